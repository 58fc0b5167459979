"""Helpers shared by the text operators: Arrow batches, a bounded word cache, checkpoints."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.keys import helper_name
from ..session import checkpoint_dir, ship_package

# A batch sent to a Python worker: at most so many rows and about so many bytes, so that very
# long texts do not pile up in one batch.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

_STATE: dict = {}


def worker_state(slot: str, key, build: Callable):
    """``build()`` once per Python worker (workers are reused by many tasks). A worker keeps the
    last value only, so that the caches and models of earlier steps do not pile up."""
    if _STATE.get("at") != (slot, key):
        _STATE.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _STATE.update(at=(slot, key), value=build())
    return _STATE["value"]


class WordCache:
    """Values per word in two generations of at most ``cap`` words each: frequent words are
    carried over when the young generation is full, rare ones are computed again. Memory is
    bounded whatever the vocabulary; results do not depend on what is cached."""

    def __init__(self, compute: Callable[[list], Iterable], cap: int):
        self.compute, self.cap, self.young, self.old = compute, cap, {}, {}

    def ensure(self, words: Iterable) -> dict:
        """A dict that holds a value for every one of ``words``."""
        if len(self.young) > self.cap:
            self.old, self.young = self.young, {}
        young, old, missing = self.young, self.old, []
        for w in set(words) - young.keys():
            v = old.get(w)
            if v is None:
                missing.append(w)
            else:
                young[w] = v
        if missing:
            young.update(zip(missing, self.compute(missing), strict=True))
        return young


def bounded_batches(df: DataFrame) -> None:
    """Ready ``df``'s session for functions on batches: their size, and the package in the workers."""
    ship_package(df.sparkSession)
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def with_arrow(df: DataFrame, make: Callable[[], Callable], out: list[tuple[str, str]], inputs: list[Column],
               keep: list[str] | None = None, flat: bool = False) -> DataFrame:
    """``df``'s ``keep`` columns (all when None) plus ``out`` columns computed in Arrow batches.
    A kept column with the name of an ``out`` column gives way to it.

    ``make()`` runs in the worker and returns a function of the input columns (Arrow arrays)
    giving one list or array per ``out`` column. With ``flat`` it also returns, first, the
    input row index of each output row, so that a row may give several.
    """
    bounded_batches(df)
    keep = [c for c in (df.columns if keep is None else keep) if c not in {n for n, _ in out}]
    names = [helper_name("in") for _ in inputs]
    source = df.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(n) for c, n in zip(inputs, names, strict=True)])
    schema = T.StructType([*[df.schema[c] for c in keep],
                           *[T.StructField(n, T._parse_datatype_string(t)) for n, t in out]])
    k = len(keep)

    def run(batches):
        fn = make()
        arrow = to_arrow_schema(schema)
        for batch in batches:
            got = list(fn(*[batch.column(k + i) for i in range(len(names))]))
            kept = [batch.column(i) for i in range(k)]
            if flat:
                rows = pa.array(got.pop(0), pa.int64())
                kept = [c.take(rows) for c in kept]
            cols = [c if isinstance(c, pa.Array) else pa.array(c, f.type)
                    for c, f in zip(got, list(arrow)[k:], strict=True)]
            yield pa.RecordBatch.from_arrays(kept + cols, names=arrow.names)

    return source.mapInArrow(run, schema)


def text_of(text: str = "text") -> Column:
    """The text column as a string, null as empty."""
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there after."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def word_index(texts: pa.Array, split: Callable = pc.ascii_split_whitespace) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, place of each word among them, first word of each text and the end) of
    texts cut by ``split``; empty words are left out."""
    lists = split(texts)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.dictionary_encode(lists.flatten())
    index, distinct = (x.to_numpy(zero_copy_only=False) for x in (words.indices, words.dictionary))
    distinct = distinct.tolist()  # of all at once: to_pylist() makes a scalar a word
    offsets = offsets - offsets[0]
    if "" in distinct:
        filled = index != distinct.index("")
        offsets = np.concatenate([[0], np.cumsum(filled)])[offsets]
        index = index[filled]
    return distinct, index, offsets


def sums_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row sums of ``values`` (a row per word) for each text."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=values.dtype)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        out[filled] = np.add.reduceat(values, offsets[filled], axis=0)
    return out


def joined_bytes(values: list[bytes], index: np.ndarray, offsets: np.ndarray) -> list[memoryview]:
    """The values of each text's words, one after the other."""
    if not len(index):
        return [memoryview(b"")] * (len(offsets) - 1)
    taken = pa.array(values, pa.large_binary()).take(pa.array(index))
    places = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset:taken.offset + len(taken) + 1]
    data, at = memoryview(taken.buffers()[2]), places[offsets]
    return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def release(spark, settle: float = 0.0) -> None:
    """Let Spark drop what earlier steps left: shuffle files, checkpoints and broadcasts go when the
    driver collects its garbage, which a driver with room to spare puts off. What Python lets go is
    told to the JVM once a second; with ``settle`` seconds before, that goes too."""
    gc.collect()
    time.sleep(settle)
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]
