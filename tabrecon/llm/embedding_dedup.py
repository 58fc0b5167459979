"""Near duplicates among embeddings by Euclidean p-stable hashing.

Vectors are normalised, so a cosine of c is a distance of sqrt(2 - 2c). A hash is
``floor((x . r + b) / width)`` for a Gaussian ``r``; a table's bucket is the tuple of ``hashes`` such values.
Vectors that share a bucket in some table are compared exactly, in double precision.

How likely two vectors at a distance share a hash is known in closed form (:func:`collision`), and
sets both numbers (:func:`plan`): as many hashes a table as leave a vector about ``strangers`` unrelated
vectors (at right angles) in its bucket, and as many tables as find a pair exactly at the threshold with
probability ``recall``; closer pairs are found more often. Both grow with the logarithm and a power of about
0.19 of the number of vectors; nothing is capped.

1. Equal vectors are one class (128 bits of hash) with its number of copies: a group of exact copies is
   one row from here on.
2. A row per class and table is counted by bucket (a count per task first); buckets of one class go.
3. Of the others every member is compared with every other. Buckets over ``BLOCK`` members are dealt into
   blocks, and each pair of blocks is one bounded group; no pair becomes a row, a task returns each
   vector's number of links and a spanning forest. A pair counts in the first table that it shares only.
4. Components by :mod:`components`.

Null vectors, zero vectors and those with null or non-finite components link with nothing, nor do vectors of
different lengths. Repeated rows are copies of each other. Ids may repeat or be null: a component's id is its
least one that is not null. Other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, release, worker_state
from .components import connected

BLOCK = 2000        # members of a bucket compared as one side of a group
_SMALL = 32         # runs up to here are compared pair by pair, all runs of a batch at once
_PAIRS = 100_000    # pairs compared at once


def collision(distance: float, width: float) -> float:
    """Probability that two vectors at ``distance`` have one hash value."""
    t = width / distance
    phi = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, cosine: float, recall: float, strangers: float = 1.0, widths: float = 6.0) -> tuple[float, int, int]:
    """(width, hashes a table, tables) for ``n`` vectors."""
    near = math.sqrt(2 - 2 * cosine)
    width = widths * near
    far = math.log(collision(math.sqrt(2), width))
    hashes = max(1, math.ceil(math.log(max(n, 2) / strangers) / -far))
    found = collision(near, width) ** hashes
    return width, hashes, max(1, math.ceil(math.log(1 - recall) / math.log1p(-found)))


def _directions(dim: int, hashes: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim, hashes, tables])
    return rng.standard_normal((dim, tables * hashes)), rng.random(tables * hashes)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` at length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector."""
    starts = np.asarray(vectors.offsets).astype(np.int64)
    sizes, values = np.diff(starts), np.asarray(vectors.values)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield rows, values[starts[rows][:, None] + np.arange(dim)]


def signatures(vectors: pa.ListArray, width: float, hashes: int, tables: int, seed: int) -> np.ndarray:
    """A bucket number of 64 bits per vector and table; it depends on the vector's length too."""
    out = np.zeros((len(vectors), tables), dtype=np.uint64)
    for rows, x in _by_length(vectors):
        r, shift = worker_state("directions", (x.shape[1], hashes, tables, seed), lambda: _directions(x.shape[1], hashes, tables, seed))  # noqa: B023
        cells = np.floor(unit(x) @ r / width + shift).astype(np.int64).view(np.uint64).reshape(len(rows), tables, hashes)
        h = np.full((len(rows), tables), x.shape[1], dtype=np.uint64) + np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        with np.errstate(over="ignore"):
            for k in range(hashes):
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k]
                h ^= h >> np.uint64(29)
            h = h * np.uint64(0xBF58476D1CE4E5B9)
        out[rows] = h ^ (h >> np.uint64(32))
    return out.view(np.int64)


def _spanning(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the components of a square boolean matrix."""
    open_, out = np.ones(len(ids), dtype=bool), []
    for start in range(len(ids)):
        if not open_[start]:
            continue
        open_[start] = False
        front = [start]
        while front:
            at = front.pop()
            new = np.flatnonzero(linked[at] & open_)
            open_[new] = False
            out += [(ids[at], ids[k]) for k in new.tolist()]
            front += new.tolist()
    return out


class _Links:
    """Compares the members of complete groups; gathers links per vector and spanning links."""

    def __init__(self, cosine: float):
        self.cosine = cosine

    def groups(self, run: np.ndarray, uid, copies, table, block, sides, x, sig):
        """Rows sorted by ``run``. (uids, numbers of links, ends a, ends b) of all its groups."""
        links, ends = np.zeros(len(uid), np.int64), []
        starts = np.flatnonzero(np.diff(run, prepend=run[0] - 1))
        sizes = np.diff([*starts, len(run)])
        small = np.repeat(sizes <= _SMALL, sizes) & ~sides
        for apart in range(1, min(_SMALL, int(sizes.max(initial=0)))):
            a = np.flatnonzero(small[:-apart] & (run[:-apart] == run[apart:]))
            for at in range(0, len(a), _PAIRS):
                i = a[at:at + _PAIRS]
                j = i + apart
                near = np.einsum("ij,ij->i", x[i], x[j]) >= self.cosine
                i, j = i[near], j[near]
                first = np.argmax(sig[i] == sig[j], axis=1) == table[i]
                i, j = i[first], j[first]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                ends += zip(uid[i].tolist(), uid[j].tolist(), strict=True)
        for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            if n < 2 or small[s]:
                continue
            g = slice(s, s + n)
            near = x[g] @ x[g].T >= self.cosine
            if block[s:s + n].min() != block[s:s + n].max():   # two blocks: pairs across only
                near &= block[g][:, None] != block[g][None, :]
            for t in range(int(table[s])):
                near &= sig[g, t][:, None] != sig[g, t][None, :]
            np.fill_diagonal(near, False)
            links[g] += near @ copies[g]
            ends += _spanning(near, uid[g])
        return uid[links > 0], links[links > 0], ends


def _compare(batches: Iterator[pa.RecordBatch], cosine: float):
    """Rows come sorted by group; a group's rows may go on in the next batch."""
    judge, held = _Links(cosine), None
    names = ["key", "i", "j"]

    def judged(t: pa.Table):
        if not t.num_rows:
            return
        t = t.combine_chunks()
        col = {n: np.asarray(t[n]) for n in t.schema.names if n not in ("vec", "sig")}
        new = np.zeros(t.num_rows, dtype=bool)
        for n in names:
            new[1:] |= col[n][1:] != col[n][:-1]
        run = np.cumsum(new)
        sig = np.asarray(t["sig"].chunk(0).flatten()).reshape(t.num_rows, -1)
        for rows, x in _by_length(t["vec"].chunk(0)):
            uid, links, ends = judge.groups(run[rows], *[col[n][rows] for n in ("uid", "copies", "table", "block")],
                                            (col["i"] != col["j"])[rows], unit(x), sig[rows])
            n = len(uid) + len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*uid.tolist(), *[int(a) for a, _ in ends]], pa.int64()), pa.array([None] * len(uid) + [int(b) for _, b in ends], pa.int64()),
                 pa.array([*links.tolist(), *[0] * (n - len(uid))], pa.int64())], names=["a", "b", "links"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        n, same = t.num_rows, np.ones(t.num_rows, dtype=bool)
        if not n:
            continue
        for c in names:
            values = np.asarray(t[c].combine_chunks())
            same &= values == values[-1]
        full = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        yield from judged(t.slice(0, full))
        held = t.slice(full)
    if held is not None:
        yield from judged(held)


def _sound(vec: Column) -> Column:
    """Vectors that may link: some component is not zero, none is null or not finite."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(vec, lambda v: v != 0)


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.95,
                    recall: float = 0.9, seed: int = 1) -> DataFrame:
    """One row per vector: its id (as ``vec_id``), n_links (other vectors linked directly), component_id and kept."""
    bounded_batches(vectors)
    kind = vectors.schema[embedding].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    vec = F.col(f"`{embedding}`").cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), vec.alias("vec"))
    rows = rows.withColumn("sound", _sound(F.col("vec")))
    print_ = [F.when(F.col("sound"), F.xxhash64(F.lit(k), "vec")).alias(f"print{k}") for k in (1, 2)]
    rows = rows.select("vec_id", "vec", *print_)
    prints = ["print1", "print2"]
    classes = rows.where("print1 is not null").groupBy(*prints).agg(
        F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id"))
    classes = cut(classes.withColumn("uid", F.monotonically_increasing_id()))
    width, hashes, tables = plan(classes.count(), cosine, recall)

    def sign(batches):
        for b in batches:
            sig = signatures(b.column(3), width, hashes, tables, seed)
            out = pa.ListArray.from_arrays(np.arange(0, sig.size + 1, tables, dtype=np.int32), sig.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=["uid", "copies", "least_id", "vec", "sig"])

    kinds = {n: t for n, t in classes.dtypes}
    signed = cut(classes.select("uid", "copies", "least_id", "vec").mapInArrow(
        sign, f"uid long, copies long, least_id {kinds['least_id']}, vec {kinds['vec']}, sig array<bigint>"))
    entries = signed.select("uid", F.posexplode("sig").alias("table", "key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = entries.join(buckets, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    dealt = (shared.withColumn("block", block)
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("uid", "table", "key", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j")))
    group = ["key", "i", "j"]
    compared = cut(dealt.join(signed.drop("least_id"), "uid").repartition(*group).sortWithinPartitions(*group)
                   .select("uid", "copies", "table", "block", "vec", "sig", *group)
                   .mapInArrow(lambda batches: _compare(batches, cosine), "a long, b long, links long"))
    release(vectors.sparkSession)
    links = compared.where("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("links").alias("links"))
    labels = connected(compared.where("b is not null").select("a", "b"))
    named = (classes.select("uid", "least_id", "copies", *prints).join(links, "uid", "left").join(labels, "uid", "left")
             .withColumn("comp", F.coalesce("comp", "uid")))
    named = cut(named)
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "comp").select(*prints, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return (rows.select("vec_id", *prints).join(named, prints, "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
