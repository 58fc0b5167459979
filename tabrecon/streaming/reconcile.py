"""The row-wise operations on a stream of A rows (Structured Streaming).

Membership, enrich and extract are stateless per row once B is fixed, so they run as
stream–static joins and filters: each micro-batch of A meets the static B (broadcast
when its measured size allows), on salted keys where some are hot. Keep-first dedup becomes streaming
deduplication, where "first" is arrival order and the seen keys are the state (bounded by a
watermark when one is given), or with a given order an aggregate that holds each key's least row. A
column split becomes a partitioned file sink.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import quote
from ..operators.attach import NamePlan
from ..operators.enrich import enrich
from ..operators.extract import extract
from ..operators.keys import helper_name, key_rule, split_on, with_key, wrapped
from ..operators.membership import intersect, subtract
from ..operators.order import first_per_key, order_columns
from ..operators.split import GROUP, SHEET_DIR, split_by_columns
from ..session import checkpoint_dir


def _require_stream(df: DataFrame) -> None:
    if not df.isStreaming:
        raise ValueError("expected a streaming DataFrame (spark.readStream...)")


def _salted(stream_a: DataFrame, b: DataFrame, on, salts: int, minus: bool | None, select_b: Sequence[str] = (),
            order_b: Sequence[str | Column] | None = None, hot: DataFrame | None = None, null_text: str = "") -> DataFrame:
    """A's rows joined to B on (key, salt): a row's salt is a function of its values, so that a retried batch
    deals it alike, and B, one row per key, is there once per salt. ``hot`` (B's key column) limits the
    copies to those keys; rows of other keys all have salt 0."""
    col_a, col_b = split_on(on)
    rule = key_rule([(stream_a, col_a), (b, col_b)] + ([(hot, col_b)] if hot is not None else []), null_text=null_text)
    ka, kb, salt, found, is_hot = (helper_name(s) for s in ("ka", "kb", "salt", "found", "hot"))
    attached = list(dict.fromkeys([*select_b, col_b])) if minus is None else []
    right = b.withColumn(kb, rule.key(b, col_b))
    right = first_per_key(right, wrapped(F.col(kb)), order_b) if attached else right.select(kb).distinct()
    right = right.select(kb, *[F.col(quote(c)).alias(helper_name("b") + c) for c in attached], F.lit(True).alias(found))
    payload = [c for c in right.columns if c not in (kb,)]
    spread = F.pmod(F.xxhash64(*[F.col(quote(c)) for c in stream_a.columns]), F.lit(salts)).cast("int")
    left = with_key(stream_a, col_a, rule, ka)
    same = (lambda x, y: x.eqNullSafe(y)) if rule.raw_integral else (lambda x, y: x == y)
    copies = F.sequence(F.lit(0), F.lit(salts - 1))
    if hot is not None:
        kh = helper_name("kh")
        hot_keys = hot.select(rule.key(hot, col_b).alias(kh)).distinct().withColumn(is_hot, F.lit(True))
        # Few keys by contract: broadcast, so that the stream is not dealt by key before it is salted.
        left = left.join(F.broadcast(hot_keys), same(F.col(ka), F.col(kh)), "left")
        left = left.withColumn(salt, F.when(F.col(is_hot), spread).otherwise(0)).drop(kh, is_hot)
        right = right.join(F.broadcast(hot_keys), same(F.col(kb), F.col(kh)), "left")
        right = right.withColumn(salt + "b", F.explode(F.when(F.col(is_hot), copies).otherwise(F.array(F.lit(0))))).drop(kh, is_hot)
    else:
        left, right = left.withColumn(salt, spread), right.withColumn(salt + "b", F.explode(copies))
    joined = left.join(right, same(F.col(ka), F.col(kb)) & (F.col(salt) == F.col(salt + "b")), "left")
    own = [F.col(quote(c)) for c in stream_a.columns]
    if minus is not None:
        return joined.where(F.col(found).isNull() if minus else F.col(found).isNotNull()).select(*own)
    names = NamePlan(stream_a.columns, attached, principal="A", suffix=" (B)")
    return joined.select(*own, *[F.col(quote(p)).alias(names.b[c]) for p, c in zip(payload, attached, strict=False)])


def stream_subtract(stream_a: DataFrame, b: DataFrame, on, *, salts: int = 1, hot: DataFrame | None = None, **kw) -> DataFrame:
    """A rows of each micro-batch whose key is not in the static B (R2). With ``salts`` a hot key's rows are
    spread over so many tasks (see :func:`_salted`): micro-batches are not re-planned for skew."""
    _require_stream(stream_a)
    return subtract(stream_a, b, on, **kw) if salts == 1 else _salted(stream_a, b, on, salts, True, hot=hot, **kw)


def stream_intersect(stream_a: DataFrame, b: DataFrame, on, *, salts: int = 1, hot: DataFrame | None = None, **kw) -> DataFrame:
    """A rows of each micro-batch whose key is in the static B (R3, R5; with ``salts`` R3 only)."""
    _require_stream(stream_a)
    return intersect(stream_a, b, on, **kw).data if salts == 1 else _salted(stream_a, b, on, salts, False, hot=hot, **kw)


def stream_enrich(stream_a: DataFrame, b: DataFrame, on, *, salts: int = 1, hot: DataFrame | None = None, **kw) -> DataFrame:
    """A rows with the first matching static-B row's columns (R17–R20; with ``salts``: left, blank keys matched)."""
    _require_stream(stream_a)
    return enrich(stream_a, b, on, **kw).data if salts == 1 else _salted(stream_a, b, on, salts, None, hot=hot, **kw)


def stream_keep_first(stream: DataFrame, key: str, order: Sequence[str | Column], *, event_time: str | None = None,
                      delay: str | None = None) -> DataFrame:
    """The first row per raw key in a *given* order (R13, R16), whatever order rows arrive in.

    A streaming aggregate holds one row per key, the least by ``order`` so far (ties by the row's values). In
    output mode ``update`` a key's row is sent again when a lesser one arrives and replaces the one before; in
    ``complete`` every key's row is sent. With ``event_time`` and ``delay`` keys are taken per event-time value's
    watermark: state older than the watermark is final, sent once in mode ``append``, and dropped."""
    _require_stream(stream)
    place, row = helper_name("place"), helper_name("row")
    values = F.struct(*[F.col(quote(c)) for c in stream.columns])
    keys = [F.col(quote(key))]
    if event_time and delay:
        stream = stream.withWatermark(event_time, delay)
        keys.append(F.window(F.col(quote(event_time)), delay).alias(place + "w"))
    least = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order_columns(order))], values.alias("row")))
    return stream.groupBy(*[k if i else k.alias(place) for i, k in enumerate(keys)]).agg(least.alias(row)).select(f"{row}.row.*")


def stream_extract(stream_a: DataFrame, column: str, condition: str, value: str | None = None, **kw) -> DataFrame:
    """Rows of each micro-batch satisfying the condition."""
    _require_stream(stream_a)
    return extract(stream_a, column, condition, value, **kw)


def stream_dedup(stream: DataFrame, key: str | None = None, *, event_time: str | None = None,
                 delay: str | None = None) -> DataFrame:
    """Keep the first-arriving row per raw key (or per full row when ``key`` is None).

    With ``event_time`` and ``delay`` the seen-key state is bounded by a watermark
    (``dropDuplicatesWithinWatermark``); without, state grows with the distinct keys."""
    _require_stream(stream)
    cols = [key] if key else None
    if event_time and delay:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(cols)
    return stream.dropDuplicates(cols)


def start_split(stream: DataFrame, split_columns: Sequence[str], keep_columns: Sequence[str], path: str, *,
                fmt: str = "parquet", checkpoint: str | None = None, name: str | None = None) -> StreamingQuery:
    """Write each micro-batch into one folder per group (R31) as a file sink."""
    _require_stream(stream)
    tagged = split_by_columns(stream, split_columns, keep_columns)
    keys = [SHEET_DIR, GROUP] if SHEET_DIR in tagged.columns else [GROUP]
    return start(tagged, path, fmt=fmt, checkpoint=checkpoint, name=name, partition_by=keys)


def start(df: DataFrame, path: str, *, fmt: str = "parquet", checkpoint: str | None = None,
          name: str | None = None, partition_by: Sequence[str] | None = None) -> StreamingQuery:
    """Start an append-mode file sink; the checkpoint defaults to a folder of the stream's
    name under the session's shared checkpoint directory."""
    _require_stream(df)
    if checkpoint is None and name is None:
        raise ValueError("give the stream a name or a checkpoint folder: two streams must not share one")
    if checkpoint is None:
        checkpoint = f"{checkpoint_dir(df.sparkSession)}/stream-{name}"
    w = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if name:
        w = w.queryName(name)
    return w.start(path)
