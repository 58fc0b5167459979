"""Writing results (R41–R43) and split outputs (R31–R35 sink form)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quote
from ..operators.keys import helper_name, spreader
from ..operators.membership import Result
from ..operators.split import GROUP, PART, SHEET_DIR, TARGET, sums_before
from ..session import checkpoint_dir

FORMATS = ("parquet", "csv")


def format_for(path: str, fmt: str | None) -> str:
    """The given format, else the one the path's suffix names (``.csv``), else parquet."""
    if fmt:
        return fmt
    return "csv" if path.rstrip("/").lower().endswith(".csv") else "parquet"


def _writer(df: DataFrame, fmt: str, mode: str):
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    w = df.write.mode(mode).format(fmt)
    return w.option("header", True) if fmt == "csv" else w


def project(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Only the ticked columns, in the given order; none ticked = all."""
    if not columns:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in the result")
    return df.select(*[F.col(quote(c)) for c in columns])


def _outputs(result: Result | DataFrame) -> dict[str, DataFrame]:
    """Every output by name. Where one join holds the rows of several, it is run once: written as a table to
    the shared checkpoint folder (which outlives an executor, as a cache does not) and read for each."""
    if isinstance(result, DataFrame):
        return {"result": result}
    parts = {"result": result.data, "not_found": result.not_found, "found": result.found}
    parts = {name: df for name, df in parts.items() if df is not None}
    if result.source is not None and len(parts) > 1 and set(parts) <= set(result.views):
        spark = result.source.sparkSession
        stage = f"{checkpoint_dir(spark)}/outputs-{uuid.uuid4().hex}"
        result.source.write.parquet(stage)
        source = spark.read.parquet(stage)
        parts = {name: result.views[name](source) for name in parts}
    return parts


def _written(parts: dict[str, DataFrame], folder: str, fmt: str, columns: Sequence[str] | None, mode: str) -> dict[str, int]:
    counts: dict[str, int] = {}
    for name, df in parts.items():
        obs = Observation(f"{name}_rows")
        out = project(df, columns) if name == "result" else df
        _writer(out.observe(obs, F.count(F.lit(1)).alias("n")), fmt, mode).save(f"{folder}/{name}")
        counts[f"{name}_rows"] = obs.get["n"]
    return counts


def export(result: Result | DataFrame, path: str, *, fmt: str | None = None, columns: Sequence[str] | None = None,
           mode: str = "errorifexists", run_id: str | None = None) -> dict[str, int]:
    """Write ``path/result`` and, when present, ``path/not_found`` and ``path/found``.

    Row counts are gathered by ``observe`` while writing, so no extra job counts them (R44).
    Without ``fmt`` the format follows the path's suffix.

    With ``run_id`` the export is all or nothing: outputs go to a folder of the run, which :func:`read_export`
    does not see before the run's manifest, written last, is there. A run that was cut off is started again with
    the same id and replaces what it left; one that is complete only gives its counts again.
    """
    fmt = format_for(path, fmt)
    if run_id is None:
        return _written(_outputs(result), path, fmt, columns, mode)
    if not run_id or not re.fullmatch(r"[A-Za-z0-9.-]+", run_id):
        raise ValueError("run_id may hold letters, digits, dots and hyphens")
    spark = (result if isinstance(result, DataFrame) else result.data).sparkSession
    done = [r for r in _manifests(spark, path) if r["run_id"] == run_id]
    if done:
        return {f"{r['output']}_rows": r["n_rows"] for r in done}
    counts = _written(_outputs(result), f"{path}/runs/{run_id}", fmt, columns, "overwrite")
    rows = [(run_id, name.removesuffix("_rows"), fmt, n) for name, n in counts.items()]
    manifest = spark.createDataFrame(rows, "run_id string, output string, format string, n_rows long").coalesce(1)
    manifest.withColumn("committed", F.current_timestamp().cast("string")).write.mode("overwrite").json(f"{path}/manifests/{run_id}")
    return counts


_MANIFEST = "run_id string, output string, format string, n_rows long, committed string"


def _manifests(spark: SparkSession, path: str) -> list:
    """The outputs of every complete run: a handful of rows a run."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/manifests/*").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def read_export(spark: SparkSession, path: str, output: str = "result", *, run_id: str | None = None) -> DataFrame:
    """An output of an export with ``run_id``: of that run, else of the complete run that ended last."""
    runs = [r for r in _manifests(spark, path) if run_id in (None, r["run_id"])]
    if not runs:
        raise ValueError(f"no complete export {run_id or ''} under {path}")
    last = max(runs, key=lambda r: (r["committed"], r["run_id"]))["run_id"]
    found = [r for r in runs if r["run_id"] == last and r["output"] == output]
    if not found:
        raise ValueError(f"the export {last} has no output {output!r}")
    reader = spark.read.option("header", True) if found[0]["format"] == "csv" else spark.read
    return reader.format(found[0]["format"]).load(f"{path}/runs/{last}/{output}")


def packed(tagged: DataFrame, keys: Sequence[str], task_bytes: int) -> DataFrame:
    """``tagged`` dealt out to write tasks by measured bytes: a group over ``task_bytes`` gets as many tasks of its
    own as it needs, smaller ones share tasks and are never cut, so a tiny group is one file.

    The rows' bytes (text lengths, eight bytes for other values) are summed by group, map-side first; groups
    are placed one after another by prefix sums in two levels, and rows learn their group's tasks by a join
    that adaptive execution may split where a group is large."""
    of, size, pieces, start = (helper_name(s) for s in ("of", "size", "pieces", "start"))
    text = [F.coalesce(F.octet_length(F.col(quote(f.name))), F.lit(0)) for f in tagged.schema if isinstance(f.dataType, T.StringType)]
    row_size = sum(text, F.lit(8 * (len(tagged.columns) - len(text)) + 1)).cast("long")
    box = F.struct(*[F.col(quote(k)) for k in keys])
    groups = tagged.groupBy(box.alias(of)).agg(F.sum(row_size).alias(size))
    large = F.col(size) > task_bytes
    groups = groups.withColumn(pieces, F.when(large, F.ceil(F.col(size) / task_bytes)).otherwise(0).cast("int"))
    # Two runs of places: bytes of small groups, tasks of large ones.
    groups = groups.withColumn("small", F.when(large, 0).otherwise(F.col(size)))
    low = sums_before(groups.select(of, "small"), of, "small", start)
    high = sums_before(groups.where(large).select(of, pieces), of, pieces, start)
    last = low.agg(F.max(F.floor(F.col(start) / task_bytes))).first()[0]
    first = 0 if last is None else int(last) + 1
    total = first + int(groups.agg(F.coalesce(F.sum(pieces), F.lit(0))).first()[0])
    places = (groups.where(~large).join(low, of).select(of, F.floor(F.col(start) / task_bytes).cast("int").alias("task"), F.lit(1).alias("tasks"))
              .unionAll(groups.where(large).join(high, of).select(of, (F.col(start) + first).cast("int"), F.col(pieces))))
    places = places.select(F.col(of).alias(start), F.col("task").alias(size), F.col("tasks").alias(pieces))
    joined = tagged.withColumn(of, box).withColumn("_spread", spreader(tagged)).join(places, F.col(of) == F.col(start))
    task = (F.col(size) + F.pmod(F.col("_spread"), F.col(pieces)).cast("int")).cast("int")
    return joined.withColumn(size, task).repartitionById(max(1, total), size).select(*[F.col(quote(c)) for c in tagged.columns])


def write_split(tagged: DataFrame, path: str, *, fmt: str | None = None, mode: str = "errorifexists",
                max_records_per_file: int | None = None, observation: Observation | None = None,
                task_bytes: int | None = None) -> None:
    """One folder per output tag of a split.

    Column splits are *rebalanced* by the tag: adaptive execution sizes the write tasks
    from measured data and splits a tag that holds a large share of rows, so no task
    writes a hot group alone. Line splits are rebalanced by part in the same way, whatever the
    input's partitions. ``observation`` receives the row count ``n`` of the written rows.

    With ``task_bytes`` the groups are measured first and packed into write tasks of about that many bytes
    (:func:`packed`): the number of files is bounded by the groups and the bytes, one file per small group.
    """
    fmt = format_for(path, fmt)
    if GROUP in tagged.columns:
        keys = [SHEET_DIR, GROUP] if SHEET_DIR in tagged.columns else [GROUP]
    elif TARGET in tagged.columns:
        keys, tagged = [TARGET], tagged.drop(PART)
    elif PART in tagged.columns:
        keys = [PART]
    else:
        raise ValueError("not a split table: no _group, _part or _target column")
    # Adaptive execution sizes the write tasks, or their groups are packed by measured bytes.
    out = packed(tagged, keys, task_bytes) if task_bytes else tagged.hint("rebalance", *keys)
    if observation is not None:
        # Observed here, above any repartition: a range split samples its input first,
        # and an observation below it would count those rows twice.
        out = out.observe(observation, F.count(F.lit(1)).alias("n"))
    w = _writer(out, fmt, mode).partitionBy(*keys)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.save(path)
