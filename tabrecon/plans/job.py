"""Declarative jobs (R46, R47): read sources, run one operation, write outputs, report counts.

A spec is a plain dict (JSON-serialisable), the batch counterpart of a saved profile::

    {"operation": "enrich",
     "a": "in/a.parquet", "b": "in/b.csv",          # or lists for the many-file modes
     "key_a": "id", "key_b": "id",
     "options": {"select_b": ["name"], "how": "left"},
     "output": {"path": "out/run1", "format": "parquet", "columns": null}}

A workbook input is read as one sheet (``sheet_a`` / ``sheet_b``, default the first),
except for ``combine``, which takes every sheet of every workbook, and a per-sheet column
split. ``from_profile`` turns a profile saved by the reference into such a spec.

Every check that needs only names or types runs before any Spark job (R47).
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..functions.predicates import CONDITIONS, condition_code
from ..operators.enrich import enrich
from ..operators.extract import extract
from ..operators.membership import Result, intersect, membership_many_a, membership_many_b, subtract
from ..operators.split import split_by_columns, split_by_lines, split_by_source
from ..operators.stack import combine
from ..sinks.export import FORMATS, export, write_split
from ..sources.csv import infer_types
from ..sources.scan import read_many, read_table
from ..sources.workbook import is_row, read_workbooks

OPERATIONS = ("subtract", "intersect", "enrich", "stack", "combine", "extract", "split_columns",
              "split_lines", "split_sources")
_NEEDS = {
    "subtract": ("a", "b", "key_a", "key_b"), "intersect": ("a", "b", "key_a", "key_b"),
    "enrich": ("a", "b", "key_a", "key_b"), "stack": ("a", "b"), "combine": ("inputs",),
    "extract": ("a",), "split_columns": ("a",), "split_lines": ("a",), "split_sources": ("inputs",),
}


def validate(spec: Mapping[str, Any]) -> None:
    """Raise ``ValueError`` for a spec that cannot run, before reading any data."""
    op = spec.get("operation")
    if op not in OPERATIONS:
        raise ValueError(f"unknown operation {op!r}; expected one of {OPERATIONS}")
    missing = [k for k in _NEEDS[op] if not spec.get(k)]
    if missing:
        raise ValueError(f"{op}: missing {missing}")
    out = spec.get("output") or {}
    if not out.get("path"):
        raise ValueError("output.path is required")
    if out.get("format") not in (None, *FORMATS):
        raise ValueError(f"output.format must be one of {FORMATS}")
    opts = spec.get("options") or {}
    if op == "enrich" and not opts.get("select_b"):
        raise ValueError("enrich: options.select_b must name at least one B column")
    if op == "extract" and not (opts.get("column") and opts.get("condition")):
        raise ValueError("extract: options.column and options.condition are required")
    if op == "extract" and condition_code(opts["condition"]) not in CONDITIONS:
        raise ValueError(f"extract: unknown condition {opts['condition']!r}")
    if op == "split_columns" and not (opts.get("split_columns") and opts.get("keep_columns")):
        raise ValueError("split_columns: options.split_columns and options.keep_columns are required")
    if op == "split_lines" and int(opts.get("lines_per_file", 200)) <= 0:
        raise ValueError("split_lines: lines_per_file must be greater than 0")


def _inputs(spark: SparkSession, value, *, all_sheets: bool = False) -> list[DataFrame]:
    return read_many(spark, [value] if isinstance(value, str) else list(value), all_sheets=all_sheets)


def _one(spark: SparkSession, spec: Mapping[str, Any], side: str) -> DataFrame:
    return read_table(spark, spec[side], spec.get(f"sheet_{side}", 0))


def _sheets_flat(spark: SparkSession, path: str) -> DataFrame:
    """Every sheet of the workbook(s) at ``path`` as one table tagged with ``_file`` and
    ``_sheet``, its columns the union of the sheets' headers (first seen first), found in one
    job whatever the number of sheets."""
    long = read_workbooks(spark, path)
    heads = (long.groupBy("_file", "_sheet_index").agg(F.first(F.map_keys("cells")).alias("names"))
             .select("_file", "_sheet_index", F.posexplode("names").alias("at", "name"))
             .groupBy("name").agg(F.min(F.struct("_file", "_sheet_index", "at")).alias("seen")).orderBy("seen").collect())
    names = [r["name"] for r in heads]
    flat = long.where(is_row()).select("_file", "_sheet", "_sheet_count", *[F.col("cells").getItem(n).alias(n) for n in names])
    return infer_types(flat)


# What a split without any output says.
_NOTHING = {"split_lines": "the table has no data to split", "split_columns": "no group to write: the table has no rows",
            "split_sources": "no workbook has two sheets or more with rows"}


def _run(spark: SparkSession, spec: Mapping[str, Any]) -> tuple[Result | DataFrame, dict[str, DataFrame | list[DataFrame]]]:
    op, opts = spec["operation"], dict(spec.get("options") or {})
    if op in ("subtract", "intersect"):
        as_ = [_one(spark, spec, "a")] if isinstance(spec["a"], str) else _inputs(spark, spec["a"])
        bs = [_one(spark, spec, "b")] if isinstance(spec["b"], str) else _inputs(spark, spec["b"])
        ka, kb = spec["key_a"], spec["key_b"]
        inputs = {"a": as_, "b": bs}
        if len(as_) > 1 and len(bs) > 1:
            raise ValueError("several A files and several B files at once are not supported")
        if len(as_) > 1:
            return membership_many_a(as_, bs[0], ka, kb, minus=op == "subtract", **opts), inputs
        if len(bs) > 1:
            return membership_many_b(as_[0], bs, ka, kb, minus=op == "subtract", **opts), inputs
        if op == "subtract":
            return subtract(as_[0], bs[0], (ka, kb), **opts), inputs
        return intersect(as_[0], bs[0], (ka, kb), **opts), inputs
    if op == "enrich":
        a, b = _one(spark, spec, "a"), _one(spark, spec, "b")
        return enrich(a, b, (spec["key_a"], spec["key_b"]), **opts), {"a": a, "b": b}
    if op == "stack":
        a, b = _one(spark, spec, "a"), _one(spark, spec, "b")
        return combine([a, b], **opts), {"a": a, "b": b}
    if op == "combine":
        return combine(_inputs(spark, spec["inputs"], all_sheets=True), **opts), {}
    if op == "split_sources":
        flat = _sheets_flat(spark, spec["inputs"])
        split = split_by_source(flat, opts.get("pattern", "{fichier}_{onglet}"))
        return split.drop("_file", "_sheet", "_sheet_count"), {}
    if op == "split_columns" and opts.get("per_sheet") and spec["a"].lower().endswith(".xlsx"):
        a = _sheets_flat(spark, spec["a"])
    else:
        a = _one(spark, spec, "a")
    if op == "extract":
        return extract(a, opts.pop("column"), opts.pop("condition"), opts.pop("value", None), **opts), {"a": a}
    if op == "split_columns":
        return split_by_columns(a, opts["split_columns"], opts["keep_columns"], per_sheet=opts.get("per_sheet", False)), {"a": a}
    if op == "split_lines":
        return split_by_lines(a, int(opts.get("lines_per_file", 200)), order=opts.get("order")), {"a": a}
    raise ValueError(f"unknown operation {op!r}")


# The reference's operation names (as its profiles store them), in its
# order, with the operation each one is.
OPERATION_NAMES = {
    "Soustraire  (A − B)": "subtract", "Fusionner  (A ∪ B)": "stack", "Intersecter  (A ∩ B)": "intersect",
    "Enrichir  (A ← B)": "enrich", "Combiner  (Multi-fichiers)": "combine", "Extraire  (Filtrer A)": "extract",
    "Scinder  (Onglets)": "split_sources", "Scinder  (Colonnes)": "split_columns", "Scinder  (Lignes)": "split_lines",
}
# The reference's "no dedup key" choices of stack and combine.
ALL_COLUMNS_CHOICES = ("— aucune (toutes les colonnes) —", "— toutes les colonnes —")


def _operation_code(name: str) -> str:
    """The reference's operation name as one of ``OPERATIONS``: the exact name (spaces
    aside), else its leading word, as the reference dispatches (splits need the exact
    name there too)."""
    if name in OPERATIONS:
        return name
    words = " ".join(str(name).split())
    for ref, code in OPERATION_NAMES.items():
        if words == " ".join(ref.split()):
            return code
    for ref, code in OPERATION_NAMES.items():
        if not code.startswith("split_") and ref.split()[0] in words:
            return code
    raise ValueError(f"unknown operation {name!r}")


def from_profile(profile: Mapping[str, Any] | str, **overrides: Any) -> dict[str, Any]:
    """A job spec from a profile saved by the reference (its 12 keys, its French names).

    The profile holds the two files, the membership keys, the operation, the extract
    settings, the stack dedup settings and the output path. Settings it never stored
    (enrich keys and columns, split columns, combine inputs, …) are given as
    ``overrides``: top-level spec keys, with ``options`` / ``output`` merged key by key.
    The output format follows the path's suffix; a workbook path (``.xlsx``) is written
    as a parquet folder of that name.
    """
    p = json.loads(profile) if isinstance(profile, str) else dict(profile)
    op = _operation_code(p.get("operation", ""))
    spec: dict[str, Any] = {"operation": op, "options": {}, "output": {"path": p.get("output_path") or None}}
    if p.get("file_a"):
        spec["a"] = p["file_a"]
    if p.get("file_b") and op in ("subtract", "intersect", "enrich", "stack"):
        spec["b"] = p["file_b"]
    if op in ("subtract", "intersect"):
        spec["key_a"], spec["key_b"] = p.get("col_a"), p.get("col_b")
    elif op == "stack":
        key = p.get("extend_key") or None
        spec["options"] = {"dedup": bool(p.get("extend_dedup", True)),
                           "dedup_key": None if key in ALL_COLUMNS_CHOICES else key}
    elif op == "extract":
        spec["options"] = {"column": p.get("extract_col"), "condition": p.get("extract_condition"),
                           "value": p.get("extract_value", ""), "case_sensitive": bool(p.get("extract_case", False))}
    for key, value in overrides.items():
        if key in ("options", "output") and isinstance(value, Mapping):
            spec[key] = {**spec.get(key, {}), **value}
        else:
            spec[key] = value
    validate(spec)
    return spec


def run_job(spark: SparkSession, spec: Mapping[str, Any] | str) -> DataFrame:
    """Run one spec (dict or JSON text) and return a one-row DataFrame of row counts.

    Output row counts are observed during the writes; input counts are separate count
    jobs (parquet answers them from file footers)."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    validate(spec)
    out = spec["output"]
    fmt, path, mode = out.get("format"), out["path"], out.get("mode", "errorifexists")
    result, inputs = _run(spark, spec)
    counts: dict[str, int] = {f"{name}_rows": sum(df.count() for df in (dfs if isinstance(dfs, list) else [dfs]))
                              for name, dfs in inputs.items()}
    if spec["operation"].startswith("split_"):
        from pyspark.sql import Observation

        obs = Observation("split_rows")
        write_split(result, path, fmt=fmt, mode=mode, max_records_per_file=out.get("max_records_per_file"),
                    observation=obs, task_bytes=out.get("task_bytes"))
        counts["result_rows"] = obs.get["n"]
        if not counts["result_rows"]:
            raise ValueError(_NOTHING[spec["operation"]])
    else:
        counts.update(export(result, path, fmt=fmt, columns=out.get("columns"), mode=mode, run_id=out.get("run_id")))
    return spark.createDataFrame([counts])
