"""Registered queries over the driver's tables, each with an equivalent DuckDB SQL text.

Every query reads whole tables and keeps all their rows, but for the rows that its operator
itself drops. Null, blank and padded keys come from one expression over ``events``
(``dirty_events``), and a B table that lacks keys is a whole table whose other rows have keys
that match nothing (``_absent``). The null and blank keys together hold about two fifths of
the rows, so hot keys are exercised too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import uuid

from ..functions.text import key_of
from ..operators.enrich import enrich
from ..operators.extract import extract
from ..operators.membership import intersect, membership_many_a, membership_many_b, subtract
from ..operators.split import manifest, split_by_columns, split_by_lines, split_by_source, split_manifest
from ..operators.stack import combine, stack
from ..plans.job import run_job
from ..plans.stats import membership_stats, preview
from ..sinks.export import export, project, read_export
from ..sinks.workbook import as_workbooks
from ..session import checkpoint_dir
from ..sources.csv import read_csv
from ..sources.scan import read_many, scan_paths, scan_tables, scan_workbooks
from ..sources.workbook import combine_sheets, parse_workbooks, select_sheet
from .sheets import as_sheets

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with key ``k``: null for ``error`` events, blank for ``signup`` events,
    else the user id padded with spaces."""
    kind = F.col("event_type")
    k = (F.when(kind == "error", F.lit(None).cast("string"))
         .when(kind == "signup", F.lit("  "))
         .otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" "))))
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value", k.alias("k"))


def _absent(df: DataFrame, key: str, where: str) -> DataFrame:
    """``df`` with the key of rows outside ``where`` replaced by a negative one."""
    return df.withColumn(key, F.when(F.expr(where), F.col(key)).otherwise(-1 - F.col(key)))


def _cust_b(spark, d):
    """Customers, those of the BUILDING segment with absent keys: a B table that lacks some keys."""
    return _absent(table(spark, d, "customer"), "c_custkey", "c_mktsegment <> 'BUILDING'")


def _orders(spark, d, where):
    return _absent(table(spark, d, "orders"), "o_custkey", where)


def _large_values(ev: DataFrame) -> DataFrame:
    """Events, with the key of those of small value replaced by one that matches nothing."""
    return ev.withColumn("k", F.when(F.col("value") > 250, F.col("k")).otherwise(F.lit("none")))


def q_normalize_key(spark, d):
    ev = dirty_events(spark, d)
    return ev.select("event_id", key_of(ev, "k").alias("key"))


def q_subtract(spark, d):
    return subtract(table(spark, d, "customer"), _orders(spark, d, "o_orderstatus = 'P'"), ("c_custkey", "o_custkey"))


def q_subtract_blank_not_in_b(spark, d):
    ev = dirty_events(spark, d).select("event_id", "k")
    return subtract(ev, _cust_b(spark, d), ("k", "c_custkey"))


def q_subtract_blank_in_b(spark, d):
    ev = dirty_events(spark, d)
    return subtract(ev.select("event_id", "k"), _large_values(ev), "k")


def q_intersect(spark, d):
    ev = dirty_events(spark, d).select("event_id", "k")
    return intersect(ev, _cust_b(spark, d), ("k", "c_custkey")).data


def q_intersect_select_a(spark, d):
    return intersect(table(spark, d, "customer"), _orders(spark, d, "o_orderstatus = 'P'"), ("c_custkey", "o_custkey"),
                     select_a=["c_name", "c_acctbal"]).data


def q_intersect_select_b(spark, d):
    return intersect(table(spark, d, "customer"), _orders(spark, d, "o_orderstatus = 'F'"), ("c_custkey", "o_custkey"),
                     select_a=["c_custkey", "c_name"], select_b=["o_orderkey", "o_totalprice"],
                     order_b=["o_orderkey"]).data


# The regions whose nations keep their keys in the name-clash queries' B.
B_REGIONS = ("AFRICA", "AMERICA", "ASIA")


def _clash_tables(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("key"),
                                           F.col("s_name").alias("name"))
    regions = table(spark, d, "region")
    b = table(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    b = _absent(b, "n_nationkey", "r_name IN ({})".format(", ".join(f"'{x}'" for x in B_REGIONS)))
    return a, b.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))


def q_intersect_conflict_principal_a(spark, d):
    a, b = _clash_tables(spark, d)
    return intersect(a, b, "key", select_a=["key", "name"], select_b=["name"], principal="A", order_b=["key"]).data


def q_intersect_conflict_principal_b(spark, d):
    a, b = _clash_tables(spark, d)
    return intersect(a, b, "key", select_a=["key", "name"], select_b=["name"], principal="B", order_b=["key"]).data


def q_intersect_not_found(spark, d):
    return intersect(_cust_b(spark, d), table(spark, d, "orders"), ("c_custkey", "o_custkey"),
                     include_not_found=True).not_found


def _two_order_sets(spark, d, second):
    return [_orders(spark, d, "o_orderstatus = 'P'"), _orders(spark, d, second)]


def q_multi_b_subtract(spark, d):
    return membership_many_b(table(spark, d, "customer"), _two_order_sets(spark, d, "o_orderpriority = '1-URGENT'"),
                             "c_custkey", "o_custkey", minus=True).data


def q_multi_b_intersect(spark, d):
    return membership_many_b(table(spark, d, "customer"), _two_order_sets(spark, d, "o_orderpriority = '1-URGENT'"),
                             "c_custkey", "o_custkey", minus=False).data


def q_multi_b_not_found(spark, d):
    return membership_many_b(_cust_b(spark, d), _two_order_sets(spark, d, "o_orderpriority = '1-URGENT'"),
                             "c_custkey", "o_custkey", minus=False, include_not_found=True).not_found


def q_multi_a_subtract(spark, d):
    return membership_many_a(_two_order_sets(spark, d, "o_orderstatus = 'F'"), _cust_b(spark, d),
                             "o_custkey", "c_custkey", minus=True).data


def q_multi_a_intersect(spark, d):
    return membership_many_a(_two_order_sets(spark, d, "o_orderstatus = 'F'"), _cust_b(spark, d),
                             "o_custkey", "c_custkey", minus=False).data


def q_multi_a_not_found(spark, d):
    return membership_many_a(_two_order_sets(spark, d, "o_orderpriority = '1-URGENT'"), table(spark, d, "customer"),
                             "o_custkey", "c_custkey", minus=False, include_not_found=True).not_found


def q_extend(spark, d):
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("n_name"))
    return stack(table(spark, d, "nation"), region)


def q_extend_dedup_rows(spark, d):
    cust = table(spark, d, "customer")
    a = cust.select(F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("seg"))
    b = cust.select(F.col("c_nationkey").alias("nk"), F.expr("CASE WHEN c_acctbal > 0 THEN c_mktsegment END").alias("seg"))
    return stack(a, b, dedup=True)


def q_extend_dedup_key(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("pk"), F.col("c_nationkey").alias("nk"),
                                           F.col("c_name").alias("name"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("pk"), F.col("s_nationkey").alias("nk"),
                                           F.col("s_name").alias("name"))
    return stack(a, b, dedup=True, dedup_key="nk", order_a=["pk"], order_b=["pk"]).select("nk", "name")


def _named(spark, d):
    cust = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nk"),
                                              F.col("c_mktsegment").alias("seg"))
    supp = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nk"))
    nat = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nk"))
    return cust, supp, nat


def q_combine(spark, d):
    return combine(list(_named(spark, d)))


def q_combine_select_columns(spark, d):
    return combine(list(_named(spark, d)), columns=["seg", "nk"])


def q_combine_dedup_rows(spark, d):
    cust, supp, _ = _named(spark, d)
    return combine([cust, supp], columns=["seg", "nk"], dedup=True)


def q_combine_dedup_key(spark, d):
    supp = table(spark, d, "supplier").select(F.col("s_suppkey").alias("pk"), F.col("s_name").alias("name"),
                                              F.col("s_nationkey").alias("nk"))
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("pk"), F.col("c_name").alias("name"),
                                              F.col("c_nationkey").alias("nk"))
    nat = table(spark, d, "nation").select(F.col("n_nationkey").alias("pk"), F.col("n_name").alias("name"),
                                           F.col("n_nationkey").alias("nk"))
    return combine([supp, cust, nat], dedup=True, dedup_key="nk", orders=[["pk"], ["pk"], ["pk"]]).select("name", "nk")


def _events_vs_cust_b(spark, d, **kw):
    ev = dirty_events(spark, d).select("event_id", "k")
    return enrich(ev, _cust_b(spark, d), ("k", "c_custkey"), select_b=["c_name"], order_b=["c_custkey"], **kw)


def q_enrich_left(spark, d):
    return _events_vs_cust_b(spark, d).data


def q_enrich_inner(spark, d):
    return _events_vs_cust_b(spark, d, how="inner").data


def _first_match(spark, d):
    return enrich(table(spark, d, "customer").select("c_custkey", "c_name"), _orders(spark, d, "o_orderstatus = 'F'"),
                  ("c_custkey", "o_custkey"), select_b=["o_totalprice"], order_b=["o_orderkey"])


def q_enrich_first_match(spark, d):
    return _first_match(spark, d).data


def q_enrich_found(spark, d):
    return _first_match(spark, d).found


def q_enrich_keep_empty(spark, d):
    ev = dirty_events(spark, d)
    b = _large_values(ev).select(F.col("event_id").alias("b_event_id"), F.col("event_type").alias("t"),
                                       F.col("k").alias("bk"))
    return enrich(ev.select("event_id", "k"), b, ("k", "bk"), select_b=["t"], skip_empty=False,
                  order_b=["b_event_id"]).data


def q_enrich_fill_empty(spark, d):
    return _events_vs_cust_b(spark, d, skip_empty=False, fill="").data


def q_enrich_fill_value(spark, d):
    return _events_vs_cust_b(spark, d, skip_empty=False, fill="N/A").data


def q_enrich_name_conflict(spark, d):
    a, b = _clash_tables(spark, d)
    return enrich(a, b, "key", select_b=["name"], order_b=["key"]).data


def q_extract_eq(spark, d):
    return extract(table(spark, d, "customer"), "c_mktsegment", "eq", "building")


def q_extract_eq_case(spark, d):
    return extract(table(spark, d, "customer"), "c_mktsegment", "eq", "BUILDING", case_sensitive=True)


def q_extract_ne_keeps_null(spark, d):
    return extract(dirty_events(spark, d).select("event_id", "k"), "k", "ne", "8")


def q_extract_contains(spark, d):
    return extract(table(spark, d, "part"), "p_name", "contains", "ring")


def q_extract_starts(spark, d):
    return extract(table(spark, d, "part"), "p_name", "starts", "red")


def q_extract_ends(spark, d):
    return extract(table(spark, d, "part"), "p_name", "ends", "widget")


def q_extract_gt(spark, d):
    return extract(table(spark, d, "customer"), "c_acctbal", "gt", "5000")


def q_extract_gt_text(spark, d):
    return extract(dirty_events(spark, d).select("event_id", "k"), "k", "gt", "50")


def q_extract_lt(spark, d):
    return extract(table(spark, d, "customer"), "c_acctbal", "lt", "0")


def q_extract_empty(spark, d):
    return extract(dirty_events(spark, d).select("event_id", "k"), "k", "empty")


def q_extract_not_empty(spark, d):
    return extract(dirty_events(spark, d).select("event_id", "k"), "k", "not_empty")


def _lineitem_split(spark, d):
    return split_by_columns(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"],
                            ["l_orderkey", "l_linenumber", "l_quantity"])


def q_split_by_columns(spark, d):
    return _lineitem_split(spark, d)


def q_split_by_columns_manifest(spark, d):
    return split_manifest(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


def _orders_lines(spark, d):
    return split_by_lines(table(spark, d, "orders").select("o_orderkey"), 200, order=["o_orderkey"])


def q_split_by_lines(spark, d):
    return _orders_lines(spark, d).select("o_orderkey", "_part")


def q_split_by_lines_file_order(spark, d):
    """File order, no sort: orders.parquet is stored in o_orderkey order, so this equals
    the key-ordered SQL (tests also check it against DuckDB's file_row_number)."""
    return split_by_lines(table(spark, d, "orders"), 200).select("o_orderkey", "_part")


def q_split_by_lines_manifest(spark, d):
    return manifest(_orders_lines(spark, d), by="_part")


def q_split_by_source_manifest(spark, d):
    long = as_sheets("all.xlsx", {"nation": table(spark, d, "nation"), "region": table(spark, d, "region")})
    return manifest(split_by_source(long, "{fichier}_{onglet}"), by="_target")


def _two_sheets(spark, d):
    return as_sheets("all.xlsx", {"nation": table(spark, d, "nation"), "region": table(spark, d, "region")})


def q_select_sheet(spark, d):
    return select_sheet(_two_sheets(spark, d), "all.xlsx", "nation")


def q_scan_sheets(spark, d):
    return scan_workbooks(_two_sheets(spark, d))


def q_split_per_sheet_manifest(spark, d):
    long = as_sheets("people.xlsx", {
        "customer": table(spark, d, "customer").select(F.col("c_nationkey").alias("nk"), F.col("c_name").alias("name")),
        "supplier": table(spark, d, "supplier").select(F.col("s_nationkey").alias("nk"), F.col("s_name").alias("name")),
    })
    flat = long.select("_sheet", F.col("cells")["nk"].alias("nk"), F.col("cells")["name"].alias("name"))
    return manifest(split_by_columns(flat, ["nk"], ["name"], per_sheet=True), by=["_sheet_dir", "_group"])


def q_csv_roundtrip(spark, d):
    """customer written as CSV by Spark into the shared checkpoint folder, read back
    with encoding detection, NA tokens and type inference."""
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, d, "customer").write.option("header", True).csv(path)
    return read_csv(spark, path)


def q_combine_files(spark, d):
    paths = [f"{d}/customer.parquet", f"{d}/supplier.parquet", f"{d}/customer.parquet"]
    return combine(read_many(spark, paths))


def q_scan_metadata(spark, d):
    return scan_tables({"nation": table(spark, d, "nation"), "region": table(spark, d, "region")})


def _stats_parts(spark, d):
    a, b = table(spark, d, "customer"), _orders(spark, d, "o_orderstatus = 'P'")
    return a, b, intersect(a, b, ("c_custkey", "o_custkey"), include_not_found=True)


def q_run_stats(spark, d):
    """Counts of an intersect run with its not-found output, all from one join."""
    a, b = table(spark, d, "customer"), _orders(spark, d, "o_orderstatus = 'P'")
    return membership_stats(a, b, ("c_custkey", "o_custkey")).select(
        "a_rows", "b_rows", F.col("a_in_b_rows").alias("result_rows"), F.col("b_not_in_a_rows").alias("not_found_rows"))


def q_preview(spark, d):
    return preview(table(spark, d, "customer"), 100, order=["c_custkey"])


def q_export_projection(spark, d):
    _, _, res = _stats_parts(spark, d)
    return project(res.data, ["c_name", "c_mktsegment"])


def q_filter_script_counts(spark, d):
    a, b = table(spark, d, "customer"), _orders(spark, d, "o_orderstatus = 'P'")
    return membership_stats(a, b, ("c_custkey", "o_custkey"), null_text="nan").select(
        F.col("a_rows").alias("global_rows"), F.col("b_rows").alias("paid_rows"),
        F.col("a_not_in_b_rows").alias("filtered_rows"))


def _shared(spark: SparkSession, stem: str) -> str:
    return f"{checkpoint_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def _documents_csv(spark: SparkSession, d: str) -> str:
    """documents as CSV files in the shared folder; their texts hold line ends."""
    path = f"{_shared(spark, 'csv')}.csv"
    (table(spark, d, "documents").write.option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def q_csv_quoted_lines(spark, d):
    """documents through CSV: records put together over lines and splits."""
    return read_csv(spark, _documents_csv(spark, d)).select("doc_id", "text", "lang", "source", "n_chars")


def q_scan_paths(spark, d):
    """Counts and headers of parquet files and of a CSV folder by path, summed up by table."""
    found = scan_paths(spark, [f"{d}/nation.parquet", f"{d}/region.parquet", _documents_csv(spark, d)])
    name = F.when(F.col("source").endswith(".parquet"), F.regexp_extract("source", r"([a-z]+)\.parquet$", 1)).otherwise("documents")
    return found.groupBy(name.alias("name"), "columns").agg(F.sum("row_count").alias("row_count"))


def _customer_workbooks(spark, d):
    """customer as real workbooks, a file per customer key modulo 4 and a sheet per market segment, parsed again."""
    path = F.concat(F.lit("part"), (F.col("c_custkey") % 4).cast("string"), F.lit(".xlsx"))
    return parse_workbooks(as_workbooks(table(spark, d, "customer"), path, F.col("c_mktsegment"), order=["c_custkey"], part_bytes=1 << 20))


def q_workbook_combine(spark, d):
    return combine_sheets(_customer_workbooks(spark, d))


def q_workbook_sheet(spark, d):
    return select_sheet(_customer_workbooks(spark, d), "part1.xlsx", "BUILDING")


def q_workbook_scan(spark, d):
    return scan_workbooks(_customer_workbooks(spark, d))


def q_workbook_split_sheets(spark, d):
    return manifest(split_by_source(_customer_workbooks(spark, d), "{fichier}_{onglet}"), by="_target")


def q_workbook_split_columns(spark, d):
    long = _customer_workbooks(spark, d).where("_row > 0")
    flat = long.select("_sheet", F.col("cells")["c_nationkey"].alias("nk"), F.col("cells")["c_name"].alias("name"))
    return manifest(split_by_columns(flat, ["nk"], ["name"], per_sheet=True), by=["_sheet_dir", "_group"])


def q_export_both_sides(spark, d):
    """An intersect with its not-found output exported from one join, both outputs read back."""
    path = _shared(spark, "export")
    export(intersect(table(spark, d, "customer"), _orders(spark, d, "o_orderstatus = 'P'"), ("c_custkey", "o_custkey"), include_not_found=True), path)
    found, missed = (spark.read.parquet(f"{path}/{n}") for n in ("result", "not_found"))
    return (found.select(F.lit("result").alias("output"), F.col("c_custkey").alias("key"), F.col("c_name").alias("what"))
            .unionAll(missed.select(F.lit("not_found"), "o_orderkey", "o_orderstatus")))


def q_export_run(spark, d):
    """An enrich exported all or nothing under a run id, its found output read through the run's manifest."""
    path = _shared(spark, "runs")
    a, b = table(spark, d, "customer"), _orders(spark, d, "o_orderstatus = 'F'")
    export(enrich(a, b, ("c_custkey", "o_custkey"), select_b=["o_totalprice"], order_b=["o_orderkey"]), path, run_id="nightly")
    return read_export(spark, path, "found").select("c_custkey", "c_name", "o_totalprice")


def q_job_enrich(spark, d):
    """A declarative job over two paths: its counts, and its written result counted again."""
    path = _shared(spark, "job")
    counts = run_job(spark, {"operation": "enrich", "a": f"{d}/customer.parquet", "b": f"{d}/orders.parquet", "key_a": "c_custkey", "key_b": "o_custkey",
                             "options": {"select_b": ["o_totalprice"], "order_b": ["o_orderkey"]}, "output": {"path": path}})
    back = spark.read.parquet(f"{path}/result").agg(F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("matched"))
    return counts.select("a_rows", "b_rows", "result_rows", "found_rows", back.select("n").scalar().alias("written_rows"),
                         back.select("matched").scalar().alias("matched_rows"))


def q_filter_script_rows(spark, d):
    """The stand-alone script's rows: a null id is the text "nan" there, so it meets no blank one."""
    ids = _absent(table(spark, d, "customer"), "c_custkey", "c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("id"))
    return subtract(dirty_events(spark, d), ids.unionAll(spark.range(1).select(F.lit("nan"))), ("k", "id"), null_text="nan")


def q_preview_file_order(spark, d):
    return preview(table(spark, d, "orders"), 100)


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}

# DuckDB text for each query, over the same parquet tables.
_D = ("WITH d AS (SELECT event_id, event_type, value, CASE WHEN event_type='error' THEN NULL WHEN event_type='signup' THEN '  ' "
      "ELSE ' '||CAST(user_id AS VARCHAR)||' ' END AS k FROM events)")


def _absent_sql(source: str, key: str, where: str) -> str:
    return f"(SELECT * REPLACE (CASE WHEN {where} THEN {key} ELSE -1 - {key} END AS {key}) FROM {source})"


_CB = "cb AS " + _absent_sql("customer", "c_custkey", "c_mktsegment<>'BUILDING'")
_NB = ("(SELECT n_name, CASE WHEN r_name IN ('AFRICA','AMERICA','ASIA') THEN n_nationkey ELSE -1 - n_nationkey END AS n_nationkey "
       "FROM nation JOIN region ON n_regionkey=r_regionkey)")
_OP, _OF, _OU = (_absent_sql("orders", "o_custkey", w) for w in (
    "o_orderstatus='P'", "o_orderstatus='F'", "o_orderpriority='1-URGENT'"))


def _k(expr: str) -> str:
    return f"coalesce(trim(CAST({expr} AS VARCHAR)),'')"


_IN_P = f"(SELECT {_k('o_custkey')} FROM {_OP})"
_IN_CB = f"(SELECT {_k('c_custkey')} FROM cb)"
_TWO_B = f"(SELECT {_k('o_custkey')} FROM (SELECT o_custkey FROM {_OP} UNION ALL SELECT o_custkey FROM {_OU}))"
_FO = ("fo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY " + _k("o_custkey") +
       f" ORDER BY o_orderkey) AS rn FROM {_OF}) WHERE rn=1)")

ORACLE_SQL: dict[str, str] = {
    "normalize_key": f"{_D} SELECT event_id, {_k('k')} AS key FROM d",
    "subtract": f"SELECT * FROM customer WHERE {_k('c_custkey')} NOT IN {_IN_P}",
    "subtract_blank_not_in_b": f"{_D}, {_CB} SELECT event_id, k FROM d WHERE {_k('k')} NOT IN {_IN_CB}",
    "subtract_blank_in_b": f"{_D} SELECT event_id, k FROM d WHERE {_k('k')} NOT IN (SELECT CASE WHEN value>250 THEN {_k('k')} ELSE 'none' END FROM d)",
    "intersect": f"{_D}, {_CB} SELECT event_id, k FROM d WHERE {_k('k')} IN {_IN_CB}",
    "intersect_select_a": f"SELECT c_name, c_acctbal FROM customer WHERE {_k('c_custkey')} IN {_IN_P}",
    "intersect_select_b": (f"WITH {_FO} SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer "
                           f"JOIN fo ON {_k('c_custkey')}={_k('o_custkey')}"),
    "intersect_conflict_principal_a": (
        f"SELECT s.s_nationkey AS key, s.s_name AS name, n.n_name AS \"name (B)\" FROM supplier s JOIN {_NB} n "
        f"ON {_k('s.s_nationkey')}={_k('n.n_nationkey')}"),
    "intersect_conflict_principal_b": (
        f"SELECT s.s_nationkey AS \"key (B)\", s.s_name AS \"name (B)\", n.n_name AS name FROM supplier s JOIN {_NB} n "
        f"ON {_k('s.s_nationkey')}={_k('n.n_nationkey')}"),
    "intersect_not_found": f"WITH {_CB} SELECT * FROM orders WHERE {_k('o_custkey')} NOT IN {_IN_CB}",
    "multi_b_subtract": f"SELECT * FROM customer WHERE {_k('c_custkey')} NOT IN {_TWO_B}",
    "multi_b_intersect": f"SELECT * FROM customer WHERE {_k('c_custkey')} IN {_TWO_B}",
    "multi_b_not_found": (
        f"WITH {_CB} SELECT * FROM {_OP} WHERE {_k('o_custkey')} NOT IN {_IN_CB} "
        f"UNION ALL SELECT * FROM {_OU} WHERE {_k('o_custkey')} NOT IN {_IN_CB}"),
    "multi_a_subtract": (
        f"WITH {_CB} SELECT * FROM {_OP} WHERE {_k('o_custkey')} NOT IN {_IN_CB} "
        f"UNION ALL SELECT * FROM {_OF} WHERE {_k('o_custkey')} NOT IN {_IN_CB}"),
    "multi_a_intersect": (
        f"WITH {_CB} SELECT * FROM {_OP} WHERE {_k('o_custkey')} IN {_IN_CB} "
        f"UNION ALL SELECT * FROM {_OF} WHERE {_k('o_custkey')} IN {_IN_CB}"),
    "multi_a_not_found": f"SELECT * FROM customer WHERE {_k('c_custkey')} NOT IN {_TWO_B}",
    "extend": ("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL BY NAME "
               "SELECT r_regionkey AS n_regionkey, r_name AS n_name FROM region"),
    "extend_dedup_rows": ("SELECT c_nationkey AS nk, c_mktsegment AS seg FROM customer UNION "
                          "SELECT c_nationkey, CASE WHEN c_acctbal>0 THEN c_mktsegment END FROM customer"),
    "extend_dedup_key": (
        "SELECT nk, name FROM (SELECT *, row_number() OVER (PARTITION BY nk ORDER BY src, pk) AS rn FROM "
        "(SELECT 0 AS src, c_custkey AS pk, c_nationkey AS nk, c_name AS name FROM customer UNION ALL "
        "SELECT 1, s_suppkey, s_nationkey, s_name FROM supplier)) WHERE rn=1"),
    "combine": ("SELECT c_name AS name, c_nationkey AS nk, c_mktsegment AS seg FROM customer UNION ALL BY NAME "
                "SELECT s_name AS name, s_nationkey AS nk FROM supplier UNION ALL BY NAME "
                "SELECT n_name AS name, n_nationkey AS nk FROM nation"),
    "combine_select_columns": ("SELECT c_mktsegment AS seg, c_nationkey AS nk FROM customer UNION ALL BY NAME "
                               "SELECT s_nationkey AS nk FROM supplier UNION ALL BY NAME "
                               "SELECT n_nationkey AS nk FROM nation"),
    "combine_dedup_rows": ("SELECT seg, nk FROM (SELECT c_mktsegment AS seg, c_nationkey AS nk FROM customer "
                           "UNION ALL BY NAME SELECT s_nationkey AS nk FROM supplier) GROUP BY ALL"),
    "combine_dedup_key": (
        "SELECT name, nk FROM (SELECT *, row_number() OVER (PARTITION BY nk ORDER BY src, pk) AS rn FROM "
        "(SELECT 0 AS src, s_suppkey AS pk, s_name AS name, s_nationkey AS nk FROM supplier UNION ALL "
        "SELECT 1, c_custkey, c_name, c_nationkey FROM customer UNION ALL "
        "SELECT 2, n_nationkey, n_name, n_nationkey FROM nation)) WHERE rn=1"),
    "enrich_left": (f"{_D}, {_CB} SELECT event_id, k, c_name, c_custkey FROM d LEFT JOIN cb "
                    f"ON {_k('k')}={_k('c_custkey')} WHERE {_k('k')}<>''"),
    "enrich_inner": (f"{_D}, {_CB} SELECT event_id, k, c_name, c_custkey FROM d JOIN cb "
                     f"ON {_k('k')}={_k('c_custkey')} WHERE {_k('k')}<>''"),
    "enrich_first_match": (f"WITH {_FO} SELECT c_custkey, c_name, o_totalprice, o_custkey FROM customer "
                           f"LEFT JOIN fo ON {_k('c_custkey')}={_k('o_custkey')}"),
    "enrich_found": (f"WITH {_FO} SELECT c_custkey, c_name, o_totalprice, o_custkey FROM customer "
                     f"JOIN fo ON {_k('c_custkey')}={_k('o_custkey')}"),
    "enrich_keep_empty": (
        f"{_D}, v AS (SELECT * REPLACE (CASE WHEN value>250 THEN k ELSE 'none' END AS k) FROM d), "
        f"b AS (SELECT * FROM (SELECT event_type AS t, k AS bk, row_number() OVER (PARTITION BY {_k('k')} "
        "ORDER BY event_id) AS rn FROM v) WHERE rn=1) "
        f"SELECT event_id, k, b.t, b.bk FROM d LEFT JOIN b ON {_k('k')}={_k('b.bk')}"),
    "enrich_fill_empty": (
        f"{_D}, {_CB} SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(k,'') AS k, coalesce(c_name,'') AS c_name, "
        f"coalesce(CAST(c_custkey AS VARCHAR),'') AS c_custkey FROM d LEFT JOIN cb ON {_k('k')}={_k('c_custkey')}"),
    "enrich_fill_value": (
        f"{_D}, {_CB} SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(k,'N/A') AS k, "
        "coalesce(c_name,'N/A') AS c_name, coalesce(CAST(c_custkey AS VARCHAR),'N/A') AS c_custkey "
        f"FROM d LEFT JOIN cb ON {_k('k')}={_k('c_custkey')}"),
    "enrich_name_conflict": (
        "SELECT s.s_suppkey AS id, s.s_nationkey AS key, s.s_name AS name, n.n_name AS \"name (B)\", "
        f"n.n_nationkey AS \"key (B)\" FROM supplier s LEFT JOIN {_NB} n "
        f"ON {_k('s.s_nationkey')}={_k('n.n_nationkey')}"),
    "extract_eq": "SELECT * FROM customer WHERE lower(trim(c_mktsegment))='building'",
    "extract_eq_case": "SELECT * FROM customer WHERE trim(c_mktsegment)='BUILDING'",
    "extract_ne_keeps_null": f"{_D} SELECT event_id, k FROM d WHERE k IS NULL OR lower(trim(k))<>'8'",
    "extract_contains": "SELECT * FROM part WHERE contains(lower(trim(p_name)),'ring')",
    "extract_starts": "SELECT * FROM part WHERE starts_with(lower(trim(p_name)),'red')",
    "extract_ends": "SELECT * FROM part WHERE ends_with(lower(trim(p_name)),'widget')",
    "extract_gt": "SELECT * FROM customer WHERE c_acctbal>5000.0",
    "extract_gt_text": f"{_D} SELECT event_id, k FROM d WHERE TRY_CAST(trim(k) AS DOUBLE)>50",
    "extract_lt": "SELECT * FROM customer WHERE c_acctbal<0",
    "extract_empty": f"{_D} SELECT event_id, k FROM d WHERE k IS NULL OR trim(k)=''",
    "extract_not_empty": f"{_D} SELECT event_id, k FROM d WHERE NOT (k IS NULL OR trim(k)='')",
    "split_by_columns": ("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag||'_'||l_linestatus AS _group "
                         "FROM lineitem"),
    "split_by_columns_manifest": ("SELECT l_returnflag||'_'||l_linestatus AS _group, count(*) AS n_rows "
                                  "FROM lineitem GROUP BY ALL"),
    "split_by_lines": ("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey)-1)//200+1 AS BIGINT) AS _part "
                       "FROM orders"),
    "split_by_lines_file_order": (
        "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey)-1)//200+1 AS BIGINT) AS _part FROM orders"),
    "split_by_lines_manifest": ("SELECT _part, count(*) AS n_rows FROM (SELECT CAST((row_number() OVER "
                                "(ORDER BY o_orderkey)-1)//200+1 AS BIGINT) AS _part FROM orders) GROUP BY ALL"),
    "split_by_source_manifest": ("SELECT 'all_nation' AS _target, count(*) AS n_rows FROM nation UNION ALL "
                                 "SELECT 'all_region', count(*) FROM region"),
    "select_sheet": ("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, "
                     "CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"),
    "scan_sheets": ("SELECT 'all.xlsx' AS source, 'nation' AS sheet, count(*) AS row_count, "
                    "'n_nationkey,n_name,n_regionkey' AS columns FROM nation UNION ALL "
                    "SELECT 'all.xlsx', 'region', count(*), 'r_regionkey,r_name' FROM region"),
    "split_per_sheet_manifest": (
        "SELECT 'customer' AS _sheet_dir, CAST(c_nationkey AS VARCHAR) AS _group, count(*) AS n_rows FROM customer "
        "GROUP BY ALL UNION ALL SELECT 'supplier', CAST(s_nationkey AS VARCHAR), count(*) FROM supplier GROUP BY ALL"),
    "csv_roundtrip": ("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment "
                      "FROM customer"),
    "combine_files": "SELECT * FROM customer UNION ALL BY NAME SELECT * FROM supplier",
    "scan_metadata": ("SELECT 'nation' AS source, count(*) AS row_count, 'n_nationkey,n_name,n_regionkey' AS columns "
                      "FROM nation UNION ALL SELECT 'region', count(*), 'r_regionkey,r_name' FROM region"),
    "run_stats": (
        "SELECT (SELECT count(*) FROM customer) AS a_rows, "
        "(SELECT count(*) FROM orders) AS b_rows, "
        f"(SELECT count(*) FROM customer WHERE {_k('c_custkey')} IN {_IN_P}) AS result_rows, "
        f"(SELECT count(*) FROM {_OP} WHERE {_k('o_custkey')} NOT IN "
        f"(SELECT {_k('c_custkey')} FROM customer)) AS not_found_rows"),
    "preview": "SELECT * FROM customer ORDER BY c_custkey LIMIT 100",
    "export_projection": f"SELECT c_name, c_mktsegment FROM customer WHERE {_k('c_custkey')} IN {_IN_P}",
    "filter_script_counts": (
        "SELECT (SELECT count(*) FROM customer) AS global_rows, "
        "(SELECT count(*) FROM orders) AS paid_rows, "
        "(SELECT count(*) FROM customer WHERE coalesce(trim(CAST(c_custkey AS VARCHAR)),'nan') NOT IN "
        f"(SELECT coalesce(trim(CAST(o_custkey AS VARCHAR)),'nan') FROM {_OP})) "
        "AS filtered_rows"),
    "csv_quoted_lines": "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents",
    "scan_paths": ("SELECT 'nation' AS name, 'n_nationkey,n_name,n_regionkey' AS columns, count(*) AS row_count FROM nation UNION ALL "
                   "SELECT 'region', 'r_regionkey,r_name', count(*) FROM region UNION ALL "
                   "SELECT 'documents', 'doc_id,text,lang,source,n_chars', count(*) FROM documents"),
    "workbook_combine": "SELECT * REPLACE (CAST(c_nationkey AS BIGINT) AS c_nationkey) FROM customer",
    "workbook_sheet": ("SELECT * REPLACE (CAST(c_nationkey AS BIGINT) AS c_nationkey) FROM customer "
                       "WHERE c_custkey % 4 = 1 AND c_mktsegment = 'BUILDING'"),
    "workbook_scan": ("SELECT 'part' || (c_custkey % 4) || '.xlsx' AS source, c_mktsegment AS sheet, count(*) AS row_count, "
                      "'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns FROM customer GROUP BY ALL"),
    "workbook_split_sheets": "SELECT 'part' || (c_custkey % 4) || '_' || c_mktsegment AS _target, count(*) AS n_rows FROM customer GROUP BY ALL",
    "workbook_split_columns": ("SELECT c_mktsegment AS _sheet_dir, CAST(c_nationkey AS VARCHAR) AS _group, count(*) AS n_rows "
                               "FROM customer GROUP BY ALL"),
    "export_both_sides": (
        f"SELECT 'result' AS output, c_custkey AS key, c_name AS what FROM customer WHERE {_k('c_custkey')} IN {_IN_P} UNION ALL "
        f"SELECT 'not_found', o_orderkey, o_orderstatus FROM {_OP} WHERE {_k('o_custkey')} NOT IN (SELECT {_k('c_custkey')} FROM customer)"),
    "export_run": ("SELECT c_custkey, c_name, o_totalprice FROM customer JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F' "
                   "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) ON c_custkey = o_custkey"),
    "job_enrich": ("SELECT (SELECT count(*) FROM customer) AS a_rows, (SELECT count(*) FROM orders) AS b_rows, (SELECT count(*) FROM customer) "
                   "AS result_rows, m AS found_rows, (SELECT count(*) FROM customer) AS written_rows, m AS matched_rows FROM "
                   "(SELECT count(*) AS m FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))"),
    "filter_script_rows": (f"{_D} SELECT * FROM d WHERE coalesce(trim(k), 'nan') NOT IN (SELECT CAST(CASE WHEN c_custkey % 3 <> 0 "
                           "THEN c_custkey ELSE -1 - c_custkey END AS VARCHAR) FROM customer UNION ALL SELECT 'nan')"),
    "preview_file_order": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100",
}
