"""Profiles saved by the reference run as job specs (R46, R47); workbook inputs in jobs."""

import json
import os

import pytest

from tabrecon import extract, read_table, run_job, stack, subtract
from tabrecon.plans.job import from_profile
from tests.conftest import SF_SMALL, rows
from tests.test_sources import _write, _xlsx


def _profile(**kw):
    """A profile with the 12 keys the reference saves, set as its UI leaves them by default."""
    p = {"file_a": "", "file_b": "", "col_a": "— charger Fichier A —", "col_b": "— charger Fichier B —",
         "operation": "Soustraire  (A − B)", "extract_col": "", "extract_condition": "égal à",
         "extract_value": "", "extract_case": False, "extend_dedup": True,
         "extend_key": "— aucune (toutes les colonnes) —", "output_path": ""}
    p.update(kw)
    return json.dumps(p, ensure_ascii=False)


def test_profile_subtract_to_csv(spark, scratch):
    cust, orders = f"{SF_SMALL}/customer.parquet", f"{SF_SMALL}/orders.parquet"
    spec = from_profile(_profile(file_a=cust, file_b=orders, col_a="c_custkey", col_b="o_custkey",
                                 output_path=f"{scratch}/unpaid.csv"))
    assert spec["operation"] == "subtract" and spec["key_a"] == "c_custkey"
    out = run_job(spark, spec).first()
    expected = subtract(spark.read.parquet(cust), spark.read.parquet(orders), ("c_custkey", "o_custkey")).count()
    assert out["result_rows"] == expected
    back = spark.read.option("header", True).csv(f"{scratch}/unpaid.csv/result")
    assert back.count() == expected


def test_profile_extract_french_condition(spark, scratch):
    part = f"{SF_SMALL}/part.parquet"
    spec = from_profile(_profile(file_a=part, operation="Extraire  (Filtrer A)", extract_col="p_name",
                                 extract_condition="contient", extract_value="RING", extract_case=False,
                                 output_path=f"{scratch}/ring"))
    assert spec["options"]["condition"] == "contient"
    out = run_job(spark, spec).first()
    df = spark.read.parquet(part)
    assert out["result_rows"] == extract(df, "p_name", "contains", "ring").count() > 0
    assert extract(df, "p_name", "se termine par", "widget").count() == extract(df, "p_name", "ends", "widget").count()


def test_profile_stack_all_columns_dedup(spark, scratch):
    nation = f"{SF_SMALL}/nation.parquet"
    spec = from_profile(_profile(file_a=nation, file_b=nation, operation="Fusionner  (A ∪ B)",
                                 output_path=f"{scratch}/stacked"))
    assert spec["options"] == {"dedup": True, "dedup_key": None}
    assert run_job(spark, spec).first()["result_rows"] == 25
    keep = from_profile(_profile(file_a=nation, file_b=nation, operation="Fusionner  (A ∪ B)", extend_dedup=False,
                                 output_path=f"{scratch}/stacked2"))
    assert run_job(spark, keep).first()["result_rows"] == 50
    df = spark.read.parquet(nation)
    assert stack(df, df, dedup=True).count() == 25


def test_profile_needs_overrides_for_unsaved_settings(spark, scratch):
    cust, orders = f"{SF_SMALL}/customer.parquet", f"{SF_SMALL}/orders.parquet"
    base = dict(file_a=cust, file_b=orders, operation="Enrichir  (A ← B)", output_path=f"{scratch}/rich")
    with pytest.raises(ValueError):  # the reference never saved enrich keys or columns
        from_profile(_profile(**base))
    spec = from_profile(_profile(**base), key_a="c_custkey", key_b="o_custkey",
                        options={"select_b": ["o_totalprice"], "order_b": ["o_orderkey"]})
    assert run_job(spark, spec).first()["result_rows"] == spark.read.parquet(cust).count()
    with pytest.raises(ValueError):
        from_profile(_profile(operation="Trier"))
    with pytest.raises(ValueError):
        from_profile(_profile(file_a=cust, operation="Extraire  (Filtrer A)", extract_col="c_name",
                              extract_condition="ressemble à", output_path=f"{scratch}/x"))
    with pytest.raises(ValueError):  # no output path chosen
        from_profile(_profile(file_a=cust, file_b=orders, col_a="c_custkey", col_b="o_custkey"))


def test_workbook_inputs_in_jobs(spark, scratch):
    os.makedirs(f"{scratch}/in")
    a = _write(f"{scratch}/in/a.xlsx", _xlsx({"people": [["id", "name"], [1, "x"], [2, "y"], [3, "z"]],
                                              "other": [["id", "note"], [9, "n"]]}))
    b = _write(f"{scratch}/in/b.xlsx", _xlsx({"paid": [["ref"], [" 2 "]]}))
    first = read_table(spark, a)
    assert first.columns == ["id", "name"] and rows(first) == [(1, "x"), (2, "y"), (3, "z")]
    assert rows(read_table(spark, a, "other")) == [(9, "n")]
    spec = from_profile(_profile(file_a=a, file_b=b, col_a="id", col_b="ref", output_path=f"{scratch}/out"))
    assert run_job(spark, spec).first()["result_rows"] == 2
    assert rows(spark.read.parquet(f"{scratch}/out/result")) == [(1, "x"), (3, "z")]
    # combine takes every sheet of every workbook, stacked by column name
    comb = {"operation": "combine", "inputs": [a, b], "output": {"path": f"{scratch}/comb"}}
    assert run_job(spark, comb).first()["result_rows"] == 5
    got = spark.read.parquet(f"{scratch}/comb/result")
    assert got.columns == ["id", "name", "note", "ref"]
    # a per-sheet column split of a workbook: one folder per sheet, then per group
    split = {"operation": "split_columns", "a": a, "output": {"path": f"{scratch}/split"},
             "options": {"split_columns": ["id"], "keep_columns": ["name", "note"], "per_sheet": True}}
    assert run_job(spark, split).first()["result_rows"] == 4
    folders = sorted(d for d in os.listdir(f"{scratch}/split") if d.startswith("_sheet_dir="))
    assert folders == ["_sheet_dir=other", "_sheet_dir=people"]
    assert sorted(os.listdir(f"{scratch}/split/_sheet_dir=people")) == ["_group=1", "_group=2", "_group=3"]


def test_profile_split_and_combine_with_overrides(spark, scratch):
    orders, nation, region = (f"{SF_SMALL}/{t}.parquet" for t in ("orders", "nation", "region"))
    lines = from_profile(_profile(file_a=orders, operation="Scinder  (Lignes)", output_path=f"{scratch}/parts"),
                         options={"lines_per_file": 400})
    assert lines["operation"] == "split_lines" and "b" not in lines
    assert run_job(spark, lines).first()["result_rows"] == 1500
    parts = sorted(d for d in os.listdir(f"{scratch}/parts") if d.startswith("_part="))
    assert parts == [f"_part={i}" for i in (1, 2, 3, 4)]
    cols = from_profile(_profile(file_a=orders, operation="Scinder  (Colonnes)", output_path=f"{scratch}/cols"),
                        options={"split_columns": ["o_orderstatus"], "keep_columns": ["o_orderkey"]})
    assert run_job(spark, cols).first()["result_rows"] == 1500
    comb = from_profile(_profile(operation="Combiner  (Multi-fichiers)", output_path=f"{scratch}/comb"),
                        inputs=[nation, region, nation])
    assert run_job(spark, comb).first()["result_rows"] == 30  # a path listed twice is read once
    with pytest.raises(ValueError):  # the split columns were never saved in a profile
        from_profile(_profile(file_a=orders, operation="Scinder  (Colonnes)", output_path=f"{scratch}/c2"))
