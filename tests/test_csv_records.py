"""CSV with line ends in quotes: read by several tasks, rows as pandas reads them (R36); scan by path."""

import io
import random

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabrecon import read_csv, split_by_lines
from tabrecon.sources.csv_records import line_maps, record_counts, record_table, states_after
from tabrecon.sources.scan import scan, scan_paths
from tests.test_sources import _xlsx

SPLITS = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}


@pytest.fixture()
def many_splits(spark):
    old = {k: spark.conf.get(k, None) for k in SPLITS}
    for k, v in SPLITS.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(path, data: str, encoding="utf-8"):
    with open(path, "wb") as f:
        f.write(data.encode(encoding))
    return path


def quoted_rows(seed, n=700, eol="\n"):
    rng = random.Random(seed)

    def cell():
        if rng.random() < 0.3:
            return '"' + rng.choice(["a\nb", "x,y", 'q""q', "\n\n", '""', "l1\r\nl2", "é\n" * rng.randint(1, 400), "", "NA", ',"",\n"",']) + '"'
        return rng.choice(["1", "22", "text", "é", 'a"b', 'x"', "NA", "", " s "])

    rows = ['id,"na\nme",c', *(f"{i},{cell()},{cell()}" for i in range(n))]
    rows[5:5] = ["", "   "]
    return eol.join(rows)


def same(got, want):
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in want.columns:
        for x, y in zip(got[c], want[c], strict=True):
            assert (pd.isna(x) and pd.isna(y)) or str(x) == str(y), (c, x, y)


@pytest.mark.parametrize("seed,eol,end,encoding", [(1, "\n", "\n", "utf-8"), (2, "\r\n", "", "utf-8"), (3, "\n", "", "latin-1"), (4, "\r\n", "\r\n", "utf-8-sig")])
def test_rows_as_pandas(spark, scratch, many_splits, seed, eol, end, encoding):
    path = written(f"{scratch}/x.csv", quoted_rows(seed, eol=eol) + end, encoding)
    want = pd.read_csv(path, encoding=encoding)
    same(read_csv(spark, path).toPandas().sort_values("id"), want)


def test_one_file_is_read_by_several_tasks(spark, scratch, many_splits):
    path = written(f"{scratch}/x.csv", quoted_rows(5, 3000))
    raw = spark.read.option("lineSep", "\n").text(path)
    assert raw.rdd.getNumPartitions() > 10
    table = record_table(spark, [path], "UTF-8")
    assert table.select(F.input_file_name()).distinct().count() > 1 and table.where("not is_header").count() == 3000
    df = read_csv(spark, path, infer=False)
    assert df.rdd.getNumPartitions() > 1
    parts = split_by_lines(df, 200).groupBy("_part").agg(F.count("*").alias("n"), F.min(F.col("id").cast("int")).alias("low")).orderBy("_part").collect()
    assert [tuple(p) for p in parts] == [(k + 1, 200, 200 * k) for k in range(15)]


def test_several_files_and_headers(spark, scratch, many_splits):
    written(f"{scratch}/a.csv", 'id,t\n1,"x\ny"\n2,z\n')
    written(f"{scratch}/b.csv", 't,id\n"p\n\nq",3\n')
    written(f"{scratch}/c.csv", "id,u\n4,plain\n")
    got = sorted((r["id"], r["t"], r["u"]) for r in read_csv(spark, scratch).collect())
    assert got == [(1, "x\ny", None), (2, "z", None), (3, "p\n\nq", None), (4, None, "plain")]


def test_refused_and_odd_files(spark, scratch):
    path = written(f"{scratch}/more.csv", 'a,b\n"x\ny",1\n1,2,3\n')
    with pytest.raises(Exception, match="more fields"):
        read_csv(spark, path, infer=False).collect()
    path = written(f"{scratch}/mac.csv", 'a,b\n"x\ny",1\r2,3\n')
    with pytest.raises(Exception, match="multi_line=True"):
        read_csv(spark, path).collect()
    path = written(f"{scratch}/open.csv", 'a,b\n1,"never\ncloses\n')
    assert read_csv(spark, path, infer=False).collect()[0]["a"] == "1"
    path = written(f"{scratch}/head.csv", '"a\nb",c\n')
    df = read_csv(spark, path)
    assert df.columns == ["a\nb", "c"] and df.count() == 0


line = st.text(alphabet='a,"', max_size=7)


def plain_state(text, open_):
    """The state machine of a CSV reader, character by character."""
    state = "quoted" if open_ else "start"
    for ch in text:
        if state == "start":
            state = "quoted" if ch == '"' else "start" if ch == "," else "plain"
        elif state == "quoted":
            state = "closing" if ch == '"' else state
        elif state == "closing":
            state = "quoted" if ch == '"' else "start" if ch == "," else "plain"
        else:
            state = "start" if ch == "," else state
    return state == "quoted"


@given(st.lists(line, min_size=1, max_size=30), st.booleans())
@settings(max_examples=300, deadline=None)
def test_states_of_lines(lines, start):
    opens, stays = line_maps(pa.array(lines))
    want, state = [], start
    for k, text in enumerate(lines):
        assert (opens[k], stays[k]) == (plain_state(text, False), plain_state(text, True))
        state = plain_state(text, state)
        want.append(state)
    assert states_after(opens, stays, start).tolist() == want


def test_counts_of_splits(spark, scratch, many_splits):
    path = written(f"{scratch}/x.csv", quoted_rows(6, 2500))
    (row,) = record_counts(spark, [path], "UTF-8").collect()
    assert row["rows"] == 2500 and row["header"] == 'id,"na\nme",c'


def test_scan_by_path(spark, scratch, monkeypatch):
    """Exact counts and headers of every kind of file without a type inferred or a table loaded."""
    import tabrecon.sources.csv as csv_source
    import tabrecon.sources.workbook as workbook

    written(f"{scratch}/q.csv", 'id,"a\nb"\n1,"x\ny"\n\n2,"z"')
    written(f"{scratch}/p.csv", "k,k,\n1,2,3\n4,5,6\n")
    with open(f"{scratch}/w.xlsx", "wb") as f:
        f.write(_xlsx({"full": [["a", "b"], [1, "x"], [None, None], [2, "y"]], "empty": [], "head": [["only"]], "wide": [["a"], [1, 2]]}))
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(f"{scratch}/t.parquet")
    for module in (csv_source, workbook):
        for name in ("infer_types", "read_csv", "read_workbooks", "typed", "kind_counts"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, None)
    got = {(r["source"].rsplit("/", 1)[-1], r["sheet"], r["row_count"], r["columns"])
           for r in scan([f"{scratch}/{n}" for n in ("q.csv", "p.csv", "w.xlsx", "t.parquet", "q.csv")], spark).collect()}
    assert got == {("q.csv", None, 2, "id,a\nb"), ("p.csv", None, 2, "k,k.1,Unnamed: 2"), ("t.parquet", None, 2, "k,v"), ("w.xlsx", "full", 3, "a,b"),
                   ("w.xlsx", "empty", 0, ""), ("w.xlsx", "head", 0, "only"), ("w.xlsx", "wide", 1, "a,Unnamed: 1")}
    with pytest.raises(ValueError):
        scan_paths(spark, "old.xls")
    with pytest.raises(ValueError):
        scan_paths(spark, [])


def test_pandas_is_the_model():
    """What the tests above call pandas' rules, said by pandas."""
    assert pd.read_csv(io.StringIO('a,b\n"x""y"z,q"r\n')).values.tolist() == [['x"yz', 'q"r']]
