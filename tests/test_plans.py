"""Plan shape: what the optimizer must produce for the operators to hold at scale."""

import pytest

import __spark_entry__ as entry
from tabrecon.plans.registry import QUERIES
from tests.conftest import SF_SMALL

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df):
    """The plan that adaptive execution ended with."""
    df._jdf.queryExecution().toRdd().count()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def big_b(spark):
    """Sessions settings that force shuffle joins, as for a large B."""
    old = {k: spark.conf.get(k, None) for k in NO_BROADCAST}
    for k, v in NO_BROADCAST.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_pairwise_join(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct"):
        assert bad not in plan, f"{name}: {bad}"
    # A nested-loop join is allowed only as an existence test on a folded constant key,
    # whose build side is a single row (LocalLimit 1).
    for part in plan.split("BroadcastNestedLoopJoin")[1:]:
        assert "LeftSemi" in part.split("\n")[0] and "LocalLimit 1" in part, f"{name}: nested-loop join"


def test_first_per_key_limits_before_shuffle(spark):
    plan = _plan(entry.queries()["enrich_first_match"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name", ["enrich_left", "intersect_select_b", "subtract", "enrich_keep_empty"])
def test_b_is_shuffled_once(spark, big_b, name):
    """B is reduced in one exchange and meets A in another (see ``keys``), in one join."""
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert plan.count("SortMergeJoin") == 1
    assert plan.count("Exchange hashpartitioning") <= 3


def test_semi_filter_reaches_scan(spark):
    from tabrecon import subtract

    a, b = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("customer", "orders"))
    plan = _plan(subtract(a, b.where("o_orderstatus = 'P'"), ("c_custkey", "o_custkey")))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,P)" in plan


@pytest.fixture()
def skewed(spark, big_b):
    """Settings under which a small test table has skewed partitions."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("key", ["long", "string"])
def test_hot_and_blank_keys_are_split(spark, skewed, key):
    """A third of A's rows hold one key and a third none: adaptive execution splits both, and
    the answer is unchanged."""
    from pyspark.sql import functions as F

    from tabrecon import enrich, subtract

    ids = spark.range(300000, numPartitions=6)
    value = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id"))
    a = ids.select(value.cast(key).alias("k"), F.col("id").alias("pk"))
    b = spark.range(300000).select(F.col("id").cast(key).alias("k"), (F.col("id") * 2).alias("v"))
    b = b.union(spark.createDataFrame([(None, -1)], f"k {key}, v long"))
    res = enrich(a, b, "k", select_b=["v"], order_b=["v"], skip_empty=False).data
    plan = _final_plan(res)
    assert "SortMergeJoin(skew=true)" in plan
    assert res.where("k = 7 AND v = 14").count() == 100001  # every third id, and id 7
    assert res.where("k IS NULL AND v = -1").count() == 100000
    minus = subtract(a, b.where("k <> 7 or k is null"), "k")
    assert "SortMergeJoin(skew=true)" in _final_plan(minus)
    assert minus.count() == 100001


def test_a_scan_reads_only_what_is_asked_for(spark, big_b):
    from tabrecon import intersect, subtract

    a, b = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("customer", "orders"))
    plan = _plan(intersect(a, b, ("c_custkey", "o_custkey"), select_a=["c_name"]).data)
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan and "LeftSemi" in plan
    plan = _plan(subtract(a, b, ("c_custkey", "o_custkey")).where("c_acctbal > 5000"))
    assert "GreaterThan(c_acctbal,5000" in plan.split("PushedFilters")[1] and "LeftAnti" in plan


def test_text_keys_scan_b_once_and_start_no_job(spark, big_b):
    from tabrecon import enrich, subtract

    a, b = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("customer", "supplier"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    made = [subtract(a, b, ("c_name", "s_name")), enrich(a, b, ("c_name", "s_name"), select_b=["s_acctbal"], order_b=["s_suppkey"]).data]
    assert not tracker.getJobIdsForGroup("plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for df in made:
        plan = _plan(df)
        final = plan.split("== Initial Plan ==")[0]
        assert final.count("s_name") and final.count("supplier.parquet") == 1


def test_a_may_hold_a_map_column(spark, big_b):
    from pyspark.sql import functions as F

    from tabrecon import subtract

    a = spark.range(10).select("id", F.create_map(F.lit("x"), F.col("id")).alias("m"))
    assert subtract(a, spark.range(5), "id").count() == 5


def test_a_column_may_have_a_helper_name(spark):
    from tabrecon import enrich

    a = spark.range(3).withColumnRenamed("id", "_rn_first")
    assert enrich(a, a, "_rn_first", select_b=["_rn_first"], order_b=["_rn_first"]).data.count() == 3
