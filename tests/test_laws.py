"""Laws on generated tables, checked against a brute-force Python model of the rules."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabrecon import combine, enrich, intersect, subtract
from tests.conftest import rows

KEYS = ["1", " 1", "1　", "2", "", " ", None, "a", "A", "\t2 "]
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture(params=["sampled", "every_key_hot"])
def hot_mode(request, spark):
    """Run each law twice: default hot-key detection, and with every sampled key hot."""
    if request.param == "every_key_hot":
        spark.conf.set("tabrecon.hotKeys.fraction", "1.0")
        spark.conf.set("tabrecon.hotKeys.minSampled", "1")
        spark.conf.set("tabrecon.hotKeys.minBytes", "0")
    yield request.param
    for key in ("fraction", "minSampled", "minBytes"):
        spark.conf.unset(f"tabrecon.hotKeys.{key}")


def norm(k):
    return "" if k is None else k.strip()


tables = st.lists(st.sampled_from(KEYS), min_size=0, max_size=12)


def frame(spark, keys, label):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"k string, {label} long")


@SETTINGS
@given(a=tables, b=tables)
def test_membership_matches_model(spark, hot_mode, a, b):
    fa, fb = frame(spark, a, "pk"), frame(spark, b, "pb")
    kb = {norm(k) for k in b}
    want_minus = sorted(i for i, k in enumerate(a) if norm(k) not in kb)
    want_inter = sorted(i for i, k in enumerate(a) if norm(k) in kb)
    assert sorted(r.pk for r in subtract(fa, fb, "k").collect()) == want_minus
    assert sorted(r.pk for r in intersect(fa, fb, "k").data.collect()) == want_inter


@SETTINGS
@given(a=tables, b=tables, skip=st.booleans())
def test_enrich_matches_model(spark, hot_mode, a, b, skip):
    fa, fb = frame(spark, a, "pk"), frame(spark, b, "pb")
    first = {}
    for i, k in enumerate(b):
        if skip and norm(k) == "":
            continue
        first.setdefault(norm(k), i)
    want = sorted((i, first.get(norm(k))) for i, k in enumerate(a) if not (skip and norm(k) == ""))
    res = enrich(fa, fb, "k", select_b=["pb"], order_b=["pb"], skip_empty=skip)
    assert rows(res.data, "pk", "pb") == sorted(want, key=lambda t: (t[0], t[1] is None, t[1] or 0))
    found = rows(res.found, "pk", "pb")
    assert found == [t for t in want if t[1] is not None]


@SETTINGS
@given(a=tables, parts=st.integers(min_value=1, max_value=6))
def test_results_do_not_depend_on_partitioning(spark, a, parts):
    fa = frame(spark, a, "pk")
    one, many = fa.coalesce(1), fa.repartition(parts)
    b = frame(spark, list(reversed(a)), "pb")
    assert rows(subtract(one, b.where("pb < 3"), "k")) == rows(subtract(many, b.where("pb < 3"), "k"))
    d1 = combine([one, one], dedup=True, dedup_key="k", orders=[["pk"], ["pk"]])
    d2 = combine([many, many], dedup=True, dedup_key="k", orders=[["pk"], ["pk"]])
    assert rows(d1) == rows(d2)
