"""p-stable hashing against all pairs, and components against a plain union of links."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabrecon.llm import embedding_dedup as ed
from tabrecon.llm.components import connected

DDL = "vec_id long, embedding array<float>, label int"


def brute_force(vectors, cosine=0.95):
    """(links, least id of the component) of each vector by comparing all pairs."""
    n = len(vectors)
    sound = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    links, parent = [0] * n, list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if sound[i] and sound[j] and len(vectors[i]) == len(vectors[j]):
                x, y = (np.array(vectors[k], dtype=np.float32).astype(float) for k in (i, j))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    return links, [find(i) for i in range(n)]


def test_links_and_components(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 24))
    vectors = [(c + 0.07 * rng.standard_normal(24)).tolist() for c in centres for _ in range(6)]
    vectors += [[2 * x for x in vectors[0]], vectors[1], vectors[1], None, [0.0] * 24, [float("nan")] * 24, [1.0, None] * 12, [float("inf")] + [0.0] * 23, [],
                [1.0, 2.0], [1.0, 2.0], [1.0, 2.1], [1e-30] * 24, [1e30] * 24]
    want_links, want_least = brute_force(vectors)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], DDL).selectExpr("*", "1 AS uid", "'x' AS key", "2 AS vec").repartition(3)
    got = sorted(ed.near_duplicates(df, recall=0.99999).collect())
    assert [r["vec_id"] for r in got] == list(range(len(vectors)))
    assert [r["n_links"] for r in got] == want_links
    assert [r["component_id"] for r in got] == want_least
    assert [r["kept"] for r in got] == [i == c for i, c in enumerate(want_least)]
    assert sum(want_links) > 300


def test_recall_and_no_false_link(spark):
    """Pairs just at the threshold are found as often as the plan says, none below it."""
    rng = np.random.default_rng(5)
    rows, pairs = [], 400
    for _ in range(pairs):
        x, y = rng.standard_normal((2, 64))
        x /= np.linalg.norm(x)
        y -= x * (x @ y)
        y /= np.linalg.norm(y)
        c = 0.9502
        rows += [x, c * x + math.sqrt(1 - c * c) * y, 0.949 * x - math.sqrt(1 - 0.949**2) * y]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = [r["n_links"] for r in sorted(ed.near_duplicates(df).collect())]
    assert max(got) <= 1 and sum(got[2::3]) == 0
    assert sum(got) / 2 >= 0.86 * pairs


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 40)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(16)
    vectors = [(base + 0.02 * rng.standard_normal(16)).tolist() for _ in range(300)]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], DDL)
    got = sorted(ed.near_duplicates(df).collect())
    assert {r["n_links"] for r in got} == {299} and {r["component_id"] for r in got} == {0}


def test_repeated_and_null_ids(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(5, v, 0), (5, v, 0), (None, v, 1), (None, w, 1), (2, None, 0)], DDL)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in ed.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 0, None, True), (2, 0, 2, True)], key=str)
    assert ed.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("distance,width", [(0.3, 1.9), (1.4, 1.9), (1.0, 0.5)])
def test_collision_probability(distance, width):
    rng = np.random.default_rng(0)
    moved, shift = distance * rng.standard_normal(200_000), rng.random(200_000)
    assert abs(ed.collision(distance, width) - np.mean(np.floor(moved / width + shift) == 0)) < 0.005


@pytest.mark.parametrize("most", [8, 500_000])
def test_components_of_a_long_chain(spark, monkeypatch, most):
    """A chain of 1000 in random order over many tasks, hubs, repeated links and loops, with many rounds and none."""
    from tabrecon.llm import components

    rounds = []
    monkeypatch.setattr(components, "MOST_NAMES", most)
    monkeypatch.setattr(components, "release", lambda s: rounds.append(1))
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(1000)] + [(5000, 5000 + i) for i in range(1, 800)] + [(9000, 9000), (-7, -3), (-3, -7), (2**62, -2**62)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(40).withColumn("a", F.col("a"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["uid"]: r["comp"] for r in connected(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    groups = {}
    for u, c in got.items():
        groups.setdefault(c, set()).add(u)
    assert sorted(map(len, groups.values())) == [2, 2, 800, 1001] and all(c in g for c, g in groups.items())
    assert len(rounds) <= (15 if most == 8 else 0)
    assert connected(df.limit(0)).count() == 0
