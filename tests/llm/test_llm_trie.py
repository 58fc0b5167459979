"""Conversation trie against a trie of nested dicts."""

import hashlib
import random
import zlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabrecon.llm import conversation_trie as ct

DDL = "conv_id long, turn long, role string, text string"


def brute_force(rows):
    own = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] if r[0] is not None else -1, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if conv is not None:
            own.setdefault(conv, []).append((role or "", text or ""))
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, ids in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(ids) - 1) * len(node[-1][1]) if node else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), children[node], leaves[node], saved[node],
                   digest(ends.get(node, []))) for node, ids in members.items())


def operator(spark, rows, ddl=DDL):
    df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, ddl)
    out = ct.prefix_trie(ct.rebuilt(ct.per_conversation(df)))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=lambda r: r[:2] + r[3:])


def test_shared_beginnings(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "", "long text é"])) for c in range(90, 330) for t in range(rng.randint(1, 9))]
    rows += [(400, t, "user", f"t{t}") for t in range(70)]                                # one long path
    rows += [(400 + k, t, "user", f"t{t}") for k in range(1, 60) for t in range(k)]        # and its beginnings
    rows += [(1000 + k, t, "user", "same") for k in range(300) for t in range(4)]          # a group of copies
    rng.shuffle(rows)
    assert operator(spark, rows) == sorted(brute_force(rows), key=lambda r: r[:2] + r[3:])


def test_odd_rows(spark):
    rows = [(7, None, None, "x"), (7, 0, "user", None), (7, 1, "", ""), (7, 1, "", ""), (None, 0, "user", "lost"), (8, 5, "user", "héé"),
            (205, 1, "user", "turnless or not"), (9, 0, "a", "bc"), (10, 0, "ab", "c"), (-5, 0, "u", "negative")]
    wide = spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS n", "'x' AS uid", "2 AS depth", "3 AS turns")
    assert operator(spark, wide) == sorted(brute_force(rows), key=lambda r: r[:2] + r[3:])


def test_no_conversations(spark):
    assert operator(spark, spark.createDataFrame([], DDL)) == []


def test_only_turnless(spark):
    conv = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(conv, 0, "user", "dropped")]
    assert operator(spark, rows) == brute_force(rows) and len(brute_force(rows)) == 1


def test_hot_handles_are_split(spark):
    """Searches keep conversations on a side that adaptive execution may split."""
    classes = ct.cut(spark.range(10).select(F.col("id").alias("uid"), F.lit(1).cast("long").alias("n"), *[F.array("id").alias(c) for c in ("p1", "p2", "chars")]))
    nodes = ct.build(classes)
    plan = ct._located(classes.withColumn("a", F.lit(0).cast("long")), nodes, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 4 and "Join Inner" not in plan


@given(st.integers(0, 2**40), st.integers(1, 2**40))
def test_two_fattest(a, more):
    b, k = a + more, 0
    while (b >> k + 1 << k + 1) > a:
        k += 1
    want = b >> k << k
    power = (a ^ b).bit_length() - 1
    assert want == b >> power << power and a < want <= b
    zeros = lambda x: (x & -x).bit_length()
    assert all(zeros(want) > zeros(x) for x in {a + 1, b, want - 1, want + 1} if a < x <= b and x != want)


def test_two_fattest_column(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)] + [(2**40, 2**40 + 5), (0, 2**50 + 1)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", ct.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r["f"] == r["b"] >> (r["a"] ^ r["b"]).bit_length() - 1 << (r["a"] ^ r["b"]).bit_length() - 1 for r in got)
