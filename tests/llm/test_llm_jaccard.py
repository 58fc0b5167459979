"""The shingle join against brute force: components, large groups, hubs, repeated rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tabrecon.llm import jaccard_join as J
from tests.conftest import SF_SMALL
from tests.llm.helpers import CLASHING, components, docs_frame, odd_texts, shingles


def check(df, texts):
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    expected = components(sets)
    rows = df.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == expected[r["doc_id"]], r
    return expected


def near_copies(rng, n, size, edits):
    base = [f"w{rng.randint(0, 500)}" for _ in range(size)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(size)] = f"e{rng.randint(0, 10 ** 6)}"
        out.append(" ".join(t))
    return out


def test_documents(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()]
    check(J.join_components(docs_frame(spark, texts)), texts)


def test_odd_texts_with_clashing_columns(spark):
    texts = [*odd_texts(), "A b C d", "a B c D", "a b c", "x y z x y z", "X Y Z x y z"]
    check(J.join_components(docs_frame(spark, texts, extra=CLASHING)), texts)


def test_large_groups_go_through_hubs(spark):
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [*near_copies(rng, 60, 120, 5), *near_copies(rng, 40, 60, 3), *["same text " * 10] * 30]
    # Short own parts around a passage that all share: alike, but few reach the threshold.
    texts += [passage + " " + " ".join(f"o{rng.randint(0, 10 ** 6)}" for _ in range(rng.randint(5, 40))) for _ in range(50)]
    rng.shuffle(texts)
    expected = check(J.join_components(docs_frame(spark, texts).repartition(3)), texts)
    assert 20 < len(set(expected.values())) < 120


def test_without_hub_rounds_all_pairs_are_compared(spark):
    rng = random.Random(8)
    texts = near_copies(rng, 40, 80, 9)
    check(J.join_components(docs_frame(spark, texts), hub_rounds=0), texts)


def test_small_batches_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(J, "CHARS_PER_BUCKET", 500)
    rng = random.Random(9)
    texts = [*near_copies(rng, 25, 60, 4), *odd_texts(n=4)]
    check(J.join_components(docs_frame(spark, texts).repartition(4)), texts)


def test_repeated_and_missing_ids(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text), (5, text), (3, text + " eleven"), (None, text), (9, None), (None, "alone here")]
    got = J.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 3), (3, 3), (5, 3), (5, 3), (9, 9)]


def test_an_empty_table(spark):
    assert J.join_components(docs_frame(spark, [])).count() == 0


@pytest.mark.parametrize("percent", [50, 75, 90])
def test_linked_sets_share_a_prefix_under_every_order(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        both = rng.integers(0, 2 ** 40, rng.integers(1, 40)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2 ** 40, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(2))
        o = len(np.intersect1d(a, b))
        if 100 * o < percent * (len(a) + len(b) - o):
            continue
        df = {int(x): int(rng.integers(2, 9)) for x in np.union1d(a, b)}
        packed = []
        for x in (a, b):
            n = np.array([df[int(v)] for v in x], dtype="<u4")
            order = np.lexsort((x, n))
            packed += [x[order].astype("<u8").tobytes(), n[order].tobytes(), len(x)]
        assert J.overlap(*packed, percent) == o


def test_shingle_sets_of_a_batch():
    texts = ["a b c d e f", "", "A B", "a b c d e a b c d e", " \x0bx\n"]
    hashes, rows = J.shingle_sets(pa.array(texts), J.word_hashes())
    assert np.bincount(rows, minlength=5).tolist() == [len(shingles(t)) for t in texts]
    assert hashes[rows == 0][0] in hashes[rows == 3] or hashes[rows == 0][1] in hashes[rows == 3]
