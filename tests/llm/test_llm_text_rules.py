"""Quality rules, license scans and Order MinHash against brute force."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tabrecon.llm import license_scan, order_minhash, quality
from tests.conftest import SF_SMALL
from tests.llm.helpers import CLASHING, docs_frame, lower_az, odd_texts, words_of


def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")


# -- quality ------------------------------------------------------------------------------

def measured(text):
    text = text or ""
    w = words_of(text)
    windows = Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4))
    covered = {j + k for j in range(len(w) - 4) if windows[tuple(w[j:j + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_measures(spark):
    rng = random.Random(6)
    texts = [*odd_texts(n=40), *["\n".join(" ".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(6)) for _ in range(60)]]
    rows = quality.ledger(docs_frame(spark, texts, extra=CLASHING)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == measured(texts[r["doc_id"]]), repr(texts[r["doc_id"]])[:200]


def test_policies_and_ablation(spark):
    rows = quality.ledger(documents(spark), keep=["doc_id"])
    data = [r["fail_bits"] for r in rows.collect()]
    for policy, rules in quality.POLICIES.items():
        mask = quality.bits_of(rules)
        assert rows.where(quality.fails(policy)).count() == sum(1 for b in data if b & mask)
        for r in quality.ablation(rows, policy).collect():
            bit = quality.bits_of((r["rule"],))
            assert r["n_fail"] == sum(1 for b in data if b & bit)
            assert r["n_only"] == sum(1 for b in data if b & mask == bit)


def test_quality_runs_no_python(spark):
    plan = quality.ledger(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_quality_of_an_empty_table(spark):
    assert quality.ledger(docs_frame(spark, [])).count() == 0
    assert quality.ablation(quality.ledger(docs_frame(spark, []))).count() == 0


# -- licenses -----------------------------------------------------------------------------

def base_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text))
    found = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(w))
             if w[i:i + len(phrase.split())] == phrase.split()]
    return len(w), found


def test_license_phrases(spark):
    texts = [*odd_texts(), "CC-BY CC by, cc  by", "all rights reserved. General\nPublic License", "cc cc by by", "xcc by", "cc byé",
             "General Public License general public license"]
    for r in license_scan.scan_licenses(docs_frame(spark, texts, extra=CLASHING)).collect():
        n, found = base_of(texts[r["doc_id"]])
        at = [i for i, _ in found]
        assert (r["n_words"], r["n_base"]) == (n, len(found))
        assert (r["first_word"], r["last_word"]) == (min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def free_places(text, anchors):
    """Places in a notice's words that are not anchors, nor next to one."""
    out, at = [], 0
    held = set(anchors.split())
    for w in text.split():
        if w not in held:
            out += range(at + 1, at + len(w) - 1)
        at += len(w) + 1
    return out


def edited(text, edits, rng, anchors):
    t = list(text)
    for i in sorted(rng.sample(free_places(text, anchors), edits), reverse=True):
        kind = rng.randrange(3)
        if kind == 0:
            t[i] = rng.choice("qxz")
        elif kind == 1:
            del t[i]
        else:
            t.insert(i, rng.choice("qxz"))
    return "".join(t)


def least_edits(pattern, text):
    """Least edit distance between ``pattern`` and any part of ``text``, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


@pytest.mark.parametrize("notice", license_scan.NOTICES, ids=lambda n: n[0])
def test_fuzzy_notices_are_found_up_to_the_bound(notice):
    rng = random.Random(len(notice[0]))
    text, label, bound, anchors = notice
    one = license_scan.Notice(*notice)
    for edits in range(bound + 3):
        for _ in range(10):
            body = edited(text, min(edits, len(free_places(text, anchors))), rng, anchors)
            least = least_edits(text, f" zz yy {body} ww ")
            found = one.matches(f" zz yy {body} ww ".encode())
            assert [m.edits for m in found] == ([least] if least <= bound else []), body
    assert not one.matches(b" nothing of the kind stands here at all ")


@pytest.mark.parametrize("text", ["released under the BSD license", "licensed under the Apache License, Version 1.1", "Mozilla Public License, version 1.1",
                                  "GNU General Public License version 1", "licensed under CC BY-ND 4.0", "released under the MTI license"])
def test_other_licences_are_not_taken_for_these(text):
    _, _, found = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES).scan(text)
    assert found == []


def test_license_time_grows_with_the_text():
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES)
    text = "relaesed under the mit license gnu genral publc license version 3 " * 16_000   # a megabyte
    start = time.perf_counter()
    _, _, found = scanner.scan(text)
    assert len(found) == 32_000 and {(m.label, m.edits) for m in found} == {("mit", 2), ("gpl-3.0", 2)}
    assert time.perf_counter() - start < 30


def test_license_spans_and_closest_notice():
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES)
    _, _, found = scanner.scan("Some words. Relaesed under the MIT Licence! More words")
    assert [(m.label, m.first_word, m.last_word) for m in found] == [("mit", 2, 6)]
    _, _, found = scanner.scan("the GNU General Public License, version 3.")
    assert {m.label for m in found} == {"gpl-3.0"}


def test_license_notices_next_to_one_another():
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES)
    _, _, found = scanner.scan("released under the mit licence released under the mit license")
    assert sorted((m.label, m.first_word, m.last_word, m.edits) for m in found) == [("mit", 0, 4, 1), ("mit", 5, 9, 0)]
    _, _, found = scanner.scan("gnu genral publc license version 3 gnu general public license version 2")
    assert sorted((m.label, m.first_word, m.last_word, m.edits) for m in found) == [("gpl-2.0", 6, 11, 0), ("gpl-3.0", 0, 5, 2)]
    rng = random.Random(4)
    for text, label, bound, anchors in license_scan.NOTICES:
        one, copies = license_scan.Notice(text, label, bound, anchors), [rng.choice([0, 1, 1]) for _ in range(6)]
        # A letter within the notice differs, so that a copy's place is certain.
        at = free_places(text, anchors)[0]
        line = " ".join(text if not k else text[:at] + "q" + text[at + 1:] for k in copies)
        assert [m.edits for m in one.matches(f" {line} ".encode())] == copies, text


def test_license_of_an_empty_table(spark):
    assert license_scan.scan_licenses(docs_frame(spark, [])).count() == 0


# -- Order MinHash ------------------------------------------------------------------------

def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def check_edited(df, texts):
    rows = by_id(df)
    assert len(rows) == len(texts)
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        quarter, after = len(t) // 4, plain[(i + 1) % len(plain)]
        changed = t[:len(t) - quarter] + after[:quarter]
        assert rows[i]["n_chars"] == len(t)
        assert rows[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    return rows


def test_order_minhash_edited_texts(spark):
    texts = odd_texts(n=20)
    rows = check_edited(order_minhash.edited_likeness(docs_frame(spark, texts, extra=CLASHING)), texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if (a or "") == (b or ""):
                assert rows[i]["fingerprint"] == rows[j]["fingerprint"]
    assert rows[0]["fingerprint"] == "" and rows[0]["near_next"] == 1.0


def test_next_document_over_many_buckets(spark):
    n = 300
    ids = random.Random(1).sample(range(10_000), n)
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = order_minhash.next_in_order(rows, "doc_id", ["text"], ["text"], rows_per_bucket=10)
    order = sorted(ids)
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    assert {r["doc_id"]: r["_next"]["text"] for r in got.collect()} == {i: f"t{after[i]}" for i in ids}


def test_next_document_with_ties_nulls_and_one_row(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n"), (2, "c")], "doc_id long, text string")
    got = order_minhash.next_in_order(rows, "doc_id", ["text"], ["text"], rows_per_bucket=1)
    assert sorted((r["text"], r["_next"]["text"]) for r in got.collect()) == [("a", "b"), ("b", "c"), ("c", "n"), ("n", "a")]
    assert [r["_next"]["text"] for r in order_minhash.next_in_order(rows.limit(1), "doc_id", ["text"], ["text"]).collect()]
    assert order_minhash.edited_likeness(docs_frame(spark, [])).count() == 0


def test_order_minhash_follows_edit_distance(spark):
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 300)}" for _ in range(400)]
    light, heavy = list(words), list(words)
    for i in rng.sample(range(400), 8):
        light[i] = "edit"
    for i in rng.sample(range(400), 120):
        heavy[i] = "edit"
    moved = words[200:] + words[:200]
    shuffled = rng.sample(words, 400)
    texts = [" ".join(t) for t in (words, light, heavy, moved, shuffled)]
    df = docs_frame(spark, texts).select("doc_id", order_minhash.signature(F.col("text")).alias("sig"))
    one = df.where("doc_id = 0").select(F.col("sig").alias("first"))
    near = {r["doc_id"]: r["near"] for r in df.join(F.broadcast(one)).select(
        "doc_id", order_minhash.likeness(F.col("first"), F.col("sig")).alias("near")).collect()}
    assert near[0] == 1.0 and near[1] > 0.6 and near[1] > near[2] and near[1] > near[4]
    assert near[3] < 1.0  # the same k-mers but one, in another order


def spark_hash(*values):
    """Spark's xxhash64 of texts, longs and ints (given as a tuple)."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def signature_of(text, k=2, bin_bits=5, size=2):
    """The signature step by step, with Python integers."""
    signed = lambda x: (x & (1 << 64) - 1) - (1 << 64 if x & 1 << 63 else 0)
    low = (1 << 24) - 1
    h = [spark_hash(w) for w in words_of(text)]
    if not h:
        return []
    if len(h) < k:
        acc = 0
        for x in h:
            acc = spark_hash(acc, x)
        grams = [(acc & ~low, 0)]
    else:
        grams = [(spark_hash(*h[i:i + k]) & ~low, i) for i in range(len(h) - k + 1)]
    seen, numbered = Counter(), []
    for value, at in sorted(grams):
        numbered.append((spark_hash(value >> 24, (seen[value],)) & ~low | at, at))
        seen[value] += 1
    numbered.sort()
    out, bins = [], set()
    for j, (value, _) in enumerate(numbered):
        bin_ = (value & (1 << 64) - 1) >> 64 - bin_bits
        if bin_ in bins:
            continue
        bins.add(bin_)
        chosen = [numbered[(j + i) % len(numbered)] for i in range(min(size, len(numbered)))]
        acc = 0
        for v, at in sorted(chosen, key=lambda x: (x[1], (x[0] & (1 << 64) - 1) >> 25)):
            acc = spark_hash(acc, at << 39 & (1 << 39) - 1 | (v & (1 << 64) - 1) >> 25)
        out.append(signed((value & (1 << 64) - 1) >> 64 - bin_bits << 64 - bin_bits | (acc & (1 << 64) - 1) >> bin_bits))
    return out


def test_order_minhash_signature_and_likeness_step_by_step(spark):
    rng = random.Random(12)
    texts = [*odd_texts(n=6), *(" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(n)) for n in (1, 2, 3, 10, 40, 500))]
    df = docs_frame(spark, texts).select("doc_id", order_minhash.signature(F.coalesce("text", F.lit(""))).alias("sig"))
    got = {r["doc_id"]: list(r["sig"]) for r in df.collect()}
    assert got == {i: signature_of(t) for i, t in enumerate(texts)}
    a, b = df.select(F.col("doc_id").alias("i"), F.col("sig").alias("a")), df.select(F.col("doc_id").alias("j"), F.col("sig").alias("b"))
    for r in a.crossJoin(b).select("i", "j", order_minhash.likeness(F.col("a"), F.col("b")).alias("near")).collect():
        x, y = ({v & (1 << 64) - 1 for v in got[r[c]]} for c in "ij")
        filled = {v >> 59 for v in x | y}
        assert r["near"] == (len(x & y) / len(filled) if filled else 1.0)


def test_order_counts_in_short_texts(spark):
    """Halves swapped: the k-mers stay but one, their order does not."""
    rng = random.Random(3)
    texts = []
    for n in (30, 30, 30, 60, 400):
        w = [f"w{rng.randint(0, 5000)}" for _ in range(n)]
        texts += [" ".join(w), " ".join(w[n // 2:] + w[:n // 2])]
    sig = {r["doc_id"]: set(r["sig"]) for r in docs_frame(spark, texts).select("doc_id", order_minhash.signature(F.col("text")).alias("sig")).collect()}
    near = [len(sig[i] & sig[i + 1]) / len({(v & (1 << 64) - 1) >> 59 for v in sig[i] | sig[i + 1]}) for i in range(0, len(texts), 2)]
    assert max(near) < 0.75 and sum(near) / len(near) < 0.62, near


def test_repeated_rows_of_one_id(spark):
    rows = spark.createDataFrame([(1, "a b c d e f")] * 5 + [(None, "x y z")] * 3, "doc_id long, text string")
    got = order_minhash.edited_likeness(rows).collect()
    assert len(got) == 8 and len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1


def test_order_minhash_of_documents(spark):
    docs = documents(spark)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    rows = check_edited(order_minhash.edited_likeness(docs), texts).values()
    assert sum(r["near_edited"] for r in rows) > 20 * sum(r["near_next"] for r in rows)
    plan = order_minhash.edited_likeness(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
