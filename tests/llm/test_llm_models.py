"""Language identification, toxicity and language-model scores: held-out accuracy, brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tabrecon.llm import hpylm, langid, toxicity
from tabrecon.llm.common import crc_mod
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.llm.helpers import CLASHING, docs_frame, lower_az, odd_texts, words_of


# -- language identification --------------------------------------------------------------

@pytest.fixture(scope="module")
def lang_model(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    return docs, langid.fit(docs.where(crc_mod("doc_id", 4) != 2), docs_per_lang=300)


def test_held_out_accuracy(lang_model):
    docs, model = lang_model
    rows = langid.predict(docs.where(crc_mod("doc_id", 4) == 2), model, keep=["doc_id", "lang"]).collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert len(rows) > 150 and right >= 0.97 * len(rows)
    assert sum(r["rejected"] for r in rows) <= 0.02 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_unknown_language_is_rejected(spark, lang_model):
    rng = random.Random(1)
    strange = " ".join("".join(rng.choices("qxzjvwkyñß", k=rng.randint(3, 9))) for _ in range(150))
    greek = "ουδεις αγεωμετρητος εισιτω μοι τη θυρα " * 6
    rows = langid.predict(docs_frame(spark, [strange, greek]), lang_model[1]).collect()
    assert all(r["rejected"] for r in rows)


def test_odd_texts(spark, lang_model):
    texts = odd_texts()
    rows = langid.predict(docs_frame(spark, texts, extra=CLASHING), lang_model[1]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        if not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"], r["cross_entropy"], r["rejected"]) == ("und", 0.0, None, True)
        else:
            assert r["lang_pred"] in lang_model[1].langs
    assert len({(r["lang_pred"], r["score"]) for r in rows if texts[r["doc_id"]] == "word"}) == 1


def test_without_labelled_rows(spark):
    docs = docs_frame(spark, ["some text", None], langs=[None, None])
    model = langid.fit(docs)
    assert model is None
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} == {"und"}
    assert langid.predict(docs_frame(spark, []), langid.fit(docs_frame(spark, []))).count() == 0


def brute_kneser_ney(words, counts, order):
    """Interpolated Kneser-Ney by dictionaries, for one language; probability of a word's characters."""
    padded = {f" {w} ": c for w, c in zip(words, counts, strict=True)}
    raw = [Counter() for _ in range(order + 2)]
    for w, c in padded.items():
        for i in range(1, len(w)):
            for m in range(1, min(order, i + 1) + 1):
                raw[m][w[i - m + 1:i + 1]] += c
    used = [None] * (order + 2)
    for m in range(1, order + 1):
        used[m] = {}
        for g in raw[m]:
            starts = m > 1 and g[0] == " "
            used[m][g] = raw[m][g] if m == order or starts else max(1, sum(1 for h in raw[m + 1] if h[1:] == g))
    discounts = [None]
    for m in range(1, order + 1):
        ones, twos = (sum(1 for c in used[m].values() if c == k) for k in (1, 2))
        discounts.append(min(0.95, max(0.05, ones / max(1, ones + 2 * twos))))
    alphabet = 1 + len(set("".join(words)))

    def prob(context, ch):
        m = len(context) + 1
        lower = prob(context[1:], ch) if m > 1 else 1 / alphabet
        same = {g: c for g, c in used[m].items() if g[:-1] == context}
        total = sum(same.values())
        if not total:
            return lower
        share = sum(min(c, discounts[m]) for c in same.values()) / total
        return max(used[m].get(context + ch, 0) - discounts[m], 0) / total + share * lower

    def word_log(w):
        w = f" {w} "
        return sum(math.log(prob(w[max(0, i - order + 1):i], w[i])) for i in range(1, len(w)))

    return word_log


def test_kneser_ney_equals_brute_force():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abcé", k=rng.randint(1, 5))) for _ in range(40)})
    counts = np.array([rng.randint(1, 9) for _ in words])
    fitted = langid.fit_language(words, counts, 3)
    model = langid.combine({"x": (*fitted, set("".join(words)))}, 3)
    tried = [*words, "zzz", "abz", "ééa"]
    brute = brute_kneser_ney(words, counts.tolist(), 3)
    assert model.word_scores(tried)[:, 0] == pytest.approx([brute(w) for w in tried], rel=1e-9)


# -- toxicity -----------------------------------------------------------------------------

def test_toxicity_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    learn = crc_mod("doc_id", 4) != 2
    model = toxicity.fit(docs.where(learn), labels.where(learn))
    rows = toxicity.score(docs.where(~learn), model, keep=["doc_id"]).join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.04 * len(clean)
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) for r in rows)


def test_toxicity_of_odd_texts_and_without_labels(spark):
    texts = [*odd_texts(), "you are a pathetic worthless idiot", "idiot idiot " * 2000]
    docs = docs_frame(spark, texts, extra=CLASHING)
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, nothing)
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows.values())
    assert rows[0]["score"] == rows[1]["score"] and rows[3]["score"] == rows[4]["score"]
    assert rows[len(texts) - 2]["predicted"] == 1 and rows[1]["predicted"] == 0
    assert toxicity.score(docs_frame(spark, []), toxicity.fit(docs_frame(spark, []), nothing)).count() == 0
    odd_labels = spark.createDataFrame([(0, None), (None, 1), (3, 1), (3, 0), (5, 7)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, odd_labels)).count() == len(texts)


def test_label_model_finds_the_voters_rates():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    rates = np.array([[0.02, 0.05, 0.01, 0.3], [0.6, 0.5, 0.4, 0.3]])
    votes = (rng.random((4000, 4)) < rates[y.astype(int)]).astype(float)
    votes = np.hstack([votes, votes[:, :1]])  # a copy of the first voter
    labels = np.where(rng.random(4000) < 0.3, y.astype(int), -1)
    model = toxicity.fit_label_model(votes, labels, 0.2)
    assert model.rates[:, :4] == pytest.approx(rates, abs=0.2)
    assert model.weight[0] < 0.7 and model.weight[4] < 0.7 < model.weight[1]
    assert ((model.posterior(votes, np.full(4000, -1)) > 0.5) == y).mean() > 0.9


# -- language model -----------------------------------------------------------------------

def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


def fit_and_score(docs, **options):
    model, others = hpylm.fit(docs.where(crc_mod("doc_id", 5) != 1), **options)
    return model, {r["doc_id"]: r for r in hpylm.score(docs, model, others).collect()}


def test_base_scores_and_both_ways_of_lookup(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    model, rows = fit_and_score(docs)
    small, joined = fit_and_score(docs, broadcast_words=50)
    assert model.complete and not small.complete and len(small.keys) <= 50
    tokens = {r["doc_id"]: [*words_of(lower_az(r["text"])), ""] for r in docs.collect()}
    counts = Counter(w for i, ws in tokens.items() if not held_out(i) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        for r in (rows[i], joined[i]):
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), total)
            assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert rows[i]["score"] == pytest.approx(joined[i]["score"], rel=1e-9)
    assert (model.words.sum(axis=0) < 1).all()


def test_word_probabilities_sum_to_one(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("ab", k=rng.randint(1, 3))) for _ in range(30)) for _ in range(20)]
    model, _ = hpylm.fit(docs_frame(spark, texts), order=3)
    known = {w for t in texts for w in t.split()}
    # Every word over the seen letters up to a length, by spelling; longer or other ones get the rest.
    words = ["".join(w) for n in range(1, 13) for w in __import__("itertools").product("ab", repeat=n)]
    spelled = np.exp(model.spelled(words))
    assert 0.9 < spelled.sum() + model.end_share <= 1 + 1e-9
    new = sum(p for w, p in zip(words, spelled, strict=True) if w not in known) * model.new_mass
    assert (0.9 < model.words.sum(axis=0) + new).all() and (model.words.sum(axis=0) + new <= 1 + 1e-6).all()
    # In a context: the shares of its words, and the word restaurant's for the rest.
    for k, context in enumerate(model.contexts.tolist()):
        of = hpylm.pair_hash(model.keys, np.full(len(model.keys), context))
        shares = hpylm.looked_up(model.pair_keys, of, model.pairs, 0.0).sum(axis=0)
        assert shares + model.back[k] == pytest.approx(1.0, abs=1e-9)


def test_seating_bounds_and_repeatability():
    keys = np.arange(1, 2001, dtype=np.uint64)
    customers = np.concatenate([np.arange(1000), np.full(1000, 10 ** 6)]).astype(float)
    opening = np.full(2000, 0.5)
    tables = hpylm.seat(keys, customers, 0.5, opening, 1)
    assert (tables <= customers).all() and (tables[customers > 0] >= 1).all() and (tables[customers == 0] == 0).all()
    assert (tables == hpylm.seat(keys, customers, 0.5, opening, 1)).all()
    few = hpylm.seat(keys, customers, 0.5, opening / 50, 1)
    assert few.sum() < tables.sum()
    # The expected number of tables of c customers, by the exact recursion, for c = 200.
    expected = {1: 1.0}
    dist = {1: 1.0}
    for c in range(1, 200):
        step = Counter()
        for t, p in dist.items():
            new = 0.5 / (0.5 + c - 0.5 * t)
            step[t + 1] += p * new
            step[t] += p * (1 - new)
        dist = step
    expected = sum(t * p for t, p in dist.items())
    drawn = hpylm.seat(np.arange(4000, dtype=np.uint64) * np.uint64(7919), np.full(4000, 200.0), 0.5, np.full(4000, 0.5), 3).mean()
    assert drawn == pytest.approx(expected, rel=0.1)


def test_frequent_and_natural_texts_score_higher(spark):
    texts = ["the cat sat on the mat and the dog sat on the cat"] * 30 + ["a dog and a cat ran"] * 10
    docs = docs_frame(spark, [*texts, "the cat and the dog", "xqz wvk jjq ppz kkw", None, ""])
    model, others = hpylm.fit(docs.where(f"doc_id < {len(texts)}"))
    r = {x["doc_id"]: x for x in hpylm.score(docs, model, others).collect()}
    n = len(texts)
    assert r[n]["score"] > r[n + 1]["score"] and r[n + 1]["n_known"] == 1
    assert r[n + 2]["n_tokens"] == r[n + 3]["n_tokens"] == 1 and r[n + 2]["score"] == r[n + 3]["score"]


def test_language_model_without_training_texts(spark):
    docs = docs_frame(spark, ["some words", None, *odd_texts(n=3)], extra=CLASHING)
    model, others = hpylm.fit(docs.where("doc_id < 0"))
    rows = hpylm.score(docs, model, others).collect()
    assert len(rows) == docs.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert hpylm.score(docs.where("doc_id < 0"), model, others).count() == 0


def test_letter_runs():
    assert langid.letter_runs("Ab1cd_é²x!") == ["ab", "cd", "é", "x"] or langid.letter_runs("Ab1cd_é²x!") == ["ab", "cd", "é²x"]
    assert langid.letter_runs("12 ²") == []
    assert not re.search("[A-Z]", "".join(langid.letter_runs("ABC Def")))
    grams = langid.Grams(["ab", "c"], 3)
    assert grams.at.tolist() == [0, 1, 2, 3, 1, 2] and grams.starts.tolist() == [1, 4]
    assert pa.array(["a"]).type == pa.string()
