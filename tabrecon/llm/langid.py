"""Language identification by interpolated Kneser-Ney character models, one per language.

Words (runs of letters, lower-cased) are scored character by character, each given up to
``order - 1`` characters before it in the word, the word's start included; its end is predicted
too. All languages share one sorted array of n-gram hashes with a row of discounted
probabilities and back-off weights per n-gram. A text's language has the lowest cross-entropy
per character.

The models are fitted on a bounded sample of labelled rows (``docs_per_lang`` rows a language are
expected in it, chosen by a hash of id and text). An eighth of it is kept back to calibrate the
confidence and the rejection: per language, the excess of a text's cross-entropy over the usual
one, scaled for its length, that is ``reject_spread`` robust spreads above the median (:func:`calibrate`),
and never under a fixed least excess.

Null texts and texts without a letter get ``und``, score 0 and are rejected. Without any labelled
row every text does. Very long texts are judged whole. Equal texts get equal results, repeated rows do; ties go
to the language first in order. No rows to judge give none. A kept column with an output's name gives way.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordCache, release, sums_by_text, text_of, with_arrow, word_index, worker_state

UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd multipliers


def letter_runs(chunk: str) -> list[str]:
    return [r for r in LETTERS.findall(chunk.lower()) if any(map(str.isalpha, r))]


class Grams:
    """Hashes of all character n-grams of some words, by order and place."""

    def __init__(self, words: list[str], order: int):
        line = " " + " ".join(words) + " "
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        n = len(codes)
        places = np.arange(n)
        spaces = np.where(codes == 32, places, 0)
        before = np.zeros(n, dtype=np.int64)
        before[1:] = np.maximum.accumulate(spaces)[:-1]
        self.at = places - before            # places since the word's start; 0 only at the very first
        self.starts = np.flatnonzero(codes == 32)[:-1] + 1
        self.word = np.cumsum(codes == 32) - 1
        self.word[codes == 32] -= 1          # a word's end belongs to it
        self.hash = []
        rolling, power = np.zeros(n, dtype=np.uint64), np.uint64(1)
        with np.errstate(over="ignore"):
            for m in range(1, order + 1):
                rolling = rolling.copy()
                rolling[m - 1:] += (codes[:n - m + 1] + np.uint64(1)) * power
                power *= _BASE
                mixed = (rolling + np.uint64(m)) * _MIX
                self.hash.append(mixed ^ (mixed >> np.uint64(29)))


def fit_language(words: list[str], counts: np.ndarray, order: int) -> tuple[dict, dict, float]:
    """(probability by n-gram hash, back-off weight by context hash, weight of the uniform floor)."""
    grams = Grams(words, order)
    weight = counts[np.maximum(grams.word, 0)].astype(np.float64)
    prob: list[tuple[np.ndarray, np.ndarray]] = []
    back: list[tuple[np.ndarray, np.ndarray]] = []
    floor = 1.0
    for m in range(1, order + 1):
        at = np.flatnonzero(grams.at >= max(1, m - 1))
        keys, first, inverse = np.unique(grams.hash[m - 1][at], return_index=True, return_inverse=True)
        count = np.bincount(inverse, weight[at], len(keys))
        place = at[first]
        if m < order:  # lower orders count the characters that an n-gram follows
            longer = np.flatnonzero(grams.at >= m)
            _, one = np.unique(grams.hash[m][longer], return_index=True)
            follows = np.bincount(np.searchsorted(keys, grams.hash[m - 1][longer[one]]), minlength=len(keys))
            count = np.where((grams.at[place] == m - 1) & (m > 1), count, np.maximum(follows, 1))
        ones, twos = np.sum(count == 1), np.sum(count == 2)
        discount = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
        if m == 1:
            total = count.sum()
            prob.append((keys, np.maximum(count - discount, 0) / total))
            floor = np.minimum(count, discount).sum() / total
        else:
            context, of = np.unique(grams.hash[m - 2][place - 1], return_inverse=True)
            total = np.bincount(of, count, len(context))
            prob.append((keys, np.maximum(count - discount, 0) / total[of]))
            back.append((context, np.bincount(of, np.minimum(count, discount), len(context)) / total))
    join = lambda parts: tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return join(prob), join(back) if back else (np.zeros(0, np.uint64), np.zeros(0)), floor


@dataclass
class Model:
    langs: list[str]
    order: int
    keys: np.ndarray      # sorted n-gram hashes
    prob: np.ndarray      # a row per key and one of zeros
    back: np.ndarray      # a row per key and one of ones
    floor: np.ndarray     # probability of any character before the first order
    usual: np.ndarray | None = None    # cross-entropy of the language's texts
    limit: np.ndarray | None = None    # scaled excess from which a text is rejected
    sharpness: float = 1.0

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Per word: log-probability in each language, characters (its end too), letters."""
        grams = Grams(words, self.order)
        rows = []
        for h in grams.hash:
            i = np.searchsorted(self.keys, h)
            i[i == len(self.keys)] = 0
            rows.append(np.where(self.keys[i] == h, i, len(self.keys)))
        p = self.prob[rows[0]] + self.floor
        for m in range(2, self.order + 1):
            at = np.flatnonzero(grams.at >= max(1, m - 1))
            p[at] = self.prob[rows[m - 1][at]] + self.back[rows[m - 2][at - 1]] * p[at]
        logs = np.log(p)
        out = np.empty((len(words), len(self.langs) + 2))
        out[:, :-2] = np.add.reduceat(logs[1:], grams.starts - 1, axis=0)
        out[:, -2] = [len(w) + 1 for w in words]
        out[:, -1] = [sum(map(str.isalpha, w)) for w in words]
        return out

    def judge(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language index, confidence, cross-entropy, rejected) of texts' summed word scores."""
        chars = np.maximum(totals[:, -2:-1], 1)
        entropy = -totals[:, :-2] / chars
        best = entropy.argmin(axis=1)
        lowest = entropy.min(axis=1)
        odds = np.exp(-(entropy - lowest[:, None]) * self.sharpness * np.sqrt(chars))
        excess = self.excess(lowest, best, chars[:, 0])
        return best, 1 / odds.sum(axis=1), lowest, excess > self.limit[best]

    def excess(self, entropy, lang, chars):
        return (entropy - self.usual[lang]) * np.sqrt(chars / (1 + chars / 400))


class TextScorer:
    """Summed word scores of texts; those of frequent words and chunks are kept."""

    def __init__(self, model: Model, cap: int = 70_000):
        self.model, self.width = model, len(model.langs) + 2
        self.runs = WordCache(lambda ws: [r.tobytes() for r in model.word_scores(ws)], cap)
        self.chunks = WordCache(self._chunks, cap)

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        split = [letter_runs(c) for c in chunks]
        known = self.runs.ensure(r for s in split for r in s)
        return [known[s[0]] if len(s) == 1 else self._rows([known[r] for r in s]).sum(axis=0).tobytes() for s in split]

    def _rows(self, parts: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(parts), dtype=np.float64).reshape(-1, self.width)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        chunks, index, offsets = word_index(texts)
        known = self.chunks.ensure(chunks)
        return sums_by_text(self._rows([known[c] for c in chunks])[index], offsets)


def combine(fitted: dict[str, tuple], order: int) -> Model:
    langs = sorted(fitted)
    keys = np.unique(np.concatenate([k for lang in langs for k in (fitted[lang][0][0], fitted[lang][1][0])]))
    prob = np.zeros((len(keys) + 1, len(langs)))
    back = np.ones((len(keys) + 1, len(langs)))
    alphabet = 1 + len({k for lang in langs for k in fitted[lang][3]})
    for j, lang in enumerate(langs):
        (pk, pv), (bk, bv), _, _ = fitted[lang]
        prob[np.searchsorted(keys, pk), j] = pv
        back[np.searchsorted(keys, bk), j] = bv
    floor = np.array([max(fitted[lang][2], 1e-6) / alphabet for lang in langs])
    return Model(langs, order, keys, prob, back, floor)


def calibrate(model: Model, totals: np.ndarray, truth: np.ndarray, reject_spread: float, least_excess: float = 8.0) -> None:
    """Sets the usual entropies, the rejection limits and the sharpness from labelled texts.

    A language's limit is the median excess of its texts and ``reject_spread`` times their spread, taken from
    the median down to the lowest tenth: junk among the labelled texts is above both, and up to a third
    of it hardly moves them, so that it does not lift the limit to let itself pass."""
    n = len(model.langs)
    model.usual, model.limit = np.zeros(n), np.full(n, np.inf)
    if not len(totals):
        return
    chars = np.maximum(totals[:, -2], 1)
    entropy = -totals[:, :-2] / chars[:, None]
    for j in range(n):
        mine = truth == j
        if mine.any():
            model.usual[j] = np.median(entropy[mine, j])
            excess = model.excess(entropy[mine, j], np.full(mine.sum(), j), chars[mine])
            low, middle = np.quantile(excess, [0.1, 0.5])
            model.limit[j] = max(middle + reject_spread * (middle - low) / 1.2816, least_excess)
    gaps = entropy - entropy.min(axis=1, keepdims=True)
    best = (np.inf, 1.0)
    for sharpness in 2.0 ** np.arange(-4, 3):
        logits = -gaps * sharpness * np.sqrt(chars)[:, None]
        loss = np.logaddexp.reduce(logits, axis=1) - logits[np.arange(len(truth)), truth]
        best = min(best, (np.minimum(loss, 20).mean(), sharpness))
    model.sharpness = best[1]


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", order: int = 4,
        docs_per_lang: int = 2000, reject_spread: float = 25.0, least_aside: int = 16) -> Model | None:
    """The models of all languages in ``docs`` (labelled rows); None without any. An eighth of a language's rows
    is set aside for calibration where it has ``least_aside`` rows or more."""
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), text_of(text).alias("text"),
                       F.col(f"`{doc_id}`").alias("id")).where("lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, docs_per_lang / n))])
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20))
    sample = (rows.withColumn("drawn", drawn).where(F.col("drawn") < share[F.col("lang")] * F.lit(1 << 20))
              .withColumn("aside", F.col("lang").isin([k for k, n in counts.items() if n >= least_aside])
                          & (F.pmod(F.xxhash64("drawn", "text"), F.lit(8)) == 0)))

    def words():
        def run(langs, texts):
            langs, texts = langs.to_pylist(), texts.to_pylist()
            found: dict[str, Counter] = {}
            for name, t in zip(langs, texts, strict=True):
                found.setdefault(name, Counter()).update(r for c in t.split() for r in letter_runs(c))
            first = {name: langs.index(name) for name in found}
            rows = [(first[name], w, n) for name, c in found.items() for w, n in c.items()]
            return list(zip(*rows, strict=True)) if rows else ([], [], [])

        return run

    learn = sample.where("not aside")
    table = (with_arrow(learn, words, [("word", "string"), ("n", "long")], [F.col("lang"), F.col("text")],
                        keep=["lang"], flat=True)
             .groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().to_pandas())
    if table.empty:
        return None
    release(docs.sparkSession)
    fitted = {}
    for name, part in table.sort_values(["lang", "word"]).groupby("lang"):
        known = part["word"].tolist()
        fitted[name] = (*fit_language(known, part["n"].to_numpy(), order), set("".join(known)))
    model = combine(fitted, order)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def totals():
        scorer = TextScorer(shared.value)
        return lambda texts: ([row.tolist() for row in scorer(texts)],)

    aside = (with_arrow(sample.where("aside"), totals, [("totals", "array<double>")], [F.col("text")], keep=["lang"])
             .where(F.col("lang").isin(model.langs)).toArrow().to_pandas())
    own = np.array(aside["totals"].tolist(), dtype=np.float64).reshape(-1, len(model.langs) + 2)
    truth = np.array([model.langs.index(x) for x in aside["lang"]], dtype=np.int64)
    lettered = own[:, -1] > 0
    calibrate(model, own[lettered], truth[lettered], reject_spread)
    return model


def predict(docs: DataFrame, model: Model | None, text: str | Column = "text", keep: list[str] | None = None,
            names: tuple[str, str, str, str] = ("lang_pred", "score", "cross_entropy", "rejected")) -> DataFrame:
    """``docs`` (its ``keep`` columns) plus language, confidence, cross-entropy per character
    (nats; null without letters) and whether the text is rejected as no known language."""
    shared, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make():
        if shared.value is None:
            return lambda texts: ([UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts),
                                  [True] * len(texts))
        model = shared.value
        scorer = worker_state("langid", token, lambda: TextScorer(model))

        def run(texts):
            totals = scorer(texts)
            if not len(totals):
                return [], [], [], []
            best, score, entropy, rejected = model.judge(totals)
            lettered = (totals[:, -1] > 0).tolist()
            pick = lambda values, other: [v if ok else other for v, ok in zip(values, lettered, strict=True)]
            return (pick([model.langs[b] for b in best], UNDETERMINED), pick(score.tolist(), 0.0),
                    pick(entropy.tolist(), None), pick(rejected.tolist(), True))

        return run

    column = text_of(text) if isinstance(text, str) else text
    types = ("string", "double", "double", "boolean")
    return with_arrow(docs, make, list(zip(names, types, strict=True)), [column], keep=keep)
