"""Toxicity scores by weak supervision.

Many voters look at a text: words and beginnings of words that a bounded sample of labelled
texts ties to toxicity, a built-in word list, and patterns of shouting and address. A generative
label model (two classes, each voter with its own rates of firing) estimates the voters'
accuracies by expectation maximisation on that sample, the given labels being one more voter; voters
that fire together within a class share their weight by the estimated correlations. A linear
classifier trained on the posterior labels then scores every text from the same voters, without
the labels.

Words are runs of letters, lower-cased. Null and empty texts have no votes and get the score of
a text without any. Very long texts are scored whole. Equal texts have equal scores, so repeated rows do;
an id labelled twice counts as toxic if one label says so. Without labelled rows the built-in list alone
decides; no rows to score give none. A kept column with an output's name gives way.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, cut, sums_by_text, text_of, with_arrow, word_index, worker_state
from .langid import letter_runs

# Built-in insults, one voter together (fixed values).
LEXICON = ("bastard", "bitch", "cretin", "disgusting", "dumb", "dumbass", "fool", "garbage", "idiot", "imbecile", "jerk",
           "loser", "moron", "pathetic", "retard", "scum", "scumbag", "shit", "stupid", "trash", "ugly", "worthless")
PREFIXES = (4, 5, 6, 7, 8) # lengths of word beginnings that may become voters
PATTERNS = ("shouting", "exclaiming", "address")
ADDRESSES = frozenset(("you", "your", "youre", "yourself"))


def features_of(word: str) -> list[str]:
    """What a word may vote by: itself and its beginnings."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


@dataclass
class Voters:
    """Voter j < len(terms): a term occurs. Then: any built-in word, and the patterns."""

    terms: list[str]
    index: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.index = {t: j for j, t in enumerate(self.terms)}
        self.lexicon = frozenset(LEXICON)

    @property
    def size(self) -> int:
        return len(self.terms) + 1 + len(PATTERNS)

    def of_word(self, chunk: str) -> tuple[int, int, tuple[int, ...]]:
        """(letters runs, runs that address someone, voters) of a run of characters between spaces."""
        runs = letter_runs(chunk)
        hits = {self.index[f] for r in runs for f in features_of(r) if f in self.index}
        if any(r in self.lexicon for r in runs):
            hits.add(len(self.terms))
        return len(runs), sum(r in ADDRESSES for r in runs), tuple(sorted(hits))

    def votes(self, texts: pa.Array, cache: WordCache) -> tuple[np.ndarray, np.ndarray]:
        """Per text: which voters fire; words that carry a term, as a share (in root) and a log."""
        chunks, index, offsets = word_index(texts)
        known = cache.ensure(chunks)
        rows = [known[c] for c in chunks]
        counts = np.array([(n, a, bool(h)) for n, a, h in rows], dtype=np.float64).reshape(-1, 3)
        sums = sums_by_text(counts[index], offsets)
        fired = np.zeros((len(texts), self.size), dtype=np.float32)
        places = np.flatnonzero(counts[index, 2])
        text = np.searchsorted(offsets, places, side="right") - 1
        for i, w in zip(text.tolist(), index[places].tolist(), strict=True):
            fired[i, list(rows[w][2])] = 1
        words = np.maximum(sums[:, 0], 1)
        length = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1)
        upper = pc.count_substring_regex(texts, r"\p{Lu}").to_numpy(zero_copy_only=False)
        bangs = pc.count_substring(texts, "!").to_numpy(zero_copy_only=False)
        fired[:, -3] = upper > 0.4 * length
        fired[:, -2] = bangs > 0.3 * words
        fired[:, -1] = (sums[:, 1] > 0) & (sums[:, 2] > 0)
        return fired, np.stack([np.sqrt(sums[:, 2] / words), np.log1p(sums[:, 2])], axis=1).astype(np.float32)


def with_none(votes: np.ndarray) -> np.ndarray:
    return np.hstack([votes, (votes.sum(axis=1, keepdims=True) == 0)])


@dataclass
class LabelModel:
    """Rates at which each voter fires by class, the classes' shares, weights by correlation."""

    rates: np.ndarray     # 2 x voters
    prior: float
    weight: np.ndarray
    label_rates: np.ndarray   # how often the given label is 1 in each class

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """P(toxic); ``labels``: 0, 1 or -1 (none)."""
        # A voter that does not fire abstains; that none fires is one vote more.
        odds = with_none(votes) @ (np.log(self.rates[1] / self.rates[0]) * self.weight)
        given = np.log(self.label_rates[1] / self.label_rates[0]), np.log((1 - self.label_rates[1]) / (1 - self.label_rates[0]))
        odds = odds + np.where(labels == 1, given[0], np.where(labels == 0, given[1], 0.0)) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_label_model(votes: np.ndarray, labels: np.ndarray, prior: float, rounds: int = 20) -> LabelModel:
    """Expectation maximisation from the labels; -1 marks rows without one. ``prior``: share of
    the class among labelled rows, held fixed."""
    plain, votes = votes, with_none(votes)
    n, k = votes.shape
    post = np.where(labels == 1, 0.95, np.where(labels == 0, 0.02, 0.1)).astype(np.float64)
    for _ in range(rounds):
        mass = np.array([(1 - post).sum(), post.sum()])
        rates = np.stack([((1 - post) @ votes + 0.1) / (mass[0] + 1), (post @ votes + 0.1) / (mass[1] + 1)])
        rates = np.clip(rates, 1e-5, 1 - 1e-5)
        # Correlation within the classes: voters that fire together count as fewer.
        shared = np.zeros((k, k))
        for y, p in ((0, 1 - post), (1, post)):
            centred = (votes - rates[y]) * np.sqrt(p)[:, None]
            cov = centred.T @ centred
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            shared += mass[y] / n * np.clip(cov / np.outer(sd, sd), 0, 1)
        weight = 1 / np.maximum(1.0, shared.sum(axis=1))
        has = labels >= 0
        said = np.array([((w * (labels == 1))[has].sum() + 0.5) / (w[has].sum() + 1) for w in (1 - post, post)])
        model = LabelModel(rates, float(np.clip(prior, 1e-3, 0.5)), weight, np.array([min(said[0], 0.05), max(said[1], 0.8)]))
        new = model.posterior(plain, labels)
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return model


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels (Newton steps); the last is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + penalty * w
        hessian = (x.T * (p * (1 - p))) @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Classifier:
    voters: Voters
    weights: np.ndarray

    def scores(self, texts: pa.Array, cache: WordCache) -> np.ndarray:
        fired, amounts = self.voters.votes(texts, cache)
        return 1 / (1 + np.exp(-np.clip(np.hstack([fired, amounts]) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def mine_terms(sample: DataFrame, most_terms: int, least_lift: float) -> list[str]:
    """Words and beginnings that toxic texts of the labelled sample have far more often."""

    def make():
        def run(texts, labels):
            found = (Counter(), Counter())
            for t, y in zip(texts.to_pylist(), labels.to_pylist(), strict=True):
                found[y].update({f for r in {r for c in set(t.split()) for r in letter_runs(c)} for f in features_of(r)})
            rows = [(y, f, n) for y in (0, 1) for f, n in found[y].items() if n > 1 or y]
            return [0] * len(rows), *([r[j] for r in rows] for j in range(3))

        return run

    counts = (with_arrow(sample, make, [("y", "int"), ("term", "string"), ("n", "long")], [F.col("text"), F.col("toxic")],
                         keep=[], flat=True)
              .groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"),
                                   F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0")))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return []
    least = max(5, 0.01 * toxic)
    lift = (F.col("n1") / toxic) / ((F.col("n0") + 1) / clean)
    return [r["term"] for r in counts.where((F.col("n1") >= least) & (lift >= least_lift))
            .orderBy(F.col("n1").desc(), "n0", F.length("term").desc(), "term").limit(most_terms).collect()]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
        rows_per_class: int = 6000, unlabelled_rows: int = 6000, most_terms: int = 400, least_lift: float = 15.0) -> Classifier:
    """Learns from ``docs`` (with ``labels`` where they have any). The sample is bounded: about
    ``rows_per_class`` rows of each label and ``unlabelled_rows`` others, chosen by a hash."""
    own = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{toxic}`").cast("int").alias("toxic"))
    own = own.where("toxic in (0, 1) and id is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select(F.col(f"`{doc_id}`").alias("id"))
    drawn = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20))
    sizes = {r["toxic"]: r["count"] for r in ids.join(own, "id", "left").groupBy(F.coalesce("toxic", F.lit(-1)).alias("toxic")).count().collect()}
    share = {y: min(1.0, n / max(1, sizes.get(y, 0))) for y, n in ((0, rows_per_class), (1, rows_per_class), (-1, unlabelled_rows))}
    limit = F.when(F.col("toxic") == 1, share[1]).when(F.col("toxic") == 0, share[0]).otherwise(share[-1])
    # Only ids are shuffled. Those drawn, as many as the parameters bound, go to the texts where these are read.
    picked = (ids.distinct().join(own, "id", "left").withColumn("toxic", F.coalesce("toxic", F.lit(-1)))
              .where(drawn < limit * F.lit(1 << 20)))
    sample = cut(docs.select(F.col(f"`{doc_id}`").alias("id"), text_of(text).alias("text")).join(F.broadcast(picked), "id").select("text", "toxic"))
    voters = Voters(mine_terms(sample.where("toxic >= 0"), most_terms, least_lift))

    def make():
        def run(texts, labels):
            cache = worker_state("voters", tuple(voters.terms), lambda: WordCache(lambda cs: [voters.of_word(c) for c in cs], 200_000))
            fired, amounts = voters.votes(texts, cache)
            return [r.tobytes() for r in fired], [r.tobytes() for r in amounts], labels

        return run

    rows = with_arrow(sample, make, [("fired", "binary"), ("amounts", "binary"), ("y", "int")],
                      [F.col("text"), F.col("toxic")], keep=[]).toArrow().to_pandas()
    fired = np.frombuffer(b"".join(rows["fired"]), dtype=np.float32).reshape(len(rows), voters.size).astype(np.float64)
    amounts = np.frombuffer(b"".join(rows["amounts"]), dtype=np.float32).reshape(len(rows), 2)
    if not len(rows) or not (rows["y"] >= 0).any():
        weights = np.zeros(voters.size + 3)
        weights[len(voters.terms)], weights[-1] = 4.0, -3.0
        return Classifier(voters, weights)
    y = rows["y"].to_numpy()
    prior = sizes.get(1, 0) / max(1, sizes.get(0, 0) + sizes.get(1, 0))
    target = fit_label_model(fired, y, prior).posterior(fired, y)
    return Classifier(voters, fit_linear(np.hstack([fired, amounts]), target))


def score(docs: DataFrame, classifier: Classifier, text: str = "text", keep: list[str] | None = None,
          threshold: float = 0.3) -> DataFrame:
    """``docs``' ``keep`` columns plus score (0 to 1) and predicted (1 from ``threshold`` on)."""
    shared, token = docs.sparkSession.sparkContext.broadcast(classifier), uuid.uuid4().hex

    def make():
        model = shared.value
        cache = worker_state("toxicity", token, lambda: WordCache(lambda cs: [model.voters.of_word(c) for c in cs], 300_000))

        def run(texts):
            s = model.scores(texts, cache)
            return s, (s >= threshold).astype(np.int32)

        return run

    return with_arrow(docs, make, [("score", "double"), ("predicted", "int")], [text_of(text)], keep=keep)
