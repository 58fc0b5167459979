"""Scores of texts under a hierarchical Pitman-Yor language model.

A word is drawn in the restaurant of its context, the word before it (before a text's first word the end of a
text). All contexts share a parent, the word restaurant over the corpus' words (and the end of a text), which
gets its new words from character restaurants: one per context of up to ``order - 1`` characters before a place
in the word, whose parent is the context without its first character. A table in a context's restaurant
is a customer of the word restaurant; a word of the vocabulary is one customer of the character restaurants.

* Seating is sampled by Gibbs sweeps (:func:`seat_buckets`, :func:`seat_parts`, :func:`seat`): a dish's customers leave
  their restaurant and are seated again given all others, customer by customer for the first ones, then in growing
  blocks; the tables they open are then seated in the parent. The random numbers are hashes of dish, sweep and step, so
  a repeated task gives the same tables.
* Counts are taken over all training texts by Spark. Pairs of words are dealt to buckets by their context, pairs of
  hot contexts to all; words to parts. In a sweep buckets tell parts the tables of their words, and parts tell buckets
  the words' customers. A pair seen once has one table in every seating and takes no part.
* Several sweeps are kept and their predictive probabilities averaged.
* What is shuffled to count pairs or to score texts is several times the model, so both go on slice by slice: of the
  buckets, of the batches of texts. A slice's shuffles are dropped before the next one's are written.
* The words with the highest counts, at most ``broadcast_words``, go to the workers as sorted hash arrays, and all
  pairs if these are all words and there are at most ``broadcast_pairs``. Otherwise each batch of texts asks the parts
  for its other words and the buckets for its pairs.
* The character restaurants stay in tables. The parent of a context of two or more characters ends
  in the same two characters or is the last one alone, so restaurants whose contexts end in the
  same two characters are sampled together, those of one character in a second step, and the one
  without context, which has a row per character, on the driver. The order does not depend on the
  number of n-grams: the most frequent, at most ``most_grams``, are held by the workers, and words
  that need others are spelled by a join.

Words are runs of characters other than white space (0x20, 0x09-0x0D), A-Z lower-cased. Null and
empty texts are one end. Very long texts are scored whole: sums over their words. Repeated rows count each
time. Without training texts every word is new; no texts to score give no rows. A kept column with an
output's name gives way.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import WordCache, bounded_batches, cut, release, sums_by_text, text_of, with_arrow, word_index, worker_state
from .langid import Grams

END = ""  # the end of a text, as a word
CODE_POINTS = 0x110000
BUCKET_GRAMS = 50_000  # n-grams sampled in one group, about
BUCKET_TOKENS = 2_000_000  # tokens whose pairs are sampled in one group, about
PART_WORDS = 200_000   # words sampled in one group, about
SLICES = 4             # of the buckets when pairs are counted, of the batches when texts are scored: one at a time is shuffled
SETTLE = 1.2           # seconds until what is let go is gone from the disk as well
LOG10 = np.log(10.0)


def hashed_uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) per key, the same whenever it is asked for."""
    with np.errstate(over="ignore"):
        x = keys ^ (np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15))
        for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(m)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0 ** 52


def seat(keys: np.ndarray, customers: np.ndarray, discount: float, opening: np.ndarray, sweep: int,
         slope: np.ndarray | float = 0.0) -> np.ndarray:
    """Tables per dish after seating its ``customers``. ``opening``: mass of a new table, that is
    (strength + discount * tables of the restaurant) * parent's probability of the dish; with ``slope`` =
    discount * that probability the tables of other dishes, and the dish's own are added as they open."""
    slope = np.broadcast_to(np.asarray(slope, dtype=np.float64), customers.shape)
    tables = np.minimum(customers, 1).astype(np.float64)
    seated, open_ = tables.copy(), np.flatnonzero(customers > 1)
    step = 0
    while len(open_):
        block = np.minimum(np.maximum(1, seated[open_] // 12), customers[open_] - seated[open_])
        mass = opening[open_] + slope[open_] * tables[open_]
        new = mass / (mass + np.maximum(seated[open_] - discount * tables[open_], 1e-9))
        mean = block * new
        u = hashed_uniform(keys[open_], sweep * 100_003 + step)
        # One customer: a coin. A block: the mean with its fraction rounded by a coin.
        tables[open_] += np.minimum(block, np.floor(mean) + (u < mean - np.floor(mean)))
        seated[open_] += block
        open_ = open_[seated[open_] < customers[open_]]
        step += 1
    return tables


def discount_of(customers: np.ndarray, weights: np.ndarray | None = None) -> float:
    w = np.ones(len(customers)) if weights is None else weights
    ones, twos = w[customers == 1].sum(), w[customers == 2].sum()
    return float(np.clip(ones / max(1.0, ones + 2 * twos), 0.1, 0.9))


@dataclass
class CharModel:
    order: int
    keys: np.ndarray    # sorted n-gram hashes
    own: np.ndarray     # per key and sweep: its discounted share of its context
    back: np.ndarray    # per key as a context and sweep: the share of its parent
    floor: np.ndarray   # per sweep: the share of the uniform distribution
    complete: bool = True  # no other n-grams have been seen

    def word_logs(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability, its end included; NaN where that takes n-grams
        that may be known but are not held here."""
        out = np.zeros(len(words))
        for a in range(0, len(words), 20_000):
            part = words[a:a + 20_000]
            grams = Grams(part, self.order)
            p = np.repeat((self.floor / CODE_POINTS)[None, :], len(grams.at), axis=0)
            rows = []
            for m, h in enumerate(grams.hash):
                i = np.searchsorted(self.keys, h)
                i[i == len(self.keys)] = 0
                rows.append(np.where(self.keys[i] == h, i, len(self.keys)) if len(self.keys) else np.zeros(len(h), int))
                at = np.flatnonzero(grams.at >= max(1, m))
                if m == 0:
                    p += self.own[rows[0]]
                else:
                    p[at] = self.own[rows[m][at]] + self.back[rows[m - 1][at - 1]] * p[at]
                if not self.complete:
                    p[at[rows[m][at] == len(self.keys)]] = np.nan
            logs = np.log(p.mean(axis=1))
            out[a:a + len(part)] = np.add.reduceat(logs[1:], grams.starts - 1)
        return out


def seat_together(table: pa.Table, low: int, high: int, order: int, discounts: list[float], strength: float, sweep: int,
                  roots: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """One sweep over whole restaurants of the orders ``low`` to ``high``, from the longest contexts
    up. ``counts`` holds the customers from outside (of the highest order also its children's
    tables); ``above_*`` the parents of the lowest order; ``roots`` characters' probabilities."""
    table = table.combine_chunks()
    table = table.take(pa.array(np.argsort(table["key"].to_numpy().view(np.uint64))))
    col = {c: table[c].to_numpy() for c in table.column_names}
    keys, parents, contexts = (col[c].astype(np.int64).view(np.uint64) for c in ("key", "parent", "context"))
    n, m, tables = len(keys), col["m"], col["tables"].copy()
    up = np.searchsorted(keys, parents)
    context, of = np.unique(contexts, return_inverse=True)
    before = np.bincount(of, tables, len(context))
    at = {k: np.flatnonzero(m == k) for k in range(low, high + 2)}
    prob, customers, discount = np.zeros(n), col["counts"].copy(), np.array(discounts)[m - 1]
    for k in range(low, high + 1 if sweep >= 0 else low):  # probabilities after the last sweep, parents first
        mine = at[k]
        if k > low:
            parent = prob[up[mine]]
        elif low == 2:
            parent = roots[1][np.searchsorted(roots[0], parents[mine])]
        else:
            above = col["above_parent"][mine].astype(np.int64).view(np.uint64)
            parent = col["above_alone"][mine] + col["above_share"][mine] * roots[1][np.searchsorted(roots[0], above)]
        prob[mine] = col["alone"][mine] + col["share"][mine] * parent
        col.setdefault("given", np.zeros(n))[mine] = parent
    for k in range(high, low - 1, -1):
        mine, longer = at[k], at[k + 1]
        customers[mine] += np.bincount(up[longer], tables[longer], n)[mine]
        if sweep < 0:  # start: one table a dish
            tables[mine] = np.minimum(customers[mine], 1)
        else:
            opening = (strength + discounts[k - 1] * before[of[mine]]) * col["given"][mine]
            tables[mine] = seat(keys[mine], customers[mine], discounts[k - 1], opening, sweep * order + k)
    total = np.bincount(of, customers, len(context)) + strength
    share = (strength + discount * np.bincount(of, tables, len(context))[of]) / total[of]
    alone = np.maximum(customers - discount * tables, 0) / total[of]
    return table.select(_GRAM).append_column("tables", pa.array(tables)).append_column(
        "alone", pa.array(alone)).append_column("share", pa.array(share))


def seating(*setting):
    return lambda table: seat_together(table, *setting)


_GRAM = ["bucket", "m", "key", "context", "parent", "n", "own_counts"]
_STATE = "bucket int, m int, key long, context long, parent long, n long, own_counts double, tables double, alone double, share double"


def sample_characters(grams: DataFrame, order: int, sweeps: int, kept: int, strength: float) -> tuple[DataFrame, np.ndarray]:
    """Samples the seating of all restaurants, in one grouped job per sweep and level of the tree: (key, n, own, back) of every n-gram, with a value per kept sweep, and the
    shares of the uniform distribution. ``grams``: m, key, context, parent, tree, n, n_first."""
    spark = grams.sparkSession
    buckets = 1 + grams.count() // BUCKET_GRAMS
    kids = grams.where("m > 1").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    # A character is a customer of its longest context: the highest order's, or one that starts the word.
    own = F.when(F.col("m") == order, F.col("n")).otherwise(F.col("n_first")).cast("double")
    start = grams.join(kids, "key", "left").select(
        F.pmod(F.xxhash64("tree"), F.lit(buckets)).cast("int").alias("bucket"), "m", "key", "context", "parent", "n",
        own.alias("own_counts"), F.when(F.col("m") == order, 0).otherwise(F.coalesce("kids", F.lit(0))).cast("double").alias("kids"))
    start = cut(start)
    held = F.col("own_counts") + F.col("kids")
    kinds = {r["m"]: r for r in start.groupBy("m").agg(*[F.sum((held == k).cast("double")).alias(f"n{k}") for k in (1, 2)]).collect()}
    discounts = [float(np.clip(kinds[m]["n1"] / max(1.0, kinds[m]["n1"] + 2 * kinds[m]["n2"]), 0.1, 0.9)) if m in kinds else 0.5
                 for m in range(1, order + 1)]
    # Order 1 has a row per character: bounded by Unicode.
    first = start.where("m = 1").select("key", "n", "own_counts").toArrow()
    root_keys, root_n, root_counts = (first[c].to_numpy() for c in ("key", "n", "own_counts"))
    by = np.argsort(root_keys.view(np.uint64))
    root_keys, root_n, root_counts = root_keys[by].astype(np.int64).view(np.uint64), root_n[by], root_counts[by]
    root_tables, root_prob = np.ones(len(root_keys)), np.zeros(len(root_keys))
    nothing = [F.lit(0.0).alias(c) for c in ("tables", "alone", "share")]
    levels = {"deep": (start.where("m > 2").select(*_GRAM, *nothing), 3, order), "two": (start.where("m = 2").select(*_GRAM, *nothing), 2, 2)}
    if order < 3:
        levels.pop("deep")
    if order < 2:
        levels.pop("two")
    saved, root_own, floor = [], [], []
    for sweep in range(-1, sweeps):
        roots, below = (root_keys, root_prob), None
        for name, (state, low, high) in levels.items():
            counts = F.col("own_counts")
            if name == "deep":
                if sweep >= 0:
                    above = levels["two"][0].select(F.col("key").alias("parent"), F.col("parent").alias("above_parent"),
                                                    F.col("alone").alias("above_alone"), F.col("share").alias("above_share"))
                    state = state.join(above, "parent", "left").na.fill(0, ["above_parent", "above_alone", "above_share"])
            elif below is not None:
                state = state.join(below, state["key"] == below["child_of"], "left")
                counts = counts + F.coalesce("child_tables", F.lit(0.0))
            state = state.withColumn("counts", counts).drop("child_of", "child_tables")

            step = seating(low, high, order, discounts, strength, sweep, roots)
            state = cut(state.groupBy("bucket").applyInArrow(step, _STATE))
            levels[name] = (state, low, high)
            below = (state.where(F.col("m") == low).groupBy(F.col("parent").alias("child_of"))
                     .agg(F.sum("tables").alias("child_tables")))
        customers = root_counts.copy()
        if below is not None:
            got = below.toArrow()
            np.add.at(customers, np.searchsorted(root_keys, got["child_of"].to_numpy().astype(np.int64).view(np.uint64)),
                      got["child_tables"].to_numpy())
        if sweep < 0:
            root_tables = np.minimum(customers, 1)
        else:
            opening = np.full(len(customers), (strength + discounts[0] * root_tables.sum()) / CODE_POINTS)
            root_tables = seat(root_keys, customers, discounts[0], opening, sweep * order + 1)
        total = customers.sum() + strength
        share = (strength + discounts[0] * root_tables.sum()) / total
        alone = np.maximum(customers - discounts[0] * root_tables, 0) / total
        root_prob = alone + share / CODE_POINTS
        if sweep >= sweeps - kept:
            saved.append([state for state, _, _ in levels.values()])
            root_own.append(alone)
            floor.append(share)
        release(spark)
    roots = spark.createDataFrame(pa.table({
        "key": pa.array(root_keys.view(np.int64)), "n": pa.array(root_n), "own": pa.array(np.stack(root_own, axis=1).tolist(), pa.list_(pa.float64()))}))
    if not levels:
        return cut(roots.withColumn("back", F.array(*[F.lit(1.0)] * kept))), np.array(floor)
    table = None
    for s, states in enumerate(saved):
        both = states[0] if len(states) == 1 else states[0].unionByName(states[1])
        one = both.select("key", *(["n", "context"] if s == 0 else []), F.col("alone").alias(f"own{s}"), F.col("share").alias(f"share{s}"))
        table = one if table is None else table.join(one, "key")
    table = cut(table)
    backs = table.groupBy("context").agg(F.array(*[F.first(f"share{s}") for s in range(kept)]).alias("back"))
    rows = table.select("key", "n", F.array(*[f"own{s}" for s in range(kept)]).alias("own")).unionByName(roots)
    rows = rows.join(backs, rows["key"] == backs["context"], "left").select(
        "key", "n", "own", F.coalesce("back", F.array(*[F.lit(1.0)] * kept)).alias("back"))
    return cut(rows), np.array(floor)


def size_class(count: str = "n") -> Column:
    """Counts by size, eight classes an octave: 1 is class 0, 2 is class 8, and a class of large counts holds
    those within a tenth of one another. A table has a few hundred classes however large its counts are."""
    return F.floor(8 * F.log2(count)).cast("int")


def least_class(histogram: dict[int, int], most: int) -> int:
    """The least class from which on at most ``most`` rows are of that class or a higher one."""
    least, size = max(histogram, default=0) + 1, 0
    for k in sorted(histogram, reverse=True):
        size += histogram[k]
        if size > most:
            break
        least = k
    return least


def fit_characters(vocabulary: DataFrame, order: int = 5, most_grams: int = 500_000, sweeps: int = 4, kept: int = 2,
                   strength: float = 1.0) -> tuple[CharModel, DataFrame]:
    """The character restaurants of the ``word`` column's distinct words: what workers hold, and
    all n-grams."""

    def make():
        def run(words):
            words = [w for w in words.to_pylist() if w]
            cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(7)]
            grams = Grams(words, order) if words else None
            for m in range(1, order + 1 if words else 0):
                at = np.flatnonzero(grams.at >= max(1, m - 1))
                keys, first, inverse = np.unique(grams.hash[m - 1][at], return_index=True, return_inverse=True)
                context, parent, tree = np.zeros((3, len(keys)), np.uint64)
                if m > 1:
                    context, parent = grams.hash[m - 2][at[first] - 1], grams.hash[m - 2][at[first]]
                    tree = grams.hash[min(m - 2, 1)][at[first] - 1]
                for c, v in zip(cols, (np.full(len(keys), m), keys.view(np.int64), context.view(np.int64), parent.view(np.int64),
                                       tree.view(np.int64), np.bincount(inverse, minlength=len(keys)),
                                       np.bincount(inverse, grams.at[at] + 1 == m, len(keys))), strict=True):
                    c.append(v.astype(np.int64))
            flat = [np.concatenate(c) for c in cols]
            return [np.zeros(len(flat[0]), np.int64), flat[0].astype(np.int32), *flat[1:]]

        return run

    names = ("key", "context", "parent", "tree", "n", "n_first")
    grams = (with_arrow(vocabulary, make, [("m", "int"), *((c, "long") for c in names)], [F.col("word")], keep=[], flat=True)
             .groupBy("m", "key", "context", "parent", "tree").agg(F.sum("n").alias("n"), F.sum("n_first").alias("n_first")))
    grams = cut(grams)
    release(vocabulary.sparkSession)
    grams, floor = sample_characters(grams, order, sweeps, kept, strength)
    histogram = {r["size"]: r["count"] for r in grams.groupBy(size_class().alias("size")).count().collect()}
    held = grams.where(size_class() >= least_class(histogram, most_grams)).toArrow()
    keys = held["key"].to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(keys)
    own, back = np.zeros((len(keys) + 1, kept)), np.ones((len(keys) + 1, kept))
    for to, c in ((own, "own"), (back, "back")):
        to[:-1] = held[c].combine_chunks().flatten().to_numpy().reshape(-1, kept)[by]
    model = CharModel(order, keys[by], own, back, floor, len(keys) == sum(histogram.values()))
    return model, grams


def spell(words: DataFrame, shared, grams: DataFrame) -> DataFrame:
    """``words`` plus ``base``, the natural log of the probability that the base distribution
    gives each. What the workers' n-grams do not suffice for is joined with all of them."""

    def make():
        return lambda words: (pa.array(shared.value.spelled(words.to_pylist()), from_pandas=True),)

    words = with_arrow(words, make, [("base", "double")], [F.col("word")])
    if shared.value.chars.complete:
        return words
    words = cut(words)
    rest = _spell_by_join(words.where("base is null").select("word").distinct(), shared.value, grams)
    return words.join(rest, "word", "left").withColumn("base", F.coalesce("base", "_base")).drop("_base")


def _spell_by_join(words: DataFrame, model: WordModel, grams: DataFrame) -> DataFrame:
    """(word, _base). Of a character's n-grams the longest, its tail, tells the probability, so
    each distinct tail is joined once."""
    order, floor, not_end = model.chars.order, model.chars.floor.tolist(), float(np.log1p(-model.end_share))

    def make():
        def run(words):
            grams = Grams(words.to_pylist(), order)
            at = np.flatnonzero(grams.at >= 1)
            size = np.minimum(order, grams.at[at] + 1)
            keys = np.stack([h[at] for h in grams.hash], axis=1).view(np.int64)
            contexts = np.stack([np.zeros(len(at), np.uint64), *(h[at - 1] for h in grams.hash[:-1])], axis=1).view(np.int64)
            used = np.arange(order) < size[:, None]
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[used])) for x in (keys, contexts)]
            return (grams.word[at], keys[np.arange(len(at)), size - 1], *lists)

        return run

    spelled = with_arrow(words, make, [("tail", "long"), ("keys", "array<long>"), ("contexts", "array<long>")], [F.col("word")],
                         keep=["word"], flat=True)
    tails = spelled.groupBy("tail").agg(F.first("keys").alias("keys"), F.first("contexts").alias("contexts"))
    kept = range(len(floor))
    own, back = [f"own{s}" for s in kept], [f"back{s}" for s in kept]
    each = (tails.select("tail", F.posexplode(F.arrays_zip("keys", "contexts")).alias("m", "at"))
            .select("tail", "m", F.col("at.keys").alias("key"), F.col("at.contexts").alias("context"))
            .join(grams.select("key", *[F.col("own")[s].alias(own[s]) for s in kept]), "key", "left")
            .join(grams.select(F.col("key").alias("context"), *[F.col("back")[s].alias(back[s]) for s in kept]), "context", "left"))
    of = lambda c, m: F.max(F.when(F.col("m") == m, F.col(c))).alias(f"{c}_{m}")
    parts = each.groupBy("tail").agg(*[of(c, m) for m in range(order) for c in own + (back if m else [])])
    for m in range(order):
        # An order that the tail does not have leaves the probability as it is.
        p = [F.coalesce(f"{own[s]}_{m}", F.lit(0.0))
             + (F.coalesce(f"{back[s]}_{m}", F.lit(1.0)) * F.col(f"p{s}") if m else F.lit(floor[s] / CODE_POINTS)) for s in kept]
        parts = parts.withColumns({f"p{s}": p[s] for s in kept})
    known = parts.select("tail", F.ln(sum((F.col(f"p{s}") for s in kept), F.lit(0.0)) / len(floor)).alias("log"))
    return (spelled.select("word", "tail").join(known, "tail").groupBy("word")
            .agg((F.sum("log") + F.lit(not_end)).alias("_base")))


def contexts_of(words: list[str], index: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last character before each token and before each text's end (its code point and one), 0 at a text's
    start. The model's contexts are whole words (:func:`pairs_of`)."""
    last = np.array([ord(w[-1]) + 1 if w else 0 for w in words], dtype=np.int64)[index] if len(index) else np.zeros(0, np.int64)
    before = np.concatenate([[0], last])
    filled = np.diff(offsets) > 0
    ends = np.where(filled, before[offsets[1:]], 0)
    before = before[:-1]
    before[offsets[:-1][filled]] = 0
    return before, ends


def tokens_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, the end last; the word of each token, each text's end included; first token of each text
    and the end)."""
    words, index, offsets = word_index(pc.ascii_lower(texts))
    if END in words:  # it has no tokens: the words after it move up
        gap = words.index(END)
        words, index = words[:gap] + words[gap + 1:], index - (index > gap)
    return [*words, END], np.insert(index.astype(np.int64), offsets[1:], len(words)), offsets + np.arange(len(offsets))


def pairs_of(tokens: np.ndarray, size: int, places: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """The distinct pairs of a word and the one before it, by the word before: (word before, word, how many, with ``places``
    the pair of each token). Before a text's first word stands the end of a text, the last of ``size`` words."""
    pairs, *at, n = np.unique(np.concatenate([[size - 1], tokens])[:-1] * size + tokens, return_inverse=places, return_counts=True)
    return pairs // size, pairs % size, n, at[0] if places else None


def lines(words: list[str]) -> bytes:
    """Words, which have no line breaks, compressed."""
    data = "\n".join(words).encode("utf-8", "surrogatepass")
    return np.array([len(words), len(data)], "<i8").tobytes() + pa.compress(data, codec="zstd", asbytes=True)


def of_lines(data: bytes) -> list[str]:
    n, size = np.frombuffer(data[:16], "<i8").tolist()
    return pa.decompress(data[16:], decompressed_size=size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\n") if n else []


def hashes_of(words: list[str]) -> np.ndarray:
    """As Spark's ``xxhash64``."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed=42) for w in words], dtype=np.uint64)


def pair_hash(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = word + (context.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, compressed byte by byte."""
    values = values.astype("<u8")
    wide = len(values) > 0 and values.max() >= 1 << 32
    planes = np.ascontiguousarray(values.astype("<u8" if wide else "<u4").view(np.uint8).reshape(-1, 8 if wide else 4).T)
    return np.array([len(values), planes.shape[0]], "<i8").tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data[:16], "<i8").tolist()
    planes = np.frombuffer(pa.decompress(data[16:], decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def looked_up(keys: np.ndarray, asked: np.ndarray, values: np.ndarray, other: float) -> np.ndarray:
    """Rows of ``values`` for the ``asked`` among the sorted ``keys``, ``other`` where there is none."""
    if not len(keys):
        return np.full((len(asked), values.shape[1]), other)
    i = np.searchsorted(keys, asked)
    i[i == len(keys)] = 0
    return np.where((keys[i] == asked)[:, None], values[i], other)


@dataclass
class WordModel:
    """What a worker needs to score words: the frequent words by hash, as words and as contexts, and the
    characters. Arrays with a column per kept sweep."""

    chars: CharModel
    total: int                # training tokens
    distinct: int
    strength: float
    discount: float           # of the contexts' restaurants
    end_share: float
    new_mass: np.ndarray      # share of a word restaurant's new table, per sweep
    keys: np.ndarray          # sorted hashes of the words held
    counts: np.ndarray
    words: np.ndarray         # per word and sweep: its probability in the word restaurant
    back: np.ndarray          # per word as a context and sweep: share of the word restaurant
    pair_keys: np.ndarray     # sorted hashes of (word, word before), if all are held
    pairs: np.ndarray         # per pair and sweep: its discounted share of its context
    complete: bool            # no other words and pairs have been seen
    hot: np.ndarray           # sorted hashes of contexts whose pairs are dealt to all buckets
    buckets: int
    parts: int                # that words are dealt to
    word_discount: float = 0.5
    word_customers: np.ndarray | None = None   # of the word restaurant, per sweep

    @property
    def contexts(self) -> np.ndarray:
        return self.keys

    def base(self, counts):
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def spelled(self, words: list[str]) -> np.ndarray:
        """Natural log of the probability that the base distribution gives each word (NaN: not
        known from the n-grams held here)."""
        logs = self.chars.word_logs([w for w in words if w]) + np.log1p(-self.end_share)
        if END in words:
            logs = np.insert(logs, words.index(END), np.log(self.end_share))
        return logs

    @property
    def row(self) -> np.dtype:
        kept = (len(self.new_mass),)
        return np.dtype([("hash", "<u8"), ("n", "<f8"), ("p", "<f8", kept), ("back", "<f8", kept)])

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, whether they are held): each word's count, its probabilities in the word restaurant, its shares of
        that as a context."""
        out = np.zeros(len(hashes), self.row)
        i = np.searchsorted(self.keys, hashes)
        i[i == len(self.keys)] = 0
        held = self.keys[i] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        out["hash"], out["back"] = hashes, 1.0
        out["n"][held], out["p"][held], out["back"][held] = self.counts[i[held]], self.words[i[held]], self.back[i[held]]
        return out, held

    def of_words(self, told: np.ndarray, spelled: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts, probabilities in the word restaurant, shares of that as contexts) of words that were seen."""
        n, *rest = told.reshape(1 + 3 * kept, -1)
        customers, tables, back = (np.stack(rest[j * kept:(j + 1) * kept], axis=1) for j in range(3))
        p = np.maximum(customers - self.word_discount * tables, 0) / (self.word_customers + self.strength) + self.new_mass * spelled[:, None]
        return n, p, (self.strength + self.discount * back) / (n + self.strength)[:, None]

    def rows(self, words: list[str]) -> list[bytes]:
        """Of a complete model: a row per word, new ones spelled."""
        out, held = self.found(hashes_of(words))
        new = np.flatnonzero(~held)
        if len(new):
            out["p"][new] = np.exp(self.spelled([words[j] for j in new]))[:, None] * self.new_mass
        return [r.tobytes() for r in out]

    def sums(self, tokens: np.ndarray, offsets: np.ndarray, at: np.ndarray, values: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Per text: known tokens, base score, score. ``values``: rows of the words; ``p``: of pairs."""
        each = np.column_stack([(values["n"] > 0)[tokens], self.base(values["n"])[tokens], np.log10(p.mean(axis=1))[at]])
        return sums_by_text(each, offsets)


@dataclass
class Others:
    """What the workers do not hold."""

    words: DataFrame   # per part: keys, spelled probabilities, and ``told``: what :meth:`WordModel.of_words` reads
    pairs: DataFrame   # per bucket: hashes of pairs seen once (alone) and more than once (often), the latter's ``told``: n, tables of the kept sweeps
    grams: DataFrame   # all character n-grams


@dataclass
class Totals:
    """Of a sweep: contexts' tables, the word restaurant's customers and tables."""

    discount: float
    word_discount: float
    strength: float
    contexts: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    word_customers: float
    word_tables: float


def word_share(customers: np.ndarray, tables: np.ndarray, spelled: np.ndarray, t: Totals) -> np.ndarray:
    """The words' probabilities in the word restaurant."""
    return (np.maximum(customers - t.word_discount * tables, 0) + (t.strength + t.word_discount * t.word_tables) * spelled) / (
        t.word_customers + t.strength)


def seat_pairs(keys: np.ndarray, counts: np.ndarray, others: np.ndarray, p: np.ndarray, t: Totals, sweep: int) -> np.ndarray:
    """Tables of pairs, whose customers leave their context's restaurant and are seated again, one after another.
    ``others``: the context's tables of other words; ``p``: the words' probabilities."""
    return seat(keys, counts.astype(np.float64), t.discount, (t.strength + t.discount * others) * p, 2 * sweep, t.discount * p)


def seat_words(keys: np.ndarray, customers: np.ndarray, tables: np.ndarray, spelled: np.ndarray, t: Totals, sweep: int) -> np.ndarray:
    """Tables of words in the word restaurant, whose customers are the contexts' tables."""
    opening = (t.strength + t.word_discount * (t.word_tables - tables)) * spelled
    return seat(keys, customers, t.word_discount, opening, 2 * sweep + 1, t.word_discount * spelled)


def reseat(counts: np.ndarray, of: np.ndarray, contexts: np.ndarray, tables: np.ndarray, word_tables: np.ndarray, spelled: np.ndarray,
           keys: np.ndarray, totals: Totals, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """One sweep over whole words that are held together, the steps of :func:`seat_buckets` and :func:`seat_parts`: a
    word's customers in its contexts, then the tables they opened, its customers in the word restaurant. ``of``: the
    word of each (word, context)."""
    n = len(spelled)
    p = word_share(np.bincount(of, tables, n), word_tables, spelled, totals)
    others = totals.tables[np.searchsorted(totals.contexts, contexts)] - tables
    new = seat_pairs(pair_hash(keys[of], contexts), counts, others, p[of], totals, sweep)
    return new, seat_words(keys, np.bincount(of, new, n), word_tables, spelled, totals, sweep)


# -- tables of arrays: a row per bucket of pairs, a row per part of the words, and what they send one another ------

def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(ddl))


def _table(schema: pa.Schema, rows: list[dict]) -> pa.Table:
    """Rows of numbers and arrays (none: empty). Arrays of whole numbers that may be small are packed."""
    columns = []
    for f in schema:
        if pa.types.is_list(f.type):
            kind = f.type.value_type.to_pandas_dtype()
            lists = [np.asarray(r.get(f.name, ())) for r in rows]
            lists = [x.view(np.int64) if x.dtype == np.uint64 else x.astype(kind, copy=False) for x in lists]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            values = np.concatenate([np.zeros(0, kind), *lists])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, f.type.value_type)))
        elif pa.types.is_binary(f.type):
            columns.append(pa.array([packed(np.asarray(r[f.name])) if f.name in r else None for r in rows], f.type))
        else:
            columns.append(pa.array([r.get(f.name) for r in rows], f.type))
    return pa.Table.from_arrays(columns, names=schema.names)


def _row(table: pa.Table, i: int) -> dict:
    """The arrays of a row."""
    lists = {f.name: pa.types.is_list(f.type) for f in table.schema if pa.types.is_list(f.type) or pa.types.is_binary(f.type)}
    return {c: np.asarray(table[c][i].values) if is_list else unpacked(table[c][i].as_py()) for c, is_list in lists.items() if table[c][i].is_valid}


def _by_number(answers: pa.ListScalar, number: str) -> dict[int, dict]:
    """The rows of a list of structs by their number."""
    if not answers.is_valid:
        return {}
    table = pa.Table.from_batches([pa.RecordBatch.from_struct_array(answers.values)])
    return {k: _row(table, i) for i, k in enumerate(table[number].to_pylist())}


def _hash(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64, copy=False).view(np.uint64)


def _split(keys: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(number, places) of the groups that hashes are dealt to."""
    group = (keys.view(np.int64) % n).astype(np.int32)
    by = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[by], np.arange(n + 1))
    return [(g, by[cuts[g]:cuts[g + 1]]) for g in np.flatnonzero(np.diff(cuts)).tolist()]


def dealt(before: np.ndarray, word: np.ndarray, keys: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, bucket) of pairs. A context's pairs lie in one bucket, a hot one's in all."""
    pairs, small = pair_hash(keys[word], keys[before]), np.uint16 if buckets < 1 << 16 else np.int64
    bucket, everywhere = (keys.view(np.int64) % buckets).astype(small)[before], np.isin(keys, hot)[before]
    bucket[everywhere] = (pairs[everywhere].view(np.int64) % buckets).astype(small)
    return pairs, bucket


def read_pairs(docs: DataFrame, text: str) -> DataFrame:
    """A row per batch of texts: ``words`` with their ``keys`` (hashes) and ``counts``, and the batch's distinct ``pairs`` (steps
    between the numbers of word before and word) with how often they stand there, ``n``."""
    bounded_batches(docs)
    columns = "keys array<long>, words binary, counts binary, pairs binary, n binary"
    schema = _arrow(columns)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                words, tokens, _ = tokens_of(batch.column(0))
                before, word, n, _ = pairs_of(tokens, len(words), places=False)
                packs = np.bincount(tokens, minlength=len(words)), np.diff(before * len(words) + word, prepend=0), n
                counts, pairs, n = (pa.array([packed(x)], pa.binary()) for x in packs)
                yield pa.RecordBatch.from_arrays([pa.array([hashes_of(words).view(np.int64)], schema.field("keys").type),
                                                  pa.array([lines(words)], pa.binary()), counts, pairs, n], names=schema.names)

    return docs.select(text_of(text).alias("text")).mapInArrow(run, columns)


def words_of(chunks: DataFrame) -> DataFrame:
    """(word, c): the words of each batch."""

    def run(batches):
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(of_lines(words.as_py()), pa.string()), pa.array(unpacked(counts.as_py()))], names=["word", "c"])

    return chunks.select("words", "counts").mapInArrow(run, "word string, c long")


def read_chunks(docs: DataFrame, text: str, keep: list[str], shared) -> DataFrame:
    """A row per batch of texts: ``docs`` (their kept columns), ``ends`` of their tokens, ``tokens`` (places among the
    words, packed), ``keys`` (hashes of the words), and the ``words`` that the model does not hold with their ``places``."""
    bounded_batches(docs)
    source = docs.select(text_of(text).alias("text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    fields = T.StructType([T.StructField("at", T.LongType()), *[f for f in source.schema if f.name != "text"]])
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("docs", T.ArrayType(fields))])
    for c, t in (("ends", "array<long>"), ("tokens", "binary"), ("keys", "array<long>"), ("words", "binary"), ("places", "binary")):
        schema.add(c, T._parse_datatype_string(t))

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        for batch in batches:
            if not batch.num_rows:
                continue
            words, tokens, offsets = tokens_of(batch.column(0))
            keys = hashes_of(words)
            kept = pa.StructArray.from_arrays([pa.array(np.arange(batch.num_rows)), *batch.columns[1:]], names=["at", *batch.schema.names[1:]])
            places = np.flatnonzero(~shared.value.found(keys)[1])
            binary = [pa.array([x], pa.binary()) for x in (packed(tokens), lines([words[j] for j in places.tolist()]), packed(places))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), listed(kept), listed(pa.array(offsets)), binary[0], listed(pa.array(keys.view(np.int64))), *binary[1:]],
                names=schema.names)
            number += 1

    return source.mapInArrow(run, schema)


def _chunk(batch: pa.RecordBatch, i: int) -> tuple:
    """(words' hashes, tokens, first token of each text and the end)."""
    offsets = np.asarray(batch.column("ends")[i].values)
    return _hash(np.asarray(batch.column("keys")[i].values)), unpacked(batch.column("tokens")[i].as_py()), offsets


_BUCKET = ("bucket int, part int, w array<long>, n binary, tables binary, contexts array<long>, once binary, more binary, "
           "hot array<long>, hot_tables binary, c binary, seated binary, spelled array<double>")
_PART = ("part int, bucket int, key array<long>, n binary, c binary, spelled array<double>, once binary, customers binary, "
         "tables binary, all_customers double, all_tables double, rare1 long, rare2 long")


def count_pairs(chunks: DataFrame, hot: np.ndarray, buckets: int, parts: int, kept: int, at: int = 0, slices: int = 1) -> DataFrame:
    """Of every ``slices``-th bucket from ``at`` on its ``contexts``; how many of their pairs were seen ``once``, whose one customer has one table in every
    seating (``alone``, their hashes), and how many ``more`` often (w, n, tables), both by context; and what it sends to
    the parts (w, c: tables of pairs seen more often, seated: pairs seen once)."""
    sent = _arrow("bucket int, u array<long>, sizes array<long>, w array<long>, n array<long>")
    merged = _arrow(f"{_BUCKET}, alone array<long>")

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys = _hash(np.asarray(batch.column("keys")[i].values))
                pairs, n = (unpacked(batch.column(c)[i].as_py()) for c in ("pairs", "n"))
                before, word = np.divmod(np.cumsum(pairs), len(keys))
                bucket = dealt(before, word, keys, hot, buckets)[1]
                by = np.flatnonzero(bucket % slices == at)
                by = by[np.argsort(bucket[by], kind="stable")]
                if not len(by):
                    continue
                bucket, before, word, n = bucket[by], before[by], word[by], n[by]
                start = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (bucket[1:] != bucket[:-1])]))
                sizes = np.diff(np.append(start, len(by)))
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                runs = np.searchsorted(start, cuts)
                some = np.flatnonzero(np.diff(cuts))
                lists = lambda at, values: pa.ListArray.from_arrays(
                    pa.array(np.append(at[some], at[-1]), pa.int32()), pa.array(values.astype(np.int64, copy=False)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), lists(runs, keys[before[start]].view(np.int64)), lists(runs, sizes),
                     lists(cuts, keys[word].view(np.int64)), lists(cuts, n)], names=sent.names)

    def merge(table):
        flat = {c: np.asarray(pc.list_flatten(table[c].combine_chunks())) for c in ("u", "sizes", "w", "n")}
        u, w = _hash(np.repeat(flat["u"], flat["sizes"])), _hash(flat["w"])
        keys = pair_hash(w, u)
        by = np.argsort(keys)
        start = np.flatnonzero(np.concatenate([[True], np.diff(keys[by]) > 0]))
        n, keys, u, w = np.add.reduceat(flat["n"][by], start), keys[by[start]], u[by[start]], w[by[start]]
        again = n > 1
        contexts, once = np.unique(u, return_inverse=True)
        words, of = np.unique(w, return_inverse=True)
        by = np.argsort(once, kind="stable")
        lone, more = by[~again[by]], by[again[by]]
        b, counts = table["bucket"][0].as_py(), [np.bincount(once[at], minlength=len(contexts)) for at in (lone, more)]
        rows = [{"bucket": b, "part": -1, "alone": keys[lone], "w": w[more], "n": n[more], "tables": np.ones(kept * len(more), np.int64),
                 "contexts": contexts, "once": counts[0], "more": counts[1], **_hot_tables(contexts, counts[0] + counts[1], hot)}]
        seen = [np.bincount(of[at], minlength=len(words)) for at in (lone, more)]
        rows += [{"bucket": b, "part": p, "w": words[at], "c": seen[1][at], "seated": seen[0][at]} for p, at in _split(words, parts)]
        return _table(merged, rows)

    bounded_batches(chunks)
    rows = chunks.mapInArrow(send, "bucket int, u array<long>, sizes array<long>, w array<long>, n array<long>")
    return rows.groupBy("bucket").applyInArrow(merge, f"{_BUCKET}, alone array<long>")


def _hot_tables(contexts: np.ndarray, tables: np.ndarray, hot: np.ndarray) -> dict:
    is_hot = np.isin(contexts, hot)
    return {"hot": contexts[is_hot], "hot_tables": tables[is_hot]}


def seat_buckets(state: DataFrame, replies: DataFrame, totals: Totals, sweep: int, parts: int) -> DataFrame:
    """A sweep over the pairs: every bucket seats its pairs given its contexts' tables (of hot contexts ``totals``' ones)
    and the words' customers, told by the parts; and tells the parts the tables of their words."""
    schema = _arrow(_BUCKET)

    def run(table):
        mine = table["part"].to_pylist().index(-1)
        row = _row(table, mine)
        n, m = row["n"], len(row["n"])
        rows = [{"bucket": table["bucket"][0].as_py(), "part": -1, **row}]
        if m:
            told = [_row(table, i) for i in range(table.num_rows) if i != mine]
            words = _hash(np.concatenate([t["w"] for t in told]))
            by = np.argsort(words)
            of = np.searchsorted(words[by], _hash(row["w"]))
            own, seated, spelled = (np.concatenate([t[c] for t in told])[by] for c in ("c", "seated", "spelled"))
            contexts, u = _hash(row["contexts"]), np.repeat(np.arange(len(row["contexts"])), row["more"])
            now = row["tables"][len(row["tables"]) - m:].astype(np.float64)
            all_ = row["once"] + np.bincount(u, now, len(contexts))
            everywhere = np.isin(contexts, totals.contexts)
            all_[everywhere] = totals.tables[np.searchsorted(totals.contexts, contexts[everywhere])]
            p = word_share(own, seated, spelled, totals)
            new = seat_pairs(pair_hash(_hash(row["w"]), contexts[u]), n, all_[u] - now, p[of], totals, sweep)
            rows[0]["tables"] = np.concatenate([row["tables"][m:], new.astype(np.int64)])
            rows[0] |= _hot_tables(contexts, row["once"] + np.bincount(u, new, len(contexts)), totals.contexts)
            tables = np.bincount(of, new, len(words))
            used = np.flatnonzero(tables)
            rows += [{"bucket": rows[0]["bucket"], "part": k, "w": words[by][used[at]], "c": tables[used[at]]} for k, at in _split(words[by][used], parts)]
        return _table(schema, rows)

    both = state.where("part = -1").select(*schema.names).unionByName(
        replies.where("bucket >= 0").select("bucket", "part", F.col("key").alias("w"), F.col("customers").alias("c"), F.col("tables").alias("seated"),
                                                "spelled"), allowMissingColumns=True)
    return both.groupBy("bucket").applyInArrow(run, _BUCKET)


def pack_parts(words: DataFrame, parts: int) -> DataFrame:
    """The words (key, c, base) of each part as arrays by key."""
    schema = _arrow(_PART)

    def run(table):
        key = np.asarray(table["key"].combine_chunks())
        by = np.argsort(_hash(key))
        return _table(schema, [{"part": table["part"][0].as_py(), "bucket": -1, "key": key[by], "n": np.asarray(table["c"].combine_chunks())[by],
                                "spelled": np.exp(np.asarray(table["base"].combine_chunks()))[by]}])

    return words.select(F.pmod("key", F.lit(parts)).cast("int").alias("part"), "key", "c", "base").groupBy("part").applyInArrow(run, _PART)


def seat_parts(state: DataFrame, sent: DataFrame, totals: Totals | None, sweep: int, kept: int) -> DataFrame:
    """A sweep over the words: their customers are the tables told by the buckets and of pairs seen once; they are seated
    given the others (at first at one table a word); and the buckets are told what they ask for. ``customers`` and
    ``tables`` of the kept sweeps follow one another."""
    schema = _arrow(_PART)

    def run(table):
        mine = table["bucket"].to_pylist().index(-1)
        row = _row(table, mine)
        told = [(b, _row(table, i)) for i, b in enumerate(table["bucket"].to_pylist()) if b >= 0]
        keys, spelled = _hash(row["key"]), row["spelled"]
        m = len(keys)
        at = [np.searchsorted(keys, _hash(t["key"])) for _, t in told]
        if totals is None:
            row["once"] = np.zeros(m)
            for j, (_, t) in zip(at, told, strict=True):
                row["once"][j] += t["seated"]
            row["customers"] = row["tables"] = np.zeros(kept * m)
        customers = row["once"].copy()
        for j, (_, t) in zip(at, told, strict=True):
            customers[j] += t["c"]
        if totals is None:
            tables = np.ones(m)
        else:
            tables = seat_words(keys, customers, row["tables"][len(row["tables"]) - m:], spelled, totals, sweep)
        row |= {"customers": np.concatenate([row["customers"][m:], customers]), "tables": np.concatenate([row["tables"][m:], tables])}
        rows = [{"part": table["part"][0].as_py(), "bucket": -1, **row, "all_customers": customers.sum(), "all_tables": tables.sum(),
                 "rare1": int((customers == 1).sum()), "rare2": int((customers == 2).sum())}]
        for j, (b, t) in zip(at, told, strict=True):
            j = j[t["c"] > 0]
            rows.append({"part": rows[0]["part"], "bucket": b, "key": keys[j], "spelled": spelled[j], "customers": customers[j], "tables": tables[j]})
        return _table(schema, rows)

    both = state.where("bucket = -1").select(*schema.names, F.lit(None).cast("binary").alias("seated")).unionByName(
        sent.where("part >= 0").select("part", "bucket", F.col("w").alias("key"), "c", F.col("seated")), allowMissingColumns=True)
    return both.groupBy("part").applyInArrow(run, _PART)


def _totals(words: DataFrame, pairs: DataFrame, discounts: tuple[float, float], strength: float) -> Totals:
    """What goes round by the driver: two sums, and the tables of the hot contexts."""
    customers, tables = words.where("bucket = -1").agg(F.sum("all_customers"), F.sum("all_tables")).first()
    hot = _flat_rows(pairs.where("part = -1").select("hot", "hot_tables"), lambda row: (row["hot"], row["hot_tables"]), "hot long, n long")
    hot = hot.groupBy("hot").agg(F.sum("n").alias("n")).toArrow()
    keys = _hash(hot["hot"].to_numpy())
    by = np.argsort(keys)
    return Totals(*discounts, strength, keys[by], np.zeros(len(keys)), hot["n"].to_numpy().astype(np.float64)[by], customers or 0.0, tables or 0.0)


def _flat_rows(df: DataFrame, make: Callable, columns: str) -> DataFrame:
    """Rows of numbers from rows of arrays: ``make`` gives the columns of one."""
    schema = _arrow(columns)
    bounded_batches(df)

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i in range(len(table)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(make(_row(table, i)), schema, strict=True)], names=schema.names)

    return df.mapInArrow(run, columns)


def finish(words: DataFrame, pairs: DataFrame, parts: int, kept: int) -> DataFrame:
    """Per part its words: key, spelled, and counts, customers and tables as words and tables as contexts (``told``:
    a row each; of all kept sweeps)."""
    columns = "part int, key array<long>, spelled array<double>, told binary"
    schema, sent = _arrow(columns), _arrow("part int, contexts array<long>, once binary")

    def send(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i in range(len(table)):
                row = _row(table, i)
                contexts, u = _hash(row["contexts"]), np.repeat(np.arange(len(row["contexts"])), row["more"])
                tables = np.stack([row["once"] + np.bincount(u, x, len(contexts)).astype(np.int64) for x in row["tables"].reshape(kept, -1)])
                yield from _table(sent, [{"part": p, "contexts": contexts[at], "once": tables[:, at].ravel()} for p, at in _split(contexts, parts)]).to_batches()

    def run(table):
        rows = [_row(table, i) for i in range(len(table))]
        mine = next(r for r in rows if "key" in r)
        keys = _hash(mine["key"])
        back = np.zeros((kept, len(keys)), np.int64)
        for r in rows:
            if "contexts" in r:
                back[:, np.searchsorted(keys, _hash(r["contexts"]))] += r["once"].reshape(kept, -1)
        told = np.concatenate([mine["n"], mine["customers"], mine["tables"], back.ravel()])
        return _table(schema, [{"part": table["part"][0].as_py(), "key": keys, "spelled": mine["spelled"], "told": told}])

    bounded_batches(pairs)
    contexts = pairs.where("part = -1").select("contexts", "once", "more", "tables").mapInArrow(send, "part int, contexts array<long>, once binary")
    both = words.where("bucket = -1").select("part", "key", "n", "spelled", "customers", "tables").unionByName(contexts, allowMissingColumns=True)
    return both.groupBy("part").applyInArrow(run, columns)


def _held_pairs(pairs: DataFrame, model: WordModel) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, shares) of all pairs."""
    kept = len(model.new_mass)
    keys, u, customers = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros((0, kept))]
    for row in (_row(table, i) for table in [pairs.toArrow()] for i in range(len(table))):
        contexts = _hash(row["contexts"])
        once, more = (np.repeat(contexts, row[c]) for c in ("once", "more"))
        keys += [_hash(row["alone"])] if "alone" in row else [pair_hash(_hash(row["w"]), more)]
        u.append(once if "alone" in row else more)
        customers.append(np.full((len(once), kept), 1 - model.discount) if "alone" in row
                         else np.maximum(row["n"] - model.discount * row["tables"].reshape(kept, -1), 0).T)
    keys, of = np.concatenate(keys), np.concatenate(u)
    by = np.argsort(keys)
    counts = looked_up(model.keys, of, model.counts.astype(np.float64)[:, None], 0.0)
    return keys[by], (np.concatenate(customers) / (counts + model.strength))[by]


def fit(docs: DataFrame, text: str = "text", order: int = 4, sweeps: int = 4, kept: int = 2, strength: float = 1.0,
        broadcast_words: int = 500_000, broadcast_pairs: int = 2_000_000, most_grams: int = 500_000) -> tuple[WordModel, Others]:
    """The model of all texts of ``docs``, and its words, pairs and n-grams beyond those that it holds."""
    spark = docs.sparkSession
    chunks = cut(read_pairs(docs, text))
    release(spark)
    vocabulary = cut(words_of(chunks).groupBy("word").agg(F.sum("c").alias("c")))
    histogram = {r["size"]: tuple(r)[1:] for r in vocabulary.groupBy(size_class("c").alias("size")).agg(F.count(F.lit(1)), F.sum("c"), F.min("c")).collect()}
    distinct, total = (sum(h[j] for h in histogram.values()) for j in (0, 1))
    buckets, parts = 1 + total // BUCKET_TOKENS, 1 + distinct // PART_WORDS
    hot = vocabulary.where(F.col("c") >= max(1, BUCKET_TOKENS // 8)).select(F.xxhash64("word").alias("key")).toArrow()["key"].to_numpy()
    hot = np.sort(_hash(hot))
    release(spark, SETTLE)
    merged, slices = None, min(SLICES, buckets)
    for at in range(slices):
        some = cut(count_pairs(chunks.select("keys", "pairs", "n"), hot, buckets, parts, kept, at, slices))
        merged = some if merged is None else merged.unionByName(some)
        release(spark, SETTLE)
    del chunks, some
    release(spark, SETTLE)
    ones, more = (v or 0 for v in merged.where("part = -1").agg(
        F.sum(F.size("alone")), F.sum(F.size("w"))).first())
    twos = _flat_rows(merged.where("part = -1").select("n"), lambda row: ([int((row["n"] == 2).sum())],), "n long").agg(F.sum("n")).first()[0] or 0
    chars, grams = fit_characters(vocabulary.where(F.col("word") != END).select("word"), order, most_grams, kept=kept, strength=strength)
    texts = vocabulary.where(F.col("word") == END).agg(F.sum("c")).first()[0] or 0
    release(spark)
    discount = discount_of(np.array([1, 2]), np.array([ones, twos], dtype=np.float64))
    end_share = texts / total if 0 < texts < total else 0.5
    none, no_words = np.zeros((0, kept)), np.zeros(0, np.uint64)
    model = WordModel(chars, total, distinct, strength, discount, end_share, np.ones(kept), no_words, np.zeros(0, np.int64), none, none,
                      no_words, none, True, hot, buckets, parts)
    shared = spark.sparkContext.broadcast(model)
    words = spell(vocabulary, shared, grams).select(F.xxhash64("word").alias("key"), "c", "base")
    pairs, words = merged, cut(seat_parts(pack_parts(words, parts), merged, None, -1, kept))
    del vocabulary
    shared.destroy()
    release(spark, SETTLE)
    rare = [v or 0 for v in words.where("bucket = -1").agg(F.sum("rare1"), F.sum("rare2")).first()]
    discounts = discount, discount_of(np.array([1, 2]), np.array(rare, dtype=np.float64))
    totals = [_totals(words, pairs, discounts, strength)]
    for sweep in range(sweeps):
        pairs = cut(seat_buckets(pairs, words, totals[-1], sweep, parts))
        words = cut(seat_parts(words, pairs, totals[-1], sweep, kept))
        totals.append(_totals(words, pairs, discounts, strength))
        release(spark, SETTLE)
    saved = totals[-kept:]
    model.new_mass = np.array([(strength + t.word_discount * t.word_tables) / (t.word_customers + strength) for t in saved])
    model.word_discount, model.word_customers = discounts[1], np.array([t.word_customers for t in saved])
    known = cut(finish(words, pairs, parts, kept))
    del words
    release(spark, SETTLE)
    least = least_class({k: h[0] for k, h in histogram.items()}, broadcast_words)
    fewest = min((h[2] for k, h in histogram.items() if k >= least), default=np.inf)
    names = [f"{c}{s}" for c in ("p", "back") for s in range(kept)]
    small = replace(model, chars=None)

    def frequent(row):
        n, p, back = small.of_words(row["told"], row["spelled"], kept)
        at = n >= fewest
        return (row["key"][at], n[at], *p[at].T, *back[at].T)

    top = _flat_rows(known.select("key", "spelled", "told"), frequent, ", ".join(["key long, c long", *(f"{c} double" for c in names)])).toArrow()
    keys = _hash(top["key"].to_numpy())
    by = np.argsort(keys)
    columns = np.stack([top[c].to_numpy() for c in names], axis=1)[by]
    model.keys, model.counts, model.words, model.back = keys[by], top["c"].to_numpy()[by], columns[:, :kept], columns[:, kept:]
    model.complete = len(keys) == distinct and ones + more <= broadcast_pairs
    often = pairs.where("part = -1").select("bucket", "w", "n", "tables", "contexts", "once", "more")
    if model.complete:
        model.pair_keys, model.pairs = _held_pairs(merged.where("part = -1").select("alone", "contexts", "once", "more").unionByName(
            often.drop("bucket"), allowMissingColumns=True), model)
    told = _arrow("bucket int, alone binary, often binary, told binary")

    def sort(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i, b in enumerate(table["bucket"].to_pylist()):
                row = _row(table, i)
                if "alone" in row:
                    out = {"alone": _steps(np.sort(_hash(row["alone"])))}
                else:
                    keys = pair_hash(_hash(row["w"]), np.repeat(_hash(row["contexts"]), row["more"]))
                    by = np.argsort(keys)
                    out = {"often": _steps(keys[by]), "told": np.stack([row["n"], *row["tables"].reshape(kept, -1)])[:, by].ravel()}
                yield from _table(told, [{"bucket": b, **out}]).to_batches()

    both = merged.where("part = -1").select("bucket", "alone").unionByName(
        often.select("bucket", "w", "n", "tables", "contexts", "more"), allowMissingColumns=True)
    seen = cut(both.mapInArrow(sort, "bucket int, alone binary, often binary, told binary"))
    del merged, pairs, often, both
    release(spark, SETTLE)
    return model, Others(known, seen, grams)


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted hashes as their differences, which take fewer bytes."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.int64)


def _sorted(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.view(np.uint64), dtype=np.uint64)


_SUMS = [("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")]


def score(docs: DataFrame, model: WordModel, others: Others, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``' ``keep`` columns plus n_tokens, n_known, train_tokens, base_score (add-half
    unigram) and score, log10 probabilities of the whole text and its end."""
    shared, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    keep = [c for c in (docs.columns if keep is None else keep) if c not in {n for n, _ in _SUMS} | {"train_tokens"}]

    def make():
        model = shared.value
        cache = worker_state("hpylm", token, lambda: WordCache(model.rows, 80_000))

        def run(texts):
            words, tokens, offsets = tokens_of(texts)
            known = cache.ensure(words)
            values = np.frombuffer(b"".join([known[w] for w in words]), dtype=model.row)
            before, word, _, at = pairs_of(tokens, len(words))
            share = looked_up(model.pair_keys, pair_hash(values["hash"][word], values["hash"][before]), model.pairs, 0.0)
            sums = model.sums(tokens, offsets, at, values, share + values["back"][before] * values["p"][word])
            return np.diff(offsets), sums[:, 0].astype(np.int64), sums[:, 1], sums[:, 2]

        return run

    if model.complete and model.chars.complete:
        scored = with_arrow(docs, make, _SUMS, [text_of(text)], keep=keep)
    else:
        scored = _score_by_join(docs, shared, others, text, keep)
    return scored.select(*[F.col(f"`{c}`") for c in keep], "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def _score_by_join(docs: DataFrame, shared, others: Others, text: str, keep: list[str]) -> DataFrame:
    """Each batch of texts asks for the words that are not held, and for its pairs."""
    model, kept = shared.value, len(shared.value.new_mass)
    spark = docs.sparkSession
    chunks = cut(read_chunks(docs, text, keep, shared))
    schema = T.StructType([T.StructField("doc", chunks.schema["docs"].dataType.elementType),
                           *[T.StructField(c, T._parse_datatype_string(t)) for c, t in _SUMS]])

    def run(batches):
        model = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                keys, tokens, offsets = _chunk(batch, i)
                values, _ = model.found(keys)
                asked, names = unpacked(batch.column("places")[i].as_py()), of_lines(batch.column("names")[i].as_py())
                unseen = np.ones(len(asked), bool)
                told = _by_number(batch.column("told")[i], "part")
                for part, at in _split(keys[asked], model.parts):
                    row = told[part]
                    seen = np.flatnonzero(row["seen"])
                    n, p, back = model.of_words(row["told"], row["spelled"], kept)
                    place = asked[at[seen]]
                    values["n"][place], values["p"][place], values["back"][place] = n, p, back
                    unseen[at[seen]] = False
                logs = np.array(model.spelled([names[j] for j in np.flatnonzero(unseen)]))
                for r in batch.column("far")[i].as_py() or []:
                    logs[np.searchsorted(asked[unseen], r["place"])] = r["base"]
                values["p"][asked[unseen]] = np.exp(logs)[:, None] * model.new_mass
                before, word, _, of = pairs_of(tokens, len(keys))
                _, by, cuts = _asked(before, word, keys, model)
                share = np.zeros((len(by), kept))
                for b, row in _by_number(batch.column("pairs")[i], "bucket").items():
                    at = by[cuts[b]:cuts[b + 1]]
                    n, *tables = row["told"].reshape(1 + kept, -1)
                    share[at] = np.maximum(n - model.discount * np.stack(tables), 0).T
                share /= (values["n"][before] + model.strength)[:, None]
                sums = model.sums(tokens, offsets, of, values, share + values["back"][before] * values["p"][word])
                yield pa.RecordBatch.from_arrays([batch.column("docs")[i].values, pa.array(np.diff(offsets)), pa.array(sums[:, 0].astype(np.int64)),
                                                  pa.array(sums[:, 1]), pa.array(sums[:, 2])], names=schema.names)

    # A chunk's number is its task's times 2 ** 33 plus its place there: both deal it to its slice.
    slices, scored = max(1, min(SLICES, chunks.count() // 4)), None
    for at in range(slices):
        mine = chunks.where(F.pmod(F.shiftright("chunk", 33) + F.col("chunk"), F.lit(slices)) == at)
        words = cut(_told_words(mine, others.words, model))
        release(spark, SETTLE)
        pairs = cut(_told_pairs(mine, others, model))
        release(spark, SETTLE)
        all_ = (mine.select("chunk", "docs", "ends", "tokens", "keys", "places", F.col("words").alias("names"))
                .join(words, "chunk", "left").join(pairs, "chunk", "left"))
        far = _spelled_far(mine, words, shared, others)
        all_ = all_.withColumn("far", F.lit(None).cast("array<struct<place: long, base: double>>")) if far is None else all_.join(far, "chunk", "left")
        some = all_.mapInArrow(run, schema).select(*[F.col(f"doc.k{i}").alias(c) for i, c in enumerate(keep)], *[c for c, _ in _SUMS])
        if slices > 1:
            some = cut(some)
            del words, pairs, all_, far
            release(spark, SETTLE)
        scored = some if scored is None else scored.union(some)
    return scored


def _told_words(chunks: DataFrame, words: DataFrame, model: WordModel) -> DataFrame:
    """(chunk, told): for each part which of the chunk's words that the workers do not hold were seen, and what is known
    of those."""
    kept, parts = len(model.new_mass), model.parts
    asked, answer = _arrow("part int, chunk long, asked array<long>"), _arrow("chunk long, part int, seen binary, spelled array<double>, told binary")
    columns = "chunk long, part int, seen binary, spelled array<double>, told binary"

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys = _hash(np.asarray(batch.column("keys")[i].values))[unpacked(batch.column("places")[i].as_py())]
                rows = [{"part": p, "chunk": batch.column("chunk")[i].as_py(), "asked": keys[at]} for p, at in _split(keys, parts)]
                yield from _table(asked, rows).to_batches()

    def tell(table):
        rows = [(c, _row(table, i)) for i, c in enumerate(table["chunk"].to_pylist())]
        keys, spelled, told = np.zeros(0, np.uint64), np.zeros(0), np.zeros((1 + 3 * kept, 0), np.int64)
        for c, r in rows:
            if c is None:
                keys, spelled, told = _hash(r["key"]), r["spelled"], r["told"].reshape(1 + 3 * kept, -1)
        out = []
        for c, r in rows:
            if c is not None:
                at = looked_up(keys, _hash(r["asked"]), np.arange(len(keys))[:, None], -1)[:, 0]
                seen = at[at >= 0]
                out.append({"chunk": c, "part": table["part"][0].as_py(), "seen": at >= 0, "spelled": spelled[seen], "told": told[:, seen].ravel()})
        return _table(answer, out)

    bounded_batches(chunks)
    rows = chunks.select("chunk", "keys", "places").mapInArrow(ask, "part int, chunk long, asked array<long>")
    both = rows.unionByName(words.select("part", "key", "spelled", "told"), allowMissingColumns=True)
    return both.groupBy("part").applyInArrow(tell, columns).groupBy("chunk").agg(F.collect_list(F.struct("part", "seen", "spelled", "told")).alias("told"))


def _spelled_far(chunks: DataFrame, words: DataFrame, shared, others: Others) -> DataFrame | None:
    """(chunk, far): places of new words that take n-grams which the workers do not hold, and what they are spelled with."""
    model = shared.value
    if model.chars.complete:
        return None
    columns, parts = "chunk long, place long, word string", model.parts

    def new(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asked = unpacked(batch.column("places")[i].as_py())
                seen = np.zeros(len(asked), bool)
                told = _by_number(batch.column("told")[i], "part")
                for part, at in _split(_hash(np.asarray(batch.column("keys")[i].values))[asked], parts):
                    seen[at] = told[part]["seen"] > 0
                names = pa.array(of_lines(batch.column("words")[i].as_py()), pa.string()).take(pa.array(np.flatnonzero(~seen)))
                far = np.flatnonzero(np.isnan(shared.value.spelled(names.to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(far), batch.column("chunk")[i].as_py())), pa.array(asked[~seen][far].astype(np.int64)),
                                                  names.take(pa.array(far))], names=["chunk", "place", "word"])

    asked = cut(chunks.select("chunk", "keys", "places", "words").join(words, "chunk", "left").mapInArrow(new, columns))
    known = spell(asked.select("word").distinct(), shared, others.grams)
    return asked.join(known, "word").groupBy("chunk").agg(F.collect_list(F.struct("place", "base")).alias("far"))


def _asked(before: np.ndarray, word: np.ndarray, keys: np.ndarray, model: WordModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of pairs, their order by bucket and hash, the buckets' first places in that and the end)."""
    pairs, bucket = dealt(before, word, keys, model.hot, model.buckets)
    by = np.argsort(pairs)
    by = by[np.argsort(bucket[by], kind="stable")]
    return pairs, by, np.searchsorted(bucket[by], np.arange(model.buckets + 1))


def _told_pairs(chunks: DataFrame, others: Others, model: WordModel) -> DataFrame:
    """(chunk, pairs): for each bucket the counts and tables of the chunk's pairs, in the order of :func:`_asked`."""
    kept, buckets = len(model.new_mass), model.buckets
    dealing = WordModel(**{**{f: None for f in model.__dataclass_fields__}, "hot": model.hot, "buckets": buckets})
    answer, asked = _arrow("chunk long, bucket int, told binary"), _arrow("bucket int, chunk long, key binary")

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, tokens, _ = _chunk(batch, i)
                before, word, _, _ = pairs_of(tokens, len(keys), places=False)
                pairs, by, cuts = _asked(before, word, keys, dealing)
                some = np.flatnonzero(np.diff(cuts))
                keys, chunk = pairs[by], batch.column("chunk")[i].as_py()
                yield from _table(asked, [{"bucket": b, "chunk": chunk, "key": _steps(keys[cuts[b]:cuts[b + 1]])} for b in some.tolist()]).to_batches()

    def tell(table):
        rows = [(c, _row(table, i)) for i, c in enumerate(table["chunk"].to_pylist())]
        alone, again, known = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, 1 + kept), np.int64)
        for c, r in rows:
            if c is None and "alone" in r:
                alone = _sorted(r["alone"])
            elif c is None:
                again, known = _sorted(r["often"]), r["told"].reshape(1 + kept, -1).T
        found, told = [], []
        for c, r in rows:
            if c is not None:
                keys = _sorted(r["key"])
                out = looked_up(again, keys, known, 0)
                out[looked_up(alone, keys, np.ones((len(alone), 1), bool), False)[:, 0]] = 1
                found.append(c)
                told.append(packed(out.T.ravel()))
        b = table["bucket"][0].as_py()
        return pa.Table.from_arrays([pa.array(found, pa.int64()), pa.array([b] * len(found), pa.int32()), pa.array(told, pa.binary())], names=answer.names)

    bounded_batches(chunks)
    rows = chunks.select("chunk", "ends", "tokens", "keys").mapInArrow(ask, "bucket int, chunk long, key binary")
    both = rows.unionByName(others.pairs, allowMissingColumns=True)
    told = both.groupBy("bucket").applyInArrow(tell, "chunk long, bucket int, told binary")
    return told.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "told")).alias("pairs"))
