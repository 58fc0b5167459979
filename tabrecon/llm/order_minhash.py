"""Order MinHash fingerprints of texts, in DataFrame expressions only.

The k-mers (``k`` neighbouring words, numbered by occurrence in the text) are hashed once. The
hash deals them out to ``2 ** bin_bits`` bins (one-permutation sketching); of each bin the
``tuple_size`` least are selected, put back into text order and hashed as a tuple; a bin with fewer
borrows from the bins after it, so that order counts in short texts too. Two texts
agree in a bin only when the same k-mers are least there and stand in the same order, so the
share of agreeing bins follows edit distance, not only the sets of k-mers.

Words are runs of characters other than space, tab and line ends. A text with fewer words than
``k`` is one k-mer; a text without words (null, empty) has an empty fingerprint, which is like
another empty one (1) and unlike any other (0). Equal texts have equal fingerprints. Rows of one id follow each
other by text, null ids come first; repeated rows stay. A single row is its own next one, an empty table gives
no rows. Other columns than the two used are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, text_of
from .quality import words_of

PLACE_BITS = 24  # a text may have 16.7 million words; places beyond share a bit pattern
_PLACE = (1 << PLACE_BITS) - 1
LEAST = -(1 << 63)


def signature(text: Column, k: int = 2, bin_bits: int = 5, tuple_size: int = 2) -> Column:
    """The selected tuples' hashes (array of long, one per filled bin, the bin in the top bits)."""
    place = lambda x: x.bitwiseAND(F.lit(_PLACE))
    packed = lambda h, i: h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place(i.cast("long")))
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - bin_bits)

    def run_starts(s: Column, key) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                        lambda j: (j == 0) | (key(F.get(s, j)) != key(F.get(s, j - 1))))

    def numbered(s: Column) -> Column:
        # ``s``: k-mer hashes with places, sorted, so that occurrences of a k-mer are a run.
        return let(run_starts(s, lambda x: F.shiftright(x, PLACE_BITS)), lambda starts: F.flatten(F.transform(
            starts, lambda a, r: F.transform(
                F.sequence(a, F.coalesce(F.get(starts, r + 1), F.size(s)) - 1),
                lambda j: packed(F.xxhash64(F.shiftright(F.get(s, j), PLACE_BITS), j - a), place(F.get(s, j)))))))

    def tuples(t: Column) -> Column:
        # ``t``: numbered k-mers with places, sorted, so that a bin is a run and starts with its least. A bin
        # with too few borrows the least of the bins after it, round to the first.
        ring = F.concat(t, F.slice(t, 1, F.least(F.lit(tuple_size), F.size(t)) - 1))

        def one(a: Column) -> Column:
            least = F.slice(ring, a + 1, F.least(F.lit(tuple_size), F.size(t)))
            in_order = F.sort_array(F.transform(least, lambda x: F.shiftleft(place(x), 64 - PLACE_BITS - 1).bitwiseOR(
                F.shiftrightunsigned(x, PLACE_BITS + 1))))
            mixed = F.aggregate(in_order, F.lit(0).cast("long"), lambda acc, x: F.xxhash64(
                acc, x.bitwiseAND(F.lit((1 << (63 - PLACE_BITS)) - 1))))
            head = F.lit(~((1 << (64 - bin_bits)) - 1))
            return F.get(t, a).bitwiseAND(head).bitwiseOR(F.shiftrightunsigned(mixed, bin_bits))

        return let(run_starts(t, bin_of), lambda starts: F.transform(starts, one))

    def kmers(h: Column) -> Column:
        several = F.transform(F.sequence(F.lit(0), F.size(h) - k),
                              lambda i: packed(F.xxhash64(*[F.get(h, i + j) for j in range(k)]), i))
        one = F.array(packed(F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: F.xxhash64(acc, x)), F.lit(0)))
        return F.sort_array(F.when(F.size(h) >= k, several).otherwise(one))

    nothing = F.array().cast("array<bigint>")
    return let(words_of(text), lambda w: F.when(F.size(w) == 0, nothing).otherwise(
        let(F.transform(w, lambda x: F.xxhash64(x)),
            lambda h: let(kmers(h), lambda s: let(F.sort_array(numbered(s)), tuples)))))


def fingerprint(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column, bin_bits: int = 5) -> Column:
    """Share of the bins filled in either signature in which both agree (0 to 1)."""

    def of(p: Column) -> Column:
        bins = F.transform(F.concat(p["a"], p["b"]), lambda x: F.shiftrightunsigned(x, 64 - bin_bits))
        filled = F.size(F.array_distinct(bins))
        return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(p["a"], p["b"])) / filled)

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def next_in_order(docs: DataFrame, key: str, ties: list[str], carry: list[str], rows_per_bucket: int = 4000,
                  most_buckets: int = 4096) -> DataFrame:
    """``docs`` plus ``_next``, a struct of the ``carry`` columns of the next row by ``key`` (a
    long, nulls first; ties by ``ties``); the last row's next is the first.

    Rows are dealt into key ranges whose bounds are keys (quantiles, a bounded list); the rows
    at a bound also go to the range before, so one shuffle brings each row and its next together."""
    k = F.coalesce(F.col(key), F.lit(LEAST))
    n, least = docs.agg(F.count(F.lit(1)), F.min(k)).first()
    buckets = min(most_buckets, 1 + n // rows_per_bucket)
    bounds: list[int] = []
    if buckets > 1:
        found = docs.agg(F.percentile_approx(k, [i / buckets for i in range(1, buckets)], max(10_000, 10 * buckets))).first()[0]
        bounds = sorted({x for x in found if x > least})
    if bounds:
        marks = F.lit(bounds).cast("array<bigint>")
        bucket = F.size(F.filter(marks, lambda x: x <= F.col("_key")))
        at_bound = F.array_contains(marks, F.col("_key"))
    else:
        bucket, at_bound = F.lit(0), F.lit(False)
    own = F.struct(bucket.alias("bucket"), F.lit(0).alias("guest"))
    before = F.struct((bucket - 1).alias("bucket"), F.lit(1).alias("guest"))
    wrap = F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(2).alias("guest"))
    first = F.col("_key") == F.lit(LEAST if least is None else least).cast("bigint")
    homes = F.when(first, F.array(own, wrap)).when(at_bound, F.array(own, before)).otherwise(F.array(own))
    dealt = docs.withColumn("_key", k).withColumn("_home", F.explode(homes))
    order = Window.partitionBy("_home.bucket").orderBy("_home.guest", "_key", *ties)
    return (dealt.withColumn("_next", F.lead(F.struct(*carry)).over(order))
            .where(F.col("_home.guest") == 0).drop("_key", "_home"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 2, bin_bits: int = 5,
                 tuple_size: int = 2) -> DataFrame:
    """The id and the fingerprint of every whole text."""
    return docs.select(F.col(f"`{doc_id}`"), fingerprint(signature(text_of(text), k, bin_bits, tuple_size)).alias("fingerprint"))


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 2, bin_bits: int = 5,
                    tuple_size: int = 2) -> DataFrame:
    """Per document: its fingerprint, that of its text with the last quarter replaced by the start
    of the next document's, and the likeness to that and to the next document's fingerprint."""
    sig = lambda c: signature(F.col(c), k, bin_bits, tuple_size)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = next_in_order(rows.withColumn("sig", sig("text")), "doc_id", ["text"], ["text", "sig"])
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", 1, F.length("text") - quarter), F.substring(F.col("_next.text"), 1, quarter))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "sig", F.col("_next.sig").alias("next_sig"),
                       edited.alias("edited"))
    rows = rows.withColumn("edited_sig", sig("edited"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
                       fingerprint(F.col("sig")).alias("fingerprint"),
                       fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
                       likeness(F.col("sig"), F.col("edited_sig"), bin_bits).alias("near_edited"),
                       likeness(F.col("sig"), F.col("next_sig"), bin_bits).alias("near_next"))
