"""Quality rules as a bitmask ledger, in DataFrame expressions only.

:func:`ledger` measures every text once and evaluates every rule once: a document's row holds
the measurements and ``fail_bits``, bit i set when rule i fails. A policy is a named, versioned
set of rules, applied to the stored bits; :func:`ablation` counts, from the bits alone, what
each rule of a policy removes and what it alone removes.

Words are runs of characters other than space, tab and line ends (0x09-0x0D). Null and empty
texts have no words and fail the first rule. Repeated rows are separate documents. Very long
texts are measured whole: windows of five words are compared by 64-bit hashes, sorted per text.
An empty table gives no rows (an ablation: no counts). A kept column with an output's name gives way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Rules in bit order: true when a text fails. Shares are compared as whole numbers.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 10,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
    "many_symbols": lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words"),
    "many_dup_lines": lambda: 2 * F.col("n_dup_lines") > F.col("n_lines"),
    "long_words": lambda: F.col("word_chars") > 15 * F.col("n_words"),
    "short_words": lambda: F.col("word_chars") < 2 * F.col("n_words"),
    "upper_case": lambda: 10 * F.col("n_upper") > 4 * F.col("word_chars"),
    "many_bangs": lambda: 2 * F.col("n_bangs") > F.col("n_words"),
}

# Policies by version: the rules that a document must pass.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "many_symbols", "many_dup_lines"),
    "web-2": ("few_words", "repeated_words", "many_symbols", "many_dup_lines", "long_words", "short_words",
              "upper_case", "many_bangs"),
}
BASE, CURRENT = "base-1", "web-2"
MEASURES = frozenset(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs",
                      "fail_bits", "_text", "_words", "_gaps", "_chars", "_lines"))


def bits_of(rules: tuple[str, ...]) -> int:
    order = list(RULES)
    return sum(1 << order.index(r) for r in set(rules))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a window of five words which the text holds twice or more."""

    def covered(hashes: Column) -> Column:
        # (hash, place) sorted: a window is repeated when a neighbour has the same hash.
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            repeated = F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1))
            return let(F.sort_array(F.transform(repeated, lambda e: e["i"])), lambda p: F.aggregate(
                F.transform(p, lambda at, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - at, F.lit(WINDOW)))),
                F.lit(0), lambda total, n: total + n))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, of_sorted))

    def windows(h: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(
            *[F.get(h, i + k) for k in range(WINDOW)])), covered)

    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), windows))


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``' ``keep`` columns (all when None) plus the measurements and ``fail_bits``; a kept
    column with the name of one of those, or of a helper (``_text``...), gives way."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in MEASURES]
    t = F.col("_text")
    measured = docs.select(*[F.col(f"`{c}`") for c in keep], text_of(text).alias("_text")).select(
        *[F.col(f"`{c}`") for c in keep],
        let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"))).alias("_words"),
        (F.length(t) - F.length(F.translate(t, " \t\n\x0b\x0c\r", ""))).alias("_gaps"),
        F.length(t).alias("_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long").alias("n_bangs"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        let(F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0),
            lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))
            ).alias("_lines"),
    ).select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("_words.n").cast("long").alias("n_words"), (F.col("_chars") - F.col("_gaps")).cast("long").alias("word_chars"),
        "n_symbols", F.col("_lines.d").cast("long").alias("n_dup_lines"),
        F.col("_words.r").cast("long").alias("n_repeat_words"), F.col("_lines.n").cast("long").alias("n_lines"),
        "n_upper", "n_bangs")
    bits = [F.when(rule(), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("fail_bits", total.cast("long"))


def fails(policy: str, bits: Column | None = None) -> Column:
    """True when the stored bits break the policy of this version."""
    return (F.col("fail_bits") if bits is None else bits).bitwiseAND(F.lit(bits_of(POLICIES[policy]))) != 0


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that fail no other rule of it
    (so many more would stay without it). One pass over the bits, grouped by their value."""
    rules = POLICIES[policy]
    own = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(bits_of(rules))).alias("bits")).count()
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bits_of((r,))).cast("long").alias("bit"))
                               for r in rules])).alias("r")
    each = own.select("bits", "count", rule)
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_only"))
