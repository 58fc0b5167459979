"""Best-fit packing of tokenised documents into fixed-length sequences (minimum bin slack).

A document's ids are cut into pieces of at most ``capacity`` ids. Only the histogram of piece
lengths (at most ``capacity`` rows, at any input size) decides the packing: each bin is seeded
with the longest remaining length, and a bitset subset-sum over the remaining lengths finds the
combination that leaves the least slack. The same combination is applied as often as the counts
allow, so the number of searches depends on the lengths, not on the number of documents. Spark
then ranks the pieces of each length and looks each rank up in the resulting ranges.

Null and empty texts give the separator alone (length 1). Repeated rows are separate documents.
An empty table gives an empty result. Ties between equal lengths go by the pieces' place. Very long texts are
cut into as many pieces as they need; other columns than the two used are left out, whatever their names.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keys import helper_name
from .common import WordCache, cut, joined_bytes, text_of, with_arrow, word_index, worker_state

ROWS_PER_RANKING = 2000  # pieces of one length ranked in one group, about


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 as
    itself, the others in order from U+0100 on."""
    own = [chr(b).isprintable() and not chr(b).isspace() for b in range(256)]
    return [chr(b) if own[b] else chr(256 + own[:b].count(False)) for b in range(256)]


def tokenizer_cache(path: str, cap: int = 300_000) -> WordCache:
    """Ids (little-endian uint32 bytes) per run of characters between ASCII white space.

    The vocabulary drops white space and case, so no token spans white space, and the ids of a
    text are those of its runs in order. A run of letters, with one punctuation mark after it or
    none, is the ids of the letters in lower case and of the mark; those are kept too. Strings of
    special tokens in a text are ordinary text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    tokenize, shown = model.model.tokenize, byte_characters()

    def encode(words: list[str]) -> list[bytes]:
        out = []
        for w in words:
            if w.isalpha() and "\u03a3" not in w:  # one pre-token, lower-cased already
                if not w.isascii():
                    w = "".join([shown[b] for b in unicodedata.normalize("NFC", w).encode("utf-8", "surrogatepass")])
                ids = [t.id for t in tokenize(w)]
            else:
                ids = model.encode(w, add_special_tokens=False).ids
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    pieces = WordCache(encode, cap)
    after = frozenset(".,;:!?")

    def runs(words: list[str]) -> list[bytes]:
        split = []
        for w in words:
            # Sigma is lower-cased by its place in Python; such words go whole.
            if w.isalpha() and "\u03a3" not in w:
                split.append((w.lower(),))
            elif w[-1:] in after and w[:-1].isalpha() and "\u03a3" not in w:
                split.append((w[:-1].lower(), w[-1]))
            else:
                split.append((w,))
        known = pieces.ensure(p for s in split for p in s)
        return [known[s[0]] if len(s) == 1 else known[s[0]] + known[s[1]] for s in split]

    return WordCache(runs, cap)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, doc_id: str = "doc_id",
                     text: str = "text", separator_id: int = 0, cached_words: int = 300_000) -> DataFrame:
    """One row per piece: the id, piece (from 0), start, length and ids_crc32."""
    end = int(separator_id).to_bytes(4, "little")

    def make():
        cache = worker_state("packing", (tokenizer_path, cached_words), lambda: tokenizer_cache(tokenizer_path, cached_words))

        def run(texts):
            row, piece, start, length, crc = [], [], [], [], []
            words, index, offsets = word_index(texts)
            known = cache.ensure(words)
            for i, own in enumerate(joined_bytes([known[w] for w in words], index, offsets)):
                ids = bytes(own) + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            return row, piece, start, length, crc

        return run

    return with_arrow(docs, make, [("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")],
                      [text_of(text)], keep=[doc_id], flat=True)


def fullest(items: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The (length, times) whose total is the largest that is at most ``room``.

    ``items``: (length, count), longest first. Bit s of ``reach`` is set when s is a possible
    total; a count is taken in powers of two. Longer lengths are tried first and the search
    ends when the room is filled exactly."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length, count in items:
        left = min(count, room // length) if length <= room else 0
        if not left:
            continue
        steps.append((length, left, reach))
        size = 1
        while left > 0:
            take = min(size, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, most, before in reversed(steps):
        times = next(k for k in range(most + 1) if total >= k * length and before >> (total - k * length) & 1)
        if times:
            chosen.append((length, times))
            total -= times * length
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """The packing as ranges of ranks: for a length, ranks [first, first + times * bins) lie in
    sequences from ``sequence``, ``times`` in each, from place ``offset`` on."""
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left, reverse=True)
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while lengths:
        seed = lengths[0]
        left[seed] -= 1
        room = capacity - seed
        chosen = fullest([(n, left[n]) for n in lengths if n <= room], room) if room else []
        left[seed] += 1
        combo = dict(chosen)
        combo[seed] = combo.get(seed, 0) + 1
        bins = min(left[n] // k for n, k in combo.items())
        order = sorted(combo, reverse=True)
        for n, offset in zip(order, accumulate([0, *[n * combo[n] for n in order[:-1]]]), strict=True):
            rows.append((n, used[n], combo[n], sequence, offset))
            used[n] += combo[n] * bins
            left[n] -= combo[n] * bins
        sequence += bins
        lengths = [n for n in lengths if left[n]]
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "times", "sequence", "offset"), columns, strict=True))


def place(plan: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks (rank from 0)."""
    high = int(max(plan["first"].max(initial=0), rank.max(initial=0))) + 1
    at = np.searchsorted(plan["length"] * high + plan["first"], length * high + rank, "right") - 1
    within, slot = np.divmod(rank - plan["first"][at], plan["times"][at])
    return plan["sequence"][at] + within, plan["offset"][at] + slot * length


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32"),
         length: str = "length") -> DataFrame:
    """``pieces`` (rows with a ``length`` of 1 to ``capacity``) plus sequence_id and offset.

    ``pieces`` is read three times (histogram, offsets of the ranks, result): pass a table or a
    checkpoint. The driver holds the histogram and the plan, whose sizes the capacity bounds."""
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    shared = pieces.sparkSession.sparkContext.broadcast(plan_bins(histogram, capacity))
    # Each length is dealt into as many groups as its count asks for.
    salts = F.get(F.lit([1 + histogram.get(n, 0) // ROWS_PER_RANKING for n in range(capacity + 1)]), F.col(length).cast("int"))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), salts).cast("int"))
    group = [length, "_salt"]
    before = Window.partitionBy(length).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (salted.groupBy(*group).count()
               .select(*group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")))
    ranked = (salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
              .join(offsets, group))

    def make():
        def run(lengths, ranks):
            return place(shared.value, lengths.to_numpy(), ranks.to_numpy())

        return run

    return with_arrow(ranked, make, [("sequence_id", "long"), ("offset", "long")],
                      [F.col(length).cast("long"), F.col("_rank") + F.col("_before")], keep=pieces.columns)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, doc_id: str = "doc_id",
                   text: str = "text", separator_id: int = 0, cached_words: int = 300_000) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and its place there. A worker keeps the
    ids of about four times ``cached_words`` words, some 200 bytes each; results do not depend on it.

    The pieces (six numbers each) are checkpointed, so the texts are tokenised once. They are ranked by their
    place in that table, which tells repeated rows apart, too."""
    place_ = helper_name("place")
    pieces = tokenized_pieces(docs, tokenizer_path, capacity, doc_id, text, separator_id, cached_words)
    return pack(cut(pieces.withColumn(place_, F.monotonically_increasing_id())), capacity, (place_,)).drop(place_)
