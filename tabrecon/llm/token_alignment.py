"""Alignment of two tokenizers' tokens over the same bytes (diagonal run skipping).

Tokenizer A is a byte-level BPE (``tokenizers`` file), which reads a space and the text; B a
sentencepiece model, which adds that space itself. The byte offsets at which tokens of both end cut a
text into groups. :func:`group_ends` compares the two arrays of token ends at the current shift of
their indices, in stretches that double while every pair of ends is equal and halve where not, so
one-to-one stretches are jumped over; only where ends differ are the arrays walked token by token to
the next common end, which gives the new shift. Tokens whose byte ranges overlap are linked.

1. One pass over the texts (:func:`_pieces`): texts are cut into units at places that no token of
   either tokenizer spans, so groups do not either; a unit's groups and links are found once and
   kept. Each piece of a batch (about ``PIECE_BYTES`` of text) becomes one row: its documents'
   figures, the units of each, and how often each pair of ids is linked.
2. The counts of id pairs are summed over all pieces, with the highest count per id of B, and joined
   back to the pairs of every piece.
3. A document's sums over its links are sums over its units, taken in the piece.

Nothing is broadcast or collected; a pair that every document has costs a row per piece. Null and empty
texts, and those whose tokens of A or B do not spell a space and the text, have no tokens: zeros and
an empty digest. A text of any length is aligned whole. Repeated rows and ids give repeated rows, and
their links count each time; null ids are kept. Columns other than the two used are ignored, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import struct
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _NOT_PLAIN, units_of
from .common import WordCache, bounded_batches, cut, joined_bytes, sums_by_text, text_of, word_index, worker_state

PIECE_BYTES = 8 << 20
_PAIR_BITS = 24     # an id pair is id of A << 24 | id of B


def group_ends(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """Where both arrays of ascending token ends hold the same offset: (tokens of A so far, tokens of B
    so far) after each group. The last ends must be equal."""
    out, i, shift, n = [], 0, 0, len(ends_a)
    if ends_a == ends_b:  # one-to-one to the end
        return [(k, k) for k in range(1, n + 1)]
    while i < n:
        # One-to-one at this shift: probe in doubling stretches, then narrow down in the failed one.
        step = 1
        while step:
            run = min(step, n - i)
            if run and ends_a[i:i + run] == ends_b[i + shift:i + shift + run]:
                out.extend([(k, k + shift) for k in range(i + 1, i + run + 1)])
                i += run
                step *= 2
                if i == n:
                    return out
            else:
                break
        while step > 1:
            step //= 2
            if ends_a[i:i + step] == ends_b[i + shift:i + shift + step] and i + step <= n:
                out.extend([(k, k + shift) for k in range(i + 1, i + step + 1)])
                i += step
        # Irregular: go on to the next common end.
        j = i + shift
        a, b = ends_a[i], ends_b[j]
        while a != b:
            if a < b:
                i += 1
                a = ends_a[i]
            else:
                j += 1
                b = ends_b[j]
        i, j = i + 1, j + 1
        out.append((i, j))
        shift = j - i
    return out


def overlaps(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """(token of A, token of B) for all pairs whose byte ranges overlap, for ends from 0 to a common end."""
    out, i, j = [], 0, 0
    while i < len(ends_a):
        out.append((i, j))
        a, b = ends_a[i], ends_b[j]
        i += a <= b
        j += b <= a
    return out


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the
    others in order from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _little(numbers: list[int]) -> bytes:
    """The numbers as little-endian 64-bit ones."""
    return struct.pack(f"<{len(numbers)}q", *numbers)


class Aligner:
    """Groups and links of texts under two tokenizers; what frequent units give is kept."""

    def __init__(self, path_a: str, path_b: str, cap: int = 120_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        own = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = {i: p.encode() if p in own else bytes(letters[c] for c in p) for p, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        # Units are independent if no piece goes on over a space or a line feed.
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.feed = self.b.encode("\n")
        self.units = WordCache(self._units, cap)

    def tokens(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B. A unit with a space in front is as after a space or at a text's start; any
        other follows a line feed."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        spaced = [u.startswith(" ") for u in units]
        ids_b = self.b.encode([u[1:] if s else "\n" + u for u, s in zip(units, spaced, strict=True)], num_threads=1)
        skip = len(self.feed)
        return ids_a, [ids if s else ids[skip:] for ids, s in zip(ids_b, spaced, strict=True)]

    def _units(self, units: list[str]):
        """(spelled right, n_a, n_b, n_groups, n_links, groups as text with ; after each, id pairs) of each."""
        ids_a, ids_b = self.tokens(units)
        for text, a, b in zip(units, ids_a, ids_b, strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            parts_a, parts_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
            if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
                yield False, 0, 0, 0, 0, b"", b""
                continue
            ends_a, ends_b = list(accumulate(map(len, parts_a))), list(accumulate(map(len, parts_b)))
            ends = group_ends(ends_a, ends_b)
            if len(ends) == len(a) == len(b):
                said = "".join([f"{x}|{y};" for x, y in zip(a, b, strict=True)])
                yield True, len(a), len(b), len(a), len(a), said.encode(), _little([x << _PAIR_BITS | y for x, y in zip(a, b, strict=True)])
                continue
            said, pairs, i, j = [], [], 0, 0
            for k, m in ends:
                if k - i == 1 and m - j == 1:
                    x, y = a[i], b[j]
                    said.append(f"{x}|{y};")
                    pairs.append(x << _PAIR_BITS | y)
                else:
                    said.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])) + ";")
                    pairs += [a[i + x] << _PAIR_BITS | b[j + y] for x, y in overlaps(ends_a[i:k], ends_b[j:m])]
                i, j = k, m
            yield True, len(a), len(b), len(ends), len(pairs), "".join(said).encode(), _little(pairs)

    def piece(self, texts: pa.Array) -> dict:
        """Figures of each text, its units, and the linked id pairs of each unit."""
        filled = pc.greater(pc.binary_length(texts), 0)
        spaced = pc.if_else(filled, pc.binary_join_element_wise("", texts, " "), "")
        plain = pc.invert(pc.match_substring_regex(texts, _NOT_PLAIN)) if self.cuts else pa.repeat(False, len(texts))
        units, index, offsets = word_index(pc.if_else(plain, spaced, ""), units_of)
        known = self.units.ensure(units)
        values = [known[u] for u in units]
        wrong = ~np.array([v[0] for v in values], dtype=bool)
        again = set(np.flatnonzero(sums_by_text(wrong[index].astype(np.int64), offsets)).tolist())
        again |= set(np.flatnonzero(pc.and_(filled, pc.invert(plain)).to_numpy(zero_copy_only=False)).tolist())
        if again:   # texts that units do not serve are one unit each
            rows = sorted(again)
            whole = list(self._units([spaced[i].as_py() for i in rows]))
            own = np.repeat(np.arange(len(texts)), np.diff(offsets))
            keep = ~np.isin(own, rows)
            fine = [k for k, v in enumerate(whole) if v[0]]
            own = np.concatenate([own[keep], np.array(rows, np.int64)[fine]])
            index = np.concatenate([index[keep], len(values) + np.arange(len(fine))])
            values += [whole[k] for k in fine]
            order = np.argsort(own, kind="stable")
            index, offsets = index[order], np.searchsorted(own[order], np.arange(len(texts) + 1))
        counts = np.array([v[1:5] for v in values], dtype=np.int64).reshape(-1, 4)
        said = joined_bytes([v[5] for v in values], index, offsets)
        links = np.frombuffer(b"".join([v[6] for v in values]), "<i8")
        pairs, link_pair = np.unique(links, return_inverse=True)
        times = np.repeat(np.bincount(index, minlength=len(values)), counts[:, 3])
        return {"counts": sums_by_text(counts[index], offsets), "sha": [hashlib.sha256(s[:-1]).hexdigest() if len(s) else "" for s in said],
                "pairs": pairs, "pair_n": np.bincount(link_pair, times, minlength=len(pairs)).astype(np.int64),
                "link_pair": link_pair.astype("<u4").tobytes(), "unit_links": counts[:, 3].astype("<u4").tobytes(),
                "units": index.astype("<u4").tobytes(), "offsets": offsets.astype("<u4").tobytes()}


_DOCS = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long")]
_HOME = ("doc_ids array<{id}>, counts binary, sha array<string>, link_pair binary, unit_links binary, units binary, offsets binary")


def _pieces(docs: DataFrame, path_a: str, path_b: str, doc_id: str, text: str) -> DataFrame:
    """A row per piece of a batch."""
    bounded_batches(docs)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"piece long, {_HOME.format(id=kind)}, pairs array<long>, pair_n array<long>"
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text"))

    def run(batches):
        aligner = worker_state("aligner", (path_a, path_b), lambda: Aligner(path_a, path_b))
        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            size = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False))
            last = size[-1] if len(size) else 0
            cuts = np.unique(np.concatenate([[0], np.searchsorted(size, np.arange(PIECE_BYTES, last, PIECE_BYTES)) + 1, [b.num_rows]]))
            for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = b.slice(at, to - at)
                found = aligner.piece(own.column(1))
                row = {"piece": part << 32 | number, "doc_ids": own.column(0), **found, "counts": found["counts"].astype("<i8").tobytes()}
                number += 1
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                names = [c.split()[0] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [one(row[n]) if not isinstance(row[n], (int, bytes)) else pa.array([row[n]], pa.int64() if n == "piece" else pa.binary())
                     for n in names], names=names)

    return rows.mapInArrow(run, schema)


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, n_a and n_b tokens, n_groups, n_links, n_best (links whose id pair has the
    highest count of its id of B, corpus-wide), count_sum (over links) and groups_sha256."""
    pieces = cut(_pieces(docs, path_a, path_b, doc_id, text))
    own = pieces.select("piece", F.posexplode(F.arrays_zip("pairs", "pair_n")).alias("place", "at"))
    own = own.select("piece", "place", F.col("at.pairs").alias("pair"), F.col("at.pair_n").alias("n"))
    counts = own.groupBy("pair").agg(F.sum("n").alias("count"))
    id_b = F.col("pair").bitwiseAND((1 << _PAIR_BITS) - 1).alias("id_b")
    best = counts.groupBy(id_b).agg(F.max("count").alias("best"))
    counts = (cut(counts).withColumn("id_b", id_b).join(best, "id_b")
              .select("pair", "count", (F.col("count") == F.col("best")).cast("long").alias("is_best")))
    answers = (own.drop("n").join(counts, "pair").groupBy("piece")
               .agg(F.sort_array(F.collect_list(F.struct("place", "count", "is_best"))).alias("at"))
               .select("piece", F.col("at.count").alias("count"), F.col("at.is_best").alias("is_best")))
    kind = docs.schema[doc_id].dataType.simpleString()
    joined = pieces.drop("pairs", "pair_n").join(answers, "piece", "left").drop("piece")
    schema = f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, t in _DOCS) + ", n_best long, count_sum long, groups_sha256 string"

    def sums(batches):
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            for k in range(batch.num_rows):
                read = lambda n, t: np.frombuffer(col[n][k].as_py(), t)  # noqa: B023, E731
                array = lambda n: np.asarray(col[n][k].values) if col[n][k].is_valid else np.zeros(0, np.int64)  # noqa: B023, E731
                links, per_unit = read("link_pair", "<u4"), read("unit_links", "<u4").astype(np.int64)
                figures = np.column_stack([array("is_best"), array("count")])[links]
                per_unit = sums_by_text(figures, np.concatenate([[0], np.cumsum(per_unit)]))
                totals = sums_by_text(per_unit[read("units", "<u4")], read("offsets", "<u4").astype(np.int64))
                counts = read("counts", "<i8").reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [col["doc_ids"][k].values, *[pa.array(np.ascontiguousarray(c)) for c in (*counts.T, *totals.T)],
                     col["sha"][k].values.cast(pa.string())],
                    names=["doc_id", *[n for n, _ in _DOCS], "n_best", "count_sum", "groups_sha256"])

    return joined.mapInArrow(sums, schema)
