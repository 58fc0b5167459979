"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The neighbouring pairs of a pre-token wait in buckets, one per merge rank, that hold the
positions of a linked list of parts. A two-level bitmap tells which buckets are not empty:
find-first-set gives the lowest rank without a search, whatever the length of the pre-token.
A merge changes its neighbours' pairs; their old entries stay and are skipped when they come
up. Within a rank the leftmost position goes first.

Null and empty texts give no ids. Any text is encoded whole; decoding its ids gives its UTF-8
bytes again. Equal texts have equal ids, repeated rows give repeated rows, an empty table none. Other columns
than the two used are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from .common import WordCache, joined_bytes, sums_by_text, text_of, with_arrow, word_index, worker_state

WORD_BITS = 256


def load_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBPE:
    """Encoder and decoder of one rank file; every single byte must have a rank.

    ``buckets`` and ``words`` are the queue; both are empty between calls. Pushing and popping
    stand in :meth:`encode_piece` itself, as a call for each would double its time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.find = regex.compile(pattern).findall
        self.pairs = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        most = max(ranks.values(), default=0) + 1
        self.buckets: list[list[int]] = [[] for _ in range(most)]
        self.words = [0] * (most // WORD_BITS + 1)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks, longest, get = self.ranks, self.longest, self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        buckets, words, pairs, top = self.buckets, self.words, self.pairs, 0
        n = len(piece)
        end = list(range(1, n + 1))      # of the part that starts at a position
        before = list(range(-1, n))      # start of the part to the left
        waiting = [-1] * n               # rank of the pair whose left part starts here
        i, last = 0, piece[0]
        for byte in piece[1:]:
            rank = pairs[last << 8 | byte]
            if rank >= 0:
                waiting[i] = rank
                bucket = buckets[rank]
                if not bucket:
                    word = rank // WORD_BITS
                    words[word] |= 1 << rank % WORD_BITS
                    top |= 1 << word
                bucket.append(i)         # in order, so a heap
            i, last = i + 1, byte
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = word * WORD_BITS + low.bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                words[word] = bits = bits ^ low
                if not bits:
                    top ^= 1 << word
            if waiting[i] != rank:
                continue                 # stale
            right = end[i]
            stop = end[right]
            end[i], waiting[right], waiting[i] = stop, -1, -1
            left = before[i]
            if stop < n:
                before[stop] = i
                after = end[stop]
                changed = ((i, after), (left, stop)) if left >= 0 else ((i, after),)
            else:
                changed = ((left, stop),) if left >= 0 else ()
            for start, close in changed:
                rank = get(piece[start:close], -1) if close - start <= longest else -1
                if waiting[start] != rank:
                    waiting[start] = rank
                    if rank >= 0:
                        bucket = buckets[rank]
                        if not bucket:
                            word = rank // WORD_BITS
                            words[word] |= 1 << rank % WORD_BITS
                            top |= 1 << word
                        heappush(bucket, start)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        return [x for piece in self.find(text) for x in self.encode_piece(piece.encode("utf-8", "surrogatepass"))]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


# White space that is not one space or one line feed between other characters (and \0, used here).
_NOT_PLAIN = (r"[ \n][ \n]|^[ \n]|[ \n]$|[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
              r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def units_of(texts: pa.Array) -> pa.Array:
    """Texts cut before each space and around each line feed. In plain texts no match of the
    pre-token pattern spans such a cut: the white space in a match is its start (one space) or
    all of it, and neither depends on what precedes."""
    marked = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
    return pc.split_pattern(marked, "\0")


class TextCoder:
    """Ids of whole texts as decimal strings, with the ids of frequent units kept."""

    def __init__(self, path: str, pattern: str, cap: int = 400_000):
        self.bpe = ByteBPE(load_ranks(path), pattern)
        self.pieces = WordCache(self._pieces, cap)
        self.units = WordCache(self._units, cap)

    def _pieces(self, pieces):
        return [self.bpe.encode_piece(p.encode("utf-8", "surrogatepass")) for p in pieces]

    def _units(self, units):
        """(number of ids, the ids as decimals, each with a space after, the bytes they decode to)"""
        found = [self.bpe.find(u) for u in units]
        known = self.pieces.ensure(p for f in found for p in f)
        out = []
        for f in found:
            ids = known[f[0]] if len(f) == 1 else [i for p in f for i in known[p]]
            out.append((len(ids), b"".join([b"%d " % i for i in ids]), self.bpe.decode(ids)))
        return out

    def __call__(self, texts: pa.Array):
        """Per text: number of ids, sha256 of the ids, sha256 of the decoded bytes."""
        plain = pc.invert(pc.match_substring_regex(texts, _NOT_PLAIN)).to_numpy(zero_copy_only=False)
        units, index, offsets = word_index(pc.if_else(pa.array(plain), texts, ""), units_of)
        known = self.units.ensure(units)
        values = [known[u] for u in units]
        counts = sums_by_text(np.array([v[0] for v in values], dtype=np.int64)[index], offsets)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        digests = [sha(ids[:-1]) for ids in joined_bytes([v[1] for v in values], index, offsets)]
        decoded = [sha(own) for own in joined_bytes([v[2] for v in values], index, offsets)]
        for i in np.flatnonzero(~plain):
            found = self.bpe.find(texts[int(i)].as_py())
            pieces = self.pieces.ensure(found)
            ids = [x for p in found for x in pieces[p]]
            counts[i], digests[i] = len(ids), sha(" ".join(map(str, ids)).encode())
            decoded[i] = sha(self.bpe.decode(ids))
        return counts, digests, decoded


def encode_texts(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and ``ids`` (array of int) of every whole text."""

    def make():
        bpe = worker_state("bpe", (path, pattern), lambda: ByteBPE(load_ranks(path), pattern))
        return lambda texts: ([bpe.encode(t) for t in texts.to_pylist()],)

    return with_arrow(docs, make, [("ids", "array<int>")], [text_of(text)], keep=[doc_id])


def decode_ids(df: DataFrame, ids: Column, path: str, out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``df`` plus the bytes that the ``ids`` stand for (null: none)."""

    def make():
        bpe = worker_state("bpe", (path, ""), lambda: ByteBPE(load_ranks(path), r"\s+|\S+"))
        return lambda rows: ([bpe.decode(r or []) for r in rows.to_pylist()],)

    return with_arrow(df, make, [(out, "binary")], [ids], keep=keep)


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text: id, n_tokens, ids_sha256, decoded_sha256."""

    def make():
        return worker_state("bpe coder", (path, pattern), lambda: TextCoder(path, pattern))

    return with_arrow(docs, make, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
                      [text_of(text)], keep=[doc_id])
