"""License notices in texts: exact phrases, and fuzzy search for short notices.

Texts are lower-cased (A-Z) and reduced to words. A notice of n bytes that may differ by k
edits is cut into k + 1 parts: by the pigeonhole principle one of them stands unchanged in any
match, so exact search for the parts finds every candidate, and only the window around a part
goes to the regex library, whose bounded-error matching verifies the edits and gives the span. A
notice's anchors, the names and versions that tell its licence from others, must stand exactly.

Null and empty texts have no words and no labels. Very long texts are searched whole, in time that grows
with their length. Repeated rows give repeated rows, extra columns are ignored; a kept id column with the
name of an output gives way. An empty table gives no rows. Ties: notices with as many edits both hold.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import text_of, with_arrow, worker_state

# Exact phrases and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short notices: words as they stand after normalisation, label, most edits in bytes, and the words that
# tell the licence from others, which must stand exactly, in this order.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0", 4, "apache 2 0"),
    ("released under the mit license", "mit", 3, "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7, ""),
    ("gnu general public license version 3", "gpl-3.0", 3, "gnu 3"),
    ("gnu general public license version 2", "gpl-2.0", 3, "gnu 2"),
    ("gnu lesser general public license", "lgpl", 3, "gnu lesser"),
    ("gnu affero general public license", "agpl", 3, "gnu affero"),
    ("redistribution and use in source and binary forms", "bsd", 5, ""),
    ("mozilla public license version 2 0", "mpl-2.0", 3, "mozilla 2 0"),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2, "cc by nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa", 2, "cc by sa"),
    ("creative commons attribution", "cc-by", 2, "creative commons"),
    ("this work is in the public domain", "public-domain", 3, "public domain"),
    ("all rights reserved", "reserved", 2, "all"),
)

_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TO_SPACE = bytes(c if c in _LETTERS else 0x20 for c in range(256))


@dataclass(frozen=True)
class Match:
    label: str
    first_word: int
    last_word: int
    edits: int
    likeness: float


class Notice:
    """One notice. A match holds its anchors as whole words; elsewhere it may differ by ``edits`` bytes."""

    def __init__(self, words: str, label: str, edits: int, anchors: str = ""):
        import regex

        self.text, self.label, self.edits = words.encode(), label, edits
        size, parts = len(self.text), edits + 1
        cuts = [i * size // parts for i in range(parts + 1)]
        self.seeds = [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.find = regex.compile(rb"(?b)(?:%s){e<=%d}" % (regex.escape(self.text, special_only=True), edits)).search
        self.anchors = [f" {w} ".encode() for w in anchors.split()]

    def windows(self, line: bytes) -> list[list[int]]:
        """Where a match may lie: a notice's length and some edits around each part that stands unchanged. Parts of
        one match give windows that start within twice the edits; they are one window, too short for two matches."""
        starts = []
        for seed, offset in self.seeds:
            at = line.find(seed)
            while at >= 0:
                starts.append(at - offset - self.edits)
                at = line.find(seed, at + 1)
        out: list[list[int]] = []
        for a in sorted(starts):
            if not out or a > out[-1][0] + 2 * self.edits:
                out.append([a, a])
            out[-1][1] = a
        return [[max(0, a), b + len(self.text) + 3 * self.edits] for a, b in out]

    def matches(self, line: bytes, spaces: np.ndarray | None = None) -> list[Match]:
        """Matches in ``line`` (words joined by spaces, with one at either end)."""
        spans = {}
        for a, b in self.windows(line):
            if all(w.strip() in line[a:b] for w in self.anchors) and (m := self.find(line, a, min(b, len(line)))):
                start, stop = m.start(), m.end()
                # The words that the match touches.
                whole, at = line[line.rfind(b" ", 0, start + 1):line.find(b" ", max(stop - 1, start)) + 1], 0
                for w in self.anchors:
                    at = whole.find(w, at) + len(w) - 1
                    if at < len(w) - 1:
                        break
                else:
                    spans[start, stop] = sum(m.fuzzy_counts)
        if not spans:
            return []
        spaces = _spaces(line) if spaces is None else spaces
        places = np.array(sorted(spans))
        first = np.maximum(np.searchsorted(spaces, places[:, 0], side="right") - 1, 0)
        last = np.maximum(np.searchsorted(spaces, np.maximum(places[:, 1] - 1, places[:, 0]), side="left") - 1, first)
        return [Match(self.label, f, t, spans[x, y], 1 - spans[x, y] / len(self.text))
                for (x, y), f, t in zip(places.tolist(), first.tolist(), last.tolist(), strict=True)]


def _spaces(line: bytes) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)


def closest(matches: list[Match]) -> list[Match]:
    """Of matches that share words the one with fewest edits; different notices with as many edits both stay."""
    out: list[Match] = []
    taken: list[tuple[int, int]] = []   # disjoint, in order: words of matches with fewer edits
    for edits in sorted({m.edits for m in matches}):
        starts, ends, own, free = [a for a, _ in taken], [b for _, b in taken], [], {}
        for m in sorted((m for m in matches if m.edits == edits), key=lambda m: (m.first_word, m.last_word, m.label)):
            at = bisect_right(starts, m.last_word) - 1
            if (at < 0 or ends[at] < m.first_word) and free.get(m.label, 0) <= m.first_word:
                own.append(m)
                free[m.label] = m.last_word + 1
        out += own
        merged: list[tuple[int, int]] = []
        for a, b in sorted(taken + [(m.first_word, m.last_word) for m in own]):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        taken = merged
    return sorted(out, key=lambda m: (m.edits, m.first_word, m.label))


def places(line: bytes, phrase: bytes) -> list[int]:
    """Word indexes at which ``phrase`` stands; ``line`` and ``phrase`` have a space at either end."""
    at, out, words, seen = line.find(phrase), [], 0, 0
    while at >= 0:
        words += line.count(b" ", seen, at)
        seen = at
        out.append(words)
        at = line.find(phrase, at + 1)
    return out


class Scanner:
    def __init__(self, phrases: dict[str, str], notices):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = [Notice(*n) for n in notices]

    def scan(self, text: str):
        """(number of words, [(word, label)] of the exact phrases, matches of the notices)."""
        words = text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()
        line = b" " + b" ".join(words) + b" "
        base = [(w, label) for phrase, label in self.phrases for w in places(line, phrase)]
        spaces = _spaces(line)
        found = closest([m for n in self.notices for m in n.matches(line, spaces)])
        return len(words), base, found


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, notices=NOTICES, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Per document: n_words; n_base, first_word, last_word and base_labels of the exact phrases;
    ``matches`` (label, first_word, last_word, edits) of the notices; labels of both; score, the
    best likeness to a notice (1 where a phrase stands exactly, 0 where nothing was found)."""
    phrases = PHRASES if phrases is None else phrases
    key = (tuple(phrases.items()), tuple(notices))

    def make():
        scanner = worker_state("licenses", key, lambda: Scanner(phrases, notices))

        def run(texts):
            out = [[] for _ in range(8)]
            for t in texts.to_pylist():
                n, base, found = scanner.scan(t)
                at, of_base = [w for w, _ in base], {label for _, label in base}
                score = 1.0 if base else max((m.likeness for m in found), default=0.0)
                row = (n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(of_base)),
                       ",".join(sorted(of_base | {m.label for m in found})), score,
                       [(m.label, m.first_word, m.last_word, m.edits) for m in found])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            keys = ("label", "first_word", "last_word", "edits")
            out[7] = [[dict(zip(keys, m, strict=True)) for m in ms] for ms in out[7]]
            return out

        return run

    return with_arrow(docs, make, [
        ("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"),
        ("base_labels", "string"), ("labels", "string"), ("score", "double"),
        ("matches", "array<struct<label: string, first_word: int, last_word: int, edits: int>>"),
    ], [text_of(text)], keep=[doc_id])
