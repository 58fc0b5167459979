"""Token counts of a unigram vocabulary by a count-only Viterbi search.

An Aho-Corasick automaton enumerates every vocabulary piece in a word; dynamic programming over
the ends carries the best score and its number of pieces, never the pieces themselves. Ties go
as in the tokenizer library: of paths with equal score, the one that reached an end first stays,
where pieces are tried from the left, shorter first. A character that no piece covers scores
``lowest - 10`` and counts as its UTF-8 bytes (byte fallback).

White space: each space becomes the word mark, and one is put before the text. A piece has the
mark only at its start (or is marks alone), so a text's search falls into one per word.

Null and empty texts have 0 tokens, very long ones are counted whole. Repeated rows give repeated rows, an
empty table none; other columns than the two used are left out. Scores are sums of the vocabulary's scores; with whole-number
scores, as in the file used, they are exact.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import WordCache, sums_by_text, text_of, with_arrow, word_index, worker_state

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece file (not control, unknown or byte pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class CountViterbi:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of ``word``."""
        n = len(word)
        by_start: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (size, score) in self.automaton.iter(word):
            by_start[end + 1 - size].append((end + 1, score))
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        for start, found in enumerate(by_start):
            score, pieces = best[start], count[start]
            single = False
            for end, own in found:  # shorter first: the automaton reports by end
                if best[end] is None or score + own > best[end]:
                    best[end], count[end] = score + own, pieces + 1
                single = single or end == start + 1
            if not single:
                own = score + self.unknown
                if best[start + 1] is None or own > best[start + 1]:
                    best[start + 1] = own
                    count[start + 1] = pieces + len(word[start].encode("utf-8", "surrogatepass"))
        return count[n], best[n]


_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def words_of(text: str) -> list[str]:
    """The text with marks, cut before each run of marks."""
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the id, n_chars, n_tokens and score of the best segmentation of its whole text."""

    def make():
        def build():
            viterbi = CountViterbi(load_pieces(path))
            return WordCache(lambda ws: list(map(viterbi.word, ws)), 400_000)

        cache = worker_state("unigram", path, build)

        def totals(words, index, offsets):
            known = cache.ensure(words)
            return sums_by_text(np.array([known[w] for w in words], dtype=np.float64).reshape(-1, 2)[index], offsets)

        def run(texts):
            # Single spaces part a text into its words; texts with more in a row are cut one by one.
            runs = pc.match_substring_regex(texts, r"  |^ | $").to_numpy(zero_copy_only=False)
            marked = pc.replace_substring(pc.if_else(pc.equal(pc.utf8_length(texts), 0), "", pc.binary_join_element_wise(MARK, texts, "")),
                                          " ", "\0" + MARK)
            out = totals(*word_index(marked, lambda t: pc.split_pattern(t, "\0")))
            for i in np.flatnonzero(runs | pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)):
                known = cache.ensure(words := words_of(texts[i].as_py()))
                out[i] = np.array([known[w] for w in words], dtype=np.float64).reshape(-1, 2).sum(axis=0)
            return pc.utf8_length(texts).cast("int64"), out[:, 0].astype(np.int64), out[:, 1]

        return run

    return with_arrow(docs, make, [("n_chars", "long"), ("n_tokens", "long"), ("score", "double")],
                      [text_of(text)], keep=[doc_id])
