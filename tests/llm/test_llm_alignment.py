"""Cross-tokenizer alignment against the tokenizer libraries and a plain search for common ends."""

import collections
import hashlib
import itertools

import public_tokenizers as P
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tabrecon.llm import token_alignment as ta

from .helpers import CLASHING, docs_frame, odd_texts

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def brute_force(texts, libraries):
    """Rows without id, as a tuple per text."""
    a, b = libraries
    letters = ta._byte_letters()
    name = {i: t for t, i in a.get_vocab().items()}
    found, counts = [], collections.Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(letters[c] for c in name[i]) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            found.append(None)
            continue
        spans = []
        for raw in (raw_a, raw_b):
            ends = list(itertools.accumulate(map(len, raw)))
            spans.append(list(zip([0, *ends], ends, strict=False)))
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        said, links = [], []
        for lo, hi in zip([0, *common], common, strict=False):
            ga = [(i, s) for i, s in zip(ids_a, spans[0], strict=True) if lo <= s[0] < hi]
            gb = [(i, s) for i, s in zip(ids_b, spans[1], strict=True) if lo <= s[0] < hi]
            said.append(",".join(str(i) for i, _ in ga) + "|" + ",".join(str(i) for i, _ in gb))
            links += [(i, j) for i, s in ga for j, t in gb if max(s[0], t[0]) < min(s[1], t[1])]
        counts.update(links)
        found.append((len(ids_a), len(ids_b), len(common), links, hashlib.sha256(";".join(said).encode()).hexdigest()))
    best = collections.Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else
            (*f[:3], len(f[3]), sum(counts[p] == best[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), f[4]) for f in found]


def check(spark, docs, texts, libraries):
    got = {r["doc_id"]: tuple(r)[1:] for r in ta.align_tokenizers(docs, *PATHS).collect()}
    assert [got[i] for i in range(len(texts))] == brute_force(texts, libraries)


def test_against_libraries(spark, libraries):
    texts = [*odd_texts(n=20), "The unbelievable token-alignment, don't stop.", "a  b", " lead", "trail ", "x\ny\nz w", "▁a <s> <0x0A> <unk>",
             "<|endoftext|> end", "naïve ﬁ ½", "日本 語", "a\tb\rc", "The unbelievable token-alignment, don't stop.", "\n", " ", "emoji 😀 done"]
    check(spark, docs_frame(spark, texts, extra=[c for c in CLASHING if c != "_text"]).repartition(3), texts, libraries)


def test_several_pieces_and_hot_pairs(spark, libraries, monkeypatch):
    monkeypatch.setattr(ta, "PIECE_BYTES", 200)
    texts = ["the cat sat on the mat and the tokenization went on"] * 40 + [f"word{i} the Überraschung" for i in range(40)]
    check(spark, docs_frame(spark, texts), texts, libraries)


def test_empty_and_null_ids(spark):
    none = docs_frame(spark, ["a"]).limit(0)
    assert ta.align_tokenizers(none, *PATHS).count() == 0
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, None)], "doc_id long, text string")
    got = sorted(ta.align_tokenizers(docs, *PATHS).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [r["doc_id"] for r in got] == [3, None, None] and got[1] == got[2] and got[1]["count_sum"] == 2 * got[1]["n_links"]


ends = st.lists(st.integers(1, 60), min_size=1, max_size=40, unique=True)


@given(ends, ends)
def test_diagonal_runs(a, b):
    last = max(*a, *b) + 1
    a, b = sorted([*a, last]), sorted([*b, last])
    common = [e for e in a if e in set(b)]
    assert ta.group_ends(a, b) == [(a.index(e) + 1, b.index(e) + 1) for e in common]


@given(ends)
def test_one_run(a):
    a = sorted(a)
    assert ta.group_ends(a, a) == [(k + 1, k + 1) for k in range(len(a))]


@given(ends, ends)
def test_overlaps(a, b):
    last = max(*a, *b) + 1
    a, b = sorted([*a, last]), sorted([*b, last])
    sa, sb = list(zip([0, *a], a, strict=False)), list(zip([0, *b], b, strict=False))
    assert ta.overlaps(a, b) == [(i, j) for i, s in enumerate(sa) for j, t in enumerate(sb) if max(s[0], t[0]) < min(s[1], t[1])]


def test_one_to_one_ends_are_not_cut_into_stretches():
    class Counted(list):
        cuts = 0

        def __getitem__(self, at):
            Counted.cuts += 1
            return super().__getitem__(at)

    from tabrecon.llm.token_alignment import group_ends

    ends = list(range(3, 3000, 3))
    assert group_ends(Counted(ends), Counted(ends)) == [(k, k) for k in range(1, len(ends) + 1)] and Counted.cuts == 0
    assert group_ends(Counted(ends), Counted([*ends[:500], *ends[501:]]))[499:501] == [(500, 500), (502, 501)] and Counted.cuts > 0
