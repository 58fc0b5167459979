"""Packing, byte-level BPE and token counts against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from tabrecon.llm import byte_bpe, packing, token_counts
from tests.conftest import SF_SMALL
from tests.llm.helpers import CLASHING, docs_frame, odd_texts

WORD_BPE, BYTE_BPE, PIECES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")


def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")


# -- packing ------------------------------------------------------------------------------

def check_packing(df, texts, capacity):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORD_BPE)
    model.encode_special_tokens = True
    rows = [r.asDict() for r in df.collect()]
    ids = [np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for t in texts]
    expected = sorted((i, p, at, len(x[at:at + capacity]), zlib.crc32(x[at:at + capacity].tobytes()))
                      for i, x in enumerate(ids) for p, at in enumerate(range(0, len(x), capacity)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]])[:-1])
        assert sum(n for _, n in parts) <= capacity
    return len(bins), sum(map(len, ids))


def test_packing_of_documents(spark):
    docs = documents(spark)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    bins, tokens = check_packing(packing.pack_documents(docs, WORD_BPE, 2048), texts, 2048)
    assert bins <= -(-tokens // 2048) * 1.02 + 1


def test_packing_of_odd_texts_with_clashing_columns(spark):
    texts = odd_texts()
    check_packing(packing.pack_documents(docs_frame(spark, texts, extra=CLASHING), WORD_BPE, 64), texts, 64)


def test_packing_splits_a_hot_length_and_keeps_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_RANKING", 10)
    texts = ["same text"] * 100 + [None] * 40
    bins, tokens = check_packing(packing.pack_documents(docs_frame(spark, texts), WORD_BPE, 32), texts, 32)
    assert bins == -(-tokens // 32)


def test_packing_of_an_empty_table(spark):
    assert packing.pack_documents(docs_frame(spark, []), WORD_BPE).count() == 0


def test_fullest_combination_is_the_best_subset():
    rng = random.Random(3)
    for _ in range(200):
        items = sorted({rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}.items(), reverse=True)
        room = rng.randint(1, 80)
        sums = {0}
        for n, c in items:
            sums = {s + n * k for s in sums for k in range(c + 1)}
        chosen = packing.fullest(items, room)
        assert sum(n * k for n, k in chosen) == max(s for s in sums if s <= room)
        assert all(k <= dict(items)[n] for n, k in chosen)


def test_tokenizer_cache_equals_the_library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORD_BPE)
    model.encode_special_tokens = True
    words = ["Ünï", "ΣΑΣ", "it's", "don't.", "x<|endoftext|>", "日本語。", "Å", "é!", "a1", "ª", "", "\x01a", "word,", "Word"]
    known = packing.tokenizer_cache(WORD_BPE).ensure(words)
    for w in words:
        assert known[w] == np.array(model.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes(), w


# -- byte-level BPE -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(BYTE_BPE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_query_equals_the_library(spark, library):
    texts = odd_texts(n=60)
    for r in byte_bpe.round_trip(docs_frame(spark, texts, extra=CLASHING), BYTE_BPE, P.PATTERN).collect():
        text = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_byte_bpe_of_random_texts(library):
    rng = random.Random(5)
    bpe = byte_bpe.ByteBPE(byte_bpe.load_ranks(BYTE_BPE), P.PATTERN)
    coder = byte_bpe.TextCoder(BYTE_BPE, P.PATTERN, cap=50)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "日", "1", "!", "\t", "　", "aaaa", "\x00", "\x1c", "'s"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(3000)]
    counts, digests, _ = coder(pa.array(texts))
    for t, n, digest in zip(texts, counts, digests, strict=True):
        ids = library.encode_ordinary(t)
        assert bpe.encode(t) == ids
        assert (n, digest) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_byte_bpe_of_a_very_long_piece(library):
    bpe = byte_bpe.ByteBPE(byte_bpe.load_ranks(BYTE_BPE), P.PATTERN)
    text = "".join(random.Random(2).choices("abcdexyz", k=60_000))
    ids = bpe.encode(text)
    assert bpe.decode(ids) == text.encode()
    assert ids[:200] == library.encode_ordinary(text[:5000])[:200]
    assert not any(bpe.words) and not any(bpe.buckets)  # the queue is empty between calls


def test_ids_and_decoding_as_columns(spark):
    docs = docs_frame(spark, ["Hello  world", None, "日本\n"])
    ids = byte_bpe.encode_texts(docs, BYTE_BPE, P.PATTERN)
    back = byte_bpe.decode_ids(ids, ids["ids"], BYTE_BPE).orderBy("doc_id").collect()
    assert [bytes(r["decoded"]).decode() for r in back] == ["Hello  world", "", "日本\n"]
    assert byte_bpe.encode_texts(docs_frame(spark, []), BYTE_BPE, P.PATTERN).count() == 0


# -- token counts -------------------------------------------------------------------------

def unigram_library(pieces):
    import sentencepiece
    from tokenizers import Tokenizer, models

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocabulary = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    low = min(s for _, s in pieces)
    ordinary = {p for p, _ in pieces}
    return Tokenizer(models.Unigram([(p, s if p in ordinary else max(low, 0.0) if i else low - 1) for i, (p, s) in enumerate(vocabulary)],
                                    unk_id=0, byte_fallback=True))


def test_token_counts_equal_the_library(spark):
    pieces = token_counts.load_pieces(PIECES)
    library = unigram_library(pieces)
    mark = token_counts.MARK
    texts = [t for t in odd_texts(n=30) if t is None or len(t) < 1000] + [
        r["text"] for r in documents(spark).limit(20).collect()]
    for r in token_counts.count_tokens(docs_frame(spark, texts, extra=CLASHING), PIECES).collect():
        text = texts[r["doc_id"]] or ""
        expected = len(library.encode(mark + text.replace(" ", mark), add_special_tokens=False).ids) if text else 0
        assert r["n_tokens"] == expected, repr(text)
        assert r["n_chars"] == len(text)


def test_viterbi_is_the_best_of_all_segmentations():
    pieces = [("a", -3.0), ("b", -2.0), ("ab", -4.0), ("ba", -4.0), ("aba", -6.0), ("bab", -9.0), ("abab", -8.0)]
    viterbi, scores = token_counts.CountViterbi(pieces), dict(pieces)

    def brute(word):
        if not word:
            return [(0.0, 0)]
        found = [(s + scores[word[:n]], k + 1) for n in range(1, len(word) + 1) if word[:n] in scores for s, k in brute(word[n:])]
        if word[0] not in scores:
            found += [(s + viterbi.unknown, k + len(word[0].encode())) for s, k in brute(word[1:])]
        return found

    rng = random.Random(4)
    for _ in range(200):
        word = "".join(rng.choices("abé", k=rng.randint(1, 8)))
        count, score = viterbi.word(word)
        best = max(s for s, _ in brute(word))
        assert score == best and (best, count) in brute(word)


def test_token_counts_of_an_empty_table(spark):
    assert token_counts.count_tokens(docs_frame(spark, []), PIECES).count() == 0
