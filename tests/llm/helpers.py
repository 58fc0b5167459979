"""Inputs and brute-force versions that the operators' tests share."""

import random
import re

DOCS_DDL = "doc_id long, text string, lang string, source string, n_chars long"

# Columns whose names clash with what operators compute or use inside.
CLASHING = ("score", "piece", "length", "n_words", "key", "word", "uid", "sig", "labels", "_text", "fail_bits")


def docs_frame(spark, texts, langs=None, extra=()):
    """A documents table: doc_id 0, 1, ...; ``extra`` columns of text are added."""
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, g, "src", None if t is None else len(t), *["x"] * len(extra))
            for i, (t, g) in enumerate(zip(texts, langs, strict=True))]
    return spark.createDataFrame(rows, DOCS_DDL + "".join(f", {c} string" for c in extra))


def odd_texts(seed=1, n=12):
    """Null, empty, white space only, one word, repeated, unusual characters, very long."""
    rng = random.Random(seed)
    alphabet = ["a", "B", "the", "ing", " ", "  ", "\n", "\t", "é", "ß", "日本", "1", "!", ".", "\x0b", "　", "\x00", "|", "$"]
    made = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(n)]
    long_one = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 900)) for _ in range(20_000))
    return [None, "", " \n\t ", "word", "word", "the the the the the the the the the the the", long_one, *made]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, width=5):
    w = words_of(lower_az(text))
    return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[j:j + width]) for j in range(len(w) - width + 1)])


def components(sets, percent=75):
    """Least id reachable by links, for a dict of id -> shingle set, by comparing all pairs."""
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: find(i) for i in ids}
