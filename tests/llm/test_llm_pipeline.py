"""The pipeline's stages, each against a plain version on its own input, and the registered queries."""

import random
from collections import Counter

import public_tokenizers as P
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tabrecon.llm import langid, queries
from tests.compare import compare, duck
from tests.conftest import SF_SMALL
from tests.llm.helpers import components, docs_frame, odd_texts, shingles
from tests.llm.test_llm_text_rules import measured
from tests.llm.test_llm_tokens import check_packing


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language id", "quality rules", "jaccard join", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    one = stages["language id"](spark, docs, SF_SMALL)
    assert one.columns == docs.columns
    kept = {r["doc_id"] for r in one.collect()}
    rejected = {r["doc_id"] for r in langid.predict(docs, langid.fit(docs), keep=["doc_id"]).where("rejected").collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - rejected

    two = stages["quality rules"](spark, docs, SF_SMALL)
    assert two.columns == docs.columns and two.schema["text"].dataType == docs.schema["text"].dataType
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in two.collect()}
    for i, t in texts.items():
        n, chars, symbols, dup, rep = measured(t)
        lines = len([x for x in t.split("\n") if x.split()])
        upper, bangs = sum(c.isupper() for c in t), t.count("!")
        fails = (n < 10 or 100 * rep > 20 * n or 10 * symbols > 3 * n or 2 * dup > lines or chars > 15 * n or chars < 2 * n
                 or 10 * upper > 4 * chars or 2 * bangs > n)
        assert (i in kept) == (not fails), i

    three = stages["jaccard join"](spark, docs, SF_SMALL)
    assert three.columns == docs.columns
    roots = components({i: shingles(t) for i, t in texts.items()})
    assert {r["doc_id"] for r in three.collect()} == set(roots.values())

    few = docs.where("doc_id < 60")
    check_packing(stages["packing"](spark, few, SF_SMALL), [texts[i] for i in range(60)], 2048)


def test_one_of_each_group_stays_with_repeated_and_null_ids(spark, scratch):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(40)] for _ in range(8)]
    rows = []
    for k in range(60):
        words = list(rng.choice(base))
        if rng.random() < 0.5:
            words[rng.randrange(40)] = f"e{k}"
        rows.append((rng.choice([None, *range(12)]), " ".join(words), k))
    rows += [(3, "the only text of its kind under an id that is taken", 60), (None, None, 61), (None, None, 62), rows[0], rows[0]]
    made = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    made.repartition(4).write.parquet(f"{scratch}/docs")
    roots = components({i: shingles(r[1]) for i, r in enumerate(rows)})
    for docs in (made, spark.read.parquet(f"{scratch}/docs")):
        kept = corpus_pipeline.one_of_each(spark, docs, SF_SMALL)
        assert kept.columns == docs.columns
        kept = [tuple(r) for r in kept.collect()]
        found = Counter(roots[rows.index(r)] for r in kept)
        assert found == Counter(set(roots.values()) - {roots[len(rows) - 1], roots[len(rows) - 2]} | {roots[0]})
        for r in kept:
            ids = [x[0] for i, x in enumerate(rows) if roots[i] == roots[rows.index(r)]]
            assert r[0] == min((i for i in ids if i is not None), default=None)


def test_run_packs_what_the_stages_keep(spark):
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    ids = {r["doc_id"] for r in rows}
    assert 0 < len(ids) < 200
    assert all(r["offset"] + r["length"] <= 2048 for r in rows)


def test_stages_on_odd_and_empty_documents(spark):
    texts = odd_texts()
    odd = docs_frame(spark, texts, langs=[None, *["en"] * (len(texts) - 1)], extra=("score", "rejected", "n_words", "gone"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF_SMALL)
        assert out.count() <= 10_000
        if name != "packing":
            assert out.columns == odd.columns
        assert stage(spark, odd.where(F.lit(False)), SF_SMALL).count() == 0, name


def test_every_query_is_registered():
    names = [*(n for n in entry.queries() if n.startswith("op")), "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


def test_queries_with_sql(spark):
    con = duck(SF_SMALL)
    for name, sql in queries.ORACLE_SQL.items():
        r = compare(entry.queries()[name](spark, SF_SMALL), sql, con)
        assert r["schema"] and r["values"] and r["rows"] == r["oracle_rows"], name


def test_query_columns(spark):
    expected = {
        "op1_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
        "op2_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op4_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                            "base_labels string, labels string, score double",
        "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
        "op7_pitman_yor": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                          "base_score double, score double",
        "op9_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        "op10_order_minhash": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                              "edited_fingerprint string, near_edited double, near_next double",
        "op11_token_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
                                "count_sum bigint, groups_sha256 string",
        "op12_conversation_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
                                  "n_leaves bigint, saved_tokens bigint, ends_sha256 string",
        "op13_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    }
    for name, columns in expected.items():
        types = dict(entry.queries()[name](spark, SF_SMALL).dtypes)
        for c in columns.split(", "):
            n, t = c.split()
            assert types[n] == t, (name, n)
    assert P.PATTERN
