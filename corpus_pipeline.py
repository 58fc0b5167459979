"""A corpus pipeline over documents: language, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's ``docs``; all but the last return the columns of documents. Rows are judged one
by one: ids may repeat or be null.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrecon.llm import jaccard_join, langid, packing, quality
from tabrecon.llm.common import cut
from tabrecon.operators.keys import helper_name
from tabrecon.operators.order import source_order
from tabrecon.session import checkpoint_dir


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the character models know; fitted on the labelled documents."""
    names = tuple(helper_name(s) for s in ("lang", "score", "entropy", "rejected"))
    return langid.predict(docs, langid.fit(docs), names=names).where(~F.col(names[3])).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current version of the quality policy."""
    packed, marker = helper_name("row"), helper_name("marker")
    rows = docs.select("text", F.struct(*docs.columns).alias(packed), F.monotonically_increasing_id().alias(marker))
    # The marker keeps the rules out of a second evaluation below the projection.
    kept = quality.ledger(rows, keep=[packed, marker]).where(~quality.fails(quality.CURRENT) & (F.col(marker) >= 0))
    return kept.select(f"{packed}.*")


def with_place(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` plus a number that tells its rows apart, the same whenever they are read: rows come from a
    file's split in the same order each time, and those that have been moved are written once."""
    try:
        source_order(docs, name)
    except ValueError:
        docs = cut(docs)
    return docs.withColumn(name, F.monotonically_increasing_id())


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: of those with the least id (null is the
    greatest) the one first in place."""
    place, first, group = (helper_name(s) for s in ("place", "first", "group"))
    rows = with_place(docs, place)
    groups = jaccard_join.join_components(rows, doc_id=place).select(F.col("doc_id").alias(place), F.col("component_id").alias(group))
    members = cut(groups.join(rows.select(place, "doc_id"), place))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", place))
    several = members.groupBy(group).agg(least.alias(first), F.count(F.lit(1)).alias("n")).where("n > 1")
    others = (members.join(several.select(group, F.col(f"{first}.{place}").alias(first)), group)
              .where(F.col(place) != F.col(first)).select(place))
    return rows.join(others, place, "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place. Workers keep fewer words than alone, as
    the stages before have left executors with a grown heap."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, cached_words=80_000)


STAGES = [("language id", known_language), ("quality rules", good_quality), ("jaccard join", one_of_each),
          ("packing", packed)]

# Language models, shingle joins and packing are beyond SQL; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    out = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{out}/{k}-{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
