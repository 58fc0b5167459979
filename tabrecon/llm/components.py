"""Connected components of a table of links, in about log(n) rounds.

Nodes are renamed by a fixed one-to-one scramble of their ids, so that "least name" is a random
choice whatever order the ids have along a chain. Each round

1. every task reduces its links to a forest of stars around least names (bounded memory: a full
   table of names is written out and started anew, which only leaves more for the next round),
2. every node points at the least name among itself and its neighbours, pointers are followed once
   more, and nodes that point at one name become that name.

A chain shrinks by a constant factor a round, a star is done in one, and a node with very many links
has them reduced by the tasks first. Once the links left fit one task's table, that task ends it. Nothing is
collected: links and labels stay in checkpointed tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, release

MOST_NAMES = 500_000      # names that a task's forest holds at once
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


def _scrambled(ids: pa.Array, factor: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (np.asarray(ids).astype(np.int64).view(np.uint64) * np.uint64(factor)).view(np.int64)


def _stars(parent: dict[int, int]):
    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ends = [(root(x), x) for x in parent]
    ends = [e for e in ends if e[0] != e[1]]
    return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in ends], pa.int64()), "b": pa.array([y for _, y in ends], pa.int64())})


def _forest(links: DataFrame, factor: int = 1) -> DataFrame:
    """Links (a, b) that connect what ``links`` connect, at most one per node and task: a < b."""
    def run(batches):
        parent: dict[int, int] = {}
        for batch in batches:
            a, b = (_scrambled(batch.column(k), factor).tolist() for k in (0, 1))
            for x, y in zip(a, b, strict=True):
                for z in (x, y):
                    if z not in parent:
                        parent[z] = z
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                while parent[y] != y:
                    parent[y] = y = parent[parent[y]]
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > MOST_NAMES:
                yield _stars(parent)
                parent = {}
        yield _stars(parent)

    return links.mapInArrow(run, "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """(uid, comp) of every node of ``links`` (long columns a and b, neither null): two nodes have the
    same ``comp``, the id of one of them, if links connect them. Links may repeat or join a node to
    itself; no links give no rows, and nodes only linked to themselves may be left out."""
    bounded_batches(links)
    links, labels = cut(_forest(links.select("a", "b"), _ODD)), None
    while links.count() > MOST_NAMES // 2:
        links = links.distinct()
        if labels is None:
            labels = cut(links.select(F.explode(F.array("a", "b")).alias("uid")).distinct().withColumn("comp", F.col("uid")))
        ends = links.union(links.select("b", "a"))
        least = cut(ends.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        on = least.select(F.col("a").alias("to"), F.col("to").alias("further"))
        least = cut(least.join(on, "to").select("a", F.col("further").alias("to")))
        labels = cut(labels.join(least, labels["comp"] == least["a"], "left").select("uid", F.coalesce("to", "comp").alias("comp")))
        to = lambda side: least.select(F.col("a").alias(side), F.col("to").alias(f"to_{side}"))
        links = links.join(to("a"), "a").join(to("b"), "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        links = cut(_forest(links))
        release(labels.sparkSession)
    # Links that one task's table holds are done by one task.
    stars = cut(_forest(links.coalesce(1)).select(F.col("a").alias("to"), F.col("b").alias("comp")))
    if labels is None:
        labels = stars.select(F.col("comp").alias("uid"), F.col("to").alias("comp")).union(stars.select("to", "to").distinct())
    else:
        labels = labels.join(stars, "comp", "left").select("uid", F.coalesce("to", "comp").alias("comp"))

    def unscramble(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({n: _scrambled(batch.column(n), _BACK) for n in ("uid", "comp")})

    return labels.mapInArrow(unscramble, "uid long, comp long")
