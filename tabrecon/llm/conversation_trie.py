"""Prefix trie over conversations as a z-fast trie held in Spark tables.

A conversation is a sequence of turns (role, text); a prefix is known by two running 64-bit
fingerprints. The trie is compacted: a node stands for the edge from its parent's depth ``lo`` to its
own depth ``ext``, and its *handle* is the prefix whose depth is the 2-fattest number in (lo, ext],
the one with most trailing zero bits. Three steps build it, all of them joins and aggregates:

* **locate** (:func:`_located`): fat binary search. Each conversation keeps an interval of depths and
  looks up, in one join per step, the handle at the interval's 2-fattest depth: a node that the
  conversation runs through moves the interval's start to its depth, a miss moves the end before the
  handle. After at most ``bit_length(longest)`` joins the deepest node on the way is known, and one join by
  a child's first turn gives the edge where the conversation leaves the trie.
* **insert in batches** (:func:`build`): a first batch builds a small trie, which the second, all other
  conversations, searches. Of the conversations that leave the trie at
  one place by the same turn, one (chosen by hash) becomes a new leaf; the others run along its edge next,
  in about log(n) rounds, as a random one of a group parts from half of it on average. Then edges are split,
  once, at all depths where conversations end or leave (:func:`_inserted`).
* **expand edges**: every depth of an edge is a row. Members are counted over the nodes that each
  distinct conversation runs through. What is summed over subtrees is summed over members instead: a node
  belongs to its member with the least id, whose nodes are the lower end of its path, so that each
  conversation adds up its own nodes and hands the sum to each node above.

Equal conversations are one class with a count, so a group of copies is one row; hot handles and
turns are only ever on the side of a join that adaptive execution may split. Ids of the conversations that
end at a node are written as text in chunks of 4096 before one task hashes a node's chunks in order.
One conversation's fingerprints (24 bytes a turn) are one row.

Turns are ordered by turn, null first; equal turns by role and a hash of their text, so repeated rows
stay. Null role or text is empty. Rows without conversation id are left out. Other columns are ignored,
whatever their names. A text's length does not matter after its fingerprint. An empty table has no
conversations, so not even a root: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, release

_CHUNK = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_KEY = ["depth", "fp1", "fp2"]


def per_conversation(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                     text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as fingerprints and code points."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    rows = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), said[0].alias("role"),
                                F.xxhash64(F.lit(1), *said).alias("h1"), F.xxhash64(F.lit(2), *said).alias("h2"),
                                F.length(said[1]).cast("long").alias("size"))
    rows = rows.where("conv_id is not null")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "h1", "h2", "size")))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["h1"].alias("h1"), t["h2"].alias("h2"), t["size"].alias("size"))).alias("turns"))


def rebuilt(own: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose first ``h = crc32(id) % most`` turns come from the first one of their group."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    start = F.col("conv_id") - F.col("conv_id") % group
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("start"), F.slice("turns", 1, most - 1).alias("head"))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.withColumn("start", start).join(heads, "start", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefixes(sequences: DataFrame) -> DataFrame:
    """(conv_id, n, p1, p2, chars): fingerprints and code points of each prefix, from one turn on."""
    def run(batches):
        for b in batches:
            lists = b.column(1)
            offsets = np.asarray(lists.offsets).astype(np.int64)
            turns = lists.flatten()
            n, at = np.diff(offsets), offsets[:-1] - offsets[0]
            place = np.arange(len(turns)) - np.repeat(at, n)
            cols = [b.column(0), pa.array(n, pa.int64())]
            for k in range(3):
                x = np.asarray(turns.field(k))
                if k < 2:
                    with np.errstate(over="ignore"):
                        x = _mixed(x.view(np.uint64) + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    total = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(x)])
                    x = (total[1:] ^ np.repeat(total[at], n)).view(np.int64)
                else:
                    total = np.concatenate([[0], np.cumsum(x)])
                    x = total[1:] - np.repeat(total[at], n)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(x, pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "n", "p1", "p2", "chars"])

    return sequences.mapInArrow(run, "conv_id long, n long, p1 array<bigint>, p2 array<bigint>, chars array<bigint>")


def two_fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] with most trailing zero bits, for 0 <= a < b."""
    power = F.floor(F.log2(a.bitwiseXOR(b).cast("double"))).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", b, power), power)


def _at(array: str, depth: Column) -> Column:
    """The fingerprint of a prefix at a depth from 1 on, null beyond."""
    return F.get(array, (depth - 1).cast("int"))


# A node: depth and fingerprints of its parent's end, code points there, and its edge's prefixes.
_NODE = ["lo", "q1", "q2", "q3", "e1", "e2", "e3"]


def _with_keys(nodes: DataFrame) -> DataFrame:
    """Nodes with their depth and its fingerprints."""
    return (nodes.withColumn("ext", F.col("lo") + F.size("e1"))
            .withColumn("x1", F.element_at("e1", -1)).withColumn("x2", F.element_at("e2", -1)))


def _located(pending: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """``pending`` (uid, n, p1, p2, chars, a) with ``leaves``, the depth up to which the trie holds the
    conversation, and the edge (its columns, null if none) on which it ends or leaves."""
    keyed = _with_keys(nodes)
    f = two_fattest(F.col("lo"), F.col("ext"))
    handles = keyed.select(f.alias("f"), F.element_at("e1", (f - F.col("lo")).cast("int")).alias("f1"),
                           F.element_at("e2", (f - F.col("lo")).cast("int")).alias("f2"), F.col("lo").alias("hit_lo"), F.col("ext").alias("hit"), "x1", "x2")
    out = pending.withColumn("b", F.col("n"))
    for step in range(steps):
        if step % 4 == 3:
            out = cut(out)
        open_ = F.col("a") < F.col("b")
        out = out.withColumn("f", F.when(open_, two_fattest(F.col("a"), F.col("b"))))
        # A conversation that is done looks up a key of its own that no handle has.
        out = (out.withColumn("f1", F.coalesce(_at("p1", F.col("f")), F.col("uid"))).withColumn("f2", _at("p2", F.col("f")))
               .withColumn("f", F.coalesce("f", F.lit(-1))).withColumn("f2", F.coalesce("f2", F.lit(0))))
        out = out.join(handles, ["f", "f1", "f2"], "left")
        through = F.coalesce((F.col("hit") <= F.col("n")) & (_at("p1", F.col("hit")) == F.col("x1")) & (_at("p2", F.col("hit")) == F.col("x2")), F.lit(False))
        a = F.when(F.col("hit").isNull(), F.col("a")).when(through, F.col("hit")).otherwise(F.col("hit_lo"))
        b = (F.when(F.col("f") < 0, F.col("b")).when(F.col("hit").isNull(), F.col("f") - 1).when(through, F.col("b"))
             .otherwise(F.col("hit_lo")))
        out = out.select("uid", "n", "p1", "p2", "chars", a.alias("a"), b.alias("b"))
    first = nodes.select(F.col("lo").alias("a"), F.element_at("e1", 1).alias("c1"), F.element_at("e2", 1).alias("c2"), *_NODE[1:])
    out = (out.drop("b").withColumn("c1", F.coalesce(_at("p1", F.col("a") + 1), F.col("uid")))
           .withColumn("c2", F.coalesce(_at("p2", F.col("a") + 1), F.lit(0))).join(first, ["a", "c1", "c2"], "left"))
    return _along(out).drop("c1", "c2")


def _along(runs: DataFrame) -> DataFrame:
    """Conversations with an edge that starts at their depth ``a`` (null: none), with ``leaves``: the depth
    up to which they run along it."""
    own = [F.slice(p, (F.col("a") + 1).cast("int"), F.size("e1")) for p in ("p1", "p2")]
    same = [F.zip_with(x, e, lambda v, w: v.eqNullSafe(w)) for x, e in zip(own, ("e1", "e2"), strict=True)]
    along = F.size(F.filter(F.zip_with(*same, lambda v, w: v & w), lambda v: v))
    return runs.withColumn("leaves", F.col("a") + F.when(F.col("e1").isNotNull() & (F.col("a") < F.col("n")), along).otherwise(0))


def _part(edge: str, lo: Column, start: Column, stop: Column) -> Column:
    return F.slice(edge, (start - lo + 1).cast("int"), (stop - start).cast("int"))


def _leaf(at: Column) -> list[Column]:
    """The node from depth ``at`` to a conversation's end."""
    before = [F.coalesce(_at(p, at), F.lit(0)).cast("long") for p in ("p1", "p2", "chars")]
    rest = [F.slice(p, (at + 1).cast("int"), (F.col("n") - at).cast("int")) for p in ("p1", "p2", "chars")]
    return [c.alias(n) for c, n in zip([at, *before, *rest], _NODE, strict=True)]


def _cuts(located: DataFrame) -> DataFrame:
    """(lo, c1, c2, depth): where conversations end on an edge or leave it, before its end."""
    inside = F.col("e1").isNotNull() & (F.col("leaves") > F.col("a")) & (F.col("leaves") < F.col("a") + F.size("e1"))
    return located.where(inside).select(F.col("a").alias("lo"), F.element_at("e1", 1).alias("c1"), F.element_at("e2", 1).alias("c2"),
                                        F.col("leaves").alias("depth"))


def _grouped(located: DataFrame) -> DataFrame:
    """The conversations that leave the trie, with the edge that one of those which leave at the same place by the
    same turn, chosen by hash, brings (``rep`` is its uid)."""
    left = located.where("leaves < n").select("uid", "n", "p1", "p2", "chars", F.col("leaves").alias("a"),
                                              _at("p1", F.col("leaves") + 1).alias("c1"), _at("p2", F.col("leaves") + 1).alias("c2"))
    place = ["a", "c1", "c2"]
    # Grouped by a struct, so that the join below deals the conversations anew and may split a hot place.
    reps = left.groupBy(F.struct(*place).alias("box")).agg(F.max_by(F.struct("uid", *_leaf(F.col("a"))), F.struct(F.xxhash64("uid"), "uid")).alias("new"))
    reps = reps.select("box.*", F.col("new.uid").alias("rep"), *[F.col(f"new.{c}") for c in _NODE[1:]])
    return left.join(reps, place)


def _split(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """The nodes with their edges split at the depths given."""
    edge = ["lo", "c1", "c2"]
    cuts = cuts.groupBy(*edge).agg(F.sort_array(F.collect_set("depth")).alias("cuts"))
    lo, ext = F.col("lo"), F.col("lo") + F.size("e1")
    split = nodes.select("*", F.element_at("e1", 1).alias("c1"), F.element_at("e2", 1).alias("c2")).join(cuts, edge, "left")
    ends = F.when(F.col("cuts").isNull(), F.array(ext)).otherwise(F.concat("cuts", F.array(ext)))
    starts = F.when(F.col("cuts").isNull(), F.array(lo)).otherwise(F.concat(F.array(lo), "cuts"))
    split = split.withColumn("part", F.explode(F.arrays_zip(starts.alias("from"), ends.alias("to"))))
    start, stop = F.col("part.from"), F.col("part.to")
    base = [F.when(start > lo, F.element_at(e, F.greatest(start - lo, F.lit(1)).cast("int"))).otherwise(F.col(q)) for q, e in (("q1", "e1"), ("q2", "e2"), ("q3", "e3"))]
    return split.select(*[c.alias(n) for c, n in zip([start, *base, *[_part(e, lo, start, stop) for e in ("e1", "e2", "e3")]], _NODE, strict=True)])


def _unplaced(classes: DataFrame) -> DataFrame:
    return classes.select("uid", "n", "p1", "p2", "chars", F.lit(0).cast("long").alias("a"))


def build(classes: DataFrame, first: int = 8) -> DataFrame:
    """The compacted trie of distinct conversations (uid, n, p1, p2, chars): its nodes but the root. One
    in ``first`` conversations, by hash, makes the first batch, all others the second."""
    steps = int(classes.agg(F.max("n")).first()[0] or 0).bit_length()
    early = F.pmod(F.xxhash64("uid"), F.lit(first)) == 0
    nodes = classes.where(F.lit(False)).select(*_leaf(F.lit(0).cast("long")))
    batch = _unplaced(classes.where((F.col("n") > 0) & early))
    # All leave the empty trie at its root, which no search needs to find.
    located = batch.select("*", *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in _NODE[1:]], F.col("a").alias("leaves"))
    nodes = _inserted(nodes, located)
    batch = _unplaced(classes.where((F.col("n") > 0) & ~early))
    return _inserted(nodes, cut(_located(batch, nodes, steps)))


def _inserted(nodes: DataFrame, located: DataFrame) -> DataFrame:
    """The trie with a batch inserted: new edges and cuts are gathered round by round, edges split once."""
    edges, cuts = nodes, _cuts(located)
    while True:
        grouped = cut(_grouped(located))
        if grouped.isEmpty():
            break
        edges = edges.unionByName(grouped.where("uid = rep").select(F.col("a").alias("lo"), *_NODE[1:]))
        located = _along(grouped.where("uid <> rep"))
        cuts = cuts.unionByName(_cuts(located))
    nodes = cut(_split(edges, cuts))
    release(nodes.sparkSession)
    return nodes


def _end_digests(convs: DataFrame) -> DataFrame:
    """Per end (depth and fingerprints), the SHA-256 of its conversations' ids in order."""
    chunks = convs.groupBy(*_KEY, F.floor(F.col("conv_id") / _CHUNK).alias("chunk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    chunks = chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk").drop("chunk")

    def run(batches):
        at, digest = None, None
        for b in batches:
            out = []
            for *key, ids in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key == at:
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = key, hashlib.sha256(ids.encode())
            yield _digest_rows(out)
        if at is not None:
            yield _digest_rows([(*at, digest.hexdigest())])

    return chunks.mapInArrow(run, "depth long, fp1 long, fp2 long, sha string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(cols)], names=[*_KEY, "sha"])


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per node of the trie over ``sequences`` (conv_id, turns as of :func:`per_conversation`):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = sequences.sparkSession
    bounded_batches(sequences)
    whole = _prefixes(sequences)
    end = [F.coalesce(F.get(p, F.size(p) - 1), F.lit(0)).alias(f) for p, f in (("p1", "fp1"), ("p2", "fp2"))]
    whole = cut(whole.select("conv_id", F.col("n").alias("depth"), *end, "p1", "p2", "chars"))
    classes = whole.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies"), F.min("conv_id").alias("least"), F.first("p1").alias("p1"),
                                       F.first("p2").alias("p2"), F.first("chars").alias("chars"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("uid"), F.col("depth").alias("n"), "copies", "least", "p1", "p2", "chars"))
    nodes = cut(_with_keys(build(classes)).withColumn("nid", F.monotonically_increasing_id()))
    root = classes.agg(F.sum("copies"), F.min("least")).first()

    # Members: the nodes that each class runs through.
    prefixes = classes.select("uid", "n", "copies", "least", F.posexplode(F.arrays_zip("p1", "p2")).alias("at", "p"))
    prefixes = prefixes.select("uid", "n", "copies", "least", (F.col("at") + 1).cast("long").alias("ext"), F.col("p.p1").alias("x1"), F.col("p.p2").alias("x2"))
    through = cut(prefixes.join(nodes.select("ext", "x1", "x2", "nid"), ["ext", "x1", "x2"]).select("uid", "n", "copies", "least", "ext", "nid"))
    members = through.groupBy("nid").agg(F.sum("copies").alias("n_convs"), F.min("least").alias("conv_id"))
    children = nodes.groupBy(F.col("lo").alias("ext"), F.col("q1").alias("x1"), F.col("q2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(members, "nid").join(children, ["ext", "x1", "x2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = cut(full)

    # Sums over subtrees, from the least member's own nodes.
    own = full.select("nid", "conv_id", (F.col("n_children") == 0).alias("childless"),
                      ((F.col("n_convs") - 1) * (F.element_at("e3", -1) - F.col("q3"))).alias("saves"))
    path = through.join(own, "nid")
    below = Window.partitionBy("uid").orderBy(F.col("ext").desc()).rowsBetween(Window.unboundedPreceding, 0)
    path = path.select("nid", F.sum(F.when(F.col("least") == F.col("conv_id"), F.col("saves")).otherwise(0)).over(below).alias("saved"),
                       F.max(((F.col("ext") == F.col("n")) & F.col("childless")).cast("long")).over(below).alias("leaf"))
    sums = path.groupBy("nid").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("n_leaves"))
    full = full.join(sums, "nid")

    # Every depth of an edge is a row; only the first has another node's member for a parent.
    parents = full.select(F.col("ext").alias("lo"), F.col("x1").alias("q1"), F.col("x2").alias("q2"), F.col("conv_id").alias("above"))
    inner = full.where("lo > 0").join(parents, ["lo", "q1", "q2"])
    top = full.where("lo = 0").withColumn("above", F.lit(root[1] if root else None).cast("long"))
    rows = inner.unionByName(top).select("*", F.posexplode("e1").alias("at", "fp1"))
    before = F.when(F.col("at") > 0, F.element_at("e3", F.greatest(F.col("at"), F.lit(1)))).otherwise(F.col("q3"))
    last = F.col("at") == F.size("e1") - 1
    digests = _end_digests(whole.select("conv_id", *_KEY))
    rows = rows.select("conv_id", (F.col("lo") + F.col("at") + 1).alias("depth"), F.when(F.col("at") > 0, F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"),
                       "n_convs", F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
                       (F.col("saved") - (F.col("n_convs") - 1) * (before - F.col("q3"))).alias("saved_tokens"), "fp1", F.get("e2", F.col("at")).alias("fp2"))
    totals = full.agg(F.coalesce(F.sum(F.when(F.col("lo") == 0, F.col("saved"))), F.lit(0)), F.count_if(F.col("lo") == 0),
                      F.coalesce(F.sum(F.when(F.col("lo") == 0, F.col("n_leaves"))), F.lit(0))).first()
    one = spark.range(1 if root and root[0] else 0).select(*[F.lit(v).cast("long").alias(n) for n, v in (
        ("conv_id", root[1]), ("depth", 0), ("parent_conv_id", None), ("n_convs", root[0]), ("n_children", totals[1]),
        ("n_leaves", totals[2] or 1), ("saved_tokens", totals[0]), ("fp1", 0), ("fp2", 0))])
    return (rows.unionByName(one).join(digests, _KEY, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                    F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256")))
