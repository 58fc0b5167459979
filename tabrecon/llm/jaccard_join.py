"""Exact Jaccard join on word shingles by multiple-global-order filtering.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct
``width``-word shingles. In any total order of all shingles, linked sets share a shingle within
their prefixes (the first ``n - ceil(percent * n / 100) + 1``). Three orders are used, all by
number of documents, rare first, and each with its own order among equals. Shingles of one
document come first and match nothing, so most documents have no prefix to join on at all; the
candidates of the first order must also share a prefix shingle under the other two before their
sets are compared.

1. One pass over the texts (:func:`_shingles`): each batch sends its shingle hashes to hash
   buckets as dense arrays, those frequent in the batch once with their count. Buckets count
   documents and answer with the shingles that more than one document has; a batch's answers
   give each document its prefix and its shared shingles, from which intersections are exact.
2. Equal sets (by a 128-bit fingerprint) are one class with one representative.
3. Connected components: the pairs of short posting lists are compared at once. In a long one
   every member is first compared with a hub. Of lists that are not in one component after
   that, the documents are dealt into bounded blocks, and in each pair of blocks every pair
   that shares a prefix shingle is compared unless it is connected by then. No link between
   components is lost, and no pair within a group becomes a row.

Shingle hashes have 64 bits, 40 bits and a bucket number after dealing out. Empty and null texts
have no shingles and link with nothing; fewer words than ``width`` make one shingle. Repeated
rows are equal sets. Rows are told apart by their place in the input, so ids may repeat; a null
id is never the least of its component. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, bounded_batches, cut, release, text_of, word_index, worker_state
from .components import connected

HOT_IN_BATCH = 16                 # documents of a batch that share a shingle, from which it is sent once
PIECE_BYTES = 2 << 20             # text of a batch that is sent together
CHARS_PER_BUCKET = 8_000_000      # about 1.2 million shingles in English text
SHORT_LIST = 8                    # posting lists up to here are compared pair by pair at once
BLOCK = 400                       # documents of a cluster compared as one side of a group
_ID_BITS = 40
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * factor
        x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


def word_hashes(cap: int = 150_000) -> WordCache:
    import xxhash

    # Only A-Z is lower-cased, as bytes do it.
    return WordCache(lambda words: [xxhash.xxh64_digest(w.encode("utf-8", "surrogatepass").lower()) for w in words], cap)


def shingle_sets(texts: pa.Array, cache: WordCache, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of each text, sorted by row, then hash. Words are
    lower-cased (A-Z) and parted by white space (0x20, 0x09-0x0D)."""
    distinct, index, offsets = word_index(texts)
    known = cache.ensure(distinct)
    counts = np.diff(offsets)
    words = np.frombuffer(b"".join([known[w] for w in distinct]), dtype="<u8").astype(np.uint64)[index]
    row = np.repeat(np.arange(len(texts)), counts)
    hashes, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= width:
        n = len(words) - width + 1
        whole = row[:n] == row[width - 1:]
        h = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            h = mixed(h, _M3) + words[k:k + n]
        hashes, rows = mixed(h[whole], _M2), row[:n][whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        import xxhash

        one = [xxhash.xxh64_intdigest(words[offsets[i]:offsets[i + 1]].tobytes(), seed=int(counts[i])) for i in short]
        hashes, rows = np.concatenate([hashes, np.array(one, dtype=np.uint64)]), np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], rows[new]


_SENT = ("bucket int, batch long, low binary, high binary, docs binary, df binary, hot binary, hot_n binary, "
         "doc_ids array<bigint>, sizes binary, prints binary, home_hot binary, home_docs binary")
_HOME = ("doc_ids", "sizes", "prints", "home_hot", "home_docs")


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _batch_rows(doc_ids: list, texts: pa.Array, cache: WordCache, width: int, batch: int, buckets: int) -> list[dict]:
    """What a batch sends: a row for each bucket that its shingles fall into, and its own."""
    hashes, rows = shingle_sets(texts, cache, width)
    sizes = np.bincount(rows, minlength=len(texts)).astype("<u4")
    prints = np.zeros((len(texts), 2), dtype="<u8")
    filled = np.flatnonzero(sizes)
    if len(filled):
        starts = np.searchsorted(rows, filled)
        for j, m in enumerate((_M2, _M3)):
            prints[filled, j] = np.add.reduceat(mixed(hashes, m), starts)
    # Of equal sets in the batch only the first is sent: the others are in its class anyway.
    _, first = np.unique(np.column_stack([prints, sizes.astype("<u8")]), axis=0, return_index=True)
    own = np.isin(rows, first)
    hashes, rows = hashes[own], rows[own]
    bucket = ((hashes >> np.uint64(_ID_BITS)).astype(np.int64) * buckets) >> (64 - _ID_BITS)
    ids = hashes & np.uint64((1 << _ID_BITS) - 1)
    keys = (bucket.astype(np.uint64) << np.uint64(_ID_BITS)) | ids
    order = np.lexsort((rows, bucket))
    ids, keys, bucket, rows = ids[order], keys[order], bucket[order], rows[order]
    seen, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    hot = times[inverse] >= HOT_IN_BATCH
    hot_keys, hot_times = seen[times >= HOT_IN_BATCH], times[times >= HOT_IN_BATCH].astype("<u4")
    home = {"bucket": batch % buckets, "batch": batch, "doc_ids": doc_ids, "sizes": sizes.tobytes(), "prints": prints.tobytes(),
            "home_hot": keys[hot].astype("<u8").tobytes(), "home_docs": rows[hot].astype("<u2").tobytes()}
    out = [home]
    ids, bucket, rows = ids[~hot], bucket[~hot], rows[~hot]
    hot_bucket = (hot_keys >> np.uint64(_ID_BITS)).astype(np.int64)
    present = np.unique(np.concatenate([bucket, hot_bucket]))
    cuts = [np.searchsorted(x, present, side=side).tolist() for x in (bucket, hot_bucket) for side in ("left", "right")]
    for b, at, to, hot_at, hot_to in zip(present.tolist(), *cuts, strict=True):
        x, y = slice(at, to), slice(hot_at, hot_to)
        out.append({"bucket": b, "batch": batch, "low": (ids[x] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
                    "high": (ids[x] >> np.uint64(32)).astype("u1").tobytes(), "docs": rows[x].astype("<u2").tobytes(),
                    "hot": hot_keys[y].astype("<u8").tobytes(), "hot_n": hot_times[y].tobytes()})
    return out


def _count_in_bucket(table: pa.Table) -> pa.Table:
    """Answers to each batch: its shingles that several documents have, and in how many."""
    rows = table.to_pylist()
    data = [r for r in rows if r["low"] is not None]
    ids = [np.frombuffer(r["low"], "<u4").astype(np.uint64) | (np.frombuffer(r["high"], "u1").astype(np.uint64) << np.uint64(32))
           for r in data]
    hot = [np.frombuffer(r["hot"], "<u8") & np.uint64((1 << _ID_BITS) - 1) for r in data]
    weights = [np.ones(len(x)) for x in ids] + [np.frombuffer(r["hot_n"], "<u4") for r in data]
    out = [r for r in rows if r["low"] is None]
    if data:
        _, inverse = np.unique(np.concatenate(ids + hot), return_inverse=True)
        df = np.bincount(inverse, np.concatenate(weights))[inverse].astype("<u4")
        cuts = np.cumsum([len(x) for x in ids + hot])[:-1]
        parts = np.split(df, cuts)
        for r, own, n, hot_n in zip(data, ids, parts[:len(data)], parts[len(data):], strict=True):
            several = n > 1
            if several.any() or len(hot_n):
                out.append(r | {"low": (own[several] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
                                "high": (own[several] >> np.uint64(32)).astype("u1").tobytes(),
                                "docs": np.frombuffer(r["docs"], "<u2")[several].tobytes(),
                                "df": n[several].tobytes(), "hot_n": hot_n.tobytes()})
    return pa.Table.from_pylist(out, schema=_arrow_schema(_SENT))


def prefix_size(n, percent: int):
    """Length of the prefix in which linked sets of ``n`` shingles must meet."""
    return n - -(-percent * n // 100) + 1


_DOCS = "uid long, doc_id long, n int, print1 long, print2 long, prefix array<bigint>, keys binary, df binary"


def _documents_of_batch(table: pa.Table, percent: int) -> pa.Table:
    """A row per document: set size, fingerprint, the shared shingles of its prefix, and, if it
    has any, all its shared shingles, rare first."""
    rows = table.to_pylist()
    home = next(r for r in rows if r["sizes"] is not None)
    sizes = np.frombuffer(home["sizes"], "<u4").astype(np.int64)
    prints = np.frombuffer(home["prints"], "<u8").reshape(-1, 2).view("<i8")
    keys, docs, df, hot, hot_df = [], [], [], [], []
    for r in rows:
        if r["low"] is not None:
            low = np.frombuffer(r["low"], "<u4").astype(np.uint64)
            high = np.frombuffer(r["high"], "u1").astype(np.uint64) << np.uint64(32)
            keys.append(low | high | np.uint64(r["bucket"] << _ID_BITS))
            docs.append(np.frombuffer(r["docs"], "<u2").astype(np.int64))
            df.append(np.frombuffer(r["df"] or b"", "<u4"))
            hot.append(np.frombuffer(r["hot"], "<u8"))
            hot_df.append(np.frombuffer(r["hot_n"], "<u4"))
    if hot and len(home["home_hot"]):
        hot_keys, hot_counts = np.concatenate(hot), np.concatenate(hot_df)
        order = np.argsort(hot_keys)
        own = np.frombuffer(home["home_hot"], "<u8")
        keys.append(own.astype(np.uint64))
        docs.append(np.frombuffer(home["home_docs"], "<u2").astype(np.int64))
        df.append(hot_counts[order][np.searchsorted(hot_keys[order], own)])
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    keys, docs, df = join(keys, np.uint64), join(docs, np.int64), join(df, np.int64)
    order = np.lexsort((keys, df, docs))
    keys, docs, df = keys[order], docs[order], df[order]
    bounds = np.searchsorted(docs, np.arange(len(sizes) + 1))
    shared = np.diff(bounds)
    taken = np.clip(prefix_size(sizes, percent) - (sizes - shared), 0, shared)
    taken[sizes == 0] = 0
    out = {c: [] for c in ("uid", "doc_id", "n", "print1", "print2", "prefix", "keys", "df")}
    for i, doc_id in enumerate(home["doc_ids"]):
        a, b, t = bounds[i], bounds[i + 1], int(taken[i])
        row = ((home["batch"] << 16) | i, doc_id, int(sizes[i]), int(prints[i, 0]), int(prints[i, 1]),
               keys[a:a + t].astype(np.int64).tolist(), keys[a:b].astype("<u8").tobytes() if t else None,
               df[a:b].astype("<u4").tobytes() if t else None)
        for column, value in zip(out.values(), row, strict=True):
            column.append(value)
    return pa.Table.from_pydict(out, schema=_arrow_schema(_DOCS))


def _shingles(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    bounded_batches(docs)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(text).alias("text"))
    buckets = 1 + int(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // CHARS_PER_BUCKET

    def send(batches):
        cache = worker_state("jaccard words", 0, word_hashes)
        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            size = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.concatenate([[0], np.searchsorted(size, np.arange(PIECE_BYTES, size[-1] if len(size) else 0, PIECE_BYTES)) + 1,
                                             [b.num_rows]]))
            for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                piece = b.slice(at, to - at)
                if piece.num_rows:
                    sent = _batch_rows(piece.column(0).to_pylist(), piece.column(1), cache, width,
                                       part << 22 | number, buckets)
                    number += 1
                    yield from pa.Table.from_pylist(sent, schema=_arrow_schema(_SENT)).to_batches()

    sent = rows.mapInArrow(send, _SENT)
    answers = sent.groupBy("bucket").applyInArrow(_count_in_bucket, _SENT)
    return answers.groupBy("batch").applyInArrow(lambda t: _documents_of_batch(t, percent), _DOCS)


def overlap(keys_a: bytes, df_a: bytes, n_a: int, keys_b: bytes, df_b: bytes, n_b: int, percent: int) -> int:
    """Size of the intersection, or -1 if some order's prefixes have nothing in common."""
    a, b = np.frombuffer(keys_a, "<u8"), np.frombuffer(keys_b, "<u8")
    p_a, p_b = prefix_size(n_a, percent) - (n_a - len(a)), prefix_size(n_b, percent) - (n_b - len(b))
    for m in (_M2, _M3):  # the order of the join itself is met by every candidate
        first = []
        for x, df, p in ((a, df_a, p_a), (b, df_b, p_b)):
            order = np.lexsort((mixed(x, m), np.frombuffer(df, "<u4")))
            first.append(x[order[:p]])
        if not np.isin(first[0], first[1]).any():
            return -1
    return len(np.intersect1d(a, b))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, with ``salts`` of a) whose sets link. A hub's set is sent once per salt."""
    hubs = pairs.groupBy("a").agg(F.max("salts").alias("salts"))
    copies = (sets.withColumnRenamed("uid", "a").join(hubs, "a")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"))
    other = sets.select(F.col("uid").alias("b"), F.col("n").alias("n_b"), F.col("keys").alias("keys_b"), F.col("df").alias("df_b"))
    both = (pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
            .join(other, "b").join(copies, ["a", "salt"]))

    def check(batches):
        for batch in batches:
            links = [(r["a"], r["b"]) for r in batch.to_pylist()
                     if (both := overlap(r["keys"], r["df"], r["n"], r["keys_b"], r["df_b"], r["n_b"], percent)) >= 0
                     and 100 * both >= percent * (r["n"] + r["n_b"] - both)]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in links], pa.int64()),
                                              "b": pa.array([x[1] for x in links], pa.int64())})

    return both.select("a", "b", "n", "n_b", "keys", "keys_b", "df", "df_b").mapInArrow(check, "a long, b long")


def _contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (uid, comp) after merging the components that ``links`` (a, b) join."""
    of = lambda side: labels.select(F.col("uid").alias(side), F.col("comp").alias(f"c{side}"))
    merged = connected(links.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    merged = merged.select(F.col("uid").alias("comp"), F.col("comp").alias("to"))
    return cut(labels.join(merged, "comp", "left").select("uid", F.coalesce("to", "comp").alias("comp")))


def _fits(percent: int):
    return 100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")


def _short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of the short lists, each once."""
    one = lists.select("key", F.col("uid").alias("a"), "n")
    other = lists.select("key", F.col("uid").alias("b"), F.col("n").alias("n_b"))
    return (one.join(other, (one["key"] == other["key"]) & (one["a"] < other["b"]) & _fits(percent))
            .select("a", "b").distinct().withColumn("salts", F.lit(1)))


def _open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of lists that are not in one component yet, with their component."""
    now = lists.join(labels, "uid")
    open_ = (now.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"))
             .where("c1 <> c2").select("key"))
    return cut(now.join(open_, "key", "left_semi"))


def _hub_pairs(lists: DataFrame, round_: int, percent: int) -> DataFrame:
    """Each list's members with its hub of this round, where not yet in one component."""
    priority = F.struct(F.xxhash64("uid", F.lit(round_)).alias("order"), "uid", "n", "comp")
    hubs = lists.groupBy("key").agg(F.min(priority).alias("hub"), F.count(F.lit(1)).alias("size"))
    hubs = hubs.select("key", F.col("hub.uid").alias("a"), F.col("hub.n").alias("n_b"), F.col("hub.comp").alias("comp_a"),
                       F.ceil(F.col("size") / 512).cast("int").alias("salts"))
    return (lists.join(cut(hubs), "key").where((F.col("comp") != F.col("comp_a")) & _fits(percent))
            .groupBy("a", F.col("uid").alias("b")).agg(F.max("salts").alias("salts")))


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """Links between components among the documents of one or two blocks, as few as connect them.

    Pairs come from posting lists of prefix shingles, each once; a pair whose documents are
    connected by then is not compared."""
    rows = table.to_pylist()
    one = rows[0]["i"] == rows[0]["j"]
    n = np.array([r["n"] for r in rows], dtype=np.int64)
    block = np.array([r["block"] for r in rows])
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    comp = [r["comp"] for r in rows]
    keys = [np.frombuffer(r["keys"], "<u8") for r in rows]
    size = [prefix_size(int(k), percent) - (int(k) - len(x)) for k, x in zip(n, keys, strict=True)]
    others = [[np.sort(x[np.lexsort((mixed(x, m), np.frombuffer(r["df"], "<u4")))[:p]]) for m in (_M2, _M3)]
              for r, x, p in zip(rows, keys, size, strict=True)]
    token = np.concatenate([x[:p] for x, p in zip(keys, size, strict=True)])
    doc = np.repeat(np.arange(len(rows)), size)
    order = np.lexsort((doc, token))
    token, doc = token[order], doc[order]
    cuts = np.flatnonzero(token[1:] != token[:-1]) + 1
    done = np.zeros((len(rows), len(rows)), dtype=bool)
    links = []
    for posting in np.split(doc, cuts):
        if len(posting) < 2:
            continue
        roots = np.array([find(comp[d]) for d in posting.tolist()])
        if (roots == roots[0]).all():
            continue
        x, y = np.triu_indices(len(posting), 1)
        a, b = posting[x], posting[y]
        open_ = (roots[x] != roots[y]) & ~done[a, b] & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        if not one:
            open_ &= block[a] != block[b]
        a, b = a[open_], b[open_]
        done[a, b] = True
        for d, e in zip(a.tolist(), b.tolist(), strict=True):
            ra, rb = find(comp[d]), find(comp[e])
            if ra == rb or not all(np.isin(f, g, assume_unique=True).any() for f, g in zip(others[d], others[e], strict=True)):
                continue
            both = len(np.intersect1d(keys[d], keys[e], assume_unique=True))
            if 100 * both >= percent * (n[d] + n[e] - both):
                parent[max(ra, rb)] = min(ra, rb)
                links.append((rows[d]["uid"], rows[e]["uid"]))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _links_in_blocks(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links that open lists may still hold. Documents that lists connect form a cluster; a
    cluster is dealt into blocks of about ``BLOCK`` documents, and each pair of blocks is one
    group, so a group's size is bounded and no pair becomes a row."""
    star = lists.groupBy("key").agg(F.min("uid").alias("a"))
    edges = cut(lists.join(star, "key").select("a", F.col("uid").alias("b")).where("a <> b").distinct())
    docs = cut(lists.groupBy("uid").agg(F.first("comp").alias("comp")))
    clusters = _contract(docs.select("uid", F.col("uid").alias("comp")), edges).withColumnRenamed("comp", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = (clusters.join(sizes, "cluster").join(docs, "uid")
              .withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")))
    dealt = (placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("uid", "comp", "cluster", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j")))
    groups = dealt.join(sets, "uid").groupBy("cluster", "i", "j")
    return groups.applyInArrow(lambda t: _block_links(t, percent), "a long, b long")


def join_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75,
                    hub_rounds: int = 1) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (place of the first with an equal set)
    and component_id, the least id that links reach."""
    table = cut(_shingles(docs, doc_id, text, width, percent))
    release(docs.sparkSession)
    same = ["print1", "print2", "n"]
    classes = cut(table.where("n > 0").groupBy(*same).agg(F.min("uid").alias("rep"), F.min("doc_id").alias("first_id")))
    sets = table.where("keys is not null").join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi")
    sets = sets.select("uid", "n", "keys", "df", "prefix")
    lists = sets.select("uid", "n", F.explode("prefix").alias("key"))
    several = lists.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    lists = cut(lists.join(several, "key"))
    sets = cut(sets.drop("prefix").join(lists.select("uid").distinct(), "uid", "left_semi"))
    labels = cut(sets.select("uid", F.col("uid").alias("comp")))
    release(docs.sparkSession)
    long_lists = lists.where(F.col("size") > SHORT_LIST).drop("size")
    pairs = _short_pairs(lists.where(F.col("size") <= SHORT_LIST), percent)
    for round_ in range(hub_rounds):
        open_ = _open_lists(long_lists, labels)
        if not open_.isEmpty():
            more = _hub_pairs(open_, round_, percent)
            pairs = more if pairs is None else pairs.union(more).groupBy("a", "b").agg(F.max("salts").alias("salts"))
        elif pairs is None:
            break
        labels = _contract(labels, cut(_verified(cut(pairs), sets, percent)))
        pairs = None
        release(docs.sparkSession)
    open_ = _open_lists(long_lists, labels)
    if not open_.isEmpty():
        labels = _contract(labels, cut(_links_in_blocks(open_, sets, percent)))
        release(docs.sparkSession)
    if pairs is not None:
        labels = _contract(labels, cut(_verified(cut(pairs), sets, percent)))
    named = classes.join(labels.withColumnRenamed("uid", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    least = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = cut(named.join(least, "comp").select(*same, F.col("rep").alias("class_id"), "component_id"))
    return (table.select("doc_id", "uid", *same).join(named, same, "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "uid").alias("class_id"),
                    F.coalesce("component_id", "doc_id").alias("component_id")))
