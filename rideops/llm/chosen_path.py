"""Near-duplicate documents by a chosen-path set similarity join.

A document's shingle set has a signature of minwise tokens. In each of several independent trees a
node picks one coordinate of the signature, by a hash of the path so far, and sends each document to
the child its minwise token there selects: two documents of similarity s stay together with
probability s at each step. After a fixed number of steps all documents of a node are compared, by
one-bit sketches, however many they are. What the trees find are candidate clusters; a cluster's documents then meet once, with
their whole texts, and links are decided on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideops.llm.common import WordHasher, mixed, runs_of, text_bytes, tidy, tidy_group
from rideops.llm.components import connected_components, forest
from rideops.session import cut_lineage

#: Minwise tokens of a signature, independent trees, steps of a path, rows compared in one array.
TOKENS, TREES, STEPS, SMALL = 128, 28, 5, 1000
#: Documents of a node in one group; the parts of a larger node meet in pairs.
LARGE = 20_000
#: Equal sketch bits of a candidate pair: similarity 0.8 has 115 of 128 on average, deviation 3.4.
SKETCH_BITS = 102
#: Shingles of the documents of one block in the final comparison, and pivots shared by a cluster's blocks.
BLOCK_SHINGLES, PIVOTS = 2_000_000, 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOWER_TABLE = np.frombuffer(_LOWER, np.uint8)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    s = mixed(np.arange(1, 2 * TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (s[:TOKENS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (s[TOKENS:] >> np.uint64(32)).astype(np.uint32)


def shingle_hashes(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Distinct 64-bit shingle hashes of each document; one for a shorter document, none without words."""
    size = np.diff(offsets)
    parted = np.full(len(data) + len(size) + 1, 32, np.uint8)
    parted[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = _LOWER_TABLE[data]
    start, _, h = hasher(parted)
    cut = np.searchsorted(start, np.append(offsets[:-1] + np.arange(len(size)), len(parted)))
    rolled = h[:max(len(h) - words + 1, 0)].copy()
    for j in range(1, words):
        rolled = rolled * np.uint64(0x9FB21C651E98DF25) + h[j:len(h) - words + 1 + j]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a:b - words + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = mixed(np.array([whole]) * np.uint64(0x9FB21C651E98DF25) + x)[0]
            out.append(np.array([whole]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    return tuple(int(x.astype(np.int64)) for x in (np.add.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D))), np.add.reduce(mixed(s + np.uint64(len(s))))))


def _signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, best = (s >> np.uint64(32)).astype(np.uint32), None
    for i in range(0, len(x), 2048):
        least = (a[:, None] * x[None, i:i + 2048] + b[:, None]).min(1)
        best = least if best is None else np.minimum(best, least)
    return best


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, signature) of every row; d1, d2 name the set."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (a, b) = WordHasher(), _seeds()
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            sets = [s for lo, hi in runs_of(at) for s in shingle_hashes(hasher, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], words)]
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                pa.array([_signature(s, a, b).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "signature"])

    return docs.select("doc_id", "text").mapInArrow(tidy(convert), "doc_id long, n_shingles long, d1 long, d2 long, signature binary")


_TREE_SCHEMA = "rep long, node long, pack binary"
_STEP_ROW = np.dtype([("sketch", "<u8", (TOKENS // 64,)), ("n", "<u4")])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document and tree: the node its path ends in, its sketch and its size."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(n, TOKENS)
        rep, every = batch.column(0), np.arange(n)
        pack = np.zeros(n, _STEP_ROW)
        pack["sketch"] = np.packbits((mixed(sig.astype(np.uint64)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64)
        pack["n"] = batch.column(1).to_numpy()
        raw, width = pack.tobytes(), _STEP_ROW.itemsize
        packs = pa.array([raw[i * width:(i + 1) * width] for i in range(n)], pa.binary())
        for tree in range(TREES):
            path = np.full(n, mixed(np.array([tree + 1], np.uint64))[0])
            for _ in range(STEPS):
                token = sig[every, (path % np.uint64(TOKENS)).astype(np.int64)]
                path = mixed(path * np.uint64(0x9FB21C651E98DF25) + token)
            yield pa.RecordBatch.from_arrays([rep, pa.array(path.view(np.int64)), packs], names=["rep", "node", "pack"])


def _alike(sketch: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Rows i against rows j: enough equal bits, and sizes that allow the similarity."""
    differ = sum(np.bitwise_count(sketch[i, w][:, None] ^ sketch[j, w][None, :]).astype(np.int16) for w in range(sketch.shape[1]))
    a, b = size[i][:, None], size[j][None, :]
    return (differ <= TOKENS - SKETCH_BITS) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))


def _node_links(rep: np.ndarray, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all candidate pairs among the rows of one group."""
    sketch, size, rest = rows["sketch"], rows["n"].astype(np.int64), np.arange(len(rep))
    none = np.zeros(0, np.int64)
    if len(rest) <= SMALL:
        x, y = np.nonzero(np.triu(_alike(sketch, size, rest, rest, percent), 1))
        return forest(rep[x], rep[y]) if len(x) else (none, none)
    left, right = [], []  # breadth first, each row against what is not yet reached
    while len(rest):
        front, rest, root = rest[:1], rest[1:], rep[rest[0]]
        while len(front) and len(rest):
            hit = np.flatnonzero(_alike(sketch, size, front[:64], rest, percent).any(0))
            front = np.concatenate([front[64:], rest[hit]])
            left.append(np.full(len(hit), root))
            right.append(rep[rest[hit]])
            rest = np.delete(rest, hit)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def candidate_links(reps: DataFrame, percent: int) -> DataFrame:
    """(a, b) links whose components hold every candidate pair. ``reps``: (rep, n_shingles, signature).

    Documents meet where their paths end, after the same number of steps at any size of the input,
    and every pair of a node is compared. A node too large for one group is dealt into parts, and
    every two parts meet in a group of their own.
    """
    paths = reps.select("rep", "n_shingles", "signature").mapInArrow(tidy(_paths), _TREE_SCHEMA)
    parts = paths.groupBy("node").count().where(F.col("count") > LARGE).select("node", F.ceil(2 * F.col("count") / LARGE).alias("_parts"))
    dealt = paths.join(cut_lineage(parts), "node", "left").withColumn("_own", F.pmod(F.xxhash64("rep"), "_parts"))
    others = F.when(F.col("_parts").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
    met = dealt.withColumn("_other", F.explode(others))
    cell = F.when(F.col("_parts").isNull(), F.col("node")).otherwise(F.xxhash64("node", F.least("_own", "_other"), F.greatest("_own", "_other")))
    nodes = met.select(cell.alias("node"), "rep", "pack")

    buckets = 16 * int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare_many(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """All nodes of a bucket; nodes of one document have nothing to compare."""
        node, rep = table["node"].to_numpy(), table["rep"].to_numpy()
        rows = np.frombuffer(b"".join(table["pack"].to_pylist()), _STEP_ROW)
        order = np.argsort(node, kind="stable")
        cuts = np.flatnonzero(np.diff(node[order])) + 1
        left, right = [], []
        for part in np.split(order, cuts):
            if len(part) > 1:
                a, b = _node_links(rep[part], rows[part], percent)
                left.append(a)
                right.append(b)
        none = [np.zeros(0, np.int64)]
        a, b = np.concatenate(left or none), np.concatenate(right or none)
        a, b = forest(a, b) if len(a) else (a, b)
        return pa.table({"a": a, "b": b})

    return nodes.withColumn("_bucket", F.pmod(F.xxhash64("node"), F.lit(buckets))).groupBy("_bucket").applyInArrow(tidy_group(compare_many), "a long, b long")


def full_set_links(texts: list[bytes], words: int, percent: int, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all documents whose full sets are similar enough, as places in the list.

    One pivot is compared with all; then every document the pivot is not linked to. So each link has
    an end that was compared with all, or both its ends are linked to the pivot. With ``first``, only
    the documents before that place are compared with all.
    """
    ids: dict[tuple[bytes, ...], int] = {}
    sets = []
    for t in texts:
        w = t.translate(_LOWER).split()
        parts = set(zip(*(w[j:] for j in range(words)))) if len(w) >= words else {tuple(w)} if w else set()
        sets.append(np.fromiter((ids.setdefault(p, len(ids)) for p in parts), np.int64, len(parts)))
    n, size = len(sets), np.array([len(s) for s in sets])
    owner, flat = np.repeat(np.arange(n), size), np.concatenate(sets) if sets else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    posting, begin = owner[order], np.searchsorted(flat[order], np.arange(len(ids) + 1))

    def linked(i: int) -> np.ndarray:
        s = sets[i]
        count = begin[s + 1] - begin[s]
        at = np.repeat(begin[s] - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(posting[at], minlength=n)
        hit = (100 * both >= percent * (size + size[i] - both)) & (size > 0)
        hit[i] = False
        return np.flatnonzero(hit)

    left, right, todo = [], [], np.arange(n if first is None else first)
    if first is None and n > 1:
        tried = {i: linked(i) for i in sorted({0, n // 3, n // 2, n - 1}) if size[i]}
        if tried:
            pivot = max(tried, key=lambda i: len(tried[i]))
            left.append(np.full(len(tried[pivot]), pivot))
            right.append(tried[pivot])
            todo = np.setdiff1d(todo, np.append(tried[pivot], pivot))
    for i in todo:
        if size[i]:
            hit = linked(int(i))
            left.append(np.full(len(hit), i))
            right.append(hit)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def confirmed_links(docs: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) links of representatives decided on full sets. ``clusters``: (rep, d1, d2, n_shingles, cluster).

    Each cluster is cut into blocks by size; a few pivots stand in all of its blocks. Documents
    that this leaves outside the cluster's largest component are then dealt into half blocks of
    their own, and each of these meets every half block of the cluster, itself included: a cell
    holds two half blocks, however loose the cluster is.
    """
    spark = docs.sparkSession
    total = clusters.groupBy("cluster").agg(F.sum("n_shingles").alias("_sum"), F.count("*").alias("_count"))
    placed = clusters.join(total, "cluster").withColumn("_blocks", F.ceil(F.col("_sum") / BLOCK_SHINGLES))
    placed = cut_lineage(placed.withColumn("_block", F.pmod(F.xxhash64("rep"), F.col("_blocks"))).drop("_sum"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))

    def compare(rows: DataFrame) -> DataFrame:
        """``rows``: (rep, d1, d2, cluster, _blocks, _at, _all); those with _all are compared with the whole block, or, if none, all."""
        cell = F.xxhash64("cluster", "_at")  # small clusters share a group, a block of a large one has its own
        cell = F.when(F.col("_blocks") > 1, cell).otherwise(F.pmod(cell, F.lit(buckets)))
        joined = docs.select(F.col("doc_id").alias("rep"), "text").join(rows, "rep").withColumn("_bucket", cell)

        def links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            rep, cluster, block, d1, d2 = (table[c].to_numpy() for c in ("rep", "cluster", "_at", "d1", "d2"))
            whole, texts, hasher = table["_all"].to_numpy(zero_copy_only=False), table["text"], WordHasher()
            order, left, right = np.lexsort((rep, ~whole, block, cluster)), [], []
            cuts = np.flatnonzero((np.diff(cluster[order]) != 0) | (np.diff(block[order]) != 0)) + 1
            for part in np.split(order, cuts):
                if len(part) < 2:
                    continue
                batch = texts.take(pa.array(part))
                data, at = text_bytes(batch)
                named = [_digest(s) for lo, hi in runs_of(at) for s in shingle_hashes(hasher, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], words)]
                own = [k for k, i in enumerate(part) if named[k] == (d1[i], d2[i])]  # an id may come with several texts
                part = part[own]
                some = int(whole[part].sum())
                a, b = full_set_links([data[at[k]:at[k + 1]].tobytes() for k in own], words, percent, some if some < len(part) and some else None)
                if len(a):
                    a, b = forest(rep[part][a], rep[part][b])
                    left.append(a)
                    right.append(b)
            none = [np.zeros(0, np.int64)]
            return pa.table({"a": np.concatenate(left or none), "b": np.concatenate(right or none)})

        return joined.groupBy("_bucket").applyInArrow(tidy_group(links), "a long, b long")

    narrow = ("rep", "d1", "d2", "cluster", "_blocks")
    pivot = (F.col("_blocks") > 1) & (F.pmod(F.xxhash64(F.lit("pivot"), "rep"), F.col("_count")) < PIVOTS)
    once = placed.where(~pivot).select(*narrow, F.col("_block").alias("_at"), F.lit(False).alias("_all"))
    pivots = placed.where(pivot).select(*narrow, every.alias("_at"), F.lit(False).alias("_all"))
    links = cut_lineage(compare(once.unionAll(pivots)))
    wide = placed.where(F.col("_blocks") > 1)
    if wide.isEmpty():
        return links
    label = connected_components(links)
    wide = wide.join(label, wide["rep"] == label["node"], "left").withColumn("_label", F.coalesce("component", "rep"))
    main = (wide.groupBy("cluster", "_label").count().groupBy("cluster").agg(F.max_by("_label", F.struct("count", "_label")).alias("_main")))
    wide = wide.join(main, "cluster").withColumn("_all", F.col("_label") != F.col("_main"))
    return links.unionAll(compare(cells_of(cut_lineage(wide.select(*narrow, "n_shingles", "_all")))))


def cells_of(wide: DataFrame) -> DataFrame:
    """``wide``, whose rows with _all must meet all rows of their cluster, once per cell (_at) they stand in.

    Rows with _all are dealt into half blocks 0 .. r - 1, the others into r .. r + m - 1. Cells are
    the pairs of half blocks of which the first is below r.
    """
    half = [F.ceil(2 * F.sum(F.when(F.col("_all") == a, F.col("n_shingles")).otherwise(0)) / F.lit(BLOCK_SHINGLES)).alias(n) for a, n in ((True, "_r"), (False, "_m"))]
    dealt = wide.join(wide.groupBy("cluster").agg(*half).where("_r > 0"), "cluster")
    own = F.when(F.col("_all"), F.pmod(F.xxhash64(F.lit("half"), "rep"), F.col("_r"))).otherwise(F.col("_r") + F.pmod(F.xxhash64(F.lit("half"), "rep"), F.col("_m")))
    last = F.when(F.col("_all"), F.col("_r") + F.col("_m")).otherwise(F.col("_r")) - 1
    met = dealt.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    at = F.least("_own", "_other") * (F.col("_r") + F.col("_m")) + F.greatest("_own", "_other")
    return met.select("rep", "d1", "d2", "cluster", "_blocks", at.alias("_at"), "_all")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose word shingle sets have 100 * intersection >= ``percent`` * union.

    Words are split at white space, A-Z lowered. Returns per input row: doc_id, n_shingles (size of
    the set), component_id (smallest doc_id reachable by links, itself included), kept (doc_id =
    component_id). Null and empty texts have no shingles and link with nothing; a text of fewer
    words is one shingle. Rows of one id count as one document with the links of all of them; a
    null id links with nothing. Equal sets are one class from the start, so copies cost one row.
    """
    sets = cut_lineage(shingle_sets(docs, words))
    some = sets.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = cut_lineage(some.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")))
    clusters = connected_components(candidate_links(classes, percent))
    known = classes.select("rep", "d1", "d2", "n_shingles").join(clusters, F.col("rep") == F.col("node")).select(
        "rep", "d1", "d2", "n_shingles", F.col("component").alias("cluster"))
    members = some.select("doc_id", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"])
    several = members.groupBy("doc_id").agg(F.min("rep").alias("_low"), F.max("rep").alias("_high")).where("_low <> _high").select("doc_id")
    same = members.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = connected_components(confirmed_links(docs, known, words, percent).unionAll(same))
    out = (sets.select("doc_id", "n_shingles", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"], "left")
           .join(found, F.col("rep") == F.col("node"), "left"))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def recall(similarity: float, depth: float = STEPS, trees: int = TREES) -> float:
    """Share of pairs that meet in a node of at least one tree after ``depth`` steps."""
    return 1 - math.pow(1 - similarity ** depth, trees)
