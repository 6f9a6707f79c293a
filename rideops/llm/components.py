"""Connected components of a link table, by stars, without gathering a component anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideops.session import cut_lineage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node, node) links with the components of the given links, one less than nodes."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, label = place[:len(a)], place[len(a):], np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, label[u], label[v])
        np.minimum.at(low, label[v], label[u])
        low = low[low]
        low = np.minimum(low, low[label])
        while (low[low] != low).any():
            low = low[low]
        if (low == label).all():
            break
        label = low
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            low, node = forest(*(batch.column(i).to_numpy() for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(node)], names=["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b) links; the component is its smallest node.

    Links are thinned to forests batch by batch, then large and small stars alternate until the
    links no longer change: in a large star a node links its greater neighbours to the least one,
    in a small star its smaller neighbours and itself. Rounds grow with the logarithm of the
    longest chain. A hub's links meet only a minimum, which Spark combines before the shuffle, and
    a join whose skewed side AQE splits. Self links and null ends are dropped; repeats don't matter.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("b"), F.least("a", "b").cast("long").alias("a"))
    edges = cut_lineage(edges.select("a", "b").mapInArrow(_contracted, "a long, b long").distinct())
    mark = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b")
        large = cut_lineage(large.unionAll(least.where("m <> a").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct())
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("x"), F.col("a").alias("y")).unionAll(small.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = cut_lineage(small.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
