"""Look-ups in values that hold for a span of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spans of one key that are compared one by one; keys with more use nested blocks of time.
FEW = 16
#: Times lie from 0 to below 2 to this power.
LEVELS = 40
FOREVER = (1 << LEVELS) - 1


def least_holder(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(point_id, holder): the least holder of the key at each point's time.

    ``points`` has point_id, key and at, ``spans`` key, holder, since and until; a span holds at
    times since < at <= until. Points without a holder are left out. A key with few spans is
    joined with them. For other keys each span is cut into at most 80 blocks whose lengths are
    powers of two, each block keeps its least holder, and a point looks into the 40 blocks that
    contain it: work grows with points plus spans, never with their product.
    """
    many = spans.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select("key")
    close = points.join(spans.join(many, "key", "left_anti"), "key").where("since < at and at <= until")
    found = close.select("point_id", "holder")

    low, high = F.greatest(F.col("since") + 1, F.lit(0)), F.least("until", F.lit(FOREVER)) + 1
    cut = spans.join(many, "key", "left_semi").select("key", "holder", low.alias("lo"), high.alias("hi"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    # At every level the blocks still open run from lo rounded up to hi rounded down; an odd end is taken.
    cut = cut.withColumns({"a": F.expr("shiftright(lo + shiftleft(1L, level) - 1, level)"), "b": F.expr("shiftright(hi, level)")}).where("a < b")
    ends = F.array_compact(F.array(F.when(F.col("a") % 2 == 1, F.col("a")), F.when((F.col("b") % 2 == 1) & (F.col("a") + F.col("a") % 2 < F.col("b")), F.col("b") - 1)))
    blocks = cut.select("key", "level", F.explode(ends).alias("block"), "holder").groupBy("key", "level", "block").agg(F.min("holder").alias("holder"))
    asked = points.join(many, "key", "left_semi").select("point_id", "key", "at", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    asked = asked.select("point_id", "key", "level", F.expr("shiftright(at, level)").alias("block"))
    found = found.unionByName(asked.join(blocks, ["key", "level", "block"]).select("point_id", "holder"))
    return found.groupBy("point_id").agg(F.min("holder").alias("holder"))
