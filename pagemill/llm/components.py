"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()


def roots(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of any orderable type to ``(a, b)``: node a belongs to the root b, the least node it reaches.

    Roots have no row of their own.  Self loops are ignored; an empty table gives an empty one.
    Each round is a written table, so a lost executor costs at most one round.  Hot nodes meet
    only a pre-aggregated minimum and a sort-merge join whose partitions can be split.
    """
    now = scratch.write("cc-0", edges.toDF("a", "b").where("a <> b").distinct())
    before = None
    for k in range(1, most_rounds + 1):
        now = scratch.write(f"cc-{k}", _small_star(_large_star(now)))
        scratch.drop(f"cc-{k - 1}")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now
        before = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
