"""Connected components of an edge table, by alternating stars (Kiveris et al., 2014): each round hangs every node's
larger neighbours, then its smaller ones, under the smallest it knows. Each round is a written table, and so are the
minima that edges are joined with: both sides of a join are then plain exchanges, which the engine splits where a hub has
most of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.common import Scratch


def _least(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    return scratch.table(edges.groupBy("u").agg(F.min("v").alias("m")), name)


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, scratch, name).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, scratch, name)
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any orderable type to (node, root): every node that has an edge, and the least node it reaches.

    Edges to oneself and with nulls are ignored; repeated edges count once.
    """
    scratch = Scratch(edges.sparkSession, "stars")
    now = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "0")
    state, k = _state(now), 0
    while state[0]:
        k += 1
        large = scratch.table(_large_star(now, scratch, f"{k}-up"), f"{k}-large")
        after = scratch.table(_small_star(large, scratch, f"{k}-down"), str(k))
        for name in (str(k - 1), f"{k}-up", f"{k}-down", f"{k}-large"):
            scratch.drop(name)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
