"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """(node, component) for every node of ``links`` (a, b); component = smallest node reachable.

    Large-star joins each larger neighbour to the smallest neighbour; small-star
    does so for the smaller ones.  Minima are taken with partial aggregation
    and joined back, so the centre of a huge star is one row per task.  Each
    round is a stored table; the loop ends when a round changes nothing.
    No links give an empty table.
    """
    edges = (links.where(F.col("a") != F.col("b"))
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    edges, path = scratch.store(edges)
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (both.where(F.col("b") > F.col("a")).join(low.hint("merge"), "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low2.hint("merge"), "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a != b").distinct())
        nxt, nxt_path = scratch.store(small)
        new = _mark(nxt)
        scratch.drop(path)
        edges, path = nxt, nxt_path
        if new == mark:
            break
        mark = new
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out, out_path = scratch.store(nodes.union(roots))
    scratch.drop(path)
    return out, out_path
