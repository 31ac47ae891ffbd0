"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v: long); equal roots mean one component.

    Each round maps a node to the neighbour of least hash (or itself), relabels the edges and drops
    loops, so the graph shrinks by a constant share a round; the maps are then composed. Minima
    are partial aggregates, and edges meet the maps in sort-merge joins of written tables, which
    Spark splits where a node has very many edges.
    """
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    left = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select("u", "v").unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = materialize(ends.groupBy("u").agg(F.min(F.least(key("u"), key("v")))["id"].alias("to")).withColumnRenamed("u", "node"), "step")
        maps.append(step)
        a, b = step.select(F.col("node").alias("u"), F.col("to").alias("x")), step.select(F.col("node").alias("v"), F.col("to").alias("y"))
        moved = left.join(a, "u").join(b, "v").where("x <> y")
        fewer = materialize(moved.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        discard(left)
        left = fewer
    discard(left)
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    out = maps[0].select("node", F.col("to").alias("root"))
    for step in maps[1:]:
        out = out.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = materialize(out, "roots")
    discard(*maps)
    return out
