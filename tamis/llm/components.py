"""Connected components of an edge list by contraction, in DataFrame operations only.

Each round points every node at its neighbour of least priority (a seeded hash, so pointer
chains stay short whatever the ids are), shortens the pointers twice, replaces the edges'
ends by what they point at, and drops edges inside a group. The edges shrink by a constant
factor a round. Rounds are written to the shared folder, which cuts the lineage. A node with
a great many edges is no hot spot: neighbours are reduced by a partial aggregate, and the
joins are plain equi-joins that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tamis.llm.frames import materialize


def _priority(col):
    return F.struct(F.xxhash64(F.lit(11), col).alias("h"), col.alias("id"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; a component's name is one of its nodes."""
    spark = edges.sparkSession
    e = materialize(spark, edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    nodes = None
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        to = both.groupBy("a").agg(F.min(_priority(F.col("b"))).alias("m"))
        to = materialize(spark, to.select(F.col("a").alias("node"), F.least(F.col("m"), _priority(F.col("a")))["id"].alias("to")), "pointers")
        for _ in range(2):
            next_ = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
            to = to.join(next_, "to").select("node", F.col("next").alias("to"))
        to = materialize(spark, to, "pointers")
        left, right = to.select(F.col("node").alias("a"), F.col("to").alias("x")), to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        e = materialize(spark, e.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        if nodes is None:
            nodes = to.select("node", F.col("to").alias("component"))
        else:
            step = to.select(F.col("node").alias("component"), F.col("to").alias("_next"))
            nodes = nodes.join(step, "component", "left").select("node", F.coalesce("_next", "component").alias("component"))
    if nodes is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes
