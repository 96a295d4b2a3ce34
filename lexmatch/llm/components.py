"""Connected components of a graph given by its edges, by repeated hooking, pointer doubling and contraction.

In each round every node with a smaller neighbour hooks to the smallest one; hooks point strictly downwards, so they form trees,
which pointer doubling flattens. Edges are then renamed to the trees' roots, and loops and repeats drop out; rounds go on until no
edge is left. All steps are joins and aggregates with partial sums; every table that a join reads is written first, so both sides
of a join are plain exchanges, whose large partitions Spark can split when one root has very many nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmatch.llm import _common


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root) for each node of edges (a, b; longs) that isn't the smallest of its component; root is the smallest.

    Loops, repeats, either direction and null ends are allowed; edges with a null end are ignored. No edges give no rows. most: a
    bound on the number of edges, if known; no table of any round has more rows, so all are written in as few files as that needs.
    """
    spark = edges.sparkSession
    held, path = _common.materialize(_common.few(_plain(edges), most), "edges")
    found = None
    while not held.isEmpty():
        hooks, own = _flat(held.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "node"), most)
        if found is None:
            found, old = hooks, own
        else:
            moved = found.join(hooks.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left")
            merged = moved.select("node", F.coalesce("new", "root").alias("root")).unionByName(hooks)
            found, new = _common.materialize(_common.few(merged, most), "roots")
            _common.discard(spark, old)
            old = new
        left = held.join(hooks.select(F.col("node").alias("hi"), F.col("root").alias("to_hi")), "hi", "left")
        both = left.join(hooks.select(F.col("node").alias("lo"), F.col("root").alias("to_lo")), "lo", "left")
        fresh = both.select(F.coalesce("to_hi", "hi").alias("a"), F.coalesce("to_lo", "lo").alias("b"))
        held, new = _common.materialize(_common.few(_plain(fresh), most), "edges")
        _common.discard(spark, path)
        path = new
        if own != old:
            _common.discard(spark, own)
    _common.discard(spark, path)
    return found if found is not None else spark.createDataFrame([], "node long, root long")


def _plain(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def _flat(hooks: DataFrame, most: int | None) -> tuple[DataFrame, str]:
    """Doubles pointers (node, root) until each root is one that hooks nowhere."""
    spark = hooks.sparkSession
    now, path = _common.materialize(_common.few(hooks, most), "hooks")
    while True:
        step = now.join(now.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left")
        done = step.select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved"))
        after, new = _common.materialize(_common.few(done, most), "hooks")
        moved = not after.where("moved").isEmpty()
        _common.discard(spark, path)
        now, path = after.select("node", "root"), new
        if not moved:
            return now, path
