"""d-separation: on the driver for small graphs, and as operations on edge tables."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bnspark.functions.combinatorics import mask_to_list
from bnspark.operators.graph import PDAG, closure
from bnspark.sources.shared import drop, materialize


def d_separated(dag: PDAG, x: int, y: int, given: Collection[int] = ()) -> bool:
    """Whether `given` separates x and y in a DAG: no path between them in the moral graph of the
    ancestors of all of these, once `given` is taken out."""
    n = dag.num_vars
    if not 0 <= x < n or not 0 <= y < n:
        raise IndexError("x or y is out of range")
    if any(not 0 <= z < n for z in given):
        raise IndexError("Z contains out-of-range index")
    if x in given or y in given:
        raise ValueError("x or y is in Z")
    old = frontier = sum(1 << v for v in {x, y, *given})
    while frontier:
        above = 0
        for v in mask_to_list(frontier):
            above |= dag.parents[v]
        frontier = above & ~old
        old |= above
    moral = [0] * n
    for v in mask_to_list(old):
        family = dag.parents[v] | 1 << v
        for u in mask_to_list(family):
            moral[u] |= family & ~(1 << u)
    blocked = sum(1 << z for z in set(given))
    seen = frontier = 1 << x
    while frontier:
        near = 0
        for v in mask_to_list(frontier):
            near |= moral[v]
        frontier = near & ~seen & ~blocked
        seen |= frontier
    return not seen >> y & 1


def ancestors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, ancestor), each node being one of its own."""
    return closure(edges, nodes).select(F.col("dst").alias("node"), F.col("src").alias("ancestor"))


def moral_graph(edges: DataFrame) -> DataFrame:
    """Undirected edges (a < b) between parents and children and between the parents of a child."""
    arcs = edges.select("src", "dst")
    kin = arcs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    left, right = arcs.select(F.col("src").alias("a"), "dst"), arcs.select(F.col("src").alias("b"), "dst")
    married = left.join(right, "dst").where("a < b").select("a", "b")
    return kin.unionByName(married).distinct()


def separated_table(edges: DataFrame, nodes: DataFrame, tests: DataFrame) -> DataFrame:
    """(test_id, separated) for tests (test_id, x, y, z array) over one DAG, all at once."""
    up = ancestors(edges, nodes)
    asked = tests.select("test_id", F.explode(F.array_union(F.array("x", "y"), F.col("z"))).alias("node"))
    old = asked.join(up, "node").select("test_id", F.col("ancestor").alias("id")).distinct()
    old = materialize(old, "old")
    arcs = old.withColumnRenamed("id", "src").join(edges.select("src", "dst"), "src").join(old.withColumnRenamed("id", "dst"), ["test_id", "dst"])
    kin = arcs.select("test_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    left, right = arcs.select("test_id", F.col("src").alias("a"), "dst"), arcs.select("test_id", F.col("src").alias("b"), "dst")
    moral = kin.unionByName(left.join(right, ["test_id", "dst"]).where("a <> b").select("test_id", "a", "b"))
    moral = moral.unionByName(moral.select("test_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    blocked = tests.select("test_id", F.explode("z").alias("b"))
    moral = materialize(moral.join(blocked, ["test_id", "b"], "left_anti"), "moral")
    seen = materialize(tests.select("test_id", F.col("x").alias("id")), "seen")
    n = seen.count()
    while True:
        near = seen.withColumnRenamed("id", "a").join(moral, ["test_id", "a"]).select("test_id", F.col("b").alias("id"))
        more = materialize(seen.unionByName(near).distinct(), "seen")
        grown = more.count()
        drop(seen)
        if grown == n:
            break
        seen, n = more, grown
    hit = more.withColumnRenamed("id", "y").withColumn("_hit", F.lit(True))
    return tests.join(hit, ["test_id", "y"], "left").select("test_id", F.col("_hit").isNull().alias("separated"))
