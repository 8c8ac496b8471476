"""Structural errors between two partially directed graphs, on edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bnspark.operators.graph import PDAG, both_ways, one_way, remove_arcs, reversed_arcs

ERRORS = ["SHD", "ME", "EE", "DE", "ED", "MD", "RD"]


def check_same_nodes(truth: DataFrame, predicted: DataFrame) -> None:
    """Node tables (id) must hold the same nodes; ValueError lists what is missing and what is extra."""
    missing = sorted(r[0] for r in truth.exceptAll(predicted).collect())
    extra = sorted(r[0] for r in predicted.exceptAll(truth).collect())
    if missing or extra:
        raise ValueError(f"node sets differ: missing {missing}, extra {extra}")


def _loopless(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src <> dst").distinct()


def split_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, kind): one-way arcs as `directed`, each undirected edge once, smaller end first."""
    arcs = _loopless(edges)
    lines = both_ways(arcs).where("src < dst")
    return one_way(arcs).withColumn("kind", F.lit("directed")).unionByName(lines.withColumn("kind", F.lit("undirected")))


def skeleton(edges: DataFrame) -> DataFrame:
    return _loopless(edges).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def v_structures(edges: DataFrame) -> DataFrame:
    """(a, mid, b), a < b: one-way arcs from both into mid, a and b not adjacent."""
    arcs = _loopless(edges)
    into = one_way(arcs)
    left, right = into.select(F.col("src").alias("a"), F.col("dst").alias("mid")), into.select(F.col("src").alias("b"), F.col("dst").alias("mid"))
    pairs = left.join(right, "mid").where("a < b")
    return pairs.join(skeleton(arcs).select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti").select("a", "mid", "b")


def pattern(edges: DataFrame) -> DataFrame:
    """The skeleton with the arcs of v-structures directed and all else undirected.  Nothing is closed
    under further orientation rules."""
    v = v_structures(edges)
    kept = v.select(F.col("a").alias("src"), F.col("mid").alias("dst")).unionByName(v.select(F.col("b").alias("src"), F.col("mid").alias("dst")))
    bones = skeleton(edges)
    return remove_arcs(bones.unionByName(reversed_arcs(bones)), reversed_arcs(kept))


def structural_errors(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: SHD, ME (missing), EE (extra), DE = ED + MD + RD, ED (directed though undirected), MD (the
    reverse) and RD (reversed), of the patterns of both graphs."""
    sides = []
    for graph, name in ((truth, "t"), (predicted, "p")):
        kinds = split_edges(pattern(graph))
        way = F.when(F.col("kind") == "undirected", 0).when(F.col("src") < F.col("dst"), 1).otherwise(-1)
        sides.append(kinds.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), way.alias(name)))
    both = sides[0].join(sides[1], ["a", "b"], "full")
    t, p = F.col("t"), F.col("p")
    counts = both.agg(
        F.count_if(p.isNull()).alias("ME"), F.count_if(t.isNull()).alias("EE"), F.count_if((t == 0) & (p != 0)).alias("ED"),
        F.count_if((t != 0) & (p == 0)).alias("MD"), F.count_if(t * p == -1).alias("RD"),
    )
    de = F.col("ED") + F.col("MD") + F.col("RD")
    return counts.withColumn("DE", de).withColumn("SHD", F.col("ME") + F.col("EE") + F.col("DE")).select(*ERRORS)


def pattern_of(graph: PDAG) -> PDAG:
    """The pattern of a small graph, on the driver.  Nodes are bits: an arc into v stays one-way if its tail
    has a partner among the other one-way tails of v that is not its neighbour."""
    tails = [0] * graph.num_vars  # of the arcs into a node
    near = [0] * graph.num_vars
    for u, v in graph.arcs():
        if u != v:
            tails[v] |= 1 << u
            near[u] |= 1 << v
            near[v] |= 1 << u
    pairs = [(u, v) for v in range(graph.num_vars) for u in range(graph.num_vars) if near[v] >> u & 1]
    out = PDAG(graph.num_vars, pairs)  # all both ways
    for v, ins in enumerate(tails):
        strict = sum(1 << u for u, w in pairs if w == v and ins >> u & 1 and not tails[u] >> v & 1)
        for u, w in pairs:
            if w == v and strict >> u & 1 and strict & ~near[u] & ~(1 << u):
                out.remove_edge(v, u)
    return out


def shd(truth: PDAG, predicted: PDAG) -> int:
    """Structural Hamming distance of the patterns of two small graphs."""
    if truth.num_vars != predicted.num_vars:
        raise ValueError("node sets differ")
    t, p = pattern_of(truth), pattern_of(predicted)
    return sum(
        (t.has_edge(a, b), t.has_edge(b, a)) != (p.has_edge(a, b), p.has_edge(b, a))
        for a in range(t.num_vars) for b in range(a + 1, t.num_vars)
    )


def structural_errors_of(truth: PDAG, predicted: PDAG) -> dict[str, int]:
    """The counts of structural_errors() for two small graphs, on the driver."""
    if truth.num_vars != predicted.num_vars:
        raise ValueError("node sets differ")
    t, p = pattern_of(truth), pattern_of(predicted)
    out = dict.fromkeys(ERRORS, 0)

    def way(g: PDAG, a: int, b: int) -> int | None:
        """0 for an undirected edge, 1 or -1 for an arc, None for no edge."""
        there, back = g.has_edge(a, b), g.has_edge(b, a)
        return there - back if there or back else None

    for a in range(t.num_vars):
        for b in range(a + 1, t.num_vars):
            x, y = way(t, a, b), way(p, a, b)
            if x == y:
                continue
            out["ME" if y is None else "EE" if x is None else "ED" if x == 0 else "MD" if y == 0 else "RD"] += 1
    out["DE"] = out["ED"] + out["MD"] + out["RD"]
    out["SHD"] = out["ME"] + out["EE"] + out["DE"]
    return out
