"""Partially directed graphs: small ones on the driver, and edge tables (src, dst).

An undirected edge is two arcs, one each way.  "One-way" arcs have no arc back.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bnspark.functions.combinatorics import mask_to_list
from bnspark.sources.shared import drop, materialize


class PDAG:
    """Arcs as bit masks: bit u of parents[v] is set if there is an arc u -> v."""

    def __init__(self, num_vars: int | PDAG, arcs: Iterable[tuple[int, int]] = ()):
        if isinstance(num_vars, PDAG):
            self.num_vars, self.parents = num_vars.num_vars, list(num_vars.parents)
        else:
            self.num_vars, self.parents = num_vars, [0] * num_vars
        for u, v in arcs:
            self.add_edge(u, v)

    @classmethod
    def complete(cls, n: int) -> PDAG:
        out = cls(n)
        out.parents = [((1 << n) - 1) & ~(1 << v) for v in range(n)]
        return out

    @classmethod
    def from_edges(cls, n: int, edges: DataFrame) -> PDAG:
        return cls(n, [(r[0], r[1]) for r in edges.select("src", "dst").collect()])

    def __eq__(self, other: object) -> bool:
        return isinstance(other, PDAG) and (self.num_vars, self.parents) == (other.num_vars, other.parents)

    def __hash__(self) -> int:
        return hash((self.num_vars, *self.parents))

    def __repr__(self) -> str:
        return f"PDAG({self.num_vars}, {self.arcs()})"

    def _check(self, *nodes: int) -> None:
        if any(not 0 <= v < self.num_vars for v in nodes):
            raise IndexError("PDAG index out of range")

    # What any graph offers: arcs as a set.
    def has_edge(self, src: int, dst: int) -> bool:
        self._check(src, dst)
        return bool(self.parents[dst] >> src & 1)

    def add_edge(self, src: int, dst: int) -> None:
        self._check(src, dst)
        self.parents[dst] |= 1 << src

    def remove_edge(self, src: int, dst: int) -> None:
        self._check(src, dst)
        self.parents[dst] &= ~(1 << src)

    def arcs(self) -> list[tuple[int, int]]:
        return sorted((u, v) for v in range(self.num_vars) for u in mask_to_list(self.parents[v]))

    def edges(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.arcs(), "src int, dst int")

    # Kinds of edges.
    has_directed_edge = has_edge

    def has_undirected_edge(self, u: int, v: int) -> bool:
        return self.has_edge(u, v) and self.has_edge(v, u)

    def is_adjacent(self, u: int, v: int) -> bool:
        return self.has_edge(u, v) or self.has_edge(v, u)

    def add_directed_edge(self, u: int, v: int) -> None:
        if self.has_edge(u, v):
            raise ValueError("arc already exists")
        self.add_edge(u, v)

    def remove_directed_edge(self, u: int, v: int) -> None:
        if not self.has_edge(u, v):
            raise ValueError("arc not found")
        self.remove_edge(u, v)

    def add_undirected_edge(self, u: int, v: int) -> None:
        if self.has_undirected_edge(u, v):
            raise ValueError("edge already exists")
        self.add_directed_edge(u, v)
        self.add_directed_edge(v, u)

    def remove_undirected_edge(self, u: int, v: int) -> None:
        if not self.has_undirected_edge(u, v):
            raise ValueError("edge not found")
        self.remove_edge(u, v)
        self.remove_edge(v, u)

    def orient_edge(self, u: int, v: int) -> None:
        """u - v becomes u -> v; anything else stays as it is."""
        if self.has_undirected_edge(u, v):
            self.remove_edge(v, u)

    # Neighbourhoods, ascending.
    def _children(self, u: int) -> int:
        return sum(1 << v for v in range(self.num_vars) if self.parents[v] >> u & 1)

    def successors(self, u: int) -> list[int]:
        self._check(u)
        return mask_to_list(self._children(u))

    def predecessors(self, u: int) -> list[int]:
        self._check(u)
        return mask_to_list(self.parents[u])

    def neighbors(self, u: int) -> list[int]:
        self._check(u)
        return mask_to_list(self._children(u) | self.parents[u])

    all_neighbors = neighbors

    def undirected_neighbors(self, u: int, without: int | None = None) -> list[int]:
        self._check(u)
        mask = self._children(u) & self.parents[u]
        return [v for v in mask_to_list(mask) if v != without]

    def directed_parents(self, u: int) -> list[int]:
        self._check(u)
        return mask_to_list(self.parents[u] & ~self._children(u))

    def directed_children(self, u: int) -> list[int]:
        self._check(u)
        return mask_to_list(self._children(u) & ~self.parents[u])

    def set_parents(self, v: int, parents: Iterable[int]) -> None:
        self.parents[v] = sum(1 << u for u in set(parents))

    # Reachability; each node reaches itself.
    def _reaches(self, s: int, t: int, step) -> bool:
        self._check(s, t)
        seen = frontier = 1 << s
        while frontier and not seen >> t & 1:
            frontier = sum(1 << v for v in {w for u in mask_to_list(frontier) for w in step(u)}) & ~seen
            seen |= frontier
        return bool(seen >> t & 1)

    def has_directed_path(self, s: int, t: int) -> bool:
        """Along one-way arcs alone."""
        return self._reaches(s, t, self.directed_children)

    def has_path(self, s: int, t: int) -> bool:
        """Along arcs; undirected edges lead both ways."""
        return self._reaches(s, t, self.successors)

    def has_connection(self, s: int, t: int) -> bool:
        return self._reaches(s, t, self.neighbors)

    def is_ancestor(self, u: int, of: int) -> bool:
        """Whether u is `of` or an ancestor of it."""
        return self._reaches(of, u, self.predecessors)

    def creates_unshielded_collider(self, y: int, z: int) -> bool:
        """Whether z -> y would meet an arc x -> y, x one-way and not adjacent to z."""
        return any(x != z and not self.is_adjacent(x, z) for x in self.directed_parents(y))

    def apply_meek_rules(self, rule4: bool = True) -> None:
        """Close under Meek's rules in their textbook form, until nothing changes."""
        changed = True
        while changed:
            changed = False
            for a in range(self.num_vars):
                for b in self.undirected_neighbors(a):
                    if self._meek(a, b, rule4):
                        self.orient_edge(a, b)
                        changed = True

    def _meek(self, a: int, b: int, rule4: bool) -> bool:
        """Whether a rule turns a - b into a -> b."""
        into_a, into_b = self.directed_parents(a), self.directed_parents(b)
        if any(c != b and not self.is_adjacent(c, b) for c in into_a):
            return True  # c -> a - b
        if any(self.has_edge(a, c) and not self.has_edge(c, a) for c in into_b):
            return True  # a -> c -> b
        sides = [c for c in into_b if self.has_undirected_edge(a, c)]
        if any(not self.is_adjacent(c, d) for i, c in enumerate(sides) for d in sides[i + 1 :]):
            return True  # a - c -> b, a - d -> b, c and d apart
        if rule4:
            for c in into_b:  # a - d -> c -> b, d and b apart
                for d in self.directed_parents(c):
                    if d != b and self.has_undirected_edge(a, d) and not self.is_adjacent(d, b) and self.is_adjacent(a, c):
                        return True
        return False


# Edge tables.


def complete_graph(nodes: DataFrame) -> DataFrame:
    """All arcs between different nodes (id)."""
    a, b = nodes.select(F.col("id").alias("src")), nodes.select(F.col("id").alias("dst"))
    return a.join(b, F.col("src") != F.col("dst"))


def reversed_arcs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def one_way(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").join(reversed_arcs(edges), ["src", "dst"], "left_anti")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").join(reversed_arcs(edges), ["src", "dst"], "left_semi")


def add_arcs(edges: DataFrame, arcs: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(arcs.select("src", "dst")).distinct()


def remove_arcs(edges: DataFrame, arcs: DataFrame) -> DataFrame:
    return edges.select("src", "dst").join(arcs.select("src", "dst"), ["src", "dst"], "left_anti")


def orient(edges: DataFrame, arcs: DataFrame) -> DataFrame:
    """Of each arc that is one way of an undirected edge, the way back goes."""
    back = reversed_arcs(both_ways(edges).join(arcs.select("src", "dst"), ["src", "dst"], "left_semi"))
    return remove_arcs(edges, back)


def edge_kinds(edges: DataFrame) -> DataFrame:
    """Each arc with whether it is part of an undirected edge."""
    back = reversed_arcs(edges).withColumn("_back", F.lit(True))
    return edges.join(back, ["src", "dst"], "left").select("src", "dst", F.coalesce("_back", F.lit(False)).alias("undirected"))


def neighbors(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbor")).union(edges.select("dst", "src")).distinct()


def closure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst) for each node and what it reaches along the arcs, itself included.  Paths double in
    each round, so the rounds are the logarithm of the longest one; each round is a table of its own, as
    plans that hold all rounds before would double, too."""
    reach = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")).unionByName(edges.select("src", "dst")).distinct()
    reach = materialize(reach, "reach")
    n = reach.count()
    while True:
        longer = reach.alias("a").join(reach.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst").distinct()
        longer = materialize(longer, "reach")
        grown = longer.count()
        drop(reach)
        if grown == n:
            return longer
        reach, n = longer, grown


def arcs_of(parents: Sequence[Iterable[int]]) -> list[tuple[int, int]]:
    return sorted((u, v) for v, p in enumerate(parents) for u in p)


def unshielded_colliders(edges: DataFrame) -> DataFrame:
    """(z, y) of undirected edges z - y such that z -> y would meet a one-way arc x -> y, x and z apart."""
    lines = both_ways(edges).select(F.col("src").alias("z"), F.col("dst").alias("y"))
    into = one_way(edges).select(F.col("src").alias("x"), F.col("dst").alias("y"))
    near = neighbors(edges).select(F.col("id").alias("x"), F.col("neighbor").alias("z"))
    return lines.join(into, "y").where("x <> z").join(near, ["x", "z"], "left_anti").select("z", "y").distinct()


def _apart(rows: DataFrame, x: str, y: str, edges: DataFrame) -> DataFrame:
    """Rows whose nodes in columns x and y are not adjacent."""
    near = neighbors(edges).select(F.col("id").alias(x), F.col("neighbor").alias(y))
    return rows.join(near, [x, y], "left_anti")


def _named(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.col("src").alias(a), F.col("dst").alias(b))


def meek_rule1(edges: DataFrame) -> DataFrame:
    """Arcs a -> b that the rule c -> a - b, c and b apart, gives, as one step over the whole table."""
    found = _named(one_way(edges), "c", "a").join(_named(both_ways(edges), "a", "b"), "a").where("c <> b")
    return _apart(found, "c", "b", edges).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def meek_rule2(edges: DataFrame) -> DataFrame:
    """Arcs a -> b that the rule a -> c -> b, a - b gives, as one step over the whole table."""
    arcs = one_way(edges)
    through = _named(arcs, "a", "c").join(_named(arcs, "c", "b"), "c").select("a", "b").distinct()
    return through.join(_named(both_ways(edges), "a", "b"), ["a", "b"]).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def meek_rule3(edges: DataFrame) -> DataFrame:
    """Arcs a -> b that the rule a - c -> b, a - d -> b, a - b, c and d apart, gives."""
    lines = both_ways(edges)
    side = _named(lines, "a", "c").join(_named(one_way(edges), "c", "b"), "c")
    side = side.join(_named(lines, "a", "b"), ["a", "b"])
    two = side.join(side.withColumnRenamed("c", "d"), ["a", "b"]).where("c < d")
    return _apart(two, "c", "d", edges).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def meek_rule4(edges: DataFrame) -> DataFrame:
    """Arcs a -> b that the rule a - d -> c -> b, a - b, a and c adjacent, d and b apart, gives."""
    lines, arcs = both_ways(edges), one_way(edges)
    path = _named(lines, "a", "d").join(_named(arcs, "d", "c"), "d").join(_named(arcs, "c", "b"), "c").where("d <> b")
    path = path.join(_named(lines, "a", "b"), ["a", "b"]).join(neighbors(edges).select(F.col("id").alias("a"), F.col("neighbor").alias("c")), ["a", "c"])
    return _apart(path, "d", "b", edges).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
