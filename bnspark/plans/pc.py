"""PC: skeleton by conditional-independence tests, then v-structures.

All tests of a level are known when it starts, so each level is one batch of Spark jobs; the rule by
which edges go, in order and with the live graph, is then replayed on the driver over the answers.
"""

from __future__ import annotations

from itertools import combinations

from bnspark.operators.citest import CITest, OracleGraph, decide
from bnspark.operators.dsep import d_separated
from bnspark.operators.graph import PDAG
from bnspark.sources.encoding import EncodedTable

Sepsets = dict[tuple[int, int], frozenset[int]]


def _candidates(adjacent: list[list[int]], u: int, v: int, k: int):
    return combinations([w for w in adjacent[u] if w != v], k)


def build_skeleton(enc: EncodedTable | None, n: int, kind: CITest, max_cond_vars: int, stable: bool) -> tuple[PDAG, Sepsets]:
    """The skeleton and, for each pair without an edge, the first set that separates it.

    Pairs x < y in order; candidates of size k out of the neighbours of x, then of y, other than the
    other one, in order; stable takes the neighbours at the start of the level.  Without `stable` they
    can only be fewer, so the level's tests are known beforehand all the same."""
    graph, sepsets = PDAG.complete(n), {}
    for k in range(max_cond_vars + 1):
        start = [graph.undirected_neighbors(v) for v in range(n)]
        if all(len(a) <= k for a in start):  # a pair has fewer than k others left
            break
        known: dict[tuple[int, int, tuple[int, ...]], bool] = {}
        if not isinstance(kind, OracleGraph):
            tests = dict.fromkeys(
                (x, y, z)
                for x in range(n) for y in start[x] if x < y
                for u, v in ((x, y), (y, x)) for z in _candidates(start, u, v, k)
            )
            known = dict(zip(tests, decide(enc, list(tests), kind), strict=True))

        def independent(x: int, y: int, z: tuple[int, ...], known=known) -> bool:
            if (x, y, z) not in known:
                known[x, y, z] = d_separated(kind.pdag, x, y, z)
            return known[x, y, z]

        for x in range(n):
            for y in range(x + 1, n):
                if not graph.has_undirected_edge(x, y):
                    continue
                for u, v in ((x, y), (y, x)):
                    near = start if stable else {u: graph.undirected_neighbors(u)}
                    found = next((z for z in _candidates(near, u, v, k) if independent(x, y, z)), None)
                    if found is not None:
                        graph.remove_undirected_edge(x, y)
                        sepsets[x, y] = frozenset(found)
                        break
    return graph, sepsets


def orient_colliders(graph: PDAG, sepsets: Sepsets) -> None:
    """x -> y <- z where x and z are apart and y does not separate them.  Nodes y ascending, each until
    nothing changes; an edge that an earlier collider has oriented stays so."""
    for y in range(graph.num_vars):
        changed = True
        while changed:
            changed = False
            for x, z in combinations(graph.undirected_neighbors(y), 2):
                if graph.is_adjacent(x, z) or y in sepsets.get((x, z), ()):
                    continue
                if graph.has_undirected_edge(x, y) or graph.has_undirected_edge(z, y):
                    graph.orient_edge(x, y)
                    graph.orient_edge(z, y)
                    changed = True


def pc(
    df: EncodedTable | int, ci_test_type: CITest, max_cond_vars: int, stable: bool = True, apply_meek: bool = False
) -> PDAG:
    """The graph that PC finds: skeleton and v-structures, by default without further orientations.

    With a graph to ask, df may be the number of variables, and no Spark job runs.  apply_meek, an
    extension, closes the result under Meek's rules."""
    n = df if isinstance(df, int) else df.num_of_vars
    if isinstance(df, int) and not isinstance(ci_test_type, OracleGraph):
        raise ValueError("a table is needed to test")
    graph, sepsets = build_skeleton(None if isinstance(df, int) else df, n, ci_test_type, max_cond_vars, stable)
    orient_colliders(graph, sepsets)
    if apply_meek:
        graph.apply_meek_rules()
    return graph
