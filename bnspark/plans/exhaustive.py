"""Exact search: the best network by dynamic programming over all subsets of the variables."""

from __future__ import annotations

from itertools import combinations

import numpy as np

from bnspark.operators.graph import PDAG
from bnspark.operators.score import Score, score_map
from bnspark.sources.encoding import EncodedTable

MOST_VARS = 22  # the tables on the driver take 16 bytes for each variable and subset


def best_parents(n: int, child: int, most: int, scores: dict) -> tuple[np.ndarray, np.ndarray]:
    """Best score of a child, and the mask of the parents that give it, for each pool of candidates.

    A pool's own score is held against those of the pools with one candidate less, in ascending order of
    the candidate left out, and gives way to one that is at least as good."""
    size = 1 << n
    best = np.full(size, -np.inf)
    mask = np.zeros(size, np.int64)
    others = [v for v in range(n) if v != child]
    for k in range(most + 1):
        for parents in combinations(others, k):
            m = sum(1 << v for v in parents)
            best[m], mask[m] = scores[child, parents], m
    pools = np.arange(size, dtype=np.int64)
    pools = pools[pools >> child & 1 == 0]
    counts = np.bitwise_count(pools)
    for k in range(1, n):
        at = pools[counts == k]
        for v in others:
            has = at[at >> v & 1 == 1]
            less = has ^ (1 << v)
            take = best[less] >= best[has]
            best[has[take]] = best[less[take]]
            mask[has[take]] = mask[less[take]]
    return best, mask


def exhaustive_search(df: EncodedTable, score_type: Score, max_parents: int, is_deterministic: bool = True) -> PDAG:
    """The network with the best score, none of whose nodes has more than max_parents parents.

    Family scores come from Spark, one number each; the sweep over subsets runs on the driver.  Of equal
    scores the smaller parent set, and the lower-numbered sink, is taken.  is_deterministic is accepted;
    the search always is."""
    n = df.num_of_vars
    if not 0 <= max_parents <= n - 1:
        raise ValueError("max_parents must be in [0, num_of_vars-1]")
    if n > MOST_VARS:
        raise ValueError(f"at most {MOST_VARS} variables can be searched")
    families = [
        (v, parents) for v in range(n) for k in range(max_parents + 1) for parents in combinations([u for u in range(n) if u != v], k)
    ]
    scores = score_map(df, families, score_type)
    tables = [best_parents(n, v, max_parents, scores) for v in range(n)]
    size = 1 << n
    total = np.full(size, -np.inf)
    total[0] = 0.0
    sink = np.full(size, -1, np.int8)
    subsets = np.arange(size, dtype=np.int64)
    counts = np.bitwise_count(subsets)
    for k in range(1, n + 1):
        at = subsets[counts == k]
        for v in range(n):
            has = at[at >> v & 1 == 1]
            rest = has ^ (1 << v)
            score = total[rest] + tables[v][0][rest]
            take = score > total[has]
            total[has[take]] = score[take]
            sink[has[take]] = v
    out = PDAG(n)
    left = size - 1
    while left:
        v = int(sink[left])
        left ^= 1 << v
        out.parents[v] = int(tables[v][1][left])
    return out
