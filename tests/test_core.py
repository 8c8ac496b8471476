"""Functions, encoding, counts, tests, scores, graphs and searches."""

import math
import random
from itertools import combinations, permutations, product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bnspark.functions.combinatorics import combinations_of, mask_to_array, mask_to_list, masks_of_size, next_mask
from bnspark.functions.special import chi2_sf, lgamma
from bnspark.operators import contingency, graph, linalg, metrics
from bnspark.operators.citest import ChiSquare, GSquare, OracleGraph, ci_batch, citest, decide
from bnspark.operators.contingency import ContingencyTable
from bnspark.operators.dsep import d_separated, separated_table
from bnspark.operators.graph import PDAG
from bnspark.operators.score import AIC, BIC, K2, BDeu, calculate_local_score, family_scores, network_score, score_map
from bnspark.plans.annealing import chains, simulated_annealing
from bnspark.plans.exhaustive import exhaustive_search
from bnspark.plans.pc import build_skeleton, pc
from bnspark.plans.rai import rai
from bnspark.sources import io, networks
from bnspark.sources.encoding import EncodedTable, dictionary, ingest


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(0)
    n = 700
    a = rng.integers(0, 3, n)
    b = (a + rng.integers(0, 2, n)) % 3
    c = rng.integers(0, 2, n)
    d = np.where(rng.random(n) < 0.8, (b + c) % 2, rng.integers(0, 2, n))
    return pd.DataFrame({"b": b, "a": a, "d": [f"s{x}" for x in d], "c": c, "k": "same"}).astype(str)


@pytest.fixture(scope="module")
def enc(spark, frame):
    return EncodedTable(frame, spark)


# Functions.


def test_chi2_sf():
    for x, dof, p in ((3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (12.405322, 14, 0.573787), (124.342, 100, 0.05)):
        assert chi2_sf(x, dof) == pytest.approx(p, abs=1e-5)
    assert (chi2_sf(0, 0), chi2_sf(1, 0), chi2_sf(0, 5)) == (1.0, 0.0, 1.0)
    for dof in (2, 4, 10):  # closed form for even dof
        for x in (0.1, 1.0, 7.5, 40.0, 200.0):
            exact = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))
            assert chi2_sf(x, dof) == pytest.approx(exact, rel=1e-12)


def test_lgamma(spark):
    values = [10.0**e * f for e in range(-6, 7) for f in (1, 1.7, 4.2)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", lgamma(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - math.lgamma(r.x)) <= 1e-11 + 1e-12 * abs(math.lgamma(r.x)) for r in got)


def test_masks(spark):
    assert [mask_to_list(m) for m in (0, 1, 0b1010, 31, 2**50 + 2**30)] == [[], [0], [1, 3], [0, 1, 2, 3, 4], [30, 50]]
    assert mask_to_list(2**64 - 1) == list(range(64))
    assert [sum(1 for _ in masks_of_size(n, k)) for n, k in ((5, 3), (10, 3), (31, 3), (63, 3), (127, 3), (9, 0), (9, 9))] == [10, 120, 4495, 39711, 333375, 1, 1]
    assert list(masks_of_size(6, 2)) == sorted(sum(1 << i for i in c) for c in combinations(range(6), 2))
    assert next_mask(0, 5) is None and next_mask(0b11000, 5) is None
    assert combinations_of("abc", 0) == [()] and combinations_of("abc", 4) == [] and len(combinations_of("abcd", 2)) == 6
    got = spark.createDataFrame([(-1,), (5,), (1 << 62,)], "m long").select(mask_to_array(F.col("m"), 64).alias("a")).collect()
    assert [list(r.a) for r in got] == [list(range(64)), [0, 2], [62]]


# Encoding.


def test_encoding(frame, enc):
    assert enc.col_idx2str == ["b", "a", "d", "c", "k"] and enc.col_str2idx["d"] == 2
    assert enc.num_of_datapoints == len(frame) and enc.num_of_vars == 5
    for i, c in enumerate(enc.col_idx2str):
        assert enc.val_idx2str[i] == sorted(frame[c].unique())
        assert enc.num_of_values[i] == frame[c].nunique() and enc.val_str2idx[i][enc.val_idx2str[i][0]] == 0
    want = sorted(zip(*[[enc.val_str2idx[i][v] for v in frame[c]] for i, c in enumerate(enc.col_idx2str)], strict=True))
    assert sorted(tuple(r) for r in enc.codes.collect()) == want
    assert sorted(tuple(r.row) for r in enc.data_row_major.collect()) == want
    assert "num_of_vars=5" in repr(enc)


def test_many_values_are_joined(spark):
    enc = EncodedTable(spark.range(1_000).select(F.col("id").alias("x"), (F.col("id") % 7).alias("y")))
    assert enc.num_of_values == [1_000, 7]
    assert sorted(r.v0 for r in enc.codes.collect()) == list(range(1_000))


def test_ingest_refuses(spark):
    for bad in (spark.range(1).select(F.lit(None).cast("string").alias("x")), spark.range(1).select(F.array(F.lit(1)).alias("x")), [1], pd.Series([1])):
        with pytest.raises(ValueError):
            ingest(bad, spark)
        with pytest.raises(ValueError):
            EncodedTable(bad, spark)
    with pytest.raises(ValueError):
        ingest(spark.range(1).selectExpr("1 a", "2 a"))
    order = dictionary(spark.createDataFrame([(v,) for v in ("é", "a", "B", "_", "Z", "b")], "x string"))
    assert [r["value"] for r in order.orderBy("code").collect()] == ["B", "Z", "_", "a", "b", "é"]


def test_empty_and_single_tables(spark):
    empty = EncodedTable(spark.createDataFrame([], "a string, b string"))
    assert empty.num_of_datapoints == 0 and empty.num_of_values == [0, 0]
    assert contingency.counts(empty, ()).count() == 0 and contingency.all_dims(empty, 2).count() == 0
    assert decide(empty, [(0, 1, ())], ChiSquare()) == [True]
    one = EncodedTable(spark.createDataFrame([("x", "y")], "a string, b string"))
    assert decide(one, [(0, 1, ())], GSquare()) == [True] and ContingencyTable([0, 1], one).counts == {0: 1}


# Counts.


def test_contingency(frame, enc):
    for names in (["a"], ["b", "d"], ["b", "a", "c"], []):
        ids = sorted(enc.col_str2idx[n] for n in names)
        ct = ContingencyTable(ids, enc)
        assert sum(ct.counts.values()) == len(frame)
        assert len(ct.counts) <= math.prod(ct.cardinalities)
        want = {}
        for row in frame.itertuples():
            key = sum(enc.val_str2idx[i][getattr(row, enc.col_idx2str[i])] * w for i, w in zip(ids, ct.radix_weights, strict=True))
            want[key] = want.get(key, 0) + 1
        assert ct.counts == want
        assert sum(contingency.dense_on_driver(enc, ids)) == len(frame)
    with pytest.raises(ValueError):
        ContingencyTable([1, 0], enc)
    with pytest.raises(IndexError):
        ContingencyTable([9], enc)
    assert ContingencyTable([1, 1], enc).var_ids == [1, 1]


def test_all_subsets(enc):
    with pytest.raises(ValueError):
        contingency.all_dims(enc, 6)
    got = {}
    for r in contingency.all_dims(enc, 3).collect():
        members = mask_to_list(r.gid)
        got.setdefault(tuple(members), {})[tuple(r[f"v{i}"] for i in members)] = r.n
    for s in contingency.subsets(5, 3):
        assert got[s] == {tuple(r[:-1]): r.n for r in contingency.counts(enc, s).collect()}
    sets = contingency.subsets(5, 2)
    chunked = contingency.count_sets(enc, sets, 5).collect()
    assert sum(r.n for r in chunked) == len(sets) * enc.num_of_datapoints


# Tests.


def brute_statistics(frame, x, y, z):
    chi = g = 0.0
    dof = 0
    for _, part in frame.groupby(list(z)) if z else [((), frame)]:
        table = pd.crosstab(part[x], part[y]).to_numpy().astype(float)
        d = (table.shape[0] - 1) * (table.shape[1] - 1)
        dof += d
        if not d:
            continue
        e = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
        o = table + (np.sign(e - table) * np.minimum(0.5, np.abs(e - table)) if d == 1 else 0)
        chi += ((o - e) ** 2 / e).sum()
        g += 2 * (o[o > 0] * np.log(o[o > 0] / e[o > 0])).sum()
    return chi, g, dof


def test_statistics(frame, enc):
    small = frame.head(60)
    for f, e in ((frame, enc), (small, EncodedTable(small, enc.spark))):
        tests = [(x, y, z) for x, y in combinations(range(5), 2) for k in range(3) for z in combinations([v for v in range(5) if v not in (x, y)], k)]
        got = {r.test_id: r for r in ci_batch(e, tests, 17).collect()}
        for k, (x, y, z) in enumerate(tests):
            want = brute_statistics(f, e.col_idx2str[x], e.col_idx2str[y], [e.col_idx2str[i] for i in z])
            assert (got[k].chi2, got[k].g2) == pytest.approx(want[:2], rel=1e-9, abs=1e-9) and got[k].dof == want[2]


def test_citest(enc):
    a, b, c, k = (enc.col_str2idx[n] for n in "abck")
    assert not citest(b, a, [], ContingencyTable(sorted([a, b]), enc), ChiSquare(0.01))
    assert citest(a, c, [], ContingencyTable(sorted([a, c]), enc), GSquare(0.01))
    assert citest(a, k, [], ContingencyTable(sorted([a, k]), enc), ChiSquare(0.01))  # one value: no degree of freedom
    with pytest.raises(ValueError):
        citest(a, a, [], ContingencyTable([a], enc), ChiSquare())
    with pytest.raises(ValueError):
        citest(a, c, [], ContingencyTable([a], enc), ChiSquare())
    dag = networks.dag("cancer")
    assert citest(1, 4, [0], None, OracleGraph(dag)) and not citest(1, 4, [], None, OracleGraph(dag))


# Scores.


def brute_bdeu(frame, child, parents, cards, ess):
    q = math.prod(cards[p] for p in parents)
    a = ess / (q * cards[child])
    total = sum(math.lgamma(n + a) - math.lgamma(a) for n in frame.groupby([*parents, child]).size())
    outer = frame.groupby(list(parents)).size() if parents else [len(frame)]
    return total - sum(math.lgamma(n + ess / q) - math.lgamma(ess / q) for n in outer)


def test_bdeu(frame, enc):
    cards = {c: frame[c].nunique() for c in frame}
    for ess in (0.5, 1.0, 10.0):
        for child in "abd":
            for parents in ([], ["c"], ["c", "k"], ["c", "k", "b" if child != "b" else "a"]):
                ids = sorted(enc.col_str2idx[n] for n in [child, *parents])
                got = calculate_local_score(enc.col_str2idx[child], [], ContingencyTable(ids, enc), BDeu(ess))
                assert got == pytest.approx(brute_bdeu(frame, child, parents, cards, ess), abs=1e-6)
    for kind in (K2(), BIC(), AIC()):
        with pytest.raises(ValueError, match="Unsupported score type"):
            calculate_local_score(0, [], ContingencyTable([0, 1], enc), kind)
        assert family_scores(enc, [(0, (1,))], kind, extensions=True).first()[1] < 0
    with pytest.raises(ValueError):
        calculate_local_score(0, [], ContingencyTable([1], enc), BDeu())
    with pytest.raises(ValueError):
        family_scores(enc, [(0, (0, 1))], BDeu())


# Graphs.


def test_pdag():
    g = PDAG(5, [(0, 1), (1, 0), (1, 2), (3, 2)])
    assert g.has_undirected_edge(0, 1) and not g.has_undirected_edge(1, 2) and g.is_adjacent(2, 3)
    assert (g.neighbors(1), g.undirected_neighbors(1), g.undirected_neighbors(1, 0)) == ([0, 2], [0], [])
    assert (g.directed_parents(2), g.directed_children(1), g.successors(1), g.predecessors(1)) == ([1, 3], [2], [0, 2], [0])
    assert g.has_path(0, 2) and not g.has_directed_path(0, 2) and g.has_directed_path(4, 4) and g.has_connection(2, 0) and not g.has_connection(0, 4)
    assert g.is_ancestor(1, 2) and g.creates_unshielded_collider(2, 4)
    g.orient_edge(0, 1)
    g.orient_edge(2, 1)
    assert g.has_edge(0, 1) and not g.has_edge(1, 0)
    h = PDAG(g)
    h.remove_edge(0, 1)
    assert g.has_edge(0, 1) and g != h
    for f, args in ((g.add_directed_edge, (0, 1)), (g.remove_directed_edge, (1, 0)), (g.add_undirected_edge, (0, 1)), (g.remove_undirected_edge, (0, 1))):
        with pytest.raises(ValueError):
            f(*args)
    with pytest.raises(IndexError):
        g.has_edge(0, 9)
    assert len(PDAG.complete(6).arcs()) == 30 and len(rai(6, ChiSquare(), 3).arcs()) == 30


def test_meek_rules():
    def closed(n, arcs, lines):
        g = PDAG(n, [*arcs, *lines, *[(v, u) for u, v in lines]])
        g.apply_meek_rules()
        return g

    assert closed(3, [(0, 1)], [(1, 2)]).directed_children(1) == [2]
    assert closed(3, [(0, 1), (1, 2)], [(0, 2)]).directed_children(0) == [1, 2]
    assert 1 in closed(4, [(2, 1), (3, 1)], [(0, 1), (0, 2), (0, 3)]).directed_children(0)
    assert 1 in closed(4, [(3, 2), (2, 1)], [(0, 1), (0, 3), (0, 2)]).directed_children(0)


def brute_separated(dag, x, y, given):
    """By active paths."""
    def descendants(v):
        return {w for w in range(dag.num_vars) if dag.is_ancestor(v, w)}

    def active(path):
        for a, b, c in zip(path, path[1:], path[2:]):
            if dag.has_edge(a, b) and dag.has_edge(c, b):
                if not descendants(b) & given:
                    return False
            elif b in given:
                return False
        return True

    def paths(path):
        if path[-1] == y:
            yield path
            return
        for w in dag.neighbors(path[-1]):
            if w not in path:
                yield from paths([*path, w])

    return not any(active(p) for p in paths([x]))


def test_d_separation(spark):
    rng = random.Random(0)
    for _ in range(25):
        n = 6
        dag = PDAG(n, [(u, v) for u, v in combinations(range(n), 2) if rng.random() < 0.4])
        tests = []
        for x, y in combinations(range(n), 2):
            given = {v for v in range(n) if v not in (x, y) and rng.random() < 0.3}
            tests.append((x, y, given, brute_separated(dag, x, y, given)))
            assert d_separated(dag, x, y, given) == tests[-1][3]
    rows = [(k, x, y, sorted(z)) for k, (x, y, z, _) in enumerate(tests)]
    got = separated_table(dag.edges(spark), spark.range(n), spark.createDataFrame(rows, "test_id int, x int, y int, z array<int>"))
    assert {r.test_id: r.separated for r in got.collect()} == {k: t[3] for k, t in enumerate(tests)}
    with pytest.raises(ValueError):
        d_separated(dag, 0, 1, {0})
    with pytest.raises(IndexError):
        d_separated(dag, 0, 9)
    with pytest.raises(IndexError):
        d_separated(dag, 0, 1, {17})


def test_structural_errors(spark):
    rng = random.Random(3)
    for _ in range(4):
        graphs = [PDAG(7, [(u, v) for u in range(7) for v in range(7) if u != v and rng.random() < 0.25]) for _ in range(2)]
        row = metrics.structural_errors(*[g.edges(spark) for g in graphs]).first()
        assert row.asDict() == metrics.structural_errors_of(*graphs)
        assert row["SHD"] == metrics.shd(*graphs) == row["ME"] + row["EE"] + row["ED"] + row["MD"] + row["RD"]
        for g in graphs:
            assert sorted(map(tuple, metrics.pattern(g.edges(spark)).collect())) == metrics.pattern_of(g).arcs()
    assert metrics.shd(graphs[0], graphs[0]) == 0
    with pytest.raises(ValueError):
        metrics.check_same_nodes(spark.range(3), spark.range(4))
    with pytest.raises(ValueError):
        metrics.shd(PDAG(2), PDAG(3))


def test_labels(spark):
    g = PDAG(3, [(0, 1), (1, 2), (2, 1)])
    directed, lines = io.to_labelled(g, ["x", "y", "z"])
    assert (directed, lines) == ([("x", "y")], [("y", "z")])
    assert io.from_labelled(directed, lines, {"x": 0, "y": 1, "z": 2}) == g
    for f in (lambda: io.to_labelled(g, ["x"]), lambda: io.from_labelled([("x", "q")], [], {"x": 0})):
        with pytest.raises(ValueError):
            f()


# Searches.


@pytest.mark.parametrize("stable", [True, False])
@pytest.mark.parametrize("name", list(networks.NETWORKS))
def test_pc_with_the_graph_finds_the_pattern(name, stable):
    truth = networks.dag(name)
    assert metrics.shd(truth, pc(truth.num_vars, OracleGraph(truth), truth.num_vars, stable)) == 0
    assert metrics.shd(truth, rai(truth.num_vars, OracleGraph(truth), 1)) == {"cancer": 8, "asia": 24, "child": 175, "alarm": 654}[name]


def test_pc_on_samples(spark):
    enc = EncodedTable(networks.simulate(spark, "asia", 20_000, 3))
    truth = networks.dag("asia")
    for kind in (ChiSquare(0.01), GSquare(0.01)):
        for stable in (True, False):
            assert metrics.shd(truth, pc(enc, kind, 3, stable)) <= 6
    found, sepsets = build_skeleton(enc, 8, ChiSquare(0.01), 1, True)
    assert all(not found.is_adjacent(*pair) for pair in sepsets)
    with pytest.raises(ValueError):
        pc(8, ChiSquare(), 1)
    oriented = pc(8, OracleGraph(truth), 8, apply_meek=True)
    assert set(oriented.arcs()) <= set(pc(8, OracleGraph(truth), 8).arcs())


@pytest.mark.parametrize("name", ["cancer", "asia"])
def test_exhaustive_search_recovers(spark, name):
    enc = EncodedTable(networks.simulate(spark, name, 100_000, 0))
    assert metrics.shd(networks.dag(name), exhaustive_search(enc, BDeu(1.0), 3)) == 0


def test_exhaustive_search_is_the_best(enc):
    some = EncodedTable(enc.table.select("a", "b", "c", "d"))
    scores = score_map(some, [(v, p) for v in range(4) for k in range(4) for p in combinations([u for u in range(4) if u != v], k)], BDeu(1.0))
    for most in range(4):
        best = max(
            sum(max(s for (v, p), s in scores.items() if v == o and len(p) <= most and set(p) <= set(order[:i])) for i, o in enumerate(order))
            for order in permutations(range(4))
        )
        found = exhaustive_search(some, BDeu(1.0), most)
        assert network_score(some, [found.predecessors(v) for v in range(4)], BDeu(1.0)) == pytest.approx(best, abs=1e-9)
        assert all(len(found.predecessors(v)) <= most for v in range(4))
    with pytest.raises(ValueError):
        exhaustive_search(some, BDeu(1.0), 4)


def test_annealing(enc):
    some = EncodedTable(enc.table.select("a", "b", "c", "d"))
    found = simulated_annealing(some, BDeu(1.0), 2, 800, seed=5, num_chains=2)
    assert found == simulated_annealing(some, BDeu(1.0), 2, 800, seed=5, num_chains=2)
    assert all(len(found.predecessors(v)) <= 2 and not any(found.is_ancestor(v, u) for u in found.predecessors(v)) for v in range(4))
    score = network_score(some, [found.predecessors(v) for v in range(4)], BDeu(1.0))
    assert max(r.score for r in chains(some, BDeu(1.0), 2, 800, seed=5, num_chains=2).collect()) == pytest.approx(score, abs=1e-4)
    assert simulated_annealing(some, BDeu(1.0), 0, 50, num_chains=1).arcs() == []
    with pytest.raises(ValueError):
        simulated_annealing(some, BDeu(1.0), 4)


def test_annealing_with_scores_beforehand(enc, monkeypatch):
    from bnspark.plans import annealing

    some = EncodedTable(enc.table.select("a", "b", "c"))
    a = simulated_annealing(some, BDeu(1.0), 2, 300, seed=1, num_chains=1)
    monkeypatch.setattr(annealing, "MOST_ROWS", 1)
    assert simulated_annealing(some, BDeu(1.0), 2, 300, seed=1, num_chains=1) == a


# The rest.


def test_matrices(spark):
    rng = np.random.default_rng(42)
    a, b = rng.random((3, 4)), rng.random((4, 5))
    got = linalg.matmul(linalg.coordinates(spark, a.tolist()), linalg.coordinates(spark, b.tolist()))
    want = a @ b
    assert all(abs(r.v - want[r.i, r.j]) < 1e-9 for r in got.collect()) and got.count() == 15
    rows = spark.createDataFrame([(r.tolist(),) for r in a], "x array<double>")
    assert all(abs(r.v - (a.T @ a)[r.i, r.j]) < 1e-9 for r in linalg.gram(rows, "x", 4).collect())
    for f in (lambda: linalg.coordinates(spark, [1.0]), lambda: linalg.check_shapes((3, 4), (3, 5))):
        with pytest.raises(ValueError):
            f()


def test_records_and_csv(spark, tmp_path):
    rows = [("asia", t, s, s % 3, 0.5 + s) for t in (1, 2) for s in range(4)]
    records = spark.createDataFrame(rows, io.RECORD)
    io.append_csv(records.coalesce(1), f"{tmp_path}/r")
    io.append_csv(records.coalesce(1), f"{tmp_path}/r")
    back = io.read_csv(spark, f"{tmp_path}/r", io.RECORD)
    assert back.count() == 16
    r = io.summary(back).where("num_threads = 1").first()
    assert (r["count"], r["time_min_s"], r["time_max_s"]) == (8, 0.5, 3.5) and r["shd_std"] == pytest.approx(np.std([0, 1, 2, 0] * 2, ddof=1))


def test_parallelism(spark):
    p = io.Parallelism(spark)
    before = p.get_num_threads()
    p.set_num_threads(3)
    assert p.get_num_threads() == 3 and p.get_max_threads() >= 1
    p.set_num_threads(before)
    for bad in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            p.set_num_threads(bad)


def test_closure(spark):
    rng = random.Random(1)
    arcs = {(rng.randrange(20), rng.randrange(20)) for _ in range(25)}
    g = PDAG(20, arcs)
    got = {tuple(r) for r in graph.closure(g.edges(spark), spark.range(20)).collect()}
    assert got == {(s, t) for s, t in product(range(20), range(20)) if g.has_path(s, t)}


def test_public_names(enc, frame):
    from bnspark import api

    assert all(hasattr(api, n) for n in api.__all__) and api.cuda_enabled is False
    assert api.PDAG2CPDAG(networks.dag("asia")) == metrics.pattern_of(networks.dag("asia"))


def test_statistics_need_one_exchange_by_slice(enc):
    plan = ci_batch(enc, [(0, 1, (2,)), (0, 2, ())])._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("REPARTITION_BY_COL")]
    assert after.count("Exchange hashpartitioning") == 2  # by slice, and by test
