"""Figures measured beforehand on the driver's tables."""

import pytest

from bnspark.functions.special import chi2_sf
from bnspark.operators.citest import ChiSquare, GSquare, ci_batch
from bnspark.operators.score import BDeu, network_score, score_map
from bnspark.plans import registry
from bnspark.plans.annealing import simulated_annealing
from bnspark.plans.exhaustive import exhaustive_search
from bnspark.plans.pc import pc

SF = "/root/testdata/sf0.01"
TOTALS = {"sf0.001": -21704.167102149077, "sf0.01": -217367.98236255354}
TRUE = [("disc_hi", "promo"), ("promo", "audit"), ("promo", "rush"), ("qty_hi", "promo"), ("tax_hi", "audit")]


def named(graph):
    return sorted((registry.BN_VARS[u], registry.BN_VARS[v]) for u, v in graph.arcs())


def test_statistics(spark):
    enc = registry.raw(spark, SF)
    triples = [("l_returnflag", "l_linestatus", "l_linenumber"), ("l_linestatus", "l_discount", "l_returnflag"), ("l_discount", "l_tax", "l_linestatus")]
    got = ci_batch(enc, [(enc.col_str2idx[x], enc.col_str2idx[y], (enc.col_str2idx[z],)) for x, y, z in triples]).orderBy("test_id").collect()
    want = [(12.405322, 12.405672), (23.657120, 23.661400), (171.699585, 172.201142)]
    assert [(r.chi2, r.g2) for r in got] == [pytest.approx(w, abs=1e-6) for w in want]
    assert chi2_sf(got[0].chi2, got[0].dof) == pytest.approx(0.573787, abs=1e-6)


def test_scores(spark):
    enc = registry.raw(spark, SF)
    family = enc.col_str2idx["l_returnflag"], (enc.col_str2idx["l_linestatus"],)
    assert score_map(enc, [family], BDeu(1.0))[family] == pytest.approx(-65940.38060372841, abs=1e-6)


@pytest.mark.parametrize("sf", list(TOTALS))
def test_searches_find_the_network(spark, sf):
    enc = registry.bn(spark, f"/root/testdata/{sf}")
    found = exhaustive_search(enc, BDeu(1.0), 3)
    assert named(found) == TRUE
    assert network_score(enc, [found.predecessors(v) for v in range(6)], BDeu(1.0)) == pytest.approx(TOTALS[sf], abs=1e-5)
    for kind in (ChiSquare(0.01), GSquare(0.01)):
        assert named(pc(enc, kind, 6)) == sorted([*TRUE, ("rush", "promo")])


def test_annealing_reaches_the_exact_score(spark):
    enc = registry.bn(spark, SF)
    found = simulated_annealing(enc, BDeu(1.0), 3, 3_000, init_temp=50.0, cooling_rate=0.997, seed=2, num_chains=4)
    score = network_score(enc, [found.predecessors(v) for v in range(6)], BDeu(1.0))
    assert TOTALS["sf0.01"] - 200 < score <= TOTALS["sf0.01"] + 1e-6
