"""The public names in one place.

    from bnspark import api
    table = api.DataframeWrapper(frame)
    graph = api.pc(table, api.ChiSquare(0.01), max_cond_vars=3)
    api.structural_errors(truth, graph)
"""

from __future__ import annotations

from bnspark.functions.special import chi2_sf
from bnspark.operators.citest import ChiSquare, GSquare, OracleGraph, ci_batch, citest
from bnspark.operators.contingency import ContingencyTable
from bnspark.operators.graph import PDAG
from bnspark.operators.metrics import pattern_of as PDAG2CPDAG  # noqa: N812
from bnspark.operators.metrics import structural_errors_of as structural_errors
from bnspark.operators.score import AIC, BIC, K2, BDeu, calculate_local_score, network_score
from bnspark.plans.annealing import simulated_annealing
from bnspark.plans.exhaustive import exhaustive_search
from bnspark.plans.pc import pc
from bnspark.plans.rai import rai
from bnspark.sources.encoding import EncodedTable as DataframeWrapper
from bnspark.sources.io import Parallelism as OpenMP
from bnspark.sources.io import from_labelled, to_labelled

cuda_enabled = False

__all__ = [
    "AIC", "BIC", "BDeu", "ChiSquare", "ContingencyTable", "DataframeWrapper", "GSquare", "K2", "OpenMP", "OracleGraph", "PDAG",
    "PDAG2CPDAG", "calculate_local_score", "chi2_sf", "ci_batch", "citest", "cuda_enabled", "exhaustive_search", "from_labelled",
    "network_score", "pc", "rai", "simulated_annealing", "structural_errors", "to_labelled",
]
