"""Recursive autonomy identification: a placeholder, as everywhere so far."""

from __future__ import annotations

from bnspark.operators.citest import CITest
from bnspark.operators.graph import PDAG
from bnspark.sources.encoding import EncodedTable


def rai(df: EncodedTable | int, ci_test_type: CITest, max_cond_vars: int) -> PDAG:
    """The complete undirected graph, whatever the data.  A true search is out of scope."""
    return PDAG.complete(df if isinstance(df, int) else df.num_of_vars)
