"""Conditional-independence tests: chi-square, G-square, and d-separation in a given graph."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bnspark.functions.special import chi2_sf
from bnspark.operators.contingency import ContingencyTable, count_sets
from bnspark.operators.dsep import d_separated
from bnspark.operators.graph import PDAG
from bnspark.sources.encoding import EncodedTable

TESTS_A_JOB = 1024


@dataclass(frozen=True)
class ChiSquare:
    level: float = 0.05


@dataclass(frozen=True)
class GSquare:
    level: float = 0.05


@dataclass(frozen=True)
class OracleGraph:
    pdag: PDAG

    def __repr__(self) -> str:
        return "<OracleGraph>"


CITest = ChiSquare | GSquare | OracleGraph
Triple = tuple[int, int, tuple[int, ...]]  # x, y, conditioning variables


def statistics(cells: DataFrame) -> DataFrame:
    """(test_id, chi2, g2, dof) from the observed cells (test_id, z, x, y, n) of many tests.

    A slice z contributes (rows - 1) (columns - 1) degrees of freedom, of rows and columns that occur in
    it.  The sums run over the whole product of these; its cells without a count are not made: of a
    cell with O = 0 the chi-square term is its E, and all E of a slice sum to its n.  Slices with one
    degree of freedom are Yates-corrected for both statistics; there all four |O - E| are the same, so
    each cell without a count has E = |O - E| of the others."""
    # One exchange by slice serves all windows and the sums of a slice: their keys contain it.
    slice_of = Window.partitionBy("test_id", "z")
    by_row, by_col = Window.partitionBy("test_id", "z", "x"), Window.partitionBy("test_id", "z", "y")
    full = cells.repartition("test_id", "z").select(
        "*", F.sum("n").over(by_row).alias("row"), F.count("*").over(by_row).alias("in_row"),
    )
    full = full.select("*", F.sum("n").over(by_col).alias("col"), F.count("*").over(by_col).alias("in_col"))
    # Each cell is its share of a row, so the shares sum to the number of rows.
    full = full.select(
        "*", F.sum("n").over(slice_of).alias("total"), F.round(F.sum(1 / F.col("in_row")).over(slice_of)).cast("long").alias("n_rows"),
        F.round(F.sum(1 / F.col("in_col")).over(slice_of)).cast("long").alias("n_cols"),
    )
    full = full.withColumn("d", (F.col("n_rows") - 1) * (F.col("n_cols") - 1))
    e = F.col("row").cast("double") * F.col("col") / F.col("total")
    off = F.abs(F.col("n") - e)
    move = F.when(F.col("d") == 1, F.least(F.lit(0.5), off)).otherwise(F.lit(0.0))
    o = F.col("n") + F.signum(e - F.col("n")) * move
    full = full.select("test_id", "z", "d", "total", "n_rows", "n_cols", e.alias("e"), o.alias("o"), off.alias("off"), move.alias("move"))
    sums = full.groupBy("test_id", "z").agg(
        F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("chi2"),
        F.sum(F.when(F.col("o") > 0, 2 * F.col("o") * F.log(F.col("o") / F.col("e"))).otherwise(F.lit(0.0))).alias("g2"),
        F.sum("e").alias("e"), F.count("*").alias("seen"), F.max("off").alias("off"), F.max("move").alias("move"),
        *[F.max(c).alias(c) for c in ("d", "total", "n_rows", "n_cols")],
    )
    empty = (F.col("n_rows") * F.col("n_cols") - F.col("seen")).cast("double")
    rest = F.when(F.col("d") == 1, empty * (F.col("off") - F.col("move")) ** 2 / F.col("off")).otherwise(F.col("total") - F.col("e"))
    log_rest = F.when(F.col("d") == 1, empty * 2 * F.col("move") * F.log(F.col("move") / F.col("off"))).otherwise(F.lit(0.0))
    slice_sums = sums.select(
        "test_id", "d",
        F.when((F.col("d") == 0), 0.0).otherwise(F.col("chi2") + F.when(empty > 0, rest).otherwise(F.lit(0.0))).alias("chi2"),
        F.when((F.col("d") == 0), 0.0).otherwise(F.col("g2") + F.when(empty > 0, log_rest).otherwise(F.lit(0.0))).alias("g2"),
    )
    return slice_sums.groupBy("test_id").agg(F.sum("chi2").alias("chi2"), F.sum("g2").alias("g2"), F.sum("d").alias("dof"))


def ci_batch(enc: EncodedTable, tests: Sequence[Triple], tests_a_job: int = TESTS_A_JOB) -> DataFrame:
    """(test_id, chi2, g2, dof) of many tests, test_id being the place in `tests`.

    Tests over the same variables share their counts; one job serves a chunk of tests."""
    for x, y, z in tests:
        if x == y:
            raise ValueError("x and y must differ")
        if x in z or y in z:
            raise ValueError("x or y is conditioned on")
    out: DataFrame | None = None
    for at in range(0, len(tests), tests_a_job):
        chunk = tests[at : at + tests_a_job]
        sets = sorted({tuple(sorted({x, y, *z})) for x, y, z in chunk})
        place = {s: i for i, s in enumerate(sets)}
        by_set: dict[int, list] = {}
        for k, (x, y, z) in enumerate(chunk, at):
            s = tuple(sorted({x, y, *z}))
            by_set.setdefault(place[s], []).append((k, s.index(x), s.index(y), [s.index(i) for i in sorted(z)]))
        spec = enc.spark.createDataFrame(
            [(i, v) for i, v in by_set.items()], "set_id int, t array<struct<test_id: int, x: int, y: int, z: array<int>>>"
        )
        cells = count_sets(enc, sets).join(F.broadcast(spec), "set_id").select("codes", "n", F.explode("t").alias("t"))
        cells = cells.select(
            F.col("t.test_id").alias("test_id"), F.transform("t.z", lambda i: F.get("codes", i)).alias("z"),
            F.get("codes", F.col("t.x")).alias("x"), F.get("codes", F.col("t.y")).alias("y"), "n",
        )
        part = statistics(cells)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return enc.spark.createDataFrame([], "test_id int, chi2 double, g2 double, dof long")
    return out


def decide(enc: EncodedTable, tests: Sequence[Triple], kind: CITest) -> list[bool]:
    """Whether each test finds independence.  A graph needs no Spark job."""
    if isinstance(kind, OracleGraph):
        return [d_separated(kind.pdag, x, y, set(z)) for x, y, z in tests]
    if not isinstance(kind, (ChiSquare, GSquare)):
        raise ValueError("Unsupported CI test type")
    found = {r["test_id"]: r for r in ci_batch(enc, tests).collect()} if tests else {}
    name = "chi2" if isinstance(kind, ChiSquare) else "g2"
    # An empty table has no cell, no degree of freedom and statistic 0: independent.
    p = [chi2_sf(found[k][name], int(found[k]["dof"])) if k in found else 1.0 for k in range(len(tests))]
    return [v >= kind.level for v in p]


def citest(x: int, y: int, sepset_candidate: Sequence[int], ct: ContingencyTable, citest_type: CITest) -> bool:
    """Whether x and y are independent given the other variables of ct (for a graph: given the
    candidate).  For the statistics the candidate must agree with ct, whose variables decide."""
    if x == y:
        raise ValueError("x and y must differ")
    x, y = min(x, y), max(x, y)
    if isinstance(citest_type, OracleGraph):
        return d_separated(citest_type.pdag, x, y, set(sepset_candidate))
    if x not in ct.var_ids or y not in ct.var_ids:
        raise ValueError("x or y not contained in contingency table")
    given = tuple(i for i in ct.var_ids if i not in (x, y))
    return decide(ct.encoded, [(x, y, given)], citest_type)[0]
