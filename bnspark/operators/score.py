"""Decomposable scores of families (a child and its parents)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bnspark.functions.special import lgamma
from bnspark.operators.contingency import ContingencyTable, count_sets
from bnspark.sources.encoding import EncodedTable


@dataclass(frozen=True)
class BDeu:
    ess: float = 1.0


@dataclass(frozen=True)
class K2:
    pass


@dataclass(frozen=True)
class BIC:
    pass


@dataclass(frozen=True)
class AIC:
    pass


Score = BDeu | K2 | BIC | AIC
Family = tuple[int, tuple[int, ...]]


def family_scores(enc: EncodedTable, families: Sequence[Family], score: Score, extensions: bool = False) -> DataFrame:
    """(family_id, score), family_id being the place in `families`.

    BDeu is the only score of the core; K2, BIC and AIC in their textbook forms are an extension that
    must be asked for, else they raise.  Families over the same variables share their counts; cells are
    summed to parent configurations, and those to families, by two partial aggregations."""
    if not isinstance(score, BDeu) and not (extensions and isinstance(score, (K2, BIC, AIC))):
        raise ValueError("Unsupported score type.")
    if any(child in parents for child, parents in families):
        raise ValueError("a child can't be its own parent")
    sets = sorted({tuple(sorted({c, *p})) for c, p in families})
    place = {s: i for i, s in enumerate(sets)}
    by_set: dict[int, list] = {}
    for k, (child, parents) in enumerate(families):
        s = tuple(sorted({child, *parents}))
        r, q = enc.num_of_values[child], prod(enc.num_of_values[i] for i in parents)
        by_set.setdefault(place[s], []).append((k, s.index(child), float(r), float(q)))
    spec = enc.spark.createDataFrame(list(by_set.items()), "set_id int, f array<struct<family_id: int, child: int, r: double, q: double>>")
    cells = count_sets(enc, sets).join(F.broadcast(spec), "set_id").select("codes", "n", F.explode("f").alias("f"))
    at = F.col("f.child")
    given = F.concat(F.slice("codes", F.lit(1), at), F.slice("codes", at + 2, F.size("codes")))
    cells = cells.select("f.family_id", "f.r", "f.q", given.alias("given"), "n")
    if isinstance(score, BDeu):
        a = score.ess / (F.col("r") * F.col("q"))
        inner = lgamma(F.col("n") + a) - lgamma(a)
        outer = lambda total: F.col("inner") - (lgamma(total + score.ess / F.col("q")) - lgamma(score.ess / F.col("q")))
        after = F.col("s")
    elif isinstance(score, K2):
        inner = lgamma(F.col("n") + 1)
        outer = lambda total: F.col("inner") + lgamma(F.col("r")) - lgamma(total + F.col("r"))
        after = F.col("s")
    else:
        inner = F.col("n") * F.log(F.col("n"))
        outer = lambda total: F.col("inner") - total * F.log(total)
        free = F.col("q") * (F.col("r") - 1)
        after = F.col("s") - (free * F.log(F.lit(float(max(enc.num_of_datapoints, 1)))) / 2 if isinstance(score, BIC) else free)
    configs = cells.groupBy("family_id", "r", "q", "given").agg(F.sum(inner).alias("inner"), F.sum("n").alias("total"))
    sums = configs.groupBy("family_id", "r", "q").agg(F.sum(outer(F.col("total").cast("double"))).alias("s"))
    return sums.select("family_id", after.alias("score"))


def score_map(enc: EncodedTable, families: Sequence[Family], score: Score, extensions: bool = False) -> dict[Family, float]:
    """Scores on the driver, one number for each family; families without any count score 0."""
    families = list(dict.fromkeys(families))
    found = {r["family_id"]: r["score"] for r in family_scores(enc, families, score, extensions).collect()} if families else {}
    return {f: found.get(k, 0.0) for k, f in enumerate(families)}


def calculate_local_score(child_var: int, parent_set: Sequence[int], ct: ContingencyTable, score_type: Score) -> float:
    """Score of child_var with all other variables of ct as its parents."""
    if child_var not in ct.var_ids:
        raise ValueError("child_var not present in contingency table")
    family = child_var, tuple(i for i in ct.var_ids if i != child_var)
    return score_map(ct.encoded, [family], score_type)[family]


def network_score(enc: EncodedTable, parents: Sequence[Sequence[int]], score: Score) -> float:
    """Sum of the local scores of a network, parents[v] being those of v."""
    return sum(score_map(enc, [(v, tuple(sorted(p))) for v, p in enumerate(parents)], score).values())


