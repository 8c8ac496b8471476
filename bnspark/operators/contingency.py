"""Counts over subsets of the variables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import cached_property
from itertools import combinations, product
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bnspark.sources.encoding import EncodedTable

SETS_A_JOB = 64


def counts(enc: EncodedTable, var_ids: Sequence[int]) -> DataFrame:
    """Observed combinations of some variables with n, from the compressed table; without variables a row
    with the number of rows, and none for an empty table."""
    cols = [f"v{i}" for i in var_ids]
    total = F.sum("w").alias("n")
    if cols:
        return enc.compressed.groupBy(*cols).agg(total)
    return enc.compressed.agg(total).where("n > 0")


class ContingencyTable:
    """Counts of the observed combinations of var_ids (ascending), under mixed-radix keys: the last
    variable has weight 1, each other the product of the cardinalities after it."""

    def __init__(self, var_ids: Sequence[int], df: EncodedTable):
        self.var_ids = list(var_ids)
        if self.var_ids != sorted(self.var_ids):
            raise ValueError("var_ids must be sorted")
        if any(not 0 <= i < df.num_of_vars for i in self.var_ids):
            raise IndexError("var_ids out of range")
        self.encoded = df
        self.cardinalities = [df.num_of_values[i] for i in self.var_ids]
        self.radix_weights = [prod(self.cardinalities[i + 1 :]) for i in range(len(self.var_ids))]
        if prod(self.cardinalities) >= 1 << 63:
            raise OverflowError("the keys of these variables exceed 63 bits")

    @cached_property
    def cells(self) -> DataFrame:
        """key, the codes and n."""
        out = counts(self.encoded, sorted(set(self.var_ids)))
        return out.select(self.key([F.col(f"v{i}") for i in self.var_ids]).alias("key"), *[c for c in out.columns])

    def key(self, codes: Sequence[Column]) -> Column:
        return sum((c.cast("long") * w for c, w in zip(codes, self.radix_weights, strict=True)), F.lit(0).cast("long"))

    def state_of(self, key: Column, at: int) -> Column:
        weight, card = self.radix_weights[at], self.cardinalities[at]
        return F.call_function("div", key - key % weight, F.lit(weight).cast("long")) % card

    def strip(self, key: Column, at: int) -> Column:
        """The key with one variable set to its first value."""
        return key - self.state_of(key, at) * self.radix_weights[at]

    def contains(self, keys: DataFrame) -> DataFrame:
        """keys (key) with whether they are observed."""
        seen = self.cells.select("key", F.lit(True).alias("_seen"))
        return keys.join(seen, "key", "left").select("key", F.coalesce("_seen", F.lit(False)).alias("contained"))

    @property
    def counts(self) -> dict[int, int]:
        """The cells on the driver; there are at most as many as combinations."""
        return {r["key"]: r["n"] for r in self.cells.select("key", "n").collect()}


def subsets(n: int, most: int) -> list[tuple[int, ...]]:
    return [s for k in range(most + 1) for s in combinations(range(n), k)]


def count_sets(enc: EncodedTable, sets: Iterable[Sequence[int]], sets_a_job: int = SETS_A_JOB) -> DataFrame:
    """(set_id, codes, n) for many subsets of the variables.  Each chunk of sets is one aggregation over
    the compressed table, whose rows are reduced in each task before they are shuffled."""
    sets = list(sets)
    out: DataFrame | None = None
    for at in range(0, len(sets), sets_a_job):
        wide = [
            F.struct(F.lit(at + k).alias("set_id"), F.array(*[F.col(f"v{i}") for i in s]).cast("array<int>").alias("codes"))
            for k, s in enumerate(sets[at : at + sets_a_job])
        ]
        part = enc.compressed.select(F.explode(F.array(*wide)).alias("s"), "w").groupBy("s.set_id", "s.codes").agg(F.sum("w").alias("n"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no set to count")
    return out


def all_dims(enc: EncodedTable, max_depth: int) -> DataFrame:
    """Counts of every subset of at most max_depth variables, by GROUPING SETS: gid (bit i set if variable
    i takes part), the codes (null where a variable doesn't) and n."""
    if not 0 <= max_depth <= enc.num_of_vars:
        raise ValueError("max_depth must be in [0, num_of_vars]")
    n = enc.num_of_vars
    sets = [[F.col(f"v{i}") for i in s] for s in subsets(n, max_depth)]
    grouped = enc.compressed.groupingSets(sets, *[F.col(c) for c in enc.names])
    present = sum(((1 - F.grouping(c)).cast("long") * (1 << i) for i, c in enumerate(enc.names)), F.lit(0).cast("long"))
    return grouped.agg(present.alias("gid"), F.sum("w").alias("n")).select("gid", *enc.names, "n").where("n > 0")


def dense(enc: EncodedTable, var_ids: Sequence[int], most: int = 1_000_000) -> DataFrame:
    """All combinations of the variables' values with n, zeros included."""
    cards = [enc.num_of_values[i] for i in var_ids]
    if prod(cards) > most:
        raise ValueError(f"a dense table of {prod(cards)} cells; at most {most} are made")
    grid = enc.spark.range(prod(cards))
    ct = [prod(cards[k + 1 :]) for k in range(len(cards))]
    grid = grid.select(*[F.expr(f"cast((id div {w}) % {c} as int)").alias(f"v{i}") for i, w, c in zip(var_ids, ct, cards, strict=True)])
    seen = counts(enc, var_ids)
    return grid.join(seen, [f"v{i}" for i in var_ids], "left").select(*[f"v{i}" for i in var_ids], F.coalesce("n", F.lit(0)).alias("n"))


def dense_on_driver(enc: EncodedTable, var_ids: Sequence[int]) -> list[int]:
    """The same as a list, the first variable most significant."""
    found = {tuple(r[:-1]): r[-1] for r in counts(enc, var_ids).collect()}
    return [int(found.get(k, 0)) for k in product(*[range(enc.num_of_values[i]) for i in var_ids])]
