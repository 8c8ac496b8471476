"""Matrix products of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coordinates(spark, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """(i, j, v) of a dense matrix, with its shape checked."""
    if not len(matrix) or any(not hasattr(r, "__len__") or len(r) != len(matrix[0]) for r in matrix):
        raise ValueError("Number of dimensions must be two")
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(matrix) for j, v in enumerate(r)], "i long, j long, v double")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two matrices of coordinates (i, j, v): a join on the inner index, whose products are
    summed in each task before they are shuffled."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("a")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def check_shapes(a: tuple[int, int], b: tuple[int, int]) -> None:
    if a[1] != b[0]:
        raise ValueError("Input shapes must match")


def gram(vectors: DataFrame, array_col: str, dims: int) -> DataFrame:
    """V' V of the rows' vectors, (i, j, v): each row adds its outer product where it lies, so one
    partial row of dims * dims sums leaves each task."""
    x = F.transform(array_col, lambda v: v.cast("double"))
    index = F.sequence(F.lit(0), F.lit(dims * dims - 1))
    both = vectors.select(x.alias("x"), F.explode(index).alias("k"))
    i, j = F.floor(F.col("k") / dims).cast("int"), (F.col("k") % dims).cast("int")
    return both.groupBy(i.cast("long").alias("i"), j.cast("long").alias("j")).agg(F.sum(F.get("x", i) * F.get("x", j)).alias("v"))
