"""Categorical tables as integer codes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bnspark.sources.shared import materialize

# A dictionary up to this size becomes a literal in the plan; a larger one is joined.
LITERAL_VALUES = 256
# Values of all columns, if they are to be lists on the driver; larger dictionaries stay tables.
MOST_LISTED = 1_000_000


def strings(data, spark: SparkSession | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A table of strings from a Spark or pandas frame; any primitive is cast.  Columns keep their order.

    Raises ValueError for anything else, for no columns and for repeated names."""
    if not isinstance(data, DataFrame):
        if not hasattr(data, "columns") or not hasattr(data, "values") or getattr(data.values, "ndim", 0) != 2:
            raise ValueError("a Spark or pandas frame is needed")
        spark = spark or SparkSession.getActiveSession()
        data = spark.createDataFrame(data.astype(object).where(data.notna(), None).astype("string").astype(object))
    names = list(columns or data.columns)
    if not names:
        raise ValueError("a table without columns can't be encoded")
    if len(set(names)) < len(names):
        raise ValueError("column names must differ")
    kinds = dict(data.dtypes)
    if bad := [c for c in names if kinds[c].startswith(("array", "map", "struct", "binary"))]:
        raise ValueError(f"columns can't be cast to string: {bad}")
    return data.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])


def ingest(data, spark: SparkSession | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """strings(), refusing tables that hold nulls."""
    out = strings(data, spark, columns)
    nulls = out.select(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in out.columns]).first()
    if found := [c for c in out.columns if nulls[c]]:
        raise ValueError(f"columns hold nulls: {found}")
    return out


def dictionary(table: DataFrame) -> DataFrame:
    """(var_id, variable, code, value): codes number the distinct values of a column in byte order.  The
    distinct values, which a distinct reduces in each task, are sorted over all tasks; a value's code is its place
    in its task and the number of the column's values in the tasks before."""
    cells = F.array(*[F.struct(F.lit(i).alias("var_id"), F.lit(c).alias("variable"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(table.columns)])
    values = table.select(F.explode(cells).alias("c")).select("c.*").distinct()
    ordered = values.repartitionByRange("var_id", "value").sortWithinPartitions("var_id", "value")
    ordered = materialize(ordered.select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("place")), "values")
    tasks = ordered.groupBy("var_id", "task").agg(F.min("place").alias("first"), F.count("*").alias("n"))  # a few rows
    before = Window.partitionBy("var_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = tasks.select("var_id", "task", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("start"))
    return ordered.join(F.broadcast(starts), ["var_id", "task"]).select("var_id", "variable", (F.col("place") - F.col("start")).cast("int").alias("code"), "value")


class EncodedTable:
    """A table with its dictionaries; the counting kernel of everything else.

    codes has an int column v0, v1, ... for each variable; compressed has each observed combination
    once, with its weight w: exact, and mostly far smaller than the rows.  Lists of values are made when they are
    asked for, and refused over MOST_LISTED values."""

    def __init__(self, data, spark: SparkSession | None = None, columns: Sequence[str] | None = None):
        self.table = strings(data, spark, columns)
        self.spark = self.table.sparkSession
        self.col_idx2str = list(self.table.columns)
        self.col_str2idx = {c: i for i, c in enumerate(self.col_idx2str)}
        self.num_of_vars = len(self.col_idx2str)
        # The rows are read once; dictionaries and counts come from the distinct combinations.
        renamed = self.table.toDF(*[f"c{i}" for i in range(self.num_of_vars)])
        self._distinct = materialize(renamed.groupBy(*renamed.columns).agg(F.count("*").alias("_w")), "distinct")
        self.dictionary = dictionary(self._distinct.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(self.col_idx2str)]))
        sizes = {r["var_id"]: r for r in self.dictionary.groupBy("var_id").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls")).collect()}
        if nulls := [c for i, c in enumerate(self.col_idx2str) if i in sizes and sizes[i]["nulls"]]:
            raise ValueError(f"columns hold nulls: {nulls}")
        self.num_of_values = [sizes[i]["n"] if i in sizes else 0 for i in range(self.num_of_vars)]

    def _listed(self, ids: Sequence[int]) -> dict[int, list[str]]:
        """The values of some columns, in the order of their codes."""
        rows = self.dictionary.where(F.col("var_id").isin(list(ids))).collect() if ids else []
        out: dict[int, list[str]] = {i: [] for i in ids}
        for r in sorted(rows, key=lambda r: r["code"]):
            out[r["var_id"]].append(r["value"])
        return out

    @cached_property
    def val_idx2str(self) -> list[list[str]]:
        if sum(self.num_of_values) > MOST_LISTED:
            raise ValueError(f"{sum(self.num_of_values)} values are too many for the driver; use the table `dictionary`")
        return list(self._listed(range(self.num_of_vars)).values())

    @cached_property
    def val_str2idx(self) -> list[dict[str, int]]:
        return [{v: i for i, v in enumerate(values)} for values in self.val_idx2str]

    @cached_property
    def _small(self) -> dict[int, list[str]]:
        return self._listed([i for i, n in enumerate(self.num_of_values) if n <= LITERAL_VALUES])

    @property
    def names(self) -> list[str]:
        return [f"v{i}" for i in range(self.num_of_vars)]

    def _encoded(self, table: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
        out = table
        for i, c in enumerate(table.columns[: self.num_of_vars]):
            if i in self._small:
                values = self._small[i]
                code: Column = F.array_position(F.array(*map(F.lit, values)).cast("array<string>"), F.col(f"`{c}`")).cast("int") - 1
                out = out.withColumn(f"_{i}", code)
            else:
                own = self.dictionary.where(F.col("var_id") == i).select(F.col("code").alias(f"_{i}"), F.col("value").alias(f"_value{i}"))
                out = out.join(own, F.col(f"`{c}`") == F.col(f"_value{i}"))
        return out.select(*[F.col(f"_{i}").cast("int").alias(f"v{i}") for i in range(self.num_of_vars)], *carried)

    @cached_property
    def codes(self) -> DataFrame:
        return self._encoded(self.table)

    @cached_property
    def compressed(self) -> DataFrame:
        return self._encoded(self._distinct, [F.col("_w").alias("w")])

    @cached_property
    def num_of_datapoints(self) -> int:
        return int(self.compressed.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0])

    @property
    def data_column_major(self) -> DataFrame:
        return self.codes

    @property
    def data_row_major(self) -> DataFrame:
        return self.codes.select(F.array(*self.names).alias("row"))

    def __repr__(self) -> str:
        return f"EncodedTable(num_of_datapoints={self.num_of_datapoints}, num_of_vars={self.num_of_vars}, columns={self.col_idx2str})"
