"""Tables, graphs and benchmark records in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bnspark.operators.graph import PDAG

RECORD = "model_name string, num_threads int, seed int, shd int, elapsed_sec double"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; without a schema all columns are strings."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def summary(records: DataFrame) -> DataFrame:
    """Count, mean and spread of errors and times of benchmark records, by model and number of threads."""
    t = "elapsed_sec"
    return records.groupBy("model_name", "num_threads").agg(
        F.count("*").alias("count"), F.avg("shd").alias("shd_mean"), F.stddev_samp("shd").alias("shd_std"), F.avg(t).alias("time_mean_s"),
        F.stddev_samp(t).alias("time_std_s"), F.min(t).alias("time_min_s"), F.max(t).alias("time_max_s"),
    )


def nodes(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "id int, name string")


def named(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (src, dst) by name, for graphs of other libraries."""
    out = edges.join(ids.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src")
    return out.join(ids.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst").select("src_name", "dst_name")


def indexed(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (src_name, dst_name) by id."""
    out = edges.join(ids.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src_name")
    return out.join(ids.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst_name").select("src", "dst")


def to_labelled(graph: PDAG, labels: Sequence[str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Directed and undirected edges by label; there must be a label for each node."""
    if len(labels) != graph.num_vars:
        raise ValueError(f"{len(labels)} labels for {graph.num_vars} nodes")
    directed = [(labels[u], labels[v]) for u, v in graph.arcs() if not graph.has_edge(v, u)]
    return directed, [(labels[u], labels[v]) for u, v in graph.arcs() if u < v and graph.has_edge(v, u)]


def from_labelled(directed: Sequence[tuple[str, str]], undirected: Sequence[tuple[str, str]], ids: dict[str, int]) -> PDAG:
    """The graph with these edges; every label must be known."""
    if unknown := {x for e in [*directed, *undirected] for x in e} - ids.keys():
        raise ValueError(f"unknown labels: {sorted(unknown)}")
    out = PDAG(len(ids), [(ids[u], ids[v]) for u, v in directed])
    for u, v in undirected:
        out.add_edge(ids[u], ids[v])
        out.add_edge(ids[v], ids[u])
    return out


class Parallelism:
    """How many tasks run at once, and how many partitions shuffles make."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def get_max_threads(self) -> int:
        return self.spark.sparkContext.defaultParallelism

    def get_num_threads(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def set_num_threads(self, n: int) -> None:
        if not isinstance(n, int) or isinstance(n, bool) or n <= 0:
            raise ValueError("Number of threads must be a positive integer.")
        self.spark.conf.set("spark.sql.shuffle.partitions", n)
