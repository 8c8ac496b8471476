"""Shared plumbing: tables in the cluster's shared folder, joins that survive hot keys, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from xxhash import xxh64_intdigest

from bnspark.sources.shared import drop, materialize, new_path, release, shared_dir, shrink

__all__ = ["drop", "materialize", "new_path", "release", "shared_dir", "shrink"]

# Most rows a join side may have to be broadcast; with the narrow rows used here, some 30 MB.
BROADCAST_ROWS = 500_000
# A key that holds at least one in HOT_SHARE rows is hot, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1_000
BATCH_ROWS = 1_000
LOCAL_EDGES = 20_000  # of a graph contracted to so few edges the driver finds the components
MOST_BITMAP = 27  # as a power of two, bits


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow table for broadcast if a count shows at most limit rows; else leave it to a
    shuffled join.  df should be cheap to count (a materialized table)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _spot(bits: int, *cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), *cols), F.lit(bits))


def _pages(keys: DataFrame, bits: int, *cols: str) -> DataFrame:
    """A bitmap of the hashes of keys, in pages of 4 KB."""
    marks = keys.select(_spot(bits, *cols).alias("_s"))
    return marks.groupBy(F.floor(F.col("_s") / 32_768).alias("_page")).agg(F.bitmap_construct_agg(F.col("_s") % 32_768).alias("_bits"))


def _bits(count: int) -> int:
    return 1 << min(MOST_BITMAP, max(15, (64 * count).bit_length()))


def marked(rows: DataFrame, key: str, keys: DataFrame, count: int, name: str) -> DataFrame:
    """rows with a boolean `name`: true where the key is in the first column of keys, about `count` rows, and in a
    few others.  What is sent to the tasks is a bitmap of hashes, of 64 bits a key but never over 16 MB."""
    bits = _bits(count)
    pages = _pages(keys, bits, keys.columns[0])
    spotted = rows.withColumn("_spot", _spot(bits, key))
    spotted = spotted.join(F.broadcast(pages), F.floor(F.col("_spot") / 32_768) == F.col("_page"), "left")
    at = F.col("_spot") % 32_768
    byte = F.conv(F.hex(F.substr("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return spotted.select(*rows.columns, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias(name))


def maybe_in(rows: DataFrame, key: str, keys: DataFrame, count: int) -> DataFrame:
    """The rows whose key may be in the first column of keys, about `count` rows: all that are, and a few more."""
    return marked(rows, key, keys, count, "_in").where("_in").select(*rows.columns)


class Places:
    """A bitmap of (doc_id, doc, pos), to be asked in Python tasks; at most 16 MB."""

    def __init__(self, places: DataFrame, count: int):
        self.bits = _bits(count)
        pages = _pages(places, self.bits, *(F.col(c).cast("long") for c in places.columns)).collect()
        self.pages = {r["_page"]: bytes(r["_bits"]) for r in pages}

    def among(self, doc_id: int, doc: int, count: int) -> list[int]:
        """The positions below count that may be in the bitmap: all that are, and a few more."""
        seed = xxh64_intdigest((11).to_bytes(4, "little"), 42)  # Spark's xxhash64 of several columns goes on from the hash before
        for part in (doc_id, doc):
            seed = xxh64_intdigest(part.to_bytes(8, "little", signed=True), seed)
        out = []
        for pos in range(count):
            spot = xxh64_intdigest(pos.to_bytes(8, "little"), seed) & (self.bits - 1)
            page = self.pages.get(spot >> 15)
            if page and page[spot >> 3 & 4_095] >> (spot & 7) & 1:
                out.append(pos)
        return out


def attach(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left-join rows with table, which has one row for each key and in column `count` the number
    of rows with that key.  The few hot keys are joined by a broadcast of at most HOT_SHARE rows;
    their rows are spread by a salt in the shuffled join of the rest, where they match nothing."""
    least = max(1000, -(-total // HOT_SHARE))
    values = [c for c in table.columns if c not in (key, count)]
    hot = F.broadcast(table.where(F.col(count) >= least).select(key, F.struct(*values).alias("_hot")))
    rest = table.where(F.col(count) < least).select(
        F.col(key).alias("_key"), F.lit(0).alias("_salt0"), F.struct(*values).alias("_rest")
    )
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(65_536)).cast("int") + 1
    out = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(spread))
    out = out.join(rest, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_salt0")), "left")
    return out.select(
        *rows.columns,
        *[F.coalesce(F.col("_hot")[v], F.col("_rest")[v]).alias(v) for v in values],
    )


def _to_roots(hook: DataFrame) -> DataFrame:
    """hook (node, up), a forest of materialized pointers, with each node pointing to its root.  Every step
    doubles the distance a pointer spans, so a path of n nodes takes about log2(n) of them."""
    while True:
        over = hook.where("node <> up").select(F.col("node").alias("up"), F.col("up").alias("over"))
        step = hook.join(maybe_broadcast(over), "up", "left")
        step = materialize(step.select("node", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")), "hook")
        drop(hook)
        if step.where("moved").isEmpty():
            return step
        hook = step


def _small_components(live: DataFrame) -> DataFrame:
    """(node, up): of at most LOCAL_EDGES edges the smallest node of each node's component."""
    up: dict = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for row in live.collect():
        a, b = (root(bytes(x) if isinstance(x, bytearray) else x) for x in row)
        up[max(a, b)] = min(a, b)
    kind = live.schema["a"].dataType
    schema = StructType([StructField("node", kind), StructField("up", kind)])
    return live.sparkSession.createDataFrame([(x, root(x)) for x in up], schema).coalesce(1)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph with edges (a, b) of any orderable type.

    Returns (node, component), component being the smallest node that can be reached, for each node
    with an edge to another.  Each round hooks every node to its smallest neighbour, follows these
    pointers to their roots by doubling, and contracts the graph to the roots: at least two nodes
    become one, so the nodes with edges halve at least.  What is hooked is one row for each node, so a hub
    never meets in one task: its neighbours are reduced by a partial minimum.  What a round leaves of the graph, if that
    is small, the driver ends.  No edge: no row."""
    least = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live = materialize(least(edges).where("a < b").distinct(), "edges")
    kind = live.schema["a"].dataType
    labels: DataFrame | None = None
    while not live.isEmpty():
        if labels is not None and live.count() <= LOCAL_EDGES:
            step = F.broadcast(_small_components(live).select(F.col("node").alias("component"), "up"))
            new = labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
            new = materialize(new, "labels")
            drop(live), drop(labels)
            return new
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b"))
        hook = _to_roots(materialize(near.select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "hook"))
        if labels is None:
            new = materialize(hook.select("node", F.col("up").alias("component")), "labels")
        else:
            step = hook.select(F.col("node").alias("component"), "up")
            new = materialize(
                labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")),
                "labels",
            )
        ends = live
        for end in ("a", "b"):
            ends = ends.join(hook.select(F.col("node").alias(end), F.col("up").alias("_" + end)), end)
        ends = ends.select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        after = materialize(least(ends).where("a < b").distinct(), "edges")
        for old in (live, labels, hook):
            drop(old)
        live, labels = after, new
    if labels is None:
        return edges.sparkSession.createDataFrame([], StructType([StructField("node", kind), StructField("component", kind)]))
    return labels


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows, unless the session asks for another size than Spark's default:
    texts are long, and each batch is held by the JVM and by Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, BATCH_ROWS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
