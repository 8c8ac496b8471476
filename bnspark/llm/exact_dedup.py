"""Exact deduplication by content-defined chunk recipes.

Texts, with A-Z lower-cased, are cut where a rolling hash of the last 32 bytes hits a mask, and where
a piece would get longer than MOST_CHUNK.  Equal chunks are brought together once, byte-compared, and
named by a 128-bit digest, with a rank appended (by SHA-256) where different chunks share one.  A document is its
ordered list of chunk names, and documents are equal exactly if their lists are: long texts take part
in the grouping as a few bytes a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_128_digest

from bnspark.llm.common import attach, drop, materialize, maybe_broadcast

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WINDOW = 32
MASK = np.uint32((1 << 11) - 1) << np.uint32(21)  # a cut each 2 KB on average
MOST_CHUNK = 16_384
DIGEST = 16
BATCH_BYTES = 4 << 20


def _gear() -> np.ndarray:
    """256 well-mixed 32-bit values from a rule (splitmix64)."""
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def cuts(data: bytes) -> np.ndarray:
    """Ends of the chunks of data, ascending; the last is len(data).  Empty data has no chunk."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    h = GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < WINDOW:  # the sum over j < 2 * span is that over j < span and, shifted, over the span before
        more = h.copy()
        more[span:] += h[:-span] << np.uint32(span)
        h, span = more, span * 2
    ends = np.flatnonzero((h & MASK) == 0) + 1
    ends = np.append(ends[(ends >= WINDOW) & (ends < n)], n)
    gaps = np.diff(ends, prepend=0)
    if (gaps > MOST_CHUNK).any():
        ends = np.concatenate([np.append(np.arange(e - g + MOST_CHUNK, e, MOST_CHUNK), e) for e, g in zip(ends, gaps, strict=True)])
    return ends


def _normal(value: pa.Scalar) -> bytes:
    return (value.as_py() or "").encode("utf-8", "replace").translate(LOWER)


def _pieces(data: bytes, width: int) -> Iterator[tuple[bytes, bytes]]:
    start = 0
    for end in cuts(data).tolist():
        piece = data[start:end]
        yield xxh3_128_digest(piece)[:width], piece
        start = end


def _recipes(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, recipe = [], []
            for value in batch.column(1):
                data = _normal(value)
                sha.append(hashlib.sha256(data).hexdigest())
                recipe.append(b"".join(d for d, _ in _pieces(data, width)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sha), pa.array(recipe, pa.binary())], names=["doc_id", "text_sha256", "recipe"]
            )

    return run


def _chunks(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(digest, data), each pair once for each stretch of input, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[bytes, bytes]] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in seen], pa.binary()), pa.array([x for _, x in seen], pa.binary())],
                names=["digest", "data"],
            )

        for batch in batches:
            for value in batch.column(0):
                for pair in _pieces(_normal(value), width):
                    if pair not in seen:
                        seen.add(pair)
                        size += len(pair[1])
                if size >= BATCH_BYTES:
                    yield flush()
                    seen.clear()
                    size = 0
        if seen:
            yield flush()

    return run


def _patched(docs: DataFrame, clashed: DataFrame, width: int) -> DataFrame:
    """Recipes in which each name whose digest is shared by different chunks is followed by the rank
    of its SHA-256 among them; all other names by rank 0.  No bytes of chunks leave their task."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_sha256", "pos", "digest", "sha"]
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                data = _normal(value)
                sha, own = hashlib.sha256(data).hexdigest(), batch.column(0).slice(i, 1)
                got = list(_pieces(data, width)) or [(b"", b"")]
                cols = [pa.concat_arrays([own] * len(got)), pa.array([sha] * len(got)), pa.array(range(len(got)), pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array([d for d, _ in got], pa.binary()), pa.array([hashlib.sha256(x).digest() for _, x in got])], names=names
                )

    schema = "doc_id long, text_sha256 string, pos int, digest binary, sha binary"
    found = docs.mapInArrow(occurrences, schema)
    hit = maybe_broadcast(clashed)
    ranks = found.join(hit, "digest", "left_semi").select("digest", "sha").distinct()
    ranks = materialize(
        ranks.select("digest", "sha", F.row_number().over(Window.partitionBy("digest").orderBy("sha")).alias("rank")), "ranks"
    )
    named = found.join(maybe_broadcast(ranks), ["digest", "sha"], "left")
    name = F.concat(F.hex("digest"), F.lit(":"), F.coalesce("rank", F.lit(0)))
    parts = named.groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_set(F.struct("pos", name.alias("name")))).alias("p"))
    lists = parts.select("doc_id", "text_sha256", F.array_join(F.col("p")["name"], ",").cast("binary").alias("recipe"))
    return docs.mapInArrow(_recipes(width), "doc_id long, text_sha256 string, recipe binary").drop("recipe").join(
        lists.withColumnsRenamed({"doc_id": "_d", "text_sha256": "_t"}),
        F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_sha256") == F.col("_t")),
    ).drop("_d", "_t")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = DIGEST) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z; null counts as empty, and empty
    texts are equal.  Of equal texts the row with the largest doc_id stays.  Rows that repeat a doc_id
    and a text count in group_size and are all marked as kept if their doc_id is the largest.  A null
    doc_id is below any other; a group of nothing but such rows has a null keep_id and keeps them.
    An empty table gives no rows; other columns are not read.  width is the digest's in bytes, less
    than DIGEST only in tests of collisions."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = rows.select("text").mapInArrow(_chunks(width), "digest binary, data binary")
    same = chunks.groupBy("digest").agg(F.min("data").alias("low"), F.max("data").alias("high"))
    clashed = materialize(same.where("low <> high").select("digest"), "clashed")
    if clashed.isEmpty():
        named = rows.mapInArrow(_recipes(width), "doc_id long, text_sha256 string, recipe binary")
    else:
        named = _patched(rows, clashed, width)
    named = materialize(named, "recipes")
    drop(clashed)
    groups = named.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialize(groups.where("group_size > 1").withColumn("_n", F.col("group_size")), "groups")
    out = attach(named, groups, "recipe", "_n", named.count())
    one = F.col("group_size").isNull()
    out = out.withColumn("keep_id", F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")))
    return out.select(
        "doc_id", "keep_id", F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )
