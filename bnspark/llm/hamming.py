"""Links between 64-bit fingerprints at a small Hamming distance, found among rows that share a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from bnspark.llm.common import connected_components, drop, materialize

# A key with more distinct fingerprints than this is compared in pairs of blocks of this size.
BLOCK = 20_000
KEYS_A_BUCKET = 500
# Keys of lists are dealt to parts of about PART of them, from stretches of DEAL, or more where there are many parts.
PART, DEAL, MOST_DEAL = 100_000, 1 << 17, 1 << 20
SHORT = 8  # runs up to this length are compared all at once


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def run_links(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges, as indices into fp, of a spanning forest of the graph that links fingerprints at most
    `most` bits apart.  Every pair is compared; what is kept is less than one edge for each row."""
    left, right = [], []
    label = np.arange(len(fp))
    for i in range(1, len(fp)):
        close = np.flatnonzero(popcount(fp[:i] ^ fp[i]) <= most)
        if len(close):
            parts, first = np.unique(label[close], return_index=True)
            left.append(close[first])
            right.append(np.full(len(first), i))
            if len(parts) > 1:
                label[:i][np.isin(label[:i], parts)] = parts[0]
            label[i] = parts[0]
    if not left:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate(left), np.concatenate(right)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a stream sorted by keys into tables that hold whole runs of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        same = np.ones(batch.num_rows, bool)
        for c in cols:
            same &= c == c[-1]
        last = int(batch.num_rows - np.argmin(same[::-1])) if not same.all() else 0
        if held and last == 0:
            ends = [held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() for k in keys]
            if any(e != c[0] for e, c in zip(ends, cols, strict=True)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def starts_of(cols: list[np.ndarray]) -> np.ndarray:
    """Where runs begin in columns sorted together; the end is appended."""
    n = len(cols[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def _pairs(fp: np.ndarray, of: np.ndarray, most: int) -> list[np.ndarray]:
    """Links (signed, two rows) between fingerprints of the same run; `of` numbers the runs in ascending order."""
    at = starts_of([of])
    size = np.diff(at)
    size_of = np.repeat(size, size)
    found: list[np.ndarray] = []
    for d in range(1, min(SHORT, size.max(initial=0))):
        i = np.flatnonzero((of[d:] == of[:-d]) & (size_of[d:] <= SHORT))
        i = i[popcount(fp[i] ^ fp[i + d]) <= most]
        found.append(np.stack([fp[i], fp[i + d]]).view(np.int64))
    for k in np.flatnonzero(size > SHORT):
        run = fp[at[k] : at[k + 1]]
        a, b = run_links(run, most)
        found.append(np.stack([run[a], run[b]]).view(np.int64))
    return found


def _links(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key", "part"]):
            key, part, signed = (t.column(c).to_numpy() for c in ("key", "part", "fp"))
            once = starts_of([key, part, signed])[:-1]  # repeats follow each other
            key, part, signed = key[once], part[once], signed[once]
            at = starts_of([key, part])
            found = _pairs(signed.view(np.uint64), np.repeat(np.arange(len(at) - 1), np.diff(at)), most)
            if found and (pairs := np.concatenate(found, axis=1)).size:
                pairs = np.unique(np.sort(pairs, axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=schema)

    return find


def _big_keys(keyed: DataFrame, block: int, total: int) -> DataFrame | None:
    """Keys with more than `block` fingerprints, with their count; None if there is none.  Counts of
    buckets of keys, which leave each task as a few rows, tell where there can be one at all.  keyed has about
    `total` rows."""
    bucket = F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(max(4096, -(-total // KEYS_A_BUCKET))))
    full = materialize(keyed.groupBy(bucket.alias("bucket")).count().where(F.col("count") > block).select("bucket"), "full")
    big = None
    if not full.isEmpty():
        some = keyed.withColumn("bucket", bucket).join(full, "bucket", "left_semi")
        big = materialize(some.groupBy("key").count().where(F.col("count") > block), "big")
        if big.isEmpty():
            drop(big)
            big = None
    drop(full)
    return big


def hamming_links(keyed: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between fingerprints at most `most` bits apart that share a key: of each key a
    spanning forest, so that no link between groups is lost and no group is written as all its
    pairs.  keyed has (key long, fp long).  Keys with more than `block`
    fingerprints are spread over pairs of blocks; each pair of blocks is a task's unit.  Rows of keyed may
    repeat."""
    return _keyed_links(keyed, most, block, _big_keys(keyed, block, keyed.count()))


def _keyed_links(keyed: DataFrame, most: int, block: int, big: DataFrame | None) -> DataFrame:
    if big is None:
        parts = keyed.withColumn("part", F.lit(0))
    else:
        n = F.ceil(F.col("count") / block).cast("int")
        mine = F.pmod(F.xxhash64("fp"), n).cast("int")
        pair = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(j, mine) * n + F.greatest(j, mine))
        parts = keyed.join(big, "key", "left").select(
            "key", "fp", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(pair)).alias("part")
        )
    return (
        parts.select("key", "part", "fp")
        .repartition("key", "part")
        .sortWithinPartitions("key", "part", "fp")
        .mapInArrow(_links(most), "a long, b long")
    )


def _dealt(parts: int, without: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (fp, keys) each key, but for those `without`, with its fingerprint, to the part that the key's hash names:
    (part, keys, fps), the numbers as bytes."""
    names = ["part", "keys", "fps"]
    deal = min(MOST_DEAL, max(DEAL, 256 * parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            part = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)
            part = part.astype(np.uint16 if parts <= 1 << 16 else np.int64)  # short numbers are sorted by radix
            order = np.argsort(part, kind="stable")
            key, fp, part = key[order], fp[order], part[order]
            at = starts_of([part]).tolist()
            cut = lambda x: pa.array([x[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(part[at[:-1]].astype(np.int64)), cut(key), cut(fp)], names=names)

        for batch in batches:
            lists = batch.column(1)
            key = lists.flatten().to_numpy()
            fp = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy())
            if len(without):
                stays = ~np.isin(key, without)
                key, fp = key[stays], fp[stays]
            held.append((key, fp))
            if sum(len(k) for k, _ in held) >= deal:
                yield out()
        if sum(len(k) for k, _ in held):
            yield out()

    return run


def _part_links(most: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between the fingerprints that share a key, part after part."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["part"]):
            key, fp = (np.frombuffer(b"".join(t.column(c).to_pylist()), k) for c, k in (("keys", kind), ("fps", "<i8")))
            order = np.argsort(key)
            key = key[order]
            same = np.append(False, key[1:] == key[:-1])
            some = np.flatnonzero(same | np.append(same[1:], False))  # most keys have one fingerprint only
            fp = fp[order[some]]
            of = np.cumsum(~same[some])
            order = np.lexsort((fp, of))
            once = order[starts_of([of[order], fp[order]])[:-1]]
            found = _pairs(fp[once].view(np.uint64), of[once], most)
            if found and (pairs := np.concatenate(found, axis=1)).size:
                pairs = np.unique(np.sort(pairs, axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return find


def list_links(rows: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """hamming_links() of rows (fp, keys array of numbers): the JVM moves keys by the thousand, as bytes, and tasks sort
    them, a part at a time.  Keys with more than `block` fingerprints, at most one in so many, are left to
    hamming_links()."""
    first = rows.select(F.size("keys")).first()
    total = rows.count() * (first[0] if first else 0)
    keyed = rows.select(F.explode("keys").alias("key"), "fp")
    big = _big_keys(keyed, block, total)
    kind = "<i4" if rows.schema["keys"].dataType.elementType == IntegerType() else "<i8"
    without = np.array([r[0] for r in big.select("key").collect()] if big else [], kind)
    parts = rows.select("fp", "keys").mapInArrow(_dealt(-(-total // PART) or 1, without), "part long, keys binary, fps binary")
    links = parts.repartition("part").sortWithinPartitions("part").mapInArrow(_part_links(most, kind), "a long, b long")
    if big is None:
        return links
    return links.unionByName(_keyed_links(keyed.join(F.broadcast(big.select("key")), "key", "left_semi"), most, block, big))


def coarse_groups(rows: DataFrame, most: int, block: int = BLOCK, more: DataFrame | None = None) -> DataFrame:
    """(fp, component) for the fingerprints of rows (fp, keys array of numbers) that may have a partner: those that
    links of at most `most` bits between fingerprints with a common key connect, or the links (a, b) of `more`, and
    those of several rows."""
    nodes = rows.groupBy("fp").agg(F.count("*").alias("rows"))
    links = list_links(rows, most, block)
    links = links if more is None else links.unionByName(more)
    linked = connected_components(links).select(F.col("node").alias("fp"), "component")
    shared = nodes.where("rows > 1").select("fp")
    alone = shared.join(linked, "fp", "left_anti").select("fp", F.col("fp").alias("component"))
    out = materialize(linked.unionByName(alone), "coarse")
    drop(linked)
    return out


def spread(rows: DataFrame, node: str, small: int, many: int, large: int) -> DataFrame:
    """rows (comp, members, node and others) without members, each once for every part of its group's work:
    a group of more than `small` members is cut into blocks, `many` at most while these stay below `large`,
    and each pair of blocks is a part; `block` tells a row's own, -1 in a group that is one part.  Parts are
    partitioned and sorted by (comp, part)."""
    n = F.greatest(F.least(F.ceil(F.col("members") / small), F.lit(many)), F.ceil(F.col("members") / large)).cast("int")
    mine = F.pmod(F.xxhash64(node), n).cast("int")
    pair = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(j, mine) * n + F.greatest(j, mine))
    rest = [c for c in rows.columns if c not in ("comp", "members")]
    parts = rows.select("comp", F.explode(pair).alias("part"), F.when(n > 1, mine).otherwise(-1).alias("block"), *rest)
    return parts.repartition("comp", "part").sortWithinPartitions("comp", "part", node)
