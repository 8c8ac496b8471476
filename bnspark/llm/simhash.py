"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits.  If two fingerprints
differ in at most two bits, one of the three ordered pairs (1,2), (2,3), (3,1) of segments has at
most one differing bit in its first segment and none in its second.  The first is made a fuzzy key:
padded to 23 bits it is decoded by the perfect binary Golay code (23, 12, 7), as it is and with each
bit flipped, which gives one or six codeword indices; words one bit apart share at least one of
them.  The second is compared as it is.  Candidates share (pair, index, second segment) and are
verified on all 64 bits, so recall is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from bnspark.llm.common import attach, connected_components, drop, fresh, materialize, maybe_broadcast
from bnspark.llm.hamming import BLOCK, hamming_links

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SHINGLE = 5
SEED = 42
MOST_BITS = 2
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (shift, width)
ORDERED_PAIRS = ((0, 1), (1, 2), (2, 0))  # (fuzzy, exact)


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; 0 where there is no word."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    counts = np.zeros(64, np.int64)
    total = len(words) - shingle + 1
    for at in range(0, total, 1 << 16):
        stop = min(at + (1 << 16), total)
        h = [
            xxh64_intdigest(joined[s : e - 1], SEED)
            for s, e in zip(starts[at:stop], starts[at + shingle : stop + shingle], strict=True)
        ]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


@lru_cache(maxsize=1)
def _decoder() -> np.ndarray:
    """The codeword index (12 bits) nearest to each of the 2^23 words; no word is over 3 bits away."""
    def syndrome(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= ((x >> bit) & 1) * np.uint32(GENERATOR << (bit - 11))
        return x

    errors = np.array([sum(1 << b for b in c) for w in range(4) for c in combinations(range(23), w)], np.uint32)
    leader = np.zeros(1 << 11, np.uint32)
    leader[syndrome(errors)] = errors
    table = np.empty(1 << 23, np.uint16)
    for at in range(0, len(table), 1 << 18):  # a worker holds the table and little more
        word = np.arange(at, at + (1 << 18), dtype=np.uint32)
        table[at : at + (1 << 18)] = (word ^ leader[syndrome(word)]) >> 11
    return table


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64): (row of fp, key), without repeats."""
    table = _decoder()
    segs = [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.uint32) for s, w in SEGMENTS]
    rows, keys = [], []
    for p, (fuzzy, exact) in enumerate(ORDERED_PAIRS):
        flips = np.array([0, *(1 << b for b in range(SEGMENTS[fuzzy][1]))], np.uint32)
        near = np.sort(table[segs[fuzzy][:, None] ^ flips], axis=1)
        own = np.ones(near.shape, bool)
        own[:, 1:] = near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(own)
        rows.append(r)
        keys.append((p << 40) | (near[r, c].astype(np.int64) << 22) | segs[exact][r].astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def _fingerprint(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return run


def emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints to (key, fp), a row for each Golay key."""
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for at in range(0, len(fp), 4096):
            part = fp[at : at + 4096]
            rows, keys = golay_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, block: int = BLOCK
) -> DataFrame:
    """One row for each row of docs: doc_id (long), fp (the fingerprint as a signed long) and
    component_id, the smallest doc_id that links of at most MOST_BITS differing bits reach.

    Null and blank texts have fingerprint zero and are linked like any other.  Rows that repeat, in
    doc_id or whole, each give a row.  A null doc_id stays null and takes the smallest known id of
    its component, or null if there is none.  An empty table gives an empty result; other columns are
    not read.  Copies share a fingerprint, so keys and links are made of distinct fingerprints."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    fps = materialize(rows.mapInArrow(_fingerprint(shingle), "doc_id long, fp long"), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    keyed = nodes.select("fp").mapInArrow(emit_keys, "key long, fp long")
    labels = connected_components(hamming_links(keyed, MOST_BITS, block))
    linked = materialize(
        nodes.join(labels.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp"), "linked"
    )
    roots = materialize(
        linked.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("members")), "roots"
    )
    far = attach(linked, roots, "root", "members", linked.count()).select("fp", "n", "component_id")
    alone = nodes.where("n > 1").join(linked.select("fp"), "fp", "left_anti")
    known = materialize(far.unionByName(alone.select("fp", "n", F.col("rep").alias("component_id"))), "known")
    for old in (nodes, labels, linked, roots):
        drop(old)
    out = attach(fps, known, "fp", "n", fps.count())
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs without its near-copies: of each component the row with the smallest doc_id stays, and of
    rows that repeat that doc_id the smallest by their columns.  A row with a null doc_id can't stand
    for a group: such rows stay, once for each different row."""
    comp = simhash_components(docs, id_col, text_col, shingle).where("doc_id is not null")
    other = fresh(docs, "_id")
    known = F.col(f"`{id_col}`")
    named = lambda df: df.select(F.col("doc_id").alias(other)).distinct()
    gone = materialize(named(comp.where("doc_id <> component_id")), "gone")
    out = docs.where(known.isNotNull()).join(maybe_broadcast(gone), known.cast("long") == F.col(other), "left_anti")
    twice = materialize(named(comp.groupBy("doc_id").count().where("count > 1")), "twice")
    nameless = docs.where(known.isNull()).distinct()
    if twice.isEmpty():
        return out.unionByName(nameless)
    # Rows that repeat an id are reduced in each task to the smallest before they meet.
    many = maybe_broadcast(twice)
    again = out.join(many, known.cast("long") == F.col(other), "left_semi")
    rest = [c for c in docs.columns if c != id_col]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    one = again.select(known.alias("id"), row.alias("row")).groupBy("id").agg(F.min("row").alias("row"))
    one = one.select(*[F.col("id").alias(c) if c == id_col else F.col("row")[c].alias(c) for c in docs.columns])
    return out.join(many, known.cast("long") == F.col(other), "left_anti").unionByName(one).unionByName(nameless)
