"""Exact encoding and decoding with merge-type (BPE) SentencePiece models.

The encoder backtracks instead of merging: at a position it tries the longest piece that an
Aho-Corasick automaton found to start there, then shorter ones.  A piece may follow another one only if
merging the two pieces' characters again gives back just these two; a whole sequence is the model's if
and only if all its adjacent pairs are.  Positions from which no piece fits are marked in a bitfield and
never tried twice, so the time is linear in the text but for the pairs, whose checks are cached.

Where two pieces have the same score (in the public model the runs of spaces), pairs alone don't decide
and the stretch is merged outright, with a heap, best score first and leftmost among equals.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

SPACE = "▁"
NORMAL, BYTE = 1, 6
MOST_WORDS, LONGEST_WORD, MOST_PAIRS = 200_000, 48, 300_000
SEEN_MASK = (1 << 23) - 1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n = {1: 8, 5: 4}.get(kind, 0)
            if kind == 2:
                n, i = varint(i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


class Model:
    """A BPE model with identity normalisation, byte fallback and a dummy prefix."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        top: dict[int, list] = {}
        for number, value in _fields(data):
            top.setdefault(number, []).append(value)
        for raw in top[1]:
            f = dict(_fields(raw))
            self.pieces.append(f[1].decode())
            self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
            kinds.append(f.get(3, NORMAL))
        trainer, norm = dict(_fields(top[2][0])), dict(_fields(top[3][0]))
        if trainer.get(3) != 2 or not trainer.get(35) or norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and identity normalisation are supported")
        if set(kinds) - {NORMAL, BYTE, 2, 3}:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that go on past a space are not supported")
        self.bytes = frozenset(self.byte_ids.values())
        self.text = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for byte, i in self.byte_ids.items():
            self.text[i] = bytes([byte])
        for i, k in enumerate(kinds):
            if k in (2, 3):
                self.text[i] = b"" if k == 3 else " ⁇ ".encode()
        often = Counter(self.scores[i] for i in self.ids.values())
        tied = {i for p, i in self.ids.items() if len(p) > 1 and often[self.scores[i]] > 1}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        # The longest piece that is a proper prefix of a piece; -1 if there is none.
        self.shorter = [-1] * len(self.pieces)
        found = set()
        for p, i in sorted(self.ids.items()):
            if i in tied:
                self.automaton.add_word(p, (len(p), -1))
            elif len(p) == 1 or self.merged(p) == [i]:  # other pieces are never made
                self.automaton.add_word(p, (len(p), i))
                found.add(p)
                self.shorter[i] = next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in found), -1)
        self.automaton.make_automaton()
        self.chars = frozenset(p for p in self.ids if len(p) == 1)
        self.length = [len(p) for p in self.pieces]
        breaks = "" if any("\n" in p for p in self.ids) else "\n"
        # Nothing merges across the end of a word and the spaces after it, nor across a line feed.
        self.words = re.compile(rf" +[^ {breaks}]*|{breaks or '$'}|[^ {breaks}]+")
        self.marks = {c: (self.ids[c], c.encode()) for c in ".,;:!?)\"'" if c in self.chars}
        # Words and what parts() gives for them, in two generations: the older is dropped as a whole.
        self.seen, self.marked = bytearray((SEEN_MASK + 1) >> 3), 0  # bits of words seen before
        self.young: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def merged(self, s: str) -> list[int]:
        """Ids of s, whose characters are all pieces, by merging."""
        ids, scores = self.ids, self.scores
        part: list[str | None] = list(s)
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(s)
            if j < len(s):
                both = part[i] + part[j]
                if (k := ids.get(both)) is not None:
                    heapq.heappush(heap, (-scores[k], i, both))

        for i in range(len(s) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) >= len(s) or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, None
            after[i] = after[j]
            if after[i] < len(s):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [ids[p] for p in part if p is not None]

    def fits(self, left: int, right: int) -> bool:
        """Whether right may follow left: merging both anew leaves them as they are.  Bytes merge with nothing."""
        if left in self.bytes:
            return True
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.pieces[left] + self.pieces[right]) == [left, right]
        return known

    def backtracked(self, s: str) -> list[int]:
        """Ids of s, whose characters are all pieces."""
        n, shorter, length, pairs = len(s), self.shorter, self.length, self.pairs
        longest = [-1] * n
        for end, (size, piece) in self.automaton.iter(s):
            if piece < 0:
                return self.merged(s)
            longest[end + 1 - size] = piece  # of those with the same start the longest comes last
        failed = None  # bitfield of the positions from which no sequence goes on
        out: list[int] = []
        pos, last, piece = 0, -1, longest[0] if n else -1
        while pos < n:
            while piece >= 0:
                to = pos + length[piece]
                if failed is None or not failed[to >> 3] >> (to & 7) & 1:
                    if last < 0:
                        break
                    known = pairs.get(last << 32 | piece)
                    if known or known is None and self.fits(last, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                last, pos = piece, to
                piece = longest[pos] if pos < n else -1
            else:
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                pos -= length[piece]
                last = out[-1] if out else -1
                piece = shorter[piece]
        return out

    def word(self, w: str) -> list[int]:
        """Ids of a stretch between places across which nothing merges; characters that are no pieces
        become their bytes."""
        if self.chars.issuperset(w):
            return self.backtracked(w)
        out: list[int] = []
        start = 0
        for i, c in enumerate(w):
            if c not in self.chars:
                out += self.backtracked(w[start:i])
                out += [self.byte_ids[b] for b in c.encode("utf-8", "replace")]
                start = i + 1
        return out + self.backtracked(w[start:])

    def part(self, w: str) -> tuple[str, bytes]:
        got = self.old.get(w)
        if got is None and len(w) > 2 and (mark := self.marks.get(w[-1])):
            # The known pieces of all but the last character are right if that one fits behind them.
            stem = self.young.get(w[:-1]) or self.old.get(w[:-1])
            if stem and self.fits(int(stem[0].rpartition(",")[2]), mark[0]):
                got = f"{stem[0]},{mark[0]}", stem[1] + mark[1]
        if got is None:
            ids = self.word(w.replace(" ", SPACE))
            got = ",".join(map(str, ids)), b"".join([self.text[i] for i in ids])
        if len(w) <= LONGEST_WORD:
            at = hash(w) & SEEN_MASK
            if self.seen[at >> 3] >> (at & 7) & 1:
                if len(self.young) >= MOST_WORDS:
                    self.old, self.young = self.young, {}
                self.young[w] = got
            else:  # words that occur once make up most of a text's different words and are not kept
                self.seen[at >> 3] |= 1 << (at & 7)
                self.marked += 1
                if self.marked > SEEN_MASK // 4:
                    self.seen, self.marked = bytearray(len(self.seen)), 0
        return got

    def parts(self, text: str) -> list[tuple[str, bytes]]:
        """(ids joined by commas, decoded bytes) of the words of a text; the dummy prefix is in the first."""
        if not text:
            return []
        known = self.young.get
        return [known(w) or self.part(w) for w in self.words.findall(" " + text.replace(SPACE, " "))]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.parts(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that form no character become U+FFFD."""
        data = b"".join([self.text[i] for i in ids])
        first = next((i for i in ids if self.text[i]), None)
        if first is not None and self.pieces[first].startswith(SPACE):
            data = data[1:]
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(data: bytes) -> Model:
    return Model(data)


def _coder(model: Callable[[], bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(model())
        for batch in batches:
            counts, ids, decoded = [], [], []
            for value in batch.column(1):
                parts = coder.parts(value.as_py() or "")
                joined = ",".join([p[0] for p in parts])
                counts.append(joined.count(",") + 1 if parts else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([p[1] for p in parts])[1:]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _model(spark_context, path: str) -> Callable[[], bytes]:
    """The model file's bytes, read by the driver and sent to each executor once (half a megabyte)."""
    with open(path, "rb") as f:
        sent = spark_context.broadcast(f.read())
    return lambda: sent.value


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs, repeats included: doc_id, n_tokens, ids_sha256 (of the decimal ids
    joined by commas) and decoded_sha256 (of the decoded text).  Null and empty texts have no ids; a
    null doc_id stays null.  Whole texts are encoded.  An empty table gives no rows; other columns are
    not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        _coder(_model(docs.sparkSession.sparkContext, path)),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def encoded(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs without its text but with its other columns, and ids (array<int>), n_tokens and decoded_sha256
    of each text, which replace columns of those names; null texts count as empty."""
    kept = [c for c in docs.columns if c not in (text_col, "ids", "n_tokens", "decoded_sha256")]
    model = _model(docs.sparkSession.sparkContext, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(model())
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids, decoded = [], []
                for value in part.column(1):
                    parts = coder.parts(value.as_py() or "")
                    ids.append([int(i) for i in ",".join([p[0] for p in parts]).split(",")] if parts else [])
                    decoded.append(hashlib.sha256(b"".join([p[1] for p in parts])[1:]).hexdigest())
                lists, counts = pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, counts, pa.array(decoded)], names=names)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType([
        rows.schema["row"], StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()),
        StructField("decoded_sha256", StringType()),
    ])
    names = schema.names
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *names[1:])
