"""Fuzzy deduplication of lines.

Lines are normalised (lower case, single spaces) and equal ones are brought together by a 128-bit hash,
with their first occurrence: tasks drop repeats of a stretch, deal what is left as bytes to parts by the hash, and sort
each part.  What is passed on of the others is their places, as these go.  A line's tokens are its words, with the number of their occurrence where that
is a power of two: the, the 2, the 4.  So a word counts more if it is repeated, but lines of common words are
not all alike.  A word of over LONG bytes, such as an address or text without blanks, is cut where its own
bytes say so, and the pieces count as words.

Different lines get a 64-bit SimHash of their tokens, and KEYS blocks.  Each block is voted on by a sample of
SAMPLE tokens alone, those that come first in the block's own order of all tokens, so an edit spoils
the blocks whose sample it meets and no other, and two lines that are alike keep one in common.  (A SimHash
whose bits every token votes on spreads an edit over all blocks: at an edit similarity of 0.8 it differs in
ten and more of 64 bits, which leaves no block to join on.)  Lines that share a block and differ in at most
MOST_BITS bits of the SimHash are candidates, and connected ones come together.  All candidates are compared by their
edit similarity, those whose common tokens hold OVERLAP of a line first, as they are likely to be alike; the others
only if what is alike doesn't connect them and their characters allow it.
Of each group that links of at least SIMILARITY connect the first occurrence stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from xxhash import xxh3_128_digest

from bnspark.llm.common import Places, connected_components, drop, marked, materialize, maybe_broadcast, maybe_in, release
from bnspark.llm.hamming import BLOCK, coarse_groups, popcount, runs, spread, starts_of

SIMILARITY = 0.8
KEYS, SAMPLE = 10, 5
# A similarity of SIMILARITY by replaced words means some 12 bits, lines with nothing in common 32.
MOST_BITS = 16
# Replaced words still have a third of their characters in common by chance, so OVERLAP of a line's words means
# a similarity of 0.84: such candidates are compared first, one by one, and what they don't connect all at once.
OVERLAP = 0.75
LONG, PIECE = 16, 2  # bytes of a word that stays whole; a longer one is cut at one place in PIECE, on average
# Groups are cut into blocks of SMALL lines, MANY blocks at most while these stay below LARGE lines.
SMALL, MANY, LARGE = 512, 16, 3_000
NO_ID = -(1 << 63)  # stands for a null doc_id in keys
# What white space there is beside single spaces between words: a text without it has lines that are normal as
# they are.  Single bytes, and characters that only texts beyond ASCII hold.
ODD_BYTES = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
ODD_BEYOND = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
LOW44 = np.uint64((1 << 44) - 1)
EACH_BYTE = np.uint64(0x0101010101010101)
TOGETHER = 32  # lines, at most, whose edit distances to a line are worked out at once
CLOSE = 200  # characters of two stretches, at most, whose distance a closer bound counts
REACH = 8  # words in which most_distance() looks for the next match
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
# Lines travel as bytes to the part that their hash names: one for each PART bytes of input, from stretches of DEAL lines.
PART, DEAL, MOST_PARTS = 4 << 20, 1 << 16, 1 << 16
MOST_HELD, GONE = 1 << 24, 4_096  # characters of a stretch; places that travel together
PLACE = np.dtype([("doc_id", "<i8"), ("doc", "<i8"), ("pos", "<i4")])
LINE = np.dtype([("id", "<u8", 2), *PLACE.descr, ("fp", "<i8"), ("keys", "<i4", KEYS)])
AT = ["doc_id", "doc", "pos"]


def normalised(line: str) -> bytes:
    return " ".join(line.lower().split()).encode("utf-8", "replace")


def normal_lines(text: str) -> list[bytes]:
    """normalised() of each line of a text; blank lines are empty."""
    low = text.lower()
    data = low.encode("utf-8", "replace")
    blank = np.frombuffer(data, np.uint8) <= 32
    odd = data[:1] == b" " or data[-1:] == b" "
    if not odd and (blank[1:] & blank[:-1]).any():
        odd = b"  " in data or b" \n" in data or b"\n " in data
    odd = odd or len(data.translate(None, ODD_BYTES)) < len(data) or len(data) > len(low) and ODD_BEYOND.search(low) is not None
    if odd:
        return [" ".join(x.split()).encode("utf-8", "replace") for x in text.lower().split("\n")]
    return data.split(b"\n")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Odd factors: a token's place in an order is its hash times the order's factor.
ORDERS = (_mixed(np.arange(1, KEYS * SAMPLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)).reshape(KEYS, SAMPLE)


def _cuts(raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where words of over LONG bytes are cut: at characters that follow four bytes whose hash says so, and
    then every LONG bytes where a piece is still longer."""
    some = np.flatnonzero(size > LONG)
    if not len(some):
        return np.empty(0, np.int64)
    n = size[some]
    base = np.repeat(starts[some] - np.append(0, np.cumsum(n)[:-1]), n)
    at = base + np.arange(len(base))
    at = at[(raw[at] & 0xC0) != 0x80]
    first = np.repeat(starts[some], n)[np.searchsorted(base + np.arange(len(base)), at)]
    at = at[at - first >= 4]
    four = np.zeros(len(at), np.uint64)
    for k in range(1, 5):
        four = four << np.uint64(8) | raw[at - k].astype(np.uint64)
    soft = at[_mixed(four) % np.uint64(PIECE) == 0]
    edges = np.union1d(soft, starts[some])
    ends = np.minimum(np.append(edges[1:], len(raw)), (starts + size)[np.searchsorted(starts, edges, side="right") - 1])
    more = (ends - edges - 1) // LONG
    hard = np.repeat(edges, more) + LONG * (1 + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
    return np.union1d(soft, hard)


def token_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of data, whose words single spaces or line feeds part, and the tokens' starts.
    A token has at most LONG bytes, so its length with its first and last eight is all of it."""
    padded = b"\0" * 8 + data + b"\0" * 8
    raw = np.frombuffer(data, np.uint8)
    ends = np.append(np.flatnonzero((raw == 32) | (raw == 10)), len(raw))
    starts = np.append(0, ends[:-1] + 1)
    cuts = _cuts(raw, starts, ends - starts)
    if len(cuts):
        starts, ends = np.sort(np.append(starts, cuts)), np.sort(np.append(ends, cuts))
    size = ends - starts
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    head = eight[starts + 8] & KEEP[np.minimum(size, 8)]
    tail = np.where(size > 8, eight[ends], np.uint64(0))
    return _mixed(_mixed(head + np.uint64(0x9E3779B97F4A7C15)) + tail * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64)), starts


def fingerprints(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of the tokens of each line, and the KEYS hashes of its blocks; no line is blank."""
    out, blocks = [], []
    at = 0
    while at < len(lines):  # stretches of about a megabyte
        stop, size = at, 0
        while stop < len(lines) and size < 1 << 20:
            size += len(lines[stop])
            stop += 1
        h, starts = token_hashes(b"\n".join(lines[at:stop]))
        firsts = np.append(0, np.cumsum([len(x) + 1 for x in lines[at : stop - 1]])).astype(np.int64)
        of = np.zeros(len(h), np.uint64)
        of[np.searchsorted(starts, firsts)[1:]] = 1
        each = np.sort(np.cumsum(of, dtype=np.uint64) << np.uint64(44) | (h & LOW44))  # line after line
        new = np.append(True, each[1:] != each[:-1])
        nth = (np.arange(1, len(each) + 1) - np.maximum.accumulate(np.where(new, np.arange(len(each)), 0))).astype(np.uint64)
        stay = (nth & (nth - np.uint64(1))) == 0
        each, nth = each[stay], nth[stay]
        line = each >> np.uint64(44)
        g = _mixed((each & LOW44) + nth * np.uint64(0x9E3779B97F4A7C15))
        # Eight sums of bytes in each of eight words: pieces of at most 255 words don't overflow.
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        words = np.diff(np.append(first, len(g)))
        n = -(-words // 255)
        of_line = np.append(0, np.cumsum(n)[:-1])
        piece = np.repeat(first, n) + 255 * (np.arange(n.sum()) - np.repeat(of_line, n))
        counts = np.empty((len(first), 8, 8), np.int64)  # line, byte, bit
        for bit in range(8):
            sums = np.add.reduceat((g >> np.uint64(bit)) & EACH_BYTE, piece)
            counts[:, :, bit] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), of_line, axis=0, dtype=np.int64)
        bits = counts.reshape(-1, 64) * 2 > words[:, None]
        out.append(np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel())
        own = np.empty((len(first), KEYS), np.uint64)
        for k in range(KEYS):
            own[:, k] = k
            for by in ORDERS[k]:
                own[:, k] = _mixed(own[:, k] + np.minimum.reduceat(g * by, first))
        blocks.append(own)
        at = stop
    if not out:
        return np.empty(0, np.uint64), np.empty((0, KEYS), np.uint64)
    return np.concatenate(out), np.concatenate(blocks)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel over the longer text after what both start and end with."""
    n = 0
    most = min(len(a), len(b))
    step = 64
    while n < most and a[n : n + step] == b[n : n + step]:
        n += step
    n = min(n, most)
    while n < most and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    most, n = min(len(a), len(b)), 0
    while n < most and a[-1 - n] == b[-1 - n]:
        n += 1
    if n:
        a, b = a[:-n], b[:-n]
    if len(a) < len(b):  # the bits stand for the longer text
        a, b = b, a
    if not b:
        return len(a)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    up, down = full, 0
    for eq in [at.get(c, 0) for c in b]:
        x = ((((eq & up) + up) ^ up) | eq | down) & full
        rise, fall = (down | (full ^ (x | up))) << 1 | 1, (x & up) << 1
        up, down = (fall | (full ^ (x | rise))) & full, rise & x
    return len(b) + up.bit_count() - down.bit_count()


def distances(text: str, others: list[str]) -> np.ndarray:
    """Levenshtein distances of text to others, none of them empty, all at once: their bits stand side by side in one
    number, with a bit between them that takes carries.  No line feed is in a line."""
    chars = np.frombuffer("".join(x + "\n" for x in others).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = chars == 10
    number = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    body, ones = number(~ends), number(np.append(True, ends[:-1]))
    at = {c: number(chars == ord(c)) for c in set(text)}
    up, down = body, 0
    for c in text:
        eq = at[c]
        x = ((((eq & up) + up) ^ up) | eq | down) & body
        rise, fall = (down | (body ^ (x | up))) << 1 | ones, (x & up) << 1
        up, down = (fall | (body ^ (x | rise))) & body, rise & x
    size = -(-len(chars) // 8)
    up_bits, down_bits = (np.unpackbits(np.frombuffer(b.to_bytes(size, "little"), np.uint8), bitorder="little") for b in (up, down))
    starts = np.append(0, np.flatnonzero(ends)[:-1] + 1)
    return len(text) + np.add.reduceat((up_bits.astype(np.int64) - down_bits)[: len(chars)], starts)


def replaced(a: str, b: str) -> list[tuple[str, str]]:
    """What is left to be replaced, by what, if the words are matched in order, behind a mismatch from the nearest place
    on where two agree; each word with a blank."""
    x, y = [w + " " for w in a.split(" ")], [w + " " for w in b.split(" ")]
    n, m = len(x), len(y)
    i = j = 0
    out = []
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        p, q = 1, 1
        for far in range(1, REACH):
            # Of the pairs of skips that add up to `far`, the first.
            k = 0
            while k <= far and not (i + k < n and j + far - k < m and x[i + k] == y[j + far - k]):
                k += 1
            if k <= far:
                p, q = k, far - k
                break
        out.append(("".join(x[i : i + p]), "".join(y[j : j + q])))
        i, j = i + p, j + q
    if i < n or j < m:
        out.append(("".join(x[i:]), "".join(y[j:])))
    return out


def most_distance(a: str, b: str) -> int:
    """An upper bound of the Levenshtein distance in little more than a pass over the words."""
    return sum([max(len(x), len(y)) for x, y in replaced(a, b)])


def alike(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length is at least `least`."""
    longer = max(len(a), len(b))
    if min(len(a), len(b)) < least * longer:
        return False
    left = replaced(a, b)
    most = sum([max(len(x), len(y)) for x, y in left])
    if longer - most >= least * longer:
        return True
    # A closer bound: what is replaced has characters in common, too; it is `apart` at least.
    apart = sum([abs(len(x) - len(y)) for x, y in left])
    if len(left) > 1 and longer - apart >= least * longer:
        for x, y in left:
            if x and y and len(x) + len(y) <= CLOSE:
                most += edit_distance(x, y) - max(len(x), len(y))
                if longer - most >= least * longer:
                    return True
    return longer - edit_distance(a, b) >= least * longer - 1e-9


def bags(lines: list[bytes]) -> np.ndarray:
    """How often each line holds each byte, by its last six bits: an edit of a character of n bytes changes two lines'
    difference by n at each side, at most."""
    out = np.zeros((len(lines), 64), np.int32)
    for k, line in enumerate(lines):
        out[k] = np.bincount(np.frombuffer(line, np.uint8) & 63, minlength=64)
    return out


def _last_null(doc_id: np.ndarray) -> np.ndarray:
    """Numbers in the order of doc_ids, null ids last."""
    return (doc_id.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) - np.uint64(1)


def first_places(group: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with doc_id, doc and pos, in groups of equal numbers, those in each group's first place, one a group, and
    those in other places."""
    order = np.argsort(group[0])
    one = group[0][order]
    shared = np.zeros(len(one), bool)
    shared[1:] = one[1:] == one[:-1]
    shared[:-1] |= shared[1:]
    some = order[shared]  # most are alone
    if not len(some):
        return order, some
    few = rows[some]
    by = np.lexsort((few["pos"], few["doc"], _last_null(few["doc_id"]), *(g[some] for g in reversed(group))))
    some, few = some[by], few[by]
    new = starts_of([g[some] for g in group])
    first = np.repeat(new[:-1], np.diff(new))
    other = np.zeros(len(some), bool)
    for c in AT:
        other |= few[c] != few[c][first]
    return np.append(order[~shared], some[new[:-1]]), some[other]


def _lines(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of documents (doc_id, doc, text) the lines, as bytes, by the part that their hash names, and the places of those
    that are equal to an earlier one of the same stretch, to any part."""
    schema = pa.schema([("part", pa.int64()), ("lines", pa.binary()), ("gone", pa.binary())])

    def dealt(doc_id: list[int], doc: list[int], pos: list[int], lines: list[bytes]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(map(xxh3_128_digest, lines)), "<u8").reshape(-1, 2)
        places = np.empty(len(lines), PLACE)
        for c, x in zip(AT, (doc_id, doc, pos), strict=True):
            places[c] = x
        first, other = first_places([ids[:, 0], ids[:, 1]], places)
        part = (ids[first, 0] % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")  # short numbers are sorted by radix
        first, part = first[order], part[order]
        rows = np.empty(len(first), LINE)
        rows["id"] = ids[first]
        for c in AT:
            rows[c] = places[c][first]
        fp, keys = fingerprints([lines[k] for k in first.tolist()])
        rows["fp"] = fp.view(np.int64)
        rows["keys"] = (keys >> np.uint64(32)).astype(np.uint32).view(np.int32)  # a chance meeting costs a look at the SimHash
        at = starts_of([part])
        own = [rows[s:e].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        gone = [places[other[k : k + GONE]].tobytes() for k in range(0, len(other), GONE)]
        some = (int(ids[0, 1]) % parts + np.arange(len(gone))) % parts
        cols = [np.append(part[at[:-1]].astype(np.int64), some), own + [None] * len(gone), [None] * len(own) + gone]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = [], [], [], []
        size = 0
        for batch in batches:
            for doc_id, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                if not text:
                    continue
                found = normal_lines(text)
                pos = [p for p, line in enumerate(found) if line]
                held[0].extend([doc_id] * len(pos))
                held[1].extend([doc] * len(pos))
                held[2].extend(pos)
                held[3].extend(filter(None, found))
                size += len(text)
                if len(held[3]) >= DEAL or size >= MOST_HELD:
                    if held[3]:
                        yield dealt(*held)
                    held, size = ([], [], [], []), 0
        if held[3]:
            yield dealt(*held)

    return run


GROUPS = "id binary, fp long, keys array<int>, doc_id long, doc long, pos int"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different line (id, fp, keys) with its first place; and the places of the others, without id."""
    names = ["id", "fp", "keys", *AT]

    def out(own: list[pa.Array], rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*own, *(pa.array(np.ascontiguousarray(rows[c])) for c in AT)], names=names)

    for t in runs(batches, ["part"]):
        lines, gone = (np.frombuffer(b"".join(x for x in t.column(c).to_pylist() if x), kind) for c, kind in (("lines", LINE), ("gone", PLACE)))
        first, other = first_places([lines["id"][:, 0], lines["id"][:, 1]], lines)
        rows = lines[first]
        n = len(rows)
        ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.py_buffer(rows["id"].tobytes())])
        keys = pa.ListArray.from_arrays(pa.array(np.arange(0, KEYS * n + 1, KEYS), pa.int32()), pa.array(rows["keys"].ravel()))
        if n:
            yield out([ids, pa.array(np.ascontiguousarray(rows["fp"])), keys], rows)
        for rows in (gone, lines[other]):
            if n := len(rows):
                yield out([pa.nulls(n, x) for x in (pa.binary(), pa.int64(), pa.list_(pa.int32()))], rows)


def _texts(places: Places) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of documents (doc_id, doc, text) the normalised lines whose place may be wanted."""
    schema = pa.schema([("doc_id", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                lines = (text.as_py() or "").split("\n")
                rows += [(doc_id, doc, pos, normalised(lines[pos]).decode()) for pos in places.among(doc_id, doc, len(lines))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


class Tokens:
    """The tokens of lines that are compared with each other.  That of an n-th occurrence stands for those since
    n / 2, too."""

    def __init__(self, lines: list[bytes]):
        hashes, starts = token_hashes(b"\n".join(lines))
        firsts = np.append(0, np.cumsum([len(x) + 1 for x in lines])).astype(np.int64)
        size = np.minimum(np.diff(np.append(starts, firsts[-1])), LONG)
        owner = np.searchsorted(firsts, starts, side="right") - 1
        _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        once, count = np.unique(owner * len(at) + inverse, return_counts=True)
        powers = np.frexp(count)[1]  # of two, up to the count
        power = np.arange(powers.sum()) - np.repeat(np.cumsum(powers) - powers, powers)
        once = np.repeat(once, powers)
        owner, token = once // len(at), once % len(at)
        every, first, self.token = np.unique(token << 6 | power, return_index=True, return_inverse=True)
        self.size = (size[at[token]] * np.maximum(1, 1 << np.maximum(power - 1, 0)))[first]
        self.first = np.searchsorted(owner, np.arange(len(lines) + 1))
        self.total = np.add.reduceat(self.size[self.token], self.first[:-1])
        self.mine = np.zeros(len(every), np.int64)

    def overlap(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others have tokens in common with line i that hold at least OVERLAP of the bytes of
        either's tokens."""
        own = self.token[self.first[i] : self.first[i + 1]]
        self.mine[own] = self.size[own]
        n = self.first[others + 1] - self.first[others]
        ends = np.cumsum(n)
        at = np.repeat(self.first[others] - (ends - n), n) + np.arange(ends[-1])
        both = np.add.reduceat(self.mine[self.token[at]], ends - n)
        self.mine[own] = 0
        return both >= OVERLAP * np.maximum(self.total[others], self.total[i])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of groups that are one part (block -1) the places of lines that are linked to an earlier one.  Of the parts of others
    edges (a, b) of a spanning forest of the links between their lines; of a part of two blocks, those between the blocks,
    as each block is a part of its own."""
    names = ["a", "b", *AT]
    for t in runs(batches, ["comp", "part"]):
        comp, part, signed = (t.column(c).to_numpy() for c in ("comp", "part", "fp"))
        ids, lines, block = t.column("id"), t.column("line"), t.column("block").to_numpy()
        every = t.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, KEYS)
        at = starts_of([comp, part])
        left, right = [], []
        group = np.arange(len(comp))  # lines that links connect, of groups that are one part
        raw = lines.cast(pa.binary()).to_pylist()
        plain = np.array([x.isascii() for x in raw])
        members = np.diff(at)
        # Of two lines all there is to ask is whether they are alike; what spares that is worked out for all pairs at once.
        i = at[:-1][members == 2]
        length = np.array([len(x) for x in lines.to_pylist()])
        near = (popcount((signed[i] ^ signed[i + 1]).view(np.uint64)) <= MOST_BITS) & (every[i] == every[i + 1]).any(axis=1)
        near &= np.minimum(length[i], length[i + 1]) >= SIMILARITY * np.maximum(length[i], length[i + 1])
        for j in i[near].tolist():  # a link that several parts find does no harm
            if alike(lines[j].as_py(), lines[j + 1].as_py()):
                if block[j] < 0:
                    group[j + 1] = j
                    continue
                left.append(ids[j].as_py())
                right.append(ids[j + 1].as_py())
        more = np.flatnonzero(members > 2)
        tokens = Tokens(raw) if len(more) else None
        for k in more:
            s, e = int(at[k]), int(at[k + 1])
            fp, keys, own = signed[s:e].view(np.uint64), every[s:e], block[s:e]
            text = lines.slice(s, e - s).to_pylist()
            name = ids.slice(s, e - s).to_pylist()
            size = np.array([len(x) for x in text])
            across = bool((own != own[0]).any())
            label = np.arange(e - s)
            edges = len(left)
            bag = None
            for i in range(1, e - s):
                bits = popcount(fp[:i] ^ fp[i])
                near = (bits <= MOST_BITS) & (np.minimum(size[:i], size[i]) >= SIMILARITY * np.maximum(size[:i], size[i]))
                if across:
                    near &= own[:i] != own[i]
                others = np.flatnonzero(near)
                others = others[(keys[others] == keys[i]).any(axis=1)]
                others = others[np.argsort(bits[others], kind="stable")]  # the closest first: its group falls out with it
                step, less = 4, []
                while len(others := others[label[others] != label[i]]):
                    some, others = others[:step], others[step:]
                    step *= 2
                    many = tokens.overlap(s + i, s + some)
                    less.append(some[~many])
                    for j in some[many].tolist():
                        if label[j] != label[i] and alike(text[j], text[i]):
                            label[label == label[j]] = label[i]
                            left.append(name[j])
                            right.append(name[i])
                # Those with few tokens in common are compared last, many at once.
                others = np.concatenate(less) if less else others
                if len(others := others[label[others] != label[i]]):
                    bag = bags(raw[s:e]) if bag is None else bag
                    apart = np.abs(bag[others] - bag[i]).sum(axis=1) + np.abs(bag[others].sum(axis=1) - bag[i].sum())
                    # Twice the bytes that the larger bag has and the other lacks; a character has four bytes at most.
                    width = np.where(plain[s + others] & plain[s + i], 1, 4)
                    others = others[apart <= 2 * width * (1 - SIMILARITY) * np.maximum(size[others], size[i]) + 1e-6]
                while len(others := others[label[others] != label[i]]):
                    some, others = others[:TOGETHER], others[TOGETHER:]
                    longer = np.maximum(size[some], size[i])
                    near = longer - distances(text[i], [text[j] for j in some]) >= SIMILARITY * longer - 1e-9
                    for j in some[near].tolist():
                        if label[j] != label[i]:
                            label[label == label[j]] = label[i]
                            left.append(name[j])
                            right.append(name[i])
            if own[0] < 0:
                group[s:e] = s + label
                del left[edges:], right[edges:]
        if left:
            none = [pa.nulls(len(left), x) for x in (pa.int64(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary()), *none], names=names)
        places = np.empty(len(comp), PLACE)
        for c in AT:
            places[c] = t.column(c).to_numpy()
        if len(other := places[first_places([group], places)[1]]):
            none = pa.nulls(len(other), pa.binary())
            yield pa.RecordBatch.from_arrays([none, none, *(pa.array(np.ascontiguousarray(other[c])) for c in AT)], names=names)


def _parts(docs: DataFrame) -> int:
    """How many parts the lines of docs are dealt to, by what Spark knows of its size."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_PARTS, max(32, size // PART))


def gone_lines(docs: DataFrame, block: int = BLOCK, small: int = SMALL, many: int = MANY) -> DataFrame:
    """docs (doc_id, doc, text) to (doc_id, doc, gone): of each document that loses lines their positions, in any
    order; doc is a hash that together with doc_id tells documents apart."""
    spark = docs.sparkSession
    dealt = docs.select("doc_id", "doc", "text").mapInArrow(_lines(_parts(docs)), "part long, lines binary, gone binary")
    lines = materialize(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_groups, GROUPS), "groups")
    release(spark)
    groups, gone = lines.where("id is not null"), lines.where("id is null").select(*AT)
    inside = coarse_groups(groups.select("fp", "keys"), MOST_BITS, block)
    release(spark)
    cand = groups.join(maybe_broadcast(inside), "fp").select(F.col("component").alias("comp"), "id", "fp", "keys", *AT)
    cand = materialize(cand, "candidates")
    sizes = materialize(cand.groupBy("comp").agg(F.count("*").alias("members")).where("members > 1"), "sizes")
    drop(inside)
    wanted = cand.join(maybe_broadcast(sizes), "comp").select("comp", "members", "id", "fp", "keys", *AT)
    wanted = materialize(wanted, "wanted")
    # Of the texts only lines that may be wanted are shuffled.  A document that repeats gives its lines twice, which
    # links them to themselves alone.
    count = wanted.count()
    holders = maybe_in(docs.select("doc_id", "doc", "text"), "doc", wanted.select("doc"), count)
    found = holders.mapInArrow(_texts(Places(wanted.select(*AT), count)), "doc_id long, doc long, pos int, line string")
    texts = found.join(wanted, AT).select("comp", "members", "id", "fp", "keys", "line", *AT)
    parts = spread(texts, "id", small, many, LARGE)
    links = materialize(parts.mapInArrow(_verify, "a binary, b binary, doc_id long, doc long, pos int"), "links")
    release(spark)
    gone = gone.unionByName(links.where("a is null").select(*AT))
    edges, final = links.where("a is not null").select("a", "b"), None
    if not edges.isEmpty():
        final = connected_components(edges)
        release(spark)
        place = F.struct((F.col("doc_id") == NO_ID).alias("none"), *AT)  # null ids come last
        joined = wanted.withColumnRenamed("id", "node").join(maybe_broadcast(final), "node").select("component", place.alias("place"))
        first = joined.groupBy("component").agg(F.min("place").alias("first"))
        gone = gone.unionByName(joined.join(first, "component").where("place <> first").select(*["place." + c for c in AT]))
    out = materialize(gone.groupBy("doc_id", "doc").agg(F.collect_set("pos").alias("gone")), "gone")
    for old in (lines, cand, sizes, wanted, links, final):
        drop(old)
    release(spark)
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        kept = [sorted({p for p, line in enumerate(normal_lines(text or "")) if line} - set(gone or ())) for text, gone in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.list_(pa.int32()))], names=["doc_id", "doc", "kept"])


def kept_lines(docs: DataFrame, block: int = BLOCK, small: int = SMALL, many: int = MANY) -> DataFrame:
    """docs (doc_id, doc, text) to (doc_id, doc, kept): of each document the positions of the lines that stay."""
    both = docs.join(gone_lines(docs, block, small, many), ["doc_id", "doc"], "left").select("doc_id", "doc", "text", "gone")
    return both.mapInArrow(_kept, "doc_id long, doc long, kept array<int>").where("size(kept) > 0").distinct()


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row", "text", "n_lines", "dropped"]
    for batch in batches:
        texts, lines, dropped = [], [], []
        for value, lost in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text, all_lines = value, (value or "").split("\n")
            gone = sorted(lost or ())
            if gone:
                lost = set(gone)
                text = "\n".join([x for p, x in enumerate(all_lines) if p not in lost])
            texts.append(text)
            lines.append(len(all_lines) if value else 0)
            dropped.append(gone)
        cols = [pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)


def _deduped(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """(row, text, n_lines, dropped): the carried columns as a struct, the text that is left, the number
    of lines before and the positions of those that went."""
    known, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        F.coalesce(known, F.lit(NO_ID)).alias("doc_id"), F.xxhash64(known.isNull(), text).alias("doc"), text.alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"),
    )
    gone = gone_lines(rows.select("doc_id", "doc", "text"))
    # Only documents that may lose a line are shuffled.
    some, feed = F.coalesce("text", F.lit("")), F.lit("\n")
    feeds = F.octet_length(some) - F.octet_length(F.replace(some, feed, F.lit("")))
    known_rows = marked(rows, "doc", gone.select("doc"), gone.count(), "_in")
    both = known_rows.where("_in").join(gone, ["doc_id", "doc"], "left").select("row", "text", "gone")
    whole = known_rows.where("not _in").select(
        "row", "text",
        F.when(some == "", 0).otherwise(feeds + 1).cast("long").alias("n_lines"),
        F.array().cast("array<int>").alias("dropped"),
    )
    schema = StructType([
        both.schema["row"], StructField("text", StringType()), StructField("n_lines", LongType()),
        StructField("dropped", ArrayType(IntegerType())),
    ])
    return both.mapInArrow(_apply, schema).unionByName(whole)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all its columns and rows, texts without the lines that stay elsewhere.

    The first occurrence by doc_id, then position, stays.  Blank lines always stay and belong to no group.
    Null texts stay null and have no lines.  Rows equal in doc_id and text are one document: they come
    out equal.  Rows with a null doc_id come last in the order of occurrences.  A document may come out
    empty.  An empty table gives no rows; no name of another column matters."""
    rest = [c for c in docs.columns if c != text_col]
    done = _deduped(docs, id_col, text_col, rest)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_dropped, dropped (positions, from 0) and
    text_sha256 of what is left; the cases are those of dedup_lines()."""
    out = _deduped(docs, id_col, text_col, [id_col])
    return out.select(
        F.col("row")[id_col].cast("long").alias("doc_id"), "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
