"""Line, exact and near deduplication against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from bnspark.llm import common, exact_dedup, hamming, line_dedup, near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key int, `a.b` string, count long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "x", 1, "y", 2) for i, t in rows], SCHEMA)


def texts(seed=0):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(15, 60))) for _ in range(25)]
    rows = []
    for i in range(90):
        lines = [rng.choice(base) for _ in range(rng.randrange(1, 5))]
        if rng.random() < 0.5:
            words = lines[0].split()
            words[rng.randrange(len(words))] = "zork"
            lines[0] = " ".join(words)
        rows.append((i * 3, "\n".join(lines)))
    rows += [(300, None), (301, ""), (302, "  "), (303, rows[0][1]), (303, rows[0][1]), (304, rows[0][1].upper()), (None, rows[1][1]), (None, "only here")]
    rows += [(305, "long " * 40_000), (306, "long " * 40_000 + "end"), (307, "\n\n \n" + base[0] + "\n\n")]
    return rows


# Lines.


def brute_kept(rows):
    """Positions that go, for each different (doc_id, text), by the edit similarity of all pairs of lines."""
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows})
    first, order = {}, []
    for k, (_, _, t) in enumerate(docs):
        for p, line in enumerate(t.split("\n")):
            n = line_dedup.normalised(line)
            if n:
                first.setdefault(n, (k, p))
                order.append((k, p, n))
    lines = list(first)
    bags = np.zeros((len(lines), 512), np.int32)
    for k, n in enumerate(lines):
        for c in n.decode():
            bags[k, ord(c) % 512] += 1
    size = bags.sum(1)
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):  # an edit changes a bag of characters by one at each side, at most
        less = np.maximum(bags[:i], bags[i]).sum(1) - np.minimum(size[:i], size[i])
        for j in np.flatnonzero(less <= (1 - line_dedup.SIMILARITY) * np.maximum(size[:i], size[i]) + 1e-6):
            if find(i) != find(j) and line_dedup.alike(lines[i].decode(), lines[j].decode()):
                root[find(i)] = find(j)
    best = {}
    for i, n in enumerate(lines):
        best[find(i)] = min(best.get(find(i), first[n]), first[n])
    stay = set(best.values())
    return {docs[k]: sorted(p for kk, p, _ in order if kk == k and (k, p) not in stay) for k in range(len(docs))}


def test_line_dedup_matches_brute_force(spark):
    rows = texts()
    got = line_dedup.line_report(table(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute_kept(rows)
    by_id = {}
    for (none, i, t), gone in want.items():
        by_id.setdefault(None if none else i, []).append((gone, t))
    fuzzy = 0
    for r in got:
        options = by_id[r.doc_id]
        left = ["\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone) for gone, t in options]
        assert (list(r.dropped), r.text_sha256) in [(g, hashlib.sha256(x.encode()).hexdigest()) for (g, _), x in zip(options, left)]
        fuzzy += r.n_dropped
    assert fuzzy > 20


@pytest.mark.parametrize("block,small,many", [(3, 2, 100), (5, 3, 4), (20_000, 64, 32)])
def test_blocks_of_hot_groups_lose_nothing(spark, block, small, many):
    rng = random.Random(4)
    words = ["word%d" % i for i in range(120)]
    rows = []
    for i in range(40):
        near = list(words)
        near[rng.randrange(120)] = "other%d" % i
        rows.append((i, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) doc", "text")
    kept = {(r.doc_id): r.kept for r in line_dedup.kept_lines(docs, block, small, many).collect()}
    want = brute_kept(rows)
    assert kept == {i: [0] for (_, i, _), gone in want.items() if not gone}


def test_stage_keeps_columns_and_rows(spark):
    docs = table(spark, texts())
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    assert line_dedup.line_report(docs.limit(0)).count() == 0


def test_normal_lines_and_distances():
    for t in ("a b\nc", " a", "a  b\n\tc ", "É  x\n\n", "", "a\r\nb", "x y", "a \nb"):
        assert line_dedup.normal_lines(t) == [line_dedup.normalised(x) for x in t.split("\n")]
    assert line_dedup.edit_distance("kitten", "sitting") == 3
    assert line_dedup.edit_distance("", "abc") == 3 and line_dedup.edit_distance("abc", "abc") == 0
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(80))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert line_dedup.edit_distance(a, b) == row[-1]
        spaced = a.replace("c", " "), b.replace("c", " ")
        assert line_dedup.most_distance(*spaced) >= line_dedup.edit_distance(*spaced)
    assert line_dedup.most_distance("one two three four", "one 2 three four") == 4
    long = "これは空白のない長い行です。一文字だけ違う行を見つけます。".encode()
    lines = [b"a b c", b"x", b"many " * 700 + b"words", b"a b c", long, b"y" * 100, long + b" " + long]
    fp, keys = line_dedup.fingerprints(lines)
    for x, f, k in zip(lines, fp, keys):
        own = line_dedup.fingerprints([x])
        assert own[0][0] == f and (own[1][0] == k).all()
    h, starts = line_dedup.token_hashes(b"\n".join(lines))
    assert max(np.diff(starts)) <= line_dedup.LONG + 1


def test_all_bytes_of_a_word_count():
    a, b = (b"http://example.com/" + x * 20 + b"/the/end/of/the/address" for x in (b"ab", b"cd"))
    fp, keys = line_dedup.fingerprints([a, b])
    assert int(fp[0] ^ fp[1]).bit_count() > 8
    a, b = ("これは空白のない長い行です。" + x + "一文字だけ違う行を見つけます。長い行には部分がいくつもあります。" for x in ("", "新"))
    fp, keys = line_dedup.fingerprints([a.encode(), b.encode()])
    assert int(fp[0] ^ fp[1]).bit_count() <= line_dedup.MOST_BITS and (keys[0] == keys[1]).any()


@pytest.mark.parametrize("n", [8, 12, 20, 40])
def test_recall_of_lines_with_a_word_replaced(n):
    """At least 0.9 of the pairs whose edit similarity is high enough are compared."""
    rng = random.Random(n)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 11))) for _ in range(3_000)]
    a, b = [], []
    for _ in range(2_000):
        own = [rng.choice(vocab) for _ in range(n)]
        other = list(own)
        for _ in range(max(1, n // 15)):
            other[rng.randrange(n)] = rng.choice(vocab)
        if line_dedup.alike(" ".join(own), " ".join(other)):
            a.append(" ".join(own).encode())
            b.append(" ".join(other).encode())
    (fa, ka), (fb, kb) = line_dedup.fingerprints(a), line_dedup.fingerprints(b)
    tokens = [line_dedup.Tokens([x, y]).overlap(0, np.array([1]))[0] for x, y in zip(a, b)]
    found = (np.bitwise_count(fa ^ fb) <= line_dedup.MOST_BITS) & (ka == kb).any(1) & np.array(tokens)
    assert len(a) > 1_500 and found.mean() >= 0.9


def test_recall_on_documents(spark):
    """Against all pairs of lines by edit similarity: nothing else goes, and at least 0.9 of what is to go."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 120")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i: set(gone) for (_, i, _), gone in brute_kept(rows).items()}
    got = {r.doc_id: set(r.dropped) for r in line_dedup.line_report(docs).collect()}
    assert all(got[i] <= want[i] for i in want)
    exact, seen = 0, set()
    for i, t in sorted(rows):
        for line in (t or "").split("\n"):
            n = line_dedup.normalised(line)
            exact += bool(n) and n in seen
            seen.add(n)
    fuzzy = sum(map(len, want.values())) - exact
    assert fuzzy > 10 and sum(map(len, got.values())) - exact >= 0.9 * fuzzy


def test_distances_of_many_at_once():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé \U0001f600") for _ in range(n))
    for _ in range(100):
        a, others = word(rng.randrange(1, 90)), [word(rng.randrange(1, 90)) for _ in range(rng.randrange(1, 9))]
        assert line_dedup.distances(a, [*others, a]).tolist() == [line_dedup.edit_distance(a, b) for b in [*others, a]]


def test_candidates_with_few_words_in_common_are_compared(spark):
    """Typing errors in over a quarter of the words: lines that share a block and are alike are one."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    found = []
    for _ in range(4_000):
        own = [word() for _ in range(20)]
        other = [w[:4] + "z" + w[5:] if k < 6 else w for k, w in enumerate(own)]
        pair = [" ".join(x).encode() for x in (own, other)]
        fp, keys = line_dedup.fingerprints(pair)
        if int(fp[0] ^ fp[1]).bit_count() <= line_dedup.MOST_BITS and (keys[0] == keys[1]).any():
            assert not line_dedup.Tokens(pair).overlap(0, np.array([1]))[0]
            found.append([x.decode() for x in pair])
        if len(found) == 10:
            break
    rows = [(2 * i + k, t) for i, pair in enumerate(found) for k, t in enumerate(pair)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_report(table(spark, rows)).collect()}
    assert len(found) == 10 and got == {i: i % 2 for i, _ in rows}


def shuffled(spark):
    """Bytes of shuffles so far."""
    jvm, none = spark._jvm, spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return {(stages.apply(k).stageId(), stages.apply(k).attemptId()): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_line_dedup_shuffles_no_text_that_stays_as_it_is(spark):
    rng = random.Random(6)
    line = lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(120))
    rows = [(i, "\n".join(line() for _ in range(3))) for i in range(400)]
    rows += [(1_000 + i, t) for i, (_, t) in enumerate(rows[:3])]
    docs = table(spark, rows).cache()
    docs.count()
    before = shuffled(spark)
    assert line_dedup.line_report(docs).where("n_dropped > 0").count() == 3
    moved = sum(n for k, n in shuffled(spark).items() if k not in before)
    docs.unpersist()
    assert moved < 0.5 * sum(len(t) for _, t in rows)


def test_places_are_all_found(spark):
    rng = random.Random(2)
    rows = [(rng.choice([i, -i, line_dedup.NO_ID]), rng.randrange(-(1 << 63), 1 << 63), rng.randrange(50)) for i in range(300)]
    places = common.Places(spark.createDataFrame(rows, "doc_id long, doc long, pos int"), len(rows))
    assert all(pos in places.among(i, d, 50) for i, d, pos in rows)
    assert sum(len(places.among(i, d, 50)) for i, d, _ in rows) < 2 * len(rows)


# Exact.


def fold(t):
    return (t or "").encode().translate(exact_dedup.LOWER)


@pytest.mark.parametrize("width", [16, 1])
def test_exact_duplicates(spark, width):
    """A digest of one byte makes different chunks share names, which ranks must tell apart."""
    rows = texts()
    got = exact_dedup.exact_duplicates(table(spark, rows), width=width).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    want = []
    for i, t in rows:
        known = [x for x in groups[fold(t)] if x is not None]
        keep = max(known) if known else None
        want.append((i, keep, len(groups[fold(t)]), i == keep, hashlib.sha256(fold(t)).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_exact_duplicates_of_nothing(spark):
    assert exact_dedup.exact_duplicates(table(spark, []).limit(0)).count() == 0


def test_chunks_cover_texts():
    rng = random.Random(2)
    for n in (0, 1, 31, 32, 33, 5_000, 200_000):
        data = bytes(rng.randrange(97, 123) for _ in range(n))
        ends = exact_dedup.cuts(data).tolist()
        assert (ends[-1:] or [0])[0] == n and ends == sorted(set(ends))
        assert all(b - a <= exact_dedup.MOST_CHUNK for a, b in zip([0, *ends], ends))
    same = bytes(60_000)
    assert exact_dedup.cuts(same)[-1] == 60_000
    a = bytes(rng.randrange(256) for _ in range(50_000))
    shared = set(exact_dedup.cuts(a).tolist()) & {e - 10 for e in exact_dedup.cuts(b"0123456789" + a).tolist()}
    assert len(shared) > 10  # cuts follow the content


# Near.


def brute_components(rows, shingle):
    fp = [simhash.simhash(t, shingle) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= simhash.MOST_BITS:
                comp[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, fp[k], least.get(find(k))) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("shingle,block", [(3, 20_000), (1, 2)])
def test_simhash_components(spark, shingle, block):
    rows = texts(3)
    got = simhash.simhash_components(table(spark, rows), shingle=shingle, block=block).collect()
    want = [(i, f - (1 << 64) if f >> 63 else f, c) for i, f, c in brute_components(rows, shingle)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_simhash_of_a_text_is_that_of_its_definition():
    from xxhash import xxh64_intdigest

    text = "The  CAT sat\ton É the mat the cat sat"
    words = [w for w in text.encode().translate(simhash.LOWER).split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    assert simhash.simhash(text, 3) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.simhash(None, 3) == simhash.simhash(" \n", 3) == 0
    assert simhash.simhash("one two", 3) == xxh64_intdigest(b"one two", 42)


def test_golay_keys_meet():
    rng = random.Random(5)
    table_ = simhash._decoder()
    assert np.bincount(table_, minlength=4096).tolist() == [2048] * 4096  # perfect: equal shares of all words
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randrange(3)):
            y ^= 1 << b
        a, b = (set(simhash.golay_keys(np.array([v], np.uint64))[1].tolist()) for v in (x, y))
        assert a & b


def test_keep_one(spark):
    rows = texts(6)
    docs = table(spark, rows)
    out = simhash.keep_one(docs, shingle=3)
    assert out.columns == docs.columns
    comps = {i: c for i, _, c in brute_components(rows, 3) if i is not None}
    ids = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert ids == sorted({i for i, c in comps.items() if i == c})
    assert sum(r.doc_id is None for r in out.collect()) == 2
    assert simhash.keep_one(docs.limit(0)).count() == 0


# Near-copies by shingles.


def brute_groups(rows, shingle=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))})
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
                links += sets[i] != sets[j]
    return [find(k) for k in range(len(rows))], links


@pytest.mark.parametrize("small,many,block", [(256, 32, 20_000), (2, 100, 3)])
def test_near_copies_match_brute_force_on_jaccard(spark, small, many, block):
    rng = random.Random(8)
    vocab = ["v%d" % i for i in range(400)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randrange(3, 300))]
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(own[rng.randrange(2) :])))
    rows += [(500, None), (501, " "), (502, rows[0][1].upper())]
    groups, links = brute_groups(rows)
    assert links > 20
    got = {r.doc_id for r in near_copies.one_of_each(table(spark, rows), small=small, many=many, block=block).collect()}
    assert got == {rows[k][0] for k in {g: k for k, g in reversed(list(enumerate(groups)))}.values()}


def test_near_copies_recall_at_the_threshold():
    """Texts whose similarity is just over the limit share a key and are close in at least 0.95 of the cases."""
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(400):
        union = rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        a, b = (np.sort(union[cut]) for cut in (slice(0, 270), slice(30, 300)))
        assert near_copies.alike([a, b])[0, 1]
        (fa, ka), (fb, kb) = near_copies.fingerprint(a), near_copies.fingerprint(b)
        found += int(fa ^ fb).bit_count() <= near_copies.MOST_BITS and bool((ka == kb).any())
    assert found >= 380


def test_alike_is_jaccard_in_columns_of_any_width(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in (90, 90, 120, 200, 200, 300, 5)]
    want = [[5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for b in sets] for a in sets]
    for cells in (1, 50, 1 << 20):
        monkeypatch.setattr(near_copies, "CELLS", cells)
        assert (near_copies.alike(sets) == np.array(want)).all()
    a, b = near_copies.forest(np.array(want))
    assert len(a) == len(sets) - len({frozenset(np.flatnonzero(np.linalg.matrix_power(np.array(want, float), 7)[k])) for k in range(7)})


def test_golay_keys_give_candidates_of_near_copies(spark):
    """Fingerprints two bits apart come together, whatever their blocks; three bits apart, only by a block."""
    rng = random.Random(1)
    rows, pairs = [], []
    for g in range(40):
        fp = rng.randrange(1 << 64)
        n = 2 + (g % 2)
        other = fp ^ sum(1 << b for b in rng.sample(range(64), n))
        pair = [int(np.array(x, np.uint64).view(np.int64)) for x in (fp, other)]
        rows += [(x, [1_000 * g + 100 * k + j for j in range(12)]) for k, x in enumerate(pair)]
        pairs.append((n, pair))
    got = {r.fp: r.component for r in near_copies.candidates(spark.createDataFrame(rows, "fp long, keys array<long>")).collect()}
    assert all((a in got and got[a] == got.get(b)) == (n == 2) for n, (a, b) in pairs)


def test_near_copies_go_by_row_not_by_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (5, a + " end"), (5, b), (7, c), (7, c), (None, c + " end"), (None, "alone")]
    got = [(r.doc_id, r.text) for r in near_copies.one_of_each(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (5, b), (7, c), (None, "alone")], key=str)


# Plumbing.


def test_run_links_and_runs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 1, dtype=np.int64).astype(np.uint64)
    fp = np.unique(base ^ (np.uint64(1) << rng.integers(0, 60, 50).astype(np.uint64)))
    a, b = hamming.run_links(fp, 2)
    assert len(a) == len(fp) - 1


@pytest.mark.parametrize("kind", ["long", "string"])
def test_connected_components(spark, kind):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(0, i) for i in range(500, 700)] + [(i, i + 1) for i in range(700, 760)]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        root[max(find(u), find(v))] = min(find(u), find(v))
    name = (lambda v: v) if kind == "long" else (lambda v: f"{v:04d}")
    got = common.connected_components(spark.createDataFrame([(name(u), name(v)) for u, v in edges], f"a {kind}, b {kind}"))
    linked = {v for e in edges if e[0] != e[1] for v in e}
    assert {r.node: r.component for r in got.collect()} == {name(v): name(find(v)) for v in linked}


def test_components_of_a_path_take_few_rounds(spark, monkeypatch):
    made = []
    own = common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: made.append(name) or own(df, name))
    got = common.connected_components(spark.range(1000).selectExpr("id as a", "id + 1 as b"))
    assert got.where("component <> 0").isEmpty() and got.count() == 1001
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert made.count("edges") == 3 and made.count("hook") <= 12  # the first hook, and doublings


def test_attach_spreads_hot_keys(spark):
    rows = spark.range(5_000).selectExpr("id", "if(id < 3000, 7, id) as k")
    groups = rows.groupBy("k").count().selectExpr("k", "count as n", "k * 2 as twice")
    out = common.attach(rows, groups.where("k % 2 = 1"), "k", "n", 5_000)
    assert out.count() == 5_000
    assert out.where("k % 2 = 1 and (twice is null or twice <> k * 2) or k % 2 = 0 and twice is not null").count() == 0


@pytest.mark.parametrize("most", [15, 27])
def test_maybe_in_loses_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BITMAP", most)
    rows = spark.range(20_000).selectExpr("id", "cast(id as string) as k", "1 as _page_")
    keys = rows.where("id % 17 = 3").select("k")
    got = {r.id for r in common.maybe_in(rows, "k", keys, keys.count()).collect()}
    assert got >= set(range(3, 20_000, 17)) and len(got) < 2_500
    assert common.maybe_in(rows, "k", keys.limit(0), 0).count() == 0


def brute_links(rows, most):
    """Components of the fingerprints that a key brings together at most `most` bits apart."""
    label = {fp: fp for fp, _ in rows}
    for a, ka in rows:
        for b, kb in rows:
            if label[a] != label[b] and set(ka) & set(kb) and ((a ^ b) & (1 << 64) - 1).bit_count() <= most:
                old, new = sorted((label[a], label[b]))[::-1]
                label = {fp: new if c == old else c for fp, c in label.items()}
    return {fp: c for fp, c in label.items() if list(label.values()).count(c) > 1}


@pytest.mark.parametrize("kind", ["int", "long"])
@pytest.mark.parametrize("block", [hamming.BLOCK, 12])
def test_list_links(spark, monkeypatch, kind, block):
    """Keys are dealt to parts as bytes, those with more than `block` rows in pairs of blocks: the same components."""
    monkeypatch.setattr(hamming, "PART", 50)
    rng = random.Random(5)
    width = 31 if kind == "int" else 63
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    rows = []
    for _ in range(240):
        fp = rng.choice(base)
        for bit in rng.sample(range(63), rng.randrange(3)):
            fp ^= 1 << bit
        rows.append((fp, [rng.choice([-7, 5, rng.randrange(40), rng.getrandbits(width) - (1 << width - 1)]) for _ in range(4)]))
    rows += rows[:5]
    df = spark.createDataFrame(rows, f"fp long, keys array<{kind}>").repartition(3)
    got = common.connected_components(hamming.list_links(df, 4, block)).collect()
    assert {r.node: r.component for r in got} == brute_links(rows, 4)
    groups = df.selectExpr("fp", "keys").withColumn("keys", F.expr("slice(keys, 1, 0)"))
    assert hamming.list_links(groups, 4, block).count() == 0
    assert hamming.list_links(df.limit(0), 4, block).count() == 0


def test_list_links_move_bytes(spark):
    """No row for each key meets a shuffle on the way to the links."""
    df = spark.range(3_000).selectExpr("id as fp", "array(id % 1000, id + 5000) as keys")
    plan = hamming.list_links(df, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "keys#" in plan


def test_alike_is_exact():
    """The bounds that spare edit distances don't change what is alike."""
    rng = random.Random(9)
    for _ in range(1_500):
        a = ["".join(rng.choice("abc\u00e9") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 25))]
        b = list(a)
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = ["xy"] * rng.randrange(2)
        x, y = " ".join(a), " ".join(b)
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        longer = max(len(x), len(y))
        assert line_dedup.edit_distance(x, y) == row[-1] <= line_dedup.most_distance(x, y)
        assert line_dedup.alike(x, y) == (longer - row[-1] >= 0.8 * longer - 1e-9)


def test_empty_lines_and_whole_documents(spark):
    """Documents that lose nothing are told by their line feeds, whatever empty lines they hold."""
    rows = [(1, "one two three\n\nfour five six"), (2, "\nseven eight nine"), (3, "ten eleven twelve\n"), (4, ""), (5, None), (6, "\n"), (7, "four five six\n\n\nalone here now")]
    got = {r.doc_id: (r.n_lines, r.dropped) for r in line_dedup.line_report(table(spark, rows)).collect()}
    assert got == {1: (3, []), 2: (2, []), 3: (2, []), 4: (0, []), 5: (0, []), 6: (2, []), 7: (4, [0])}


@pytest.mark.parametrize("few", [0, common.LOCAL_EDGES])
def test_components_ended_by_the_driver(spark, monkeypatch, few):
    """What rounds leave of a graph is ended by the driver with the same components, of numbers and of bytes."""
    monkeypatch.setattr(common, "LOCAL_EDGES", few)
    rng = random.Random(3)
    order = rng.sample(range(400), 400)
    edges = list(zip(order[:150], order[1:151], strict=True)) + [(rng.randrange(150, 400), rng.randrange(150, 400)) for _ in range(120)]
    label = list(range(400))
    for a, b in edges:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    want = {a: label[a] for e in edges if e[0] != e[1] for a in e}
    made = []
    kept = common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: made.append(name) or kept(df, name))
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want
    assert (len([x for x in made if x == "edges"]) == 2) == (few > 0)
    rows = [(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in edges]
    got = common.connected_components(spark.createDataFrame(rows, "a binary, b binary"))
    assert {int.from_bytes(r.node, "big"): int.from_bytes(r.component, "big") for r in got.collect()} == want


def test_groups_that_are_one_part_need_no_components(spark, monkeypatch):
    """The task that compares a small group knows what its links connect; only groups of several parts need more."""
    monkeypatch.setattr(line_dedup, "connected_components", lambda edges: pytest.fail("components of small groups"))
    rows = texts()[:40]
    want = brute_kept(rows)
    got = {r.doc_id: r.dropped for r in line_dedup.line_report(table(spark, rows)).collect()}
    assert got == {i: gone for (_, i, _), gone in want.items()} and any(got.values())


@pytest.mark.parametrize("parts,deal", [(1, 1), (3, 7), (50, 1_000)])
def test_lines_meet_as_bytes(monkeypatch, parts, deal):
    """Each different line has one row with its first place, whatever stretches it came in; all other places are gone."""
    monkeypatch.setattr(line_dedup, "DEAL", deal)
    monkeypatch.setattr(line_dedup, "GONE", 2)
    rng = random.Random(8)
    docs = [(rng.choice([i, -i, line_dedup.NO_ID]), i, "\n".join(rng.choice(["one two", "One  two", "", " ", "x%d" % rng.randrange(30)]) for _ in range(6))) for i in range(60)]
    docs += docs[:5] + [(7, 70, None), (8, 80, "")]  # repeats are one document
    schema = pa.schema([("doc_id", pa.int64()), ("doc", pa.int64()), ("text", pa.string())])
    batches = pa.Table.from_pylist([dict(zip(schema.names, d, strict=True)) for d in docs], schema).to_batches(9)
    dealt = pa.Table.from_batches(line_dedup._lines(parts)(iter(batches))).sort_by("part")
    got = pa.Table.from_batches(line_dedup._groups(iter(dealt.to_batches(4)))).to_pylist()
    first, places = {}, set()
    for i, d, text in docs:
        for p, line in enumerate((text or "").split("\n")):
            if n := line_dedup.normalised(line):
                first[n] = min(first.get(n, (2,)), (i == line_dedup.NO_ID, i, d, p))
                places.add((i, d, p))
    found = {r["id"]: (r["doc_id"], r["doc"], r["pos"]) for r in got if r["id"] is not None}
    assert found == {xxh3_128_digest(n): f[1:] for n, f in first.items()} and len(found) == sum(r["id"] is not None for r in got)
    assert {(r["doc_id"], r["doc"], r["pos"]) for r in got if r["id"] is None} == places - set(found.values())
    fp, keys = line_dedup.fingerprints(list(first))
    own = {r["id"]: (r["fp"], r["keys"]) for r in got if r["id"] is not None}
    for n, f, k in zip(first, fp.view(np.int64).tolist(), (keys >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist(), strict=True):
        assert own[xxh3_128_digest(n)] == (f, k)


def test_places_of_a_repeated_document_are_few(spark):
    line = "one two three four five six seven eight"
    rows = [(1, 1, line)] + [(2, 2, "other words\n" + line)] * 200 + [(3, 3, line + " nine")]
    docs = spark.createDataFrame(rows, "doc_id long, doc long, text string")
    assert {r.doc_id: r.gone for r in line_dedup.gone_lines(docs).collect()} == {2: [1], 3: [0]}
