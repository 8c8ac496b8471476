"""Fingerprints, licence scans, URL filters, WARC, mixing, quality, tokens and the pipeline."""

import base64
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from bnspark.llm import common, fingerprints, licenses, mixing, quality, queries, sentencepiece_bpe, url_filter, warc

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, features string, label int, `a.b` string, p string, score long"
ODD = [(None, "no id"), (None, None), (9_001, None), (9_002, ""), (9_003, " \n "), (9_004, "x"), (9_004, "x"), (9_005, "é ﬁ ẞ"), (9_006, "word " * 30_000)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "f", 1, "y", "p", 3) for i, t in rows], SCHEMA)


# Fingerprints.


def canon(t):
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    return re.sub("[ \t\n\x0b\f\r\x1c-\x1f\x85\u1680\u2028\u2029]+", " ", nfkc(nfkc(t).casefold())).strip(" ")


@pytest.mark.parametrize("bits,per_bucket", [(128, 3), (4, 512)])
def test_fingerprints(spark, monkeypatch, bits, per_bucket):
    monkeypatch.setattr(fingerprints, "ROWS_A_BUCKET", per_bucket)
    rng = random.Random(1)
    words = ["Ｆｏｏ", "foo", "É", "é", "straße", "STRASSE", "x\u2028y", "a", "b", "İ"]
    rows = [(7 * i - 50, " ".join(rng.choice(words) for _ in range(rng.randrange(4)))) for i in range(60)] + [r for r in ODD if r[0]]
    rows.remove((9_004, "x"))
    got = fingerprints.edited_fingerprints(table(spark, [*rows, (None, "abc")]), bits=bits).collect()
    assert len(got) == len(rows) + 1
    order = sorted((i, t or "") for i, t in rows)
    want = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want[i] = t, t[: len(t) - half] + after[:half], after
    want[None] = "abc", "ab", ""
    prints = {}
    for r in got:
        t, edited, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canon(t) == canon(edited)), float(canon(t) == canon(after)))
        for form, name in ((canon(t), r.fingerprint), (canon(edited), r.edited_fingerprint)):
            if bits == 128:
                assert prints.setdefault(form, name) == name
        prints.setdefault(canon(t), r.fingerprint)
        same = [i for i, x in [*order, (None, "abc")] if canon(x) == canon(t)]
        assert r.group_size == len(same) and r.group_id == min((i for i in same if i is not None), default=None)
    own = {canon(want[r.doc_id][0]): r.fingerprint for r in got}
    assert len(set(own.values())) == len(own)  # even where 4 bits collide


def test_fingerprints_of_nothing_and_of_repeats(spark):
    assert fingerprints.edited_fingerprints(table(spark, []).limit(0)).count() == 0
    got = fingerprints.edited_fingerprints(table(spark, [(5, "ab"), (5, "ab"), (5, "aa"), (5, None)])).collect()
    assert len(got) == 4 and {r.n_chars for r in got} == {0, 2}


# Licences.


# Held out: no line of these stands in license_texts.
LICENCES = [
    ('MIT License', 'MIT'),
    ('SPDX-License-Identifier: MIT', 'MIT'),
    ('ISC License', 'ISC'),
    ('GNU AFFERO GENERAL PUBLIC LICENSE Version 3', 'AGPL-3.0'),
    ('Apache License, Version 2.0, January 2004', 'Apache-2.0'),
    ('This software is licensed under GPLv3 or later', 'GPL-3.0'),
    ('Redistributions of source code must retain the above copyright', 'BSD'),
    ('Redistributions of source code must retain', 'BSD'),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR', 'MIT'),
    ('to deal in the Software without restriction, including without limitation the rights', 'MIT'),
    ('Boost Software License - Version 1.0 - August 17th, 2003', 'BSL-1.0'),
    ('Licensed under the EUPL, Version 1.2', 'EUPL-1.2'),
    ('GNU Lesser General Public License v2.1', 'LGPL'),
    ('Code licensed under Apache 2.0.', 'Apache-2.0'),
    ('All code in this repository is released under the MIT license', 'MIT'),
    ('You may use this library under the terms of the GNU LGPL', 'LGPL'),
    ('Content is available under CC BY-SA 4.0 unless otherwise noted', 'CC-BY-SA'),
    ('# SPDX-License-Identifier: GPL-2.0-only', 'GPL-2.0'),
    ('// SPDX-License-Identifier: Apache-2.0', 'Apache-2.0'),
    ('Distributed under the BSD 3-Clause license, see the file', 'BSD'),
    ('This file is covered by the Mozilla Public License 2.0', 'MPL-2.0'),
    ('All rights reserved.', 'proprietary'),
    ('2019 Acme. All rights reserved.', 'proprietary'),
    ('This project is free and unencumbered software released into the public domain', 'public-domain'),
    ('dual-licensed; the zlib license applies', 'Zlib'),
    ('this program under the Eclipse Public License 2.0', 'EPL-2.0'),
    ('modify it under the terms of the GNU General Public License as published by', 'GPL'),
    ('Licensed under the AGPLv3', 'AGPL-3.0'),
]
NO_LICENCES = [
    'The license was framed on the wall of his office.',
    'Please show your licence at the desk before you rent a car.',
    'He was granted permission to copy the letters of the author.',
    'The public library is open on Sunday.',
    'Software makes up a large part of the cost of a modern car.',
    'The general terms of the agreement were not disclosed.',
    'Any person who finds the dog should call the owner.',
    'The source of the noise was a broken fan.',
    'The warranty on the washing machine has expired.',
    'They distribute free copies of the paper at the station.',
    'The apache helicopter flew over the valley.',
    'She studied at MIT before moving to Boston.',
    'The foundation published a report on general health.',
    'Version 2 of the proposal was better.',
    'Use of the pool is restricted to members.',
    'The rights of workers are reserved a chapter of their own.',
    'The commons was used by all farmers of the village.',
    'It is provided with two doors and a window.',
    'The creative team licensed the song for a film.',
    'You may obtain tickets at the door.',
    'No warranty could have covered such damage.',
    'This work was commissioned by the king.',
    'A notice on the door said closed.',
    'The program was distributed to all parents at the school.',
]


def test_license_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    held_out = [
        (9_101, "intro\nThis project is licensed under the MIT license.\nmore", "MIT"), (9_102, "Licensed under the Apache License Version 2.0", "Apache-2.0"),
        (9_103, "My licence plate is under version 2 of the law", None), (9_104, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3!", "GPL-3.0"),
        (9_105, "Licensed under CC BY-NC 4.0.", "CC-BY-NC"), (9_106, "Licensed under CC BY-SA 4.0.", "CC-BY-SA"),
        (9_107, "permission license version under the terms of work", None),
    ]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = licenses.license_scan(table(spark, [*rows, *ODD, *[x[:2] for x in held_out]])).collect()
    assert len(got) == len(rows) + len(ODD) + len(held_out)
    found = {r.doc_id: r for r in got}
    assert {i: found[i].license for i, _, _ in held_out} == {i: f for i, _, f in held_out}
    line = re.compile(r"^(Licensed under CC BY-NC 4\.0\.|This work is licensed under the GNU General Public License, version 3\.|Licensed under the Apache License, Version 2\.0\.|Released under the MIT License\.|All rights reserved\.)$", re.M)
    assert all(found[i].n_licenses == len(line.findall(t)) for i, t in rows)
    assert all(found[i].n_paragraphs == sum(bool(x.strip(" ")) for x in t.split("\n")) for i, t in rows)
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_licences_in_other_words(spark):
    """Held-out recall of at least 0.9, wrapped lines and tags included, and no false family among sentences with
    licence words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(i, t) for i, (t, _) in enumerate(LICENCES)] + [(1_000 + i, t) for i, t in enumerate(NO_LICENCES)]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.train(docs)).collect()}
    right = [(got[i] or "").startswith(f) for i, (_, f) in enumerate(LICENCES)]
    assert np.mean(right) >= 0.9
    assert sum(got[1_000 + i] is not None for i in range(len(NO_LICENCES))) == 0


def test_marks_look_words_up(spark):
    """What is found is what sets of words say, and no array of all phrases is gone through for a paragraph."""
    held = licenses._held(spark)
    marks = licenses.Marks.of(spark, held)
    texts = [t for t, _ in LICENCES] + NO_LICENCES + ["", "one", "under the terms of the terms of the", "the software is a car and nothing else at all"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", licenses.words(F.col("text")).alias("w"))
    found = df.select("text", "w", marks.found(F.col("w")).alias("found"))
    for r in found.collect():
        own = [f"{a} {b}" for a, b in zip(r.w, r.w[1:])] or r.w
        shared = len(set(own) & set(marks.known))
        assert r.found == (shared > 0 and shared >= licenses.LICENCE_LIKE * len(own) or bool(set(own) & set(marks.names)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "arrays_overlap" not in plan


def test_rare_license_words_are_counted_in_all_documents(spark):
    """Licence words fill the one sampled document and no other: they stay features."""
    rows = [(i, "\n".join(f"plain words of row {i} line {k}" for k in range(60))) for i in range(30)]
    first = licenses._sampled(table(spark, rows).select("doc_id", "text"), 1).first()[0]
    hot = "the mit has a licence or some license of its own and general software under a version"
    rows = [(i, "\n".join(f"{hot} {k}" for k in range(10)) if i == first else t) for i, t in rows]
    rows += [(1_000 + i, "Released under the MIT License.") for i in range(3)]
    docs = table(spark, rows).select("doc_id", "text")
    rare = licenses.rare_words(docs, licenses.Marks.of(spark, licenses._held(spark)))
    assert {"mit", "license", "software"} <= set(rare) and "of" not in rare
    assert licenses.train(docs, 1).rare == rare


# URLs.

RULES = [url_filter.split_rule(*r) for r in (("com/en/", "block"), ("example.com/en/7", "allow"), ("a.net/", "allow"), ("b.net/", "block"), ("b.net/", "allow"))]


def brute_verdicts(pages):
    parsed = []
    for i, url, html in pages:
        rest = (url or "").partition("://")[2]
        host = re.match("[^/?#]*", rest)[0].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
        parsed.append((i, host, re.match(r"[^/?#]*([^?#]*)", rest)[1], re.findall(url_filter.LINK, html or "")))
    ruled, pages_of, bad, good = [], {}, {}, {}
    for i, host, path, _ in parsed:
        fits = [(len(h + p), v, h + p) for h, p, v in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        ruled.append((i, host, path, best and best[2], best and best[1]))
        if host:
            pages_of[host] = pages_of.get(host, 0) + 1
            bad[host] = bad.get(host, 0) + bool(best and best[1] == "block")
            good[host] = good.get(host, 0) + bool(best and best[1] == "allow")
    blocked = [h for h in pages_of if bad[h] >= pages_of[h] / 2]
    trusted = [h for h in pages_of if h not in blocked and good[h]]
    links = {}
    for _, host, _, found in parsed:
        for dst in found:
            dst = dst.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
            if host and dst != host:
                links[host, dst] = links.get((host, dst), 0) + 1
    excess = {}
    for seeds, edges, sign in ((trusted, links, -1), (blocked, {(b, a): n for (a, b), n in links.items()}, 1)):
        if not seeds:
            continue
        out = {}
        for (a, _), n in edges.items():
            out[a] = out.get(a, 0) + n
        rank = {h: 1 / len(seeds) for h in seeds}
        for _ in range(300):
            got = {}
            for (a, b), n in edges.items():
                if a in rank:
                    got[b] = got.get(b, 0) + url_filter.DAMPING * rank[a] * n / out[a]
            back = 1 - sum(got.values())
            rank = {h: got.get(h, 0) + (back / len(seeds) if h in seeds else 0) for h in {*got, *seeds}}
        for h, r in rank.items():
            excess[h] = excess.get(h, 0) + sign * r * len(seeds)
    return [(i, h, p, r, v or ("block" if excess.get(h, 0) > url_filter.THRESHOLD else "allow")) for i, h, p, r, v in ruled]


def test_url_verdicts(spark):
    rng = random.Random(3)
    hosts = ["x.com", "y.example.com", "a.net", "b.net", "c.org", "d.org", "e.org", "F.org", "q.b.net"]
    link = lambda: "".join(f'<a HREF = "{rng.choice(["http:", "https:", ""])}//{rng.choice(hosts)}{rng.choice(["/x", "", "?q"])}">' for _ in range(rng.randrange(4)))
    pages = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['en/', 'en/7', 'fr/', ''])}{i}?a#b", link()) for i in range(120)]
    pages += [(200, None, None), (201, "no scheme.com/en/", link()), (202, "http://", ""), (203, "HTTP://X.COM", None), (None, "http://x.com/en/1", ""), (204, "a://b://c.com/en/", "")]
    pages += [pages[0], pages[0]]
    df = spark.createDataFrame([(*p, 1, "r", "v") for p in pages], "page_id long, url string, html string, n int, rule string, verdict string")
    got = [tuple(r) for r in url_filter.verdicts(df, RULES).collect()]
    want = brute_verdicts(pages)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {v for _, h, _, r, v in want if r is None and h} == {"allow", "block"}
    assert url_filter.verdicts(df.limit(0), RULES).count() == 0


def test_verdicts_by_links_equal_their_sql(spark):
    """Hosts from a table: customers link to the hosts of their orders' clerks, priorities and years."""
    import duckdb

    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey % 3 = 0").selectExpr(
        "cast(o_orderkey as long) as page_id",
        "concat('http://c', o_custkey % 40, case o_custkey % 4 when 0 then '.com/en/' when 1 then '.a.net/de/' else '.org/' end, o_orderkey) as url",
        "concat('<a href=\"http://c', o_orderkey % 37, case (o_orderkey % 37) % 4 when 0 then '.com' when 1 then '.a.net' else '.org' end, '/x\">') as html",
    )
    con = duckdb.connect()
    con.register("pages", orders.toPandas())
    got = [tuple(r) for r in url_filter.verdicts(orders, queries.OP5_RULES).collect()]
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLES['op5_url_filter']})").fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


# WARC.


@pytest.mark.parametrize("split", [1 << 23, 700])
@pytest.mark.parametrize("least", [0, 20])
def test_warc_round_trip(spark, split, least):
    rng = random.Random(2)
    inner = b"".join(warc.record(i, "u", b"payload", None) for i in range(3)).decode("latin-1")
    pages = [(i, f"http://h/{i}", rng.choice(["", None, "tiny", "x" * 30, "日本 " * 20, inner, "".join(rng.choice("abcdef") for _ in range(1_000))])) for i in range(60)]
    pages += [(100, None, "a b\n"), (101, "u v\r\nX: 1", "x" * 30), (101, "u v", "x" * 30), (-5, "neg", "x" * 30), (102, "big", "".join(map(chr, rng.choices(range(32, 3000), k=200_000 if split > 1 << 20 else 2_000))))]
    pages += [(None, "no id", "x" * 30), (None, "no id", "of nobody else, but long enough"), (None, "", "of nobody else, but long enough"), (0, "zero", "0" * 25), (None, "", "0" * 25)]
    if split > 1 << 20:
        pages += [(103, "http://h/" + "".join(rng.choices("abcdef", k=4 << 20)), "behind a long address")]
    owner = {}
    for i, _, h in pages:
        owner[h or ""] = max(owner.get(h or ""), i, key=lambda x: (x is not None, x))
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        refers = owner[h or ""] if len(data) >= least and owner[h or ""] != i else None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, sha int")
    got = warc.round_trip(df, least, split).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def found(spark, folder, split=1 << 23):
    rows = warc.scan_warc(spark, f"file://{folder}", split).collect()
    return sorted(r.page_id for r in rows if not r.fault), sorted((r.file, r.start) for r in rows if r.fault)


@pytest.mark.parametrize("split", [1 << 23, 1_500])
def test_warc_of_nothing_and_of_rot(spark, tmp_path, split):
    df = spark.createDataFrame([(i, "u", f"{i}" * 300 + str(random.Random(i).random())) for i in range(50)], "page_id long, url string, html string")
    assert warc.round_trip(df.limit(0)).count() == 0
    warc.write_warc(df.coalesce(1), f"file://{tmp_path}/w")
    data = next((tmp_path / "w").glob("*.warc.gz")).read_bytes()
    members, at = [], 0
    while at < len(data):
        z = zlib.decompressobj(31)
        z.decompress(data[at:])
        members.append(data[at : len(data) - len(z.unused_data)])
        at += len(members[-1])
    every = list(range(50))
    cut = bytearray(members[25])
    cut[len(cut) // 2] ^= 255
    cases = {
        "junk": (b"junk\x1f\x8b\x08" + data, every, 1),
        "tail": (data[:-10], every[:-1], 1),
        "padded": (data + bytes(16), every, 1),
        "rotten": (b"".join([*members[:25], bytes(cut), *members[26:]]), every[:25] + every[26:], 1),
        "headless": (data[5:], every[1:], 1),
        "gap": (members[0] + b"\n\n" + members[1], [0, 1], 1),
    }
    for name, (held, want, faults) in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc.gz").write_bytes(held)
        got, places = found(spark, tmp_path / name, split)
        assert got == want and len(places) == faults, name


def test_warc_inside_a_payload_is_no_record(spark, tmp_path):
    """An archive that is stored as it is within a member, over many ranges, gives no records of its own."""
    inner = b"".join(warc.record(900 + i, "inner", random.Random(i).randbytes(700), None) for i in range(20))
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:00000000-0000-0000-0000-000000000001>\r\n"
    block = head + b"Content-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n"
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    member = lambda x: (lambda c: c.compress(x) + c.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    request = b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: x\r\nContent-Type: application/http\r\nContent-Length: 4\r\n\r\nGET \r\n\r\n"
    data = member(info) + warc.record(1, "a", b"one", None) + z.compress(block) + z.flush() + member(request) + warc.record(2, "b", b"two", None)
    (tmp_path / "x.warc.gz").write_bytes(data)
    for split in (1 << 23, 600, 3_000):
        rows = warc.read_warc(spark, f"file://{tmp_path}", split, payloads=True).collect()
        assert sorted((r.record_type, r.page_id or 0, bytes(r.payload)) for r in rows) == sorted(
            [("warcinfo", 0, b"hello"), ("response", 1, b"one"), ("resource", 0, inner), ("request", 0, b""), ("response", 2, b"two")]
        )
        assert all(r.intact for r in rows)


def test_warc_round_trip_raises_on_loss(spark, monkeypatch):
    df = spark.createDataFrame([(1, "u", "h"), (2, "u", "i")], "page_id long, url string, html string")
    whole = warc.scan_warc
    monkeypatch.setattr(warc, "scan_warc", lambda *a: whole(*a).where("page_id = 1"))
    with pytest.raises(ValueError, match="do not give back"):
        warc.round_trip(df)


# Mixing.


def least_objective(n, p, targets, most=np.inf):
    """Of all rates, by many plain steps of the projected gradient with momentum."""
    total = n.sum()
    m = np.linalg.inv((p * n[:, None]).T @ p / total + 1e-9 * np.eye(len(targets)))
    value = lambda r: ((r * n) @ p / total - targets) @ m @ ((r * n) @ p / total - targets)
    r = y = np.ones(len(n))
    best, a = value(r), 1.0
    for _ in range(20_000):
        new = np.clip(y - p @ (m @ ((y * n) @ p / total - targets)), 0, most)
        a, was = (1 + np.sqrt(1 + 4 * a * a)) / 2, a
        y, r = new + (was - 1) / a * (new - r), new
        best = min(best, value(r))
    return best, value


def test_mixing_rates(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("n", "n")
    got = mixing.mixing_rates(table(spark, [*docs, *ODD]), labels).collect()
    assert len(got) == len(docs) + len(ODD)
    n = np.array([r.n_tokens for r in got], float)
    p = np.array([(r.p_good, r.p_poor, r.p_toxic) for r in got])
    rate = np.array([r.rate for r in got])
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all()
    assert np.abs((rate * n) @ p / n.sum() - mixing.TARGETS).max() < 1e-5
    assert all(np.abs(r.gaps).max() < 1e-5 for r in got)
    marks = str.maketrans({**{c: " " for c in mixing.PARTING}, **{c: f" {c} " for c in mixing.MARKS}})
    text = {i: t for i, t in docs}
    assert all(r.n_tokens == len([w for w in text[r.doc_id].translate(marks).split(" ") if w]) for r in got if r.doc_id in text)
    known = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    right = [np.argmax(p[k]) == (2 if known[r.doc_id][1] else 0 if known[r.doc_id][0] else 1) for k, r in enumerate(got) if r.doc_id in known]
    assert np.mean(right) > 0.95


def test_projection_clips_and_bounds(spark):
    rows = [(10, [0.9, 0.1]), (10, [0.1, 0.9]), (5, [0.5, 0.5]), (0, [0.3, 0.7])]
    members = spark.createDataFrame(rows, "n_tokens long, p array<double>")
    n, p = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    for targets in ((0.9, 0.0), (0.0, 0.0), (3.0, 3.0), (0.5, 0.5), (0.05, 20.0)):
        steps, gaps = mixing.fit_rates(members, targets)
        got = np.array([r[0] for r in members.select(mixing.rate_of(members["p"], steps)).collect()])
        best, value = least_objective(n, p, np.array(targets))
        assert value(got) <= 1.01 * best + 1e-6 and min(got) >= 0
        assert np.allclose(gaps, (got * n) @ p / n.sum() - targets, atol=1e-9)
        assert max(np.abs(gaps)) < 1e-5 or targets in ((0.9, 0.0), (0.05, 20.0))  # those can't be served
    steps, gaps = mixing.fit_rates(members, (3.0, 3.0), most_rate=2.0)
    assert max(r[0] for r in members.select(mixing.rate_of(members["p"], steps, 2.0)).collect()) == 2.0 and min(gaps) < -0.1


def test_posteriors_are_those_of_the_model(spark):
    """Softmax of the fitted weights over the different words of each text, worked out plainly."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text")
    model = mixing.train(rows, labels)
    features = {r.doc_id: r.features for r in mixing.with_features(rows).collect()}
    at = {w: i for i, w in enumerate(model.words.vocabulary)}
    weights, bias = model.domains.coefficientMatrix.toArray(), model.domains.interceptVector.toArray()
    for r in model.of(mixing.with_features(rows)).collect():
        z = bias + weights[:, [at[w] for w in features[r.doc_id] if w in at]].sum(1)
        e = np.exp(z - z.max())
        assert np.allclose(r.p, e / e.sum())


def test_mixing_without_labels_or_documents(spark):
    labels = spark.createDataFrame([(None, 1, 0), (9_004, None, None)], "doc_id long, quality int, toxic int")
    assert mixing.mixing_rates(table(spark, ODD).limit(0), labels).count() == 0
    got = mixing.mixing_rates(table(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(abs(r.p_good - 1 / 3) < 1e-9 for r in got)
    one = spark.createDataFrame([(9_004, 0, 1)], "doc_id long, quality int, toxic int")
    assert all(r.p_toxic > 0.99 for r in mixing.mixing_rates(table(spark, ODD), one).collect())


def test_mixed_repeats_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("source", "_row")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rates = {r.doc_id: r.rate for r in mixing.mixing_rates(docs, labels, corpus_pipeline.TARGETS).collect()}
    out = mixing.mixed(docs, labels, corpus_pipeline.TARGETS)
    assert out.columns == docs.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(int(rates[i]) <= times.get(i, 0) <= int(rates[i]) + 1 for i in rates)


# Quality.


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [g.score for g, y in held if y], [g.score for g, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([g.predicted == y for g, y in held]) > 0.93


def test_quality_uses_no_held_out_label_and_no_other_column(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) quality", "toxic")
    other = docs.selectExpr("doc_id", "text", "'zz' lang", "doc_id source", "n_chars", "0 score")
    assert a == {r.doc_id: r.score for r in quality.quality_scores(other, flipped).collect()}


def test_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([(9_004, 1, 0), (9_004, 0, 0), (9_006, 1, None), (None, 1, 1), (9_005, None, 1)], "doc_id long, quality int, toxic int")
    docs = table(spark, ODD)
    assert quality.quality_scores(docs, labels).count() == len(ODD)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    out = quality.keep_good(docs, labels.limit(0))
    assert out.columns == docs.columns and out.count() == len(ODD)


def planted(rng, n, share):
    x = np.zeros((n, quality.WIDTH), np.float32)
    x[:, :20] = rng.normal(size=(n, 20))
    y = rng.random(n) < share
    x[:, 0] += np.where(y, 2.5, -2.5)
    return x, y


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_of_planted_shares(share):
    rng = np.random.default_rng(1)
    trusted, _ = planted(rng, 1_500, 1.0)
    unlabelled, _ = planted(rng, 3_000, share)
    assert abs(quality.estimated_prior(trusted, unlabelled) - share) < 0.08
    assert quality.estimated_prior(trusted[:5], unlabelled) == 0.5


def test_non_negative_risk_finds_the_negatives():
    rng = np.random.default_rng(0)
    x, y = planted(rng, 4_000, 0.7)
    model = quality.fit(x[:2_000][y[:2_000]], x[2_000:], 0.7)
    assert np.mean((model.score(x) >= 0.5) == y) > 0.95


def test_non_negative_risk_is_that_of_its_definition():
    """A step of the descent goes down the risk, worked out plainly."""
    rng = np.random.default_rng(2)
    x, y = planted(rng, 2_000, 0.7)
    p, u = x[:1_000][y[:1_000]], x[1_000:]

    def risk(w, b):
        loss = lambda z: np.log1p(np.exp(-z))
        zp, zu = p @ w + b, u @ w + b
        return 0.7 * loss(zp).mean() + max(0.0, loss(-zu).mean() - 0.7 * loss(-zp).mean())

    at = [risk(*quality._descend(p, u, 0.7, steps)) for steps in (1, 10, 100)]
    assert at[0] > at[1] > at[2]


def test_repeated_ids_are_sampled_alike(spark):
    rows = [(7, "one text"), (7, "another text"), (8, "more")]
    for order in (rows, rows[::-1]):
        x = quality._sampled(spark.createDataFrame(order, "doc_id long, text string"), spark.createDataFrame([(7,), (8,)], "doc_id long"))
        assert sorted(map(bytes, x)) == sorted([min(quality.features(t).tobytes() for _, t in rows[:2]), quality.features("more").tobytes()])


# Tokens.


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_tokens_equal_the_library(library):
    model = sentencepiece_bpe.load(open(MODEL, "rb").read())
    rng = random.Random(3)
    alphabet = ["a", "b", "e", "t", "th", "in", " ", "  ", "▁", "\n", "\t", "é", "日", "😀", "\x00", "ß", "aaaa", "====", "1", " the", "ing", "<0x41>", "</s>", "\u0301", ".", ",", "!)"]
    vocabulary = [p.replace("▁", " ") for p in model.ids]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(4_000)]
    texts += ["".join(rng.choice(vocabulary) for _ in range(rng.randrange(8))) for _ in range(3_000)]
    texts += ["a" * 5_000 + "e" * 3_000 + " " * 999 + "x" * 2_000, "".join(rng.choice("abcdefghij") for _ in range(50_000)), "", " ", "▁"]
    for t in texts:
        ids = library.encode(t)
        assert model.encode(t) == ids
        assert model.decode(ids) == library.decode(ids)
    for _ in range(500):
        ids = [rng.randrange(32_000) for _ in range(rng.randrange(12))]
        assert model.decode(ids) == library.decode(ids)


def test_word_cache_generations(library, monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "MOST_WORDS", 3)
    monkeypatch.setattr(sentencepiece_bpe, "MOST_PAIRS", 5)
    model = sentencepiece_bpe.Model(open(MODEL, "rb").read())
    for t in ["one two, three. four one two", "five six seven eight nine", "one, two. six"] * 3:
        assert model.encode(t) == library.encode(t)
    assert len(model.young) <= 3 and len(model.pairs) <= 5


def test_token_digests(spark, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sentencepiece_bpe.token_digests(table(spark, [*docs, *ODD]), MODEL).collect()
    want = []
    for i, t in [*docs, *ODD]:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sentencepiece_bpe.token_digests(table(spark, ODD).limit(0), MODEL).count() == 0
    rows = sentencepiece_bpe.encoded(table(spark, ODD), MODEL)
    assert "text" not in rows.columns and {"a.b", "ids", "n_tokens"} <= set(rows.columns)
    assert all(list(r.ids) == library.encode({i: t for i, t in ODD}[r.doc_id] or "") for r in rows.collect() if r.doc_id and r.doc_id != 9_004)


# Pipeline and queries.


def test_pipeline(spark, library):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "lang", "source", "n_chars", "ids", "n_tokens", "decoded_sha256"} == set(out.columns)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = quality.keep_good(docs, labels)
    good = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == good
    lines = corpus_pipeline.lines(spark, kept, SF)
    assert lines.columns == docs.columns and {r.doc_id for r in lines.collect()} == good
    near = corpus_pipeline.near_dedup(spark, lines, SF)
    ids = {r.doc_id: r.text for r in near.collect()}
    assert set(ids) <= good and len(ids) == near.count()
    rows = out.collect()
    assert {r.doc_id for r in rows} <= set(ids)
    assert all(list(r.ids) == library.encode(ids[r.doc_id]) and r.n_tokens == len(r.ids) and r.n_chars == len(ids[r.doc_id]) for r in rows)


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_tables(spark, stage):
    docs = table(spark, ODD).select("doc_id", "text", "lang", "source", "n_chars")
    f = corpus_pipeline.STAGES[stage][1]
    out = f(spark, docs, SF)
    assert out.columns == docs.columns if stage < 4 else {"doc_id", "ids", "n_tokens"} <= set(out.columns)
    assert len(out.collect()) <= len(ODD) or stage == 3
    assert f(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_stages_begin_with_small_heaps(spark, monkeypatch):
    """Each stage lets executors give back heap before it reads anything, by as many tasks as there are cores."""

    class Shrunk(Exception):
        pass

    def shrunk(spark):
        raise Shrunk

    monkeypatch.setattr(corpus_pipeline, "shrink", shrunk)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Shrunk):
            stage(spark, None, SF)
    spark.sparkContext.setJobGroup("shrink", "")
    common.shrink(spark)
    tracker = spark.sparkContext.statusTracker()
    stages = [i for job in tracker.getJobIdsForGroup("shrink") for i in tracker.getJobInfo(job).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(tracker.getStageInfo(i).numTasks for i in stages) == spark.sparkContext.defaultParallelism
