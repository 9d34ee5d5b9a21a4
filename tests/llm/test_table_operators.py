"""Sharding, Jaccard join, nearest neighbours, archives and licences against brute force and exact round trips."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.llm import ann, components, jaccard, licences, shared, sharding, warc


def scalar_jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark):
    rows = [(i * 37 - 500, f"text {i % 7}" if i % 11 else None, 1) for i in range(500)] + [(None, "n", 1), (5, "same", 1), (5, "same", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    got = sharding.assign(docs, 16).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        assert r["shard"] == scalar_jump(r["doc_id"] or 0, 16) and r["grown_shard"] == scalar_jump(r["doc_id"] or 0, 17)
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {(k, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for k, t, _ in rows}
    assert {(r["doc_id"], r["text_crc32"], r["size"]) for r in got} == texts
    assert sharding.assign(docs.limit(0), 16).count() == 0
    assert sharding.moved(docs, 16).count() == sum(r["grown_shard"] == 16 for r in got)


def brute_classes(rows, k, num, den):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and den * both >= num * (len(a) + len(b) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return {key: (len(sets[i]), least[find(i)] if sets[i] else key) for i, (key, _) in enumerate(rows)}


@pytest.mark.parametrize(("k", "num", "den", "block"), [(3, 90, 100, 256), (5, 80, 100, 4), (1, 80, 100, 3)])
def test_jaccard_classes_match_brute_force(spark, monkeypatch, k, num, den, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    random = np.random.default_rng(k)
    words = [f"w{i}" for i in range(400)]
    rows = []

    def add(text):
        rows.append((1000 - len(rows), text))

    for size in (4, 9, 10, 20, 45, 60, 130, 400):
        base = list(random.choice(words, size))
        add(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(edits):
                copy[random.integers(len(copy))] = random.choice(words)
            add(" ".join(copy))
        add(" ".join(base[: int(size * 0.9)]))
        add(" ".join(base).upper() + "\n")
    passage = list(random.choice(words, 60))
    for _ in range(30):
        add(" ".join([*random.choice(words, 20), *passage, *random.choice(words, 20)]))
    for extra in (None, "", "  ", "one", "one", "one two"):
        add(extra)
    docs = spark.createDataFrame([(a, b, 3) for a, b in rows], "doc_id long, text string, node int").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs, k, num, den).collect()}
    assert got == brute_classes(rows, k, num, den)


def test_link_counts_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    random = np.random.default_rng(12)
    texts = ["", None, "one", "one"]
    for _ in range(3):
        base = [f"w{i}" for i in random.integers(0, 300, 60)]
        texts += [" ".join(base)] * 3
        for i in range(12):
            texts.append(" ".join(f"x{i}" if j == (i * 5) % 60 else w for j, w in enumerate(base)))
    sets = [{tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set() for w in ((t or "").split() for t in texts)]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    want = {i: sum(linked(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["n_links"] for r in jaccard.link_counts(docs, 3, 80, 100).collect()} == want


def test_one_of_each_keeps_one_row_of_each_class(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(3, text, "c"), (1, text, "a"), (1, text, "a"), (None, text, "n"), (None, None, "n"), (7, None, "s"), (8, "", "e")], "doc_id long, text string, _row string")
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, r["text"] or "", r["_row"]) for r in out.collect())
    assert kept == [(0, "", "n"), (1, text, "a"), (7, "", "s"), (8, "", "e")]
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_bounds_never_drop_a_link():
    random = np.random.default_rng(5)
    for _ in range(200):
        n = int(random.integers(1, 300))
        a = np.unique(random.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * random.random())], random.integers(0, 1 << 63, int(random.integers(1, 30))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        maps = jaccard._folded([jaccard.bitmap(a), jaccard.bitmap(b)])
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert jaccard.may_link(80, 100, len(a), len(b), maps[0], maps[1])
            # whatever the tiles' frequencies are
            frequency = lambda tile: np.maximum(tile % 7 - 3, 1)
            tiled = jaccard.Bands(80, 100).tiles([a, b])
            which, tile = tiled.kept(frequency(tiled.tile))
            assert set(tile[which == 0].tolist()) & set(tile[which == 1].tolist())


def test_a_key_with_half_of_the_rows_joins_whole(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 50)
    rows = spark.createDataFrame([(7 if i % 2 else i, i) for i in range(400)] + [(None, -1)], "k long, v long")
    lookup = spark.createDataFrame([(i, i * 10) for i in range(0, 400, 4)] + [(7, 70)], "k long, w long")
    plan = shared.join_hot(rows, lookup, "k", "left")
    assert sorted(map(str, plan.collect())) == sorted(map(str, rows.join(lookup, "k", "left").collect()))
    assert sorted(map(str, shared.join_hot(rows, lookup, "k").collect())) == sorted(map(str, rows.join(lookup, "k").collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_results_are_the_same_whichever_keys_are_hot(spark, monkeypatch, how):
    rows = spark.createDataFrame([(i % 3, i) for i in range(90)] + [(None, -1), (9, -2)], "k long, v long")
    lookup = spark.createDataFrame([(0, 10), (5, 50)], "k long, w long")
    want = sorted(map(str, rows.join(lookup, "k", how).collect()))
    for hot in (1, 20, 1 << 11):
        monkeypatch.setattr(shared, "HOT_ROWS", hot)
        assert sorted(map(str, shared.join_hot(rows, lookup, "k", how).collect())) == want


@pytest.mark.parametrize("hot", [4, 1 << 14])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(shared, "HOT_ROWS", hot)
    random = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in random.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


def test_nearest_neighbours(spark):
    random = np.random.default_rng(7)
    x = random.normal(size=(3000, 24)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, x[i].tolist(), 0) for i in range(3000)]
    odd = [(3000, None, 0), (3100, [0.0] * 24, 0), (3200, [float("nan")] * 24, 0), (3300, [1.0], 0), (None, x[0].tolist(), 0), (3400, [None] * 24, 0), (7, x[7].tolist(), 0)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int").repartition(3)
    indexed, book = ann.index(vectors)
    got = defaultdict(list)
    for r in ann.search(indexed, book, indexed.where("id % 100 = 0").select("id", "vector"), block=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) == set(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        distance = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(3000), distance)) if i != q][:10]
        assert [f[2] for f in found] == list(range(1, 11))
        assert [f[1] for f in found] == pytest.approx([distance[f[0]] for f in found], abs=1e-12)
        hits += len(set(want) & {f[0] for f in found})
    assert hits / (10 * len(got)) >= 0.95
    assert [f[0] for f in got[100]] == list(range(101, 111))
    few, book = ann.index(vectors.where("vec_id < 4"))
    assert ann.search(few, book, few.where("id = 0").select("id", "vector")).count() == 3
    none, book = ann.index(vectors.limit(0))
    assert ann.search(none, book, none.select("id", "vector")).count() == 0


def test_nearest_neighbours_of_hot_groups(spark):
    """More copies, and more near copies, in a batch than are reranked: the smallest ids and distances still come back."""
    random = np.random.default_rng(11)
    x = random.normal(size=(4000, 16)).astype(np.float32)
    copies = random.permutation(4000)
    x[copies[:1300]] = x[copies[0]]
    x[copies[1300:2600]] = x[copies[1300]] + random.normal(scale=1e-4, size=(1300, 16)).astype(np.float32)
    asked = [int(i) for i in (*copies[:6], *copies[1300:1306], *copies[2600:2606])]
    shuffled = [(int(i), x[i].tolist()) for i in random.permutation(4000)]
    indexed, book = ann.index(spark.createDataFrame(shuffled, "vec_id long, embedding array<float>").repartition(1))
    got = defaultdict(list)
    for r in ann.search(indexed, book, indexed.where(indexed.id.isin(asked)).select("id", "vector")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q in asked:
        distance = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        assert got[q] == [int(i) for i in np.lexsort((np.arange(4000), distance)) if i != q][:10]


def test_archive_round_trip(spark, tmp_path):
    long = "<html>" + "ä" * 100
    rows = [(5, "http://a/1", long), (2, "http://a/2", long), (9, None, long), (1, "http://b/\r\nX: y", "small"), (3, "u", "small"), (4, "u", None), (6, "u", ""), (7, "u", long + "!"), (None, "u", long), (8, "u", "z" * 100), (8, "u", "z" * 100)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    back = warc.read_archive(spark, path)
    got = sorted((r["id"] if r["id"] is not None else 99, bytes(r["payload"]), r["payload_digest"], r["record_type"], r["refers_to"]) for r in back.collect())
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        twin = [j for j, _, u in rows if (u or "").encode() == raw and j is not None]
        other = len(raw) >= 100 and i != min(twin)
        want.append((i if i is not None else 99, raw, hashlib.sha256(raw).hexdigest(), "revisit" if other else "response", str(min(twin)) if other else None))
    same = [w for w in want if w[0] == 8]
    want.remove(same[0])
    want.append((*same[0][:3], "revisit", "8"))
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert spark.read.parquet(f"{path}/payloads").count() == len({(t or "").encode() for _, _, t in rows})
    parsed = warc.parse_records(warc.record_bytes(back)).collect()
    assert len(parsed) == len(rows) and all(r["intact"] for r in parsed)
    assert sum(r["record_type"] == "revisit" for r in parsed) == sum(w[3] == "revisit" for w in want)
    warc.write_archive(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_records_of_a_hot_payload_go_to_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HOT_ROWS", 8)
    rows = [(i, "http://x/\r\n" if i == 1 else "http://x", "" if i % 2 else "y" * 150 if i % 4 else f"p{i}") for i in range(60)] + [(3, "u", ""), (None, "u", "y" * 150)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    warc.write_archive(pages, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/records")).agg(F.max("parts")).first()[0] > 1
    back = warc.read_archive(spark, str(tmp_path / "a"))
    got = back.collect()
    key = lambda r: tuple(map(str, r))
    assert sorted([(r["id"], bytes(r["payload"]).decode()) for r in got], key=key) == sorted([(i, t) for i, _, t in rows], key=key)
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {"2"} and sum(r["record_type"] == "revisit" for r in got) == 15
    heads = [bytes(r["header"]).decode() for r in got]
    assert len({re.search("WARC-Record-ID: (.*)", h)[1] for h in heads}) == len(rows)
    assert all("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in h for h in heads) and "http://x/%0D%0A" in {r["target_uri"] for r in got}


def test_distances_are_of_the_vectors_as_they_are(spark):
    rows = [(0, [1.0, 1e-9]), (1, [1.0, 2e-9]), (2, [1.0, 4e-9]), (3, [1e200, 1.0]), (4, [1.0, 1.0])]
    indexed, book = ann.index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r["vec_id"], r["score"]) for r in ann.search(indexed, book, indexed.where("id = 0").select("id", "vector"), k=4).orderBy("rank").collect()]
    assert [i for i, _ in got] == [1, 2, 4, 3] and got[0][1] == pytest.approx(1e-9, rel=1e-9) and got[1][1] == pytest.approx(3e-9, rel=1e-9)


def test_damaged_payloads_raise(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "u", "x" * 200), (3, "u", "y")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "good"))
    good = spark.read.parquet(str(tmp_path / "good/payloads"))
    spark.read.parquet(str(tmp_path / "good/records")).write.parquet(str(tmp_path / "bad/records"))
    good.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(str(tmp_path / "bad/payloads"))
    for read in (lambda a: a.select("id", F.length("payload")), lambda a: a.select("id", "payload"), warc.record_bytes, lambda a: a.select("verified")):
        assert read(warc.read_archive(spark, str(tmp_path / "good"))).count() == 3
        assert len(read(warc.read_archive(spark, str(tmp_path / "good"))).collect()) == 3
        with pytest.raises(Exception, match="payload does not match its digest"):
            read(warc.read_archive(spark, str(tmp_path / "bad"))).collect()


def test_licences_of_hot_directories_exact_identifiers_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 20)
    rows = [(f"big/{i}.c", f"file {i}") for i in range(60)] + [("big/LICENSE", "Released under the MIT License."), ("x/a.c", "// SPDX-License-Identifier: BSD-2-Clause\nint a;"), ("x/b.c", "# one\n# SPDX-License-Identifier: GPL-2.0-only OR MIT"), ("x/c.c", "SPDX-License-Identifier: Apache-2.0\n" + "word " * 30000)]
    files = spark.createDataFrame([(*r, "mine", 1.5, "d", "n") for r in rows], "path string, text string, licence string, cosine double, _directory string, near string").repartition(3)
    got = {r["path"]: r for r in licences.scan(files).collect()}
    assert len(got) == len(rows) and all(got[f"big/{i}.c"]["licence"] == "MIT" and got[f"big/{i}.c"]["how"] == "inherited" for i in range(60))
    assert [(got[p]["licence"], got[p]["line"], got[p]["cosine"]) for p in ("x/a.c", "x/b.c", "x/c.c")] == [("BSD-2-Clause", 0, 1.0), ("GPL-2.0-only OR MIT", 1, 1.0), ("Apache-2.0", 0, 1.0)]
    assert got["big/0.c"]["_directory"] == "d" and got["big/0.c"]["near"] == "n"


def test_files_of_a_hot_directory_without_a_licence_stay(spark, monkeypatch):
    rows = [(f"big/{i}.c", f"file {i}") for i in range(60)] + [("big/own.c", "long text " * 50 + "\nReleased under the MIT License.\nmore"), ("x/LICENSE", "Released under the MIT License."), ("x/a.c", "int a;")]
    files = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)] + [("big/0.c", None, -1)], "path string, text string, n int").repartition(3)
    found = []
    for hot in (20, 1 << 11):
        monkeypatch.setattr(shared, "HOT_ROWS", hot)
        found.append(sorted(map(str, licences.scan(files).select("n", "path", "licence", "how", "from_directory").collect())))
    assert found[0] == found[1] and len(found[0]) == len(rows) + 1


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("a/LICENSE", mit), ("a/b/c/x.txt", "nothing here\nat all"), ("a/b/COPYING", gpl), ("a/y.txt", "long text " * 50 + "\n" + "Licensed under the Apache License, Version 2.0.\nmore"), ("d/z.txt", None), (None, mit), ("a/b/e/w.txt", ""), ("", "x"), ("a/LICENSE", mit)]
    files = spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, cosine2 int").repartition(2)
    got = [(r["path"] or "", r["licence"], r["how"], r["from_directory"]) for r in licences.scan(files).collect()]
    want = [("a/LICENSE", "MIT", "own", None)] * 2 + [("a/b/c/x.txt", "GPL-3.0", "inherited", "a/b"), ("a/b/COPYING", "GPL-3.0", "own", None), ("a/y.txt", "Apache-2.0", "own", None), ("d/z.txt", None, "none", None), ("", "MIT", "own", None), ("a/b/e/w.txt", "GPL-3.0", "inherited", "a/b"), ("", None, "none", None)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert licences.scan(files.limit(0)).count() == 0


def test_licence_texts_and_headers(spark):
    """Full texts, headers as comment blocks, and statements over two lines or inside a longer one."""
    texts = dict(licences.long_templates()[len(licences.HEADERS) :])
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the\nGNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License\nalong with this program. If not, see <https://www.gnu.org/licenses/>."
    code = "\n".join(f"total{i} = first{i} + second{i}" for i in range(40))
    prose = "the words of this sentence are not a license of any kind " * 30
    rows = [
        ("mit/LICENSE", "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + texts["MIT"], "MIT"),
        ("mit/src/a.py", code, "MIT"),
        ("gpl/a.py", "#!/bin/python\n" + "\n".join("# " + x for x in gpl.split("\n")) + "\n" + code, "GPL-3.0"),
        ("wrap/a.txt", prose + "\nThis work is licensed under the GNU\nGeneral Public License, version 3.\n" + prose, "GPL-3.0"),
        ("inside/a.txt", prose + " Released under the MIT License. " + prose, "MIT"),
        ("none/a.txt", prose, None),
        *((f"full-{name}/COPYING", "Some project\n" + t, name) for name, t in texts.items()),
    ]
    files = spark.createDataFrame([r[:2] for r in rows], "path string, text string").repartition(2)
    got = {r["path"]: (r["licence"], r["how"]) for r in licences.scan(files).collect()}
    assert got == {p: (w, "inherited" if p == "mit/src/a.py" else "own" if w else "none") for p, _, w in rows}


def test_cosine_matches_plain_arithmetic():
    from collections import Counter

    known = licences.Templates(licences.TEMPLATES)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    templates = [(n, Counter(words(t))) for n, t in licences.TEMPLATES]
    idf = lambda w: np.log((1 + len(templates)) / (1 + max(1, sum(w in t for _, t in templates)))) + 1
    vector = lambda c: {w: n * idf(w) for w, n in c.items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
    import pyarrow as pa

    from chronotext.llm import bytescan

    lines = ["released under the mit license today", "licensed under cc by nc", "the the the license", "GNU general public license version 3 or later"]
    (_, offsets, data), *_ = bytescan.blocks(pa.array(lines))
    w = bytescan.words(offsets, data, bytescan.ALNUM)
    found, score = known.best(np.repeat(np.arange(len(lines)), w.counts()), w.hashes, len(lines), 0.3)
    for i, line in enumerate(lines):
        v = vector(Counter(words(line)))
        best = max((sum(v.get(x, 0) * y for x, y in u.items()) / norm(v) / norm(u)) for u in (vector(t) for _, t in templates))
        assert (score[i] == pytest.approx(best)) if best >= 0.3 else found[i] == -1
