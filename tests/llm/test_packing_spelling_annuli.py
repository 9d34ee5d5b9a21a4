"""Packing, spelling variants and hard negatives against plain Python."""

import random
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.llm import annuli, bestfit, spelling
from chronotext.llm.queries import tokenizer_path

ODD = [
    (1, "the quick brown fox's  jumps\n\n over\tthe lazy dog "), (2, ""), (3, None), (4, "a<|endoftext|>b  <|endoftext|> c <|endoftext|>"), (5, " "), (6, "  leading   and trailing  "),
    (7, "x  y　 z   w\u0085 v été 你好 你 \U0001f600 \U0001f600 1234 $%^"), (None, "null key <|endoftext|"), (2, ""), (8, "endoftext|> <|endof"), (9, "É ×\n \n x\r\n y"),
    (10, "word " * 3000), (11, "你好" * 900), (12, " ".join("w%d" % i for i in range(1200))), (10, "word " * 3000),
]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_ids_are_the_librarys(spark):
    rows = [(k, t, "extra", 1) for k, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length2 string, _row int")
    got = bestfit.pieces(docs, tokenizer_path("byte_bpe_50k.json"), capacity=64).collect()
    one = library()
    want = Counter()
    for k, t in ODD:
        ids = [*one.encode(t or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % 64 + 1
        at = 0
        for n, size in enumerate([head] + [64] * ((len(ids) - head) // 64)):
            part = ids[at : at + size]
            want[k, n, at, size, zlib.crc32(struct.pack(f"<{size}I", *part)), tuple(part)] += 1
            at += size
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("group", [1 << 15, 100])
def test_sequences_are_few_and_gapless(spark, group):
    random.seed(3)
    sizes = [min(64, 1 + int(random.expovariate(0.07))) for _ in range(3000)] + [64] * 20
    pieces = spark.createDataFrame([(i, 0, 0, s, 0) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = bestfit.pack(pieces, 64, group).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(sizes)))
    least = 20 + -(-(sum(sizes) - 20 * 64) // 64)
    assert least <= check_packed(rows, 64) <= least + 1.7 * max(1, len(sizes) / group)


def test_packing_of_large_pieces_and_of_none(spark):
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    assert check_packed(bestfit.pack(spark.createDataFrame([(i, 0, 0, 40, 0) for i in range(50)], schema), 64).collect(), 64) == 50
    assert bestfit.pack(spark.createDataFrame([], schema), 64).collect() == []


def test_sequences_hold_their_documents(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    packed = bestfit.pack(bestfit.pieces(docs, tokenizer_path("byte_bpe_50k.json")))
    parts = packed.collect()
    whole = {r["sequence_id"]: r for r in bestfit.sequences(packed).collect()}
    assert sum(r["length"] for r in whole.values()) == sum(r["length"] for r in parts)
    for r in parts:
        assert whole[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert len(bestfit.pieces(docs.where("false"), tokenizer_path("byte_bpe_50k.json")).collect()) == 0
    with pytest.raises(ValueError, match="result"):
        bestfit.pieces(docs.withColumnRenamed("doc_id", "Start"), tokenizer_path("byte_bpe_50k.json"), key="Start")


def plain_words(rows, dropped):
    n = Counter()
    for k, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{k}:{run}".encode())
            if dropped and k is not None and h % dropped == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(n):
    out = {}
    for w in n:
        near = [u for u in n if abs(len(u) - len(w)) < 2 and one_edit(u, w)]
        best = min(near, key=lambda u: (-n[u], u), default=None)
        form = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = (form, n[w], len(near), n[form] if form else None)
    for w in n:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] += (root,)
    return out


def test_words(spark):
    rows = [(1, "Caféteria CAFÉTERIA sentences, x×yzabcd"), (2, "cafetéria sentences你sentences"), (None, "sentences sentences anything"), (3, None), (4, ""), (1, "Caféteria anything"), (5, "z" * 40000 + " " + "z" * 40000)]
    rows += [(i, "sentences recurring wonderful étonnant") for i in range(10, 120)]
    docs = spark.createDataFrame([(*r, "n", 3) for r in rows], "doc_id long, text string, word string, n int")
    for dropped in (None, 31, 5):
        assert {r["word"]: r["n"] for r in spelling.words(docs, dropped=dropped).collect()} == plain_words(rows, dropped)


@pytest.mark.parametrize("shard", [2, 7, 1 << 13])
def test_variants(spark, shard):
    random.seed(shard)
    base = ["sentence", "wonderful", "international", "étonnante", "aaaaaaa", "z" * 3000]
    n = {}
    for w in base:
        n[w] = 5000
        for _ in range(25):
            u, edits = w, random.randint(1, 3)
            for _ in range(edits):
                i = random.choice([0, 1, len(u) // 2 - 1, len(u) // 2, len(u) // 2 + 1, len(u) - 1, len(u)])
                u = random.choice([u[:i] + random.choice("abeé") + u[i:], u[:i] + u[i + 1 :], u[:i] + random.choice("abeé") + u[i + 1 :]])
            if len(u) >= 7:
                n.setdefault(u, random.choice([2, 3, 30, 31, 400]))
    known = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["n"], r["n_near"], r["form_n"], r["root"]) for r in spelling.variants(known, shard=shard).collect()}
    want = plain_variants(n)
    assert got == want and sum(1 for w in want if want[w][4] != want[w][0] and want[w][0]) > 0
    assert spelling.variants(known.where("false"), shard=shard).collect() == []


def plain_negatives(rows, k, m, least, most):
    seen = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or len(v) != 4:
            continue
        one = (label, [int(np.floor(256.0 * x)) for x in v])
        seen[i] = min(seen.get(i, one), one)
    out = set()
    for a, (label, v) in seen.items():
        scored = sorted((-sum(x * y for x, y in zip(v, u, strict=True)), j, other) for j, (other, u) in seen.items() if j != a)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            fit = [x for x in scored if x[2] != label and least * -s <= -x[0] <= most * -s][:m]
            out |= {(a, p, r, x[1], -s, -x[0]) for r, x in enumerate(fit, 1)}
    return out


@pytest.mark.parametrize("run_rows", [3, 64])
def test_hard_negatives(spark, run_rows):
    rng = np.random.default_rng(run_rows)
    centres = rng.normal(size=(6, 4)).round(1)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in (centres[i % 6] + rng.normal(scale=0.3, size=4)).round(1)]) for i in range(150)]
    rows += [(200 + i, i % 3, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]  # copies
    rows += [(300, 1, None), (301, None, [1.0] * 4), (302, 1, [1.0, None, 1.0, 1.0]), (303, 1, [1.0, float("nan"), 0.0, 0.0]), (304, 1, [float("inf")] * 4), (305, 1, []), (306, 1, [1.0] * 3), (None, 1, [1.0] * 4), (307, 2, [0.0] * 4)]
    rows += [(5, 0, [9.0] * 4), rows[7]]
    vectors = annuli.quantised(spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, id string, run int").repartition(3))
    found = annuli.index(vectors, sample=100, pivot_rows=30, run_rows=run_rows)
    got = annuli.hard_negatives(found, found.rows.select("id", "label", "v"), 3, 4)
    want = plain_negatives(rows, 3, 4, Fraction(3, 10), Fraction(9, 10))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 500


def test_search_of_few_and_of_huge_values(spark):
    rows = [(1, 0, [1e38, 1.0]), (2, 0, [-1e38, 2.0]), (3, 1, [1e-3, 3.0]), (4, 0, [2.0, 2.0])]
    vectors = annuli.quantised(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    found = annuli.index(vectors)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("slot"), F.lit(-(1 << 63)).cast("long").alias("low"), F.lit((1 << 63) - 1).cast("long").alias("high")))
    got = annuli.search(found, found.rows.withColumn("windows", everything), 2, True).collect()
    assert {(r["query_id"], r["rank"], r["id"]) for r in got} == {(1, 1, 4), (1, 2, 2), (2, 1, 1), (2, 2, 4), (4, 1, 1), (4, 2, 2)}  # both are as low as 64 bits go
    assert annuli.index(vectors.where("false")) is None
    assert annuli.hard_negatives(None, vectors).collect() == []


def test_rounds_leave_out_what_is_too_far(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, [float(x) for x in rng.normal(size=2) + 20 * np.array([i % 5, (i // 5) % 5])]) for i in range(2000)]
    found = annuli.index(annuli.quantised(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")), pivot_rows=80, run_rows=20)
    queries = found.rows.where("id % 100 = 0").withColumn("windows", F.expr("array(named_struct('slot', 0L, 'low', -9223372036854775807L, 'high', 9223372036854775807L))")).withColumn("found", F.expr("CAST(NULL AS array<struct<slot:long,n:int,worst:long>>)")).withColumn("radius", F.lit(-1.0))
    first = queries.mapInArrow(annuli._plan(found, 5, 4, 4), annuli._PLAN).collect()
    assert all(len(r["runs"]) <= 6 for r in first)  # of more than 100 runs
    exact = {(r["query_id"], r["rank"]): r["score"] for r in annuli.search(found, queries.select("id", "label", "v", "windows"), 5, True).collect()}
    v = {i: np.floor(256 * np.array(x)).astype(int) for i, _, x in rows}
    for i in range(0, 2000, 100):
        best = sorted((-int(v[i] @ v[j]), j) for j in v if j != i)[:5]
        assert [exact[i, r] for r in range(1, 6)] == [-s for s, _ in best]
