"""Cuts by doubling against the walk, whatever the chunk."""

import random

import pytest

from chronotext.operators import cuts
from chronotext.operators.packing import blocks_of, pack
from chronotext.schema import LATIN_STYLE


def media(seed, n):
    random.seed(seed)
    rows = [("long" if random.random() < 0.5 else f"m{random.randrange(20)}", i, random.choice([0, 1, 3, 20, 90, 401]), "x" * random.choice([1, 3, 9, 30, 100]) + random.choice(["", "", "."])) for i in range(n)]
    return rows, sorted({r[0] for r in rows})


@pytest.mark.parametrize("chunk", [7, 50, 1 << 16])
def test_blocks(spark, chunk):
    rows, names = media(chunk, 1500)
    got = cuts.cue_blocks(spark.createDataFrame(rows, "m string, i long, n long, t string").repartition(5), ["m"], ["i"], "n", chunk=chunk).collect()
    assert len(got) == len(rows)
    for m in names:
        own = sorted((r for r in got if r["m"] == m), key=lambda r: r["i"])
        assert [r["block"] for r in own] == blocks_of([r["n"] for r in own], 6, 400)


@pytest.mark.parametrize("chunk", [100, 1 << 16])
def test_word_runs(spark, chunk):
    rows, names = media(chunk + 1, 1500)
    told = spark.createDataFrame(rows, "m string, i long, n long, t string").selectExpr("*", "char_length(t) AS size", "endswith(t, '.') AS closes")
    got = cuts.word_runs(told, ["m"], ["i"], "size", "closes", LATIN_STYLE.capacity, chunk=chunk).collect()
    for m in names:
        own = sorted((r for r in got if r["m"] == m), key=lambda r: r["i"])
        want = [k for k, (a, b) in enumerate(pack([r["t"] for r in own], LATIN_STYLE, "en")) for _ in range(b - a)]
        assert [r["run"] for r in own] == want


def test_numbers_of_long_media_and_null_keys(spark):
    rows = [(None if i % 3 == 0 else "a", i // 2) for i in range(400)]
    got = cuts.numbered(spark.createDataFrame(rows, "m string, i long").repartition(7), ["m"], ["i"]).collect()
    for m in (None, "a"):
        own = sorted((r for r in got if r["m"] == m), key=lambda r: r["no"])
        assert [r["no"] for r in own] == list(range(len(own))) and [r["i"] for r in own] == sorted(r["i"] for r in own)


def test_no_rows_and_too_small_chunks(spark):
    empty = spark.createDataFrame([], "m string, i long, n long")
    assert cuts.cue_blocks(empty, ["m"], ["i"], "n").collect() == []
    with pytest.raises(ValueError, match="longer"):
        cuts.cue_blocks(empty, ["m"], ["i"], "n", chunk=6)
