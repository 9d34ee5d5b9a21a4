"""Segments, their words and their cues without shuffles of words, against the operators that take words as rows."""

import random

import pytest
from pyspark.sql import functions as F

from chronotext.functions import text
from chronotext.operators import packing, quality, sequence, stats
from chronotext.plans.registry import QUERIES
from chronotext.sources import tables

WORDS = ["a", "one", "señor", "Yes.", "no,", "extraordinary", "我们很好", "étude", "well…", "(and)", "I", "wonder?"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def segments(spark):
    random.seed(8)
    rows = []
    for m in range(12):
        at = 0.0
        for n in range(random.randrange(1, 9)):
            said = None if random.random() < 0.05 else "  ".join(random.choices(WORDS, k=random.choice([0, 1, 3, 12, 45])))
            took = random.choice([0.0, 300.0, 1500.0, 9000.0])
            rows.append((f"m{m}", n, "zh" if m == 3 else "en", said, at, None if random.random() < 0.03 else at + took))
            at += took + random.choice([0.0, 40.0, 700.0])
    return spark.createDataFrame(rows, "m string, n int, lang string, text string, start_ms double, end_ms double").repartition(3)


def test_words_of_an_array_are_those_of_rows(segments):
    rows = sequence.distribute_words(segments, ["m", "n"])
    own = sequence.with_words(segments).select("m", "n", F.posexplode("words").alias("pos", "w")).select("m", "n", "pos", "w.*")
    assert sorted(map(tuple, own.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)


@pytest.mark.parametrize("merge", [True, False])
def test_cues_of_segments_are_those_of_words(segments, merge):
    told = segments.where("end_ms IS NOT NULL")
    words = sequence.distribute_words(told, ["m", "n", "lang"])
    made = packing.packed_cues(words, ["m"], "n", "pos", "lang", merge=merge)
    want = sequence.reindex(sequence.fix_overlaps(made, ["m"], ["cue"], 80), ["m"], ["cue"]).select("m", "index", "start_ms", "end_ms", F.size("words").alias("n_words"), "lines")
    got = packing.segment_cues(told, ["m"], "n", "lang", merge=merge)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_visible_length_of_ascii(spark):
    odd = ["", " a\tb\r\n\x0b\x0c c ", "a\x1cb\x00", "é é 　我", "x y"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select(text.visible_length("t").alias("v"), F.regexp_count(F.regexp_replace("t", f"[{text.SPACE}]", " "), F.lit("(?! )\\X")).alias("w")).collect()
    assert all(r["v"] == r["w"] for r in rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    rows = [(1, "en", "one two.\n\n \t three  four \nfive"), (2, "es", None), (3, "en", "\n"), (4, "en", "x" * 50 + "\r\n" + "ab " * 30)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_segments_stay_where_their_documents_are(spark, folder):
    told = tables.segments(spark, folder)
    assert "Exchange" not in plan(told)
    assert sorted((r["doc_id"], r["seg_no"], r["text"], r["start_ms"], r["end_ms"]) for r in told.collect()) == [
        (1, 1, "one two.", 0.0, 480.0), (1, 2, "three four", 480.0, 1080.0), (1, 3, "five", 1080.0, 1380.0),
        (4, 1, "x" * 50, 0.0, 3000.0), (4, 2, ("ab " * 30).strip(), 3000.0, 3000.0 + 89 * 60),
    ]


@pytest.mark.parametrize("name", ["build_cues", "greedy_chunks"])
def test_cues_shuffle_segments_once(spark, folder, name):
    found = plan(QUERIES[name](spark, folder))
    assert found.split("Initial Plan")[0].count("Exchange") == 1 and "Window" not in found


def test_counted_words_are_not_shuffled(spark, folder):
    found = plan(QUERIES["segment_word_counts"](spark, folder))
    assert "collect_list" not in found and "Join" not in found
    assert {r["doc_id"]: r["word_count"] for r in QUERIES["segment_word_counts"](spark, folder).collect()} == {1: 5, 4: 31}


def test_a_pass_without_change_is_the_last(spark):
    said = "aXbXbXbXbXc " + "no no no no no no " * 2 + "ha" * 9
    df = spark.createDataFrame([(said,), ("plain",), (None,), ("",)], "t string")
    want = df
    for _ in range(10):
        want = want.withColumn("t", F.regexp_replace("t", "(.{2,20}?)\\1{3,}", "$1"))
    got = df.select(quality.deloop("t").alias("t"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("t").collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_counted_words_of_cues(spark):
    cues = spark.createDataFrame([("m", 0.0, 1000.0, ["a b", "c"], 7)], "m string, start_ms double, end_ms double, lines array<string>, n_words int")
    assert stats.cue_stats(cues, ["m"]).first()["word_count"] == 7


def test_segments_cleaned_by_their_own_words(spark, segments):
    """As by words that are rows of their own, and no word is shuffled."""
    told = segments.where("end_ms IS NOT NULL").select("m", "n", F.coalesce("text", F.lit("")).alias("text"), "lang", "start_ms", "end_ms")
    regions = told.where("n % 3 <> 0").select("m", (F.col("start_ms") + 90).alias("start_ms"), (F.col("end_ms") + 40).alias("end_ms"))
    words = sequence.distribute_words(told, ["m", "n"], lang=F.lit("en"))
    want = sequence.normalize_segments(told, words, regions, ["m"], "n", "pos", least_ms=120)
    own = sequence.with_words(told, lang=F.lit("en"))
    got = sequence.normalize_segments(own, None, regions, ["m"], "n", "pos", least_ms=120)
    rows = lambda df: sorted(map(tuple, df.select("m", "n", "text", "start_ms", "end_ms", "words").collect()))
    assert rows(got) == rows(want) and any(r["words"] for r in want.collect()) and any(r["words"] is None for r in want.collect())
    ends = sequence.normalize_segments(own, None, regions, ["m"], "n", "pos", least_ms=120, whole=False)
    counted = sorted((r["m"], r["n"], r["text"], len(r["words"] or []), r["start_ms"], r["end_ms"]) for r in want.collect())
    assert sorted(map(tuple, ends.select("m", "n", "text", "n_words", "start_ms", "end_ms").collect())) == counted
    assert all(len(r["words"] or []) <= 2 for r in ends.collect())
