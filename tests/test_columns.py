"""Column expressions against known results."""

import pytest
from pyspark.sql import functions as F

from chronotext.functions import streams, text, timing
from chronotext.operators import quality, sequence
from chronotext.sources import sinks


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("said", "n"),
    [("Sr. García llegó. ¿Qué hora es?", 2), ("你好！世界？再见；", 3), ("Pi is 3.14 today. Yes", 2), ('He said "go!" Then left.', 2), ("", 0), ("no end", 1)],
)
def test_sentences(spark, said, n):
    assert len(one(spark, text.sentences("t"), t=said)) == n


def test_scripts_and_lengths(spark):
    assert one(spark, text.script("t"), t="hello 你好") == "mixed"
    assert one(spark, text.script("t"), t="123") == "latin"
    assert one(spark, text.visible_length("t"), t="a b \U0001F468‍\U0001F469‍\U0001F467 é") == 4
    assert one(spark, text.utf16_length("t"), t="a\U0001F600") == 3
    assert one(spark, text.tokens("t", F.lit("zh")), t="我用 Spark 3") == ["我", "用", "Spark", "3"]
    assert one(spark, text.for_display("t"), t="​“Hi”  你 好 ") == '"Hi" 你好'
    assert one(spark, text.halfwidth("t"), t="Ａ１　！") == "A1 !"


@pytest.mark.parametrize(("tag", "code"), [("zh_CN", "zh"), ("ES", "es"), ("eng", "en"), ("fr", "unknown"), ("", "unknown"), ("essential", "unknown")])
def test_language_tags(spark, tag, code):
    assert one(spark, text.language_tag("t"), t=tag) == code


def test_times(spark):
    assert one(spark, timing.srt_time("t"), t=3_723_004.9) == "01:02:03,004"
    assert one(spark, timing.vtt_time("t"), t=-5.0) == "00:00:00.000"
    assert one(spark, timing.ass_time("t"), t=3_723_004.9) == "1:02:03.00"
    assert one(spark, timing.parse_time("t"), t="01:02:03,5") == 3_723_500
    assert one(spark, timing.parse_time("t"), t="02:03") == 123_000
    assert one(spark, timing.parse_time("t"), t="00:61:00") is None
    assert one(spark, timing.clock("t"), t=61_400.0) == "01:01"
    assert one(spark, timing.ffmpeg_time("t"), t="frame=1 time=00:00:01.50 bitrate") == 1500


@pytest.mark.parametrize(("colour", "opacity", "out"), [("#000000", 0.6, "&H66000000"), ("#ABCDEF", 1.0, "&H00EFCDAB"), ("fff", 1.0, "&H00FFFFFF")])
def test_colours(spark, colour, opacity, out):
    assert one(spark, timing.ass_colour("t", opacity), t=colour) == out


@pytest.mark.parametrize(("said", "out"), [("hahahaha", "ha"), ("abcabcabcabc", "abc"), ("fine text", "fine text")])
def test_deloop(spark, said, out):
    assert one(spark, quality.deloop("t"), t=said) == out


@pytest.mark.parametrize(
    ("said", "noise"),
    [("Thanks for watching!", True), ("you you you you you", True), ("This is a perfectly normal sentence about music.", False), ("", True), ("谢谢观看", True), ("aaaaaaaa", True), ("I", True), ("please subscribe to it now", True)],
)
def test_hallucinations(spark, said, noise):
    assert one(spark, quality.hallucinated("t"), t=said) is noise


def test_hypotheses(spark):
    assert one(spark, streams.stable_prefix("a", "b"), a="the quick brown fox", b="the quick red fox") == "the quick"
    assert one(spark, streams.stable_prefix("a", "b"), a="", b="x") == ""
    assert one(spark, streams.stable_prefix("a", "b"), a="Hello, world", b="hello world again") == "hello world"
    assert one(spark, streams.strip_overlap("a", "b"), a="hello world", b="world today") == "today"
    assert one(spark, streams.strip_overlap("a", "b"), a="one", b="two  three") == "two three"
    assert one(spark, streams.strip_overlap("a", "b"), a="same", b="same") == ""


def test_fix_overlaps(spark):
    cues = lambda *x: spark.createDataFrame([("m", float(a), float(b)) for a, b in x], "m string, start_ms double, end_ms double")
    ends = lambda d: [tuple(r)[1:] for r in sequence.fix_overlaps(d, ["m"], ["start_ms"], 100).orderBy("start_ms").collect()]
    assert ends(cues((0, 2200), (2100, 3000))) == [(0, 2000), (2100, 3000)]
    assert ends(cues((0, 100), (50, 300))) == [(50, 300)]


def test_distribute_words(spark):
    rows = spark.createDataFrame([("m", "one two three", 0.0, 3000.0), ("e", "", 0.0, 5.0), ("z", "a b", 7.0, 7.0)], "m string, text string, start_ms double, end_ms double")
    out = sequence.distribute_words(rows, ["m"], lang=F.lit("en")).orderBy("m", "pos").collect()
    assert [(r["m"], r["text"], r["start_ms"], r["end_ms"]) for r in out] == [("m", "one", 0, 818), ("m", "two", 818, 1636), ("m", "three", 1636, 3000), ("z", "a", 7, 7), ("z", "b", 7, 7)]


def test_snap_to_regions(spark):
    segments = spark.createDataFrame([("m", 1, 1050.0, 1900.0, None), ("m", 2, 3200.0, 3900.0, None)], "m string, n int, start_ms double, end_ms double, words array<struct<text:string,start_ms:double,end_ms:double>>")
    regions = spark.createDataFrame([("m", 1000.0, 2000.0), ("m", 3000.0, 4000.0)], "m string, start_ms double, end_ms double")
    out = sequence.snap_to_regions(segments, regions, ["m"], ["n"]).orderBy("n").collect()
    assert [(r["start_ms"], r["end_ms"]) for r in out] == [(1000, 2000), (3000, 4000)]


def test_documents(spark):
    cues = spark.createDataFrame([("m", 1, 0.0, 1500.0, ["Hello", "you"]), ("m", 2, 2000.0, 3000.0, ["{x}"])], "m string, index int, start_ms double, end_ms double, lines array<string>")
    media = spark.createDataFrame([("m",), ("none",)], "m string")
    srt = {r["m"]: r["srt"] for r in sinks.srt(cues, ["m"], media=media).collect()}
    assert srt == {"m": "1\n00:00:00,000 --> 00:00:01,500\nHello\nyou\n\n2\n00:00:02,000 --> 00:00:03,000\n{x}\n", "none": ""}
    vtt = {r["m"]: r["vtt"] for r in sinks.vtt(cues, ["m"], media=media).collect()}
    assert vtt["none"] == "WEBVTT\n\n" and vtt["m"].startswith("WEBVTT\n\n00:00:00.000 --> 00:00:01.500\nHello")
    assert "Dialogue: 0,0:00:02.00,0:00:03.00,Default,,0,0,0,,(x)\n" in sinks.ass(cues, ["m"], title="T").first()["ass"]
    words = [{"text": t, "start_ms": 100.0 * i} for i, t in enumerate("one two three".split())]
    assert sinks.karaoke(["one two", "three"], words) == ["<00:00:00.000>one <00:00:00.100>two", "<00:00:00.200>three"]
    assert one(spark, text.plain_text("t"), t=srt["m"]) == "Hello you {x}"
    assert one(spark, sinks.with_suffix("t", ".es"), t="a.b/film.srt") == "a.b/film.es.srt"


def test_median_and_percentile(spark):
    rows = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate([5, 1, 9, 2, 8, 3])], "m string, i int, v double")
    got = [r["s"] for r in sequence.median_filter(rows, ["m"], ["i"], "v", "s").orderBy("i").collect()]
    values = [5, 1, 9, 2, 8, 3]
    at = lambda i: values[min(5, max(0, i))]
    assert got == [sorted(at(i + d) for d in range(-2, 3))[2] for i in range(6)]
    assert sequence.percentile_floor(rows, ["m"], "v", 0.9).first()["percentile"] == 8.0


def test_group_words_and_merge(spark):
    words = spark.createDataFrame([("m", 0, "Hi.", 0.0, 100.0), ("m", 1, "there", 150.0, 300.0), ("m", 2, "late", 1100.0, 1200.0), ("m", 3, " ", 1200.0, 1300.0)], "m string, p int, text string, start_ms double, end_ms double")
    out = sequence.group_words(words, ["m"], ["p"]).orderBy("segment").collect()
    assert [(r["text"], r["start_ms"], r["end_ms"]) for r in out] == [("Hi.", 0, 100), ("there", 150, 300), ("late", 1100, 1200)]
    regions = spark.createDataFrame([("m", 0.0, 10.0), ("m", 5.0, 20.0), ("m", 21.0, 30.0)], "m string, start_ms double, end_ms double")
    assert sorted((r["start_ms"], r["end_ms"]) for r in sequence.merge_intervals(regions, ["m"]).collect()) == [(0, 20), (21, 30)]
