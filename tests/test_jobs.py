"""Jobs as rows, the clean-up of segments, readings, and the registered SQL of a few queries."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.functions import text, timing
from chronotext.operators import jobs, phonetics, sequence, signal, translate
from chronotext.plans.engine import Engine
from chronotext.schema import Style
from chronotext.sources import media, sinks
from chronotext.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_choices_and_targets(spark):
    assert one(spark, jobs.choice_error(F.lit("tiny"), "model")) is None
    assert one(spark, jobs.choice_error(F.lit("huge"), "model")) == 'Invalid model "huge". Expected one of: tiny, base, small.'
    with pytest.raises(Exception, match="Invalid format"):
        one(spark, jobs.required_choice(F.lit("doc"), "format"))
    assert one(spark, jobs.target_list(F.lit("es, en,es ,,"))).asDict() == {"targets": ["es", "en"], "error": None}
    assert "fr" in one(spark, jobs.target_list(F.lit("es,fr")))["error"]
    assert one(spark, jobs.target_list(F.lit(" , ")))["error"].startswith("No translation languages")
    assert one(spark, jobs.active_targets(F.array(F.lit("zh"), F.lit("es"), F.lit("en")), F.lit("es"))) == ["zh", "en"]


@pytest.mark.parametrize(("a", "b", "said"), [(0, 1000, None), (0, 90_000, None), (0, 120_000, "exceeds"), (5, 5, "Invalid"), (-1, 5, "Invalid"), (None, 5, "Invalid"), (float("nan"), 5, "Invalid"), (0, 120_001, "limited"), (99_000, 102_001, "exceeds"), (99_000, 102_000, None)])
def test_clip_ranges(spark, a, b, said):
    got = one(spark, jobs.clip_error(F.lit(a).cast("double"), F.lit(b).cast("double"), F.lit(100_000.0)))
    assert got is None if said is None else said in got


def test_edits(spark):
    cues = spark.createDataFrame([("m", 1), ("m", 2), ("n", 1), ("o", 1)], "m string, index int")
    edits = spark.createDataFrame([("m", 1, "fine"), ("m", 2, " \t "), ("n", 1, "x" * 500)], "m string, index int, text string")
    got = {r["m"]: r["error"] for r in jobs.edit_check(cues, edits, ["m"]).collect()}
    assert got == {"m": "Cue 2 must be between 1 and 500 characters.", "n": None, "o": "Expected 1 cues."}


def test_styles(spark):
    plain = one(spark, jobs.merged_style(F.lit(None).cast(f"struct<{jobs.STYLE_INPUT.replace(' ', ':').replace(',:', ',')}>")))
    assert plain["font_family"] == "Arial" and plain["font_size"] == 48 and plain["position"] == "bottom"
    sent = F.from_json(F.lit('{"fontFamily":"  Serif ","fontSize":900,"primaryColor":"#12","outlineColor":"abc","bold":false,"shadow":-1}'), jobs.STYLE_INPUT)
    got = one(spark, jobs.merged_style(sent))
    assert (got["font_family"], got["font_size"], got["primary_color"], got["outline_color"], got["bold"], got["shadow"]) == ("Serif", 160, "#ffffff", "abc", False, 0)


def test_upsert_lookup_prune_and_tail(spark):
    records = spark.createDataFrame([("a", "queued", 0), ("b", "queued", 0)], "id string, status string, percent int")
    patches = spark.createDataFrame([("a", 1, "running", None), ("a", 2, None, 40), ("c", 1, "done", 9)], "id string, n int, status string, percent int")
    assert {tuple(r) for r in jobs.upsert(records, patches, ["id"], ["n"]).collect()} == {("a", "running", 40), ("b", "queued", 0)}
    made = spark.createDataFrame([("j2", {"x": "late"}), ("j1", {"x": "first", "y": "other"}), ("j3", None)], "job string, exports map<string,string>")
    asked = spark.createDataFrame([("x",), ("z",)], "export_id string")
    assert [tuple(r) for r in jobs.find_export(made, asked, "job").select("export_id", "job", "record").collect()] == [("x", "j1", "first")]
    old = spark.sql("SELECT 1 AS id, TIMESTAMP '2024-01-01 00:00:00' AS created_at UNION ALL SELECT 2, TIMESTAMP '2024-01-01 01:30:00' UNION ALL SELECT 3, NULL")
    kept, removed = jobs.prune(old, F.lit("2024-01-01 02:00:00").cast("timestamp"))
    assert {r["id"] for r in kept.collect()} == {2, 3} and {r["id"] for r in removed.collect()} == {1}
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "g string, i int")
    assert {tuple(r) for r in jobs.tail(rows, ["g"], ["i"], 2).collect()} == {("a", 3), ("a", 4), ("b", 0)}


def test_files_and_downloads(spark):
    rows = spark.createDataFrame([("/a/talk.wav", "en", ["es"]), ("/a/b.c.wav", "en", ["es", "zh"]), ("plain", "en", [])], "path string, language string, targets array<string>")
    files = lambda form, batch: sorted(r["file"] for r in jobs.output_files(rows, "path", "targets", F.lit(form), batch).collect())
    assert files("srt", False) == ["/a/b.c.es.srt", "/a/b.c.srt", "/a/b.c.zh.srt", "/a/talk.es.srt", "plain.srt"]
    assert files("vtt", True) == ["/a/b.c.es.vtt", "/a/b.c.vtt", "/a/b.c.zh.vtt", "/a/talk.es.vtt", "/a/talk.vtt", "plain.vtt"]
    assert files("json", False) == ["/a/b.c.json", "/a/talk.json", "plain.json"]
    assert one(spark, jobs.download(F.lit("talk.mp3"), F.lit("vtt"), F.lit("es")))["name"] == "talk.es.vtt"
    assert one(spark, jobs.download(F.lit(""), F.lit("json")))["name"] == "subtitles.study.json"
    assert one(spark, jobs.download(F.lit("x"), F.lit("doc"))) is None


def test_written_files(spark, tmp_path):
    docs = spark.createDataFrame([("a.srt", "1\nx\n"), ("b.srt", "2\ny\n")], "file string, srt string")
    sinks.write_files(docs, str(tmp_path / "out"), "file", "srt", 2)
    parts = {p.parent.name: p.read_text() for p in (tmp_path / "out").rglob("part-*.txt")}
    assert parts == {"file=a.srt": "1\nx\n\n\n", "file=b.srt": "2\ny\n\n\n"}


def test_progress_and_clocks(spark):
    got = [one(spark, jobs.progress(F.lit(s), F.lit(p))) for s, p in [("queued", 9.0), ("decoding", 0.0), ("transcribing", 50.0), ("loading-model", 200.0), ("done", 1.0), ("odd", 1.0)]]
    assert got == [0, 5, 55, 85, 100, None]
    assert [one(spark, timing.clock_tenths(F.lit(x))) for x in (0, 59_960, 61_500, 3_723_400)] == ["00:00.0", "00:60.0", "01:01.5", "1:02:03.4"]


def test_client_messages(spark):
    said = lambda x: one(spark, live.client_message(F.lit(x)))
    assert said('{"type":"start","language":"en","model":"base"}')["model"] == "base"
    assert said('{"type":"start","language":"en"}') is None and said('{"type":"start","language":"en","model":"base","translateTo":"fr"}') is None
    assert said('{"type":"flush"}')["type"] == "flush" and said("[]") is None and said("null") is None


def test_segments_are_cleaned(spark):
    segs = spark.createDataFrame([("m", 0, "x", 1050.0, 1900.0), ("m", 1, "Thanks for watching!", 3200.0, 3900.0), ("m", 2, "hahahaha is what they said then", 5000.0, 6000.0)], "m string, seg int, text string, start_ms double, end_ms double")
    words = spark.createDataFrame([("m", 0, 0, "a", 1050.0, 1090.0), ("m", 0, 1, "good", 1100.0, 1400.0), ("m", 0, 2, "day", 1400.0, 1900.0)], "m string, seg int, pos int, text string, start_ms double, end_ms double")
    regions = spark.createDataFrame([("m", 1000.0, 2000.0), ("m", 3000.0, 4000.0)], "m string, start_ms double, end_ms double")
    got = {r["seg"]: r for r in sequence.normalize_segments(segs, words, regions, ["m"], "seg", "pos").collect()}
    assert set(got) == {0, 2}
    assert (got[0]["text"], got[0]["start_ms"], got[0]["end_ms"]) == ("good day", 1000.0, 2000.0)
    assert got[2]["text"] == "ha is what they said then" and got[2]["words"] is None


def test_pinyin_columns(spark):
    table = {"展": "zhǎn", "览": "lǎn", "馆": "guǎn", "你": "nǐ", "好": "hǎo"}
    assert one(spark, phonetics.pinyin_of(F.lit("展览馆"), table)) == "zhán lán guǎn"
    assert one(spark, phonetics.pinyin_of(F.lit("你好，你好"), table)) == "ní hǎo, ní hǎo"
    assert one(spark, phonetics.pinyin_of(F.lit("你 Spark3 好"), table)) == "nǐ Spark3 hǎo"
    words = F.array(F.struct(F.lit("你好").alias("text")), F.struct(F.lit("ok").alias("text")))
    assert one(spark, phonetics.pinyin_of_words(words, table)) == ["ní hǎo", "ok"]


def test_spectrum_and_back():
    x = np.random.default_rng(2).normal(size=32)
    re, im = signal.fft(x)
    back, rest = signal.ifft(re, im)
    assert np.allclose(back, x) and np.allclose(rest, 0) and np.allclose(re[0], x.sum())
    with pytest.raises(ValueError, match="power of two"):
        signal.fft(x[:5])


def test_signals_are_prepared(spark):
    rate, random = 16000, np.random.default_rng(3)
    t = np.arange(2 * rate) / rate
    voice = 0.3 * np.sin(2 * np.pi * 300 * t) * (np.arange(2 * rate) // (rate // 2) % 2)
    noisy = voice + random.normal(0, 0.15, len(t))
    rows = [("clean", voice.tolist(), None), ("noisy", noisy.tolist(), None), ("wide", voice.tolist(), [voice.tolist(), (voice * 0.9).tolist()])]
    audio = spark.createDataFrame([(m, x, rate, c) for m, x, c in rows], "m string, samples array<float>, rate int, channel_data array<array<float>>")
    got = {r["m"]: r for r in signal.prepared(audio, ["m"]).collect()}
    assert got["noisy"]["snr_db"] < 10 and got["clean"]["snr_db"] is None  # nothing but silence beside the speech
    assert np.abs(np.array(got["noisy"]["samples"])[: rate // 2]).mean() < 0.8 * np.abs(noisy[: rate // 2]).mean()
    assert len(got["noisy"]["samples"]) == len(t)
    voices = {r["m"]: r for r in signal.prepared(audio, ["m"], vocals=True).collect()}
    assert np.corrcoef(voices["wide"]["samples"], voice)[0, 1] > 0.9 and len(voices["clean"]["samples"]) == len(t)


def test_the_engine_keeps_the_times_of_words(spark):
    engine = Engine(spark, readings={"你": "nǐ", "好": "hǎo"}, simplified={"們": "们"})
    segs = spark.createDataFrame([("m", 0, "en", "one two", 0.0, 3000.0), ("m", 1, "en", "three four", 3500.0, 6500.0)], "m string, seg_no int, lang string, text string, start_ms double, end_ms double")
    words = spark.createDataFrame([("m", 0, 0, "one", 0.0, 500.0), ("m", 0, 1, "two", 2000.0, 3000.0)], "m string, seg_no int, pos int, text string, start_ms double, end_ms double")
    none = spark.createDataFrame([], "m string, start_ms double, end_ms double")
    clean = engine.clean(segs, none, ["m"], words)
    cues = engine.cues(clean, ["m"]).orderBy("index").collect()
    assert [[(w["text"], w["start_ms"], w["end_ms"]) for w in c["words"]] for c in cues][0] == [("one", 0.0, 500.0), ("two", 2000.0, 3000.0)]
    assert [c["lines"] for c in cues] == [["one two"], ["three four"]]
    han = spark.createDataFrame([(["你好"], "zh"), (["casa"], "es")], "lines array<string>, lang string")
    assert {(r["pinyin"], r["ipa"]) for r in engine.annotate(han).collect()} == {("ní hǎo", None), (None, "ˈkasa")}


def test_study_documents(spark):
    cues = spark.createDataFrame([("m", 'a"b', 1, 0.0, 900.0, ["x"], [("x", 0.0, 900.0)])], "m string, lang string, index int, start_ms double, end_ms double, lines array<string>, words array<struct<text:string,start_ms:double,end_ms:double>>")
    other = spark.createDataFrame([("m", "es", 1, 0.0, 900.0, ["y"])], "m string, target string, index int, start_ms double, end_ms double, lines array<string>")
    got = json.loads(sinks.study(cues, ["m"], "lang", translations=other).first()["study"])
    assert got == {"version": 1, "language": 'a"b', "durationMs": 900.0, "cues": [{"startMs": 0.0, "endMs": 900.0, "lines": ["x"], "words": [{"text": "x", "startMs": 0.0, "endMs": 900.0}]}], "translations": {"es": {"cues": [{"startMs": 0.0, "endMs": 900.0, "lines": ["y"], "words": []}]}}}


def test_live_audio_windows(spark):
    held = live.Buffer(1000, 3000)
    for i in range(5):
        held.append(np.full(1000, i, np.float32))
    assert held.consumed_ms == 5000 and held.begin == 2000 and len(held.samples) == 3000
    window, at = held.window(1500)
    assert len(window) == 1500 and at == 3500
    held.trim(500)
    assert held.consumed_ms == 5000 and held.window(9000)[1] == 4500
    frames = spark.createDataFrame([("s", 1, "audio", [0.1] * 1000), ("s", 0, "audio", [0.5] * 1000), ("s", 2, "stop", None)], "session_id string, seq long, kind string, samples array<float>")
    got = live.frames_to_updates(frames, lambda x, rate: (f"{len(x)}", 10.0, len(x) / rate * 1000), rate=1000, partial_ms=1500).orderBy("seq").collect()
    assert [(r["hypothesis"], r["consumed_ms"], r["speech_start_ms"]) for r in got] == [("1000", 1000.0, 10.0), ("1500", 2000.0, 510.0), ("2000", 2000.0, 10.0)]


def test_late_updates_change_nothing():
    s = live.Session()
    row = lambda seq, kind="audio", said="hello": {"seq": seq, "kind": kind, "consumed_ms": seq * 1500.0, "speech_start_ms": 0.0, "speech_end_ms": seq * 1500.0, "hypothesis": said}
    list(s.take(row(2)))
    assert list(s.take(row(1, "flush"))) == [] and s.last_seq == 2


def test_translators_by_route_and_in_batches():
    seen = []

    def model(texts, a, b):
        seen.append((a, b, len(texts)))
        return [t + b for t in texts]

    run = translate.in_batches(translate.by_route({("es", "en"): model, ("en", "zh"): model}), 2)
    assert run(["a", "", "b", "c"], "es", "zh") == ["aenzh", "", "benzh", "cenzh"]
    assert seen == [("es", "en", 2), ("en", "zh", 2), ("es", "en", 1), ("en", "zh", 1)]
    assert run(["a"], "en", "en") == ["a"] and translate.in_batches(lambda t, a, b: [""] * len(t))(["a"], "x", "y") == ["a"]
    with pytest.raises(KeyError, match="zh to en"):
        run(["a"], "zh", "es")


def test_other_containers_and_batches(spark, tmp_path):
    program = tmp_path / "decoder"
    program.write_text("#!/bin/sh\nif [ \"$(head -c 3)\" = bad ]; then echo broken >&2; exit 3; fi\nprintf '\\000\\000\\200\\077\\000\\000\\000\\277'\n")
    program.chmod(0o755)
    files = spark.createDataFrame([("a", bytearray(b"fine")), ("b", bytearray(b"bad!"))], "path string, content binary")
    got = {r["path"]: r for r in media.decode_others(files, program=str(program), stereo=True).collect()}
    assert got["a"]["samples"] == [0.25] and got["a"]["channel_data"] == [[1.0], [-0.5]] and "broken" in got["b"]["error"]
    none = media.decode_others(files, program="no-such-program").first()
    assert none["error"] == "no decoder is installed" and none["samples"] is None

    def process(r):
        if r["path"] == "b":
            raise ValueError("deaf")
        return r["path"].upper()

    assert sorted(map(tuple, media.run_batch(files.select("path"), process).collect())) == [("a", True, "A", None), ("b", False, None, "deaf")]


def test_uploads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.wav").write_bytes(b"abc")
    assert [(r["length"], bytes(r["content"])) for r in media.uploads(spark, str(tmp_path / "in"), stream=False).collect()] == [(3, b"abc")]
    query = media.uploads(spark, str(tmp_path / "in")).select("length").writeStream.format("memory").queryName("uploads").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(60)
    assert [r["length"] for r in spark.table("uploads").collect()] == [3]


def test_pretty_documents_and_paths(spark):
    assert sinks.pretty('{"a":[1],"b":"é"}') == '{\n  "a": [\n    1\n  ],\n  "b": "é"\n}\n'
    assert one(spark, text.filter_path(F.lit("C:\\a b\\subs.ass"))) == "'C\\:/a b/subs.ass'" and one(spark, text.filter_path(F.lit("/x/y.ass"))) == "/x/y.ass"


def test_styles_of_an_engine_and_translated_cues(spark):
    engine = Engine(spark, translator=lambda texts, a, b: [t.upper() for t in texts], style=Style(max_chars=8, max_lines=1))
    segs = spark.createDataFrame([("m", 0, "en", "one two three four", 0.0, 9000.0)], "m string, seg_no int, lang string, text string, start_ms double, end_ms double")
    cues = engine.cues(segs, ["m"])
    assert [r["lines"] for r in cues.orderBy("index").collect()] == [["one two"], ["three"], ["four"]]
    said = engine.translate(cues, ["m"], "en", "es").orderBy("index").collect()
    assert " ".join(" ".join(r["lines"]) for r in said) == "ONE TWO THREE FOUR" and "words" not in said[0].asDict()
    assert engine.documents(cues, ["m"], "txt").first()["txt"] == "one two\nthree\nfour\n"
