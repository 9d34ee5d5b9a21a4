"""Registered queries over jobs as rows: checks, patches, look-ups, lifetimes, files. Documents, events and turns stand for jobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text, timing
from ..operators import jobs, sequence, translate
from ..sources import media
from ..sources.tables import intervals, table, turns
from ..streaming import live
from .registry import query


def _choice_sql(column: str, label: str, allowed: list[str]) -> str:
    return f"""CASE WHEN {column} NOT IN ({", ".join(f"'{a}'" for a in allowed)}) THEN 'Invalid {label} "' || {column} || '". Expected one of: {", ".join(allowed)}.' END"""


@query(f"SELECT doc_id, {_choice_sql('lang', 'language', jobs.CHOICES['language'])} AS language_error, {_choice_sql('source', 'format', jobs.CHOICES['format'])} AS format_error FROM documents")
def choice_guards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", jobs.choice_error("lang", "language").alias("language_error"), jobs.choice_error("source", "format").alias("format_error"))


@query("""WITH r AS (SELECT event_id, value * 1000 - 5000 AS a, CASE WHEN event_id % 10 = 9 THEN NULL ELSE value * 1000 - 5000 + (event_id % 6) * 30000 END AS b FROM events)
SELECT event_id, CASE WHEN a IS NULL OR b IS NULL OR a < 0 OR b <= a THEN 'Invalid clip range. Use startMs and endMs in milliseconds.'
WHEN b - a > 120000 THEN 'Clips are limited to 120 seconds.' WHEN b > 62000 THEN 'Clip range exceeds the media duration.' END AS error FROM r""")
def clip_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") * 1000 - 5000).alias("a"))
    rows = rows.withColumn("b", F.when(F.col("event_id") % 10 == 9, None).otherwise(F.col("a") + F.col("event_id") % 6 * 30000))
    return rows.select("event_id", jobs.clip_error("a", "b", F.lit(60_000.0)).alias("error"))


@query("""SELECT vec_id, CAST(len(c) AS INTEGER) AS n, round(list_sum(list_transform(c, lambda x: x::DOUBLE)), 5) AS total
FROM (SELECT vec_id, embedding[floor(vec_id % 5 * 0.5 + 0.5)::INTEGER + 1:least(len(embedding), floor((vec_id % 5 + 40) * 0.5 + 0.5)::INTEGER)] AS c FROM embeddings)""")
def sample_clips(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", jobs.clip("embedding", F.lit(500), F.col("vec_id") % 5, F.col("vec_id") % 5 + 40).alias("c"))
    return rows.select("vec_id", F.size("c").alias("n"), F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query(r"""WITH e AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN '   ' WHEN conv_id % 5 = 0 THEN repeat(text || ' ', 10) ELSE text END AS t FROM conversations WHERE NOT (conv_id % 11 = 0 AND turn = 0)),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM e),
b AS (SELECT conv_id, count(*) AS n, min(k) FILTER (t = '' OR length(t) + len(regexp_extract_all(t, '[\x{10000}-\x{10FFFF}]')) > 500) AS bad FROM p GROUP BY conv_id),
c AS (SELECT conv_id, count(*) AS n_cues FROM conversations GROUP BY conv_id)
SELECT conv_id, n_cues, CASE WHEN coalesce(n, 0) <> n_cues THEN 'Expected ' || n_cues || ' cues.' WHEN bad IS NOT NULL THEN 'Cue ' || bad || ' must be between 1 and 500 characters.' END AS error FROM c LEFT JOIN b USING (conv_id)""")
def edit_checks(spark, sf_dir):
    rows = turns(spark, sf_dir)
    text = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 1), "   ").when(F.col("conv_id") % 5 == 0, F.repeat(F.concat("text", F.lit(" ")), F.lit(10))).otherwise(F.col("text"))
    edits = rows.where("NOT (conv_id % 11 = 0 AND turn = 0)").select("conv_id", "turn", text.alias("text"))
    return jobs.edit_check(rows, edits, ["conv_id"], index="turn")


_STYLES = """k AS (SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events)"""


@query(f"""WITH {_STYLES} SELECT event_id, CASE WHEN k % 5 = 0 THEN 'Arial' ELSE 'Font ' || k END AS font_family, least(160, greatest(12, k * 3))::DOUBLE AS font_size, CASE WHEN k % 7 = 0 THEN TRUE ELSE k % 2 = 0 END AS bold,
CASE k % 3 WHEN 0 THEN '#Fff' WHEN 1 THEN 'abcdef' ELSE '#ffffff' END AS primary_color, CASE k % 4 WHEN 0 THEN 'top' WHEN 1 THEN 'middle' ELSE 'bottom' END AS position, 2.0::DOUBLE AS outline_width,
round(least(1, k / 50), 6) AS background_opacity FROM k""")
def merged_styles(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    sent = F.format_string(
        '{"fontFamily":"%s","fontSize":%d,"bold":%s,"primaryColor":"%s","position":"%s","outlineWidth":"wide","backgroundOpacity":%s}',
        F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit(" Font "), k.cast("string"))), k * 3, F.when(k % 7 == 0, "null").otherwise((k % 2 == 0).cast("string")),
        F.when(k % 3 == 0, "#Fff").when(k % 3 == 1, "abcdef").otherwise("red"), F.when(k % 4 == 0, "top").when(k % 4 == 1, "middle").when(k % 4 == 2, "bottom").otherwise("left"), (k / 50).cast("string"),
    )
    style = table(spark, sf_dir, "events").select("event_id", jobs.merged_style(F.from_json(sent, jobs.STYLE_INPUT)).alias("s")).select("event_id", "s.*")
    return style.select("event_id", "font_family", "font_size", "bold", "primary_color", "position", "outline_width", F.round("background_opacity", 6).alias("background_opacity"))


_MESSAGES = [
    ('{"type":"start","language":"es","model":"tiny","translateTo":"en"}', ("start", "es", "tiny", "en")),
    ('{"type":"start","language":"fr","model":"tiny"}', None),
    ('{"type":"start","language":"auto","model":"small","translateTo":null}', ("start", "auto", "small", None)),
    ('{"type":"start","language":"zh","model":"base","translateTo":"xx"}', None),
    ('{"type":"flush","language":"fr"}', ("flush", None, None, None)),
    ('{"type":"stop"}', ("stop", None, None, None)),
    ('[{"type":"stop"}]', None),
    ("not json", None),
    ('{"type":"restart"}', None),
]
_said = lambda v: "NULL" if v is None else f"'{v}'"


@query(f"""WITH m AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_said(w and w[0])}, {_said(w and w[1])}, {_said(w and w[2])}, {_said(w and w[3])})" for i, (_, w) in enumerate(_MESSAGES))}) t(i, type, language, model, translate_to))
SELECT event_id, type IS NOT NULL AS valid, type, language, model, translate_to FROM events JOIN m ON event_id % {len(_MESSAGES)} = i""")
def client_messages(spark, sf_dir):
    raw = F.element_at(F.array(*(F.lit(r) for r, _ in _MESSAGES)), (F.col("event_id") % len(_MESSAGES) + 1).cast("int"))
    told = table(spark, sf_dir, "events").select("event_id", live.client_message(raw).alias("m"))
    return told.select("event_id", F.col("m").isNotNull().alias("valid"), "m.type", "m.language", "m.model", F.col("m.translateTo").alias("translate_to"))


@query("""WITH t AS (SELECT doc_id, lang, 'en, ' || lang || ' ,es,,' || lang || CASE WHEN doc_id % 3 = 0 THEN ',zh' ELSE '' END AS raw FROM documents),
p AS (SELECT *, list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM t),
e AS (SELECT *, list_filter(l, lambda x: x NOT IN ('es', 'en', 'zh')) AS bad FROM p)
SELECT doc_id, CASE WHEN len(bad) = 0 THEN array_to_string(list_filter(['en', 'es', 'zh'], lambda x: list_contains(l, x)), ',') END AS targets,
       CASE WHEN len(bad) = 0 THEN array_to_string(list_filter(['en', 'es', 'zh'], lambda x: list_contains(l, x) AND x <> lang), ',') END AS active,
       CASE WHEN len(bad) > 0 THEN 'Invalid translate "' || bad[1] || '". Expected one of: es, en, zh.' END AS error FROM e""")
def target_lists(spark, sf_dir):
    raw = F.concat(F.lit("en, "), "lang", F.lit(" ,es,,"), "lang", F.when(F.col("doc_id") % 3 == 0, ",zh").otherwise(""))
    told = table(spark, sf_dir, "documents").select("doc_id", "lang", jobs.target_list(raw).alias("t"))
    return told.select("doc_id", F.array_join("t.targets", ",").alias("targets"), F.array_join(jobs.active_targets("t.targets", "lang"), ",").alias("active"), F.col("t.error").alias("error"))


@query("""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s, arg_max(value, (ts, event_id)) FILTER (event_type <> 'error' AND value IS NOT NULL) AS p, arg_max(props, (ts, event_id)) FILTER (event_type = 'error') AS e FROM events GROUP BY user_id),
j AS (SELECT DISTINCT conv_id AS user_id FROM conversations)
SELECT j.user_id, coalesce(s, 'queued') AS status, coalesce(p, 0.0)::DOUBLE AS progress, e AS error FROM j LEFT JOIN l USING (user_id)""")
def job_patches(spark, sf_dir):
    records = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("user_id")).distinct().select("user_id", F.lit("queued").alias("status"), F.lit(0.0).alias("progress"))
    failed = F.col("event_type") == "error"
    patches = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status"), F.when(~failed, F.col("value")).alias("progress"), F.when(failed, F.col("props")).alias("error"))
    return jobs.upsert(records, patches, ["user_id"], ["ts", "event_id"])


@query("""WITH j AS (SELECT doc_id, unnest(['x' || doc_id % 700, 'y' || doc_id]) AS export_id, unnest([lang, source]) AS status FROM documents),
f AS (SELECT export_id, min(doc_id) AS doc_id, arg_min(status, doc_id) AS status FROM j GROUP BY export_id)
SELECT event_id, export_id, doc_id, status FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'y' END || event_id AS export_id FROM events) JOIN f USING (export_id)""")
def export_lookup(spark, sf_dir):
    made = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.concat(F.lit("x"), (F.col("doc_id") % 700).cast("string")), "lang", F.concat(F.lit("y"), F.col("doc_id").cast("string")), "source").alias("exports"))
    asked = table(spark, sf_dir, "events").select("event_id", F.concat(F.when(F.col("event_id") % 2 == 0, "x").otherwise("y"), F.col("event_id").cast("string")).alias("export_id"))
    return jobs.find_export(made, asked, "doc_id").select("event_id", "export_id", "doc_id", F.col("record").alias("status"))


@query("SELECT event_id, coalesce(ts < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 36 HOUR, false) AS removed FROM events")
def pruned_jobs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at"))
    kept, removed = jobs.prune(rows, F.lit("2024-01-15 12:00:00").cast("timestamp"), age="36 HOUR")
    return kept.select("event_id", F.lit(False).alias("removed")).unionAll(removed.select("event_id", F.lit(True).alias("removed")))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def transcript_tail(spark, sf_dir):
    return jobs.tail(turns(spark, sf_dir).select("conv_id", "turn", "role"), ["conv_id"], ["turn"], 3)


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 15 WHEN 3 THEN 85 WHEN 4 THEN 100 ELSE CAST(floor(25 + least(100, greatest(0, coalesce(value, 0)))::DOUBLE / 100 * 60 + 0.5) AS INTEGER) END AS percent FROM events""")
def job_progress(spark, sf_dir):
    stage = F.element_at(F.array(*map(F.lit, ["queued", "decoding", "analyzing", "formatting", "done", "loading-model", "transcribing"])), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", jobs.progress(stage, "value").alias("percent"))


_NAMED = """j AS (SELECT doc_id, lang, '/media/' || source || '/talk.' || doc_id AS stem, list_filter(['es', 'en', 'zh'][1:doc_id % 4], lambda x: x <> lang) AS t, CASE doc_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'vtt' ELSE 'srt' END AS form FROM documents)"""


def _named_jobs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), F.concat(F.lit("/media/"), "source", F.lit("/talk."), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"), F.slice(F.array(*map(F.lit, ["es", "en", "zh"])), F.lit(1), (F.col("doc_id") % 4).cast("int")).alias("asked"))
    return rows.withColumn("targets", jobs.active_targets("asked", "language")).withColumn("form", F.when(F.col("doc_id") % 5 == 0, "json").when(F.col("doc_id") % 5 == 1, "vtt").otherwise("srt"))


@query(f"""WITH {_NAMED}, b AS (SELECT *, FALSE AS batch FROM j UNION ALL SELECT *, TRUE FROM j)
SELECT doc_id, batch, stem || '.' || form AS file, lang AS file_language FROM b WHERE form = 'json' OR batch OR len(t) <> 1
UNION ALL SELECT doc_id, batch, stem || '.' || x || '.' || form, x FROM (SELECT *, unnest(t) AS x FROM b WHERE form <> 'json')""")
def output_files(spark, sf_dir):
    rows = _named_jobs(spark, sf_dir)
    made = [jobs.output_files(rows, "path", "targets", "form", batch=b).select("doc_id", F.lit(b).alias("batch"), "file", "file_language") for b in (False, True)]
    return made[0].unionAll(made[1])


@query(f"""WITH {_NAMED} SELECT doc_id, CASE form WHEN 'json' THEN 'application/json; charset=utf-8' WHEN 'vtt' THEN 'text/vtt; charset=utf-8' ELSE 'application/x-subrip; charset=utf-8' END AS content_type,
'talk.' || doc_id || CASE WHEN form = 'json' THEN '.study.json' WHEN doc_id % 2 = 0 THEN '.' || lang || '.' || form ELSE '.' || form END AS name FROM j""")
def download_names(spark, sf_dir):
    tag = F.when(F.col("doc_id") % 2 == 0, F.col("language"))
    return _named_jobs(spark, sf_dir).select("doc_id", jobs.download("path", "form", tag).alias("d")).select("doc_id", "d.*")


@query(r"""SELECT event_id, round(CASE WHEN value IS NULL THEN 7 ELSE least(20, greatest(3, value)) END, 6)::DOUBLE AS bounded, round(CASE WHEN value IS NULL THEN 0 ELSE least(1, greatest(0, (15 - value) / 15)) END, 6)::DOUBLE AS wet FROM events""")
def bounded_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(timing.bounded("value", 3, 20, 7), 6).alias("bounded"), F.round(timing.wet_mix("value"), 6).alias("wet"))


_CLOCKS = "t AS (SELECT event_id, event_id * 7919 + 250 AS ms FROM events), u AS (SELECT *, CAST(floor(ms / 1000 + 0.5) AS BIGINT) AS s FROM t)"


@query(f"""WITH {_CLOCKS} SELECT event_id,
CASE WHEN s >= 3600 THEN (s // 3600) || ':' ELSE '' END || printf('%02d:%02d', s // 60 % 60, s % 60) AS clock,
CASE WHEN ms >= 3600000 THEN (ms // 3600000) || ':' ELSE '' END || printf('%02d:%02d.%03d', ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS precise,
CASE WHEN ms >= 3600000 THEN (ms // 3600000) || ':' ELSE '' END || printf('%02d:%02d.%d', ms // 60000 % 60, ms // 1000 % 60, ms % 1000 // 100) AS spoken FROM u""")
def clocks(spark, sf_dir):
    ms = F.col("event_id") * 7919 + 250
    return table(spark, sf_dir, "events").select("event_id", timing.clock(ms).alias("clock"), timing.clock(ms, millis=True).alias("precise"), timing.clock_tenths(ms - ms % 100).alias("spoken"))


@query("""WITH b AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN -1 ELSE event_id * event_id * 37 END::DOUBLE AS n FROM events), p AS (SELECT event_id, n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END AS p FROM b),
q AS (SELECT *, n / pow(1024, p) AS v FROM p)
SELECT event_id, CASE WHEN n < 0 THEN '0 B' ELSE CASE WHEN p = 0 OR v >= 100 THEN printf('%.0f', round(v, 0)) WHEN v >= 10 THEN printf('%.1f', round(v, 1)) ELSE printf('%.2f', round(v, 2)) END || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][p + 1] END AS size FROM q""")
def byte_sizes(spark, sf_dir):
    from ..functions.text import bytes_text

    n = F.when(F.col("event_id") % 9 == 0, F.lit(-1)).otherwise(F.col("event_id") * F.col("event_id") * 37)
    return table(spark, sf_dir, "events").select("event_id", bytes_text(n).alias("size"))


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 3 AND value >= 0 AND value < 60 THEN CAST(floor(((event_id % 5) * 3600 + (event_id % 60) * 60 + value) * 1000 + 0.5) AS BIGINT) END AS ms FROM events""")
def progress_times(spark, sf_dir):
    """Lines without a time, and with seconds that none has, give none."""
    rows = table(spark, sf_dir, "events")
    line = F.when((F.col("event_id") % 4 == 3) | ~F.coalesce((F.col("value") >= 0) & (F.col("value") < 60), F.lit(False)), F.lit("frame=  10 fps=25")).otherwise(F.format_string("frame=1 time=%d:%02d:%05.2f bitrate=1", F.col("event_id") % 5, F.col("event_id") % 60, "value"))
    return rows.select("event_id", timing.ffmpeg_time(line).alias("ms"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 16 ELSE 42 END AS max_chars, 2 AS max_lines, CASE WHEN doc_id % 3 = 0 THEN 9.0 ELSE 17.0 END::DOUBLE AS max_cps FROM documents""")
def language_styles(spark, sf_dir):
    from ..functions.text import style_of

    lang = F.when(F.col("doc_id") % 3 == 0, F.element_at(F.array(F.lit(" ZH-tw"), F.lit("ja"), F.lit("ko-KR"), F.lit("cmn")), (F.col("doc_id") % 4 + 1).cast("int"))).otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", style_of(lang).alias("s")).select("doc_id", "s.max_chars", "s.max_lines", F.col("s.max_cps").cast("double").alias("max_cps"))


@query("""SELECT event_id, event_type AS text, greatest(0, floor(coalesce(value, 0) * 1000 + 0.5))::DOUBLE AS start_ms, greatest(0, floor(coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value + 1.5 END, 0) * 1000 + 0.5))::DOUBLE AS end_ms
FROM events WHERE event_id % 7 <> 0""")
def chunk_segments(spark, sf_dir):
    said = F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type"))
    chunks = table(spark, sf_dir, "events").select("event_id", said.alias("text"), F.col("value").alias("start_s"), F.when(F.col("event_id") % 5 != 0, F.col("value") + 1.5).alias("end_s"))
    return media.chunk_segments(chunks, ["event_id"])


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + CAST(floor(coalesce(value, 0) * 1000) AS BIGINT) AS e FROM events)
SELECT user_id, edge, count(*) AS n FROM (SELECT user_id, s AS edge FROM e UNION ALL SELECT user_id, e FROM e) GROUP BY ALL""")
def edge_union(spark, sf_dir):
    rows = intervals(spark, sf_dir)
    edges = sequence.union_all([rows.select("user_id", F.col(c).alias("edge")) for c in ("start_ms", "end_ms")])
    return edges.groupBy("user_id", "edge").agg(F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT page_id, replace(replace(CASE page_id % 3 WHEN 0 THEN 'C:' || chr(92) || 'a b' || chr(92) ELSE '' END || url, chr(92), '/'), ':', chr(92) || ':') AS p FROM pages)
SELECT page_id, CASE WHEN regexp_matches(p, '[ ''",;\[\]]') THEN chr(39) || replace(p, chr(39), chr(92) || chr(39)) || chr(39) ELSE p END AS shown FROM p""")
def filter_paths(spark, sf_dir):
    raw = F.concat(F.when(F.col("page_id") % 3 == 0, "C:\\a b\\").otherwise(""), "url")
    return table(spark, sf_dir, "pages").select("page_id", text.filter_path(raw).alias("shown"))


@query("""SELECT conv_id, turn, CASE WHEN length(trim(text)) = 0 THEN text ELSE replace(text, 'e', 'E') || '>' END AS said FROM conversations""")
def routed_translations(spark, sf_dir):
    """Turns from Spanish to Chinese through English, by models that change a letter and that mark, eight texts at a time."""
    models = {("es", "en"): lambda texts, a, b: [t.replace("e", "E") for t in texts], ("en", "zh"): lambda texts, a, b: [f"{t}>" for t in texts]}
    model = translate.in_batches(translate.by_route(models))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model([t or "" for t in texts], "es", "zh"))

    return turns(spark, sf_dir).select("conv_id", "turn", F.when(F.col("text").isNotNull(), run("text")).alias("said"))
