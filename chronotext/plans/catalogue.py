"""The registered queries over the shared tables, with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import streams, text, timing
from ..operators import hypotheses, packing, phonetics, quality, sequence, signal, stats, translate
from ..sources import sinks
from ..sources.tables import intervals, segments, table, turns
from ..streaming import live
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

_LINES = r"""
lines AS (SELECT doc_id, lang, line, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text
          FROM (SELECT doc_id, lang, unnest(range(len(l))) AS line, unnest(l) AS raw FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents))),
seg AS (SELECT doc_id, lang, CAST(row_number() OVER w AS INTEGER) AS seg_no, text,
               sum(greatest(300.0::DOUBLE, length(text) * 60.0::DOUBLE)) OVER w - greatest(300.0::DOUBLE, length(text) * 60.0::DOUBLE) AS start_ms,
               sum(greatest(300.0::DOUBLE, length(text) * 60.0::DOUBLE)) OVER w AS end_ms
        FROM lines WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING))
"""
_WORDS = f"""{_LINES},
tok AS (SELECT doc_id, seg_no, start_ms AS s, end_ms AS e, CAST(unnest(range(len(t))) AS INTEGER) AS pos, unnest(t) AS text
        FROM (SELECT doc_id, seg_no, start_ms, end_ms, list_filter(string_split(text, ' '), lambda x: x <> '') AS t FROM seg)),
wt AS (SELECT *, greatest(1, length_grapheme(text)) AS w FROM tok),
cum AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, seg_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY doc_id, seg_no) AS a,
               max(pos) OVER (PARTITION BY doc_id, seg_no) AS m FROM wt),
bnd AS (SELECT *, CASE WHEN pos = m THEN e ELSE s + floor((e - s) * c / a + 0.5) END AS b FROM cum),
words AS (SELECT doc_id, seg_no, pos, text, CAST(coalesce(lag(b) OVER (PARTITION BY doc_id, seg_no ORDER BY pos), s) AS DOUBLE) AS start_ms, CAST(b AS DOUBLE) AS end_ms FROM bnd)
"""
_EVENTS = "ev AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(floor(coalesce(value, 0) * 1000) AS BIGINT) AS end_ms FROM events)"
_DAY = 86_400_000


@query(f"WITH {_LINES} SELECT doc_id, lang, seg_no, text, start_ms, end_ms FROM seg")
def split_segments(spark, sf_dir):
    return segments(spark, sf_dir)


_SENTENCES = rf"""d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
g AS (SELECT doc_id, regexp_replace(t, '(^|[^A-Za-z\x{{00C0}}-\x{{024F}}])({"|".join(text.ABBREVIATIONS)})\.', '\1\2' || chr(2), 'gi') AS t FROM d),
c AS (SELECT doc_id, string_split(regexp_replace(t, '([。！？；]["''\)\]\}}”’」』）】》]*|[.!?;…]["''\)\]\}}”’」』）】》]*( |$))', '\1' || chr(1), 'g'), chr(1)) AS l FROM g),
s AS (SELECT doc_id, unnest(list_filter(list_transform(l, lambda x: trim(replace(x, chr(2), '.'))), lambda x: x <> '')) AS sentence, unnest(range(len(list_filter(list_transform(l, lambda x: trim(x)), lambda x: x <> '')))) AS pos FROM c)"""


@query(f"WITH {_SENTENCES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence FROM s")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences("text")).alias("pos", "sentence"))


@query(r"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, '|') AS tokens
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents)""")
def tokenize_words(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", text.tokens("text", "lang").alias("t"))
    return found.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", "|").alias("tokens"))


@query(rf"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(?:{"|".join(text.SPANISH)})\b')) AS es, len(regexp_extract_all(text, '(?i)\b(?:{"|".join(text.ENGLISH)})\b')) AS en FROM documents)
SELECT doc_id, CASE WHEN es > en THEN 'es' WHEN en > es THEN 'en' ELSE 'unknown' END AS language FROM c""")
def detect_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.spoken_language("text").alias("language"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]') THEN 'cjk' ELSE 'latin' END AS script FROM documents")
def detect_script(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.script("text").alias("script"))


@query(r"SELECT doc_id, CAST(length_grapheme(regexp_replace(text, '\s+', '', 'g')) AS INTEGER) AS visible, CAST(length(text) AS INTEGER) AS total FROM documents")
def visible_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.visible_length("text").alias("visible"), text.total_length("text").alias("total"))


@query(r"""SELECT page_id, tag, CASE WHEN tag = 'es' THEN 'es' WHEN tag = 'en' THEN 'en' WHEN tag = 'zh' THEN 'zh' ELSE 'unknown' END AS language
FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS tag FROM pages)""")
def normalize_language_tag(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("tag"))
    return tags.withColumn("language", text.language_tag("tag"))


@query(rf"""WITH {_LINES}, t AS (SELECT doc_id, seg_no, CAST(floor(start_ms) AS BIGINT) AS s FROM seg)
SELECT doc_id, seg_no, printf('%02d:%02d:%02d,%03d', s // 3600000, s // 60000 % 60, s // 1000 % 60, s % 1000) AS srt,
       printf('%02d:%02d:%02d.%03d', s // 3600000, s // 60000 % 60, s // 1000 % 60, s % 1000) AS vtt,
       printf('%d:%02d:%02d.%02d', s // 3600000, s // 60000 % 60, s // 1000 % 60, s % 1000 // 10) AS ass FROM t""")
def format_timestamps(spark, sf_dir):
    return segments(spark, sf_dir).select("doc_id", "seg_no", timing.srt_time("start_ms").alias("srt"), timing.vtt_time("start_ms").alias("vtt"), timing.ass_time("start_ms").alias("ass"))


@query(f"WITH {_LINES} SELECT doc_id, seg_no, CAST(floor(start_ms) AS BIGINT) AS from_srt, CAST(floor(end_ms) AS BIGINT) AS from_vtt FROM seg")
def parse_timestamps(spark, sf_dir):
    return segments(spark, sf_dir).select("doc_id", "seg_no", timing.parse_time(timing.srt_time("start_ms")).alias("from_srt"), timing.parse_time(timing.vtt_time("end_ms")).alias("from_vtt"))


def _words(spark, sf_dir):
    return sequence.distribute_words(segments(spark, sf_dir), ["doc_id", "seg_no"], lang=F.lit("en"))


@query(f"WITH {_WORDS} SELECT doc_id, seg_no, pos, text, start_ms, end_ms FROM words")
def distribute_words(spark, sf_dir):
    return _words(spark, sf_dir)


@query(f"WITH {_WORDS} SELECT doc_id, seg_no, pos, text, start_ms, end_ms FROM words WHERE end_ms - start_ms >= 250")
def drop_micro_words(spark, sf_dir):
    return sequence.drop_micro_words(_words(spark, sf_dir), 250)


@query(f"""WITH {_EVENTS}, g AS (SELECT *, lag(end_ms) OVER w AS before FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, event_id)),
n AS (SELECT *, sum(CASE WHEN start_ms - before > {_DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM g)
SELECT user_id, CAST(segment AS BIGINT) AS segment, string_agg(event_type, ' ' ORDER BY start_ms, event_id) AS text, arg_min(start_ms, (start_ms, event_id)) AS start_ms, arg_max(end_ms, (start_ms, event_id)) AS end_ms
FROM n GROUP BY user_id, segment""")
def group_words_islands(spark, sf_dir):
    words = intervals(spark, sf_dir).withColumnRenamed("event_type", "text")
    return sequence.group_words(words, ["user_id"], ["start_ms", "event_id"], gap_ms=_DAY).drop("words")


@query(f"""WITH {_EVENTS}, g AS (SELECT *, max(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev),
n AS (SELECT *, sum(CASE WHEN start_ms - before > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_merged FROM n GROUP BY user_id, k""")
def merge_intervals(spark, sf_dir):
    return sequence.merge_intervals(intervals(spark, sf_dir), ["user_id"], max_gap=3_600_000)


@query(f"""WITH {_EVENTS}, g AS (SELECT user_id, start_ms, lag(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, end_ms) AS before FROM ev)
SELECT user_id, before AS start_ms, start_ms AS end_ms FROM g WHERE start_ms - before >= {_DAY}""")
def silence_gaps(spark, sf_dir):
    return sequence.silence_gaps(intervals(spark, sf_dir), ["user_id"], least_ms=_DAY)


@query("""WITH e AS (SELECT event_id, user_id, value, lag(value, 1) OVER w AS a1, lag(value, 2) OVER w AS a2, lead(value, 1) OVER w AS b1, lead(value, 2) OVER w AS b2,
 first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, list_sort([coalesce(a2, f), coalesce(a1, f), value, coalesce(b1, l), coalesce(b2, l)])[3] AS smooth FROM e""")
def median_smooth(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return sequence.median_filter(rows, ["user_id"], ["ts", "event_id"], "value", "smooth").select("event_id", "user_id", "smooth")


@query(f"""WITH {_EVENTS}, m AS (SELECT user_id, event_id, max(start_ms) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS start_ms, end_ms FROM ev)
SELECT user_id, event_id, start_ms, greatest(end_ms, start_ms) AS end_ms FROM m""")
def monotonic_repair(spark, sf_dir):
    rows = intervals(spark, sf_dir).select("user_id", "event_id", "start_ms", "end_ms")
    return sequence.monotonic(rows, ["user_id"], ["event_id"])


@query(f"""WITH {_EVENTS}, n AS (SELECT *, lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) - 1000 AS most FROM ev),
k AS (SELECT user_id, event_id, start_ms, least(end_ms, coalesce(most, end_ms)) AS end_ms FROM n)
SELECT user_id, event_id, start_ms, end_ms, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS INTEGER) AS index FROM k WHERE end_ms > start_ms""")
def fix_overlaps(spark, sf_dir):
    rows = intervals(spark, sf_dir).select("user_id", "event_id", "start_ms", "end_ms")
    return sequence.reindex(sequence.fix_overlaps(rows, ["user_id"], ["start_ms", "event_id"], 1000), ["user_id"], ["start_ms", "event_id"])


@query(f"""WITH {_EVENTS}, p AS (SELECT * FROM ev WHERE event_type = 'click'), q AS (SELECT DISTINCT user_id, start_ms AS edge FROM ev WHERE event_type = 'view')
SELECT p.user_id, p.event_id, p.start_ms, arg_min(q.edge, (abs(q.edge - p.start_ms), q.edge)) AS nearest
FROM p LEFT JOIN q ON q.user_id = p.user_id AND q.edge BETWEEN p.start_ms - 3600000 AND p.start_ms + 3600000 GROUP BY ALL""")
def snap_nearest_edge(spark, sf_dir):
    rows = intervals(spark, sf_dir)
    points = rows.where("event_type = 'click'").select("user_id", "event_id", "start_ms")
    edges = rows.where("event_type = 'view'").select("user_id", F.col("start_ms").alias("edge"))
    return sequence.nearest_edge(points, edges, ["user_id"], "start_ms", "edge", 3_600_000)


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
SELECT user_id, value AS percentile FROM r WHERE r = floor(0.1::DOUBLE * (n - 1)) + 1""")
def percentile_floor(spark, sf_dir):
    return sequence.percentile_floor(table(spark, sf_dir, "events").select("user_id", "value"), ["user_id"], "value", 0.1)


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, role, length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
b AS (SELECT conv_id, turn, role, n, k, 0 AS block, 1 AS count, n AS size FROM c WHERE k = 1
      UNION ALL SELECT c.conv_id, c.turn, c.role, c.n, c.k, CASE WHEN b.count >= 6 OR b.size + c.n > 400 THEN b.block + 1 ELSE b.block END,
      CASE WHEN b.count >= 6 OR b.size + c.n > 400 THEN 1 ELSE b.count + 1 END, CASE WHEN b.count >= 6 OR b.size + c.n > 400 THEN c.n ELSE b.size + c.n END
      FROM b JOIN c ON c.conv_id = b.conv_id AND c.k = b.k + 1)
SELECT conv_id, turn, role, block FROM b""")
def cue_blocks(spark, sf_dir):
    return packing.cue_blocks(turns(spark, sf_dir), ["conv_id"], "turn", "text").select("conv_id", "turn", "role", "block")


def _cues(spark, sf_dir, merge=True):
    return packing.segment_cues(segments(spark, sf_dir).withColumn("lang", F.lit("en")), ["doc_id"], "seg_no", "lang", merge=merge)


@query()
def build_cues(spark, sf_dir):
    return _cues(spark, sf_dir).select("doc_id", "index", "start_ms", "end_ms", "n_words", F.array_join("lines", "\n").alias("text"))


@query()
def cue_stats(spark, sf_dir):
    return stats.cue_stats(_cues(spark, sf_dir), ["doc_id"], table(spark, sf_dir, "documents").select("doc_id"), digits=6)


def _line_cues(spark, sf_dir):
    """Segments as cues of one line, mended and numbered."""
    cues = segments(spark, sf_dir).select("doc_id", "seg_no", "start_ms", "end_ms", F.array("text").alias("lines"))
    return sequence.reindex(sequence.fix_overlaps(cues, ["doc_id"], ["seg_no"], 80), ["doc_id"], ["seg_no"])


_LINE_CUES = f"""{_LINES}, nx AS (SELECT *, lead(start_ms) OVER (PARTITION BY doc_id ORDER BY seg_no) - 80 AS most FROM seg),
cue AS (SELECT doc_id, text, CAST(floor(start_ms) AS BIGINT) AS s, CAST(floor(least(end_ms, coalesce(most, end_ms))) AS BIGINT) AS e, least(end_ms, coalesce(most, end_ms)) - start_ms AS d, start_ms,
        row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) AS i FROM nx WHERE least(end_ms, coalesce(most, end_ms)) > start_ms)"""
_T = "printf('%02d:%02d:%02d{m}%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"


@query(f"""WITH {_LINE_CUES}, c AS (SELECT doc_id, length_grapheme(replace(text, ' ', '')) / (d / 1000) AS cps, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w, start_ms + d AS e2 FROM cue)
SELECT doc_id, count(*) AS cue_count, CAST(sum(w) AS BIGINT) AS word_count, round(avg(cps), 6) AS avg_cps, round(max(cps), 6) AS max_cps, max(e2) AS duration_ms FROM c GROUP BY doc_id""")
def line_cue_stats(spark, sf_dir):
    return stats.cue_stats(_line_cues(spark, sf_dir), ["doc_id"], digits=6)


@query(f"""WITH {_LINE_CUES} SELECT doc_id, string_agg(i || chr(10) || {_T.format(m=",", x="s")} || ' --> ' || {_T.format(m=",", x="e")} || chr(10) || text, chr(10) || chr(10) ORDER BY i) || chr(10) AS srt FROM cue GROUP BY doc_id""")
def srt_document(spark, sf_dir):
    return sinks.srt(_line_cues(spark, sf_dir), ["doc_id"])


@query(f"""WITH {_LINE_CUES} SELECT doc_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_T.format(m=".", x="s")} || ' --> ' || {_T.format(m=".", x="e")} || chr(10) || text, chr(10) || chr(10) ORDER BY i) || chr(10) AS vtt FROM cue GROUP BY doc_id""")
def vtt_document(spark, sf_dir):
    return sinks.vtt(_line_cues(spark, sf_dir), ["doc_id"])


_ASS = "printf('%d:%02d:%02d.%02d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000 // 10)"


@query(f"""WITH {_LINE_CUES} SELECT doc_id, array_to_string(['[Script Info]', 'ScriptType: v4.00+', 'PlayResX: 1920', 'PlayResY: 1080', 'WrapStyle: 0', 'ScaledBorderAndShadow: yes', '', '[V4+ Styles]', '{sinks.STYLE_FIELDS}',
'Style: Default,Arial,48,&H00FFFFFF,&H00FFFFFF,&H00000000,&H66000000,-1,0,0,0,100,100,0,0,1,2,1,2,20,20,60,1', '', '[Events]', '{sinks.EVENT_FIELDS}'], chr(10)) || chr(10) ||
string_agg('Dialogue: 0,' || {_ASS.format(x="s")} || ',' || {_ASS.format(x="e")} || ',Default,,0,0,0,,' || translate(text, '{{}}', '()'), chr(10) ORDER BY i) || chr(10) AS ass FROM cue GROUP BY doc_id""")
def ass_document(spark, sf_dir):
    return sinks.ass(_line_cues(spark, sf_dir), ["doc_id"])


@query(f"WITH {_LINE_CUES} SELECT doc_id, string_agg(text, ' ' ORDER BY i) FILTER (text NOT LIKE '%-->%' AND text <> 'WEBVTT' AND NOT regexp_matches(text, '^[0-9]+$')) AS plain FROM cue GROUP BY doc_id")
def subtitles_plain_text(spark, sf_dir):
    return sinks.srt(_line_cues(spark, sf_dir), ["doc_id"]).select("doc_id", text.plain_text("srt").alias("plain"))


_NOISE = r"""m AS (SELECT doc_id, seg_no, text, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM seg),
k AS (SELECT *, list_filter(string_split(t, ' '), lambda x: x <> '') AS w, length(regexp_replace(text, '[\s\p{P}\p{S}]+', '', 'g')) AS clean FROM m)"""


@query(f"WITH {_LINES}, {_NOISE} SELECT doc_id, seg_no, len(w) >= 4 AND len(list_distinct(w)) <= greatest(1, len(w) // 3) AS low_diversity, clean = 1 AS one_char FROM k")
def hallucination_rules(spark, sf_dir):
    clean = F.char_length(text.compact("text"))
    return segments(spark, sf_dir).select("doc_id", "seg_no", quality.low_diversity("text").alias("low_diversity"), (clean == quality.NOISE_CHARS).alias("one_char"))


@query(f"""WITH {_LINES}, {_NOISE}, f AS (SELECT doc_id, max(CASE WHEN len(w) >= 4 AND len(list_distinct(w)) <= greatest(1, len(w) // 3) THEN 1 ELSE 0 END) AS flagged FROM k GROUP BY doc_id)
SELECT l.quality, f.flagged, count(*) AS n FROM f JOIN labels l USING (doc_id) GROUP BY ALL""")
def quality_confusion(spark, sf_dir):
    flags = segments(spark, sf_dir).groupBy("doc_id").agg(F.max(quality.low_diversity("text").cast("int")).alias("flagged"))
    return flags.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "flagged").agg(F.count("*").alias("n"))


@query(r"""WITH b AS (SELECT w AS word, CAST(min(item_id) AS VARCHAR) AS reading FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM benchmark) GROUP BY w),
d AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents) GROUP BY w)
SELECT d.word, n, coalesce(reading, d.word) AS reading FROM d LEFT JOIN b USING (word)""")
def lexicon_lookup(spark, sf_dir):
    split = lambda df, *keep: df.select(*keep, F.explode(text.spaced_tokens(F.lower("text"))).alias("word"))
    words = split(table(spark, sf_dir, "documents")).groupBy("word").agg(F.count("*").alias("n"))
    entries = split(table(spark, sf_dir, "benchmark"), F.col("item_id")).groupBy("word").agg(F.min("item_id").cast("string").alias("reading"))
    return sequence.lexicon(words, entries).select("word", "n", "reading")


@query("""SELECT a.conv_id, a.turn, a.role, coalesce(b.role, a.role) AS answered_by FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def positional_zip(spark, sf_dir):
    rows = turns(spark, sf_dir).select("conv_id", "turn", "role")
    answers = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("answered_by"))
    return sequence.zip_by_place(rows, answers, ["conv_id"], "turn", answered_by=F.col("role"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, CAST(ceil(len(w) / 5.0) AS BIGINT) + 1)) AS k FROM t WHERE len(w) > 0),
p AS (SELECT doc_id, k, greatest(5 * (k - 2), 0) AS skip, least(5 * k, n) - greatest(5 * (k - 2), 0) AS m, least(5 * (k - 1), n) - greatest(5 * (k - 2), 0) AS mp, w[greatest(5 * (k - 2), 0) + 1:least(5 * k, n)] AS part FROM k),
h AS (SELECT doc_id, k, skip, CASE WHEN k % 2 = 0 THEN list_concat(part[1:m - 1], ['xx' || k]) ELSE part END AS w, CASE WHEN k = 1 THEN [] WHEN k % 2 = 1 THEN list_concat(part[1:mp - 1], ['xx' || (k - 1)]) ELSE part[1:mp] END AS p FROM p),
q AS (SELECT *, list_transform(w, lambda x: regexp_replace(lower(x), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')) AS a, list_transform(p, lambda x: regexp_replace(lower(x), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')) AS b FROM h),
c AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS c FROM q)
SELECT doc_id, CAST(k AS INTEGER) AS k, CAST(skip AS INTEGER) AS n_before, array_to_string(w[1:c], ' ') AS committed FROM c""")
def stable_prefix_whole(spark, sf_dir):
    """What h_(k-1) and h_k share for every k of a whole text, h_k being its first 5 k words, the last one altered when k is even.

    Both begin with the same `n_before` words, so `committed` is what follows them."""

    def each(w):
        for k in range(1, -(-len(w) // 5) + 1):
            skip = max(5 * (k - 2), 0)
            before, said = w[skip : 5 * (k - 1)], w[skip : 5 * k]
            if k % 2 == 0:
                said[-1] = f"xx{k}"
            elif k > 1:
                before[-1] = f"xx{k - 1}"
            yield k, skip, " ".join(said[: hypotheses.shared(before, said)])

    return hypotheses.by_text(table(spark, sf_dir, "documents"), ["doc_id"], each, {"k": "int", "n_before": "int", "committed": "string"})


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, CAST(greatest(ceil((len(w) - 10) / 7.0), 0) AS BIGINT) + 2)) AS i FROM t WHERE len(w) > 0),
h AS (SELECT doc_id, i, CASE WHEN i = 1 THEN [] ELSE w[7 * i - 13:7 * i - 4] END AS a, w[7 * i - 6:7 * i + 3] AS b FROM i),
m AS (SELECT *, list_transform(a, lambda x: regexp_replace(lower(x), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')) AS x, list_transform(b, lambda x: regexp_replace(lower(x), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')) AS y FROM h),
k AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(x), len(y)) + 1), lambda n: x[len(x) - n + 1:len(x)] = y[1:n])), 0) AS k FROM m)
SELECT doc_id, CAST(i AS INTEGER) AS "window", array_to_string(b[k + 1:], ' ') AS rest FROM k""")
def strip_overlap_whole(spark, sf_dir):
    """Windows of 10 words at step 7 over whole texts, each without what the one before ends with; the first is whole."""

    def each(w):
        keys = [live.token_key(t) for t in w]
        for at in range(0, max(len(w) - 3, 1) if w else 0, 7):
            again = hypotheses.repeated(keys[at - 7 : at + 3] if at else [], keys[at : at + 10])
            yield at // 7 + 1, " ".join(w[at + again : at + 10])

    return hypotheses.by_text(table(spark, sf_dir, "documents"), ["doc_id"], each, {"window": "int", "rest": "string"})


@query(ORACLES["stable_prefix_whole"])
def stable_prefix(spark, sf_dir):
    """Another name of stable_prefix_whole."""
    return stable_prefix_whole(spark, sf_dir)


@query(ORACLES["strip_overlap_whole"])
def strip_overlap(spark, sf_dir):
    """Another name of strip_overlap_whole."""
    return strip_overlap_whole(spark, sf_dir)


@query("""WITH d AS (SELECT doc_id, n_chars >= 200 AS ok, CASE WHEN n_chars < 200 THEN 'too short' END AS error FROM documents)
SELECT count(*) AS total, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, count(DISTINCT error) AS kinds FROM d""")
def batch_summary(spark, sf_dir):
    results = table(spark, sf_dir, "documents").select((F.col("n_chars") >= 200).alias("ok"), F.lit("too short").alias("error"))
    return stats.batch_summary(results).select("total", "succeeded", "failed", F.size("errors").cast("long").alias("kinds"))


@query()
def spanish_ipa(spark, sf_dir):
    """Spanish texts in IPA; those of other languages stay as they are."""
    said = phonetics.ipa("text", F.when(F.col("lang").startswith("es"), F.col("lang")).otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", said.alias("ipa"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 5) AS rms, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 5) AS peak,
CAST(list_sum(list_transform(range(1, len(embedding)), lambda i: CASE WHEN (embedding[i] >= 0) <> (embedding[i + 1] >= 0) THEN 1 ELSE 0 END)) AS INTEGER) AS crossings FROM embeddings""")
def signal_rms_peak_zcr(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(signal.rms("embedding"), 5).alias("rms"), F.round(signal.peak("embedding"), 5).alias("peak"), signal.crossings("embedding").alias("crossings"))


@query("""WITH g AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) AS r, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS p FROM embeddings),
f AS (SELECT *, least(pow(10, -1.0) / r, pow(10, -1.0 / 20) / p) AS k FROM g)
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: pow((x * k)::FLOAT::DOUBLE, 2))) / len(embedding)), 4) AS rms, round(list_max(list_transform(embedding, lambda x: abs((x * k)::FLOAT::DOUBLE))), 4) AS peak FROM f""")
def loudness_normalize(spark, sf_dir):
    loud = table(spark, sf_dir, "embeddings").select("vec_id", signal.normalize_loudness("embedding").alias("x"))
    return loud.select("vec_id", F.round(signal.rms("x"), 4).alias("rms"), F.round(signal.peak("x"), 4).alias("peak"))


@query("""WITH p AS (SELECT a.label, a.vec_id, unnest(a.embedding)::DOUBLE AS l, unnest(b.embedding)::DOUBLE AS r FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(corr(l, r), 5) AS correlation FROM p GROUP BY vec_id""")
def channel_correlation(spark, sf_dir):
    one = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("l"))
    two = one.select((F.col("vec_id") - 1).alias("vec_id"), F.col("l").alias("r"))
    pairs = one.join(two, "vec_id").select("vec_id", F.explode(F.arrays_zip("l", "r")).alias("x")).select("vec_id", F.col("x.l").cast("double").alias("l"), F.col("x.r").cast("double").alias("r"))
    return signal.correlation(pairs, ["vec_id"], "l", "r").withColumn("correlation", F.round("correlation", 5))


@query()
def translate_blocks(spark, sf_dir):
    return translate.translate_cues(turns(spark, sf_dir), ["conv_id"], "turn", "text", "en", "es")


@query("""WITH d AS (SELECT doc_id, lang AS source, CASE doc_id % 4 WHEN 0 THEN 'es' WHEN 1 THEN 'en' WHEN 2 THEN 'zh' ELSE source END AS target FROM documents)
SELECT doc_id, source, target, CASE WHEN source NOT IN ('es', 'en', 'zh') OR target NOT IN ('es', 'en', 'zh') THEN NULL WHEN source = target THEN '' WHEN source = 'en' OR target = 'en' THEN source || '>' || target ELSE source || '>en>' || target END AS route FROM d""")
def translation_routes(spark, sf_dir):
    """The way from each document's language to a target, which for every fourth one is none that is known."""
    k = F.col("doc_id") % 4
    target = F.when(k == 0, "es").when(k == 1, "en").when(k == 2, "zh").otherwise(F.col("source"))
    pairs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("source"), target.alias("target"))
    return translate.routes(pairs).withColumn("route", F.array_join("route", ">"))


@query(f"""WITH RECURSIVE {_EVENTS}, g AS (SELECT *, max(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS k FROM ev),
s AS (SELECT user_id, k, start_ms AS s, end_ms AS e, 1 AS n, 0 AS no FROM g WHERE k = 1
      UNION ALL SELECT g.user_id, g.k, CASE WHEN c THEN g.start_ms ELSE s.s END, CASE WHEN c THEN g.end_ms ELSE greatest(s.e, g.end_ms) END, CASE WHEN c THEN 1 ELSE s.n + 1 END, CASE WHEN c THEN s.no + 1 ELSE s.no END
      FROM s, LATERAL (SELECT g.*, g.start_ms - g.before >= 3600000 OR g.end_ms - s.s >= 14400000 AS c FROM g WHERE g.user_id = s.user_id AND g.k = s.k + 1) g)
SELECT user_id, CAST(s AS DOUBLE) AS start_ms, CAST(max(e) AS DOUBLE) AS end_ms, CAST(max(n) AS INTEGER) AS n_rows FROM s GROUP BY user_id, no, s""")
def live_sessions(spark, sf_dir):
    return live.sessions_by_gap(intervals(spark, sf_dir), ["user_id"], ["start_ms", "event_id"], 3_600_000, 14_400_000)


@query(rf"""WITH {_SENTENCES}, f AS (SELECT doc_id, pos, string_split(sentence, ' ') AS w, string_split(lag(sentence) OVER (PARTITION BY doc_id ORDER BY pos), ' ') AS p FROM s WHERE pos % 2 = 0),
k AS (SELECT *, list_transform(p, lambda x: regexp_replace(lower(x), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) AS x, list_transform(w, lambda x: regexp_replace(lower(x), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) AS y FROM f),
o AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(x), len(y)) + 1), lambda n: x[len(x) - n + 1:] = y[1:n])), 0) AS n FROM k),
t AS (SELECT doc_id, pos, array_to_string(w[n + 1:], ' ') AS text, CASE WHEN pos = 0 THEN 100 ELSE pos * 1500 - 1400 END::DOUBLE AS start_ms, ((pos + 1) * 1500 - 700)::DOUBLE AS end_ms FROM o)
SELECT CAST(doc_id AS VARCHAR) AS session_id, CAST(pos AS BIGINT) AS seq, 'final' AS type, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS cue_id, text, start_ms, end_ms FROM t WHERE text <> ''""")
def live_events(spark, sf_dir):
    """Sentences of documents as the updates of live sessions; every other one ends in a silence, which makes it a final."""
    said = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences("text")).alias("pos", "hypothesis"))
    now = (F.col("pos") + 1) * 1500.0
    updates = said.select(F.col("doc_id").cast("string").alias("session_id"), F.col("pos").cast("long").alias("seq"), F.lit("audio").alias("kind"), now.alias("consumed_ms"), (now - 1400).alias("speech_start_ms"), (now - F.when(F.col("pos") % 2 == 0, 700).otherwise(100)).alias("speech_end_ms"), "hypothesis")
    return live.batch(updates)
