"""Registered queries over media of any length: cuts, recurrences, trailing percentiles and windows, each in many tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.streams import bound
from ..operators import cuts, scans, stitching
from ..sources.tables import table
from .registry import query

#: Rows of a chunk in these queries, so that the tables at hand have media of several chunks.
CHUNK = 1 << 10
#: Every other event belongs to one medium, the others to that of their user.
_MEDIA = """ev AS (SELECT CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS medium, event_id, ts, event_type, value FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY medium ORDER BY ts, event_id) - 1 AS k FROM ev)"""


def _media(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("medium", F.when(F.col("event_id") % 2 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id")))


@query(f"""WITH RECURSIVE {_MEDIA}, c AS (SELECT medium, event_id, k, CAST(floor(coalesce(value, 0)) AS BIGINT) AS n FROM e),
b AS (SELECT medium, event_id, k, 0 AS block, 1 AS count, n AS size FROM c WHERE k = 0
      UNION ALL SELECT c.medium, c.event_id, c.k, CASE WHEN b.count >= 6 OR b.size + c.n > 400 THEN b.block + 1 ELSE b.block END,
      CASE WHEN b.count >= 6 OR b.size + c.n > 400 THEN 1 ELSE b.count + 1 END, CASE WHEN b.count >= 6 OR b.size + c.n > 400 THEN c.n ELSE b.size + c.n END
      FROM b JOIN c ON c.medium = b.medium AND c.k = b.k + 1)
SELECT medium, event_id, block FROM b""")
def long_cue_blocks(spark, sf_dir):
    """Blocks of at most 6 events and 400 in all; half of all events are one medium."""
    sized = _media(spark, sf_dir).select("medium", "ts", "event_id", F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("n"))
    return cuts.cue_blocks(sized, ["medium"], ["ts", "event_id"], "n", chunk=CHUNK).select("medium", "event_id", "block")


@query(f"""WITH RECURSIVE {_MEDIA}, c AS (SELECT medium, event_id, k, CAST(floor(coalesce(value, 0)) AS BIGINT) % 12 + 1 AS n, event_type IN ('error', 'purchase') AS closes FROM e),
b AS (SELECT medium, event_id, k, 0 AS run, n AS size, closes AND n >= 84 / 4.0 AS done FROM c WHERE k = 0
      UNION ALL SELECT medium, event_id, k, CASE WHEN fresh THEN run + 1 ELSE run END, CASE WHEN fresh THEN n ELSE size + n + 1 END, closes AND CASE WHEN fresh THEN n ELSE size + n + 1 END >= 84 / 4.0
      FROM (SELECT c.*, b.run, b.size, b.done OR b.size + c.n + 1 > 84 AS fresh FROM b JOIN c ON c.medium = b.medium AND c.k = b.k + 1))
SELECT medium, event_id, run FROM b""")
def long_word_runs(spark, sf_dir):
    """Runs of words that fit in two lines of 42; events stand for words, some of which close a sentence."""
    n = F.floor(F.coalesce("value", F.lit(0.0))).cast("long") % 12 + 1
    told = _media(spark, sf_dir).select("medium", "ts", "event_id", n.alias("n"), F.coalesce(F.col("event_type").isin("error", "purchase"), F.lit(False)).alias("closes"))
    return cuts.word_runs(told, ["medium"], ["ts", "event_id"], "n", "closes", 84, chunk=CHUNK).select("medium", "event_id", "run")


@query(f"""WITH RECURSIVE {_MEDIA}, p AS (SELECT 2 * pi() * 300 / 8000 AS w), q AS (SELECT cos(w) AS c, sin(w) / sqrt(2) AS a FROM p), x AS (SELECT medium, event_id, k, coalesce(value, 0) AS v FROM e),
y AS (SELECT medium, event_id, k, v, 0.0::DOUBLE AS v1, (1 + c) / 2 / (1 + a) * v AS y, 0.0::DOUBLE AS y1, 0.02 * greatest(v - 1, 0) AS z, c, a FROM x, q WHERE k = 0
      UNION ALL SELECT x.medium, x.event_id, x.k, x.v, y.v, (1 + c) / 2 / (1 + a) * (x.v - 2 * y.v + y.v1) + 2 * c / (1 + a) * y.y - (1 - a) / (1 + a) * y.y1, y.y, 0.98 * y.z + 0.02 * greatest(x.v - 1, 0), c, a
      FROM y JOIN x ON x.medium = y.medium AND x.k = y.k + 1)
SELECT medium, event_id, round(y, 5) + 0.0 AS high, round(z, 5) + 0.0 AS prior FROM y""")
def long_recurrences(spark, sf_dir):
    """A high-pass filter and a decision-directed prior over the values of events in order."""
    told = _media(spark, sf_dir).select("medium", "ts", "event_id", "value", F.greatest(F.coalesce("value", F.lit(0.0)) - 1, F.lit(0.0)).alias("over"))
    m, v, b0 = scans.biquad_highpass(8000, 300)
    # one state for both: two of the filter, its output, and the prior
    wide = [[m[0, 0], m[0, 1], 0.0, 0.0], [m[1, 0], m[1, 1], 0.0, 0.0], [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.98]]
    fed = [[v[0, 0], 0.0], [v[1, 0], 0.0], [b0, 0.0], [0.0, 0.02]]
    out = scans.affine_scan(told, ["medium"], ["ts", "event_id"], ["value", "over"], wide, fed, ["s1", "s2", "high", "prior"], CHUNK)
    return out.select("medium", "event_id", (F.round("high", 5) + 0.0).alias("high"), (F.round("prior", 5) + 0.0).alias("prior"))


@query(f"""WITH {_MEDIA}, n AS (SELECT *, count(*) FILTER (value >= 5) OVER (PARTITION BY medium ORDER BY k) AS m FROM e),
l AS (SELECT medium, m, list_sort(list(value) OVER (PARTITION BY medium ORDER BY k ROWS 124 PRECEDING)) AS held FROM n WHERE value >= 5)
SELECT n.medium, n.event_id, held[CAST(floor(0.1::DOUBLE * (len(held) - 1)) AS BIGINT) + 1] AS low FROM n LEFT JOIN l USING (medium, m)""")
def trailing_floor(spark, sf_dir):
    """The 10th percentile of the last 125 values from 5 on, of each medium, at every event."""
    told = _media(spark, sf_dir).select("medium", "ts", "event_id", "value", (F.col("value") >= 5).alias("loud"))
    return scans.trailing_percentile(told, ["medium"], ["ts", "event_id"], "value", 0.1, 125, "low", "loud", CHUNK).select("medium", "event_id", "low")


@query(r"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, array_to_string(w, ' ') AS text
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0""")
def stitched_documents(spark, sf_dir):
    """Documents heard in windows of 30 words that overlap by 10, with noise where a window begins and ends, joined again."""

    def windows(w):
        def one(k):
            def word(t, i):
                noise = ((k > 0) & (i < 2)) | ((i >= 28) & (k * 20 + 30 < F.size(w)))
                at = (k * 20 + i) * 300.0
                return F.struct(F.when(noise, F.concat(F.lit("noise"), (k % 7).cast("string"))).otherwise(t).alias("text"), at.alias("start_ms"), (at + 300).alias("end_ms"))

            return F.struct(k.alias("window"), F.transform(F.slice(w, 20 * k + 1, F.lit(30)), word).alias("words"))

        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((F.size(w) - 30) / 20).cast("int"), F.lit(0))), one))

    # bound: else a text would be split again for each of its windows
    heard = table(spark, sf_dir, "documents").select("doc_id", F.explode(bound(text.spaced_tokens("text"), windows)).alias("x")).select("doc_id", "x.*")
    joined = stitching.stitched(heard, ["doc_id"], tolerance_ms=100.0)
    # of each window only its words as one text go to their document
    said = joined.select("doc_id", F.struct("window", F.array_join(F.transform("words", lambda x: x["text"]), " ").alias("t")).alias("x"), F.size("words").alias("n")).where("n > 0")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), " ")
    return said.groupBy("doc_id").agg(F.sum("n").alias("n_words"), whole.alias("text"))
