"""Registered queries that run as streams: tables land in a folder, are read as they come, and what comes out is a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..operators.job_store import JobStore
from ..operators.sequence import distribute_words
from ..sources.tables import segments, table, work_folder
from ..streaming import audio, ordered, progress
from .catalogue import _WORDS
from .registry import query

#: Samples of a frame made of an embedding, and their rate: a frame of 100 ms.
FRAME_SAMPLES, FRAME_RATE = 64, 640


def _landed(parts: list[DataFrame], folder: str, files: int) -> DataFrame:
    """A stream over tables that land one after the other, each in so many files, the rows of each in any order."""
    spark = parts[0].sparkSession
    for part in parts:
        part.repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(folder)


def _ran(stream: DataFrame, folder: str, partitions: int = 4) -> DataFrame:
    return ordered.run_available(stream, f"{folder}/out", f"{folder}/state", partitions)


@query("""SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('milliseconds', ts), event_id) AS place, CAST(NULL AS BIGINT) AS n_late
FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL""")
def ordered_events(spark, sf_dir):
    """Events that land in three parts, each shuffled, put in order behind a watermark. A last row, of no user, moves the watermark on."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    folder = work_folder(spark, "events")
    ends = events.agg(F.min(F.unix_millis("ts")).alias("a"), F.max(F.unix_millis("ts")).alias("b"), F.count("*").alias("n")).first()
    a, b = ends["a"] or 0, ends["b"] or 0
    partitions = max(4, min(int(spark.conf.get("spark.sql.shuffle.partitions")), ends["n"] // 400_000))
    third, at = (b - a) // 3 + 1, F.unix_millis("ts")
    last = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit(0).cast("long").alias("event_id"), F.timestamp_millis(F.lit(b + 10 * third)).alias("ts"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"))
    stream = _landed([*(events.where((at >= a + i * third) & (at < a + (i + 1) * third)) for i in range(3)), last], f"{folder}/in", 4)
    told = ordered.in_order(stream, ["user_id"], "ts", "event_id", f"{third + third // 2} milliseconds")
    return _ran(told.where("user_id >= 0").drop("ts"), folder, partitions)


def _loud(samples, rate):
    """Frames whose first sample is above 0 count as speech, from the first to the last of them."""
    import numpy as np

    found = np.flatnonzero(samples.reshape(-1, 64)[:, 0] > 0)
    return [(float(found[0] * 100), float(found[-1] * 100 + 100))] if len(found) else []


def _counted(samples, rate):
    frames = samples.reshape(-1, 64)
    return f"speech {int((frames[:, 0] > 0).sum())}/{len(frames)}"


def _frames(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("label IS NOT NULL AND vec_id IS NOT NULL AND size(embedding) = 64")
    return rows.select(F.col("label").cast("string").alias("session_id"), F.col("vec_id").alias("seq"), F.timestamp_millis(F.col("vec_id") * 10).alias("ts"), F.lit("audio").alias("kind"), F.col("embedding").cast("array<float>").alias("samples"))


_AUDIO_SQL = """
WITH RECURSIVE x AS (
  SELECT CAST(label AS VARCHAR) AS session_id, vec_id AS seq, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS x
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) = 64
), s AS (
  SELECT DISTINCT session_id, CAST(NULL AS BIGINT) AS seq, CAST(-1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS a, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS l, CAST(0 AS BIGINT) AS c, 0 AS p, CAST(NULL AS BIGINT) AS start, CAST(0 AS BIGINT) AS floor,
         CAST(0 AS BIGINT) AS updated, false AS hyp, false AS said, '' AS last, CAST(0 AS BIGINT) AS cue, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS BIGINT) AS start_ms, CAST(NULL AS BIGINT) AS end_ms FROM x
  UNION ALL
  SELECT session_id, seq, k, CASE WHEN final OR quiet THEN k - 1 ELSE a END,
         CASE WHEN final OR quiet THEN CASE WHEN p = 1 THEN k - 1 WHEN x = 1 THEN k END ELSE f END, CASE WHEN final OR quiet THEN CASE WHEN x = 1 THEN k WHEN p = 1 THEN k - 1 END ELSE l END,
         CASE WHEN final OR quiet THEN p + x ELSE c END, x, CASE WHEN NOT final THEN start END, CASE WHEN final THEN greatest(floor, ended) ELSE floor END,
         CASE WHEN partial THEN (k + 1) * 100 ELSE updated END, CASE WHEN final THEN false ELSE hyp OR partial END, CASE WHEN final THEN false ELSE said OR (partial AND hyp) END,
         CASE WHEN final THEN told ELSE last END, CASE WHEN final AND told <> last THEN cue + 1 ELSE cue END,
         CASE WHEN final AND told <> last THEN 'final' WHEN partial AND hyp AND NOT said THEN 'partial' END, CASE WHEN final THEN told WHEN partial THEN 'speech' END, CASE WHEN final THEN start END, CASE WHEN final THEN greatest(start, ended) END
  FROM (SELECT *, NOT final AND f IS NOT NULL AND (k + 1) * 100 - updated >= 1000 AS partial, f IS NULL AND n > 6 AS quiet FROM (
    SELECT *, f IS NOT NULL AND (n >= 70 OR k - l >= 6) AS final, (l + 1) * 100 AS ended, 'speech ' || c || '/' || n AS told FROM (
      SELECT s.session_id, x.seq, x.k, s.a, coalesce(s.f, CASE WHEN x.x = 1 THEN x.k END) AS f, CASE WHEN x.x = 1 THEN x.k ELSE s.l END AS l, s.c + x.x AS c, s.p, x.x,
             CASE WHEN s.f IS NOT NULL OR x.x = 1 THEN coalesce(s.start, greatest(coalesce(s.f, x.k) * 100, s.floor)) END AS start, s.floor, s.updated, s.hyp, s.said, s.last, s.cue, x.k - s.a + 1 AS n
      FROM s JOIN x ON x.session_id = s.session_id AND x.k = s.k + 1)))
)
SELECT session_id, seq, type, CAST(CASE WHEN type = 'final' THEN cue END AS INTEGER) AS cue_id, text, CAST(CASE WHEN type = 'final' THEN start_ms END AS DOUBLE) AS start_ms, CAST(CASE WHEN type = 'final' THEN end_ms END AS DOUBLE) AS end_ms
FROM s WHERE type IS NOT NULL
"""
_SETTINGS = audio.Settings(_counted, _loud, FRAME_RATE)


@query(_AUDIO_SQL)
def live_audio(spark, sf_dir):
    """Embeddings as frames of one live session for each label, heard as a stream."""
    frames, folder = _frames(spark, sf_dir), work_folder(spark, "audio")
    last = spark.range(1).select(F.lit("end").alias("session_id"), F.lit(0).cast("long").alias("seq"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit("flush").alias("kind"), F.lit(None).cast("array<float>").alias("samples"))
    return _ran(audio.events(_landed([frames, last], f"{folder}/in", 4), _SETTINGS, "1 hour", None), folder)


@query(_AUDIO_SQL)
def live_audio_batch(spark, sf_dir):
    """The same from the table, without a stream."""
    return audio.batch(_frames(spark, sf_dir), _SETTINGS)


@query("""WITH l AS (SELECT user_id, arg_max(ts, (ts, event_id)) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(value, (ts, event_id)) FILTER (event_type <> 'error' AND value IS NOT NULL) AS progress,
  arg_max(props, (ts, event_id)) FILTER (event_type = 'error' AND props IS NOT NULL) AS error FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT user_id, event_id, status, progress, error FROM l WHERE NOT (status = 'click' AND user_id % 3 = 0)""")
def job_store(spark, sf_dir):
    """Events as changes of their user's job, merged in four micro-batches, in any order; some jobs are removed and the store compacted."""
    failed = F.col("event_type") == "error"
    changes = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("status"), F.when(~failed, F.col("value")).alias("progress"), F.when(failed, F.col("props")).alias("error"))
    store = JobStore(spark, work_folder(spark, "jobs"), "user_id long, ts timestamp, event_id long, status string, progress double, error string", "user_id", ["ts", "event_id"], buckets=16)
    for i in range(4):
        store.merge(changes.where(F.pmod("event_id", F.lit(4)) == i), i)
    store.prune((F.col("status") == "click") & (F.col("user_id") % 3 == 0))
    store.compact()
    return store.read().drop("ts")


@query(f"""WITH {_WORDS} SELECT 'documents' AS job, 'segments' AS stage, count(*) AS done, CAST(NULL AS BIGINT) AS total, count(*) FILTER (length(text) < 20) AS failed FROM seg
UNION ALL SELECT 'documents', 'words', count(*), CAST(NULL AS BIGINT), 0 FROM words""")
def observed_progress(spark, sf_dir):
    """Segments and words of documents, counted while they are made."""
    board = progress.Board()
    told = board.watch(segments(spark, sf_dir), "documents", "segments", failed=F.char_length("text") < 20)
    words = board.watch(distribute_words(told, ["doc_id", "seg_no"], lang=F.lit("en")), "documents", "words")
    words.write.format("noop").mode("overwrite").save()
    return board.table(spark)


def _runs():
    import numpy as np

    def hear(samples, rate):
        up = np.concatenate([[0], (samples > 0).astype(np.int8), [0]])
        begin, end = np.flatnonzero(np.diff(up) > 0), np.flatnonzero(np.diff(up) < 0)
        return [(f"{b - a} up", a * 1000 / rate, b * 1000 / rate) for a, b in zip(begin.tolist(), end.tolist(), strict=True) if b - a > 2]

    return tables.one_by_one(hear)


@query("""WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) > 0 AS up FROM embeddings), g AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM x WHERE up),
r AS (SELECT vec_id, min(i) AS a, max(i) + 1 AS b FROM g GROUP BY vec_id, g HAVING count(*) > 2)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY a) - 1 AS INTEGER) AS seg_no, (b - a) || ' up' AS text, a * 1000.0::DOUBLE / 640 AS start_ms, b * 1000.0::DOUBLE / 640 AS end_ms, CAST(NULL AS VARCHAR) AS error FROM r""")
def heard_by_sql(spark, sf_dir):
    """Embeddings heard by a table function in SQL, a worker's model over several media at once."""
    tables.register_recogniser(spark, "chronotext_hear", _runs, "vec_id")
    table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").selectExpr("vec_id", "embedding AS samples", "640 AS rate").createOrReplaceTempView("chronotext_audio")
    return spark.sql("SELECT * FROM chronotext_hear(TABLE(chronotext_audio))")
