"""Reading statistics of cues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .packing import cps


def cue_stats(cues: DataFrame, by: list[str], media: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """Per medium: cue_count, word_count, avg_cps, max_cps, duration_ms; zeros for media without cues if `media` lists them."""
    told = cues.withColumn("_c", cps("lines", "start_ms", "end_ms"))
    words = F.col("n_words") if "n_words" in cues.columns else F.size("words") if "words" in cues.columns else F.aggregate(F.transform("lines", lambda x: F.size(tokens(x, F.lit("")))), F.lit(0), lambda a, x: a + x)
    out = told.groupBy(*by).agg(F.count("*").alias("cue_count"), F.sum(words).alias("word_count"), F.avg("_c").alias("avg_cps"), F.max("_c").alias("max_cps"), F.max("end_ms").alias("duration_ms"))
    if digits is not None:
        out = out.withColumns({c: F.round(c, digits) for c in ("avg_cps", "max_cps")})
    if media is not None:
        out = media.select(*by).join(out, by, "left").na.fill(0)
    return out


def word_count(segments: DataFrame, by: list[str], lang: str) -> DataFrame:
    """Words of all segments of a medium: their timed words, or else the tokens of their text."""
    timed = F.nullif(F.size(F.coalesce("words", F.array().cast("array<struct<text:string,start_ms:double,end_ms:double>>"))), F.lit(0))
    return segments.groupBy(*by).agg(F.sum(F.coalesce(timed, F.size(tokens("text", F.col(lang))))).alias("word_count"))


def batch_summary(results: DataFrame, ok: str = "ok", error: str = "error") -> DataFrame:
    """total, succeeded, failed of rows that carry their own success, and how often each error occurs."""
    by_error = results.groupBy(F.col(ok).alias("ok"), F.when(~F.col(ok), F.col(error)).alias("error")).agg(F.count("*").alias("n"))
    return by_error.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("succeeded"), F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0)).alias("failed"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.struct("error", "n")))).alias("errors"))
