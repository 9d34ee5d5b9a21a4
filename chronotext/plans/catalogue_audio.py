"""Registered queries over signals: embeddings of one label put together, in turns loud and soft.

A recording is what a label has in one range of PART_ROWS ids, so none grows with the table; there are only more of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import signal
from ..sources.tables import table
from .registry import query

#: An embedding's 64 values are 10 ms, so a frame of 20 ms is two of them.
RATE, TURN = 6400, 40
PART_ROWS = 1 << 15
KEY = ["label", "part"]
_SIGNAL = f"""n AS (SELECT struct_pack(label := label, part := CAST(floor(vec_id / {PART_ROWS}) AS BIGINT)) AS label, vec_id, embedding FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) = 64),
r AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM n),
x AS (SELECT label, k, list_transform(embedding, lambda v: (abs(v) * CASE WHEN k // {TURN} % 2 = 0 THEN 1.0 ELSE 0.01 END::FLOAT)::FLOAT::DOUBLE) AS e FROM r)"""
_FRAMES = f"""{_SIGNAL}, p AS (SELECT label, k, list_sum(list_transform(e, lambda v: v * v)) AS q FROM x),
f AS (SELECT label, k, sqrt((q + lead(q) OVER w) / 128) AS rms, lead(q) OVER w IS NOT NULL AS whole FROM p WINDOW w AS (PARTITION BY label ORDER BY k)),
g AS (SELECT label, k, rms FROM f WHERE whole),
t AS (SELECT label, greatest(0.005, least(2.5 * list_sort(list(rms))[CAST(floor(0.1::DOUBLE * (count(*) - 1)) AS BIGINT) + 1], 0.5 * max(rms))) AS least FROM g GROUP BY label)"""
_SPANS = f"""{_FRAMES}, l AS (SELECT label, k, k - lag(k) OVER (PARTITION BY label ORDER BY k) AS d FROM g JOIN t USING (label) WHERE rms > least),
i AS (SELECT label, k, sum(CASE WHEN d > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY k) AS n FROM l),
a AS (SELECT label, min(k) * 10.0::DOUBLE AS s, max(k) * 10.0::DOUBLE + 20 AS e FROM i GROUP BY label, n),
b0 AS (SELECT *, s - lag(e) OVER (PARTITION BY label ORDER BY s) > 200 AS cut FROM a), b1 AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY s) AS n FROM b0),
b AS (SELECT label, min(s) AS s, max(e) AS e FROM b1 GROUP BY label, n HAVING max(e) - min(s) >= 300),
c0 AS (SELECT *, s - lag(e) OVER (PARTITION BY label ORDER BY s) > 300 AS cut FROM b), c1 AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY s) AS n FROM c0),
len AS (SELECT label, count(*) * 10.0::DOUBLE AS ms FROM x GROUP BY label),
spans AS (SELECT label, greatest(0, min(s) - 100)::DOUBLE AS start_ms, least(any_value(ms), max(e) + 100)::DOUBLE AS end_ms FROM c1 JOIN len USING (label) GROUP BY label, n)"""


def _chunks(spark, sf_dir):
    """(label, part, vec_id, embedding): the recordings as chunks of 10 ms, not yet in turns."""
    return table(spark, sf_dir, "embeddings").where("label IS NOT NULL AND vec_id IS NOT NULL AND size(embedding) = 64").withColumn("part", F.floor(F.col("vec_id") / PART_ROWS))


def _heard(spark, sf_dir, kernel, **results):
    """(label, part, results) by a kernel over each recording in turns loud and soft."""

    def turned(x):
        soft = (np.arange(len(x) // 64) // TURN % 2).repeat(64)
        return kernel((np.abs(x) * np.where(soft, np.float32(0.01), np.float32(1.0))).astype(np.float32))

    return signal.over_chunks(_chunks(spark, sf_dir), KEY, ["vec_id"], turned, results, "embedding")


def _signals(spark, sf_dir, turns=True):
    """(label, part, samples, rate) of every recording; without turns it is noise all through."""
    rows = _chunks(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy(*KEY).orderBy("vec_id")) - 1
    gain = F.when(F.floor(F.col("k") / TURN) % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.01)).cast("float")
    told = rows.withColumn("k", k).select(*KEY, "k", (F.transform("embedding", lambda v: (F.abs(v) * gain).cast("float")) if turns else F.col("embedding").cast("array<float>")).alias("e"))
    held = told.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("k", "e"))).alias("r"))
    # no lambda above the sums: Spark does not take a Python function over one apart
    loud = F.flatten("r.e")
    return held.select(*KEY, loud.alias("samples"), F.lit(RATE).alias("rate"))


@query(f"WITH {_SPANS} SELECT label.label AS label, label.part AS part, round(start_ms, 6) AS start_ms, round(end_ms, 6) AS end_ms FROM spans")
def speech_spans(spark, sf_dir):
    told = _heard(spark, sf_dir, lambda x: signal.regions(x, RATE), start_ms="double", end_ms="double")
    return told.select(*KEY, F.round("start_ms", 6).alias("start_ms"), F.round("end_ms", 6).alias("end_ms"))


@query(f"""WITH {_SPANS}, o AS (SELECT label, min(start_ms) AS a, max(end_ms) AS b FROM spans GROUP BY label),
c AS (SELECT label, CAST(ms * 6.4 AS BIGINT) AS n, greatest(0, CAST(floor(greatest(0, a - 100) * 6.4 + 0.5) AS BIGINT)) AS first, least(CAST(ms * 6.4 AS BIGINT), CAST(floor((b + 100) * 6.4 + 0.5) AS BIGINT)) AS last FROM len LEFT JOIN o USING (label))
SELECT label.label AS label, label.part AS part, CASE WHEN last > first AND first IS NOT NULL THEN first / 6.4 ELSE 0.0 END::DOUBLE AS lead_ms, CAST(CASE WHEN last > first AND first IS NOT NULL THEN last - first ELSE n END AS INTEGER) AS n_samples FROM c""")
def trimmed_signals(spark, sf_dir):
    def ends(x):
        lead, kept = signal.trimmed(x, RATE)
        return [(lead, len(kept))]

    return _heard(spark, sf_dir, ends, lead_ms="double", n_samples="int")


@query(f"""WITH {_SPANS}, m AS (SELECT x.label, x.k, s.label IS NOT NULL AS inside, e FROM x LEFT JOIN spans s ON s.label = x.label AND x.k * 10 >= s.start_ms AND x.k * 10 < s.end_ms),
z AS (SELECT label, inside, sum(list_sum(list_transform(e, lambda v: v * v))) / (count(*) * 64) AS power FROM m GROUP BY label, inside),
bo AS (SELECT label, max(power) FILTER (inside) AS speech, max(power) FILTER (NOT inside) AS noise FROM z GROUP BY label)
SELECT label.label AS label, label.part AS part, round(20 * log10(sqrt(speech) / sqrt(noise)), 4) AS snr_db FROM bo WHERE speech IS NOT NULL AND noise IS NOT NULL""")
def signal_to_noise(spark, sf_dir):
    """Speech against the rest, of labels that have both; spans begin and end between embeddings."""

    def against(x):
        n, spans = len(x) / RATE * 1000, signal.regions(x, RATE)
        covered = sum(min(n, b) - max(0.0, a) for a, b in spans)
        return [] if not spans or covered >= n else [(signal.snr_db(x, RATE, spans),)]

    told = _heard(spark, sf_dir, against, snr_db="double").withColumn("snr_db", F.round("snr_db", 4))
    return told.where("snr_db IS NOT NULL")


@query(f"""WITH {_SIGNAL}, s AS (SELECT label, k * 64 + i AS n, v FROM (SELECT label, k, unnest(range(64)) AS i, unnest(e) AS v FROM x)), c AS (SELECT label, count(*) AS n FROM s GROUP BY label),
fr AS (SELECT label, unnest(range(CAST(floor((n - 512) / 256) AS BIGINT) + 1)) AS f FROM c WHERE n >= 512),
w AS (SELECT fr.label, f, n - f * 256 AS i, v * (0.5 - 0.5 * cos(2 * pi() * (n - f * 256) / 512)) AS v FROM fr JOIN s ON s.label = fr.label AND n >= f * 256 AND n < f * 256 + 512),
b AS (SELECT unnest(range(1, 257)) AS q), co AS (SELECT j, cos(2 * pi() * j / 512) AS c, sin(2 * pi() * j / 512) AS s FROM (SELECT unnest(range(512)) AS j)),
p AS (SELECT label, f, q, pow(sum(v * co.c), 2) + pow(sum(v * co.s), 2) AS power FROM w, b JOIN co ON co.j = (i * q) % 512 GROUP BY label, f, q)
SELECT label.label AS label, label.part AS part, round(CASE WHEN avg(power) <= 1e-12 THEN 0 ELSE exp(avg(ln(power + 1e-12)) - ln(avg(power))) END, 4) AS flatness FROM p GROUP BY label""")
def signal_flatness(spark, sf_dir):
    told = _signals(spark, sf_dir).where(F.size("samples") >= 512)
    return told.select(*KEY, F.round(signal.measure("samples", lambda x: signal.flatness(x.astype("float64"))), 4).alias("flatness"))


@query()
def denoised_signals(spark, sf_dir):
    """Noisy signals by the noise filter, and what two neighbouring labels share (the last one with itself); spectra of 1024 samples have no form in SQL here."""
    media = _signals(spark, sf_dir, turns=False)
    clean = media.select(*KEY, signal.apply("samples", signal.denoise, "rate").alias("clean"), "samples", "rate")
    other = media.select((F.col("label") - 1).alias("label"), "part", F.col("samples").alias("right"))
    sides = clean.join(other, KEY, "left").withColumn("right", F.coalesce("right", "samples")).withColumn("shared", signal.apply("samples", signal.centre_channel, "right", "rate"))
    return sides.select(*KEY, F.size("clean").alias("n_samples"), F.round(signal.rms("samples"), 5).alias("rms"), F.round(signal.rms("clean"), 5).alias("clean_rms"), F.round(signal.rms("shared"), 5).alias("shared_rms"))
