"""Audio signals as arrays of samples: frames, speech regions, loudness, spectra, filters, resampling, separation.

A medium's samples are one array, or several rows of chunks (`over_chunks`). What sums or maps samples is a Column expression;
what recurs or transforms (filters, spectra) is numpy in an Arrow function, a row or a medium at a time. Rows of whole
recordings are large: Spark sends them to Python by thousands, so many long ones are better left as chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .media_runs import by_medium
from .scans import TrailingPercentile, affine_states, biquad_highpass, decayed
from .sequence import islands, merge_intervals

FRAME, HOP = 0.02, 0.01
TINY = 1e-12
# Fixed values of speech detection.
HANGOVER_MS, LEAST_SPEECH_MS, MERGE_MS, PAD_MS, LEAST_RMS, MOST_CROSSINGS = 200.0, 300.0, 300.0, 100.0, 0.005, 0.35
TARGET_DB, PEAK_DB = -20.0, -1.0


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rms(samples: Column | str) -> Column:
    s = _col(samples)
    return F.when(F.size(s) > 0, F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(s))).otherwise(0.0)


def peak(samples: Column | str) -> Column:
    return F.coalesce(F.array_max(F.transform(_col(samples), lambda x: F.abs(x.cast("double")))), F.lit(0.0))


def has_energy(samples: Column | str, least: float = 1e-9) -> Column:
    return F.exists(_col(samples), lambda x: F.abs(x) > least)


def crossings(samples: Column | str) -> Column:
    """How often the sign changes; zero counts as positive."""
    s = _col(samples)
    pairs = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: ((a >= 0) != (b >= 0)).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + x)


def gain(samples: Column | str, target_db: float = TARGET_DB) -> Column:
    """The factor to a loudness, less where a peak would pass -1 dB; 1 for silence."""
    level, top = rms(samples), peak(samples)
    wanted = F.lit(10 ** (target_db / 20)) / level
    return F.when(level > TINY, F.least(wanted, F.when(top > 0, F.lit(10 ** (PEAK_DB / 20)) / top).otherwise(wanted))).otherwise(1.0)


def normalize_loudness(samples: Column | str, target_db: float = TARGET_DB) -> Column:
    """The samples at a loudness. The factor is found once for the array, not once for each sample."""
    s = _col(samples)
    with_gain = F.transform(F.array(F.struct(gain(s, target_db).alias("g"), s.alias("s"))), lambda r: F.transform(r["s"], lambda x: (x * r["g"]).cast("float")))
    return F.element_at(with_gain, 1)


def resample_linear(samples: Column | str, source: int, target: int) -> Column:
    s, n = _col(samples), F.size(_col(samples))
    count = F.floor(n * F.lit(target / source) + 0.5).cast("int")
    at = lambda i: F.element_at(s, F.least(F.greatest(i, F.lit(0)), n - 1).cast("int") + 1).cast("double")

    def value(i):
        place = i * F.lit(source / target)
        low = F.floor(place)
        return (at(low) + (at(low + 1) - at(low)) * (place - low)).cast("float")

    return F.when((n == 0) | (count <= 0), F.array().cast("array<float>")).when(F.lit(source == target), s.cast("array<float>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), value))


def correlation(pairs: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """Pearson's correlation of two columns; constant ones are 1 if equal, else 0."""
    flat = (F.var_pop(left) * F.var_pop(right) <= TINY) | F.isnan(F.corr(left, right))
    value = F.when(flat, F.when(F.max(F.abs(F.col(left) - F.col(right))) < 1e-9, 1.0).otherwise(0.0)).otherwise(F.corr(left, right))
    return pairs.groupBy(*by).agg(value.alias("correlation"))


def frames(media: DataFrame, by: list[str], samples: str = "samples", rate: str = "rate") -> DataFrame:
    """(by, frame_no, start_ms, end_ms, rms, zcr): windows of 20 ms every 10 ms that lie wholly inside."""
    size = F.greatest(F.lit(1), F.floor(F.col(rate) * FRAME + 0.5)).cast("int")
    hop = F.greatest(F.lit(1), F.floor(F.col(rate) * HOP + 0.5)).cast("int")
    told = media.withColumns({"_size": size, "_hop": hop}).withColumn("_n", F.floor((F.size(samples) - F.col("_size")) / F.col("_hop")).cast("int"))
    each = told.where("_n >= 0").select(*by, rate, "_size", "_hop", samples, F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("frame_no"))
    cut = each.withColumn("_w", F.slice(samples, F.col("frame_no") * F.col("_hop") + 1, F.col("_size"))).drop(samples)
    at = F.col("frame_no") * F.col("_hop")
    return cut.select(*by, "frame_no", (at / F.col(rate) * 1000).alias("start_ms"), ((at + F.col("_size")) / F.col(rate) * 1000).alias("end_ms"), rms("_w").alias("rms"), (crossings("_w") / F.col("_size")).alias("zcr"))


def speech_regions(media: DataFrame, by: list[str], samples: str = "samples", rate: str = "rate") -> DataFrame:
    """(by, start_ms, end_ms): islands of loud, voiced frames, bridged, at least 300 ms long, merged and padded.

    A frame is loud above 2.5 times the 10th percentile of its medium, but never above half the peak.
    """
    told = frames(media, by, samples, rate)
    level = told.groupBy(*by).agg(F.sort_array(F.collect_list("rms")).alias("_r")).select(*by, F.greatest(F.lit(LEAST_RMS), F.least(2.5 * F.element_at("_r", F.floor(0.1 * (F.size("_r") - 1)).cast("int") + 1), 0.5 * F.array_max("_r"))).alias("_least"))
    loud = told.join(level, by).where((F.col("rms") > F.col("_least")) & (F.col("zcr") < MOST_CROSSINGS))
    from pyspark.sql import Window

    before = F.lag("frame_no").over(Window.partitionBy(*by).orderBy("frame_no"))
    numbered = islands(loud.withColumn("_before", before), by, ["frame_no"], F.col("frame_no") - F.col("_before") > 1)
    raw = numbered.groupBy(*by, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")
    bridged = merge_intervals(raw, by, max_gap=HANGOVER_MS).where(F.col("end_ms") - F.col("start_ms") >= LEAST_SPEECH_MS).drop("n_merged")
    merged = merge_intervals(bridged, by, max_gap=MERGE_MS).drop("n_merged")
    length = media.select(*by, (F.size(samples) / F.col(rate) * 1000).alias("_length"))
    return merged.join(length, by).select(*by, F.greatest(F.lit(0.0), F.col("start_ms") - PAD_MS).alias("start_ms"), F.least(F.col("_length"), F.col("end_ms") + PAD_MS).alias("end_ms"))


def trim_to_speech(media: DataFrame, by: list[str], samples: str = "samples", rate: str = "rate") -> DataFrame:
    """Samples from the first speech to the last and 100 ms around; `lead_ms` is what was cut in front, to put times back."""
    ends = speech_regions(media, by, samples, rate).groupBy(*by).agg(F.min("start_ms").alias("_a"), F.max("end_ms").alias("_b"))
    joined = media.join(ends, by, "left")
    per_ms = F.col(rate) / 1000
    first = F.greatest(F.lit(0), F.floor(F.greatest(F.lit(0.0), F.col("_a") - PAD_MS) * per_ms + 0.5)).cast("int")
    last = F.least(F.size(samples), F.floor((F.col("_b") + PAD_MS) * per_ms + 0.5)).cast("int")
    found = F.col("_a").isNotNull() & (last > first)
    return joined.withColumn("lead_ms", F.when(found, first / per_ms).otherwise(0.0)).withColumn(samples, F.when(found, F.slice(samples, first + 1, last - first)).otherwise(F.col(samples))).drop("_a", "_b")


def active_rms(media: DataFrame, regions: DataFrame, by: list[str], samples: str = "samples", rate: str = "rate") -> DataFrame:
    """Loudness inside the regions, or of the whole signal without any."""
    n, per_ms = F.size(samples), F.col(rate) / 1000
    cut = lambda c: F.greatest(F.lit(0), F.least(n, F.floor(F.col(c) * per_ms + 0.5))).cast("int")
    inside = media.join(regions, by).select(*by, cut("start_ms").alias("start_ms"), cut("end_ms").alias("end_ms")).where("end_ms > start_ms")
    merged = merge_intervals(inside, by).groupBy(*by).agg(F.collect_list(F.struct("start_ms", "end_ms")).alias("_spans"))
    held = media.join(merged, by, "left")
    speech = F.flatten(F.transform("_spans", lambda s: F.slice(samples, s["start_ms"] + 1, s["end_ms"] - s["start_ms"])))
    return held.select(*by, F.when(F.col("_spans").isNull(), rms(samples)).otherwise(rms(speech)).alias("active_rms"))


# numeric kernels

def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def fft(re: np.ndarray, im: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary part of the spectrum; the length must be a power of two."""
    if len(re) & (len(re) - 1) or not len(re):
        raise ValueError("the length must be a power of two")
    out = np.fft.fft(np.asarray(re, np.float64) + 1j * (np.zeros(len(re)) if im is None else np.asarray(im, np.float64)))
    return out.real, out.imag


def ifft(re: np.ndarray, im: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signal of a spectrum, divided by its length."""
    if len(re) & (len(re) - 1) or not len(re):
        raise ValueError("the length must be a power of two")
    out = np.fft.ifft(np.asarray(re, np.float64) + 1j * np.asarray(im, np.float64))
    return out.real, out.imag


def fft_power(samples: np.ndarray) -> np.ndarray:
    """Power of the bins up to half the rate; the length must be a power of two."""
    if len(samples) & (len(samples) - 1) or not len(samples):
        raise ValueError("the length must be a power of two")
    return np.abs(np.fft.rfft(np.asarray(samples, np.float64))) ** 2


def high_pass(x: np.ndarray, rate: float, hz: float) -> np.ndarray:
    """A second-order Butterworth high-pass."""
    x = np.asarray(x, np.float64)
    if not len(x) or rate <= 0 or not 0 < hz < rate / 2:
        return x.astype(np.float32)
    m, v, b0 = biquad_highpass(rate, hz)
    states = affine_states(m, v, x[:, None], np.zeros(2))
    return (b0 * x + states[:-1, 0]).astype(np.float32)


def resample_sinc(x: np.ndarray, source: float, target: float, taps: int = 32) -> np.ndarray:
    """A Blackman-windowed sinc of `taps` samples, scaled so that a constant stays."""
    x = np.asarray(x, np.float64)
    if not len(x) or source == target or source <= 0 or target <= 0:
        return x.astype(np.float32)
    n = int(np.floor(len(x) * target / source + 0.5))
    half, cut = taps / 2, 0.45 * min(source, target) / source
    out = np.empty(n, np.float32)
    for a in range(0, n, 1 << 15):
        place = np.arange(a, min(n, a + (1 << 15))) * (source / target)
        near = np.ceil(place - half).astype(np.int64)[:, None] + np.arange(taps + 1)[None, :]
        tau = place[:, None] - near
        window = np.where(np.abs(tau) < half, 0.42 + 0.5 * np.cos(np.pi * tau / half) + 0.08 * np.cos(2 * np.pi * tau / half), 0)
        kernel = np.where((near >= 0) & (near < len(x)), 2 * cut * np.sinc(2 * cut * tau) * window, 0)
        weight = kernel.sum(1)
        out[a : a + len(place)] = np.divide((kernel * x[near.clip(0, len(x) - 1)]).sum(1), weight, out=np.zeros(len(place)), where=weight != 0)
    return out


def _overlap_add(signals: list[np.ndarray], change: Callable[[list[np.ndarray]], np.ndarray], size: int = 1024, hop: int = 256) -> np.ndarray:
    """Windowed spectra (frames x bins) of padded signals, changed to one and put together again."""
    n, window = len(signals[0]), hann(size)
    padded = [np.concatenate([np.zeros(size), s, np.zeros(size)]) for s in signals]
    places = np.arange(0, len(padded[0]) - size + 1, hop)
    spectra = [np.fft.rfft(np.stack([p[i : i + size] for i in places]) * window) for p in padded]
    back = np.fft.irfft(change(spectra), size) * window
    out, norm = np.zeros(len(padded[0])), np.zeros(len(padded[0]))
    for row, i in zip(back, places, strict=True):
        out[i : i + size] += row
        norm[i : i + size] += window**2
    return np.where(norm > 1e-8, out / np.maximum(norm, 1e-8), padded[0])[size : size + n]


def lower_percentile(values: np.ndarray, fraction: float, axis: int = 0) -> np.ndarray:
    """The value at the place floor(fraction * (n - 1)) of the sorted values."""
    return np.take(np.sort(values, axis=axis), int(np.floor(fraction * (values.shape[axis] - 1))), axis=axis)


def flatness(x: np.ndarray, size: int = 512, hop: int = 256) -> float:
    """Geometric over arithmetic mean of the power of all frames; 1 without a frame."""
    places = range(0, len(x) - size + 1, hop)
    if not len(places):
        return 1.0
    power = np.abs(np.fft.rfft(np.stack([x[i : i + size] for i in places]) * hann(size)))[:, 1:] ** 2
    return 0.0 if power.mean() <= TINY else float(np.exp(np.log(power + TINY).mean() - np.log(power.mean())))


def snr_db(x: np.ndarray, rate: float, regions: list[tuple[float, float]] = ()) -> float | None:
    """Speech against the rest; without regions, the mean against the quiet frames, or how flat the spectrum is."""
    x = np.asarray(x, np.float64)
    if not len(x) or rate <= 0 or not (np.abs(x) > 1e-9).any():
        return None
    inside = np.zeros(len(x), bool)
    for a, b in regions:
        inside[max(0, int(np.floor(a / 1000 * rate + 0.5))) : max(0, int(np.floor(b / 1000 * rate + 0.5)))] = True
    if inside.any() and not inside.all():
        speech, noise = (np.sqrt(np.mean(x[m] ** 2)) for m in (inside, ~inside))
        return float(20 * np.log10(speech / noise)) if noise > 1e-7 and speech > 0 else None
    size, hop = (max(1, int(np.floor(f * rate + 0.5))) for f in (FRAME, HOP))
    energy = np.array([np.mean(x[i : i + size] ** 2) for i in range(0, len(x) - size + 1, hop)] or [np.mean(x**2)])
    low, high = (lower_percentile(energy, f) for f in (0.1, 0.9))
    if low <= TINY:
        return None if high <= TINY else 60.0
    if 10 * np.log10(high / low) >= 6:
        return float(np.clip(10 * np.log10(max(energy.mean() - low, TINY) / low), -20, 60))
    flat = flatness(x)
    return 60.0 if flat <= 1e-6 else float(np.clip(-10 * np.log10(flat), 0, 60))


def _merged(spans: list[tuple[float, float]], most_gap: float) -> list[tuple[float, float]]:
    """Spans in order, together where the gap to all before is at most `most_gap`."""
    out: list[tuple[float, float]] = []
    for a, b in spans:
        if out and a - out[-1][1] <= most_gap:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def regions(x: np.ndarray, rate: float) -> list[tuple[float, float]]:
    """speech_regions() of one signal that is at hand."""
    x = np.asarray(x, np.float64)
    size, hop = (max(1, int(np.floor(f * rate + 0.5))) for f in (FRAME, HOP))
    if len(x) < size:
        return []
    windows = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    level = np.sqrt((windows**2).mean(1))
    sign = windows >= 0
    crossed = (sign[:, 1:] != sign[:, :-1]).sum(1) / size
    least = max(LEAST_RMS, min(2.5 * lower_percentile(level, 0.1), 0.5 * level.max()))
    loud = np.flatnonzero((level > least) & (crossed < MOST_CROSSINGS))
    begins = np.flatnonzero(np.diff(loud, prepend=-2) > 1)
    ends = np.append(begins[1:], len(loud)) - 1
    raw = [(a * hop / rate * 1000, (b * hop + size) / rate * 1000) for a, b in zip(loud[begins].tolist(), loud[ends].tolist(), strict=True)] if len(loud) else []
    bridged = [(a, b) for a, b in _merged(raw, HANGOVER_MS) if b - a >= LEAST_SPEECH_MS]
    return [(max(0.0, a - PAD_MS), min(len(x) / rate * 1000, b + PAD_MS)) for a, b in _merged(bridged, MERGE_MS)]


def trimmed(x: np.ndarray, rate: float) -> tuple[float, np.ndarray]:
    """trim_to_speech() of one signal that is at hand: `lead_ms` and the samples."""
    found, per_ms = regions(x, rate), rate / 1000
    if not found:
        return 0.0, x
    first = max(0, int(np.floor(max(0.0, min(a for a, _ in found) - PAD_MS) * per_ms + 0.5)))
    last = min(len(x), int(np.floor((max(b for _, b in found) + PAD_MS) * per_ms + 0.5)))
    return (first / per_ms, x[first:last]) if last > first else (0.0, x)


def denoise(x: np.ndarray, rate: float, strength: float = 1.0) -> np.ndarray:
    """A Wiener filter with decision-directed gains over a trailing noise floor, mixed in by how noisy the signal is."""
    x = np.asarray(x, np.float64)
    if not len(x) or rate <= 0:
        return x.astype(np.float32)
    snr = snr_db(x, rate)
    wet = (0.0 if snr is None else float(np.clip((15 - snr) / 15, 0, 1))) * float(np.clip(strength, 0, 1))
    if wet <= 0:
        return x.astype(np.float32)
    most = max(1, int(np.floor(2 * rate / 256 + 0.5)))

    def filtered(spectra: list[np.ndarray]) -> np.ndarray:
        power = np.abs(spectra[0]) ** 2
        loud = power.sum(1) > TINY
        window, floors = TrailingPercentile(0.1, most, power.shape[1]), np.empty_like(power)
        for i, row in enumerate(power):
            # a silent frame leaves the window as it is; before the first other one it is its own floor
            floors[i] = window.push(row) if loud[i] else window.at() if window.n else row
        after = np.minimum(power / (floors * 6 + TINY), 1e4)
        # 0.98 of the prior before and 0.02 of what the frame adds; both are below 1e4, and so is their sum
        prior = decayed(0.98, 0.02 * np.maximum(after - 1, 0))
        gains = np.maximum(prior / (1 + prior), 10 ** (-15 / 20))
        return spectra[0] * gains

    return ((1 - wet) * x + wet * _overlap_add([x], filtered)).astype(np.float32)


def centre_channel(left: np.ndarray, right: np.ndarray, rate: float) -> np.ndarray:
    """What both channels share, by a mask of middle against side power in each bin."""
    n = min(len(left), len(right))
    left, right = (np.asarray(x[:n], np.float64) for x in (left, right))
    if not n or rate <= 0:
        return np.zeros(n, np.float32)

    def mask(spectra: list[np.ndarray]) -> np.ndarray:
        middle, side = (spectra[0] + spectra[1]) / 2, (spectra[0] - spectra[1]) / 2
        m, s = np.abs(middle) ** 2, np.abs(side) ** 2
        return middle * np.clip(m / (m + 1.2 * s + TINY), 0.08, 1)

    return _overlap_add([left, right], mask).astype(np.float32)


def apply(samples: Column | str, kernel: Callable[[np.ndarray], np.ndarray], *more: Column | str) -> Column:
    """A kernel over a column of sample arrays (and further columns, passed as they are)."""

    @F.pandas_udf("array<float>")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else np.asarray(kernel(np.asarray(row[0], np.float32), *row[1:]), np.float32) for row in zip(*columns, strict=True)])

    return run(samples, *more)


def measure(samples: Column | str, kernel: Callable[..., float | None], *more: Column | str) -> Column:
    """A kernel that gives one number for a column of sample arrays."""

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else kernel(np.asarray(row[0], np.float32), *row[1:]) for row in zip(*columns, strict=True)], dtype="float64")

    return run(samples, *more)


def over_chunks(chunks: DataFrame, by: list[str], order: list[str], kernel: Callable[[np.ndarray], list[tuple]], results: dict[str, str], samples: str = "samples") -> DataFrame:
    """(by, results) of media whose samples stand in several rows: `kernel` gives rows for the samples of one medium in order.

    `results` are names and types (int, double). A task holds one medium and one Arrow batch of chunks.
    """
    types, arrow = dict(chunks.dtypes), {"int": pa.int32(), "double": pa.float64()}

    def make(rows: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        found, medium = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            x = [c.flatten().to_numpy(zero_copy_only=False) for c in rows[samples].slice(a, b - a).chunks]
            own = kernel(np.concatenate(x) if x else np.zeros(0, np.float32))
            found += own
            medium += [a] * len(own)
        keys = [rows[k].take(pa.array(medium, pa.int64())).combine_chunks() for k in by]
        return pa.RecordBatch.from_arrays([*keys, *(pa.array([r[i] for r in found], arrow[t]) for i, t in enumerate(results.values()))], [*by, *results])

    told = chunks.select(*by, *(c for c in order if c not in by), samples)
    return by_medium(told, by, order, make, ", ".join(f"`{c}` {t}" for c, t in [*((k, types[k]) for k in by), *results.items()]))


#: Below this ratio of speech to the rest a signal is denoised; voices in music are heard above this frequency.
NOISY_DB, VOICE_HZ = 10.0, 80.0


def isolated(samples: Column | str, channels: Column | str, rate: Column | str) -> Column:
    """What the first two channels share above VOICE_HZ; of fewer channels the samples above it."""

    def kernel(x: np.ndarray, sides, hz: float) -> np.ndarray:
        if sides is None or len(sides) < 2:
            return high_pass(x, hz, VOICE_HZ)
        return centre_channel(*(high_pass(np.asarray(s, np.float32), hz, VOICE_HZ) for s in sides[:2]), hz)

    return apply(samples, kernel, channels, rate)


def prepared(media: DataFrame, by: list[str], samples: str = "samples", rate: str = "rate", channels: str = "channel_data", vocals: bool = False) -> DataFrame:
    """`media` ready for a recogniser: voices apart from music (with `vocals`), of even loudness, and denoised where the speech
    stands less than NOISY_DB above the rest; `snr_db` is what was measured."""
    if vocals:
        sides = F.col(channels) if channels in media.columns else F.lit(None).cast("array<array<float>>")
        media = media.withColumn(samples, isolated(samples, sides, rate))
    loud = media.withColumn(samples, normalize_loudness(samples))
    heard = speech_regions(loud, by, samples, rate).groupBy(*by).agg(F.sort_array(F.collect_list(F.array("start_ms", "end_ms"))).alias("_regions"))
    told = loud.join(heard, by, "left").withColumn("snr_db", measure(samples, lambda x, hz, r: snr_db(x, hz, [] if r is None else [tuple(p) for p in r]), rate, "_regions")).drop("_regions")
    return told.withColumn(samples, F.when(F.col("snr_db") < NOISY_DB, apply(samples, lambda x, hz, snr: denoise(x, hz) if snr is not None and snr < NOISY_DB else x, rate, "snr_db")).otherwise(F.col(samples)))
