"""Media as tables: listings of a folder, WAV files to samples, live frames, recognisers' chunks."""

from __future__ import annotations

import shutil
import struct
import subprocess
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.signal import resample_sinc
from ..schema import MEDIA_EXTENSIONS

AUDIO = "rate int, channels int, duration_ms double, samples array<float>, channel_data array<array<float>>, error string"
ASR_RATE = 16000


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the media files of one folder, hidden ones left out, by path; contents are not read."""
    name = F.element_at(F.split("path", "/"), -1)
    known = F.concat(F.lit("."), F.lower(F.element_at(F.split(name, "\\."), -1))).isin(MEDIA_EXTENSIONS)
    return spark.read.format("binaryFile").load(path).select("path", "length").where(known & ~name.startswith(".") & name.contains(".")).orderBy("path")


def parse_wav(content: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples by channel in [-1, 1]) of PCM with 8, 16, 24 or 32 bits, or floats of 32."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    form, data, at = None, None, 12
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            form = body
        elif name == b"data" and data is None:
            data = body
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("a WAV file without format or data")
    kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", form)
    if kind == 0xFFFE and len(form) >= 26:
        kind = struct.unpack_from("<H", form, 24)[0]
    width = bits // 8
    if not channels or not rate or (kind, bits) not in ((1, 8), (1, 16), (1, 24), (1, 32), (3, 32)):
        raise ValueError(f"unsupported WAV format {kind} with {bits} bits")
    data = data[: len(data) // (width * channels) * width * channels]
    if kind == 3:
        x = np.frombuffer(data, "<f4").astype(np.float32)
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 24:
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        x = (wide.view("<i4").ravel() >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(data, f"<i{width}").astype(np.float64).astype(np.float32) / np.float32(1 << (bits - 1))
    return rate, x.reshape(-1, channels).T


def decode(files: DataFrame, content: str = "content", target_rate: int | None = ASR_RATE) -> DataFrame:
    """WAV contents as samples, mono (the mean of the channels) and by channel, at a rate; a bad file is a row with an error."""

    @F.pandas_udf(AUDIO)
    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for data in column:
            try:
                rate, x = parse_wav(bytes(data or b""))
                length = x.shape[1] / rate * 1000
                x = x if target_rate is None else np.stack([resample_sinc(c, rate, target_rate) for c in x])
                rows.append((target_rate or rate, x.shape[0], length, x.mean(axis=0).astype(np.float32), [c.astype(np.float32) for c in x], None))
            except ValueError as e:
                rows.append((None, None, None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["rate", "channels", "duration_ms", "samples", "channel_data", "error"])

    return files.withColumn("_a", run(content)).select(*[c for c in files.columns if c != content], "_a.*")


def load_audio(spark: SparkSession, path: str, target_rate: int | None = ASR_RATE) -> DataFrame:
    return decode(spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").load(path).select("path", "content"), target_rate=target_rate)


def pcm_floats(frame: Column | str) -> Column:
    """Little-endian 32-bit floats of a binary frame; a partial one at the end is left out."""

    @F.pandas_udf("array<float>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else np.frombuffer(bytes(b)[: len(b) // 4 * 4], "<f4"))

    return run(frame)


def chunk_segments(chunks: DataFrame, by: list[str], text: str = "text", start_s: str = "start_s", end_s: str = "end_s") -> DataFrame:
    """A recogniser's chunks (seconds) as segments (whole milliseconds), without the empty ones."""
    ms = lambda c: F.greatest(F.lit(0.0), F.floor(F.coalesce(F.col(c), F.lit(0.0)) * 1000 + 0.5).cast("double"))
    return chunks.withColumn(text, F.trim(text)).where(F.col(text) != "").select(*by, text, ms(start_s).alias("start_ms"), ms(end_s).alias("end_ms"))


#: samples, rate, language -> list of (text, start_ms, end_ms)
Recogniser = Callable[[np.ndarray, int, str | None], list[tuple[str, float, float]]]


def transcribe(audio: DataFrame, by: list[str], recogniser: Recogniser, samples: str = "samples", rate: str = "rate", language: str | None = None) -> DataFrame:
    """(by, seg_no, text, start_ms, end_ms, error): a pluggable recogniser over media; one that fails is a row with its error."""
    types = dict(audio.dtypes)

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                key = {k: r[k] for k in by}
                try:
                    out += [key | {"seg_no": i, "text": t, "start_ms": float(a), "end_ms": float(b), "error": None} for i, (t, a, b) in enumerate(recogniser(np.asarray(r[samples], np.float32), int(r[rate]), language))]
                except Exception as e:  # one medium's failure is its row's result
                    out.append(key | {"seg_no": None, "text": None, "start_ms": None, "end_ms": None, "error": str(e)})
            yield pd.DataFrame(out, columns=[*by, "seg_no", "text", "start_ms", "end_ms", "error"]).astype({"seg_no": "Int32"})

    return audio.select(*by, samples, rate).mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in by) + ", seg_no int, text string, start_ms double, end_ms double, error string")


#: Uploads larger than this are not taken.
MOST_UPLOAD = 500 << 20


def uploads(spark: SparkSession, path: str, stream: bool = True, files_at_once: int = 64) -> DataFrame:
    """(path, length, content) of the media that arrive in a folder, each once as a stream, or those that are there."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_at_once) if stream else spark.read.format("binaryFile")
    return reader.load(path).where(F.col("length") <= MOST_UPLOAD).select("path", "length", "content")


def find_decoder(program: str | None = None) -> str | None:
    """Where a decoder for other containers is, on this machine: the named program, or ffmpeg; None if there is none."""
    return shutil.which(program or "ffmpeg")


def decode_others(files: DataFrame, content: str = "content", program: str | None = None, stereo: bool = False, rate: int = ASR_RATE, seconds: int = 600) -> DataFrame:
    """Media of any container as samples, like decode(), through a decoder that every machine has; a file it fails on is a row with an error.

    The file goes in on standard input and 32-bit floats come out, so nothing is written to a machine's own disk.
    """

    def one(data: bytes) -> tuple:
        place = find_decoder(program)
        if place is None:
            raise ValueError("no decoder is installed")
        channels = 2 if stereo else 1
        done = subprocess.run([place, "-v", "error", "-i", "pipe:0", "-f", "f32le", "-ac", str(channels), "-ar", str(rate), "pipe:1"], input=data, capture_output=True, timeout=seconds, check=False)
        if done.returncode:
            raise ValueError(f"the decoder failed ({done.returncode}): {done.stderr.decode(errors='replace').strip() or 'no output'}")
        x = np.frombuffer(done.stdout[: len(done.stdout) // (4 * channels) * 4 * channels], "<f4").reshape(-1, channels)
        return rate, channels, len(x) / rate * 1000, x.mean(axis=1).astype(np.float32), [c.copy() for c in x.T], None

    @F.pandas_udf(AUDIO)
    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for data in column:
            try:
                rows.append(one(bytes(data or b"")))
            except (ValueError, OSError, subprocess.TimeoutExpired) as e:
                rows.append((None, None, None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["rate", "channels", "duration_ms", "samples", "channel_data", "error"])

    return files.withColumn("_a", run(content)).select(*[c for c in files.columns if c != content], "_a.*")


def run_batch(files: DataFrame, process: Callable[[dict], str], key: str = "path") -> DataFrame:
    """(key, ok, value, error) of a function over rows: what one row raises is its own result, and the others go on."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                try:
                    out.append((r[key], True, process(r), None))
                except Exception as e:  # the row's result
                    out.append((r[key], False, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "ok", "value", "error"])

    return files.mapInPandas(run, f"`{key}` {kind}, ok boolean, value string, error string")
