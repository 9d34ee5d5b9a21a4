"""Types, styles and fixed values of timed text. Times are milliseconds as double, for edges may fall between two."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

WORD = T.StructType([T.StructField("text", T.StringType()), T.StructField("start_ms", T.DoubleType()), T.StructField("end_ms", T.DoubleType()), T.StructField("confidence", T.DoubleType())])
WORDS = T.ArrayType(WORD)
SEGMENT = T.StructType([T.StructField("text", T.StringType()), T.StructField("start_ms", T.DoubleType()), T.StructField("end_ms", T.DoubleType()), T.StructField("words", WORDS)])
CUE = T.StructType([
    T.StructField("index", T.IntegerType()),
    T.StructField("start_ms", T.DoubleType()),
    T.StructField("end_ms", T.DoubleType()),
    T.StructField("lines", T.ArrayType(T.StringType())),
    T.StructField("words", WORDS),
    T.StructField("pinyin", T.StringType()),
    T.StructField("ipa", T.StringType()),
])
REGION = T.StructType([T.StructField("start_ms", T.DoubleType()), T.StructField("end_ms", T.DoubleType())])
#: A job as a row: its state and what it has made so far.
JOB = "job_id string, status string, stage string, progress double, created_at timestamp, language string, duration_ms double, error string, translations map<string,struct<language:string,status:string,progress:double,srt:string,vtt:string>>, exports map<string,struct<export_id:string,status:string,progress:double>>"


@dataclass(frozen=True)
class Style:
    """Typography and timing of cues. max_cps is reported, not enforced."""

    max_chars: int = 42
    max_lines: int = 2
    min_duration_ms: float = 1000
    max_duration_ms: float = 7000
    max_cps: float = 17
    min_gap_ms: float = 80

    @property
    def capacity(self) -> int:
        return self.max_chars * self.max_lines

    def with_(self, **changes) -> Style:
        return replace(self, **changes)


LATIN_STYLE = Style()
CJK_STYLE = Style(max_chars=16, max_cps=9)


@dataclass(frozen=True)
class ExportStyle:
    """How an ASS document looks."""

    font_family: str = "Arial"
    font_size: float = 48
    bold: bool = True
    primary_color: str = "#ffffff"
    outline_color: str = "#000000"
    outline_width: float = 2
    shadow: float = 1
    position: str = "bottom"
    margin_v: float = 60
    background: bool = False
    background_color: str = "#000000"
    background_opacity: float = 0.6


# Fixed values.
MEDIA_EXTENSIONS = [".mp3", ".wav", ".m4a", ".flac", ".ogg", ".opus", ".aac", ".mp4", ".mkv", ".mov", ".webm"]
STRONG_PUNCTUATION = ".!?…。！？"
LANGUAGES = ["es", "en", "zh"]
