"""Subtitle documents from cues: SRT, WebVTT, ASS, plain text and the nested study document, one row per medium."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ass_text
from ..functions.timing import ass_colour, ass_time, srt_time, vtt_time
from ..schema import ExportStyle

# Column orders of the ASS format.
STYLE_FIELDS = "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
EVENT_FIELDS = "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
ALIGNMENT = {"bottom": 2, "middle": 5, "top": 8}


def _document(cues: DataFrame, by: list[str], order: str, block: Column, between: str, name: str) -> DataFrame:
    held = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    return cues.groupBy(*by).agg(F.array_join(F.transform(held, lambda x: x["b"]), between).alias(name))


def srt(cues: DataFrame, by: list[str], index: str = "index", media: DataFrame | None = None) -> DataFrame:
    """An SRT document for each medium; media without cues (if `media` lists them) have an empty one."""
    block = F.concat(F.col(index).cast("string"), F.lit("\n"), srt_time("start_ms"), F.lit(" --> "), srt_time("end_ms"), F.lit("\n"), F.array_join("lines", "\n"))
    out = _document(cues, by, index, block, "\n\n", "srt").withColumn("srt", F.concat("srt", F.lit("\n")))
    return out if media is None else media.select(*by).join(out, by, "left").withColumn("srt", F.coalesce("srt", F.lit("")))


def vtt(cues: DataFrame, by: list[str], index: str = "index", media: DataFrame | None = None, karaoke: bool = False) -> DataFrame:
    """A WebVTT document for each medium, with a time before every word for karaoke."""
    said = F.array_join(karaoke_lines("lines", "words") if karaoke else F.col("lines"), "\n")
    block = F.concat(vtt_time("start_ms"), F.lit(" --> "), vtt_time("end_ms"), F.lit("\n"), said)
    out = _document(cues, by, index, block, "\n\n", "vtt").withColumn("vtt", F.concat(F.lit("WEBVTT\n\n"), F.col("vtt"), F.lit("\n")))
    return out if media is None else media.select(*by).join(out, by, "left").withColumn("vtt", F.coalesce("vtt", F.lit("WEBVTT\n\n")))


def plain(cues: DataFrame, by: list[str], index: str = "index") -> DataFrame:
    """The text of each medium, a line for each cue."""
    return _document(cues, by, index, F.array_join("lines", " "), "\n", "txt").withColumn("txt", F.concat("txt", F.lit("\n")))


def _stamp(ms: float) -> str:
    t = int(max(ms, 0))
    return f"{t // 3600000:02d}:{t // 60000 % 60:02d}:{t // 1000 % 60:02d}.{t % 1000:03d}"


def karaoke(lines: list[str], words: list[dict] | None) -> list[str]:
    """The lines with their words timed: each takes as many words as its length holds, one at least; the last takes the rest."""
    if not words:
        return list(lines)
    units = lambda s: len(s.encode("utf-16-le")) // 2
    out, at = [], 0
    for line in lines:
        first, room = at, units(line)
        while at < len(words) and (used := units(words[at]["text"]) + (at > first)) <= room:
            room -= used
            at += 1
        if at == first and at < len(words):
            at += 1
        out.append(words[first:at])
    rest = words[at:]
    text = [" ".join(f"<{_stamp(w['start_ms'])}>{w['text']}" for w in part) for part in out]
    if rest:
        tail = " ".join(f"<{_stamp(w['start_ms'])}>{w['text']}" for w in rest)
        text = [*text[:-1], f"{text[-1]} {tail}"] if text else [tail]
    return text


def karaoke_lines(lines: Column | str, words: Column | str) -> Column:
    @F.pandas_udf("array<string>")
    def timed(both: pd.DataFrame) -> pd.Series:
        as_rows = lambda w: [x if isinstance(x, dict) else x.asDict() for x in w] if w is not None else None
        return pd.Series([karaoke(list(a), as_rows(b)) for a, b in zip(both["lines"], both["words"], strict=True)])

    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return timed(F.struct(as_col(lines).alias("lines"), as_col(words).alias("words")))


def ass_style(style: ExportStyle) -> Column:
    number = lambda x: f"{x:g}"
    fields = ["Default", style.font_family, number(style.font_size), ass_colour(F.lit(style.primary_color)), ass_colour(F.lit(style.primary_color)), ass_colour(F.lit(style.outline_color)), ass_colour(F.lit(style.background_color), style.background_opacity), "-1" if style.bold else "0", "0", "0", "0", "100", "100", "0", "0", "3" if style.background else "1", number(style.outline_width), number(style.shadow), str(ALIGNMENT[style.position]), "20", "20", number(style.margin_v), "1"]
    return F.concat(F.lit("Style: "), F.concat_ws(",", *(F.lit(f) if isinstance(f, str) else f for f in fields)))


def ass(cues: DataFrame, by: list[str], index: str = "index", style: ExportStyle | None = None, width: int = 1920, height: int = 1080, title: str = "") -> DataFrame:
    """An ASS document for each medium."""
    line = F.concat(F.lit("Dialogue: 0,"), ass_time("start_ms"), F.lit(","), ass_time("end_ms"), F.lit(",Default,,0,0,0,,"), F.array_join(F.transform("lines", ass_text), "\\N"))
    top = ["[Script Info]", *([f"Title: {title}"] if title else []), "ScriptType: v4.00+", f"PlayResX: {width}", f"PlayResY: {height}", "WrapStyle: 0", "ScaledBorderAndShadow: yes", "", "[V4+ Styles]", STYLE_FIELDS]
    head = F.concat(F.lit("\n".join(top) + "\n"), ass_style(style or ExportStyle()), F.lit(f"\n\n[Events]\n{EVENT_FIELDS}\n"))
    return _document(cues, by, index, line, "\n", "ass").withColumn("ass", F.concat(head, F.col("ass"), F.lit("\n")))


def study(cues: DataFrame, by: list[str], language: str, index: str = "index", translations: DataFrame | None = None, duration: Column | None = None) -> DataFrame:
    """The nested study document as JSON: version, language, duration, cues with words, translations by language.

    Readings (columns pinyin and ipa, where there are any) stand for Chinese, and for English and Spanish. `translations`
    has (by, target, index, start_ms, end_ms, lines), one row per cue and language; `duration` is an aggregate, by default
    the last end.
    """
    none = F.array().cast("array<struct<text:string,start_ms:double,end_ms:double>>")

    def entry(columns: set[str], lang: Column) -> Column:
        word = F.transform(F.coalesce("words", none) if "words" in columns else none, lambda w: F.struct(w["text"].alias("text"), w["start_ms"].alias("startMs"), w["end_ms"].alias("endMs")))
        optional = [F.when(lang.rlike("^(?i)zh"), F.col("pinyin")).alias("pinyin")] * ("pinyin" in columns) + [F.when(lang.rlike("^(?i)(en|es)"), F.col("ipa")).alias("ipa")] * ("ipa" in columns)
        return F.struct(F.col("start_ms").alias("startMs"), F.col("end_ms").alias("endMs"), F.col("lines").alias("lines"), word.alias("words"), *optional)

    def in_order(e: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("o"), F.to_json(e).alias("j")))), lambda x: x["j"])

    out = cues.groupBy(*by, language).agg(in_order(entry(set(cues.columns), F.col(language))).alias("_cues"), (F.max("end_ms") if duration is None else duration).alias("_d"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"^\{\"x\":(.*)\}$", 1)
    if translations is not None:
        each = translations.groupBy(*by, "target").agg(in_order(entry(set(translations.columns), F.col("target"))).alias("c"))
        said = F.concat(quoted("target"), F.lit(':{"cues":['), F.array_join("c", ","), F.lit("]}"))
        out = out.join(each.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(said)), ",").alias("_tr")), by, "left")
    tr = F.coalesce("_tr", F.lit("")) if translations is not None else F.lit("")
    return out.select(*by, F.concat(F.lit('{"version":1,"language":'), quoted(language), F.lit(',"durationMs":'), F.col("_d").cast("string"), F.lit(',"cues":['), F.array_join("_cues", ","), F.lit('],"translations":{'), tr, F.lit("}}")).alias("study"))


def pretty(document: str) -> str:
    """A study document with an indent of two spaces and a line end."""
    return json.dumps(json.loads(document), ensure_ascii=False, indent=2) + "\n"


def with_suffix(path: Column | str, suffix: str) -> Column:
    """A path with a suffix before its extension."""
    p = F.col(path) if isinstance(path, str) else path
    return F.when(p.rlike(r"\.[^./\\]+$"), F.regexp_replace(p, r"(\.[^./\\]+)$", f"{suffix}$1")).otherwise(F.concat(p, F.lit(suffix)))


def write_files(documents: DataFrame, path: str, file: str, column: str, most_files: int = 200) -> None:
    """Each document as a text file named by its `file` column below `path`: one folder for each, as Spark writes folders.

    Documents are dealt by file, so a folder holds one part; `most_files` parts are written at a time.
    """
    rows = documents.select(F.regexp_replace(F.col(file), "^/+", "").alias("file"), F.col(column).alias("value"))
    rows.repartition(most_files, "file").write.mode("overwrite").partitionBy("file").option("lineSep", "\n\n").text(path)


def write_documents(documents: DataFrame, path: str, column: str, language: str | None = None) -> None:
    """Documents as text files, a folder for each language if there is one."""
    rows = documents.select(F.col(column).alias("value"), *([F.col(language).alias("language")] if language else []))
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("language") if language else writer).option("lineSep", "\n\n").text(path)
