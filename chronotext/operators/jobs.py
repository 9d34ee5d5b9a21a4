"""Transcription jobs as rows: checks of what users send, patches, look-ups, lifetimes, and the files that a job gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, utf16_length
from ..functions.timing import bounded
from ..schema import LANGUAGES, ExportStyle

#: What may be chosen, and the limits of clips and edits.
CHOICES = {
    "language": ["auto", "es", "en", "zh"],
    "model": ["tiny", "base", "small"],
    "format": ["srt", "vtt", "ass", "json"],
    "translate": LANGUAGES,
}
MOST_CLIP_MS, CLIP_SLACK_MS, MOST_EDIT = 120_000, 2_000, 500
# Content types, and the message texts of choice_error(), target_list(), clip_error() and edit_check() below,
# which results have to carry word by word.
CONTENT_TYPES = {"srt": "application/x-subrip; charset=utf-8", "vtt": "text/vtt; charset=utf-8", "ass": "text/x-ssa; charset=utf-8", "json": "application/json; charset=utf-8"}


def choice_error(value: Column | str, label: str, allowed: list[str] | None = None) -> Column:
    """Null if the value is allowed, else what is wrong with it."""
    allowed = CHOICES[label] if allowed is None else allowed
    said = F.coalesce(col(value).cast("string"), F.lit(""))
    return F.when(~said.isin(allowed), F.concat(F.lit(f'Invalid {label} "'), said, F.lit(f'". Expected one of: {", ".join(allowed)}.')))


def required_choice(value: Column | str, label: str, allowed: list[str] | None = None) -> Column:
    """The value, or an error that ends the query."""
    wrong = choice_error(value, label, allowed)
    return F.when(wrong.isNull(), col(value)).otherwise(F.raise_error(wrong))


def target_list(value: Column | str) -> Column:
    """(targets, error) of a comma-separated list of languages: each once, where it first stands."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(value), F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    none = F.lit(f"No translation languages given. Expected a comma-separated list of: {', '.join(LANGUAGES)}.")
    error = F.when(F.size(parts) == 0, none).otherwise(F.get(F.filter(F.transform(parts, lambda t: choice_error(t, "translate")), lambda e: e.isNotNull()), 0))
    return F.struct(F.when(error.isNull(), F.array_distinct(parts)).alias("targets"), error.alias("error"))


def active_targets(targets: Column | str, source: Column | str) -> Column:
    """The targets that are not the language itself, in their order."""
    return F.filter(col(targets), lambda t: t != F.coalesce(col(source), F.lit("")))


def clip_error(start: Column | str, end: Column | str, duration: Column | str) -> Column:
    """Null if a clip may be cut, else why not."""
    a, b = col(start).cast("double"), col(end).cast("double")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        F.when(odd(a) | odd(b) | (a < 0) | (b <= a), "Invalid clip range. Use startMs and endMs in milliseconds.")
        .when(b - a > MOST_CLIP_MS, "Clips are limited to 120 seconds.")
        .when(b > col(duration) + CLIP_SLACK_MS, "Clip range exceeds the media duration.")
    )


def clip(samples: Column | str, rate: Column | str, start: Column | str, end: Column | str) -> Column:
    """The samples between two times, cut at whole samples and at the ends of the signal."""
    n, place = F.size(col(samples)), lambda ms: F.floor(col(ms) * col(rate) / 1000 + 0.5)
    first = F.least(n, F.greatest(F.lit(0), place(start))).cast("int")
    last = F.least(n, F.greatest(F.lit(0), place(end))).cast("int")
    return F.slice(col(samples), first + 1, F.greatest(last - first, F.lit(0)))


def edit_check(cues: DataFrame, edits: DataFrame, by: list[str], index: str = "index", text: str = "text") -> DataFrame:
    """(by, n_cues, error) of every medium with cues: null where the edits are as many as the cues, each of 1 to 500 units."""
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\s ﻿]+", " "))
    wrong = (plain == "") | (utf16_length(plain) > MOST_EDIT)
    # the place among the edits, not what an edit calls itself, tells a cue
    placed = edits.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(index)))
    told = placed.groupBy(*by).agg(F.count("*").alias("_n"), F.min(F.when(wrong, F.col("_at"))).alias("_bad"))
    n = cues.groupBy(*by).agg(F.count("*").alias("n_cues"))
    error = F.when(F.coalesce("_n", F.lit(0)) != F.col("n_cues"), F.format_string("Expected %d cues.", "n_cues")).when(F.col("_bad").isNotNull(), F.format_string("Cue %d must be between 1 and 500 characters.", "_bad"))
    return n.join(told, by, "left").select(*by, "n_cues", error.alias("error"))


#: How a style is sent; a field of another type is as good as none.
STYLE_INPUT = "fontFamily string, fontSize double, bold boolean, primaryColor string, outlineColor string, outlineWidth double, shadow double, position string, marginV double, background boolean, backgroundColor string, backgroundOpacity double"


def merged_style(raw: Column | str, default: ExportStyle = ExportStyle()) -> Column:  # noqa: B008
    """An export style as a struct: what was sent (a struct of STYLE_INPUT, or null), within limits, over the default."""
    x = col(raw)
    colour = lambda f, d: F.when(F.trim(x[f]).rlike("^#?(?:[0-9a-fA-F]{3}){1,2}$"), F.trim(x[f])).otherwise(d)
    family = F.when((F.trim(x["fontFamily"]) != "") & (F.char_length(x["fontFamily"]) <= 100), F.trim(x["fontFamily"])).otherwise(default.font_family)
    return F.struct(
        family.alias("font_family"),
        bounded(x["fontSize"], 12, 160, default.font_size).alias("font_size"),
        F.coalesce(x["bold"], F.lit(default.bold)).alias("bold"),
        colour("primaryColor", default.primary_color).alias("primary_color"),
        colour("outlineColor", default.outline_color).alias("outline_color"),
        bounded(x["outlineWidth"], 0, 12, default.outline_width).alias("outline_width"),
        bounded(x["shadow"], 0, 12, default.shadow).alias("shadow"),
        F.when(x["position"].isin("top", "middle", "bottom"), x["position"]).otherwise(default.position).alias("position"),
        bounded(x["marginV"], 0, 500, default.margin_v).alias("margin_v"),
        F.coalesce(x["background"], F.lit(default.background)).alias("background"),
        colour("backgroundColor", default.background_color).alias("background_color"),
        bounded(x["backgroundOpacity"], 0, 1, default.background_opacity).alias("background_opacity"),
    )


def upsert(records: DataFrame, patches: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """`records` with their patches applied in order: of each field the last patch that sets it. Patches of unknown keys are dropped."""
    fields = [c for c in patches.columns if c not in by and c not in order]
    latest = patches.groupBy(*by).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_{c}") for c in fields))
    joined = records.join(latest, by, "left")
    kept = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in records.columns]
    new = [F.col(f"_{c}").alias(c) for c in fields if c not in records.columns]
    return joined.select(*kept, *new)


def find_export(jobs: DataFrame, asked: DataFrame, key: str, exports: str = "exports", export: str = "export_id") -> DataFrame:
    """`asked` (export) with the job that has an export of that id, the first by key, and its record; ids that none has are dropped."""
    each = jobs.select(key, F.explode(exports).alias(export, "record"))
    first = each.groupBy(export).agg(F.min_by("record", key).alias("record"), F.min(key).alias(key))
    return asked.join(first, export)


def prune(jobs: DataFrame, now: Column, created: str = "created_at", age: str = "1 HOUR") -> tuple[DataFrame, DataFrame]:
    """(kept, removed): jobs older than `age` go; those without a time of creation stay."""
    old = F.coalesce(F.col(created) < now - F.expr(f"INTERVAL {age}"), F.lit(False))
    return jobs.where(~old), jobs.where(old)


def tail(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The last `most` rows of each group."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def progress(stage: Column | str, percent: Column | str) -> Column:
    """A job's percentage from a stage and how far that stage is: recognising takes 25 to 85, the others begin where they stand."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(col(percent).cast("double"), F.lit(0.0))))
    s, fixed = col(stage), {"queued": 0, "decoding": 5, "analyzing": 15, "formatting": 85, "done": 100}
    moving = F.floor(25 + p / 100 * 60 + 0.5)
    return reduce(lambda c, kv: c.when(s == kv[0], F.lit(kv[1])), fixed.items(), F.when(s.isin("loading-model", "transcribing"), moving)).cast("int")


def _parts(path: Column) -> tuple[Column, Column]:
    """A path's folder with its last slash, and its name without extension."""
    folder, name = F.regexp_extract(path, "^(.*/)?", 0), F.regexp_extract(path, "[^/]*$", 0)
    return folder, F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def output_files(jobs: DataFrame, path: str, targets: str, form: Column | str, batch: bool = False, language: str = "language") -> DataFrame:
    """`jobs` with a row for each file to write: its `file` and the language of its cues (`file_language`).

    JSON is one file. Of a single medium one target takes the place of the text itself; more targets, and any in a batch,
    are files of their own beside it.
    """
    folder, name = _parts(F.col(path))
    form, to = col(form), F.coalesce(F.col(targets), F.array().cast("array<string>"))
    named = lambda tag: F.concat(folder, name, tag, F.lit("."), form)
    own = F.struct(named(F.lit("")).alias("file"), F.col(language).alias("file_language"))
    each = F.transform(to, lambda t: F.struct(named(F.concat(F.lit("."), t)).alias("file"), t.alias("file_language")))
    alone = F.lit(not batch) & (F.size(to) == 1)
    files = F.when(form == "json", F.array(own)).when(alone, each).otherwise(F.concat(F.array(own), each))
    return jobs.withColumn("_f", F.explode(files)).select(*jobs.columns, "_f.file", "_f.file_language")


def download(filename: Column | str, form: Column | str, language: Column | str | None = None) -> Column:
    """(content_type, name) under which a document is sent; null for an unknown form."""
    _, name = _parts(col(filename))
    base = F.when(name == "", F.lit("subtitles")).otherwise(name)
    form = col(form)
    tag = F.lit("") if language is None else F.coalesce(F.concat(F.lit("."), col(language)), F.lit(""))
    kind = reduce(lambda c, kv: c.when(form == kv[0], F.lit(kv[1])), list(CONTENT_TYPES.items())[1:], F.when(form == "srt", F.lit(CONTENT_TYPES["srt"])))
    sent = F.when(form == "json", F.concat(base, F.lit(".study.json"))).otherwise(F.concat(base, tag, F.lit("."), form))
    return F.when(kind.isNotNull(), F.struct(kind.alias("content_type"), sent.alias("name")))
