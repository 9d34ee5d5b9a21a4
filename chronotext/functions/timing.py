"""Times and colours as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def clamp(ms: Column | str) -> Column:
    """Whole milliseconds; negative and non-finite values are 0."""
    x = col(ms).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0), F.lit(0)).otherwise(F.floor(x)).cast("long")


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + 0.5)


def _stamp(ms: Column | str, mark: str) -> Column:
    t = clamp(ms)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(t / 3600000), F.floor(t / 60000) % 60, F.floor(t / 1000) % 60, t % 1000)


def srt_time(ms: Column | str) -> Column:
    return _stamp(ms, ",")


def vtt_time(ms: Column | str) -> Column:
    return _stamp(ms, ".")


def ass_time(ms: Column | str) -> Column:
    c = F.floor(clamp(ms) / 10)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(c / 360000), F.floor(c / 6000) % 60, F.floor(c / 100) % 60, c % 100)


def parse_time(stamp: Column | str, strict: bool = False) -> Column:
    """Milliseconds of [HH:]MM:SS[.,mmm]; anything else is null, or an error if strict."""
    form = "^(?:([0-9]{1,3}):)?([0-9]{1,2}):([0-9]{1,2})(?:[.,]([0-9]{1,3}))?$"
    text = F.trim(col(stamp))
    part = lambda i: F.coalesce(F.regexp_extract(text, form, i).try_cast("int"), F.lit(0)) if i < 4 else F.coalesce(F.rpad(F.nullif(F.regexp_extract(text, form, 4), F.lit("")), 3, "0").try_cast("int"), F.lit(0))
    ok = text.rlike(form) & (part(2) <= 59) & (part(3) <= 59)
    value = (part(1) * 3600000 + part(2) * 60000 + part(3) * 1000 + part(4)).cast("long")
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit("invalid timestamp: "), text)).cast("long")) if strict else F.when(ok, value)


def ffmpeg_time(line: Column | str) -> Column:
    """Milliseconds of `time=H:MM:SS.f` in a progress line."""
    form = "time=([0-9]+):([0-9]{2}):([0-9]{2}(?:\\.[0-9]+)?)"
    part = lambda i: F.regexp_extract(col(line), form, i).try_cast("double")
    return F.when(col(line).rlike(form), rounded((part(1) * 3600 + part(2) * 60 + part(3)) * 1000).cast("long"))


def clock(ms: Column | str, millis: bool = False) -> Column:
    """mm:ss or h:mm:ss of the nearest second, or with `millis` mm:ss.mmm or h:mm:ss.mmm."""
    t = F.greatest(F.lit(0), rounded(col(ms) / (1 if millis else 1000))).cast("long")
    s = F.floor(t / 1000) if millis else t
    short = F.format_string("%02d:%02d", F.floor(s / 60) % 60, s % 60)
    whole = F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), short)).otherwise(short)
    return F.concat(whole, F.format_string(".%03d", t % 1000)) if millis else whole


def clock_tenths(ms: Column | str) -> Column:
    """mm:ss.s or h:mm:ss.s; tenths are rounded, and 59.96 seconds are written as 60.0."""
    t = col(ms).cast("double") / 1000
    seconds = F.lpad(F.format_string("%.1f", t % 60), 4, "0")
    short = F.concat(F.format_string("%02d", F.floor(t % 3600 / 60)), F.lit(":"), seconds)
    return F.when(t >= 3600, F.concat(F.floor(t / 3600).cast("string"), F.lit(":"), short)).otherwise(short)


def expired(created: Column | str, age: str = "1 HOUR") -> Column:
    return col(created) < F.current_timestamp() - F.expr(f"INTERVAL {age}")


def ass_colour(colour: Column | str, opacity: Column | float = 1.0) -> Column:
    """&HAABBGGRR of #rgb or #rrggbb; another value is an error."""
    raw = F.upper(F.regexp_replace(F.trim(col(colour)), "^#", ""))
    six = F.when(raw.rlike("^[0-9A-F]{3}$"), F.regexp_replace(raw, "(.)", "$1$1")).when(raw.rlike("^[0-9A-F]{6}$"), raw).otherwise(F.raise_error(F.concat(F.lit("invalid colour: "), col(colour))))
    clear = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(opacity) if isinstance(opacity, (int, float)) else opacity))
    alpha = F.lpad(F.hex(rounded((1 - clear) * 255).cast("long")), 2, "0")
    return F.concat(F.lit("&H"), alpha, F.substring(six, 5, 2), F.substring(six, 3, 2), F.substring(six, 1, 2))


def bounded(x: Column | str, low: float, high: float, default: float) -> Column:
    """Within limits; null and non-finite values are the default."""
    v = col(x).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(float(default))).otherwise(F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), v)))


def wet_mix(snr_db: Column | str) -> Column:
    """How much of a denoised signal is mixed in: all at 0 dB and below, none from 15 dB on or where it is unknown."""
    x = col(snr_db).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (15 - x) / 15)))
