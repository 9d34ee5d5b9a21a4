"""Telling recognised speech from boilerplate, loops and noise, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.streams import bound
from ..functions.text import SPACE, col, compact, halfwidth

#: Phrases that recognisers make up, in the order in which they are taken out.
ENGLISH_PHRASES = ["thank you for watching", "thanks for watching", "thank you for watching this video", "thanks for watching this video", "subtitles by", "subtitles provided by", "subtitle by", "amara.org", "transcription by", "translated by", "please subscribe", "please like and subscribe", "like and subscribe", "subscribe to my channel", "subscribe"]
CHINESE_PHRASES = ["谢谢观看", "感谢观看", "感谢收看", "谢谢大家观看", "请订阅", "请订阅频道", "订阅频道", "请点赞", "请关注", "字幕由", "字幕组", "字幕志愿者", "翻译由"]
FILLERS = f"[{SPACE}.,!?…、，。！？:;'\"()\\[\\]{{}}<>—–\\-_/\\\\|*#$%^&+=~`@]+"
LOOP = "^(?:(.)\\1{3,}|(.{2})\\2{3,}|(.{3})\\3{3,}|(.{4})\\4{3,})$"
#: A text of so few characters, once cleaned, counts as noise in every language.
NOISE_CHARS = 1


def repeats(text: Column | str) -> Column:
    """One to four characters, four times or more, and nothing else."""
    return col(text).rlike(LOOP)


def deloop(text: Column | str, passes: int = 10) -> Column:
    """Phrases of 2 to 20 characters that stand four times or more in a row, once; again up to `passes` times."""
    once = lambda t: F.regexp_replace(t, "(.{2,20}?)\\1{3,}", "$1")
    # a pass that changes nothing is the last
    again = lambda s, _: F.when(s["more"], bound(once(s["t"]), lambda t: F.struct(t.alias("t"), (t != s["t"]).alias("more")))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.struct(col(text).alias("t"), F.lit(True).alias("more")), again)["t"]


def matchable_text(text: Column | str) -> Column:
    straight = F.translate(col(text), "‘’“”", "''\"\"")
    return F.trim(F.lower(F.regexp_replace(straight, f"[{SPACE}]+", " ")))


def _any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def _clean(text: Column, table: dict[str, str] | None) -> Column:
    """The text in half-width and simplified characters, without spaces, punctuation and symbols."""
    mapped = F.translate(text, "".join(table), "".join(table.values())) if table else text
    return compact(halfwidth(mapped))


def _chinese(text: Column, clean: Column) -> Column:
    rest = F.char_length(reduce(lambda t, p: F.replace(t, F.lit(p), F.lit("")), CHINESE_PHRASES, clean)) <= NOISE_CHARS
    said = reduce(lambda a, b: a | b, [(clean.contains(p) & (F.lit(float(len(p))) >= F.char_length(clean) * 0.5)) | clean.startswith(p) for p in CHINESE_PHRASES])
    # without any phrase nothing can be taken out
    return (F.trim(text) != "") & (clean != "") & (repeats(clean) | F.when(_any(clean, CHINESE_PHRASES), rest | said).otherwise(F.char_length(clean) <= NOISE_CHARS))


def chinese_boilerplate(text: Column | str, table: dict[str, str] | None = None) -> Column:
    return bound(_clean(col(text), table), lambda clean: _chinese(col(text), clean))


def _words(plain: Column) -> Column:
    return F.filter(F.split(plain, " "), lambda t: t != "")


def _low_diversity(words: Column) -> Column:
    return (F.size(words) >= 4) & (F.size(F.array_distinct(words)) <= F.greatest(F.lit(1), F.floor(F.size(words) / 3)))


def low_diversity(text: Column | str) -> Column:
    """Four words or more of which a third or fewer differ."""
    return bound(_words(matchable_text(text)), _low_diversity)


def _boilerplate(plain: Column, words: Column) -> Column:
    left = F.regexp_replace(reduce(lambda t, p: F.replace(t, F.lit(p), F.lit(" ")), ENGLISH_PHRASES, plain), FILLERS, "")
    # a text that is one of the phrases has six words at most
    return F.when(_any(plain, ENGLISH_PHRASES), (F.size(words) <= 6) | (left == "")).otherwise(F.regexp_replace(plain, FILLERS, "") == "")


def boilerplate_phrase(text: Column | str) -> Column:
    """Nothing but known phrases, or one of them among six words or fewer."""
    return bound(matchable_text(text), lambda plain: _boilerplate(plain, _words(plain)))


def hallucinated(text: Column | str, table: dict[str, str] | None = None) -> Column:
    """Whether a text is empty, boilerplate or a loop."""
    text = col(text)
    forms = F.struct(matchable_text(text).alias("plain"), _clean(text, table).alias("clean"), _words(matchable_text(text)).alias("words"))

    def noise(t: Column) -> Column:
        loop = repeats(F.regexp_replace(t["plain"], f"[{SPACE}]+", ""))
        return (t["plain"] == "") | _low_diversity(t["words"]) | loop | _boilerplate(t["plain"], t["words"]) | _chinese(text, t["clean"])

    return F.coalesce(bound(forms, noise), F.lit(True))
