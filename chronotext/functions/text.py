"""Text scalars as Column expressions: spaces, scripts, lengths, sentences, tokens, language.

White space is the set that follows, spelled out, since regular expressions of different engines differ on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CJK_STYLE, LATIN_STYLE, Style

#: White space, Han ideographs, zero-width and directional marks.
SPACE = "\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
HAN = "\\u3400-\\u4DBF\\u4E00-\\u9FFF"
INVISIBLE = "[\\u200B-\\u200F\\u202A-\\u202E\\u2060\\uFEFF]"
CLOSERS = "\"'\\)\\]\\}”’」』）】》"
ABBREVIATIONS = ["sr", "sra", "srta", "dr", "dra", "mr", "mrs", "ms", "prof", "st"]
SPANISH = ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "es", "por", "con", "para", "no", "se", "del", "al"]
ENGLISH = ["the", "of", "and", "to", "in", "is", "it", "you", "that", "he", "was", "for", "on", "are", "as", "with", "his", "they"]
#: A language or script is ignored beside another that has more than 85 % of the letters.
MINORITY = 0.15


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def language_is_cjk(lang: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(lang))).rlike("^(zh|cmn|ja|ko)"), F.lit(False))


def style_of(lang: Column | str, latin: Style = LATIN_STYLE, cjk: Style = CJK_STYLE) -> Column:
    """The style's fields as a struct."""
    as_struct = lambda s: F.struct(*(F.lit(v).alias(k) for k, v in vars(s).items()))
    return F.when(language_is_cjk(lang), as_struct(cjk)).otherwise(as_struct(latin))


def script(text: Column | str) -> Column:
    """latin, cjk or mixed, by counts of Han and Latin letters."""
    han, latin = F.regexp_count(col(text), F.lit(f"[{HAN}]")), F.regexp_count(col(text), F.lit("\\p{IsLatin}"))
    both = (han + latin).cast("double")
    return F.when(han == 0, "latin").when(latin == 0, "cjk").when(han / both < MINORITY, "latin").when(latin / both < MINORITY, "cjk").otherwise("mixed")


def collapse(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(text), f"[{SPACE}]+", " "))


def for_display(text: Column | str) -> Column:
    """Without invisible marks, with straight quotes, single spaces, and none between Han characters."""
    plain = F.translate(F.regexp_replace(col(text), INVISIBLE, ""), "“”‘’", "\"\"''")
    return F.regexp_replace(collapse(plain), f"(?<=[{HAN}]) (?=[{HAN}])", "")


def visible_length(text: Column | str) -> Column:
    """Grapheme clusters that hold no white space."""
    t = col(text)
    # of ASCII each character is a cluster
    plain = F.char_length(F.translate(t, "\t\n\v\f\r ", ""))
    return F.when(F.octet_length(t) == F.char_length(t), plain).otherwise(F.regexp_count(F.regexp_replace(t, f"[{SPACE}]", " "), F.lit("(?! )\\X")))


def total_length(text: Column | str) -> Column:
    """Code points, spaces included."""
    return F.char_length(col(text))


def utf16_length(text: Column | str, spaces: bool = True) -> Column:
    """UTF-16 units; a character beyond the basic plane has two."""
    plain = col(text) if spaces else F.regexp_replace(col(text), f"[{SPACE}]+", "")
    return F.char_length(plain) + F.regexp_count(plain, F.lit("[\\x{10000}-\\x{10FFFF}]"))


def sentences(text: Column | str) -> Column:
    """Sentences in order.

    A full-width terminator always ends one; a Latin one where a space or the end follows, but for a dot after a known
    abbreviation. Closing marks stay with the sentence.
    """
    guard = "(?<!(?<![A-Za-z\\u00C0-\\u024F])(?i:" + "|".join(ABBREVIATIONS) + "))"
    cut = F.regexp_replace(collapse(text), f"([。！？；][{CLOSERS}]*|[!?;…][{CLOSERS}]*(?= |$)|{guard}\\.[{CLOSERS}]*(?= |$))", "$1\u0001")
    return F.filter(F.transform(F.split(cut, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def tokens(text: Column | str, lang: Column | str) -> Column:
    """Words between white space; in CJK text a token per Han character and other runs whole."""
    split = F.filter(F.split(col(text), f"[{SPACE}]+"), lambda t: t != "")
    single = F.regexp_extract_all(col(text), F.lit(f"[{HAN}]|[^{HAN}{SPACE}]+"), F.lit(0))
    return F.when(language_is_cjk(lang) | (script(text) == "cjk"), single).otherwise(split)


def joined(texts: Column | str, lang: Column | str) -> Column:
    """Texts put together, without spaces in CJK."""
    spaced = F.array_join(col(texts), " ")
    return F.when(language_is_cjk(lang) | (script(spaced) == "cjk"), F.array_join(col(texts), "")).otherwise(spaced)


def word_hits(text: Column | str, words: list[str]) -> Column:
    """How often one of the words occurs, letters of other alphabets counting as borders."""
    return F.regexp_count(col(text), F.lit(f"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])"))


def spoken_language(text: Column | str) -> Column:
    """zh for any Han character, else es or en by their frequent words, else unknown."""
    es, en = word_hits(text, SPANISH), word_hits(text, ENGLISH)
    return F.when(col(text).rlike(f"[{HAN}]"), "zh").when(es > en, "es").when(en > es, "en").otherwise("unknown")


def language_tag(tag: Column | str) -> Column:
    """es, en, zh or unknown from a language tag."""
    code = F.regexp_replace(F.lower(F.trim(col(tag))), "_", "-")
    return F.when(code.rlike("^(zh(-.*)?|cmn|zho|chi)$"), "zh").when(code.rlike("^(es(-.*)?|spa)$"), "es").when(code.rlike("^(en(-.*)?|eng)$"), "en").otherwise("unknown")


def halfwidth(text: Column | str) -> Column:
    """Full-width forms as ASCII."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.translate(col(text), "　" + wide, " " + "".join(chr(ord(c) - 0xFEE0) for c in wide))


def simplified(text: Column | str, table: dict[str, str] | None = None) -> Column:
    """Chinese text normalised; `table` maps traditional to simplified characters (none is bundled)."""
    mapped = F.translate(col(text), "".join(table), "".join(table.values())) if table else col(text)
    return collapse(F.regexp_replace(halfwidth(mapped), f"(?<=[{HAN}])[{SPACE}]+(?=[{HAN}])", ""))


def compact(text: Column | str) -> Column:
    """Without white space, punctuation and symbols."""
    return F.regexp_replace(col(text), f"[{SPACE}\\p{{P}}\\p{{S}}]+", "")


def matchable(token: Column) -> Column:
    """Lower case, without marks at the ends."""
    return F.regexp_replace(F.lower(token), "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")


def spaced_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(f"[^{SPACE}]+"), F.lit(0))


def bytes_text(n: Column | str) -> Column:
    """A number of bytes in binary units."""
    x = col(n).cast("double")
    power = F.least(F.floor(F.log(F.greatest(x, F.lit(1.0))) / F.log(F.lit(1024.0))), F.lit(4)).cast("int")
    scaled = x / F.pow(F.lit(1024.0), power)
    digits = F.when((power == 0) | (scaled >= 100), F.format_string("%.0f", scaled)).when(scaled >= 10, F.format_string("%.1f", scaled)).otherwise(F.format_string("%.2f", scaled))
    return F.when(x.isNull() | (x < 0), "0 B").otherwise(F.concat(digits, F.lit(" "), F.element_at(F.array(*map(F.lit, ["B", "KB", "MB", "GB", "TB"])), power + 1)))


def ass_text(text: Column | str) -> Column:
    return F.translate(col(text), "{}", "()")


def filter_path(path: Column | str) -> Column:
    """A path as a value of a filter graph: forward slashes, colons escaped, quoted where it holds spaces, quotes or marks of the graph."""
    plain = F.replace(F.replace(col(path), F.lit("\\"), F.lit("/")), F.lit(":"), F.lit("\\:"))
    quoted = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(plain.rlike("[ '\",;\\[\\]]"), quoted).otherwise(plain)


def plain_text(document: Column | str) -> Column:
    """The spoken lines of an SRT or WebVTT document, with spaces between."""
    lines = F.transform(F.split(col(document), "\\r?\\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: (x != "") & (x != "WEBVTT") & ~x.contains("-->") & ~x.rlike("^[0-9]+$")), " ")
