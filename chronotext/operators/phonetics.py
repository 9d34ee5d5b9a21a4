"""Phonetic annotation: Spanish by rule, English through a pronouncing dictionary, Chinese through a given reading.

Words are converted once per batch and value. Dictionaries and character readings are data that the caller supplies.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.streams import bound
from ..functions.text import HAN, col, halfwidth

# ARPAbet to IPA.
CONSONANTS = {"B": "b", "CH": "tʃ", "D": "d", "DH": "ð", "F": "f", "G": "ɡ", "HH": "h", "JH": "dʒ", "K": "k", "L": "l", "M": "m", "N": "n", "NG": "ŋ", "P": "p", "R": "ɹ", "S": "s", "SH": "ʃ", "T": "t", "TH": "θ", "V": "v", "W": "w", "Y": "j", "Z": "z", "ZH": "ʒ"}
VOWELS = {"AA": "ɑ", "AE": "æ", "AO": "ɔ", "AW": "aʊ", "AY": "aɪ", "EH": "ɛ", "EY": "eɪ", "IH": "ɪ", "IY": "i", "OW": "oʊ", "OY": "ɔɪ", "UH": "ʊ", "UW": "u"}
BY_STRESS = {"AH": ("ə", "ʌ"), "ER": ("ɚ", "ɝ")}
# Spanish spellings, longest and most special first; where a context follows, it is not taken.
SPANISH = [
    ("qu", "k"), ("gu(?=[ei])", "g"), ("g(?=[ei])", "x"), ("c(?=[ei])", "s"), ("ll", "ʝ"), ("rr", "r"), ("ch", "tʃ"), ("ñ", "ɲ"), ("z", "s"), ("h", ""), ("v", "b"), ("x", "ks"), ("y(?=[aeiouáéíóúü])", "ʝ"), ("y", "i"),
    ("b", "b"), ("c", "k"), ("d", "d"), ("f", "f"), ("g", "g"), ("j", "x"), ("k", "k"), ("l", "l"), ("m", "m"), ("n", "n"), ("p", "p"), ("q", "k"), ("s", "s"), ("t", "t"), ("w", "w"),
]
PLAIN = dict(zip("aeiouáéíóúü", "aeiouaeiouu", strict=True))
ACCENTED, HIGH = set("áéíóú"), set("iuü")
SOFT = {"b": "β", "d": "ð", "g": "ɣ"}

_RULES = regex.compile("|".join(f"(?P<r{i}>{p})" for i, (p, _) in enumerate(SPANISH)) + "|(?P<tap>r)|(?P<vowel>[aeiouáéíóúü])|(?P<other>.)", regex.S)


def _spelled(word: str) -> list[tuple[str, str]]:
    """(letter of a vowel or '', sound) of each step of a Spanish word."""
    out: list[tuple[str, str]] = []
    for m in _RULES.finditer(word.lower()):
        kind = m.lastgroup
        if kind == "vowel":
            out.append((m[0], PLAIN[m[0]]))
        elif kind == "tap":
            strong = m.start() == 0 or (out and not out[-1][0] and out[-1][1] in ("n", "l", "s"))
            out.append(("", "r" if strong else "ɾ"))
        else:
            out.append(("", m[0] if kind == "other" else SPANISH[int(kind[1:])][1]))
    return out


def _mark_place(steps: list[tuple[str, str]], stressed: int) -> int:
    """Where the stressed syllable begins: glides before the vowel, then one consonant, or two that may open a syllable."""
    start = stressed
    while start and steps[start - 1][0] in HIGH and steps[start - 1][0]:
        start -= 1
    if not any(v for v, _ in steps[:start]):
        return 0
    before = 0
    while before < start and not steps[start - 1 - before][0]:
        before += 1
    if before < 2:
        return start - before
    a, b = steps[start - 2][1], steps[start - 1][1]
    together = (b in ("l", "r") and a in tuple("bcdfgkpt")) or (a == "s" and b in tuple("ptk"))
    return start - 2 if together else start - 1


@lru_cache(maxsize=200_000)
def spanish_word(word: str, casual_endings: bool = False) -> str:
    """A Spanish word in IPA. `casual_endings`: words in -s and capitals take the usual stress as well."""
    steps = _spelled(word)
    vowels = [i for i, (v, _) in enumerate(steps) if v]
    sounds = [s for _, s in steps]
    for i in range(1, len(steps) - 1):
        if not steps[i][0] and steps[i - 1][0] and steps[i + 1][0]:
            sounds[i] = SOFT.get(sounds[i], sounds[i])
    if not vowels:
        return "".join(sounds)
    last = word[-1].lower() if casual_endings else word[-1]
    light = last in "aeioun" or last in ACCENTED or (casual_endings and last == "s")
    stressed = next((i for i in vowels if steps[i][0] in ACCENTED), vowels[max(0, len(vowels) - 2)] if light else vowels[-1])
    for i in vowels:
        near = [steps[j][0] for j in (i - 1, i + 1) if 0 <= j < len(steps) and steps[j][0]]
        if steps[i][0] in HIGH and i != stressed and any(v not in HIGH for v in near):
            sounds[i] = {"i": "j", "u": "w"}[sounds[i]]
    at = _mark_place(steps, stressed)
    return "".join(sounds[:at]) + "ˈ" + "".join(sounds[at:])


# What may follow what at the beginning of an English syllable.
GLIDES = {"l", "r", "w", "j"}
AFTER_S = {"p", "t", "k", "m", "n", "f", "l", "w", "j"}
STOPS_AFTER_S = {"p", "t", "k"}


def _opens(cluster: list[str]) -> bool:
    """Whether one to three consonants may open an English syllable."""
    head, *rest = cluster
    if head == "s" and len(rest) == 2:
        return rest[0] in STOPS_AFTER_S and rest[1] in GLIDES
    if head == "s":
        return set(rest) <= AFTER_S
    return len(rest) < 2 and head != "ŋ" and set(rest) <= GLIDES and not (rest and head in GLIDES)


@lru_cache(maxsize=200_000)
def arpabet(pronunciation: str) -> str:
    """ARPAbet as IPA, with stress marks before the longest onset."""
    sounds, strong = [], []
    for raw in pronunciation.split():
        m = regex.fullmatch(r"([A-Z]+)([0-2])?", raw)
        base, stress = (m[1], int(m[2] or 0)) if m else (raw, 0)
        if m and base in BY_STRESS:
            sounds.append(BY_STRESS[base][stress > 0])
        else:
            sounds.append((VOWELS.get(base) or CONSONANTS.get(base) or raw.lower()) if m and (base in VOWELS or base in CONSONANTS) else base.lower())
        strong.append((stress, base in VOWELS or base in BY_STRESS) if m else (0, False))
    marks = {}
    for i, (stress, vowel) in enumerate(strong):
        if vowel and stress:
            before = [j for j in range(i) if strong[j][1]]
            if not before:
                at = 0
            else:
                cluster = sounds[before[-1] + 1 : i]
                at = i - next((n for n in range(min(3, len(cluster)), 0, -1) if _opens(cluster[-n:])), 0)
            marks[at] = "ˈ" if stress == 1 else "ˌ"
    return "".join(marks.get(i, "") + s for i, s in enumerate(sounds))


_CORE = regex.compile(r"(\P{L}*)(\p{L}[\p{L}'’]*)(\P{L}*)")


def words_in(text: str, convert: Callable[[str], str | None]) -> str:
    """A text with each word converted; spaces, marks around words and unknown words stay."""
    out = []
    for chunk in regex.split(r"(\s+)", text):
        m = _CORE.fullmatch(chunk)
        said = convert(m[2]) if m else None
        out.append(chunk if said is None else m[1] + said + m[3])
    return "".join(out)


def to_ipa(text: str | None, lang: str | None, dictionary: dict[str, str] | None = None) -> str | None:
    code = (lang or "").lower()
    if not text:
        return text
    if code.startswith("es"):
        return words_in(text, spanish_word)
    if code.startswith("en"):
        known = dictionary or {}
        return words_in(text, lambda w: arpabet(known[w.lower()]) if w.lower() in known else None)
    return text


def ipa(text: Column | str, lang: Column | str, dictionary: dict[str, str] | None = None) -> Column:
    """IPA of texts; the dictionary (word to ARPAbet) is shipped with the function and must be small, else see with_lexicon."""

    @F.pandas_udf("string")
    def said(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([to_ipa(t, x, dictionary) for t, x in zip(texts, langs, strict=True)])

    return said(text, lang)


def with_lexicon(texts: DataFrame, entries: DataFrame, key: str, text: str = "text", name: str = "ipa") -> DataFrame:
    """IPA of English texts through a dictionary table (word, arpabet) of any size: words are joined, not shipped."""
    word = r"^(\P{L}*)(\p{L}[\p{L}'’]*)(\P{L}*)$"
    parts = texts.select(key, F.posexplode(F.split(text, r"(?<=\s)(?=\S)|(?<=\S)(?=\s)")).alias("pos", "chunk")).withColumn("word", F.lower(F.nullif(F.regexp_extract("chunk", word, 2), F.lit(""))))

    @F.pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        return s.map(lambda x: arpabet(x) if isinstance(x, str) else None)

    known = entries.groupBy(F.lower("word").alias("word")).agg(F.min("arpabet").alias("arpabet")).select("word", convert("arpabet").alias("said"))
    joined = parts.join(known, "word", "left")
    out = F.when(F.col("said").isNull(), F.col("chunk")).otherwise(F.concat(F.regexp_extract("chunk", word, 1), "said", F.regexp_extract("chunk", word, 3)))
    spoken = joined.withColumn("out", out).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]), "").alias(name))
    return texts.join(spoken, key, "left")


def third_tone(reading: Column | str) -> Column:
    """Tone sandhi: of syllables of the third tone in a row all but the last take the second."""
    r = F.col(reading) if isinstance(reading, str) else reading
    syllables = F.filter(F.split(r, " "), lambda s: s != "")
    third = lambda s: F.coalesce(s.rlike("[ǎěǐǒǔǚ]"), F.lit(False))

    def changed(every: Column) -> Column:
        return F.transform(every, lambda s, i: F.when(third(s) & third(F.get(every, i + 1)), F.translate(s, "ǎěǐǒǔǚ", "áéíóúǘ")).otherwise(s))

    # bound: else a reading would be split again for each of its syllables
    return F.array_join(bound(syllables, changed), " ")


def tidy(reading: str) -> str:
    """Half-width marks, no space before them or after opening ones."""
    plain = "".join(" " if c == "　" else chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in reading)
    plain = regex.sub(r"\s+([,.!?;:、。)\]}”’」』》】])", r"\1", plain)
    plain = regex.sub(r"([(\[{“‘「『《【])\s+", r"\1", plain)
    return regex.sub(r"\s+", " ", plain).strip()


def pinyin(text: str, reading: Callable[[str], str]) -> str:
    """Pinyin of a text: `reading` gives spaced syllables of a run without marks; sandhi stays within the run."""
    out = []
    for i, part in enumerate(regex.split(r"(\s+|[^\p{L}\p{N}\s]+)", text)):
        if i % 2:
            out.append(" " if part.isspace() else f" {part} ")
        elif part:
            syllables = reading(part).split()
            low = [bool(regex.search("[ǎěǐǒǔǚ]", s)) for s in syllables]
            out.append(" ".join(s.translate(str.maketrans("ǎěǐǒǔǚ", "áéíóúǘ")) if low[j] and j + 1 < len(low) and low[j + 1] else s for j, s in enumerate(syllables)))
    return tidy("".join(out))


def tidied(reading: Column) -> Column:
    """tidy() as a column."""
    plain = F.regexp_replace(halfwidth(reading), r"\s+([,.!?;:、。)\]}”’」』》】])", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"([(\[{“‘「『《【])\s+", "$1"), r"\s+", " "))


def pinyin_of(text: Column | str, readings: dict[str, str]) -> Column:
    """Pinyin of texts from the readings of single characters (a small dictionary); other characters stay, sandhi ends at marks and spaces."""
    table = F.create_map(*(F.lit(x) for pair in readings.items() for x in pair))

    def said(part: Column) -> Column:
        syllables = F.transform(F.regexp_extract_all(part, F.lit(f"[{HAN}]|[^{HAN}]+"), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), c))
        return third_tone(F.array_join(syllables, " "))

    parts = F.regexp_extract_all(col(text), F.lit(r"\s+|[^\p{L}\p{N}\s]+|[\p{L}\p{N}]+"), F.lit(0))
    spaced = F.transform(parts, lambda p: F.when(p.rlike(r"^\s"), " ").when(p.rlike(r"^[\p{L}\p{N}]"), said(p)).otherwise(F.concat(F.lit(" "), p, F.lit(" "))))
    return tidied(F.array_join(spaced, ""))


def pinyin_of_words(words: Column | str, readings: dict[str, str], text: str = "text") -> Column:
    """One reading for each word of an array, by place."""
    return F.transform(col(words), lambda w: pinyin_of(w[text], readings))


def annotate_pinyin(cues: DataFrame, readings: dict[str, str], lines: str = "lines") -> DataFrame:
    """Cues with `pinyin` of their lines."""
    return cues.withColumn("pinyin", pinyin_of(F.array_join(lines, " "), readings))


def annotate(cues: DataFrame, lang: str, dictionary: dict[str, str] | None = None) -> DataFrame:
    """Cues with `ipa` of their lines."""
    return cues.withColumn("ipa", ipa(F.array_join("lines", " "), F.col(lang), dictionary))
