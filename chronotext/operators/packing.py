"""Packing words into display lines and cues: kernels in plain Python, run over Arrow batches grouped by medium.

The steps here depend on what the step before has chosen (greedy packing, merges that look back), so they are no window
functions. A kernel sees one medium's rows in order; media are dealt over the cluster.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CJK_STYLE, LATIN_STYLE, STRONG_PUNCTUATION, Style
from .media_runs import begins, by_medium

_SPACE = "\t\n\v\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_HAN = regex.compile("[㐀-䶿一-鿿]")
_LATIN = regex.compile(r"\p{Script=Latin}")
_SPACES = regex.compile(f"[{_SPACE}]+")
_ODD_SPACES = "\x1c\x1d\x1e\x1f\x85\ufeff"  # str.split() takes them for what they are not here
_CLUSTER = regex.compile(r"\X")
#: Marks that may not begin, and that may not end, a line of CJK text.
_NOT_FIRST, _NOT_LAST = set("、。，！？：；」』）】》"), set("「『（【《")


def cjk_language(lang: str | None) -> bool:
    return (lang or "").strip().lower().startswith(("zh", "cmn", "ja", "ko"))


def script(text: str) -> str:
    if text.isascii():
        return "latin"
    han = len(_HAN.findall(text))
    if not han:
        return "latin"
    latin = len(_LATIN.findall(text))
    if not latin:
        return "cjk"
    share = han / (han + latin)
    return "latin" if share < 0.15 else "cjk" if 1 - share < 0.15 else "mixed"


def collapse(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


def spaced(text: str) -> list[str]:
    """What stands between white space."""
    return [t for t in _SPACES.split(text) if t] if any(c in text for c in _ODD_SPACES) else text.split()


@lru_cache(1 << 16)
def visible_length(text: str) -> int:
    if text.isascii():
        return len(_SPACES.sub("", text))
    return sum(1 for c in _CLUSTER.findall(text) if not _SPACES.search(c))


def joined(texts: Iterable[str], lang: str | None) -> str:
    texts = list(texts)
    spaced = " ".join(texts)
    return "".join(texts) if cjk_language(lang) or script(spaced) == "cjk" else spaced


def tokens(text: str, lang: str | None) -> list[str]:
    if cjk_language(lang) or script(text) == "cjk":
        return regex.findall(f"[㐀-䶿一-鿿]|[^㐀-䶿一-鿿{_SPACE}]+", text)
    return spaced(text)


def deal(texts: list[str | None], langs: list[str | None], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """The time of each text dealt to its words by visible length (1 at least): where the words of each begin (and the end of all), words, starts, ends.

    Times that are not known are NaN.
    """
    each = [tokens(t, x) if t else [] for t, x in zip(texts, langs, strict=True)]
    counts = np.fromiter(map(len, each), np.int64, len(each))
    at, words = np.concatenate([[0], np.cumsum(counts)]), [w for own in each for w in own]
    shares = np.fromiter((len(w) if w.isascii() else max(1, visible_length(w)) for w in words), np.int64, len(words))
    upto, whose = np.concatenate([[0], np.cumsum(shares)]), np.repeat(np.arange(len(each)), counts)
    so_far, whole = upto[1:] - upto[at[:-1]][whose], (upto[at[1:]] - upto[at[:-1]])[whose]
    s, e = np.asarray(start, np.float64)[whose], np.asarray(end, np.float64)[whose]
    border = s + np.floor((e - s) * so_far / whole + 0.5)
    last = at[1:][counts > 0] - 1
    border[last] = e[last]
    border = np.where(e <= s, s, border)
    begin = np.concatenate([s[:1], border[:-1]])
    first = at[:-1][counts > 0]
    begin[first] = s[first]
    return at, words, np.where(np.isnan(begin), s, begin), border


def balanced(widths: list[int], gaps: list[int], lines: int) -> list[int] | None:
    """Where to begin each of exactly `lines` lines so that the longest is shortest; gaps[i] is the space before item i.

    Of equally good breaks the earliest is taken, from the last line backwards. None if there are fewer items than lines.
    """
    n = len(widths)
    if lines < 1 or n < lines:
        return None
    ends = [0]
    for w, g in zip(widths, gaps, strict=True):
        ends.append(ends[-1] + w + g)
    if lines == 2:
        longest = [max(ends[p] - gaps[0], ends[n] - ends[p] - gaps[p]) for p in range(1, n)]
        return [0, longest.index(min(longest)) + 1]
    width = lambda a, b: ends[b] - ends[a] - gaps[a]
    cost: list[dict[int, int]] = [{0: 0}]
    back: list[dict[int, int]] = [{}]
    for used in range(1, lines + 1):
        cost.append({}), back.append({})
        for stop in range(used, n + 1):
            at = min((p for p in range(used - 1, stop) if p in cost[used - 1]), key=lambda p, u=used, s=stop: max(cost[u - 1][p], width(p, s)))
            cost[used][stop], back[used][stop] = max(cost[used - 1][at], width(at, stop)), at
    starts, stop = [], n
    for used in range(lines, 0, -1):
        stop = back[used][stop]
        starts.append(stop)
    return starts[::-1]


def _broken(items: list[str], widths: list[int], gaps: list[int], style: Style, fits) -> list[str]:
    """Items in as few lines as fit, two at least; all lines if none fits."""
    lines: list[str] | None = None
    for k in range(2, max(1, style.max_lines) + 1):
        starts = balanced(widths, gaps, k)
        if starts is None:
            continue
        lines = [render(items, gaps, a, b) for a, b in zip(starts, [*starts[1:], len(items)], strict=True)]
        if fits(starts, lines):
            return lines
    last = balanced(widths, gaps, max(1, style.max_lines))
    if last is None:
        return [render(items, gaps, 0, len(items))]
    return [render(items, gaps, a, b) for a, b in zip(last, [*last[1:], len(items)], strict=True)]


def render(items: list[str], gaps: list[int], a: int, b: int) -> str:
    return items[a] + "".join(" " * gaps[i] + items[i] for i in range(a + 1, b)) if b > a else ""


def wrap_latin(text: str, style: Style) -> list[str]:
    words = [w for w in _SPACES.split(text) if w]
    if not words:
        return []
    whole = " ".join(words)
    if len(words) == 1 or len(whole) <= style.max_chars:
        return [whole]
    widths, gaps = [visible_length(w) for w in words], [0] + [1] * (len(words) - 1)

    def fits(starts, lines):
        return all(sum(widths[a:b]) + b - a - 1 <= style.max_chars for a, b in zip(starts, [*starts[1:], len(words)], strict=True))

    return _broken(words, widths, gaps, style, fits)


def wrap_cjk(text: str, style: Style) -> list[str]:
    chars = _SPACES.sub("", text)
    most = max(1, style.max_chars)
    count = min(max(1, style.max_lines), -(-len(chars) // most))
    if count <= 1:
        return [chars] if chars else []
    lines, at = [], 0
    for left in range(count, 0, -1):
        stop = len(chars) if left == 1 else min(len(chars), at - (at - len(chars)) // left)
        if left > 1:
            while stop - 1 > at and chars[stop - 1] in _NOT_LAST:
                stop -= 1
            while stop < len(chars) and chars[stop] in _NOT_FIRST:
                stop += 1
        stop = max(stop, min(at + 1, len(chars)))
        lines.append(chars[at:stop])
        at = stop
    return lines


def wrap_mixed(text: str, style: Style) -> list[str]:
    items, gaps = [], []
    for m in regex.finditer(f"([{_SPACE}]*)([㐀-䶿一-鿿]|[^㐀-䶿一-鿿{_SPACE}]+)", text):
        items.append(m[2])
        gaps.append(1 if m[1] else 0)
    if not items:
        return []
    widths = [1 if _HAN.match(x) else visible_length(x) for x in items]
    if len(items) == 1 or sum(widths) + sum(gaps[1:]) <= style.max_chars:
        return [render(items, gaps, 0, len(items))]
    return _broken(items, widths, gaps, style, lambda _, lines: all(len(x) <= style.max_chars for x in lines))


def wrap_lines(text: str, style: Style, lang: str | None) -> list[str]:
    """Text as at most `max_lines` balanced lines; words are never broken, so a line may be too long."""
    plain = collapse(text)
    if not plain:
        return []
    kind = script(plain)
    if kind == "cjk":
        return wrap_cjk(plain, style)
    return wrap_mixed(plain, style) if kind == "mixed" and cjk_language(lang) else wrap_latin(plain, style)


def wrapped(text: Column, lang: Column, style: Style = LATIN_STYLE, cjk_style: Style = CJK_STYLE) -> Column:
    """wrap_lines() over a column, in the style of each row's language."""

    @F.pandas_udf("array<string>")
    def lines(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([wrap_lines(t or "", cjk_style if cjk_language(x) else style, x) for t, x in zip(texts, langs, strict=True)])

    return lines(text, lang)


def pack(texts: list[str], style: Style, lang: str | None) -> list[tuple[int, int]]:
    """Runs (first, end) of words: cut where the next word would not fit, and after strong punctuation from a quarter full on."""
    if cjk_language(lang) or _HAN.search(" ".join(texts)):
        size = lambda a, b: len(joined(texts[a:b], lang))
    else:
        ends = [0]
        for t in texts:
            ends.append(ends[-1] + len(t) + 1)
        size = lambda a, b: ends[b] - ends[a] - 1
    runs, first = [], 0
    for i, text in enumerate(texts):
        if i > first and size(first, i + 1) > style.capacity:
            runs.append((first, i))
            first = i
        if style.capacity > 0 and text and text[-1] in STRONG_PUNCTUATION and size(first, i + 1) >= style.capacity / 4:
            runs.append((first, i + 1))
            first = i + 1
    if first < len(texts):
        runs.append((first, len(texts)))
    return runs


def _cue_text(cue: dict, lang: str | None) -> str:
    return joined([w["text"] for w in cue["words"]] if cue["words"] else cue["lines"], lang)


def _both(a: str, b: str, lang: str | None) -> str:
    return joined([x for x in (a, b) if x], lang) if a and b else a or b


#: A cue as start, end, the text to show, and the first and last (excluded) of what it is made of.
Span = tuple[float, float, str, int, int]


def merge_spans(spans: list[Span], style: Style, lang: str | None, said: Callable[[Span], str]) -> list[Span]:
    """A cue shorter than the least duration joins the next, else the one before, else lasts longer where there is room.

    `said` gives the text of a cue as it goes into another.
    """

    def together(a: Span, b: Span) -> Span | None:
        if b[1] - a[0] > style.max_duration_ms:
            return None
        text = _both(said(a), said(b), lang)
        return None if len(text) > style.capacity else (a[0], b[1], text, a[3], b[4])

    done: list[Span] = []  # what stands before the cue at hand
    todo = spans[::-1]
    while todo:
        cue = todo.pop()
        if cue[1] - cue[0] >= style.min_duration_ms:
            done.append(cue)
        elif todo and (new := together(cue, todo[-1])):
            todo[-1] = new
        elif done and (new := together(done[-1], cue)):
            done.pop()
            todo.append(new)
        else:
            room = cue[0] + style.max_duration_ms
            if todo:
                room = min(room, todo[-1][0] - style.min_gap_ms)
            done.append((cue[0], max(cue[1], min(cue[0] + style.min_duration_ms, room)), *cue[2:]))
    return done


def merge_short(cues: list[dict], style: Style, lang: str | None) -> list[dict]:
    """merge_spans() over cues with lines and words; a merged cue has words only if all its parts have."""
    spans = [(c["start_ms"], c["end_ms"], _cue_text(c, lang), i, i + 1) for i, c in enumerate(cues)]

    def words_of(a: int, b: int) -> list[dict] | None:
        return None if any(c["words"] is None for c in cues[a:b]) else [w for c in cues[a:b] for w in c["words"]]

    def said(s: Span) -> str:
        if words := words_of(s[3], s[4]):
            return joined([w["text"] for w in words], lang)
        return s[2] if s[4] - s[3] == 1 else joined(wrap_lines(s[2], style, lang), lang)

    out = []
    for start, end, text, a, b in merge_spans(spans, style, lang, said):
        if b - a == 1:
            out.append(cues[a] | {"start_ms": start, "end_ms": end})
        else:
            out.append({"start_ms": start, "end_ms": end, "lines": wrap_lines(text, style, lang), "words": words_of(a, b)})
    return out


def blocks_of(sizes: list[int], most: int = 6, most_chars: int = 400) -> list[int]:
    """The block of each size: consecutive ones, up to `most` and `most_chars` together."""
    out, block, count, size = [], 0, 0, 0
    for n in sizes:
        if count and (count >= most or size + n > most_chars):
            block, count, size = block + 1, 0, 0
        out.append(block)
        count, size = count + 1, size + n
    return out


def group_blocks(texts: list[str], most: int = 6, most_chars: int = 400) -> list[int]:
    """The block of each text, by visible UTF-16 units."""
    return blocks_of([len(_SPACES.sub("", t).encode("utf-16-le")) // 2 for t in texts], most, most_chars)


def _border(starts: list[int], stops: list[int], low: int, high: int, ideal: int) -> tuple[int, int] | None:
    """The white space nearest to `ideal` that lies within low..high: where it begins and ends; of two, the first."""
    first, last = bisect_left(starts, low), bisect_right(stops, high)
    if first >= last:
        return None
    at = min(max(bisect_left(starts, ideal), first), last - 1)
    if at > first and ideal - starts[at - 1] <= starts[at] - ideal:
        at -= 1
    return starts[at], stops[at]


def split_proportionally(text: str, parts: list[str]) -> list[str]:
    """A text cut in as many pieces as `parts`, by their visible lengths, at white space where there is any; no piece is empty if that can be."""
    text, n = text.strip(), len(parts)
    if n and not text:
        return [""] * n
    sizes = [len(_SPACES.sub("", p)) for p in parts]
    shares = np.cumsum(sizes if any(sizes) else [1] * n)
    gaps = [m.span() for m in _SPACES.finditer(text)]
    starts, stops = [a for a, _ in gaps], [b for _, b in gaps]
    pieces, here = [], 0
    for i in range(n - 1):
        ideal = int(len(text) * int(shares[i]) / int(shares[-1]) + 0.5)
        # one character at least for this piece and for each that follows
        low = here + 1
        high = max(low, len(text) - (n - 1 - i))
        cut = _border(starts, stops, low, high, ideal)
        if cut is None or not text[here : cut[0]].strip():
            cut = (min(max(ideal, low), high),) * 2
        pieces.append(text[here : cut[0]].strip())
        here = cut[1]
    return [*pieces, text[here:].strip()] if n else []


CUE_SCHEMA = "cue int, start_ms double, end_ms double, lines array<string>, words array<struct<text:string,start_ms:double,end_ms:double>>"


def packed_cues(words: DataFrame, by: list[str], segment: str, place: str, lang: str, style: Style = LATIN_STYLE, cjk_style: Style = CJK_STYLE, merge: bool = True) -> DataFrame:
    """Cues from words with times (by, segment, place, lang, text, start_ms, end_ms), before overlaps are mended.

    A cue is a run of words; the words of all cues stay one Arrow array, of which each cue has a part.
    """
    types = dict(words.dtypes)

    def build(rows: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        texts, starts, ends, codes = rows["text"].to_pylist(), rows["start_ms"].to_pylist(), rows["end_ms"].to_pylist(), rows[lang].to_pylist()
        parts = np.union1d(begins(rows["_segment"]), at).tolist()
        spans, medium, number, lines, where = [], [], [], [], 0
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            code = codes[a]
            use = cjk_style if cjk_language(code) else style
            own = []
            while parts[where] < b:
                first, last = parts[where], parts[where + 1]
                said = texts[first:last]
                own += [(starts[first + i], ends[first + j - 1], joined(said[i:j], code), first + i, first + j) for i, j in pack(said, use, code)]
                where += 1
            if merge:
                own = merge_spans(own, use, code, lambda s, code=code: joined(texts[s[3] : s[4]], code))
            spans += own
            lines += [wrap_lines(s[2], use, code) for s in own]
            medium += [a] * len(own)
            number += range(len(own))
        first = pa.array([s[3] for s in spans] + [len(texts)], pa.int32())
        column = lambda c, t: rows[c].combine_chunks().cast(t) if isinstance(rows[c], pa.ChunkedArray) else rows[c].cast(t)
        timed = pa.StructArray.from_arrays([column("text", pa.string()), column("start_ms", pa.float64()), column("end_ms", pa.float64())], ["text", "start_ms", "end_ms"])
        keys = [rows[k].take(pa.array(medium, pa.int64())).combine_chunks() for k in by]
        return pa.RecordBatch.from_arrays(
            [*keys, pa.array(number, pa.int32()), pa.array([s[0] for s in spans], pa.float64()), pa.array([s[1] for s in spans], pa.float64()), pa.array(lines, pa.list_(pa.string())), pa.ListArray.from_arrays(first, timed)],
            [*by, "cue", "start_ms", "end_ms", "lines", "words"],
        )

    told = words.select(*by, F.col(place).alias("_place"), F.col(segment).alias("_order"), F.xxhash64(segment).alias("_segment"), lang, "text", F.col("start_ms").cast("double").alias("start_ms"), F.col("end_ms").cast("double").alias("end_ms"))
    return by_medium(told, by, ["_order", "_place"], build, ", ".join(f"`{k}` {types[k]}" for k in by) + ", " + CUE_SCHEMA)


def segment_cues(segments: DataFrame, by: list[str], segment: str, lang: str, style: Style = LATIN_STYLE, cjk_style: Style = CJK_STYLE, merge: bool = True) -> DataFrame:
    """(by, index, start_ms, end_ms, n_words, lines): mended and numbered cues of segments (by, segment, lang, text, start_ms, end_ms).

    What distribute_words, packed_cues, fix_overlaps and reindex give in turn, with one shuffle, that of the segments: words are
    made where a medium's cues are, and ends are cut to the next start there.
    """
    types = dict(segments.dtypes)

    def build(rows: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        codes, texts = rows[lang].to_pylist(), rows["text"].to_pylist()
        start, end = (rows[c].to_numpy().astype(np.float64) for c in ("start_ms", "end_ms"))
        medium, number, starts, ends, sizes, lines = [], [], [], [], [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            code = codes[a]
            use = cjk_style if cjk_language(code) else style
            parts, words, s, e = deal(texts[a:b], codes[a:b], start[a:b], end[a:b])
            parts, s, e, own = parts.tolist(), s.tolist(), e.tolist(), []
            for first, last in zip(parts[:-1], parts[1:], strict=True):
                said = words[first:last]
                own += [(s[first + i], e[first + j - 1], joined(said[i:j], code), first + i, first + j) for i, j in pack(said, use, code)]
            if merge:
                own = merge_spans(own, use, code, lambda x, code=code, words=words: joined(words[x[3] : x[4]], code))
            index = 0
            for i, cue in enumerate(own):
                stop = min(cue[1], own[i + 1][0] - use.min_gap_ms) if i + 1 < len(own) else cue[1]
                if stop > cue[0]:
                    index += 1
                    medium.append(a), number.append(index), starts.append(cue[0]), ends.append(stop), sizes.append(cue[4] - cue[3]), lines.append(wrap_lines(cue[2], use, code))
        keys = [rows[k].take(pa.array(medium, pa.int64())).combine_chunks() for k in by]
        return pa.RecordBatch.from_arrays(
            [*keys, pa.array(number, pa.int32()), pa.array(starts, pa.float64()), pa.array(ends, pa.float64()), pa.array(sizes, pa.int32()), pa.array(lines, pa.list_(pa.string()))],
            [*by, "index", "start_ms", "end_ms", "n_words", "lines"],
        )

    told = segments.select(*by, F.col(segment).alias("_order"), lang, "text", F.col("start_ms").cast("double").alias("start_ms"), F.col("end_ms").cast("double").alias("end_ms"))
    return by_medium(told, by, ["_order"], build, ", ".join(f"`{k}` {types[k]}" for k in by) + ", index int, start_ms double, end_ms double, n_words int, lines array<string>")


def cps(lines: Column | str, start: Column | str, end: Column | str) -> Column:
    """Visible characters a second of a cue; 0 without a duration."""
    from ..functions.text import col, visible_length as visible

    size = F.aggregate(F.transform(col(lines), visible), F.lit(0), lambda a, x: a + x)
    seconds = (col(end) - col(start)) / 1000
    return F.when(seconds > 0, size / seconds).otherwise(0.0)


def cue_blocks(cues: DataFrame, by: list[str], order: str, text: str, most: int = 6, most_chars: int = 400) -> DataFrame:
    """`cues` with their block, from one pass over each medium's texts in order."""
    from ..functions.text import utf16_length

    names = cues.columns

    def number(rows: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        sizes, out = rows["_size"].to_pylist(), []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            out += blocks_of(sizes[a:b], most, most_chars)
        return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() for c in names), pa.array(out, pa.int32())], [*names, "block"])

    told = cues.withColumn("_size", utf16_length(F.coalesce(F.col(text), F.lit("")), spaces=False))
    return by_medium(told, by, [order], number, ", ".join(f"`{c}` {t}" for c, t in [*cues.dtypes, ("block", "int")]))
