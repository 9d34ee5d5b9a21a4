"""Block-wise translation of cues through a given translator, and the routes between languages."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import language_tag
from ..schema import CJK_STYLE, LANGUAGES, LATIN_STYLE
from .media_runs import by_medium
from .packing import cjk_language, group_blocks, joined, split_proportionally, wrap_lines

#: texts, source, target -> texts
Translator = Callable[[list[str], str, str], list[str]]
PIVOT = "en"


def identity(texts: list[str], source: str, target: str) -> list[str]:
    return list(texts)


def from_dictionary(words: dict[str, str]) -> Translator:
    return lambda texts, source, target: [" ".join(words.get(w.lower(), w) for w in t.split()) for t in texts]


def in_batches(translator: Translator, most: int = 8) -> Translator:
    """A translator that is given `most` texts at a time, none of them empty; an empty translation leaves the text as it is."""

    def run(texts: list[str], source: str, target: str) -> list[str]:
        out, full = list(texts), [i for i, t in enumerate(texts) if t.strip()]
        for a in range(0, len(full), most):
            some = full[a : a + most]
            for i, said in zip(some, translator([texts[i] for i in some], source, target), strict=True):
                out[i] = said if said.strip() else texts[i]
        return out

    return run


def by_route(models: dict[tuple[str, str], Translator], pivot: str = PIVOT) -> Translator:
    """A translator over models of single directions: the one from source to target, else through the pivot language."""

    def run(texts: list[str], source: str, target: str) -> list[str]:
        way = [] if source == target else [(source, target)] if (source, target) in models else [(source, pivot), (pivot, target)]
        for step in way:
            if step not in models:
                raise KeyError(f"no model translates {step[0]} to {step[1]}")
            texts = models[step](texts, *step)
        return list(texts)

    return run


def routes(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """`pairs` with the languages on the way: none if equal, one step to or from English, else through it; null if unknown."""
    a, b = language_tag(source), language_tag(target)
    way = F.when(a == b, F.array().cast("array<string>")).when((a == PIVOT) | (b == PIVOT), F.array(a, b)).otherwise(F.array(a, F.lit(PIVOT), b))
    return pairs.withColumn("route", F.when(a.isin(LANGUAGES) & b.isin(LANGUAGES), way))


def translate_cues(cues: DataFrame, by: list[str], order: str, text: str, source: str, target: str, translator: Translator = identity, most: int = 6, most_chars: int = 400) -> DataFrame:
    """(by, order, translation, error): blocks of consecutive cues translated together and cut apart again.

    A block that fails is tried cue by cue; a cue that fails keeps its text and carries the error. `by` names one medium.
    """
    types = dict(cues.dtypes)

    def translated(texts: list[str]) -> tuple[list[str], list[str | None]]:
        out, errors = list(texts), [None] * len(texts)
        blocks = group_blocks(texts, most, most_chars)
        first = 0
        while first < len(texts):
            last = first
            while last < len(texts) and blocks[last] == blocks[first]:
                last += 1
            own = texts[first:last]
            try:
                whole = translator([joined(own, source)], source, target)[0]
                out[first:last] = list(split_proportionally(whole, own))
            except Exception:
                for i in range(first, last):
                    try:
                        out[i] = translator([texts[i]], source, target)[0]
                    except Exception as e:  # the cue keeps its text; the error is its row's
                        errors[i] = str(e)
            first = last
        return out, errors

    def run(rows: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        texts = [t or "" for t in rows["_text"].to_pylist()]
        parts = [translated(texts[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        out, errors = ([x for p in parts for x in p[i]] for i in (0, 1))
        return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() for c in [*by, order]), pa.array(out, pa.string()), pa.array(errors, pa.string())], [*by, order, "translation", "error"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in [*by, order]) + ", translation string, error string"
    return by_medium(cues.select(*by, order, F.col(text).alias("_text")), by, [order], run, schema)


def translated_cues(cues: DataFrame, translations: DataFrame, by: list[str], order: str, target: str) -> DataFrame:
    """Cues with their translation broken into lines, timed as before and without words."""
    style = CJK_STYLE if cjk_language(target) else LATIN_STYLE

    @F.pandas_udf("array<string>")
    def lines(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: wrap_lines(t or "", style, target))

    said = translations.select(*by, order, F.col("translation").alias("_t"))
    return cues.join(said, [*by, order], "left").withColumn("lines", lines(F.coalesce("_t", F.array_join("lines", " ")))).drop("_t", "words")
