"""Comparing hypotheses of one utterance, as Column expressions over texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, col, collapse, matchable, spaced_tokens


def _ends(text: Column, count: Column) -> Column:
    """The text up to the end of its token number `count` (from 1)."""
    parts = F.regexp_extract_all(text, F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0))
    return F.array_join(F.slice(parts, F.lit(1), count), "")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is found once, however often f names it: inside lambdas Spark does not share what it has found."""
    return F.get(F.transform(F.array(value), f), 0)


def _both(previous: Column, following: Column) -> Column:
    return F.struct(F.transform(spaced_tokens(previous), matchable).alias("a"), F.transform(spaced_tokens(following), matchable).alias("b"))


def stable_prefix(previous: Column | str, following: Column | str) -> Column:
    """The longest run of first words that two hypotheses share, as the later one writes it."""
    before, after = col(previous), col(following)

    def shared(t: Column) -> Column:
        n = F.least(F.size(t["a"]), F.size(t["b"]))
        same = F.zip_with(F.slice(t["a"], F.lit(1), n), F.slice(t["b"], F.lit(1), n), lambda x, y: x == y)
        return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n).cast("int")

    return bound(bound(_both(before, after), shared), lambda count: F.when(count <= 0, F.lit("")).otherwise(F.trim(_ends(after, count))))


def strip_overlap(previous: Column | str, following: Column | str) -> Column:
    """The later text without the words at its start that the earlier one ends with, as many as possible."""
    before, after = col(previous), col(following)

    def overlap(t: Column) -> Column:
        n = F.least(F.size(t["a"]), F.size(t["b"]))
        lengths = F.when(n > 0, F.sequence(n, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        found = F.filter(lengths, lambda k: F.slice(t["a"], -k, k) == F.slice(t["b"], F.lit(1), k))
        return F.struct(F.coalesce(F.get(found, F.lit(0)), F.lit(0)).alias("k"), F.size(t["b"]).alias("n"))

    def rest(o: Column) -> Column:
        parts = F.slice(F.regexp_extract_all(after, F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0)), o["k"] + 1, F.greatest(o["n"] - o["k"], F.lit(0)))
        return F.when(o["n"] == 0, F.lit("")).when(o["k"] == 0, collapse(after)).otherwise(F.regexp_replace(F.array_join(parts, ""), f"^[{SPACE}]+|[{SPACE}]+$", ""))

    return bound(bound(_both(before, after), overlap), rest)
