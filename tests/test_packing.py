"""Kernels of line breaking, packing and merging."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronotext.operators import packing as P
from chronotext.schema import Style

SMALL = Style(max_chars=20, max_lines=2, min_duration_ms=1000, max_duration_ms=7000, max_cps=17, min_gap_ms=80)


def test_pack_fills_and_closes_early():
    assert P.pack(["aaaa", "bbbb", "cccc"], SMALL.with_(max_chars=10, max_lines=1), "en") == [(0, 2), (2, 3)]
    assert P.pack(["Hello", "there.", "friend"], SMALL, "en") == [(0, 2), (2, 3)]
    assert P.pack([], SMALL, "en") == []


@pytest.mark.parametrize(("text", "lines"), [("你好啊。再见", ["你好啊。", "再见"]), ("你好「世界」", ["你好", "「世界」"]), ("你好", ["你好"])])
def test_cjk_lines_respect_marks(text, lines):
    assert P.wrap_lines(text, SMALL.with_(max_chars=4), "zh") == lines


def test_latin_lines_are_balanced():
    assert P.wrap_lines("one two three four five six", SMALL, "en") == ["one two three", "four five six"]
    assert P.wrap_lines("  ", SMALL, "en") == []
    assert P.wrap_lines("supercalifragilisticexpialidocious word", SMALL, "en") == ["supercalifragilisticexpialidocious", "word"]


def test_mixed_lines_keep_latin_runs():
    lines = P.wrap_lines("我们使用 Apache Spark 处理很多数据", SMALL.with_(max_chars=14), "zh")
    assert "".join(lines).replace(" ", "") == "我们使用ApacheSpark处理很多数据"
    assert all("Apache" in x or "Apache" not in "".join(lines) or "Apa" not in x for x in lines)


def test_short_cues_merge_or_last_longer():
    style = SMALL.with_(max_duration_ms=2000, max_chars=42)
    cue = lambda a, b, t: {"start_ms": a, "end_ms": b, "lines": [t], "words": None}
    out = P.merge_short([cue(0, 500, "one"), cue(700, 4000, "two")], style, "en")
    assert [c["end_ms"] for c in out] == [620, 4000]
    out = P.merge_short([cue(0, 500, "one"), cue(600, 1900, "two")], style, "en")
    assert [(c["start_ms"], c["end_ms"], c["lines"]) for c in out] == [(0, 1900, ["one two"])]


def test_blocks():
    assert P.group_blocks(["x" * 200] * 3) == [0, 0, 1]
    assert P.group_blocks(["a"] * 7) == [0] * 6 + [1]


def test_split_proportionally():
    assert P.split_proportionally("one two three four", ["a", "bbb"]) == ["one", "two three four"]
    assert P.split_proportionally("", ["a", "b"]) == ["", ""]
    assert P.split_proportionally(" x ", ["a"]) == ["x"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc.", min_size=1, max_size=12), min_size=1, max_size=30))
def test_packing_loses_no_word_and_fits(words):
    runs = P.pack(words, SMALL, "en")
    assert [w for a, b in runs for w in words[a:b]] == words
    assert all(len(" ".join(words[a:b])) <= SMALL.capacity or b - a == 1 for a, b in runs)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=2, max_size=9), st.integers(1, 3))
def test_balanced_is_optimal(widths, lines):
    from itertools import combinations

    gaps = [0] + [1] * (len(widths) - 1)
    starts = P.balanced(widths, gaps, lines)
    if len(widths) < lines:
        assert starts is None
        return
    cost = lambda cut: max(sum(widths[a:b]) + b - a - 1 for a, b in zip(cut, [*cut[1:], len(widths)], strict=True))
    assert cost(starts) == min(cost([0, *c]) for c in combinations(range(1, len(widths)), lines - 1))
