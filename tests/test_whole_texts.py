"""Hypotheses and windows over whole texts against the scalar functions."""

import pytest

from chronotext.functions import text
from chronotext.operators import packing
from chronotext.plans import catalogue
from chronotext.streaming import live

TEXTS = ["one", "a b c d e", "a b c d e f", "", None, " ".join(f"Word{i}," for i in range(63)), "a b c d e f g h i xx2 k l", "same " * 41, "one two  three four\nfive six seven eight nine ten eleven"]


def documents(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_stable_prefix_of_whole_texts(spark, tmp_path):
    got = {(r["doc_id"], r["k"]): (r["n_before"], r["committed"]) for r in catalogue.QUERIES["stable_prefix_whole"](spark, documents(spark, tmp_path)).collect()}
    want = {}
    for doc, t in enumerate(TEXTS):
        w, before = (t or "").split(), ""
        for k in range(1, -(-len(w) // 5) + 1):
            h = w[: 5 * k]
            said = " ".join([*h[:-1], f"xx{k}"] if k % 2 == 0 else h)
            want[doc, k] = live.stable_prefix(before, said)
            before = said
        assert max([k for d, k in got if d == doc], default=0) == -(-len(w) // 5)
    assert {(d, k): " ".join([*TEXTS[d].split()[:n], *rest.split()]) for (d, k), (n, rest) in got.items()} == want


def test_strip_overlap_of_whole_texts(spark, tmp_path):
    got = {(r["doc_id"], r["window"]): r["rest"] for r in catalogue.QUERIES["strip_overlap_whole"](spark, documents(spark, tmp_path)).collect()}
    want = {}
    for doc, t in enumerate(TEXTS):
        w, before, i = (t or "").split(), "", 0
        while w and (i == 0 or 7 * i + 3 < len(w)):
            said = " ".join(w[7 * i : 7 * i + 10])
            want[doc, i + 1] = live.strip_overlap(before, said)
            before, i = said, i + 1
    assert got == want


@pytest.mark.parametrize("name", ["stable_prefix_whole", "strip_overlap_whole"])
def test_windows_are_parts_of_one_list_of_words(spark, tmp_path, name):
    """No window is a row before it is compared, and nothing is shuffled."""
    plan = catalogue.QUERIES[name](spark, documents(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Exchange" not in plan


def test_words_between_the_white_space_of_text(spark):
    odd = ["x\u00a0y\ufeffz w", "a\x1cb c\x85d", "  a\u3000b\n", ""]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", text.spaced_tokens("t").alias("w")).collect()
    assert all(packing.spaced(r["t"]) == r["w"] for r in rows)
