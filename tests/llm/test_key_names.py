"""Key columns that bear the names of columns inside an operator, or of its results."""

import pytest

from chronotext.llm import decontam, jaccard, tokencount
from chronotext.llm.queries import tokenizer_path

ROWS = [(1, "the quick brown fox jumps over the lazy dog and runs far away"), (2, "the quick brown fox jumps over the lazy dog and runs far away"), (None, "another text of a few words"), (3, None), (1, "")]


@pytest.mark.parametrize("name", ["unit", "row"])
def test_keys_of_any_name(spark, name):
    docs = spark.createDataFrame(ROWS, f"{name} long, text string")
    counted = tokencount.count(docs, tokenizer_path("word_bpe_49k.json"), key=name)
    assert counted.columns == [name, "n_bytes", "n_tokens"] and counted.count() == len(ROWS)
    assert sorted(r["n_tokens"] for r in counted.where(f"`{name}` = 1").collect())[0] == 0
    benchmark = spark.createDataFrame([("i", "quick brown fox jumps over the lazy dog and runs"), ("j", "a few words")], "item_id string, text string")
    for block_bytes in (1 << 20, 50):
        found = decontam.find(docs, benchmark, key=name, block_bytes=block_bytes)
        assert sorted((r[name] or 0, r["n_words"], sorted(r["items"])) for r in found.collect()) == sorted([(1, 13, ["i"]), (2, 13, ["i"]), (0, 6, ["j"]), (3, 0, []), (1, 0, [])])
        kept = decontam.cut(docs, benchmark, key=name, block_bytes=block_bytes)
        assert kept.columns == docs.columns and kept.count() in (4, 5)


@pytest.mark.parametrize("name", ["node"])
def test_keys_of_the_join(spark, name):
    docs = spark.createDataFrame(ROWS, f"{name} long, text string")
    got = jaccard.classes(docs, 3, 90, 100, key=name)
    assert got.columns == [name, "n_shingles", "component_id"]
    assert sorted((r[name] or 0, r["n_shingles"], r["component_id"] or 0) for r in got.collect()) == [(0, 4, 0), (1, 0, 1), (1, 11, 1), (2, 11, 1), (3, 0, 3)]


def test_keys_with_the_name_of_a_result_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "n_tokens long, text string")
    with pytest.raises(ValueError, match="result"):
        tokencount.count(docs, tokenizer_path("word_bpe_49k.json"), key="n_tokens")
    with pytest.raises(ValueError, match="result"):
        jaccard.classes(docs.withColumnRenamed("n_tokens", "component_id"), 3, 90, 100, key="component_id")


def test_a_benchmark_of_several_blocks_keeps_rows_apart(spark):
    """Null keys and many repeated rows: a row each, whatever is the same in them."""
    rows = [(None, ROWS[0][1])] * 40 + [(7, ROWS[0][1])] * 40 + [(7, ROWS[2][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame([("i", "quick brown fox jumps over the lazy dog and runs"), ("j", "a few words"), ("k", "brown fox jumps over the lazy dog and runs far")], "item_id string, text string")
    one, many = (sorted((r["doc_id"] or 0, r["n_words"], [tuple(s) for s in r["spans"]], sorted(r["items"])) for r in decontam.find(docs, benchmark, block_bytes=b).collect()) for b in (1 << 20, 60))
    assert one == many and len(many) == len(rows)
    assert sorted(map(str, decontam.cut(docs, benchmark, block_bytes=60).collect())) == sorted(map(str, decontam.cut(docs, benchmark).collect()))
