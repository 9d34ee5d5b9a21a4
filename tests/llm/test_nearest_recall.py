"""What the scan of four-bit tables leaves to measure, and how many of the nearest it finds, on the tables at hand."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from chronotext.llm import ann

FOLDERS = [f for f in ("/root/testdata/sf0.01", "/root/testdata/sf0.1", "/root/testdata/check_h") if os.path.exists(f)]


@pytest.mark.parametrize("folder", FOLDERS)
def test_recall_of_the_tables(spark, folder):
    indexed, book = ann.index(spark.read.parquet(f"{folder}/embeddings.parquet"))
    got = {}
    for r in ann.search(indexed, book, indexed.where("id % 100 = 0").select("id", "vector")).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    rows = pq.read_table(f"{folder}/embeddings.parquet")
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_pylist()).astype(np.float32).astype(np.float64)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        hits += len(set(want) & set(got[q]))
        total += 10
        assert all(abs(d[ids == i][0] - s) < 1e-9 for i, s in got[q].items())
    assert hits / total >= 0.95


def test_few_vectors_are_measured():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64)).astype(np.float32)
    book = ann.fit(x[:1000], 64)
    nodes = ann.Nodes(np.arange(len(x)), x, ann.pack(book.encode(x)).T.copy(), 10)
    table = book.tables(x[:50])
    estimate = sum(np.take(table[:, b], nodes.codes[b], axis=1) for b in range(len(nodes.codes))) - nodes.half
    listed = ann.shortlist(estimate, nodes.code, 10)
    assert np.mean([len(a) for a in listed]) <= 0.1 * len(nodes.half)
    found = [len(set(np.argsort(((nodes.x - q) ** 2).sum(1))[:11]) & set(a)) for q, a in zip(x[:50].astype(float), listed, strict=True)]
    assert np.mean(found) >= 0.95 * 11
