"""The pipeline's stages, one by one and together, against plain Python over whole small tables."""

import re

import numpy as np
import plain_models as plain
import pytest

import corpus_pipeline
from chronotext.llm.queries import tokenizer_path

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
NAMES = [n for n, _ in corpus_pipeline.STAGES]


def shingles(text, k=5):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def firsts(rows):
    """Of the rows (in the order of their keys, null last) those that no link leads to an earlier one, by classes."""
    sets, parent = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [r for i, r in enumerate(rows) if find(i) == i]


def without(text, items, size=10):
    """The text without the words inside windows of the items, and whether a word is left; None: no hit."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for t in items:
        w = re.findall(word, (t or "").translate(LOWER))
        n = min(size, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    at = [(m.start(), m.end(), m[0].translate(LOWER)) for m in re.finditer(word, text or "")]
    hit = np.zeros(len(at) + 1, bool)
    for n in {len(w) for w in windows}:
        for i in range(len(at) - n + 1):
            if tuple(x[2] for x in at[i : i + n]) in windows:
                hit[i : i + n] = True
    if not hit.any():
        return text, True
    out, done, i = [], 0, 0
    while i < len(at):
        if hit[i]:
            j = i
            while j < len(at) and hit[j]:
                j += 1
            out.append(text[done : at[i][0]])
            done, i = at[j - 1][1], j
        else:
            i += 1
    return " ".join([*out, text[done:]]), not hit[: len(at)].all()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark: copies, near copies, toxic rows, passages of the benchmark, empty and null texts."""
    random = np.random.default_rng(11)
    words = {"en": [f"{a}{b}" for a in ("the", "gar", "hou", "ri", "wa") for b in ("den", "se", "ver", "ter", "and", "ing")], "fr": [f"{a}{b}" for a in ("le", "mai", "jar", "ri", "é") for b in ("son", "din", "vière", "cole", "aux", "ment")]}
    items = [" ".join(random.choice(words["en"], 14)) for _ in range(5)] + ["short item here"]
    rows, labels = [], []
    for i in range(260):
        lang = "en" if i % 3 else "fr"
        text = list(random.choice(words[lang], int(random.integers(30, 70))))
        toxic = i % 9 == 0
        if toxic:
            text[5:5] = ["vilslur", "hatword", "vilslur"]
        if i % 20 == 7:
            text[10:10] = items[i // 20 % 6].split()
        text = " ".join(text)
        if i % 10 == 4:
            text = rows[-1][1]
        if i % 10 == 6:
            text = rows[-1][1] + " end"
        rows.append((i, text, lang, "web", len(text)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    rows += [(300, None, "en", "web", None), (301, "", "en", None, 0), (302, "12 34 !?", None, "web", 8), (None, "the garden house was there and the river", "en", "web", 40), (303, items[0], "en", "web", 1), (304, "x" * 40000 + " the garden", "en", "web", 1)]
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def expected(spark, folder, items):
    import sentencepiece

    docs = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if not plain.held_out(r["doc_id"])]
    scores = plain.toxic_scores([(r["doc_id"], r["text"]) for r in docs], labels)
    rows = [r for r, (score, _) in zip(docs, scores, strict=True) if score < 0.5]
    assert not any("hatword" in (r["text"] or "") for r in rows) and len(rows) > 200
    spoken = plain.languages([r["text"] for r in rows], [(r["text"], r["lang"]) for r in rows if not plain.held_out(r["doc_id"])])
    rows = [r for r, (lang, score, _) in zip(rows, spoken, strict=True) if lang != "und" and score >= 0.5]
    rows = firsts(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)))
    out = {}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for r in rows:
        text, left = without(r["text"], items)
        if left:
            out[r["doc_id"]] = (text, len(text), library.encode(text or ""))
    return out


def test_the_pipeline_matches_plain_python(spark, tables):
    folder, items = tables
    want = expected(spark, folder, items)
    got = corpus_pipeline.run(spark, folder).collect()
    assert len(got) == len(want)
    assert {r["doc_id"]: (r["text"], r["n_chars"], list(r["ids"])) for r in got} == want
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in got)
    assert 303 not in want and 300 not in want and 304 in want and None in want


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_tables(spark, tables, stage):
    folder, _ = tables
    name, run = corpus_pipeline.STAGES[stage]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert run(spark, docs.limit(0), folder).count() == 0
    odd = docs.where("doc_id >= 300 OR doc_id IS NULL OR doc_id < 12").selectExpr("*", "1 AS _row", "2 AS node", "3 AS _key", "4 AS _spans", "5 AS score", "6 AS ids2")
    odd = odd.unionAll(odd.where("doc_id = 3"))  # a row that is repeated
    out = run(spark, odd, folder)
    rows = out.collect()
    assert rows, name
    assert [c for c in out.columns if c in odd.columns] == odd.columns
    if stage < 4:
        assert out.columns == odd.columns
    assert all((r["_row"], r["node"], r["_key"], r["_spans"], r["score"]) == (1, 2, 3, 4, 5) for r in rows)
    # clean rows stay, and repeated ones but in the Jaccard join
    assert sum(r["doc_id"] == 3 for r in rows) == (1 if stage == 2 else 2)


def test_stages_leave_the_tables_of_other_results_alone(spark):
    from chronotext.llm import shared

    held = shared.written(spark.range(10), "held")
    docs = spark.createDataFrame([(i, f"the quick brown fox number {i} jumps over the lazy dog again", "en", "web", 60) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:4:2]:
        with shared.scope() as outer:
            stage(spark, docs, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        assert isinstance(outer, set)
    assert held.count() == 10
