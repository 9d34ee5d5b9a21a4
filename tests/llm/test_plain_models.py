"""The queries of language ID and toxicity over whole small tables, each row against plain Python."""

import numpy as np
import plain_models as plain
import pytest

from chronotext.llm import queries, toxicity
from chronotext.llm.queries import toxic_labels

SYLLABLES = {"en": ("the", "th", "ing", "ow", "sh", "er", "gh", "and"), "fr": ("le", "eau", "é", "ique", "oi", "qu", "ç", "ent"), "ru": ("пр", "ств", "ого", "ый", "да", "ни", "ж", "щи")}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents in three languages, some mixed, with words that only toxic ones say, repeats, and odd texts."""
    random = np.random.default_rng(23)
    vocabulary = {lang: ["".join(random.choice(s, int(random.integers(1, 4)))) for _ in range(120)] for lang, s in SYLLABLES.items()}
    say = lambda lang, n: list(random.choice(vocabulary[lang], n))
    rows, labels = [], []
    for i in range(240):
        lang = ("en", "fr", "ru", "en")[i % 4]
        said = say(lang, int(random.integers(5, 60)))
        if i % 11 == 0:
            said += say("fr" if lang != "fr" else "ru", int(random.integers(5, 40)))
        toxic = i % 6 == 1
        if toxic:
            for w in random.choice(["grumblefoo", "snarlword", "Hatefully", "vexing42"], int(random.integers(1, 4))):
                said.insert(int(random.integers(0, len(said))), w)
        if i % 29 == 3:
            said.append("grumblefoo")  # clean ones say it now and then
        rows.append((i, " ".join(said).capitalize() + ".", None if i % 17 == 5 else lang))
        if i % 5 != 2:
            labels.append((i, None if i % 31 == 4 else int(toxic)))
    rows += [(500, None, "en"), (501, "", "fr"), (502, "12 34 !?", None), (503, "中文字", "en"), (504, "中文字 abc", None), (505, " ".join(say("en", 4000) + say("ru", 3000)), "en"), (506, rows[1][1] + " " + rows[1][1], "en"), (7, rows[7][1], "fr"), (None, rows[13][1], "fr")]
    labels += [(501, 0), (505, 0), (600, 1), (13, 0), (None, 1)]  # without a document, with both labels, without a key
    path = tmp_path_factory.mktemp("plain")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, labels


def key(row):
    return repr(row)


def test_toxicity_query_matches_plain_python(spark, folder):
    path, rows, labels = folder
    usable = [(k, y) for k, y in labels if y is not None and k is not None and not plain.held_out(k)]
    want = plain.toxic_scores([(k, t) for k, t, _ in rows], usable)
    got = queries.op9_toxicity(spark, path).collect()
    told = sorted((key(k), round(s, 6), int(s >= 0.5), len(e), plain.held_out(k)) for (k, _, _), (s, e) in zip(rows, want, strict=True))
    assert sorted((key(r["doc_id"]), round(r["score"], 6), r["predicted"], r["n_evidence"], r["held_out"]) for r in got) == told
    assert {p for _, _, p, _, _ in told} == {0, 1} and {n for _, _, _, n, _ in told} >= {0, toxicity.NEIGHBOURS}


def test_evidence_matches_plain_python(spark, folder):
    path, rows, labels = folder
    usable = [(k, y) for k, y in labels if y is not None and k is not None and not plain.held_out(k)]
    want = plain.toxic_scores([(k, t) for k, t, _ in rows], usable)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = toxicity.score(docs, toxicity.learn(docs, toxic_labels(spark, path))).collect()
    by = {}
    for (k, _, _), (_, e) in zip(rows, want, strict=True):
        by.setdefault(k, []).append(e)
    for r in got:
        assert any([(x["example"], x["label"]) for x in r["evidence"]] == [(a, y) for a, _, y in e] and [x["cosine"] for x in r["evidence"]] == pytest.approx([c for _, c, _ in e], abs=1e-9) for e in by[r["doc_id"]]), r


def test_language_query_matches_plain_python(spark, folder):
    path, rows, _ = folder
    want = plain.languages([t for _, t, _ in rows], [(t, x) for k, t, x in rows if not plain.held_out(k)])
    got = queries.op1_language_id(spark, path).collect()
    told = sorted((key(k), plain.held_out(k), x, round(s, 9), n) for (k, _, _), (x, s, n) in zip(rows, want, strict=True))
    assert sorted((key(r["doc_id"]), r["held_out"], r["lang_pred"], round(r["score"], 9), r["n_spans"]) for r in got) == told
    assert {x for _, _, x, _, _ in told} == {"en", "fr", "ru", "und"} and any(n > 1 for *_, n in told)
