"""Language ID, token counts, SentencePiece, decontamination and toxicity against brute force and known cases."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronotext.llm import bytescan, decontam, langid, lattice, queries, tokencount, toxicity
from chronotext.llm.queries import tokenizer_path

TEXTS = ["Hello  world\n\tfoo ﬁ １", "", None, " ", "   a", "a   ", "中文字 かな", "😀 ok!!!...", "x" * 100, "https://example.com/" + "ab1" * 60, "été naïve Ünï", "<s> </s> <0x0A> <|endoftext|>", "a▁b", "tab\tsep\r\n", "0123456789", "ΟΔΟΣ İstanbul", "it'S DON'T", "x y　z\x1cr\x85t", "same", "same", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 4 else None, t, i * 2, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens long, unit string").repartition(3)


def test_words_and_shingles_match_regular_expressions():
    texts = ["a B c\td", "", "x  y", None, "é b 1,2", "the the the the"]
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    for table, pattern in ((bytescan.SPACED, r"[^\x20\x09-\x0D]+"), (bytescan.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        known = {}
        for row, offsets, data in bytescan.blocks(pa.array(texts), 8):
            w = bytescan.words(offsets, data, table)
            for i in range(len(offsets) - 1):
                said = re.findall(pattern, (texts[row + i] or "").translate(lower))
                hashes = w.hashes[w.first[i] : w.first[i + 1]].tolist()
                assert len(said) == len(hashes)
                for a, b in zip(said, hashes, strict=True):
                    assert known.setdefault(a, b) == b
        assert len(set(known.values())) == len(known)
    (_, offsets, data), *_ = bytescan.blocks(pa.array(["a b c a b c", "a b", ""]))
    assert [len(s) for s in bytescan.shingles(bytescan.words(offsets, data, bytescan.SPACED), 3)] == [3, 1, 0]


def test_viterbi_is_the_best_path():
    random = np.random.default_rng(0)
    sizes = [0, 1, 31, 32, 33, 100, 5]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = random.normal(0, 3, (first[-1], 3)).astype(np.float32)
    prior = np.log([0.5, 0.3, 0.2])
    got = langid.viterbi(scores, first, 2.0, prior)

    def value(path, s):
        return prior[path[0]] * 0 + sum(s[t][p] for t, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            continue
        s = scores[a:b].astype(float)
        v, back = prior.copy(), []
        for t in range(len(s)):
            switched = v.max() - 2.0
            back.append(np.where(v >= switched, np.arange(3), v.argmax()))
            v = np.maximum(v, switched) + s[t]
        path = [int(v.argmax())]
        for t in range(len(s) - 1, 0, -1):
            path.append(int(back[t][path[-1]]))
        assert value(got[a:b].tolist(), s) == pytest.approx(value(path[::-1], s), abs=1e-3)


def test_language_id(spark):
    en, fr = "the house and the garden of the king was there ", "la maison et le jardin du roi était là dans une "
    train = spark.createDataFrame([(i, (en if i % 2 else fr) * 3, "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.learn(train)
    rows = [(1, en), (2, fr), (3, en * 8 + fr * 8), (4, None), (5, "123 !?"), (6, "中文"), (None, en), (8, "")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert by[1]["lang_pred"] == "en" and by[2]["lang_pred"] == "fr" and by[None]["lang_pred"] == "en"
    assert [s["lang"] for s in by[3]["spans"]] == ["en", "fr"]
    assert by[4]["lang_pred"] == by[5]["lang_pred"] == by[8]["lang_pred"] == "und"
    assert by[6]["lang_pred"] in ("en", "fr")
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(train.limit(0), model).count() == 0
    empty = langid.learn(train.limit(0))
    assert {r["lang_pred"] for r in langid.identify(train, empty).collect()} == {"und"}
    kept = langid.kept(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 6]


@pytest.mark.parametrize("hot", [1 << 19, 0])
def test_token_counts_match_the_library(spark, docs, hot):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    one = Tokenizer.from_file(path)
    want = sorted((len((t or "").encode()), len(one.encode(t or "", add_special_tokens=False).ids)) for t in TEXTS)
    got = tokencount.count(docs.select("doc_id", "text"), path, hot=hot).collect()
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert tokencount.count(docs.limit(0), path).count() == 0


@pytest.mark.parametrize(("hot", "short", "long"), [(1 << 19, 60, 1 << 14), (0, 60, 1 << 14), (0, 4, 1 << 14), (0, 4, 30)])
def test_sentencepiece_matches_the_library_and_decodes(spark, docs, monkeypatch, hot, short, long):
    import sentencepiece

    monkeypatch.setattr(lattice, "MOST_CHARS", short)
    monkeypatch.setattr(lattice, "LONG_CHARS", long)
    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = lattice.Pieces.load(path)
    rows = lattice.decode(lattice.encode(docs, pieces, hot=hot), pieces, text="back").collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert list(r["ids"]) == library.encode(r["text"] or "")
        assert r["back"] == (r["text"] or "").replace("▁", " ")
    sums = lattice.totals(docs.select("doc_id", "text"), pieces, hot=hot).collect()
    assert sorted(r["n_pieces"] for r in sums) == sorted(len(library.encode(t or "")) for t in TEXTS)


def test_sentencepiece_of_a_long_unit_and_of_clashing_columns(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=path), lattice.Pieces.load(path)
    random = np.random.default_rng(3)
    long = "".join(random.choice(list("aeinrst"), 3000))
    texts = [long, long, "a" * 2000, "the end"]
    docs = spark.createDataFrame([(t, [1], "x", "y", "z", {"a": 1}) for t in texts], "text string, ids array<int>, _row string, _own string, _key string, m map<string,int>").repartition(2)
    out = lattice.encode(docs, pieces, hot=0)
    assert out.columns == ["text", "_row", "_own", "_key", "m", "ids"]
    rows = out.collect()
    assert len(rows) == 4 and all(list(r["ids"]) == library.encode(r["text"]) and (r["_row"], r["_own"], r["_key"], r["m"]) == ("x", "y", "z", {"a": 1}) for r in rows)


@pytest.mark.parametrize("hot", [1 << 19, 0])
def test_texts_of_the_same_pass_are_those_of_the_ids(spark, docs, hot):
    pieces = lattice.Pieces.load(tokenizer_path("piece_bpe_32k.model"))
    out = lattice.encode(docs.withColumn("back", F.lit(1)), pieces, hot=hot, back="back")
    assert out.columns == [*docs.columns, "ids", "back"]
    rows = lattice.decode(out, pieces, text="again").collect()
    assert len(rows) == len(TEXTS) and all(r["back"] == r["again"] == (r["text"] or "").replace("▁", " ") for r in rows)
    assert lattice.encode(docs.limit(0), pieces, back="back").count() == 0


def test_ids_of_any_order_decode_alike(spark):
    pieces = lattice.Pieces.load(tokenizer_path("piece_bpe_32k.model"))
    random = np.random.default_rng(11)
    spell = lambda t: [pieces.byte[b] for b in t.encode()]
    normal = np.flatnonzero(pieces.normal)
    lists = [[], spell("▁▁é😀 x"), spell(" two"), [pieces.unknown], [pieces.unknown, *spell("\n")], *(random.choice(normal, n).tolist() for n in (1, 3, 50))]
    want = [r["text"] for r in lattice.decode(spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ids array<int>"), pieces).orderBy("i").collect()]
    decoder = lattice.Decoder(pieces)
    assert decoder(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == want
    assert decoder(pa.array([[5, 6], *lists], pa.list_(pa.int32())).slice(1)).to_pylist() == want
    assert decoder(pa.array([], pa.list_(pa.int32()))).to_pylist() == []


def test_sentencepiece_query_gives_whole_texts(spark, docs, tmp_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = [*TEXTS, "a▁b", "the cat saw the dog", "the dog saw the cat"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op8_sentencepiece(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        r = got[i]
        assert list(r["ids"]) == library.encode(t or "") and r["n_pieces"] == len(r["ids"]) and r["n_bytes"] == len((t or "").encode())
        assert r["round_trip"] == ("▁" not in (t or ""))


def brute_hits(text, items, window=10):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    w, hit, names = words(text), set(), set()
    for name, t in items:
        x = words(t)
        k = min(window, len(x))
        for i in range(len(x) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == x[i : i + k]:
                    hit |= set(range(j, j + k))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_items_of_one_name_count_once(spark, block_bytes):
    bench = spark.createDataFrame([(6, "a b c d e f g h i j k"), (6, "k l m n o p q r s t u"), (7, "k l m n o p q r s t u"), (None, "one two")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u"), (2, "One, two"), (2, "One, two"), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], sorted(r["items"])) for r in decontam.find(docs, bench, block_bytes=block_bytes).collect())
    assert got == [(1, ["6", "7"]), (2, ["null"]), (2, ["null"]), (3, [])]
    clash = docs.selectExpr("doc_id", "text", "1 AS _spans", "2 AS _key", "3 AS _left", "4 AS _text_key")
    cut = decontam.cut(clash, bench, block_bytes=block_bytes)
    assert cut.columns == clash.columns and [tuple(r) for r in cut.collect()] == [(3, None, 1, 2, 3, 4)] or cut.count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_matches_brute_force(spark, block_bytes):
    random = np.random.default_rng(1)
    vocabulary = ["ab", "cd", "ef", "GH", "ij"]
    say = lambda n: " ".join(random.choice(vocabulary, n))
    items = [(1, say(14)), (2, say(12)), (3, "short item"), (4, ""), (5, None), (1, say(11)), (6, say(11)), (6, say(11))]
    texts = [say(50) + " " + (items[i % 2][1] or "") + ". " + say(20) for i in range(8)] + [None, "", "short, ITEM!", "clean", say(3) + " short item " * 3, "x", "x"]
    docs = spark.createDataFrame([(i if i < 13 else 99, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, item_id string").repartition(2)
    bench = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, doc_id int")
    got = decontam.find(docs, bench, block_bytes=block_bytes).collect()
    assert len(got) == len(texts)
    want = sorted((d, *map(str, brute_hits(t, items))) for d, t in zip([r if r < 13 else 99 for r in range(len(texts))], texts, strict=True))
    have = sorted((r["doc_id"], str(r["n_words"]), str(sum(s["end_word"] - s["first_word"] for s in r["spans"])), str(sorted(r["items"]))) for r in got)
    assert have == want
    cut = {r["doc_id"]: r["text"] for r in decontam.cut(docs, bench, block_bytes=block_bytes).collect()}
    assert cut[11] == "clean" and 10 not in cut and cut[8] is None
    assert all(brute_hits(t, [i for i in items if i[0] != 3])[1] == 0 for t in cut.values())
    assert decontam.find(docs, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontam.find(docs.limit(0), bench).count() == 0


def test_suffixes_are_sorted():
    symbols = np.array([3, 1, 2, 0, 1, 2, 0, 3, 1, 2, 0, 1, 1, 1, 1, 0])
    order = decontam.suffix_order(symbols)
    key = lambda i: [(x, i + k if x == 0 else 0) for k, x in enumerate(symbols[i:])][: list(symbols[i:]).index(0) + 1]
    assert order.tolist() == sorted(range(len(symbols)), key=key)
    index = decontam.FMIndex(symbols, 3)
    low, high = index.search(np.array([[1, 2], [1, 1], [2, 2]]))
    assert (high - low).tolist() == [3, 3, 0]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == [1, 4, 8]


def test_toxicity(spark):
    random = np.random.default_rng(2)
    plain = [f"w{i}" for i in range(200)]
    say = lambda n, bad=0: " ".join([*random.choice(plain, n), *(["grumblefoo"] * bad)])
    rows = [(i, say(60, 3 if i % 5 == 0 else 0)) for i in range(300)]
    docs = spark.createDataFrame([*rows, (None, None), (1000, ""), (1001, say(20000, 200)), (0, rows[0][1])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 300:
            assert r["predicted"] == int(r["doc_id"] % 5 == 0), r
        assert 0 <= r["score"] <= 1
    assert {r["predicted"] for r in got if r["doc_id"] == 1001} == {1}
    assert toxicity.clean(docs, model).count() == sum(r["predicted"] == 0 for r in got)
    none = toxicity.learn(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}


def test_nearest_examples_are_exact():
    random = np.random.default_rng(3)
    sizes = random.integers(0, 6, 400)
    first = np.concatenate([[0], np.cumsum(sizes)])
    terms = np.concatenate([np.sort(random.choice(30, n, replace=False)) for n in sizes]).astype(np.int64)
    weights = random.random(len(terms)) + 0.1
    norm = np.sqrt(np.add.reduceat(np.append(weights**2, 0), first[:-1].clip(max=len(weights))))
    dense = np.zeros((400, 30))
    for i in range(400):
        if sizes[i]:
            weights[first[i] : first[i + 1]] /= np.linalg.norm(weights[first[i] : first[i + 1]])
            dense[i, terms[first[i] : first[i + 1]]] = weights[first[i] : first[i + 1]]
    del norm
    index = toxicity.BlockMaxIndex(first, terms, weights, 30)
    for i in range(0, 400, 7):
        if not sizes[i]:
            continue
        found, cosine = index.nearest(terms[first[i] : first[i + 1]], weights[first[i] : first[i + 1]], 15)
        every = np.round(dense @ dense[i], 12)
        want = [j for j in np.lexsort((np.arange(400), -every)) if every[j] > 0][:15]
        assert found.tolist() == want and cosine == pytest.approx(every[want].clip(max=1))


def test_items_digest_is_of_sorted_names():
    assert hashlib.sha256(b"10,2").hexdigest() == hashlib.sha256(",".join(sorted(["2", "10"])).encode()).hexdigest()


def test_language_id_of_long_texts_repeated_rows_and_clashing_columns(spark):
    en, fr = "the house and the garden of the king was there ", "la maison et le jardin du roi était là dans une "
    model = langid.learn(spark.createDataFrame([(i, (en if i % 2 else fr) * 3, "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string"))
    rows = [(1, en * 20000, "x", 2.0, "s"), (2, fr, "x", 2.0, "s"), (2, fr, "x", 2.0, "s"), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double, spans string").repartition(2)
    got = sorted((r["doc_id"], r["lang_pred"]) for r in langid.identify(docs.select("doc_id", "text"), model).collect())
    assert got == [(1, "en"), (2, "fr"), (2, "fr"), (3, "und")]
    kept = langid.kept(docs, model)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["lang_pred"], r["score"], r["spans"]) for r in kept.collect()) == [(1, "x", 2.0, "s"), (2, "x", 2.0, "s"), (2, "x", 2.0, "s")]


def test_toxicity_of_keys_with_both_labels_repeats_and_clashing_columns(spark):
    random = np.random.default_rng(8)
    words = [f"w{i}" for i in range(200)]
    text = lambda bad: " ".join([*random.choice(words, 30), *(["slur"] * bad)])
    rows = [(i, text(7 if i % 4 == 0 else 0)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(0, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert sum(1 for k in model.keys if k == 0) == 2 and len(model.keys) == 201
    odd = spark.createDataFrame([(1, text(9), 1, "a", "b"), (1, text(9), 1, "a", "b"), (2, text(0) * 5000, 2, "a", "b"), (3, None, 3, None, None)], "doc_id long, text string, score int, label string, evidence string")
    assert sorted((r["doc_id"], r["predicted"]) for r in toxicity.score(odd, model).collect()) == [(1, 1), (1, 1), (2, 0), (3, 0)]
    clean = toxicity.clean(odd, model)
    assert clean.columns == odd.columns and sorted((r["doc_id"], r["score"]) for r in clean.collect()) == [(2, 2), (3, 3)]
    # a term that stands more often is a term of its own, without a bound
    assert max(len(v) for v in [model.terms.codes]) > 4


def test_token_counts_of_clashing_columns_and_long_texts(spark):
    rows = [(1, "hello world " * 30000, 5, "u", 7), (1, "hello world " * 30000, 5, "u", 7), (None, "x", 5, "u", 7), (2, None, 5, "u", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, unit string, rid int").repartition(2)
    got = sorted(((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in tokencount.count(docs, tokenizer_path("word_bpe_49k.json")).collect()))
    assert got == [(0, 1, 1), (1, 360000, 60000), (1, 360000, 60000), (2, 0, 0)]
