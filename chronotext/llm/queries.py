"""The registered queries of this subpackage, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, annuli, bestfit, decontam, jaccard, langid, lattice, licences, sharding, spelling, tokencount, toxicity, warc
from .shared import bound_batches, held_out, shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~held_out()))
    return langid.identify(docs, model, spans=True).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


SHARDS = 16


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


ORACLES["op2_sharding"] = """
WITH RECURSIVE rows AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, text,
         CASE WHEN coalesce(doc_id, 0) < 0 THEN coalesce(doc_id, 0)::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END AS key
  FROM documents
), jump AS (
  SELECT DISTINCT key, key AS state, CAST(-1 AS BIGINT) AS here, CAST(0 AS BIGINT) AS ahead FROM rows
  UNION ALL
  SELECT key, next, ahead, CAST(floor((ahead + 1) * (CAST(2147483648 AS DOUBLE) / (CAST(next // 8589934592 AS DOUBLE) + 1))) AS BIGINT)
  FROM (SELECT key, (state * 2862933555777941757 + 1) % 18446744073709551616 AS next, ahead FROM jump WHERE ahead < 17)
), found AS (
  SELECT key, max(CASE WHEN here < 16 THEN here END) AS shard, max(CASE WHEN here < 17 THEN here END) AS grown FROM jump GROUP BY key
), bits AS (
  SELECT r.doc_id, r.size, r.text, f.shard, f.grown FROM rows r JOIN found f USING (key)
), crc(i, c) AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) FROM range(256) t(i)
), lookup AS (
  SELECT list(c ORDER BY i) AS t FROM crc
), summed AS (
  SELECT doc_id, size, shard, grown,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(list_transform(range(0, size - 1), lambda i: CAST(concat('0x', substr(h, 2 * i + 1, 2)) AS BIGINT)) AS BIGINT[])),
                         lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS text_crc32
  FROM (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM bits), lookup
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM summed
"""


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    back = warc.read_archive(spark, path)
    return back.select(F.col("id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end_word - s.first_word)")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLES["op6_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     n AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
           FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT k FROM n),
     g AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
           FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
     h AS (SELECT g.doc_id, g.i, g.k, n.item_id FROM g JOIN n ON g.phrase = n.phrase AND g.k = n.k),
     hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
     item AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""


TOKEN_LIMIT = 2048


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; it is installed with Python on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.count(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return tokencount.over_limit(counts, TOKEN_LIMIT).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that a toxicity model may learn from."""
    return table(spark, sf_dir, "labels").where(~held_out() & F.col("toxic").isNotNull()).select("doc_id", "toxic")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.learn(table(spark, sf_dir, "documents"), toxic_labels(spark, sf_dir))
    scored = toxicity.score(table(spark, sf_dir, "documents"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("evidence").alias("n_evidence"))


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed, book = ann.index(table(spark, sf_dir, "embeddings"))
    return ann.search(indexed, book, indexed.where("id % 100 = 0").select("id", "vector"), k=10)


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = lattice.Pieces.load(tokenizer_path("piece_bpe_32k.model"))
    back = lattice.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces, back="_back")
    whole = F.coalesce("text", F.lit(""))
    return back.select("doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), F.size("ids").cast("long").alias("n_pieces"), "ids", (F.col("_back") == whole).alias("round_trip"))


@query
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files below source and language, the only hierarchy that they have."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return licences.scan(files).select("doc_id", "path", "licence", "how", F.round("cosine", 9).alias("cosine"), "line", "from_directory")


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = annuli.quantised(table(spark, sf_dir, "embeddings"), label=F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    found = annuli.index(rows)
    anchors = rows if found is None else found.rows
    return annuli.hard_negatives(found, anchors.where("id % 100 = 0").select("id", "label", "v"))


ORACLES["op11_hard_negatives"] = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bestfit.pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), keep_ids=False)
    return bestfit.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents"), dropped=31))


ORACLES["op13_spelling"] = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), crc(i, c) AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) FROM range(256) t(i)
), lookup AS (
  SELECT list(c ORDER BY i) AS t FROM crc
), summed AS (
  SELECT run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(list_transform(range(0, len(h) // 2), lambda i: CAST(concat('0x', substr(h, 2 * i + 1, 2)) AS BIGINT)) AS BIGINT[])),
                         lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) END AS s
  FROM (SELECT *, hex(encode(concat(doc_id, ':', run))) AS h FROM runs), lookup
), lost AS (
  SELECT CASE WHEN s % 31 = 0 THEN concat(substr(run, 1, CAST(s % length(run) AS BIGINT)), substr(run, CAST(s % length(run) AS BIGINT) + 2)) ELSE run END AS word, n FROM summed
), w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM lost WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS MATERIALIZED (
  SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top, min(other) FILTER (WHERE other_n = mx) AS other FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS mx FROM near) GROUP BY word
), forms AS MATERIALIZED (
  SELECT w.word, CASE WHEN top >= 10 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.next = f.word
)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f JOIN (SELECT word, root FROM chain WHERE next IS NULL) c USING (word)
"""
