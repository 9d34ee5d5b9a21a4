"""A training corpus from `documents` in five stages, each one of the operators of chronotext.llm.

Every stage takes (spark, docs, sf_dir) and returns what it keeps; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. A stage's result has to be written before the next one
is called: its tables in the shared folder go then.

Every stage takes null and empty texts, repeated rows, columns of other names and an empty table; ties go as the operator
of the stage says. Null and empty texts have no letter, so the second stage drops them.

1. toxicity: rows that the nearest labelled examples call toxic go. Rows that a model may learn from are those of
   `labels` whose crc32(doc_id) mod 5 is not 0.
2. language ID: rows without a letter, and rows of which no language holds half of the letters, go.
3. n-gram Jaccard join: of the rows linked by a Jaccard similarity of at least 0.8 over five-word shingles one stays.
4. benchmark decontamination: every word inside a 10-word window of `benchmark` is cut out; rows without a word left go.
5. SentencePiece: the ids of every whole text, their number, and whether they decode to the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm import decontam, jaccard, langid, lattice, toxicity
from chronotext.llm.queries import tokenizer_path, toxic_labels
from chronotext.llm.shared import bound_batches, fresh_name, held_out, scope, shared_dir, sweep, table


#: Of each application the tables behind the result of the last stage that was called.
_behind: dict[str, set[str]] = {}


def _alone(stage):
    """A stage whose docs are stored, so that the tables behind the stage before can go; those of other work stay."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, _behind.pop(spark.sparkContext.applicationId, set()))
        bound_batches(spark)
        with scope() as own:
            out = stage(spark, docs, sf_dir)
        _behind[spark.sparkContext.applicationId] = own
        return out

    return run_stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.learn(docs, toxic_labels(spark, sf_dir)))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.kept(docs, langid.learn(docs.where(~held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = decontam.cut(docs, table(spark, sf_dir, "benchmark"))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows carry their text and all their ids: smaller batches for the last stage, which the executors enter with full heaps
    bound_batches(spark, 500)
    pieces = lattice.Pieces.load(tokenizer_path("piece_bpe_32k.model"))
    name = fresh_name(docs.columns, "_back")
    back = lattice.encode(docs, pieces, back=name)
    return back.withColumn("n_pieces", F.size("ids")).withColumn("round_trip", F.col(name) == F.coalesce("text", F.lit(""))).drop(name)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _alone(drop_toxic)),
    ("language ID", _alone(keep_languages)),
    ("n-gram Jaccard join", _alone(drop_near_duplicates)),
    ("benchmark decontamination", _alone(cut_benchmark)),
    ("SentencePiece encoding and decoding", _alone(encode)),
]

#: Nearest neighbours, Viterbi paths and byte-pair merges have no form in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's result a Parquet table in the shared folder; others stay for a look."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    sweep(spark, _behind.pop(spark.sparkContext.applicationId, set()))
    return docs
