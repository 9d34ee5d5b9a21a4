"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, with evidence.

* Terms are words (A-Z in lower case) and the first 4, 5 and 6 bytes of longer words, as 64-bit hashes, each with its
  occurrence in the text: first, second, third and so on. So a text that repeats a term has terms of its own. The
  vocabulary is the terms that stand in texts of label 1 more often than chance would give (Chernoff's bound of the
  binomial tail, against the number of terms) in a bounded sample of labelled rows; a term's weight is its idf, and
  vectors are scaled to length 1 over that vocabulary.
* Examples are the sample's rows. Each term has a posting list, cut in blocks of examples with the largest weight of the
  term in each block. A text's blocks are visited in the order of their upper bounds until no bound beats the k-th best
  cosine, so the k nearest examples are exact (ties: the smaller example number, which is the smaller key).
* Votes are weighted by 1 / (distance + a constant) and by how many labelled rows an example stands for; a monotone fit to
  the examples' own leave-one-out votes turns the share of label 1 into a calibrated score.

Defined results: a text with no term of the vocabulary (null and empty ones too) has no evidence and gets the calibrated
share of label 1 among examples without such a term; without labelled rows of both labels every score is that of the
only label, or 0. A key with both labels is an example of each. Rows are kept one for one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .shared import bounded_sample, tidy, written

PREFIXES = (4, 5, 6)
#: Most labelled rows of one label that a model is learned from.
SAMPLE_PER_LABEL = 4000
NEIGHBOURS, BLOCK = 15, 64
SOFTEN = 0.05


def _terms(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every term of the texts."""
    w = bytescan.words(offsets, data, bytescan.ALNUM, PREFIXES)
    text = np.repeat(np.arange(len(offsets) - 1), w.counts())
    return np.concatenate([text, *(text[i] for i, _ in w.prefixes.values())]), np.concatenate([w.hashes, *(h for _, h in w.prefixes.values())])


def _counted(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrence from 0 on), each once."""
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
    first = np.flatnonzero(fresh)
    tf = np.diff(np.append(first, len(text)))
    row = np.repeat(first, tf)
    return text[row], term[row], np.arange(len(row)) - np.repeat(np.cumsum(tf) - tf, tf)


class Terms:
    """The vocabulary: pairs of a hash and an occurrence, with their idf."""

    def __init__(self, hashes: np.ndarray, occurrences: np.ndarray, idf: np.ndarray):
        self.base, self.idf = np.unique(hashes), idf
        codes = self._code(hashes, occurrences)
        self.number = np.argsort(codes, kind="stable")
        self.codes = codes[self.number]
        self.likely = np.zeros(1 << 20, bool)
        self.likely[self.base >> np.uint64(44)] = True

    @staticmethod
    def _code(hashes: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
        """One number for a term and its occurrence."""
        with np.errstate(over="ignore"):
            return bytescan.mix(hashes + bytescan.mix(occurrences.astype(np.uint64)))

    def vectors(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, term numbers, weights) of the texts' vectors of length 1."""
        n = len(offsets) - 1
        if not len(self.base):
            return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)
        text, term = _terms(offsets, data)
        maybe = np.flatnonzero(self.likely[term >> np.uint64(44)])
        text, term = text[maybe], term[maybe]
        at = np.searchsorted(self.base, term)
        hit = self.base[np.minimum(at, len(self.base) - 1)] == term
        text, at, occurrence = _counted(text[hit], at[hit])
        code = self._code(self.base[at], occurrence)
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[place] == code
        text, number = text[hit], self.number[place[hit]]
        weight = self.idf[number]
        norm = np.sqrt(np.bincount(text, weights=weight * weight, minlength=n))
        return np.searchsorted(text, np.arange(n + 1)), number, weight / norm[text]


class BlockMaxIndex:
    """Posting lists of examples by term, with the largest weight of each block of BLOCK examples."""

    def __init__(self, first: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int):
        self.n = len(first) - 1
        example = np.repeat(np.arange(self.n), np.diff(first))
        order = np.lexsort((example, terms))
        self.example, self.weight, term = example[order], weights[order], terms[order]
        self.blocks = -(-self.n // BLOCK)
        cell = term * max(self.blocks, 1) + self.example // BLOCK
        self.cell_first = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1))
        self.most = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(n_terms, self.blocks)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine above 0, nearest first, and their cosines."""
        bound = weights @ self.most[terms]
        found, score = np.zeros(0, np.int64), np.zeros(0)
        todo = np.argsort(-bound, kind="stable")
        at, worst = 0, 0.0
        while at < len(todo) and bound[todo[at]] > 0:
            run = todo[at : at + 8]
            run = run[(bound[run] > 0) & ((len(found) < k) | (bound[run] >= worst - 1e-12))]
            if not len(run):
                break
            cells = (terms[:, None] * self.blocks + run[None, :]).ravel()
            a, b = self.cell_first[cells], self.cell_first[cells + 1]
            n = b - a
            place = np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            q = np.repeat(np.repeat(weights, len(run)), n)
            slot = np.searchsorted(run_sorted := np.sort(run), self.example[place] // BLOCK) * BLOCK + self.example[place] % BLOCK
            total = np.bincount(slot, weights=q * self.weight[place], minlength=len(run) * BLOCK)
            hit = np.flatnonzero(total > 0)
            who = run_sorted[hit // BLOCK] * BLOCK + hit % BLOCK
            keep = who != without
            found, score = np.concatenate([found, who[keep]]), np.concatenate([score, total[hit][keep]])
            best = np.lexsort((found, -np.round(score, 12)))[:k]
            found, score = found[best], score[best]
            worst = score[-1] if len(found) == k else 0.0
            at += 8
        return found, np.minimum(score, 1.0)


@dataclass
class Model:
    terms: Terms
    index: BlockMaxIndex
    keys: list  # of the examples
    labels: np.ndarray
    stands_for: np.ndarray  # how many labelled rows an example stands for
    k: int
    knots: tuple[np.ndarray, np.ndarray] | None = None  # share of votes, calibrated score
    bare: float = 0.0  # score of a text without any term

    def share(self, found: np.ndarray, cosine: np.ndarray) -> float:
        vote = self.stands_for[found] / (1 - cosine + SOFTEN)
        return float((vote * self.labels[found]).sum() / vote.sum())

    def score(self, found: np.ndarray, cosine: np.ndarray) -> float:
        if not len(found):
            return self.bare
        return float(np.interp(self.share(found, cosine), *self.knots))


def _monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing fit of y over x, as knots; pools are drawn to 1/2 by two rows."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], weight[order], strict=True):
        pools.append([xi * wi, yi * wi, wi, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    sums = np.array(pools)
    rate = (sums[:, 1] / sums[:, 2] * sums[:, 3] + 1) / (sums[:, 3] + 2)
    return sums[:, 0] / sums[:, 2], np.maximum.accumulate(np.clip(rate, 0.001, 0.999))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", sample_per_label: int = SAMPLE_PER_LABEL, k: int = NEIGHBOURS) -> Model:
    """A model from the whole texts of about `sample_per_label` rows of `labels` (key, label) of each label, or all if fewer."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    chosen = written(bounded_sample(rows, "label", "key", sample_per_label), "chosen")
    small = chosen.count() <= 4 * sample_per_label  # keys and labels alone; else the texts are shuffled to them
    sample = written(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen) if small else chosen, "key").select("key", "label", "text").repartition(8), "examples")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    whole = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)

    def each(batches):
        for batch in batches:
            for row, offsets, data in bytescan.blocks(batch.column(1)):
                text, term, occurrence = _counted(*_terms(offsets, data))
                label = batch.column(0).to_numpy(zero_copy_only=False)[row + text]
                order = np.lexsort((occurrence, term, label))
                label, term, occurrence = label[order], term[order], occurrence[order]
                fresh = np.ones(len(label), bool)
                fresh[1:] = (label[1:] != label[:-1]) | (term[1:] != term[:-1]) | (occurrence[1:] != occurrence[:-1])
                first = np.flatnonzero(fresh)
                for i in range(0, len(first), 50_000):
                    at = first[i : i + 50_000]
                    n = np.diff(np.append(first[i : i + 50_001], len(label)))[: len(at)]
                    yield pa.record_batch([pa.array(label[at].astype(np.int32)), pa.array(term[at].view(np.int64)), pa.array(occurrence[at].astype(np.int32)), pa.array(n.astype(np.int64))], ["label", "term", "occurrence", "n"])

    df = sample.select("label", "text").mapInArrow(tidy(each), "label int, term long, occurrence int, n long")
    counted = df.groupBy("term", "occurrence").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    both = written(counted, "term-counts")
    n_terms = max(2, both.count())
    base = min(max(n1 / max(n1 + n0, 1), 1e-6), 1 - 1e-6)
    n, rate = F.col("a") + F.col("b"), F.col("a") / (F.col("a") + F.col("b"))
    tail = n * (F.when(rate > 0, rate * F.log(rate / base)).otherwise(0.0) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - base))).otherwise(0.0))
    chosen = both.withColumn("tail", tail).where((rate > base) & (F.col("tail") > float(np.log(n_terms)))).orderBy(F.desc("tail"), "term", "occurrence").toPandas()  # terms of the bounded sample
    share = (chosen["a"].to_numpy(float) / max(n1, 1) * whole.get(1, 0) + chosen["b"].to_numpy(float) / max(n0, 1) * whole.get(0, 0)) / max(1, sum(whole.values()))
    terms = Terms(chosen["term"].to_numpy(np.int64).view(np.uint64), chosen["occurrence"].to_numpy(np.int64), 1 + np.log(1 / np.maximum(share, 1e-9)))

    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def vectors(batches):
        for batch in batches:
            for row, offsets, data in bytescan.blocks(batch.column(2)):
                first, at, weight = shared.value.vectors(offsets, data)
                n, cut = len(offsets) - 1, pa.array(first, pa.int32())
                yield pa.record_batch([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.ListArray.from_arrays(cut, pa.array(at, pa.int64())), pa.ListArray.from_arrays(cut, pa.array(weight, pa.float64()))], ["key", "label", "terms", "weights"])

    kind = sample.schema["key"].dataType.simpleString()
    # bounded: rows of the sample, terms of the vocabulary
    examples = sample.mapInArrow(tidy(vectors), f"key {kind}, label int, terms array<long>, weights array<double>").orderBy("key", "label").toArrow()
    at, weight = (examples[c].combine_chunks() for c in ("terms", "weights"))
    first = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64) if len(at) else np.zeros(1, np.int64)
    at, weight = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64), weight.flatten().to_numpy(zero_copy_only=False)
    labels = examples["label"].to_numpy().astype(float)
    stands = np.where(labels == 1, whole.get(1, 0) / max(n1, 1), whole.get(0, 0) / max(n0, 1))
    model = Model(terms, BlockMaxIndex(first, at, weight, len(terms.idf)), examples["key"].to_pylist(), labels, stands, k)
    # leave-one-out votes of the examples, and the share of label 1 among those without a term
    bare, votes = np.zeros(len(labels), bool), np.zeros(len(labels))
    for i in range(len(labels)):
        found, cosine = model.index.nearest(at[first[i] : first[i + 1]], weight[first[i] : first[i + 1]], k, without=i) if first[i] < first[i + 1] else (np.zeros(0, np.int64), None)
        bare[i] = not len(found)
        votes[i] = 0 if bare[i] else model.share(found, cosine)
    if bare.any():
        model.bare = float(np.clip((stands * labels)[bare].sum() / stands[bare].sum(), 0.001, 0.999))
    elif len(labels):
        model.bare = float(np.clip((stands * labels).sum() / stands.sum(), 0.001, 0.999))
    model.knots = _monotone(votes[~bare], labels[~bare], stands[~bare]) if (~bare).any() else (np.array([0.0, 1.0]), np.array([model.bare, model.bare]))
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", evidence: bool = True) -> DataFrame:
    """One row per row of `docs`: its key, score (0 to 1), predicted (score >= 0.5), and the nearest examples with cosine and label."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    of = pa.list_(pa.struct([("example", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def predict(batches):
        m = shared.value
        for batch in batches:
            for row, offsets, data in bytescan.blocks(batch.column(1)):
                n = len(offsets) - 1
                first, at, weight = m.terms.vectors(offsets, data)
                scores, why = np.full(n, m.bare), [[] for _ in range(n)]
                for i in np.flatnonzero(np.diff(first)).tolist():
                    found, cosine = m.index.nearest(at[first[i] : first[i + 1]], weight[first[i] : first[i + 1]], m.k)
                    scores[i] = m.score(found, cosine)
                    if evidence:
                        why[i] = [{"example": str(m.keys[j]), "cosine": c, "label": int(m.labels[j])} for j, c in zip(found.tolist(), cosine.tolist(), strict=True)]
                columns = [batch.column(0).slice(row, n), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
                if evidence:
                    columns.append(pa.array(why, of))
                yield pa.record_batch(columns, [key, "score", "predicted", "evidence"][: len(columns)])

    schema = f"{key} {docs.schema[key].dataType.simpleString()}, score double, predicted int" + ", evidence array<struct<example:string,cosine:double,label:int>>" * evidence
    return docs.select(key, text).mapInArrow(tidy(predict), schema)


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs` that the model does not call toxic, as they are; nothing is shuffled."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def keep(batches):
        m = shared.value
        for batch in batches:
            fine = np.ones(batch.num_rows, bool)
            for row, offsets, data in bytescan.blocks(batch.column(at)):
                first, number, weight = m.terms.vectors(offsets, data)
                size = np.diff(first)
                fine[row : row + len(size)][size == 0] = m.bare < 0.5
                for i in np.flatnonzero(size).tolist():
                    fine[row + i] = m.score(*m.index.nearest(number[first[i] : first[i + 1]], weight[first[i] : first[i + 1]], m.k)) < 0.5
            yield batch.filter(pa.array(fine))

    return docs.mapInArrow(tidy(keep), docs.schema)
