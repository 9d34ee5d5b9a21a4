"""Language identification: script ranges narrow the candidates, and a Viterbi path over per-word scores labels spans.

A model is learned from labelled texts: for each language the log-probabilities of hashed letter trigrams (word
boundaries included) and the scripts it is written in. A text's words get one score per language; the path through
the words that maximises the summed scores less a penalty for each switch of language gives spans of one language.

Defined results: a null text or one without letters has no spans, language ``und`` and score 0; a word in a script of
no learned language takes part with equal scores; with no evidence at all the most frequent learned language is named
with score 1 / number of languages; a model without languages names none (``und``). Rows are kept one for one, repeated rows and null ids included.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, tidy

#: First and last code point of the ranges of each script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
OTHER = len(SCRIPTS) + 1
BITS = 17
#: Most labelled texts of one language that a model is learned from.
SAMPLE_PER_LANGUAGE = 2000
SWITCH_PENALTY = 12.0
#: A language is a candidate for a script that holds at least this share of its training letters.
SCRIPT_SHARE = 0.005
BLOCK_CHARS = 1 << 20
STEP = 32

_tables: dict[str, np.ndarray] = {}


def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: the number of its script (0: not a letter), and itself in lower case."""
    if not _tables:
        script = np.full(0x110000, OTHER, np.uint8)
        for i, ranges in enumerate(SCRIPTS.values(), 1):
            for a, b in ranges:
                script[a : b + 1] = i
        lower = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if not c.isalpha():
                script[i] = 0
            elif len(x := c.lower()) == 1:
                lower[i] = ord(x)
        _tables.update(script=script, lower=lower)
    return _tables["script"], _tables["lower"]


@dataclass
class Scan:
    """Words of a run of texts and the trigram slots of each."""

    first: np.ndarray  # of each text, its first word
    begin: np.ndarray  # of each word, in characters of the joined texts
    end: np.ndarray
    script: np.ndarray
    slots: np.ndarray
    slot_first: np.ndarray
    base: np.ndarray  # where each text begins in the joined texts


def scan(texts: list[str]) -> Scan:
    script_of, lower_of = _code_points()
    joined = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    base = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=base[1:])
    script = script_of[joined]
    c = np.where(script > 0, lower_of[joined], np.uint32(0))
    one = np.concatenate([[np.uint32(0)], c[:-1]])
    two = np.concatenate([np.zeros(2, np.uint32), c[:-2]])[: len(c)]
    two = np.where(one > 0, two, np.uint32(0))
    with np.errstate(over="ignore"):
        h = (c * np.uint32(0x9E3779B1)) ^ (one * np.uint32(0x85EBCA77)) + (two * np.uint32(0xC2B2AE3D))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h = h >> np.uint32(32 - BITS)
    letter = c > 0
    begin = np.flatnonzero(letter & (one == 0))
    used = np.flatnonzero(letter | (one > 0))
    end = np.flatnonzero(~letter & (one > 0))
    return Scan(np.searchsorted(begin, base), begin, end, script[begin], h[used], np.searchsorted(used, begin), base[:-1])


def _runs(column: pa.Array, most: int = BLOCK_CHARS):
    """(first row, texts): whole texts, up to `most` characters together."""
    run, start, size = [], 0, 0
    for i, t in enumerate(column.to_pylist()):
        t = t or ""
        if run and size + len(t) > most:
            yield start, run
            run, start, size = [], i, 0
        run.append(t)
        size += len(t)
    if run:
        yield start, run


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x slots, log-probabilities
    scripts: np.ndarray  # scripts x languages, whether the language is a candidate
    prior: np.ndarray  # log share of the labelled rows
    penalty: float = SWITCH_PENALTY
    extra: dict = field(default_factory=dict)

    def word_scores(self, s: Scan) -> np.ndarray:
        n, out = len(s.begin), np.zeros((len(s.begin), len(self.languages)), np.float32)
        if not n:
            return out
        for j in range(len(self.languages)):
            out[:, j] = np.add.reduceat(self.weights[j][s.slots], s.slot_first)
        allowed = self.scripts[s.script]
        known = allowed.any(axis=1)
        out[~known] = 0
        best = out.max(axis=1, initial=-np.inf, where=allowed | ~known[:, None])
        out = out - np.where(np.isfinite(best), best, 0)[:, None]
        return np.where(allowed | ~known[:, None], np.maximum(out, -30), np.float32(-60))


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float, prior: np.ndarray) -> np.ndarray:
    """The best label of each word of each text.

    Texts are cut in blocks of STEP words. All blocks are folded at once, each from every possible label before it;
    the blocks of a text are then chained, which fixes the labels at their borders, and each is traced back alone.
    """
    n_labels, counts = scores.shape[1], np.diff(first)
    n_blocks = -(-counts // STEP)
    block_first = np.concatenate([[0], np.cumsum(n_blocks)])
    total = int(block_first[-1])
    if not total:
        return np.zeros(0, np.int8)
    rank = np.arange(len(scores)) - np.repeat(first[:-1], counts)
    at = (np.repeat(block_first[:-1], counts) + rank // STEP) * STEP + rank % STEP
    steps = np.zeros((total * STEP, n_labels), np.float32)
    steps[at] = scores
    steps = np.ascontiguousarray(steps.reshape(total, STEP, n_labels).transpose(1, 0, 2))
    fold = np.full((total, n_labels, n_labels), -np.inf, np.float64)
    fold[:, np.arange(n_labels), np.arange(n_labels)] = 0
    for t in range(STEP):
        fold = np.maximum(fold, fold.max(axis=2, keepdims=True) - penalty) + steps[t][:, None, :]
    order = np.argsort(-n_blocks, kind="stable")
    value = np.repeat(prior[None, :].astype(np.float64), len(counts), axis=0)[order]
    came = np.zeros((total, n_labels), np.int8)
    sorted_blocks, sorted_first = n_blocks[order], block_first[:-1][order]
    deepest = int(sorted_blocks[0])
    for k in range(deepest):
        m = int(np.searchsorted(-sorted_blocks, -k, side="left"))
        b = sorted_first[:m] + k
        paths = value[:m, :, None] + fold[b]
        came[b] = paths.argmax(axis=1)
        value[:m] = paths.max(axis=1)
    state = value.argmax(axis=1)
    enter, leave = np.zeros(total, np.int8), np.zeros(total, np.int8)
    for k in range(deepest - 1, -1, -1):
        m = int(np.searchsorted(-sorted_blocks, -k, side="left"))
        b = sorted_first[:m] + k
        leave[b] = state[:m]
        state[:m] = came[b, state[:m]]
        enter[b] = state[:m]
    del fold
    value = np.full((total, n_labels), -np.inf)
    value[np.arange(total), enter] = 0
    stay, top = np.zeros((STEP, total, n_labels), bool), np.zeros((STEP, total), np.int8)
    for t in range(STEP):
        top[t] = value.argmax(axis=1)
        switched = value.max(axis=1, keepdims=True) - penalty
        stay[t] = value >= switched
        value = np.maximum(value, switched) + steps[t]
    labels, state, row = np.zeros((total, STEP), np.int8), leave.astype(np.int64), np.arange(total)
    for t in range(STEP - 1, -1, -1):
        labels[:, t] = state
        state = np.where(stay[t, row, state], state, top[t])
    return labels.reshape(-1)[at]


def learn(labelled: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from the whole texts of at most about `sample_per_language` labelled rows of each language."""
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(text).alias("text"))
    sample = bounded_sample(rows, "label", "k", sample_per_language).select("label", "text").repartition(8)

    def count(batches):
        slots: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            labels = batch.column("label").to_pylist()
            for start, texts in _runs(batch.column("text")):
                for name in set(labels[start : start + len(texts)]):
                    s = scan([t for t, x in zip(texts, labels[start:], strict=False) if x == name])
                    slots[name] = slots.get(name, 0) + np.bincount(s.slots, minlength=1 << BITS)
                    scripts[name] = scripts.get(name, 0) + np.bincount(s.script, weights=s.end - s.begin, minlength=OTHER + 1)
                    rows[name] = rows.get(name, 0) + labels[start : start + len(texts)].count(name)
        for name, n in slots.items():
            for kind, v in (("slot", n), ("script", scripts[name]), ("rows", np.array([rows[name]]))):
                used = np.flatnonzero(v)
                yield pa.record_batch({"label": pa.array([name] * len(used), pa.string()), "kind": pa.array([kind] * len(used), pa.string()), "at": pa.array(used, pa.int64()), "n": pa.array(np.asarray(v)[used].astype(np.int64), pa.int64())})

    found = sample.mapInArrow(tidy(count), "label string, kind string, at long, n long").groupBy("label", "kind", "at").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["label"].unique())
    if not names:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros((OTHER + 1, 0), bool), np.zeros(0))
    weights = np.zeros((len(names), 1 << BITS), np.float64)
    scripts, prior = np.zeros((OTHER + 1, len(names))), np.zeros(len(names))
    for j, name in enumerate(names):
        for kind, to in (("slot", weights[j]), ("script", scripts[:, j])):
            part = found[(found["label"] == name) & (found["kind"] == kind)]
            to[part["at"].to_numpy()] = part["n"].to_numpy()
        prior[j] = found[(found["label"] == name) & (found["kind"] == "rows")]["n"].sum()
    seen = max(1, int((weights.sum(axis=0) > 0).sum()))
    weights = np.log((weights + 0.1) / (weights.sum(axis=1, keepdims=True) + 0.1 * seen))
    return Model(names, weights.astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1), np.log(np.maximum(prior, 0.5) / max(prior.sum(), 1)))


def label_texts(model: Model, texts: list[str]):
    """For each text (language, score, spans); a span is (begin, end, language) in characters."""
    if not model.languages:
        return [("und", 0.0, ([], [], []))] * len(texts)
    s = scan(texts)
    scores = model.word_scores(s)
    labels = viterbi(scores, s.first, model.penalty, model.prior)
    letters, out = s.end - s.begin, []
    evidence = scores.max(axis=1, initial=0) - scores.min(axis=1, initial=0) > 0 if scores.size else np.zeros(0, bool)
    for i in range(len(texts)):
        a, b = int(s.first[i]), int(s.first[i + 1])
        if a == b:
            out.append(("und", 0.0, ([], [], [])))
            continue
        own, size = labels[a:b], letters[a:b]
        share = np.bincount(own, weights=size, minlength=len(model.languages))
        best = int(share.argmax())
        sure = float(share[best] / share.sum())
        if not evidence[a:b].any():
            best, sure = int(model.prior.argmax()), 1 / len(model.languages)
        cut = np.flatnonzero(np.diff(own)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [b - a]])
        out.append((model.languages[best], sure, (s.begin[a:b][begin] - s.base[i], s.end[a:b][end - 1] - s.base[i], own[begin])))
    return out


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """One row per row of `docs`: its key, lang_pred, score, and (with `spans`) an array of (start, end, lang)."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, lang_pred string, score double" + ", spans array<struct<start:long,end:long,lang:string>>" * spans
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = shared.value
        names = np.array(m.languages, object)
        for batch in batches:
            langs, scores, sizes, begin, end, of = [], [], [0], [], [], []
            for _, texts in _runs(batch.column(1)):
                for lang, score, (a, b, x) in label_texts(m, texts):
                    langs.append(lang)
                    scores.append(score)
                    if spans:
                        sizes.append(sizes[-1] + len(a))
                        begin.append(np.asarray(a, np.int64)), end.append(np.asarray(b, np.int64)), of.append(names[x] if len(a) else np.zeros(0, object))
            columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            if spans:
                flat = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
                each = pa.StructArray.from_arrays([flat(begin, pa.int64()), flat(end, pa.int64()), flat(of, pa.string())], ["start", "end", "lang"])
                columns.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), each))
            yield pa.RecordBatch.from_arrays(columns, [key, "lang_pred", "score", "spans"][: len(columns)])

    return docs.select(key, text).mapInArrow(tidy(predict), schema)


def kept(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of `docs` that have a language: some letter, and at least the share `least` of letters in one language."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def keep(batches):
        for batch in batches:
            found = [x for _, texts in _runs(batch.column(at)) for x in label_texts(shared.value, texts)]
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score, _ in found], pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)


def narrow(text: pa.Array) -> list[str]:
    """The scripts of the letters of each text, most letters first; a plain report of the first step."""
    names, out = [None, *SCRIPTS, "other"], []
    for t in pc.fill_null(text, "").to_pylist():
        s = scan([t])
        n = np.bincount(s.script, weights=s.end - s.begin, minlength=OTHER + 1)
        out.append([names[i] for i in np.argsort(-n, kind="stable") if n[i] > 0])
    return out
