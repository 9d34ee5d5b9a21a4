"""Largest inner products and hard negatives by one-dimensional distance keys.

1. A vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm, a query q gets 0: then
   |q - x|^2 = |q|^2 + M^2 - 2 q.x, and the largest inner products are the nearest vectors.
2. Each vector belongs to its nearest pivot, with its distance to it as key. All are stored sorted by (pivot, key, id) and cut
   into runs of neighbours; of each run only pivot, smallest and largest key are told to the tasks (at most RUNS runs).
3. A vector within r of q has a key within r of q's own distance to that pivot. A search asks for the runs whose key intervals
   come nearest first, in rounds: until a window of scores has its k, the number of runs grows by `growth`; then the radius is
   the distance of the k-th. What lies outside the radius cannot be nearer, so the k are certain. A window that ends at a score
   ends at that distance, and one that begins below a score leaves out runs that are nearer as a whole.
4. A run meets the queries that ask for it in blocks; scores are integers and exact, and each block hands on its k of a window.

Defined results: rows with a null id or label, a null or empty vector, or a null or non-finite component take no part, nor does
a vector of another dimension than most have; of a repeated id the smallest (label, vector) counts; a component's integer is
kept within 2^62, a score within 64 bits; zero vectors take part. Of equal scores the smaller id comes first.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import tidy, unit_hash, written

#: Vectors that pivots are fitted on; vectors of a pivot, at least, and most pivots; vectors of a run, at least, and most runs.
SAMPLE, PIVOT_ROWS, PIVOTS, RUN_ROWS, RUNS = 20_000, 512, 256, 512, 1 << 20
#: Runs that a query asks for first, how their number grows, and queries that meet a run at a time.
FIRST_RUNS, GROWTH, BLOCK = 8, 4, 2048
_MOST = 1 << 62


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | F.Column = "label", scale: float = 256.0) -> DataFrame:
    """(id, label, v): the rows that take part, with floor(scale * x) for each component x."""
    sound = F.expr(f"`{key}` IS NOT NULL AND `{vector}` IS NOT NULL AND size(`{vector}`) > 0 AND forall(`{vector}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    label = F.col(label) if isinstance(label, str) else label
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), F.floor(x.cast("double") * scale).cast("long"))))
    rows = vectors.where(sound).select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v")).where("label IS NOT NULL")
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("one"))
    return one.select("id", "one.label", "one.v")


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of integer vectors, exact: in doubles where they hold them, in Python's integers where 64 bits do not."""
    most = q.shape[1] * max(1, float(np.abs(q.astype(float)).max(initial=0))) * max(1, float(np.abs(x.astype(float)).max(initial=0)))
    if most < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return q @ x.T
    return np.clip(q.astype(object) @ x.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Index:
    """The stored vectors of a search, and what every task knows of them."""

    def __init__(self, rows: DataFrame, dimension: int, norm: float, pivots: np.ndarray, runs: dict[str, np.ndarray]):
        self.rows, self.dimension, self.norm, self.pivots, self.runs = rows, dimension, norm, pivots, runs


def _pivots(x: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Centres of plain k-means."""
    centres = x[np.random.default_rng(1).choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        own = _distances(x, centres).argmin(1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(0)
    return centres


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(pivots)))
    for i, p in enumerate(pivots):
        out[:, i] = np.sqrt(((x - p) ** 2).sum(1))
    return out


def _augmented(v: np.ndarray, norm: float) -> np.ndarray:
    x = v.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(0, norm**2 - (x**2).sum(1)))[:, None]], 1)


def index(vectors: DataFrame, sample: int = SAMPLE, pivot_rows: int = PIVOT_ROWS, run_rows: int = RUN_ROWS) -> Index | None:
    """The index of (id, label, v), each id once; None if there is no row."""
    vectors = written(vectors, "vectors")
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("square"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return None
    n, dimension, norm = most["n"], most["d"], math.sqrt(most["square"])
    vectors = vectors.where(F.size("v") == dimension)
    chosen = vectors.where(unit_hash(F.col("id"), F.lit("pivots")) < min(1.0, sample / n)) if n > sample else vectors
    some = _augmented(matrix(chosen.limit(2 * sample).toArrow()["v"].combine_chunks(), dimension), norm)
    pivots = _pivots(some, min(PIVOTS, max(1, n // pivot_rows)))

    def key(batches):
        for batch in batches:
            parts = [_distances(_augmented(x, norm), pivots) for x in np.array_split(matrix(batch.column(2), dimension), max(1, batch.num_rows // 4096))]
            d = np.concatenate(parts)
            own = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            yield pa.record_batch([*batch.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own])], [*batch.schema.names, "pivot", "key"])

    keyed = vectors.mapInArrow(tidy(key), "id long, label long, v array<long>, pivot int, key double")
    run_rows = max(run_rows, math.ceil(n / (RUNS // 2)))

    def cut(batches):
        task, run, held, last = TaskContext.get().partitionId() << 32, -1, 0, None
        for batch in batches:
            runs = np.zeros(batch.num_rows, np.int64)
            for i, p in enumerate(batch.column(3).to_pylist()):
                if p != last or held == run_rows:
                    run, held, last = run + 1, 0, p
                runs[i] = task + run
                held += 1
            yield pa.record_batch([*batch.columns, pa.array(runs)], [*batch.schema.names, "run"])

    order = ["pivot", "key", "id"]
    rows = written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(cut), "id long, label long, v array<long>, pivot int, key double, run long"), "runs")
    # a row for each run: RUNS at most, but for those that a border of pivots or partitions has cut short
    known = rows.groupBy("run").agg(F.first("pivot").alias("pivot"), F.min("key").alias("low"), F.max("key").alias("high")).toArrow()
    return Index(rows, dimension, norm, pivots, {c: known[c].to_numpy() for c in known.column_names})


#: A query: its id, label and vector, and for each slot the scores (low to high) that it wants.
QUERY = "id long, label long, v array<long>, windows array<struct<slot:long,low:long,high:long>>"
_PLAN = f"{QUERY}, radius double, runs array<long>"


def _plan(found: Index, k: int, first: int, growth: int):
    """From queries with what they have found and the radius they have seen to those that ask for more, with their runs."""
    order = np.lexsort((found.runs["run"], found.runs["pivot"]))
    runs, pivot, low, high = (found.runs[c][order] for c in ("run", "pivot", "low", "high"))
    norm, pivots, dimension = found.norm, found.pivots, found.dimension

    def plan(batches):
        for batch in batches:
            out = []
            for row, q in zip(batch.select(["id", "label", "windows", "found", "radius"]).to_pylist(), matrix(batch.column(batch.schema.names.index("v")), dimension), strict=True):
                x = np.append(q.astype(np.float64), 0.0)
                square = float((x**2).sum())
                slack = 1e-12 * (norm + math.sqrt(square)) + 1e-9
                far = lambda s, square=square, slack=slack: math.sqrt(max(0.0, square + norm**2 - 2.0 * s) + 1e-13 * (square + norm**2)) + slack
                have = {f["slot"]: (f["n"], f["worst"]) for f in row["found"] or []}
                windows, edges, full = [], [], True
                for w in row["windows"]:
                    n, worst = have.get(w["slot"], (0, None))
                    edge = far(max(w["low"], worst) if n >= k else w["low"])
                    if edge > row["radius"]:
                        windows.append({"slot": w["slot"], "low": max(w["low"], worst) if n >= k else w["low"], "high": w["high"]})
                        edges.append(edge)
                        full = full and n >= k
                if not windows:
                    continue
                own = np.sqrt(((pivots - x) ** 2).sum(1))[pivot]
                bound = np.maximum(np.maximum(low - own, own - high) - slack, 0.0)
                # nothing of a run is farther than own + high: then all its scores are above the windows
                top = max(w["high"] for w in windows)
                near = math.sqrt(max(0.0, square + norm**2 - 2.0 * top - 1e-13 * (square + norm**2))) - slack
                bound[own + high + slack < near] = np.inf
                left = np.sort(bound[(bound > row["radius"]) & (bound <= max(edges))])
                if not len(left):
                    continue
                seen = int((bound <= row["radius"]).sum())
                wanted = max(first, seen * (growth - 1))
                radius = max(edges) if full or wanted >= len(left) else min(max(edges), max(left[wanted - 1], near))
                out.append((row["id"], row["label"], q, windows, float(radius), runs[(bound > row["radius"]) & (bound <= radius)]))
            for i in range(0, len(out), 256):
                some = list(zip(*out[i : i + 256], strict=True))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("slot", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])), pa.float64(), pa.list_(pa.int64())]
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(some, kinds, strict=True)], ["id", "label", "v", "windows", "radius", "runs"])

    return plan


def _scorer(k: int, same: bool, dimension: int):
    def score(asks: pa.Table, rows: pa.Table) -> pa.Table:
        q, x = matrix(asks["v"].combine_chunks(), dimension), matrix(rows["v"].combine_chunks(), dimension)
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, labels, x = ids[order], labels[order], x[order]
        all_scores, out = products(q, x), []
        for own, label, windows, scores in zip(asks["id"].to_pylist(), asks["label"].to_pylist(), asks["windows"].to_pylist(), all_scores, strict=True):
            fit = ((labels == label) if same else (labels != label)) & (ids != own)
            for w in windows:
                there = np.flatnonzero(fit & (scores >= w["low"]) & (scores <= w["high"]))
                there = there[np.argsort(-scores[there], kind="stable")[:k]]
                out.append((np.full(len(there), own), np.full(len(there), w["slot"]), ids[there], scores[there]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "slot", "id", "score"])

    return score


def search(found: Index, queries: DataFrame, k: int, same: bool, first: int = FIRST_RUNS, growth: int = GROWTH, block: int = BLOCK) -> DataFrame:
    """(query_id, slot, id, score, rank): for each window of each query (QUERY, each id once) the first k vectors of the same
    label, or of others, with a score in it; all, if there are fewer. A query never finds its own id."""
    schema = "query_id long, slot long, id long, score long"
    spark = found.rows.sparkSession
    queries = written(queries.select("id", "label", "v", "windows"), "queries")
    best, radii = spark.createDataFrame([], f"{schema}, rank int"), None
    first_best = Window.partitionBy("query_id", "slot").orderBy(F.desc("score"), "id")
    while True:
        if radii is None:
            state = queries.withColumn("found", F.expr("CAST(NULL AS array<struct<slot:long,n:int,worst:long>>)")).withColumn("radius", F.lit(-1.0))
        else:
            slots = best.groupBy("query_id", "slot").agg(F.count("*").cast("int").alias("n"), F.min("score").alias("worst"))
            # k rows of a slot, and as many slots as a query has windows
            told = slots.groupBy(F.col("query_id").alias("id")).agg(F.collect_list(F.struct("slot", "n", "worst")).alias("found"))
            state = radii.join(told, "id", "left").select("id", "label", "v", "windows", "found", "radius")
        plan = written(state.mapInArrow(tidy(_plan(found, k, first, growth)), _PLAN), "plan")
        if plan.isEmpty():
            return best
        asks = plan.select("id", "label", "v", "windows", F.explode("runs").alias("run"))
        # a row for each run that is asked for more than `block` times
        busy = asks.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") > block).select("run", F.ceil(F.col("n") / block).alias("blocks"))
        blocks = F.coalesce("blocks", F.lit(1))
        asked = asks.join(F.broadcast(busy), "run", "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks)).drop("blocks")
        wanted = plan.select(F.explode("runs").alias("run")).distinct()
        there = found.rows.join(wanted, "run", "left_semi").join(F.broadcast(busy), "run", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        scored = asked.groupBy("run", "block").cogroup(there.select("run", "block", "id", "label", "v").groupBy("run", "block")).applyInArrow(_scorer(k, same, found.dimension), schema)
        both = scored.unionByName(best.drop("rank")).withColumn("rank", F.row_number().over(first_best)).where(F.col("rank") <= k)
        best = written(both, "best")
        radii = plan.select("id", "label", "v", "windows", "radius")


def _share(part: Fraction, up: bool) -> F.Column:
    """The floor or ceiling of `score` * part, for scores from 0 on, without leaving 64 bits."""
    d = part.denominator
    return F.expr(f"score div {d} * {part.numerator} + (score % {d} * {part.numerator} + {d - 1 if up else 0}) div {d}")


def hard_negatives(found: Index | None, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: Fraction = Fraction(30, 100), most: Fraction = Fraction(90, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchors`: (id, label, v). An anchor's positives are its first rows of the same label; a negative is of another label and
    scores from `least` to `most` (0 <= least < most <= 1) times what the positive does.
    """
    anything = F.array(F.struct(F.lit(0).cast("long").alias("slot"), F.lit(-(1 << 63)).cast("long").alias("low"), F.lit((1 << 63) - 1).cast("long").alias("high")))
    if found is None:
        return anchors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = written(anchors.where(F.size("v") == found.dimension), "anchors")
    good = search(found, anchors.withColumn("windows", anything), positives, True)
    # of a positive that scores below 0, `least` times its score is more than `most` times it
    wanted = good.where("score >= 0").select("query_id", F.col("id").alias("slot"), _share(least, True).alias("low"), _share(most, False).alias("high")).where("low <= high")
    windows = wanted.groupBy(F.col("query_id").alias("id")).agg(F.collect_list(F.struct("slot", "low", "high")).alias("windows"))
    bad = search(found, anchors.join(windows, "id"), negatives, False)
    paired = bad.join(good.select("query_id", F.col("id").alias("slot"), F.col("score").alias("positive_score")), ["query_id", "slot"])
    return paired.select(F.col("query_id").alias("anchor_id"), F.col("slot").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
