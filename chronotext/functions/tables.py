"""Recognisers as table functions for SQL: `SELECT * FROM hear(TABLE(audio))`, with a model that each worker loads once.

The input table has a medium (any column), samples and a rate; the output begins with the medium, under its own name and type.
Without a partition clause a task's rows are one run of the function, so a recogniser that takes several media at once gets
them in batches; with `PARTITION BY medium` each medium is a run of its own. A medium that fails is a row with its error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

#: Samples of several media and their rates to, for each, a list of (text, start_ms, end_ms) or the error that it raised.
BatchRecogniser = Callable[[list[np.ndarray], list[int]], list[list[tuple[str, float, float]] | Exception]]

#: Models of this worker, by the name of their function.
_loaded: dict[str, BatchRecogniser] = {}


def one_by_one(hear: Callable[[np.ndarray, int], list[tuple[str, float, float]]]) -> BatchRecogniser:
    """A recogniser of single media for several: one that fails does not touch the others."""

    def run(samples: list[np.ndarray], rates: list[int]):
        out = []
        for x, rate in zip(samples, rates, strict=True):
            try:
                out.append(hear(x, rate))
            except Exception as e:  # one medium's failure is its row's result
                out.append(e)
        return out

    return run


def register_recogniser(spark: SparkSession, name: str, load: Callable[[], BatchRecogniser], medium: str, samples: str = "samples", rate: str = "rate", most: int = 16) -> None:
    """Makes `name` a table function over tables with these columns; at most `most` media are heard at a time.

    `load` gives the recogniser and is called once by each worker that runs the function.
    """

    @udtf
    class Hear:
        def __init__(self):
            self.held: list[tuple] = []
            if name not in _loaded:
                _loaded[name] = load()

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError(f"{name} needs TABLE(...)")
            known = {f.name.lower(): f for f in table.dataType.fields}
            for c in (medium, samples, rate):
                if c.lower() not in known:
                    raise ValueError(f"{name} needs a column {c}")
            out = StructType([known[medium.lower()]]).add("seg_no", IntegerType()).add("text", StringType()).add("start_ms", DoubleType()).add("end_ms", DoubleType()).add("error", StringType())
            return AnalyzeResult(out)

        def eval(self, row) -> Iterator[tuple]:
            self.held.append((row[medium], row[samples], row[rate]))
            if len(self.held) >= most:
                yield from self._heard()

        def terminate(self) -> Iterator[tuple]:
            if self.held:
                yield from self._heard()

        def _heard(self) -> Iterator[tuple]:
            held, self.held = self.held, []
            sound = [(m, x, r) for m, x, r in held if x is not None and r is not None]
            for m, x, r in held:
                if x is None or r is None:
                    yield m, None, None, None, None, "no samples"
            told = _loaded[name]([np.asarray(x, np.float32) for _, x, _ in sound], [int(r) for _, _, r in sound]) if sound else []
            for (m, _, _), segments in zip(sound, told, strict=True):
                if isinstance(segments, Exception):
                    yield m, None, None, None, None, str(segments)
                else:
                    for i, (text, a, b) in enumerate(segments):
                        yield m, i, text, float(a), float(b), None

    spark.udtf.register(name, Hear)

