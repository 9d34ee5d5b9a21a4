"""Live sessions: keyed streams of hypotheses with silence cuts, length cuts, stable prefixes and finals.

A session's input is a row for each update: how much audio it has taken in (`consumed_ms`, the event time), where speech
begins and ends within the session, and the hypothesis for the audio since the last cut. Recognition itself is a function
that the caller applies before; what is kept here is the state machine. `batch` gives the same events from a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.media_runs import by_medium, in_order

SILENCE_MS, MOST_MS, UPDATE_MS, TAIL_MS = 600.0, 7000.0, 1000.0, 200.0
UPDATES = "session_id string, seq long, kind string, consumed_ms double, speech_start_ms double, speech_end_ms double, hypothesis string"
EVENTS = "session_id string, seq long, type string, cue_id int, text string, start_ms double, end_ms double"
_UPDATES = pa.schema([("session_id", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("consumed_ms", pa.float64()), ("speech_start_ms", pa.float64()), ("speech_end_ms", pa.float64()), ("hypothesis", pa.string())])
_EVENTS = pa.schema([("session_id", pa.string()), ("seq", pa.int64()), ("type", pa.string()), ("cue_id", pa.int32()), ("text", pa.string()), ("start_ms", pa.float64()), ("end_ms", pa.float64())])
#: Control messages of a client. Fixed values.
CONTROL = "type string, language string, model string, translateTo string, sampleRate int"
KINDS = ["start", "flush", "stop"]
LIVE_LANGUAGES, LIVE_MODELS, LIVE_TARGETS = ["auto", "es", "en", "zh"], ["tiny", "base", "small"], ["es", "en", "zh"]

_EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def control_message(value: F.Column) -> F.Column:
    """A client's JSON message as a struct, or null if it is none or of no known type; client_message() also checks what it names."""
    parsed = F.from_json(value.cast("string"), CONTROL)
    return F.when(parsed["type"].isin(KINDS), parsed)


def client_message(value: F.Column) -> F.Column:
    """A client's JSON message as a struct; null if it is no object, of no known type, or names a language, model or target that is not known.

    Only `start` carries more than its type.
    """
    raw = value.cast("string")
    m = F.from_json(raw, CONTROL)
    known = m["language"].isin(LIVE_LANGUAGES) & m["model"].isin(LIVE_MODELS) & (m["translateTo"].isNull() | m["translateTo"].isin(LIVE_TARGETS))
    plain = F.struct(m["type"].alias("type"), *(F.lit(None).cast("string").alias(f) for f in ("language", "model", "translateTo")), F.lit(None).cast("int").alias("sampleRate"))
    said = F.when(m["type"].isin("flush", "stop"), plain).when((m["type"] == "start") & known, m)
    return F.when(raw.rlike(r"^\s*\{"), said)


@lru_cache(1 << 16)
def _without_edges(token: str) -> str:
    return _EDGES.sub("", token)


def token_key(token: str) -> str:
    """What two words are compared by: lower case, without marks around them."""
    low = token.lower()
    return low if low.isalnum() else _without_edges(low)


def stable_prefix(before: str, after: str) -> str:
    a, b = before.split(), list(regex.finditer(r"\S+", after))
    n = 0
    while n < min(len(a), len(b)) and token_key(a[n]) == token_key(b[n][0]):
        n += 1
    return after[: b[n - 1].end()].strip() if n else ""


def strip_overlap(before: str, after: str) -> str:
    a, b = [token_key(t) for t in before.split()], [token_key(t) for t in after.split()]
    n = next((k for k in range(min(len(a), len(b)), 0, -1) if a[-k:] == b[:k]), 0)
    return " ".join(after.split()[n:])


@dataclass
class Buffer:
    """The audio of a session that may still be decoded: what `most_ms` hold, at most, and where it begins."""

    rate: int
    most_ms: float = 29_000.0
    begin: int = 0  # samples that have been let go
    samples: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def append(self, frame: np.ndarray) -> None:
        self.samples = np.concatenate([self.samples, np.asarray(frame, np.float32)])
        self.trim(self.most_ms)

    def trim(self, keep_ms: float) -> None:
        """Lets go of all but the last `keep_ms`."""
        gone = max(0, len(self.samples) - int(keep_ms * self.rate / 1000))
        self.begin, self.samples = self.begin + gone, self.samples[gone:]

    def window(self, most_ms: float) -> tuple[np.ndarray, float]:
        """The last `most_ms` of the audio and the time at which they begin."""
        n = min(len(self.samples), int(most_ms * self.rate / 1000))
        return self.samples[len(self.samples) - n :], (self.begin + len(self.samples) - n) / self.rate * 1000

    @property
    def consumed_ms(self) -> float:
        return (self.begin + len(self.samples)) / self.rate * 1000


def frames_to_updates(frames: DataFrame, recogniser: Callable, rate: int = 16_000, partial_ms: float = 15_000.0, final_ms: float = 29_000.0) -> DataFrame:
    """Updates (UPDATES) of a table of frames (session_id, seq, kind, samples): each session's audio in order, decoded over bounded windows.

    The recogniser takes samples and a rate and gives (text, speech start, speech end) in ms of the window, or None; a flush
    or stop is decoded over `final_ms`, any other frame over `partial_ms`.
    """

    def decode(held: Buffer, r: dict) -> Iterator[dict]:
        if r["samples"] is not None:
            held.append(r["samples"])
        window, at = held.window(final_ms if r["kind"] in ("flush", "stop") else partial_ms)
        heard = recogniser(window, rate) if len(window) else None
        text, a, b = heard if heard else ("", None, None)
        yield {"seq": r["seq"], "kind": r["kind"], "consumed_ms": held.consumed_ms, "speech_start_ms": None if a is None else at + a, "speech_end_ms": None if b is None else at + b, "hypothesis": text}

    return in_order(frames.select("session_id", "seq", "kind", "samples"), ["session_id"], ["seq"], lambda: Buffer(rate, final_ms), decode, UPDATES, _UPDATES)


def write_events(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """The events of a stream as JSON lines below `path`; `trigger` as for a stream's trigger()."""
    lines = stream.select("session_id", F.to_json(F.struct(*[c for c in stream.columns if c != "session_id"])).alias("value"))
    return lines.writeStream.format("text").partitionBy("session_id").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


@dataclass
class Session:
    """What a session keeps between updates; a few scalars, whatever its length."""

    cue_id: int = 0
    cut_ms: float = 0.0
    floor_ms: float = 0.0
    start_ms: float = -1.0
    updated_ms: float = 0.0
    hypothesis: str = ""
    partial: str = ""
    final: str = ""
    stopped: bool = False
    last_seq: int = -(1 << 62)

    def take(self, row: dict, silence_ms: float = SILENCE_MS, most_ms: float = MOST_MS, update_ms: float = UPDATE_MS) -> Iterator[dict]:
        """The events of one update."""
        if self.stopped or row["seq"] <= self.last_seq:
            return  # what comes after a stop, or late behind rows of an earlier batch, changes nothing
        self.last_seq = row["seq"]
        now, said = row["consumed_ms"] or 0.0, " ".join((row["hypothesis"] or "").split())
        speech = row["speech_end_ms"] is not None and row["speech_end_ms"] == row["speech_end_ms"]
        if speech and self.start_ms < 0:
            self.start_ms = max(row["speech_start_ms"] or 0.0, self.floor_ms)
        forced = row["kind"] in ("flush", "stop")
        if speech and (forced or now - self.cut_ms >= most_ms or now - row["speech_end_ms"] >= silence_ms):
            yield from self._final(row["seq"], said, row["speech_end_ms"], now)
        elif not speech and now - self.cut_ms > silence_ms:
            self.cut_ms = max(self.cut_ms, now - TAIL_MS)
        elif speech and now - self.updated_ms >= update_ms:
            self.updated_ms = now
            sure, self.hypothesis = stable_prefix(self.hypothesis, said), said
            if sure and sure != self.partial:
                self.partial = sure
                yield {"seq": row["seq"], "type": "partial", "cue_id": None, "text": sure, "start_ms": None, "end_ms": None}
        if row["kind"] == "stop":
            self.stopped = True

    def _final(self, seq: int, said: str, speech_end: float, now: float) -> Iterator[dict]:
        text = strip_overlap(self.final, said)
        start = max(0.0, float(int((self.start_ms if self.start_ms >= 0 else self.cut_ms) + 0.5)))
        end = max(start, float(int(speech_end + 0.5)))
        if said:
            self.final = said
        if text:
            self.cue_id += 1
            yield {"seq": seq, "type": "final", "cue_id": self.cue_id, "text": text, "start_ms": start, "end_ms": end}
        self.cut_ms, self.floor_ms, self.start_ms, self.hypothesis, self.partial, self.updated_ms = max(self.cut_ms, now - TAIL_MS), end, -1.0, "", "", now


_COLUMNS = ["session_id", "seq", "type", "cue_id", "text", "start_ms", "end_ms"]
_STATE = "cue_id int, cut_ms double, floor_ms double, start_ms double, updated_ms double, hypothesis string, partial string, final string, stopped boolean, last_seq long"


def _events(key: str, state: Session, rows: pd.DataFrame) -> pd.DataFrame:
    out = [e | {"session_id": key} for row in rows.sort_values("seq", kind="stable").to_dict("records") for e in state.take(row)]
    frame = pd.DataFrame(out, columns=_COLUMNS)
    return frame.astype({"cue_id": "Int32"})


def events(updates: DataFrame, idle_ms: int | None = 3_600_000) -> DataFrame:
    """The events of a stream of updates. State is a row for each live session; sessions idle for `idle_ms` leave it.

    With None none leaves, and a query over what is available now ends by itself.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session = Session(*state.get) if state.exists else Session()
        rows = pd.concat(list(batches))
        yield _events(key[0], session, rows)
        state.update(tuple(asdict(session).values()))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    return updates.groupBy("session_id").applyInPandasWithState(step, EVENTS, _STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def batch(updates: DataFrame) -> DataFrame:
    """The same events from a table of updates, each session in order."""
    return in_order(updates, ["session_id"], ["seq"], Session, lambda session, row: session.take(row), EVENTS, _EVENTS)


def finals_translated(stream: DataFrame, translate) -> DataFrame:
    """Finals with a translation beside them; what a translator raises becomes `error`. translate: texts to texts."""

    @F.pandas_udf("text string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        try:
            return pd.DataFrame({"text": translate(list(texts)), "error": [None] * len(texts)})
        except Exception:  # then one by one: an error of one cue is its row's result
            out, errors = [], []
        for t in texts:
            try:
                out.append(translate([t])[0])
                errors.append(None)
            except Exception as e:
                out.append(None)
                errors.append(str(e))
        return pd.DataFrame({"text": out, "error": errors})

    return stream.where("type = 'final'").withColumn("_t", run("text")).select(*stream.columns, F.col("_t.text").alias("translation"), F.col("_t.error").alias("error"))


def sessions_by_gap(rows: DataFrame, by: list[str], order: list[str], gap_ms: float, most_ms: float, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Sessions of intervals: one ends at a gap of `gap_ms` behind all before, or where it would be `most_ms` long or more.

    The cut at a length hangs on the cut before, so the rows of a medium are walked in order; only sums are kept on the way.
    """

    def cut(table: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        s, e = table["_s"].to_pylist(), table["_e"].to_pylist()
        medium, out = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            first, last, n, reached = s[a], e[a], 0, float("-inf")
            for i in range(a, b):
                if n and (s[i] - reached >= gap_ms or e[i] - first >= most_ms):
                    medium.append(a), out.append((first, last, n))
                    first, last, n = s[i], e[i], 0
                last, n, reached = max(last, e[i]), n + 1, max(reached, e[i])
            medium.append(a), out.append((first, last, n))
        keys = [table[k].take(pa.array(medium, pa.int64())).combine_chunks() for k in by]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([*keys, pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int32())], [*by, "start_ms", "end_ms", "n_rows"])

    types = dict(rows.dtypes)
    told = rows.select(*by, *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.col(start).cast("double").alias("_s"), F.col(end).cast("double").alias("_e"))
    schema = ", ".join(f"`{k}` {types[k]}" for k in by) + ", start_ms double, end_ms double, n_rows int"
    return by_medium(told, by, [f"_o{i}" for i in range(len(order))], cut, schema)
