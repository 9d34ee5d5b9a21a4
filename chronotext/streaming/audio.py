"""Live audio in keyed stream state: the current segment's samples, bounded windows for the recogniser, cuts and their events.

A session's input is a row for each frame of samples (or for a flush or stop), with an event time and a number. Its state is
the frames that are still held, each under its number, and one row of scalars. Held are the samples since the last cut: they
are cut to their tail of 200 ms after a final, and while nothing is said for 600 ms, so a session never holds more than
`most_ms` and a frame. What is said and where are two functions of samples and rate, the caller's:

    hear(samples, rate) -> text            speech(samples, rate) -> [(start_ms, end_ms), ...]

A final comes where speech has been silent for `silence_ms`, where `most_ms` are held, or on a flush or stop; in between a
partial every `update_ms`, of what two hypotheses agree on. `batch` gives the same events from a table, over sessions in
order, and holds no more of one than the stream does.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, MutableMapping
from dataclasses import asdict, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.media_runs import in_order
from ..operators.signal import regions
from .live import _EVENTS, EVENTS, MOST_MS, SILENCE_MS, TAIL_MS, UPDATE_MS, stable_prefix, strip_overlap
from .ordered import InOrder, by_value, watermarked

FRAMES = "session_id string, seq long, ts timestamp, kind string, samples array<float>"
PARTIAL_MS, FINAL_MS = 15_000.0, 29_000.0
_RESULTS = ["session_id", "seq", "type", "cue_id", "text", "start_ms", "end_ms"]

Hear = Callable[[np.ndarray, int], str]
Speech = Callable[[np.ndarray, int], list[tuple[float, float]]]


@dataclass
class Scalars:
    """What a session keeps beside its samples."""

    first: int = 0  # number of the first frame that is held
    last: int = 0  # and of the next one to come
    held: int = 0  # samples
    gone: int = 0
    updated: int = 0  # samples taken in when the last partial was due
    start_ms: float = -1.0
    floor_ms: float = 0.0
    hypothesis: str = ""
    partial: str = ""
    final: str = ""
    cue_id: int = 0
    stopped: bool = False


_SCALARS = ", ".join(f"{f.name} {({'int': 'long', 'float': 'double', 'str': 'string', 'bool': 'boolean'})[f.type]}" for f in fields(Scalars))


@dataclass(frozen=True)
class Settings:
    hear: Hear
    speech: Speech = regions
    rate: int = 16_000
    silence_ms: float = SILENCE_MS
    most_ms: float = MOST_MS
    update_ms: float = UPDATE_MS
    tail_ms: float = TAIL_MS


def _whole(ms: float) -> float:
    return float(math.floor(ms + 0.5))


class Segment:
    """A session at work: scalars, and the held frames by number (a dict, or a map state behind one)."""

    def __init__(self, settings: Settings, scalars: Scalars, frames: MutableMapping[int, np.ndarray]):
        self.settings, self.now, self.frames = settings, scalars, frames

    def _ms(self, samples: int) -> float:
        return samples * 1000 / self.settings.rate  # multiplied first: whole milliseconds come out whole

    @property
    def consumed(self) -> int:
        return self.now.gone + self.now.held

    @property
    def consumed_ms(self) -> float:
        return self._ms(self.consumed)

    @property
    def begin_ms(self) -> float:
        return self._ms(self.now.gone)

    def samples(self) -> np.ndarray:
        parts = [self.frames[i] for i in range(self.now.first, self.now.last)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def append(self, frame: np.ndarray) -> None:
        if len(frame):
            self.frames[self.now.last] = np.asarray(frame, np.float32)
            self.now.last += 1
            self.now.held += len(frame)

    def trim(self, keep_ms: float) -> None:
        """Lets go of all but the last `keep_ms`: frames as a whole, and the beginning of the first that stays."""
        more = self.now.held - max(0, int(_whole(keep_ms / 1000 * self.settings.rate)))
        if more <= 0:
            return
        self.now.held, self.now.gone = self.now.held - more, self.now.gone + more
        while more:
            frame = self.frames[self.now.first]
            if len(frame) <= more:
                more -= len(frame)
                del self.frames[self.now.first]
                self.now.first += 1
            else:
                self.frames[self.now.first] = frame[more:]
                more = 0

    def take(self, row: dict) -> Iterator[dict]:
        """The events of one row: `no`, kind and samples."""
        s, now = self.settings, self.now
        if now.stopped:
            return
        forced = row["kind"] in ("flush", "stop")
        if row["samples"] is not None and not forced:
            self.append(np.asarray(row["samples"], np.float32))
        heard = self.samples()
        found = s.speech(heard, s.rate) if len(heard) else []
        if found:
            if now.start_ms < 0:
                now.start_ms = max(self.begin_ms + found[0][0], now.floor_ms)
            end, held_ms = self.begin_ms + found[-1][1], self._ms(now.held)
            if forced or now.held * 1000 >= s.most_ms * s.rate or held_ms - found[-1][1] >= s.silence_ms:
                yield from self._final(row["no"], heard, end)
            elif (self.consumed - now.updated) * 1000 >= s.update_ms * s.rate:
                now.updated = self.consumed
                yield from self._partial(row["no"], heard)
        elif forced:
            self._reset(self.consumed_ms)
        elif now.held * 1000 > s.silence_ms * s.rate:
            self.trim(s.tail_ms)
        if row["kind"] == "stop":
            now.stopped = True
            self.trim(0)

    def _window(self, heard: np.ndarray, most_ms: float) -> np.ndarray:
        return heard[max(0, len(heard) - int(most_ms / 1000 * self.settings.rate)) :]

    def _partial(self, seq: int, heard: np.ndarray) -> Iterator[dict]:
        said = " ".join(self.settings.hear(self._window(heard, PARTIAL_MS), self.settings.rate).split())
        sure, self.now.hypothesis = stable_prefix(self.now.hypothesis, said), said
        if sure and sure != self.now.partial:
            self.now.partial = sure
            yield {"seq": seq, "type": "partial", "cue_id": None, "text": sure, "start_ms": None, "end_ms": None}

    def _final(self, seq: int, heard: np.ndarray, end_ms: float) -> Iterator[dict]:
        said = " ".join(self.settings.hear(self._window(heard, FINAL_MS), self.settings.rate).split())
        text = strip_overlap(self.now.final, said)
        start = max(0.0, _whole(self.now.start_ms))
        end = max(start, _whole(end_ms))
        if said:
            self.now.final = said
        if text:
            self.now.cue_id += 1
            yield {"seq": seq, "type": "final", "cue_id": self.now.cue_id, "text": text, "start_ms": start, "end_ms": end}
        self.trim(self.settings.tail_ms)
        self._reset(end)

    def _reset(self, end_ms: float) -> None:
        self.now.hypothesis, self.now.partial, self.now.start_ms = "", "", -1.0
        self.now.floor_ms = max(self.now.floor_ms, end_ms)


class _Held(MutableMapping):
    """A map state of frames as a dict: what is read is kept, and only what has changed goes back."""

    def __init__(self, state):
        self.state, self.known, self.changed = state, {}, set()

    def __getitem__(self, i):
        if i not in self.known:
            self.known[i] = np.asarray(self.state.getValue((i,))[0], np.float32)
        return self.known[i]

    def __setitem__(self, i, frame):
        self.known[i] = frame
        self.changed.add(i)

    def __delitem__(self, i):
        self.known.pop(i, None)
        self.changed.add(i)

    def __iter__(self):
        return iter(self.known)

    def __len__(self):
        return len(self.known)

    def flush(self) -> None:
        for i in sorted(self.changed):
            if i in self.known:
                self.state.updateValue((i,), (self.known[i].tolist(),))
            elif self.state.containsKey((i,)):
                self.state.removeKey((i,))


class AudioSessions(InOrder):
    """Frames applied in order (see InOrder), with the frames that a session holds in a map state and its scalars in a value state."""

    def __init__(self, settings: Settings, idle_ms: int | None):
        super().__init__({"kind": "string", "samples": "array<float>"}, _RESULTS, idle_ms)
        self.settings = settings

    def init(self, handle) -> None:
        super().init(handle)
        self.frames = handle.getMapState("frames", "n long", "samples array<float>")
        self.scalars = handle.getValueState("scalars", _SCALARS)

    def apply(self, key, rows, n):
        held = _Held(self.frames)
        segment = Segment(self.settings, Scalars(*self.scalars.get()) if self.scalars.exists() else Scalars(), held)
        for row in rows:
            for event in segment.take(row):
                yield event | {"session_id": key[0]}
        held.flush()
        self.scalars.update(tuple(asdict(segment.now).values()))

    def late(self, key, row, count):
        return {"session_id": key[0], "seq": int(row["no"]), "type": "late", "cue_id": count, "text": None, "start_ms": None, "end_ms": None}

    def forget(self):
        self.frames.clear()
        self.scalars.clear()


def events(frames: DataFrame, settings: Settings, delay: str = "10 seconds", idle_ms: int | None = 3_600_000) -> DataFrame:
    """The events (EVENTS) of a stream of FRAMES; a frame that comes after its turn is an event `late`, whose cue_id counts such frames."""
    rows = watermarked(frames, ["session_id"], "ts", "seq", {"kind": "kind", "samples": "samples"}, delay)
    with by_value():
        return rows.groupBy("k0").transformWithStateInPandas(AudioSessions(settings, idle_ms), EVENTS, "Append", "EventTime")


def batch(frames: DataFrame, settings: Settings) -> DataFrame:
    """The same events from a table of FRAMES. A task holds one Arrow batch and what one session holds."""
    told = frames.select("session_id", F.unix_millis("ts").alias("at_ms"), F.col("seq").alias("no"), "kind", "samples").dropna(subset=["session_id", "at_ms", "no"])
    once = told.dropDuplicates(["session_id", "at_ms", "no"])
    return in_order(once, ["session_id"], ["at_ms", "no"], lambda: Segment(settings, Scalars(), {}), lambda segment, row: segment.take(row), EVENTS, _EVENTS)
