"""Live task views, transcript sessions and a voice gate on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.store import change_ticker

#: Fixed values of the gate.
FLOOR_FALL, FLOOR_RISE, FLOOR_CAP, OVER_FLOOR, LEAST_RMS = 0.5, 0.0005, 0.01, 2.5, 0.0015


def watch(changes: DataFrame, snapshot: Callable[[], DataFrame], emit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``emit`` with the whole snapshot after each batch of changes that moved the table."""
    last: list = [None]

    def batch(_: DataFrame, number: int) -> None:
        now = snapshot()
        mark = tuple(change_ticker(now).first())
        if mark != last[0]:
            last[0] = mark
            emit(now, number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_state(events: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """Stateful rows on event time; the state is kept in RocksDB, which timers need."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return events.groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def _millis(times: pd.Series) -> int:
    return int(pd.Timestamp(times.max()).value // 1_000_000)


class _Session(StatefulProcessor):
    """What a session has said: its events by number, and after its end only that it is over."""

    def __init__(self, timeout_ms: int, keep_ms: int):
        self.timeout_ms, self.keep_ms = timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "seq long", "kind string, text string")
        self.mark = handle.getValueState("mark", "due long, over boolean")

    def _due(self, at: int, over: bool) -> None:
        """One timer a session: it ends a session that is open, and forgets one that is over."""
        if self.mark.exists():
            self.handle.deleteTimer(self.mark.get()[0])
        self.mark.update((at, over))
        self.handle.registerTimer(at)

    @staticmethod
    def _last_partial(events: dict[int, tuple[str, str]], before: int | None) -> str:
        said = [n for n, (kind, _) in events.items() if kind == "partial" and (before is None or n < before)]
        return events[max(said)][1] if said else ""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = 0
        over = self.mark.exists() and self.mark.get()[1]
        for frame in rows:
            last = max(last, _millis(frame["at"]))
            if not over:
                for e in frame.itertuples():
                    if not self.events.containsKey((e.seq,)):
                        self.events.updateValue((e.seq,), (e.kind, e.text or ""))
        if over:
            return
        events = {n[0]: tuple(v) for n, v in self.events.iterator()}
        finals = sorted(n for n, (kind, _) in events.items() if kind == "final")
        done = min((n for n, (kind, _) in events.items() if kind == "done"), default=None)
        # A final counts once all before it that could be final are there; a done, once every event before it is.
        text = outcome = None
        if finals and all(n in events for n in range(finals[0])):
            text, outcome = events[finals[0]][1], "final"
        elif done is not None and not finals and all(n in events for n in range(done)):
            text, outcome = self._last_partial(events, done), "partial"
        if outcome is None:
            self._due(last + self.timeout_ms, False)
            return
        self.events.clear()
        self._due(last + self.keep_ms, True)
        yield pd.DataFrame({"session": [key[0]], "text": [text], "outcome": [outcome]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.mark.get()[1]:
            events = {n[0]: tuple(v) for n, v in self.events.iterator()}
            finals = sorted(n for n, (kind, _) in events.items() if kind == "final")
            done = min((n for n, (kind, _) in events.items() if kind == "done"), default=None)
            text = events[finals[0]][1] if finals else self._last_partial(events, done)
            yield pd.DataFrame({"session": [key[0]], "text": [text], "outcome": ["final" if finals else "partial" if done is not None else "timeout"]})
        self.events.clear()
        self.mark.clear()

    def close(self) -> None:
        pass


def final_transcripts(events: DataFrame, timeout_ms: int = 30_000, keep_ms: int = 600_000) -> DataFrame:
    """One row per session from (session, seq, kind, text, at): the first final text, or the last partial at done or timeout.

    ``at`` is the event time, under a watermark.  Kinds are "partial", "final" and "done"; events are numbered from 0 in each session.  A final
    counts once every event before it is there, and a done likewise, so what arrives late but in time changes nothing about the result.  A session
    without new events for ``timeout_ms`` of event time ends with what it has.  A session that is over is remembered for ``keep_ms``
    and then forgotten; repeated events count once; null texts are empty.
    """
    return _with_state(events, "session", _Session(timeout_ms, keep_ms), "session string, text string, outcome string")


class _Windows(StatefulProcessor):
    """Pieces that wait for those before them, and the window that is open."""

    def __init__(self, seconds: float, idle_ms: int):
        self.seconds, self.idle_ms = seconds, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long", "seconds double, text string")
        self.open = handle.getValueState("open", "next long, window long, length double, text string, due long")

    def _add(self, key, pieces, state):
        n, window, length, text, _ = state
        out = []
        while n in pieces:
            seconds, said = pieces.pop(n)
            self.waiting.removeKey((n,))
            n, length, text = n + 1, length + seconds, f"{text} {said}".strip()
            if length > self.seconds:
                out.append((key[0], window, text))
                window, length, text = window + 1, 0.0, ""
        return out, (n, window, length, text)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.open.get()) if self.open.exists() else (0, 0, 0.0, "", -1)
        last = 0
        for frame in rows:
            last = max(last, _millis(frame["at"]))
            for p in frame.itertuples():
                if p.seq >= state[0] and not self.waiting.containsKey((p.seq,)):
                    self.waiting.updateValue((p.seq,), (float(p.seconds), p.text or ""))
        out, now = self._add(key, {n[0]: tuple(v) for n, v in self.waiting.iterator()}, state)
        if state[4] >= 0:
            self.handle.deleteTimer(state[4])
        due = max(last + self.idle_ms, state[4])
        self.open.update((*now, due))
        self.handle.registerTimer(due)
        if out:
            yield pd.DataFrame(out, columns=["session", "window", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, window, length, text, _ = tuple(self.open.get())
        # Pieces whose forerunners never came are taken in their order.
        pieces, out = dict(sorted((k[0], tuple(v)) for k, v in self.waiting.iterator())), []
        for seconds, said in pieces.values():
            length, text = length + seconds, f"{text} {said}".strip()
            if length > self.seconds:
                out.append((key[0], window, text))
                window, length, text = window + 1, 0.0, ""
        if text:
            out.append((key[0], window, text))
        self.waiting.clear()
        self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=["session", "window", "text"])

    def close(self) -> None:
        pass


def committed_windows(pieces: DataFrame, seconds: float = 25.0, idle_ms: int = 60_000) -> DataFrame:
    """(session, window, text) of rows (session, seq, seconds, text, at): a window's text is committed once it has passed ``seconds``.

    ``at`` is the event time, under a watermark.  Pieces are numbered from 0 and taken in that order, whenever they arrive; repeated ones count
    once.  After ``idle_ms`` of event time without a piece what is left is committed and the session forgotten.
    """
    return _with_state(pieces, "session", _Windows(seconds, idle_ms), "session string, window long, text string")


def recordings(sessions: DataFrame, least: float = 0.9, most: float = 60.0) -> DataFrame:
    """Sessions (with ``seconds``) that are long enough, and their length as far as it is kept."""
    return sessions.where(F.col("seconds") >= least).withColumns({"stopped": F.col("seconds") >= most, "seconds": F.least("seconds", F.lit(most))})


def gate_frames(levels: np.ndarray, floor: float) -> tuple[np.ndarray, float]:
    """Whether each frame's RMS is voice, and the noise floor after them."""
    voiced = np.zeros(len(levels), bool)
    for i, rms in enumerate(levels):
        floor = floor + (rms - floor) * FLOOR_FALL if rms < floor else min(FLOOR_CAP, floor + (rms - floor) * FLOOR_RISE)
        voiced[i] = rms >= max(OVER_FLOOR * floor, LEAST_RMS)
    return voiced, float(floor)


def _level(pcm: bytes | None) -> float:
    samples = np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2") / 32768.0 if pcm else np.zeros(0)
    return float(np.sqrt(np.mean(samples**2))) if len(samples) else 0.0


class _Gate(StatefulProcessor):
    """The noise floor of a stream, the frame it has come to, and the levels of frames that wait for those before them."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long", "rms double")
        self.floor = handle.getValueState("floor", "next long, floor double, due long")

    def _judged(self, key, taken: dict[int, float], floor: float) -> tuple[list[pd.DataFrame], float]:
        if not taken:
            return [], floor
        voiced, floor = gate_frames(np.array(list(taken.values())), floor)
        return [pd.DataFrame({"stream": key[0], "seq": list(taken), "rms": list(taken.values()), "voiced": voiced})], floor

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, floor, due = tuple(self.floor.get()) if self.floor.exists() else (0, FLOOR_CAP, -1)
        last = 0
        for frame in rows:
            last = max(last, _millis(frame["at"]))
            for f in frame.itertuples():
                if f.seq >= n and not self.waiting.containsKey((f.seq,)):
                    self.waiting.updateValue((f.seq,), (_level(f.pcm),))
        held, taken = {k[0]: v[0] for k, v in self.waiting.iterator()}, {}
        while n in held:
            taken[n] = held[n]
            self.waiting.removeKey((n,))
            n += 1
        out, floor = self._judged(key, taken, floor)
        if due >= 0:
            self.handle.deleteTimer(due)
        due = max(due, last + self.idle_ms)
        self.floor.update((n, floor, due))
        self.handle.registerTimer(due)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = dict(sorted((k[0], v[0]) for k, v in self.waiting.iterator()))
        out, _ = self._judged(key, held, self.floor.get()[1])
        self.waiting.clear()
        self.floor.clear()
        yield from out

    def close(self) -> None:
        pass


def voice_gate(chunks: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """(stream, seq, rms, voiced) of rows (stream, seq, pcm, at) of 16-bit frames; the noise floor is kept per stream.

    ``at`` is the event time, under a watermark.  Frames are numbered from 0 and judged in that order, whenever they arrive; repeated ones count once, and a null
    or empty frame is silence.  A stream without a frame for ``idle_ms`` of event time is forgotten, and frames whose forerunners never came are judged then.
    """
    return _with_state(chunks, "stream", _Gate(idle_ms), "stream string, seq long, rms double, voiced boolean")


def level_ring(levels: DataFrame, bars: int = 32) -> DataFrame:
    """The newest ``bars`` levels of each stream as bar heights, oldest first."""
    newest = Window.partitionBy("stream").orderBy(F.desc("seq"))
    return levels.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= bars).select("stream", (F.lit(bars) - F.col("back")).alias("bar"), level_bar(F.col("rms")).alias("height"))


def level_bar(rms):
    """Height of a level bar, 0 to 1."""
    return F.least(F.lit(1.0), F.pow(F.least(F.greatest(rms, F.lit(0.0)), F.lit(1.0)), F.lit(0.45)) * 1.6)
