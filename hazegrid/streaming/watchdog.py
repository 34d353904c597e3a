"""Silent sensors, reported by event-time timers without a new message."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.timefeat import micros
from ..session import JOB_CONF

MINUTE_US = 60_000_000
#: What a session without the settings of the jobs must set for a stream of silences to start: timers need a state store of several columns.
STATE = {k: JOB_CONF[k] for k in ("spark.sql.streaming.stateStore.providerClass",)}


class Silence(StatefulProcessor):
    """Per sensor: ``active`` at the first message and the first after a silence, ``inactive`` and ``dropout`` when a silence gets too long.

    Messages wait until the watermark has passed them, so late ones within its delay take their place and the cut into micro-batches
    does not matter. A timer stands at the next time something can happen; long after a dropout the state is removed.
    """

    def __init__(self, silent_us: int, dropout_us: int, forget_us: int):
        self.limits = ((silent_us, "inactive"), (dropout_us, "dropout"))
        self.forget = forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "last long, phase int, timer long")
        self.waiting = handle.getListState("waiting", "us long")

    def _advance(self, key, mark_us: int, new: list[int]) -> Iterator[pd.DataFrame]:
        last, phase, timer = self.state.get() if self.state.exists() else (None, 0, None)
        wait = sorted({int(r[0]) for r in self.waiting.get()} | set(new)) if self.waiting.exists() else sorted(set(new))
        out = []

        def silences(until: int) -> None:
            nonlocal phase
            while last is not None and phase < 2 and last + self.limits[phase][0] <= until:
                out.append((last + self.limits[phase][0], self.limits[phase][1]))
                phase += 1

        while wait and wait[0] <= mark_us:
            t = wait.pop(0)
            if last is not None and t <= last:
                continue
            silences(t - 1)
            if last is None or phase:
                out.append((t, "active"))
            last, phase = t, 0
        silences(mark_us)
        if last is not None and phase == 2 and last + self.forget <= mark_us and not wait:
            self.state.clear()
            self.waiting.clear()
            last = None
        else:
            due = wait[:1] + ([last + (self.limits[phase][0] if phase < 2 else self.forget)] if last is not None else [])
            at = -(-min(due) // 1000) if due else None
            if at != timer:
                if timer is not None and timer * 1000 > mark_us:
                    self.handle.deleteTimer(timer)
                if at is not None:
                    self.handle.registerTimer(at)
            self.state.update((last, phase, at))
            if wait:
                self.waiting.put([(t,) for t in wait])
            elif self.waiting.exists():
                self.waiting.clear()
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "at_us": [a for a, _ in out], "status": [s for _, s in out]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [int(t) for pdf in rows for t in pdf["us"]]
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            last, phase, timer = self.state.get()
            if timer is not None and timer <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.update((last, phase, None))  # it has gone off
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000, [])

    def close(self) -> None:
        pass


def silence_stream(messages: DataFrame, silent_min: int = 10, dropout_min: int = 30, late: str = "1 minute", forget_min: int = 7 * 24 * 60) -> DataFrame:
    """``(sensor_id, at_us, status)`` of a stream ``messages(sensor_id, ts)``: each change of a sensor's state at its own time.

    Rows without a time are left out. The stream is started with the settings ``STATE``, as by ``to_table(..., conf=STATE)``.
    """
    kind = messages.schema["sensor_id"].dataType.simpleString()
    # a text that is never null: null among numbers would turn the keys of its rows' neighbours into floating point
    key = F.coalesce(F.concat(F.lit("="), F.col("sensor_id").cast("string")), F.lit("")).alias("key")
    d = messages.where(messages["ts"].isNotNull()).withWatermark("ts", late).select(key, "ts", micros(messages["ts"]).alias("us"))
    p = Silence(silent_min * MINUTE_US, dropout_min * MINUTE_US, forget_min * MINUTE_US)
    told = d.groupBy("key").transformWithStateInPandas(p, outputStructType="key string, at_us long, status string", outputMode="Append", timeMode="EventTime")
    return told.select(F.when(F.col("key") != "", F.substr("key", F.lit(2)).cast(kind)).alias("sensor_id"), "at_us", "status")
