"""Keyed stream state: highest sequence number, alert cooldown and Kalman filter.

A micro-batch hands each key its new rows; they are ordered by event time and folded into the
state by array scans. A micro-batch is bounded by the source's limit per trigger, so a busy key is too.

With ``forget`` seconds and a watermark on the stream, the state of a key that has been silent for so long is removed, and rows older than
the watermark are dropped; without, state is kept for every key ever seen.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.chains import affine_scan, chain, kalman_steps


def _kinds(stream: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.select(*cols).schema.fields)


def _rows(parts, order: Sequence[str]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(list(order))


def _folded(stream: DataFrame, keys: Sequence[str], step, out, state: str, ts: str | None, forget: int | None) -> DataFrame:
    """``step`` over the rows of each key; a key without rows for ``forget`` seconds of event time loses its state."""
    def run(k, parts, held):
        if held.hasTimedOut:
            held.remove()
            return
        parts = list(parts)
        yield from step(k, parts, held)
        if forget and held.exists:
            newest = int(max(p[ts].max() for p in parts).timestamp() * 1000)
            held.setTimeoutTimestamp(max(newest, held.getCurrentWatermarkMs()) + forget * 1000)

    kind = GroupStateTimeout.EventTimeTimeout if forget else GroupStateTimeout.NoTimeout
    return stream.groupBy(*keys).applyInPandasWithState(run, out, state, "append", kind)


def seq_dedup(stream: DataFrame, key: str, seq: str, order: Sequence[str], ts: str = "ts", forget: int | None = None,
              always: str | None = None) -> DataFrame:
    """Keep rows whose number is above every earlier number of the key; keys whose rows are marked ``always`` keep all."""
    cols = stream.columns

    def step(k, parts, state):
        pdf = _rows(parts, order)
        if always and pdf[always].iloc[0]:
            yield pdf[cols]
            return
        top = state.get[0] if state.exists else np.iinfo(np.int64).min
        before = np.concatenate([[top], np.maximum.accumulate(np.maximum(pdf[seq].to_numpy(), top))[:-1]])
        state.update((int(max(top, pdf[seq].max())),))
        yield pdf.loc[pdf[seq].to_numpy() > before, cols]

    return _folded(stream, [key], step, stream.schema, "top long", ts, forget)


def cooldown(stream: DataFrame, keys: Sequence[str], ts: str, seconds: int, forget: int | None = None) -> DataFrame:
    """Pass an alert only when none was passed for the key in the last ``seconds``."""
    keys = list(keys)
    wait = seconds * 1_000_000

    def step(k, parts, state):
        pdf = _rows(parts, [ts])
        due = state.get[0] if state.exists else None
        t = pdf[ts].to_numpy().astype("datetime64[us]").astype("int64")
        on = chain(np.searchsorted(t, t + wait), 0 if due is None else int(np.searchsorted(t, due)))
        if len(on):
            due = int(t[on[-1]]) + wait
        if due is not None:
            state.update((due,))
        yield pdf.iloc[on]

    schema = stream.select(*keys, ts).schema
    return _folded(stream.select(*keys, ts), keys, step, schema, "due long", ts, forget)


def kalman(stream: DataFrame, key: str, ts: str, tie: str, z: str, q: float = 0.5, r: float = 4.0,
           initial: DataFrame | None = None, forget: int | None = None) -> DataFrame:
    """Filtered value, gain and deviation per row. ``initial`` (key, x, p) seeds keys without state."""
    d = stream.select(key, ts, tie, z)
    d = d.join(initial.selectExpr(key, "x AS _x0", "p AS _p0"), key, "left") if initial is not None else d.selectExpr(
        "*", "CAST(NULL AS DOUBLE) AS _x0", "CAST(NULL AS DOUBLE) AS _p0")

    def step(k, parts, state):
        pdf = _rows(parts, [ts, tie])
        if state.exists:
            x, p = state.get
        else:
            x, p = pdf["_x0"].iloc[0], pdf["_p0"].iloc[0]
            if pd.isna(x):
                x, p = float(pdf[z].iloc[0]), r
        g, ps = kalman_steps(p, q, r, np.arange(1, len(pdf) + 1))
        a, b = affine_scan(1 - g, g * pdf[z].to_numpy(float))
        xs = a * x + b
        state.update((float(xs[-1]), float(ps[-1])))
        yield pd.DataFrame({key: pdf[key], ts: pdf[ts], tie: pdf[tie], "x": xs, "gain": g, "p": ps})

    out = T.StructType(stream.select(key, ts, tie).schema.fields + [T.StructField(c, T.DoubleType()) for c in ("x", "gain", "p")])
    return _folded(d, [key], step, out, "x double, p double", ts, forget)
