"""Order-dependent folds per key: alert cooldown and the scalar Kalman filter, in batch form."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefeat import micros
from .chains import affine_scan, chain, kalman_steps, last_of
from .scan import numbered

DAY_US = 86_400_000_000


def runs(parts: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition that is sorted by ``by``, one frame each.

    One pass over Arrow batches; only the group at hand is held, which keeps the cost per small
    group far below that of a separate call for each.
    """
    by, held = list(by), None
    for pdf in parts:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        if pdf.empty:
            continue
        change = np.zeros(len(pdf), dtype=bool)
        for c in by:
            v, none = pdf[c].to_numpy(), pdf[c].isna().to_numpy()
            change[1:] |= (v[1:] != v[:-1]) & ~(none[1:] & none[:-1])
        edges = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(edges, edges[1:]):
            yield pdf.iloc[a:b]
        held = pdf.iloc[edges[-1]:]
    if held is not None:
        yield held


def packed(frames: Iterator[pd.DataFrame], rows: int = 20000) -> Iterator[pd.DataFrame]:
    """Join small result frames to batches of about ``rows`` rows."""
    some, n = [], 0
    for f in frames:
        some.append(f)
        n += len(f)
        if n >= rows:
            yield pd.concat(some, ignore_index=True)
            some, n = [], 0
    if some:
        yield pd.concat(some, ignore_index=True)


def by_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn, schema: str) -> DataFrame:
    """``fn`` on each group of ``keys``, rows in ``order``; groups must be of bounded size."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(
        lambda parts: packed(fn(g) for g in runs(parts, keys)), schema)


def cooldown(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, chunk_us: int = DAY_US) -> DataFrame:
    """Times at which an alert is emitted: none was *emitted* for the key in the last ``seconds``.

    Equal times of a key collapse first. Then each (key, day) is reduced to a table "first alert
    here -> last alert of the day", needed only for starts within ``seconds`` of the day's begin;
    the chain over these small tables gives every day its start; and the days are
    expanded side by side. Links to the next alert are doubled, so no step runs alert by alert; the
    tables of a key grow with the time span, not with the row count.
    """
    keys = list(keys)
    cd = seconds * 1_000_000
    cand = (df.select(*keys, micros(F.col(ts)).alias("_us")).distinct()
            .withColumn("_day", F.floor(F.col("_us") / chunk_us).cast("long")))
    ks = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cand.select(*keys).schema.fields)

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf["_us"].to_numpy()
        last = t[last_of(np.searchsorted(t, t + cd, "left"))]
        day = int(pdf["_day"].iloc[0])
        m = int(np.searchsorted(t, day * chunk_us + cd, "left")) + 1
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "_day": [day], "_starts": [t[:m].tolist()], "_ends": [last[:m].tolist()]})

    tables = by_group(cand, [*keys, "_day"], ["_us"], links, f"{ks}, _day long, _starts array<long>, _ends array<long>")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        starts, ends = (np.concatenate([np.asarray(x) for x in pdf[c]]) for c in ("_starts", "_ends"))
        days = np.repeat(pdf["_day"].to_numpy(), [len(x) for x in pdf["_starts"]])
        # a day's last alert bars all later starts of that day, so the next start lies in another day
        on = chain(np.searchsorted(starts, ends + cd, "left"), 0)
        out = pd.DataFrame({"_day": days[on], "_start": starts[on]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "_day", "_start"]]

    begin = by_group(tables, keys, ["_day"], walk, f"{ks}, _day long, _start long")

    def expand(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf["_us"].to_numpy()
        on = chain(np.searchsorted(t, t + cd, "left"), int(np.searchsorted(t, pdf["_start"].iloc[0], "left")))
        out = pd.DataFrame({"_us": t[on]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "_us"]]

    b = begin.select(*[F.col(c).alias(f"_b_{c}") for c in (*keys, "_day")], "_start")
    same = [cand[c].eqNullSafe(b[f"_b_{c}"]) for c in (*keys, "_day")]  # a null key is a key
    open_days = cand.join(b, same).where(F.col("_us") >= F.col("_start")).select(*cand.columns, "_start")
    emitted = by_group(open_days, [*keys, "_day"], ["_us"], expand, f"{ks}, _us long")
    return emitted.select(*keys, F.timestamp_micros("_us").cast(df.schema[ts].dataType).alias(ts))


def kalman_gains(q: float, r: float, n: int) -> list[tuple[float, float]]:
    """(gain, variance) of the first ``n`` steps; they depend on the step number only."""
    gain, p = kalman_steps(r, q, r, np.arange(1, n + 1))
    return list(zip(gain.tolist(), p.tolist()))


def kalman(df: DataFrame, keys: Sequence[str], ts: str, tie: str, z: str, q: float = 0.5, r: float = 4.0,
           block: int = 8192) -> DataFrame:
    """Filtered value, gain and standard deviation of every row, per key in time order.

    The gain depends on the row number only, so each step is a map ``x -> a * x + b``. Maps are composed block by block, the
    blocks' compositions are scanned per key, and every block goes on from the value before it. The first step takes the measurement itself.
    """
    keys = list(keys)
    rows = numbered(df.select(*keys, ts, tie, F.col(z).cast("double").alias("_z")), keys, ts, [ts, tie])
    rows = rows.withColumn("_block", F.floor((F.col("rn") - 1) / block).cast("long"))
    ks = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def maps(pdf: pd.DataFrame):
        n = pdf["rn"].to_numpy()
        gain, p = kalman_steps(r, q, r, n)
        own = np.where(n == 1, 1.0, gain)
        return *affine_scan(1 - own, own * pdf["_z"].to_numpy()), gain, p

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, _, _ = maps(pdf)
        return pdf[[*keys, "_block"]].iloc[-1:].assign(_a=a[-1], _b=b[-1])

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        _, b = affine_scan(pdf["_a"].to_numpy(), pdf["_b"].to_numpy())  # the first map forgets whatever was before
        return pdf[[*keys, "_block"]].assign(_x=np.concatenate([[0.0], b[:-1]]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, gain, p = maps(pdf)
        return pdf[[*keys, ts, tie, "rn"]].assign(x=a * pdf["_x"].to_numpy() + b, gain=gain, std=np.sqrt(p))

    ends = by_group(rows, [*keys, "_block"], ["rn"], summary, f"{ks}, _block long, _a double, _b double")
    before = by_group(ends, keys, ["_block"], carry, f"{ks}, _block long, _x double")
    before = before.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, "_block")], "_x")
    same = [rows[c].eqNullSafe(before[f"_k_{c}"]) for c in (*keys, "_block")]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys, ts, tie).schema.fields)
    return by_group(rows.join(before, same).select(*rows.columns, "_x"), [*keys, "_block"], ["rn"], run, f"{out}, rn long, x double, gain double, std double")
