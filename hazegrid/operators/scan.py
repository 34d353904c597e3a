"""Ordered computations per key that stay parallel when one key holds a large share of the rows.

A plain window ``PARTITION BY key ORDER BY ts`` puts a whole key into one task. Here the rows of a
key are cut into time chunks; each chunk is scanned on its own and gets a *carry* — the combined
result of all earlier chunks — from a small per-chunk summary. Sum, count, min, max and
last-value are associative, so the outcome equals the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timefeat import micros

HOUR = 3600


def chunk_of(ts: Column, seconds: int = HOUR) -> Column:
    return F.floor(micros(ts) / (seconds * 1_000_000)).cast("long")


def _agg(kind: str, c: Column, order: Column | None = None) -> Column:
    if kind == "last":
        return F.max_by(c, F.when(c.isNotNull(), order))
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](c)


def running(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], what: dict[str, tuple[str, Column]],
            chunk_s: int = HOUR, inclusive: bool = True, reverse: bool = False) -> DataFrame:
    """Add running aggregates ``name: (kind, column)``; kind in sum, count, min, max, last.

    ``order`` lists the ordering columns (``ts`` first). ``reverse`` scans from the newest row, so
    ``last`` then means the next value. ``inclusive=False`` leaves the current row out.
    """
    keys = list(keys)
    # one struct key: equal to itself even with null parts, and shared by window and join, so that the
    # rows are shuffled once
    d = df.withColumn("_k", F.struct(*keys, chunk_of(F.col(ts), chunk_s).alias("_chunk")))
    sort = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    rank = F.struct(*[F.col(c) for c in order])
    summary = d.groupBy("_k").agg(*[
        (F.min_by(c, F.when(c.isNotNull(), rank)) if kind == "last" and reverse else _agg(kind, c, rank)).alias(n)
        for n, (kind, c) in what.items()])
    at = F.col("_k._chunk")
    before = (W.partitionBy(*[F.col("_k")[k] for k in keys]).orderBy(at.desc() if reverse else at.asc())
              .rowsBetween(W.unboundedPreceding, -1))
    over_chunks = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min,
                   "last": lambda c: F.last(c, ignorenulls=True)}
    carry = summary.select("_k", *[over_chunks[kind](F.col(n)).over(before).alias(f"_c_{n}")
                                   for n, (kind, _) in what.items()])
    w = W.partitionBy("_k").orderBy(*sort).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = d.select("*", *[(F.last(c, ignorenulls=True) if kind == "last" else _agg(kind, c)).over(w).alias(f"_l_{n}")
                            for n, (kind, c) in what.items()])
    j = local.join(carry, "_k", "left")

    def merged(n: str, kind: str) -> Column:
        here, held = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if kind == "count":
            return F.coalesce(here, F.lit(0)) + F.coalesce(held, F.lit(0))
        if kind == "sum":
            return F.when(here.isNotNull() | held.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(held, F.lit(0)))
        return {"max": F.greatest, "min": F.least, "last": F.coalesce}[kind](here, held)

    return j.select(*df.columns, *[merged(n, kind).alias(n) for n, (kind, _) in what.items()])


def numbered(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], name: str = "rn",
             chunk_s: int = HOUR) -> DataFrame:
    """Row number per key in ``order`` (``ts`` first), starting at 1."""
    return running(df, keys, ts, order, {name: ("count", F.lit(1))}, chunk_s)


def with_halo(df: DataFrame, rn: str, block: int, before: int = 0, after: int = 0) -> DataFrame:
    """Cut numbered rows into blocks of ``block`` rows and copy the edge rows to the next block.

    Adds ``_block``; rows whose ``_own`` is another block are copies, to be dropped with
    :func:`drop_halo` after the block-wise window. Windows of up to ``before``/``after`` rows
    partitioned by (key, ``_block``) then equal windows over the whole key.
    """
    if max(before, after) > block:
        raise ValueError("halo wider than a block")
    own = F.floor((F.col(rn) - 1) / block).cast("long")
    d = df.withColumn("_own", own)
    parts = [F.col("_own")]
    if before:
        parts.append(F.when(F.col(rn) > (F.col("_own") + 1) * block - before, F.col("_own") + 1))
    if after:
        parts.append(F.when((F.col(rn) <= F.col("_own") * block + after) & (F.col("_own") > 0), F.col("_own") - 1))
    return d.withColumn("_block", F.explode(F.array_compact(F.array(*parts))))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col("_own") == F.col("_block")).drop("_own", "_block")


def row_windows(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], build, before: int = 0,
                after: int = 0, block: int = 65536) -> DataFrame:
    """Columns over windows of at most ``before``/``after`` rows around the current one.

    ``build(window_spec)`` returns ``{name: Column}``; the spec is partitioned by (key, block) and
    ordered by ``order``. Adds the row number ``rn`` too.
    """
    d = with_halo(numbered(df, keys, ts, order), "rn", block, before, after)
    cols = build(W.partitionBy(*keys, "_block").orderBy(*order))
    return drop_halo(d.select("*", *[c.alias(n) for n, c in cols.items()]))


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, right_tie: Sequence[str],
         take: Sequence[str], direction: str = "backward", inclusive: bool = True, chunk_s: int = HOUR) -> DataFrame:
    """Each left row with the columns ``take`` of the latest right row at or before its time.

    ``direction='forward'`` takes the first right row at or after. Among right rows at the same
    time the greatest ``right_tie`` wins (forward: the smallest). Ordered union plus
    running last value; no pair of rows is ever built.
    """
    back = direction == "backward"
    # at equal times a right row must be met before the left row iff the match is inclusive
    l_side = 1 if back == inclusive else 0
    l = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(l_side).alias("_side"),
                    F.struct(*left.columns).alias("_l"))
    r = right.select(*keys, F.col(right_ts).alias("_ts"), F.lit(1 - l_side).alias("_side"),
                     F.struct(*[F.col(c) for c in right_tie]).alias("_tie"),
                     F.struct(*[F.col(c) for c in take]).alias("_r"))
    u = l.unionByName(r, allowMissingColumns=True)
    s = running(u, keys, "_ts", ["_ts", "_side", "_tie"], {"_hit": ("last", F.col("_r"))}, chunk_s, reverse=not back)
    return s.where(F.col("_l").isNotNull()).select("_l.*", *[F.col("_hit")[c].alias(c) for c in take])
