"""Rolling statistics at any time, from five-minute panes.

A window ``[t - k h, t)`` is put together from whole hours, whole panes of the two hours that its ends fall into, and the rows of
the two panes that its ends fall into. Readings are scanned twice: once into panes (value counts, so that statistics and exact
percentiles come from the same small table), once for the rows of the end panes. Statistics are kept as number, mean and sum of squared
deviations; they are merged by Chan's formula, whole hours by sums relative to a centre, so a large mean costs no digits of the deviation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timefeat import micros
from ..session import cut

PANE_S, HOUR_S = 300, 3600
PANE_US, HOUR_US = PANE_S * 1_000_000, HOUR_S * 1_000_000
PART = "struct<n:bigint,mean:double,m2:double,lo:double,hi:double>"


def merged(parts: Column) -> Column:
    """Partial statistics of an array of them as one struct, by Chan's formula; null if there are no values."""
    def both(a, b):
        n = a["n"] + b["n"]
        d = b["mean"] - a["mean"]
        share = b["n"] / n
        return F.struct(n.alias("n"), (a["mean"] + d * share).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * share).alias("m2"),
                        F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"))

    some = F.filter(parts, lambda p: p["n"] > 0)
    return F.when(F.size(some) > 0, F.aggregate(F.slice(some, 2, F.greatest(F.size(some) - 1, F.lit(0))), F.get(some, F.lit(0)).cast(PART), lambda a, b: both(a, b).cast(PART)))


def part_of(value: Column) -> Column:
    """Partial statistics of a group's values."""
    return F.struct(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"),
                    F.min(value).alias("lo"), F.max(value).alias("hi")).cast(PART)


def framed(frame) -> Column:
    """Partial statistics of the rows ``part`` in a window frame.

    Means are summed relative to ``centre``, a value near all of them, so nothing is lost to their common size.
    """
    p, c = F.col("part"), F.col("centre")
    d = p["mean"] - c
    n = F.coalesce(F.sum(p["n"]).over(frame), F.lit(0))
    s1, s2 = F.sum(p["n"] * d).over(frame), F.sum(p["m2"] + p["n"] * d * d).over(frame)
    some = F.nullif(n, F.lit(0))
    return F.struct(n.alias("n"), (c + s1 / some).alias("mean"), F.greatest(s2 - s1 * s1 / some, F.lit(0.0)).alias("m2"),
                    F.min(p["lo"]).over(frame).alias("lo"), F.max(p["hi"]).over(frame).alias("hi")).cast(PART)


def std(part: Column) -> Column:
    return F.when(part["n"] > 1, F.sqrt(part["m2"] / (part["n"] - 1)))


def counted(readings: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``(*keys, field, hour, pane, value, c)``: how often each value occurs in each pane; written once."""
    pane = F.floor(micros(F.col("ts")) / PANE_US).cast("long")
    r = readings.where(F.col("field").isin(*fields) & F.col("value").isNotNull())
    c = r.groupBy(*keys, "field", pane.alias("pane"), F.col("value").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    return cut(c.withColumn("hour", F.floor(F.col("pane") * PANE_S / HOUR_S).cast("long")))


def pane_parts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, field, hour, pane, part)``; values that occur more than once weigh accordingly."""
    one = F.struct("c", F.col("value").alias("mean"), F.lit(0.0).alias("m2"), F.col("value").alias("lo"), F.col("value").alias("hi"))
    values = counts.groupBy(*keys, "field", "hour", "pane").agg(F.sort_array(F.collect_list(one.cast(PART))).alias("v"))
    return values.select(*keys, "field", "hour", "pane", merged(F.col("v")).alias("part"))


def hour_parts(panes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, field, hour, part)`` from the panes of each hour."""
    h = panes.groupBy(*keys, "field", "hour").agg(F.sort_array(F.collect_list(F.struct("pane", "part"))).alias("p"))
    return h.select(*keys, "field", "hour", merged(F.transform("p", lambda x: x["part"])).alias("part"))


class Rolling:
    """Panes of some readings, from which windows of whole hours before any times are answered.

    ``fields`` maps each field to the spans, in hours, that will be asked for; ``percentiles`` to the spans of exact percentiles.
    """

    def __init__(self, readings: DataFrame, fields: dict[str, Sequence[int]], percentiles: dict[str, Sequence[int]] | None = None,
                 keys: Sequence[str] = ("zone_id",), ts: str = "ts"):
        self.keys, self.fields, self.percentiles = list(keys), {f: sorted(set(k)) for f, k in fields.items()}, percentiles or {}
        r = readings.withColumn("ts", F.col(ts)) if ts != "ts" else readings
        names = sorted({*self.fields, *self.percentiles})
        self.rows = r.where(F.col("field").isin(*names) & F.col("value").isNotNull()).select(
            *self.keys, "field", micros(F.col("ts")).alias("us"), F.col("value").cast("double").alias("value"))
        self.counts = counted(r, names, self.keys)
        self.panes = pane_parts(self.counts, self.keys)
        self.hours = cut(hour_parts(self.panes, self.keys))

    def _ends(self, anchors: DataFrame, spans: Sequence[int]) -> DataFrame:
        """Both ends of each anchor's windows: span 0 is the time itself."""
        a = anchors.select(*self.keys, "t").distinct().withColumn("t_us", micros(F.col("t")))
        a = a.withColumn("span", F.explode(F.array(*[F.lit(k) for k in (0, *spans)]))).withColumn("end", F.col("t_us") - F.col("span").cast("long") * HOUR_US)
        return a.withColumns({"end_pane": F.floor(F.col("end") / PANE_US).cast("long"), "end_hour": F.floor(F.col("end") / HOUR_US).cast("long")})

    def _edge_rows(self, ends: DataFrame) -> DataFrame:
        """Rows of the end panes on the window's side."""
        r = self.rows.withColumn("end_pane", F.floor(F.col("us") / PANE_US).cast("long"))
        j = ends.join(r, [*self.keys, "end_pane"])
        return j.where(F.when(F.col("span") == 0, F.col("us") < F.col("end")).otherwise(F.col("us") >= F.col("end")))

    def _side(self) -> Column:
        """Whether a pane of an end's hour lies wholly on the window's side."""
        return F.when(F.col("span") == 0, F.col("pane") < F.col("end_pane")).otherwise(F.col("pane") > F.col("end_pane"))

    def stats(self, anchors: DataFrame) -> DataFrame:
        """``(*keys, t, field, spans)`` for each anchor ``(*keys, t)`` and field: a map from span to the statistics of ``[t - span h, t)``."""
        every = sorted({k for ks in self.fields.values() for k in ks})
        ends = self._ends(anchors, every)
        by = [*self.keys, "t", "field", "span"]
        rows = self._edge_rows(ends).groupBy(*by).agg(part_of(F.col("value")).alias("part"))
        panes = ends.join(self.panes.withColumnRenamed("hour", "end_hour"), [*self.keys, "end_hour"]).where(self._side()).select(*by, "part")
        edge = rows.select(*by, "part").union(panes).groupBy(*self.keys, "t", "field").agg(F.collect_list(F.struct("span", "part")).alias("edges"))
        # whole hours strictly between the two ends, by a frame over hours and anchors
        a = anchors.select(*self.keys, "t").distinct().withColumn("hour", F.floor(micros(F.col("t")) / HOUR_US).cast("long"))
        a = a.withColumn("field", F.explode(F.array(*[F.lit(f) for f in self.fields])))
        u = a.unionByName(self.hours, allowMissingColumns=True)
        w = W.partitionBy(*self.keys, "field").orderBy("hour")
        u = u.withColumn("centre", F.avg("part.mean").over(W.partitionBy(*self.keys, "field")))
        mid = u.select(*self.keys, "t", "field", *[F.array(framed(w.rangeBetween(-(k - 1), -1))).alias(f"m{k}") for k in every if k > 1])
        mid = mid.where(F.col("t").isNotNull())
        edge = edge.select(*[F.col(c).alias(f"_{c}") for c in (*self.keys, "t", "field")], "edges")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*self.keys, "t", "field")]
        j = mid.join(edge, same, "left")
        own = F.coalesce("edges", F.array().cast(f"array<struct<span:int,part:{PART}>>"))

        def parts(k):
            at_ends = F.transform(F.filter(own, lambda e: (e["span"] == 0) | (e["span"] == k)), lambda e: e["part"])
            return F.concat(at_ends, F.col(f"m{k}")) if k > 1 else at_ends

        return j.select(*self.keys, "t", "field", F.create_map(*[x for k in every for x in (F.lit(k), merged(parts(k)))]).alias("spans"))

    def quantiles(self, anchors: DataFrame, field: str, wanted: dict[str, tuple[int, float]]) -> DataFrame:
        """``(*keys, t, *names)``: exact percentiles of ``field``; ``wanted`` maps a name to span and share. Anchors without values are left out."""
        spans = sorted({k for k, _ in wanted.values()})
        c = self.counts.where(F.col("field") == field)
        ends = self._ends(anchors, spans)
        by = [*self.keys, "t"]
        rows = self._edge_rows(ends).where(F.col("field") == field).select(*by, "span", "value", F.lit(1).cast("long").alias("c"))
        panes = ends.join(c.withColumnRenamed("hour", "end_hour"), [*self.keys, "end_hour"]).where(self._side()).select(*by, "span", "value", "c")
        hourly = c.groupBy(*self.keys, "hour", "value").agg(F.sum("c").alias("c"))
        a = anchors.select(*by).distinct().withColumn("at", F.floor(micros(F.col("t")) / HOUR_US).cast("long"))
        a = a.withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(max(spans))))).withColumn("hour", F.col("at") - F.col("back"))
        # a whole hour belongs to every span that reaches beyond it; -back tells it from an end's span
        mid = a.join(hourly, [*self.keys, "hour"]).select(*by, (-F.col("back")).alias("span"), "value", "c")
        v = rows.unionByName(panes).unionByName(mid)

        def of(k, p):
            mine = (F.col("span") == 0) | (F.col("span") == k) | ((F.col("span") < 0) & (-F.col("span") < k))
            return F.percentile(F.when(mine, F.col("value")), p, F.when(mine, F.col("c")).otherwise(0))

        return v.groupBy(*by).agg(*[of(k, p).alias(n) for n, (k, p) in wanted.items()])
