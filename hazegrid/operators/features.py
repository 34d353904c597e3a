"""Feature vectors per zone and hour, and the training matrix of a single series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import timefeat as tf
from ..functions.aqi import POLLUTANTS
from ..session import cut
from . import joins, scan
from .panes import Rolling, framed, part_of, std
from .windows import full, hour_lags, hourly

# fixed values: hour lags and rolling windows of the feature vector
HOUR_LAGS = {"pm25": (1, 2, 3, 4, 6, 12, 24, 48, 168), "pm10": (1, 24), "co": (1,), "no2": (1,)}
MEAN_HOURS, STD_HOURS, MIN_MAX_HOURS = (1, 3, 6, 12, 24, 168), (1, 3, 6, 24), (1, 6)
PM10_MEAN_HOURS = (1, 6, 24)
# fixed values: row lags, rolling rows and diffs of the training matrix
ROW_LAGS = (1, 2, 3, 6, 12, 24, 36, 48, 72, 96, 144, 288)
ROW_DIFFS = (1, 3, 12, 24)
TARGET_ROWS = {"target_h1": 12, "target_h6": 72, "target_h24": 288}


def label(h: int) -> str:
    return "7d" if h == 168 else f"{h}h"


def zone_hours(readings: DataFrame) -> DataFrame:
    """Per zone and hour: number, mean, squared deviations, min and max of PM2.5, and number and mean of PM10.

    These partials are all that rolling statistics at full hours need, so readings are shuffled
    once, already combined.
    """
    v = lambda f: F.when(F.col("field") == f, F.col("value"))
    h = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return readings.where(F.col("field").isin("pm25", "pm10")).groupBy("zone_id", h.alias("hour")).agg(
        part_of(v("pm25")).alias("part"), F.count(v("pm10")).alias("n10"), F.avg(v("pm10")).alias("mean10"))


def rolling(readings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rolling statistics over ``[t - k h, t)`` for every anchor ``(zone_id, t)``, ``t`` a full hour."""
    hour_no = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / 3600).cast("long")
    z = zone_hours(readings).withColumn("_h", hour_no("hour"))
    u = anchors.select("zone_id", "t", hour_no("t").alias("_h")).unionByName(z.drop("hour"), allowMissingColumns=True)
    u = u.withColumn("centre", F.avg("part.mean").over(W.partitionBy("zone_id")))
    w = W.partitionBy("zone_id").orderBy("_h")
    out = {}
    for k in MEAN_HOURS:
        f = w.rangeBetween(-k, -1)
        part = framed(f)
        out[f"pm25_rolling_mean_{label(k)}"] = part["mean"]
        if k in STD_HOURS:
            out[f"pm25_rolling_std_{k}h"] = std(part)
        if k in MIN_MAX_HOURS:
            out[f"pm25_rolling_min_{k}h"], out[f"pm25_rolling_max_{k}h"] = part["lo"], part["hi"]
        if k in PM10_MEAN_HOURS:
            n10 = F.sum("n10").over(f)
            out[f"pm10_rolling_mean_{k}h"] = F.when(n10 > 0, F.sum(F.col("n10") * F.col("mean10")).over(f) / n10)
    r = u.select("zone_id", "t", *[c.alias(n) for n, c in out.items()]).where(F.col("t").isNotNull())
    # percentiles: distinct values with counts per zone and hour, offered to the hours they serve
    v = readings.where(F.col("field") == "pm25").groupBy("zone_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
                                                        "value").agg(F.count("*").alias("c"))
    serve = v.select("zone_id", "value", "c", F.explode(F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.struct(
        (F.col("hour") + F.make_dt_interval(hours=i)).alias("t"), i.alias("age")))).alias("x")).select(
        "zone_id", "value", "c", "x.t", "x.age")
    p = serve.groupBy("zone_id", "t").agg(
        F.percentile(F.when(F.col("age") <= 6, F.col("value")), 0.5, F.when(F.col("age") <= 6, F.col("c")).otherwise(0)).alias("pm25_rolling_median_6h"),
        F.percentile("value", 0.95, F.col("c")).alias("pm25_rolling_p95_24h"))
    return r.join(p, ["zone_id", "t"], "left")


def derivatives(now: Column, lag: dict[int, Column]) -> dict[str, Column]:
    d = {f"pm25_delta_{k}h": now - lag[k] for k in (1, 3, 6, 12)}
    d["pm25_accel_1h"] = (now - lag[1]) - (lag[1] - lag[6])
    d["pm25_daily_change_pct"] = F.when(lag[24] > 0, (now - lag[24]) / lag[24] * 100)
    return d


def panes_of(readings: DataFrame) -> Rolling:
    """Panes for all windows of the feature vector."""
    spans = {"pm25": sorted({*MEAN_HOURS, *STD_HOURS, *MIN_MAX_HOURS}), "pm10": PM10_MEAN_HOURS, "co": (1,), "no2": (1,), "o3": (1,)}
    return Rolling(readings, spans, {"pm25": (6, 24)})


def rolling_at(panes: Rolling, anchors: DataFrame) -> DataFrame:
    """The columns of :func:`rolling` for anchors at any time, the means of the last hour of every pollutant, and the number of PM2.5 values in it."""
    s = panes.stats(anchors)
    of = {f: F.first(F.when(F.col("field") == f, F.col("spans")), ignorenulls=True).alias(f"_{f}") for f in POLLUTANTS}  # one row each
    d = s.groupBy("zone_id", "t").agg(*of.values())
    at = lambda f, k: F.try_element_at(F.col(f"_{f}"), F.lit(k))
    out = {f"pm25_rolling_mean_{label(k)}": at("pm25", k)["mean"] for k in MEAN_HOURS}
    out |= {f"pm25_rolling_std_{k}h": std(at("pm25", k)) for k in STD_HOURS}
    for k in MIN_MAX_HOURS:
        out |= {f"pm25_rolling_min_{k}h": at("pm25", k)["lo"], f"pm25_rolling_max_{k}h": at("pm25", k)["hi"]}
    out |= {f"pm10_rolling_mean_{k}h": at("pm10", k)["mean"] for k in PM10_MEAN_HOURS}
    out |= {f"{p}_hour": at(p, 1)["mean"] for p in POLLUTANTS} | {"n_hour": at("pm25", 1)["n"]}
    q = panes.quantiles(anchors, "pm25", {"pm25_rolling_median_6h": (6, 0.5), "pm25_rolling_p95_24h": (24, 0.95)})
    d = d.select("zone_id", "t", *[c.alias(n) for n, c in out.items()])
    return d.join(q.withColumnsRenamed({"zone_id": "_z", "t": "_t"}), (F.col("zone_id") == F.col("_z")) & (F.col("t") == F.col("_t")), "left").drop("_z", "_t")


def zone_vector(readings: DataFrame, zones: DataFrame, sensors: DataFrame, weather: DataFrame, traffic: DataFrame,
                sensor_meta: DataFrame, anchors: DataFrame, neighbor: str = "self") -> DataFrame:
    """The 81 features for every anchor ``(zone_id, t)``, at any time, in one plan.

    ``anchors`` hold all zones of the city at each of their times, as a run at that time does: neighbours and the city mean are taken from them.
    Windows end at ``t``; lags are the means of the whole hours before the hour of ``t``.
    """
    panes = panes_of(readings)
    h = panes.hours.groupBy("zone_id", F.timestamp_seconds(F.col("hour") * 3600).cast("timestamp_ntz").alias("hour")).agg(
        *[F.first(F.when(F.col("field") == f, F.col("part.mean")), ignorenulls=True).alias(f) for f in POLLUTANTS])
    spine = anchors.select("zone_id", F.date_trunc("hour", "t").cast("timestamp_ntz").alias("hour")).distinct().join(h, ["zone_id", "hour"], "full_outer")
    lags = hour_lags(spine, HOUR_LAGS).drop(*POLLUTANTS)
    d = cut(rolling_at(panes, anchors))
    d = d.withColumns({f"{p}_now": F.coalesce(f"{p}_hour", F.lit(0.0)) for p in POLLUTANTS}).withColumn("hour", F.date_trunc("hour", "t").cast("timestamp_ntz"))
    d = d.join(lags, ["zone_id", "hour"]).drop("hour")
    lag = {k: F.col(f"pm25_lag_{k}h") for k in HOUR_LAGS["pm25"]}
    now = F.col("pm25_now")
    d = d.select("*", *[c.alias(n) for n, c in {**derivatives(now, lag), **tf.cyclic(F.col("t")), **tf.calendar(F.col("t"))}.items()])

    wcols = ["temperature", "humidity", "pressure", "wind_speed", "wind_direction", "precipitation"]
    wx = scan.asof(anchors.select("zone_id", "t"), weather, ["zone_id"], "t", "ts", ["event_id"], wcols)
    wx = cut(wx.select("*", *[c.alias(n) for n, c in tf.weather(F.col("temperature"), F.col("humidity"), F.col("wind_direction")).items()]))
    a = anchors.select("zone_id", "t").withColumn("_t1", F.col("t") - F.expr("INTERVAL '1' HOUR")).withColumn("_id", F.struct("zone_id", "t"))
    tr = scan.asof(a, traffic, ["zone_id"], "t", "ts", ["event_id"], ["congestion_level"])
    tr = scan.asof(tr, traffic.select("zone_id", "ts", "event_id", F.col("congestion_level").alias("congestion_lag_1h")),
                   ["zone_id"], "_t1", "ts", ["event_id"], ["congestion_lag_1h"])
    tr = joins.interval_mean(tr.withColumnRenamed("_id", "_aid"), "_aid", traffic, ["zone_id"], "t", "ts", "congestion_level",
                             3 * 3600, "congestion_rolling_mean_3h").drop("_aid", "_t1")

    means = d.select("zone_id", "t", F.col("pm25_hour").alias("mean"))
    up = joins.sector_mean(zones, wx, means, 0.0, out="pm25_upwind_mean", keys=["t"])
    down = joins.sector_mean(zones, wx, means, 180.0, out="pm25_downwind_mean", keys=["t"])
    city = d.where("n_hour > 0").groupBy("t").agg((F.sum(F.col("n_hour") * F.col("pm25_hour")) / F.sum("n_hour")).alias("pm25_city_mean"))
    density = sensors.groupBy("zone_id").agg(F.count_if(F.col("status") == "active").alias("sensor_density"))
    d = (d.join(wx, ["zone_id", "t"]).join(tr, ["zone_id", "t"]).join(up, ["zone_id", "t"], "left")
         .join(down, ["zone_id", "t"], "left").join(city, "t", "left").join(density, "zone_id", "left")
         .join(sensor_meta, "zone_id", "left"))
    if neighbor == "self":
        d = d.withColumn("pm25_neighbor_mean", F.col("pm25_rolling_mean_1h"))
    else:
        level = zones.select("zone_id", "niveau").join(means, "zone_id").groupBy("niveau", "t").agg(
            F.sum("mean").alias("_s"), F.count("mean").alias("_n"))
        own = F.coalesce("pm25_rolling_mean_1h", F.lit(0.0))
        n = F.col("_n") - F.col("pm25_rolling_mean_1h").isNotNull().cast("int")
        d = (d.join(zones.select("zone_id", "niveau"), "zone_id").join(level, ["niveau", "t"], "left")
             .withColumn("pm25_neighbor_mean", F.when(n > 0, (F.col("_s") - own) / n)).drop("niveau", "_s", "_n"))
    d = d.select("*", *[c.alias(n) for n, c in tf.ratios({p: F.col(f"{p}_now") for p in POLLUTANTS}).items()])
    d = d.withColumn("wind_independence_index", tf.wind_independence(now, F.col("pm25_upwind_mean"), F.col("wind_speed")))
    d = d.withColumn("pm25_spatial_gradient", tf.spatial_gradient(now, F.col("pm25_neighbor_mean")))
    sensor = F.datediff(F.col("t"), F.col("install_date"))
    return d.select("*", sensor.alias("sensor_age_days"), F.datediff("t", "last_calibration").alias("days_since_calibration")).drop(
        "install_date", "last_calibration", "n_hour", *[f"{p}_{x}" for p in POLLUTANTS for x in ("now", "hour")])


def store_row(vector: DataFrame, names: Sequence[str]) -> DataFrame:
    """Vector columns as the stored form: map of non-null values, ordered names, number missing."""
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("double"))]
    m = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    return vector.select("zone_id", F.col("t").alias("timestamp"), m.alias("features"),
                         F.array(*[F.lit(n) for n in names]).alias("feature_names"), (F.lit(len(names)) - F.size(m)).alias("missing_count"))


def lag_columns(x: Column, w, steps: Sequence[int], prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{k}": F.lag(x, k).over(w) for k in steps}


def training_columns(w) -> dict[str, Column]:
    """The 57 features and 3 targets over an ordered row window ``w``."""
    pm, c = F.col("pm25"), F.col
    roll = lambda x, n, f: full(w, n, f(x), x)
    out = lag_columns(pm, w, ROW_LAGS, "pm25_lag")
    for name, n, f in (("mean_1h", 12, F.avg), ("std_1h", 12, F.stddev_samp), ("mean_3h", 36, F.avg), ("std_3h", 36, F.stddev_samp),
                       ("mean_6h", 72, F.avg), ("mean_12h", 144, F.avg), ("mean_24h", 288, F.avg), ("min_3h", 36, F.min),
                       ("max_3h", 36, F.max), ("min_24h", 288, F.min), ("max_24h", 288, F.max),
                       ("median_3h", 36, lambda x: F.percentile(x, 0.5))):
        out[f"pm25_rolling_{name}"] = roll(pm, n, f)
    out |= {f"pm25_diff_{k}": pm - F.lag(pm, k).over(w) for k in ROW_DIFFS}
    out |= tf.cyclic_training(c("ts"))
    out |= {x: c(x) for x in ("temperature", "humidity", "pressure", "wind_speed")}
    out |= {"temp_rolling_mean_3h": roll(c("temperature"), 36, F.avg), "humidity_rolling_mean_3h": roll(c("humidity"), 36, F.avg),
            "wind_rolling_mean_3h": roll(c("wind_speed"), 36, F.avg), "temp_x_humidity": c("temperature") * c("humidity") / 100,
            "traffic_index": c("traffic_index"), "traffic_rolling_mean_1h": roll(c("traffic_index"), 12, F.avg),
            "traffic_rolling_mean_3h": roll(c("traffic_index"), 36, F.avg)}
    out |= {f"{p}_lag_1": F.lag(p, 1).over(w) for p in ("pm10", "co", "no2", "o3")}
    ratio = lambda a, b: c(a) / F.when(c(b) != 0, c(b))
    out |= {"pm25_pm10_ratio": ratio("pm25", "pm10"), "no2_o3_ratio": ratio("no2", "o3"), "pm25_co_ratio": ratio("pm25", "co"),
            "pm25_no2_product": pm * c("no2"), "pm25_spatial_lag": F.lag(pm, 6).over(w), "zone_elevation": F.lit(12.0)}
    out |= {t: F.lead(pm, k).over(w) for t, k in TARGET_ROWS.items()}
    return out


def training_matrix(series: DataFrame) -> DataFrame:
    """Features and targets of one series in time order; rows with any gap are dropped."""
    names: list[str] = []
    keep = ("temperature", "humidity", "pressure", "wind_speed", "traffic_index")

    def build(w):
        cols = {n: c for n, c in training_columns(w).items() if n not in keep}
        names.extend(cols)
        return cols

    d = scan.row_windows(series, [], "ts", ["ts"], build, before=288, after=288)
    d = d.select("ts", *keep, *names)
    # one test per column: a single n-ary test over renamed columns makes Catalyst list every mix of old and new names
    return d.where(reduce(and_, [F.col(c).isNotNull() for c in d.columns]))
