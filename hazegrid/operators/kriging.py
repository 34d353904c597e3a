"""Gaussian-process interpolation of zone means on a regular grid (Rasmussen and Williams 2006)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

# fixed values: grid extent and size, kernel length, noise level
LAT_RANGE, LON_RANGE, GRID = (14.60, 14.82), (-17.58, -17.30), 200
LENGTH, NOISE = 0.05, 1.0
# fixed values: bounds of both when they are fitted
LENGTH_BOUNDS, NOISE_BOUNDS = (1e-5, 1e5), (1e-5, 1e5)


def grid_rows(df: DataFrame, n: int = GRID) -> DataFrame:
    """Every row repeated for each grid cell, with the cell's numbers and centre."""
    # grid rows are dealt over tasks before they are filled
    d = spread(df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return (d
            .withColumn("lat", LAT_RANGE[0] + (LAT_RANGE[1] - LAT_RANGE[0]) * F.col("i") / (n - 1))
            .withColumn("lon", LON_RANGE[0] + (LON_RANGE[1] - LON_RANGE[0]) * F.col("j") / (n - 1)))


def kernel(s: Column, lat: Column, lon: Column, length: float) -> Column:
    return F.exp(-(F.pow(lat - s["lat"], 2) + F.pow(lon - s["lon"], 2)) / (2 * length * length))


def kernel_sum(stations: Column, lat: Column, lon: Column, length: float) -> Column:
    """Sum of ``w * kernel`` over an array of (lat, lon, w) structs."""
    return F.aggregate(stations, F.lit(0.0), lambda a, s: a + s["w"] * kernel(s, lat, lon, length))


def snapshots(readings: DataFrame, zones: DataFrame, field: str = "pm25", every: str = "1 hour") -> DataFrame:
    """Zone centroid and mean per window; zones without data are absent."""
    m = readings.where(F.col("field") == field).groupBy(F.window("ts", every).alias("w"), "zone_id").agg(F.avg("value").alias("v"))
    z = zones.select("zone_id", F.col("lat_c").alias("lat"), F.col("lon_c").alias("lon"))
    return m.join(z, "zone_id").select(F.col("w.start").alias("computed_at"), "zone_id", "lat", "lon", "v")


class Likelihood:
    """Log marginal likelihood of scaled values ``y`` at places with squared distances ``d2``.

    For a given length one decomposition serves every noise level.
    """

    def __init__(self, d2: np.ndarray, y: np.ndarray):
        self.d2, self.y, self.known = d2, y, {}

    def _spectrum(self, log_length: float):
        if log_length not in self.known:
            w, q = np.linalg.eigh(np.exp(-self.d2 / (2 * np.exp(2 * log_length))))
            self.known[log_length] = np.maximum(w, 0.0), np.square(q.T @ self.y)
        return self.known[log_length]

    def __call__(self, log_length: float, log_noise):
        w, z = self._spectrum(log_length)
        s = w[:, None] + np.exp(np.atleast_1d(log_noise))[None, :]
        return -0.5 * ((z[:, None] / s).sum(axis=0) + np.log(s).sum(axis=0) + len(w) * np.log(2 * np.pi))


def _highest(f, lo: float, hi: float, tolerance: float = 1e-7) -> tuple[float, float]:
    """Place and value of the maximum of a function with one peak between two bounds, by golden sections."""
    g = (np.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > tolerance:
        if fa >= fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return (a, fa) if fa >= fb else (b, fb)


def fit_kernel(d2: np.ndarray, y: np.ndarray, steps: int = 49) -> tuple[float, float, float]:
    """Length, noise and the log likelihood they reach: the best of a grid over both bounds, then refined around its best places.

    For each length the best noise is searched on its own, so the search over lengths sees one value each.
    """
    like = Likelihood(d2, y)
    lengths, noises = (np.linspace(np.log(a), np.log(b), steps) for a, b in (LENGTH_BOUNDS, NOISE_BOUNDS))
    table = np.array([like(k, noises) for k in lengths])

    def over_noise(k, around=None):
        v = like(k, noises)
        i = int(v.argmax())
        return _highest(lambda s: float(like(k, s)[0]), noises[max(i - 1, 0)], noises[min(i + 1, steps - 1)])

    by_length = table.max(axis=1)
    peaks = [i for i in range(steps) if by_length[i] >= by_length[max(i - 1, 0)] and by_length[i] >= by_length[min(i + 1, steps - 1)]]
    best = (-np.inf, 0.0, 0.0)
    for i in sorted(peaks, key=lambda i: -by_length[i])[:3]:
        k, _ = _highest(lambda k: over_noise(k)[1], lengths[max(i - 1, 0)], lengths[min(i + 1, steps - 1)], 1e-6)
        for k in (k, lengths[i]):
            s, v = over_noise(k)
            best = max(best, (v, k, s))
    return float(np.exp(best[1])), float(np.exp(best[2])), float(best[0])


def solve(s: DataFrame, keys: list[str], length: float = LENGTH, noise: float = NOISE, fit: bool = False) -> DataFrame:
    """Per snapshot: weights, inverse factor, scaling and leave-one-out error.

    One small linear system per snapshot — its size is the number of zones — and as many systems
    side by side as there are snapshots. Fewer than two zones give no row; the error needs three. With ``fit`` each snapshot
    has the length and noise of highest likelihood; without, those given.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lat", "lon"])
        p, y = pdf[["lat", "lon"]].to_numpy(), pdf["v"].to_numpy()
        n = len(y)
        if n < 2:
            return pd.DataFrame(columns=[*keys, "n", "mean", "scale", "stations", "inverse", "rmse_loo", "length", "noise", "likelihood", "residual"])
        mu, sd = float(y.mean()), float(y.std()) or 1.0
        d2 = ((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)
        scaled = (y - mu) / sd
        ell, sigma, reached = fit_kernel(d2, scaled) if fit else (length, noise, float(Likelihood(d2, scaled)(np.log(length), np.log(noise))[0]))
        k = np.exp(-d2 / (2 * ell * ell)) + sigma * np.eye(n)
        inv = np.linalg.inv(k)
        alpha = inv @ scaled
        loo = None
        if n >= 3:  # each point predicted from the others, with the others' own mean
            errors = []
            for i in range(n):
                o = np.arange(n) != i
                m_i, s_i = y[o].mean(), y[o].std() or 1.0
                # inverse without row i, by downdating the full inverse
                sub = inv[np.ix_(o, o)] - np.outer(inv[o, i], inv[i, o]) / inv[i, i]
                errors.append(m_i + s_i * (k[i, o] @ sub @ ((y[o] - m_i) / s_i)) - y[i])
            loo = float(np.sqrt(np.mean(np.square(errors))))
        out = {key: [pdf[key].iloc[0]] for key in keys}
        out |= {"n": [n], "mean": [mu], "scale": [sd], "rmse_loo": [loo], "inverse": [inv.tolist()],
                "length": [ell], "noise": [sigma], "likelihood": [reached], "residual": [float(np.abs(k @ alpha - scaled).max())],
                "stations": [[{"lat": float(a), "lon": float(b), "w": float(w)} for (a, b), w in zip(p, alpha)]]}
        return pd.DataFrame(out)

    ks = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.select(*keys).schema.fields)
    return spread(s, *keys).groupBy(*keys).applyInPandas(
        run, f"{ks}, n int, mean double, scale double, stations array<struct<lat:double,lon:double,w:double>>, "
             "inverse array<array<double>>, rmse_loo double, length double, noise double, likelihood double, residual double")


def predict(fit: DataFrame, keys: list[str], length: float | None = None, noise: float | None = None, n: int = GRID, strip: int = 20) -> DataFrame:
    """Mean (at least 0) and standard deviation in every grid cell of every snapshot, with the snapshot's own length and noise if none are given.

    Work is spread by (snapshot, strip of grid rows); a strip is filled by two matrix products.
    """
    lons, lats = np.linspace(*LON_RANGE, n), np.linspace(*LAT_RANGE, n)
    work = spread(fit.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(strip)))), *keys, "_i")

    def fill(parts):
        for pdf in parts:
            for r in pdf.to_dict("records"):
                p = np.array([(s["lat"], s["lon"], s["w"]) for s in r["stations"]])
                i, j = (x.ravel() for x in np.meshgrid(np.arange(r["_i"], min(r["_i"] + strip, n)), np.arange(n), indexing="ij"))
                d2 = (lats[i][:, None] - p[:, 0]) ** 2 + (lons[j][:, None] - p[:, 1]) ** 2
                k = np.exp(-d2 / (2 * (length or r["length"]) ** 2))
                quad = ((k @ np.vstack(r["inverse"])) * k).sum(axis=1)
                out = {key: [r[key]] * len(i) for key in keys}
                yield pd.DataFrame({**out, "i": i, "j": j, "lat": lats[i], "lon": lons[j],
                                    "pm25": np.maximum(0.0, r["mean"] + r["scale"] * (k @ p[:, 2])),
                                    "std": r["scale"] * np.sqrt(np.maximum(0.0, 1.0 + (r["noise"] if noise is None else noise) - quad))})

    ks = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fit.select(*keys).schema.fields)
    return work.mapInPandas(fill, f"{ks}, i int, j int, lat double, lon double, pm25 double, std double")
