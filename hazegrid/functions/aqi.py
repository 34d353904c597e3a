"""Air-quality indices as Column expressions.

Three grids exist side by side and differ in rounding; they are kept apart on purpose:
``daily_subindex`` truncates, ``epa_index`` and ``local_pm25_index`` round half to even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLLUTANTS = ("pm25", "pm10", "no2", "o3", "co")  # also the tie order of the dominant pollutant

# fixed values: daily grid, band upper bounds and (base, span) of each band
DAILY_BANDS = {
    "pm25": ((12.0, 0, 50), (35.4, 51, 49), (55.4, 101, 49), (150.4, 151, 49), (250.4, 201, 99)),
    "pm10": ((54.0, 0, 50), (154.0, 51, 49), (254.0, 101, 49), (354.0, 151, 49), (424.0, 201, 99)),
    "co": ((4.4, 0, 50), (9.4, 51, 49), (12.4, 101, 49), (15.4, 151, 49), (30.4, 201, 99)),
    "no2": ((53.0, 0, 50), (100.0, 51, 49), (360.0, 101, 49)),
    "o3": ((54.0, 0, 50), (70.0, 51, 49), (85.0, 101, 49), (105.0, 151, 49)),
}
# fixed values: daily grid above the last band as (width, gain, base), capped at 500
DAILY_TAIL = {"pm25": (250.0, 199, 301), "pm10": (200.0, 199, 301), "co": (19.6, 199, 301),
              "no2": (640.0, 349, 151), "o3": (95.0, 99, 201)}

# fixed values: concentration at index 0, 50, 100, 150, 200, 300, 500
EPA_LEVELS = (0, 50, 100, 150, 200, 300, 500)
EPA_POINTS = {
    "pm25": (0, 12.0, 35.4, 55.4, 150.4, 250.4, 500.4),
    "pm10": (0, 54, 154, 254, 354, 424, 604),
    "co": (0, 4.4, 9.4, 12.4, 15.4, 30.4, 50.4),
    "no2": (0, 53, 100, 360, 649, 1249, 2049),
    "o3": (0, 54, 70, 85, 105, 200, 400),
}

# fixed values: local PM2.5 grid (index low, index high, concentration low, concentration high)
LOCAL_PM25 = ((0, 50, 0, 25), (51, 100, 25, 55), (101, 150, 55, 150), (151, 200, 150, 250),
              (201, 300, 250, 350), (301, 500, 350, 500))

# fixed values: index upper bound, level, label, colour
LEVELS = ((50, "good", "Bon", "#00E400"), (100, "moderate", "Modéré", "#FFA500"),
          (150, "unhealthy_sensitive", "Mauvais pour personnes sensibles", "#FF7E00"),
          (200, "unhealthy", "Mauvais", "#FF0000"), (300, "very_unhealthy", "Très mauvais", "#8F3F97"),
          (None, "hazardous", "Dangereux", "#7E0023"))

# fixed values: PM2.5 upper bound, label, colour of the supervision view
PM25_BANDS = ((12.0, "Bon", "#22c55e"), (35.4, "Modéré", "#eab308"), (55.4, "Mauvais (sensibles)", "#f97316"),
              (150.4, "Mauvais", "#ef4444"), (250.4, "Très mauvais", "#a21caf"), (None, "Dangereux", "#7f1d1d"))

# fixed values: colours, labels and advice of the map view, by index upper bound
DISPLAY = (
    (50, "#00E400", "Bon",
     "La qualité de l'air est bonne. Profitez de vos activités extérieures sans restriction."),
    (100, "#FFA500", "Modéré", "Qualité de l'air acceptable. Les personnes très sensibles (asthme sévère) "
     "peuvent ressentir une gêne légère."),
    (150, "#FF7E00", "Mauvais (sensibles)", "Les enfants, asthmatiques et personnes âgées doivent réduire les "
     "efforts prolongés en extérieur. Port du masque recommandé."),
    (200, "#FF0000", "Mauvais", "Tout le monde peut ressentir des effets. Port du masque fortement recommandé. "
     "Évitez les activités physiques intenses."),
    (300, "#8F3F97", "Très mauvais", "Alerte sanitaire. Limitez les déplacements. Fermez les fenêtres. "
     "Contactez un médecin si symptômes respiratoires."),
    (None, "#7E0023", "Dangereux", "Urgence sanitaire. Restez à l'intérieur. Masque obligatoire. "
     "Suivez les consignes des autorités."),
)
PM25_HEX = ((25, "#00E400"), (55, "#FFFF00"), (150, "#FF7E00"), (250, "#FF0000"), (350, "#8F3F97"), (None, "#7E0023"))
PM25_AQI_COLOR = ((25, "#00E400"), (50, "#FFFF00"), (100, "#FF7E00"), (180, "#FF0000"), (350, "#8F3F97"),
                  (None, "#7E0023"))
UNITS = {"pm25": "µg/m³", "pm10": "µg/m³", "no2": "ppb", "co": "ppm", "temperature": "°C", "humidity": "%"}
MISSING_COLOR, MISSING_LABEL = "#9CA3AF", "Indisponible"


def step(x: Column, table, pick: int = 1) -> Column:
    """First entry of ``table`` whose upper bound is at least ``x``; the last row has no bound."""
    out = None
    for row in table[:-1]:
        out = F.when(x <= row[0], row[pick]) if out is None else out.when(x <= row[0], row[pick])
    return F.when(x.isNotNull(), out.otherwise(table[-1][pick]))


def by_pollutant(pollutant: Column, fn, names=POLLUTANTS) -> Column:
    out = None
    for p in names:
        out = F.when(pollutant == p, fn(p)) if out is None else out.when(pollutant == p, fn(p))
    return out


def daily_subindex(pollutant: str, c: Column) -> Column:
    lo, out = 0.0, None
    for hi, base, span in DAILY_BANDS[pollutant]:
        v = ((c - lo) / (hi - lo) * float(span) + float(base)).cast("int")
        out = F.when(c <= hi, v) if out is None else out.when(c <= hi, v)
        lo = hi
    width, gain, base = DAILY_TAIL[pollutant]
    return out.when(c > lo, F.least((c - lo) / width * float(gain) + float(base), F.lit(500.0)).cast("int"))


def daily_subindex_of(pollutant: Column, c: Column) -> Column:
    return by_pollutant(pollutant, lambda p: daily_subindex(p, c))


def epa_index(pollutant: str, c: Column) -> Column:
    pts, out = EPA_POINTS[pollutant], None
    for i in range(1, len(pts)):
        l0, l1, c0, c1 = EPA_LEVELS[i - 1], EPA_LEVELS[i], float(pts[i - 1]), float(pts[i])
        v = F.rint(l0 + (c - c0) / (c1 - c0) * (l1 - l0))
        if i == len(pts) - 1:
            out = out.when(c > c0, v)
        else:
            out = F.when(c <= c1, v) if out is None else out.when(c <= c1, v)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(500.0)).cast("int")


def epa_index_of(pollutant: Column, c: Column) -> Column:
    """Unknown pollutant or missing concentration gives 0, since the clamp skips nulls."""
    return F.coalesce(by_pollutant(pollutant, lambda p: epa_index(p, c)), F.lit(0))


def local_pm25_index(c: Column) -> Column:
    out = F.when(c < 0, F.lit(None))
    for i_lo, i_hi, c_lo, c_hi in LOCAL_PM25:
        out = out.when(c <= c_hi, F.rint(i_lo + (c - c_lo) / (c_hi - c_lo) * (i_hi - i_lo)))
    return F.when(c.isNotNull(), out.otherwise(500.0)).cast("int")


def category(index: Column) -> Column:
    return F.coalesce(step(index, LEVELS), F.lit("hazardous"))


def level(index: Column) -> Column:
    return F.struct(step(index, LEVELS, 1).alias("level"), step(index, LEVELS, 2).alias("label"),
                    step(index, LEVELS, 3).alias("color"))


def pm25_band(c: Column) -> Column:
    return F.struct(F.coalesce(step(c, PM25_BANDS, 1), F.lit("—")).alias("label"),
                    F.coalesce(step(c, PM25_BANDS, 2), F.lit("#475569")).alias("color"))


def marker_index(c: Column) -> Column:
    """Linear index of map markers (JavaScript rounding: halves go up)."""
    up = lambda x: F.floor(x + 0.5)
    return (F.when(c <= 25, up(c / 25 * 50)).when(c <= 55, up(50 + (c - 25) / 30 * 50))
            .when(c > 55, up(100 + F.least(c - 55, F.lit(95.0)))))


def index_color(index: Column) -> Column:
    return F.coalesce(step(index, DISPLAY, 1), F.lit(MISSING_COLOR))


def pollutant_color(pollutant: Column, c: Column) -> Column:
    scaled = F.least(F.lit(500.0), c / F.when(pollutant == "pm10", 425.0).otherwise(100.0) * 150)
    return F.when(pollutant == "pm25", step(c, PM25_AQI_COLOR)).otherwise(index_color(scaled))


def unit(pollutant: Column) -> Column:
    return F.coalesce(by_pollutant(pollutant, lambda p: F.lit(UNITS[p]), tuple(UNITS)), F.lit(""))


def overall(subindex: dict[str, Column]) -> tuple[Column, Column]:
    """Highest sub-index and the pollutant that has it (ties: fixed order)."""
    top = F.greatest(*subindex.values())
    dom = None
    for p in POLLUTANTS:
        if p in subindex:
            dom = F.when(subindex[p] == top, p) if dom is None else dom.when(subindex[p] == top, p)
    return top, dom
