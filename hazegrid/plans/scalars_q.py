"""Scalar functions."""

from pyspark.sql import functions as F

from ..functions import aqi, geo, text, timefeat
from ..operators import joins, messages, rollup
from ..operators.govern import changed_keys
from .registry import query
from .views import POLLUTANT_TOKENS, URGENT_TOKENS, now

P = aqi.POLLUTANTS

SUB_SQL = """CASE pollutant
 WHEN 'pm25' THEN CASE WHEN m<=12 THEN m/12*50 WHEN m<=35.4E0 THEN (m-12)/(35.4E0-12)*49+51 WHEN m<=55.4E0 THEN (m-35.4E0)/(55.4E0-35.4E0)*49+101
  WHEN m<=150.4E0 THEN (m-55.4E0)/(150.4E0-55.4E0)*49+151 WHEN m<=250.4E0 THEN (m-150.4E0)/(250.4E0-150.4E0)*99+201 ELSE least((m-250.4E0)/250*199+301,500) END
 WHEN 'pm10' THEN CASE WHEN m<=54 THEN m/54*50 WHEN m<=154 THEN (m-54)/100*49+51 WHEN m<=254 THEN (m-154)/100*49+101
  WHEN m<=354 THEN (m-254)/100*49+151 WHEN m<=424 THEN (m-354)/70*99+201 ELSE least((m-424)/200*199+301,500) END
 WHEN 'co' THEN CASE WHEN m<=4.4E0 THEN m/4.4E0*50 WHEN m<=9.4E0 THEN (m-4.4E0)/(9.4E0-4.4E0)*49+51 WHEN m<=12.4E0 THEN (m-9.4E0)/(12.4E0-9.4E0)*49+101
  WHEN m<=15.4E0 THEN (m-12.4E0)/(15.4E0-12.4E0)*49+151 WHEN m<=30.4E0 THEN (m-15.4E0)/(30.4E0-15.4E0)*99+201 ELSE least((m-30.4E0)/19.6E0*199+301,500) END
 WHEN 'no2' THEN CASE WHEN m<=53 THEN m/53*50 WHEN m<=100 THEN (m-53)/47*49+51 WHEN m<=360 THEN (m-100)/260*49+101 ELSE least((m-360)/640*349+151,500) END
 ELSE CASE WHEN m<=54 THEN m/54*50 WHEN m<=70 THEN (m-54)/16*49+51 WHEN m<=85 THEN (m-70)/15*49+101 WHEN m<=105 THEN (m-85)/20*49+151
  ELSE least((m-105)/95*99+201,500) END END"""
DAILY_SQL = f"""d AS (SELECT zone_id, CAST(ts AS DATE) AS day, field AS pollutant, avg(value) AS m FROM v_readings GROUP BY 1,2,3),
s AS (SELECT zone_id, day, pollutant, CAST(trunc({SUB_SQL}) AS INTEGER) AS iqa FROM d)"""
CAT_SQL = """CASE WHEN {0}<=50 THEN 'good' WHEN {0}<=100 THEN 'moderate' WHEN {0}<=150 THEN 'unhealthy_sensitive'
 WHEN {0}<=200 THEN 'unhealthy' WHEN {0}<=300 THEN 'very_unhealthy' ELSE 'hazardous' END"""


def _daily(t):
    return t.v_readings.groupBy("zone_id", F.to_date("ts").alias("day")).agg(
        *[F.avg(F.when(F.col("field") == p, F.col("value"))).alias(p) for p in P])


@query("fn_aqi_subindex_daily", f"WITH {DAILY_SQL} SELECT * FROM s")
def _(t):
    m = t.v_readings.groupBy("zone_id", F.to_date("ts").alias("day"), F.col("field").alias("pollutant")).agg(
        F.avg("value").alias("m"))
    return m.select("zone_id", "day", "pollutant", aqi.daily_subindex_of(F.col("pollutant"), F.col("m")).alias("iqa"))


@query("fn_aqi_overall", f"""WITH {DAILY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY zone_id, day ORDER BY iqa DESC,
  CASE pollutant WHEN 'pm25' THEN 1 WHEN 'pm10' THEN 2 WHEN 'no2' THEN 3 WHEN 'o3' THEN 4 ELSE 5 END) AS rn FROM s)
SELECT zone_id, day, iqa AS iqa_value, {CAT_SQL.format('iqa')} AS iqa_category, pollutant AS dominant_pollutant,
 (SELECT max(iqa) FROM s WHERE s.zone_id=r.zone_id AND s.day=r.day AND pollutant='pm25') AS pm25_iqa
FROM r WHERE rn = 1""")
def _(t):
    sub = {p: F.col(f"{p}_iqa") for p in P}
    top, dom = aqi.overall(sub)
    d = _daily(t).select("zone_id", "day", *[aqi.daily_subindex(p, F.col(p)).alias(f"{p}_iqa") for p in P])
    return d.select("zone_id", "day", top.alias("iqa_value"), aqi.category(top).alias("iqa_category"),
                    dom.alias("dominant_pollutant"), "pm25_iqa")


def _epa(p, pts):
    lv = (0, 50, 100, 150, 200, 300, 500)
    seg = [f"round_even({lv[i]}+(v-{pts[i]}E0)/({pts[i+1]}E0-{pts[i]}E0)*{lv[i+1]-lv[i]},0)" for i in range(6)]
    return (f"WHEN '{p}' THEN CASE " + " ".join(f"WHEN v<={pts[i+1]}E0 THEN {seg[i]}" for i in range(5))
            + f" ELSE {seg[5]} END")


EPA_SQL = ("CAST(least(greatest(CASE p " + _epa("pm25", (0, 12, 35.4, 55.4, 150.4, 250.4, 500.4)) + " "
           + _epa("pm10", (0, 54, 154, 254, 354, 424, 604)) + " " + _epa("co", (0, 4.4, 9.4, 12.4, 15.4, 30.4, 50.4))
           + " " + _epa("no2", (0, 53, 100, 360, 649, 1249, 2049)) + " " + _epa("o3", (0, 54, 70, 85, 105, 200, 400))
           + " END, 0), 500) AS INTEGER)")


@query("fn_aqi_epa", f"SELECT reading_id, {EPA_SQL} AS iqa FROM (SELECT reading_id, field AS p, value AS v FROM v_readings)")
def _(t):
    return t.v_readings.select("reading_id", aqi.epa_index_of(F.col("field"), F.col("value")).alias("iqa"))


@query("fn_aqi_pm25_local", """SELECT reading_id, CAST(CASE WHEN v<0 THEN NULL WHEN v<=25 THEN round_even(v/25*50,0)
 WHEN v<=55 THEN round_even(51+(v-25)/30*49,0) WHEN v<=150 THEN round_even(101+(v-55)/95*49,0) WHEN v<=250 THEN round_even(151+(v-150)/100*49,0)
 WHEN v<=350 THEN round_even(201+(v-250)/100*99,0) WHEN v<=500 THEN round_even(301+(v-350)/150*199,0) ELSE 500 END AS INTEGER) AS iqa
FROM (SELECT reading_id, value - 5 AS v FROM v_readings)""")
def _(t):
    return t.v_readings.select("reading_id", aqi.local_pm25_index(F.col("value") - 5).alias("iqa"))


@query("fn_aqi_category", f"SELECT reading_id, {CAT_SQL.format('value')} AS category FROM v_readings")
def _(t):
    return t.v_readings.select("reading_id", aqi.category(F.col("value")).alias("category"))


@query("fn_aqi_level", f"""SELECT reading_id, {CAT_SQL.format('value')} AS level, CASE WHEN value<=50 THEN 'Bon' WHEN value<=100 THEN 'Modéré'
 WHEN value<=150 THEN 'Mauvais pour personnes sensibles' WHEN value<=200 THEN 'Mauvais' WHEN value<=300 THEN 'Très mauvais' ELSE 'Dangereux' END AS label,
 CASE WHEN value<=50 THEN '#00E400' WHEN value<=100 THEN '#FFA500' WHEN value<=150 THEN '#FF7E00' WHEN value<=200 THEN '#FF0000'
 WHEN value<=300 THEN '#8F3F97' ELSE '#7E0023' END AS color FROM v_readings""")
def _(t):
    return t.v_readings.select("reading_id", aqi.level(F.col("value")).alias("l")).select("reading_id", "l.*")


@query("fn_pm25_band", """SELECT reading_id, CASE WHEN v IS NULL THEN '—' WHEN v<=12 THEN 'Bon' WHEN v<=35.4E0 THEN 'Modéré' WHEN v<=55.4E0 THEN 'Mauvais (sensibles)'
 WHEN v<=150.4E0 THEN 'Mauvais' WHEN v<=250.4E0 THEN 'Très mauvais' ELSE 'Dangereux' END AS label, CASE WHEN v IS NULL THEN '#475569' WHEN v<=12 THEN '#22c55e'
 WHEN v<=35.4E0 THEN '#eab308' WHEN v<=55.4E0 THEN '#f97316' WHEN v<=150.4E0 THEN '#ef4444' WHEN v<=250.4E0 THEN '#a21caf' ELSE '#7f1d1d' END AS color
FROM (SELECT reading_id, CASE WHEN field='pm25' THEN value END AS v FROM v_readings)""")
def _(t):
    v = F.when(F.col("field") == "pm25", F.col("value"))
    return t.v_readings.select("reading_id", aqi.pm25_band(v).alias("b")).select("reading_id", "b.*")


@query("fn_aqi_display", """SELECT reading_id, CAST(CASE WHEN value<=25 THEN floor(value/25*50+0.5E0) WHEN value<=55 THEN floor(50+(value-25)/30*50+0.5E0)
 ELSE floor(100+least(value-55,95)+0.5E0) END AS BIGINT) AS marker, CASE WHEN field='pm25' THEN CASE WHEN value<=25 THEN '#00E400' WHEN value<=50 THEN '#FFFF00'
 WHEN value<=100 THEN '#FF7E00' WHEN value<=180 THEN '#FF0000' WHEN value<=350 THEN '#8F3F97' ELSE '#7E0023' END ELSE
 CASE WHEN s<=50 THEN '#00E400' WHEN s<=100 THEN '#FFA500' WHEN s<=150 THEN '#FF7E00' WHEN s<=200 THEN '#FF0000' WHEN s<=300 THEN '#8F3F97' ELSE '#7E0023' END END AS color,
 CASE WHEN value<=25 THEN '#00E400' WHEN value<=55 THEN '#FFFF00' WHEN value<=150 THEN '#FF7E00' WHEN value<=250 THEN '#FF0000' WHEN value<=350 THEN '#8F3F97' ELSE '#7E0023' END AS hex,
 CASE field WHEN 'pm25' THEN 'µg/m³' WHEN 'pm10' THEN 'µg/m³' WHEN 'no2' THEN 'ppb' WHEN 'co' THEN 'ppm' ELSE '' END AS unit,
 CASE WHEN value<=50 THEN 'Bon' WHEN value<=100 THEN 'Modéré' WHEN value<=150 THEN 'Mauvais (sensibles)' WHEN value<=200 THEN 'Mauvais' WHEN value<=300 THEN 'Très mauvais' ELSE 'Dangereux' END AS label,
 CASE WHEN value<=50 THEN 'La qualité' WHEN value<=100 THEN 'Qualité de' WHEN value<=150 THEN 'Les enfant' WHEN value<=200 THEN 'Tout le mo' WHEN value<=300 THEN 'Alerte san' ELSE 'Urgence sa' END AS advice_start
FROM (SELECT *, least(500, value/CASE field WHEN 'pm10' THEN 425 ELSE 100 END*150) AS s FROM v_readings)""")
def _(t):
    v, p = F.col("value"), F.col("field")
    return t.v_readings.select("reading_id", aqi.marker_index(v).alias("marker"), aqi.pollutant_color(p, v).alias("color"),
                               aqi.step(v, aqi.PM25_HEX).alias("hex"), aqi.unit(p).alias("unit"),
                               aqi.step(v, aqi.DISPLAY, 2).alias("label"),
                               F.left(aqi.step(v, aqi.DISPLAY, 3), F.lit(10)).alias("advice_start"))


def _flags(d):
    return [c.alias(n) for n, c in d.items()]


def _r(d):
    return [F.round(c, 6).alias(n) for n, c in d.items()]


@query("fn_calendar", """SELECT reading_id, CASE WHEN d>=5 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN h IN (7,8,9,17,18,19) THEN 1 ELSE 0 END AS is_rush_hour,
 CASE WHEN h>=22 OR h<=5 THEN 1 ELSE 0 END AS is_night, CASE WHEN h BETWEEN 6 AND 10 THEN 1 ELSE 0 END AS is_morning,
 CASE WHEN h BETWEEN 17 AND 21 THEN 1 ELSE 0 END AS is_evening, CASE WHEN h BETWEEN 8 AND 17 AND d<5 THEN 1 ELSE 0 END AS is_business_hour
FROM (SELECT reading_id, hour(ts) AS h, isodow(ts)-1 AS d FROM v_readings)""")
def _(t):
    return t.v_readings.select("reading_id", *_flags(timefeat.calendar(F.col("ts"))))


@query("fn_cyclic", """SELECT reading_id, round(sin(2*pi()*h/24),6) AS hour_sin, round(cos(2*pi()*h/24),6) AS hour_cos, round(sin(2*pi()*d/7),6) AS day_of_week_sin,
 round(cos(2*pi()*d/7),6) AS day_of_week_cos, round(sin(2*pi()*m/12),6) AS month_sin, round(cos(2*pi()*m/12),6) AS month_cos,
 round(sin(2*pi()*dy/365),6) AS day_of_year_sin, round(cos(2*pi()*dy/365),6) AS day_of_year_cos,
 round(sin(2*pi()*w/52),6) AS week_of_year_sin, round(cos(2*pi()*w/52),6) AS week_of_year_cos
FROM (SELECT reading_id, hour(ts)+minute(ts)/60.0E0 AS h, isodow(ts)-1 AS d, month(ts) AS m, dayofyear(ts) AS dy, week(ts) AS w FROM v_readings)""")
def _(t):
    ts = F.col("ts")
    return t.v_readings.select("reading_id", *_r({**timefeat.cyclic(ts), **timefeat.cyclic_training(ts)}))


@query("fn_weather", """SELECT event_id, round(sin(radians(wind_direction)),6) AS wind_dir_sin, round(cos(radians(wind_direction)),6) AS wind_dir_cos,
 round(0.8E0*temperature+humidity*temperature/500,6) AS temp_hum_index, round(temperature-(100-humidity)/5,6) AS dew_point,
 round(temperature*humidity/100,6) AS temp_x_humidity FROM v_weather""")
def _(t):
    w = timefeat.weather(F.col("temperature"), F.col("humidity"), F.col("wind_direction"))
    return t.v_weather.select("event_id", *_r({**w, "temp_x_humidity": F.col("temperature") * F.col("humidity") / 100}))


@query("fn_ratios", """WITH z AS (SELECT zone_id, hour(ts) AS h, coalesce(avg(value) FILTER (field='pm25'),0) AS pm25, coalesce(avg(value) FILTER (field='pm10'),0) AS pm10,
 coalesce(avg(value) FILTER (field='co'),0) AS co, coalesce(avg(value) FILTER (field='no2'),0) AS no2, coalesce(avg(value) FILTER (field='o3'),0) AS o3 FROM v_readings GROUP BY 1,2)
SELECT zone_id, CAST(h AS INTEGER) AS h, round(CASE WHEN pm10>0 THEN pm25/pm10 END,6) AS pm25_pm10_ratio, round(CASE WHEN co>0 THEN pm25/co END,6) AS pm25_co_ratio,
 round(CASE WHEN co>0 THEN no2/co END,6) AS no2_co_ratio, round(CASE WHEN no2>0 THEN pm25/no2 END,6) AS pm25_no2_ratio, round(CASE WHEN no2>0 THEN co/no2 END,6) AS co_no2_ratio,
 round(CASE WHEN pm25>0 THEN pm10/pm25 END,6) AS pm10_pm25_ratio, round(CASE WHEN co>0 THEN pm10/co END,6) AS pm10_co_ratio, round(CASE WHEN o3>0 THEN no2/o3 END,6) AS no2_o3_ratio FROM z""")
def _(t):
    z = rollup.pivot(t.v_readings.withColumn("h", F.hour("ts")), ["zone_id", "h"], list(P))
    return z.select("zone_id", "h", *_r(timefeat.ratios({p: F.coalesce(p, F.lit(0.0)) for p in P})))


@query("fn_wind_independence", """SELECT event_id, round(CASE WHEN pm>0 AND up>0 THEN abs(pm-up)/greatest(pm,up) WHEN wind_speed<0.5E0 THEN 1.0E0 END,6) AS wii
FROM (SELECT event_id, wind_speed, wind_speed*20-10 AS pm, CAST(event_id%60-20 AS DOUBLE) AS up FROM v_weather)""")
def _(t):
    w = t.v_weather
    return w.select("event_id", F.round(timefeat.wind_independence(
        F.col("wind_speed") * 20 - 10, (F.col("event_id") % 60 - 20).cast("double"), F.col("wind_speed")), 6).alias("wii"))


@query("fn_spatial_gradient", """SELECT r.reading_id, round((r.value-c.m)/greatest(r.value,1),6) AS gradient FROM v_readings r
JOIN (SELECT zone_id, avg(value) AS m FROM v_readings WHERE field='pm25' GROUP BY 1) c USING (zone_id) WHERE field='pm25'""")
def _(t):
    r = t.v_readings.where(F.col("field") == "pm25")
    m = r.groupBy("zone_id").agg(F.avg("value").alias("m"))
    return r.join(m, "zone_id").select(
        "reading_id", F.round(timefeat.spatial_gradient(F.col("value"), F.col("m")), 6).alias("gradient"))


@query("fn_sensor_meta", """WITH s AS (SELECT sensor_id, zone_id, DATE '2023-01-01' + CAST(sensor_id % 300 AS INTEGER) AS install_date, CAST(sensor_id % 101 AS DOUBLE) AS battery
  FROM v_sensors WHERE status='active'), f AS (SELECT zone_id, min(sensor_id) AS sensor_id FROM s GROUP BY 1),
c AS (SELECT sensor_id, max(valid_from) AS last_calibration FROM v_calibration GROUP BY 1)
SELECT zone_id, f.sensor_id, battery AS battery_level, date_diff('day', install_date, DATE '2024-01-31') AS sensor_age_days,
 date_diff('day', CAST(last_calibration AS DATE), DATE '2024-01-31') AS days_since_calibration FROM f JOIN s USING (zone_id, sensor_id) LEFT JOIN c USING (sensor_id)""")
def _(t):
    s = t.v_sensors.where(F.col("status") == "active").withColumn(
        "install_date", F.date_add(F.lit("2023-01-01").cast("date"), (F.col("sensor_id") % 300).cast("int")))
    s = s.withColumn("battery", (F.col("sensor_id") % 101).cast("double"))
    first = s.groupBy("zone_id").agg(F.min_by(F.struct("sensor_id", "install_date", "battery"), "sensor_id").alias("s"))
    c = t.v_calibration.groupBy("sensor_id").agg(F.max("valid_from").alias("last_calibration"))
    day = F.to_date(now())
    return first.select("zone_id", "s.*").join(c, "sensor_id", "left").select(
        "zone_id", "sensor_id", F.col("battery").alias("battery_level"),
        F.datediff(day, "install_date").cast("long").alias("sensor_age_days"),
        F.datediff(day, "last_calibration").cast("long").alias("days_since_calibration"))


@query("fn_sensor_density", "SELECT zone_id, count(*) FILTER (status='active') AS density FROM v_sensors GROUP BY 1")
def _(t):
    return t.v_sensors.groupBy("zone_id").agg(F.count_if(F.col("status") == "active").alias("density"))


HAV_SQL = """2*6371*asin(sqrt(least(pow(sin(radians({lat2}-{lat1})/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2),1)))"""


@query("fn_haversine", "SELECT report_id, round(" + HAV_SQL.format(lat1="lat", lon1="lon", lat2="14.7E0", lon2="(-17.45E0)") + ", 6) AS km FROM v_reports")
def _(t):
    return t.v_reports.select("report_id", F.round(
        geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(14.7), F.lit(-17.45)), 6).alias("km"))


AZ_SQL = "CASE WHEN {x1}<>{x2} OR {y1}<>{y2} THEN fmod(degrees(atan2({x2}-{x1},{y2}-{y1}))+360,360) END"


@query("fn_azimuth", "SELECT report_id, round(az,6) AS azimuth, round(abs(fmod(az-10+180+360,360)-180),6) AS diff FROM (SELECT report_id, "
       + AZ_SQL.format(x1="lon", y1="lat", x2="(-17.45E0)", y2="14.7E0") + " AS az FROM v_reports)")
def _(t):
    az = geo.azimuth(F.col("lon"), F.col("lat"), F.lit(-17.45), F.lit(14.7))
    return t.v_reports.select("report_id", F.round(az, 6).alias("azimuth"),
                              F.round(geo.circular_diff(az, F.lit(10.0)), 6).alias("diff"))


@query("fn_centroid_bbox", """SELECT zone_id, round((2*lon_c)/2,6) AS lon, round(lat_c,6) AS lat, round(lon_c-half,6) AS xmin, round(lat_c-half,6) AS ymin,
 round(lon_c+half,6) AS xmax, round(lat_c+half,6) AS ymax FROM v_zones""")
def _(t):
    z = t.v_zones.select("zone_id", (F.col("lon_c") - F.col("half")).alias("xmin"), (F.col("lat_c") - F.col("half")).alias("ymin"),
                         (F.col("lon_c") + F.col("half")).alias("xmax"), (F.col("lat_c") + F.col("half")).alias("ymax"))
    return z.select("zone_id", F.round((F.col("xmin") + F.col("xmax")) / 2, 6).alias("lon"),
                    F.round((F.col("ymin") + F.col("ymax")) / 2, 6).alias("lat"),
                    *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query("fn_snap_grid", """SELECT report_id, round(round_even(lon/0.001E0,0)*0.001E0,6) AS lon_insert, round(round_even(lat/0.001E0,0)*0.001E0,6) AS lat_insert,
 round(round_even(lon/0.005E0,0)*0.005E0,6) AS lon_read, round(round_even(lat/0.005E0,0)*0.005E0,6) AS lat_read FROM v_reports""")
def _(t):
    return t.v_reports.select("report_id", *[F.round(geo.snap(F.col(c), g), 6).alias(f"{c}_{n}")
                                             for c in ("lon", "lat") for n, g in (("insert", 0.001), ("read", 0.005))])


#: The shift comes from a hash that SQL does not have; what holds for every published point is checked instead.
@query("fn_anonymize_point", """SELECT r.report_id, min(z.zone_id) AS zone_id, true AS shift_bounded, true AS moved, true AS stays_in_zone
FROM v_reports r LEFT JOIN v_zones z ON r.lon BETWEEN z.lon_c-z.half AND z.lon_c+z.half AND r.lat BETWEEN z.lat_c-z.half AND z.lat_c+z.half GROUP BY 1""")
def _(t):
    p = joins.locate(t.v_reports.select("report_id", "lon", "lat"), t.v_zones).join(
        t.v_zones.select("zone_id", "lon_c", "lat_c", "half"), "zone_id", "left")
    box = F.struct("lon_c", "lat_c", "half")
    a = geo.anonymize_point(F.col("lon"), F.col("lat"), F.col("report_id"),
                            lambda x, y: F.col("lon_c").isNull() | joins.in_zone_box(box, x, y))
    d = p.withColumn("p", a)
    off = [F.abs(F.col(f"p.{c}") - geo.snap(F.col(c), 0.001)) for c in ("lon", "lat")]
    deep = (F.abs(F.col("lon") - F.col("lon_c")) < F.col("half") - 0.001) & (F.abs(F.col("lat") - F.col("lat_c")) < F.col("half") - 0.001)
    kept = F.col("lon_c").isNull() | ~deep | joins.in_zone_box(box, F.col("p.lon"), F.col("p.lat"))
    return d.select("report_id", "zone_id", (F.greatest(*off) <= 0.0005 + 1e-9).alias("shift_bounded"), (F.greatest(*off) > 0).alias("moved"), kept.alias("stays_in_zone"))


@query("fn_text_normalize", r"""SELECT report_id, md5(regexp_replace(regexp_replace(trim(lower(texte), ' '), '\s+', ' ', 'g'),
 '[^\p{L}\p{N}_\s\.,!?''àáâãäåèéêëìíîïòóôõöùúûüçñ]', '', 'g')) AS clean_md5 FROM v_reports""")
def _(t):
    return t.v_reports.select("report_id", F.md5(text.normalize(F.col("texte"))).alias("clean_md5"))


@query("fn_keyword_entities", f"""SELECT report_id, 'POLLUTANT' AS label, kw AS entity FROM v_reports, unnest({POLLUTANT_TOKENS}) u(kw)
WHERE contains(lower(texte), kw)""")
def _(t):
    return t.v_reports.select("report_id", F.lit("POLLUTANT").alias("label"),
                              F.explode(text.found(F.lower("texte"), POLLUTANT_TOKENS)).alias("entity"))


@query("fn_urgency", "SELECT report_id, CASE WHEN " + " OR ".join(f"contains(lower(texte),'{u}')" for u in URGENT_TOKENS)
       + " THEN 'high' WHEN " + "+".join(f"CAST(contains(lower(texte),'{k}') AS INTEGER)" for k in POLLUTANT_TOKENS)
       + " >= 2 THEN 'medium' ELSE 'low' END AS urgency FROM v_reports")
def _(t):
    low = F.lower("texte")
    return t.v_reports.select("report_id", text.urgency(
        low, F.size(text.found(low, POLLUTANT_TOKENS)), URGENT_TOKENS).alias("urgency"))


@query("fn_confidence", """SELECT zone_id, hour(ts)::INTEGER AS h, round(least(greatest(1-stddev_samp(value)/greatest(avg(value),1),0),1),3) AS confidence
FROM v_readings WHERE field='pm25' GROUP BY 1,2""")
def _(t):
    return t.v_readings.where(F.col("field") == "pm25").groupBy("zone_id", F.hour("ts").alias("h")).agg(
        messages.confidence(F.stddev_samp("value"), F.avg("value")).alias("confidence"))


@query("fn_linear_calibration", """WITH c AS (SELECT sensor_id, arg_max(coef_a, (valid_from,id)) AS a, arg_max(coef_b,(valid_from,id)) AS b FROM v_calibration WHERE pollutant='pm25' GROUP BY 1)
SELECT reading_id, round(greatest(0, 0.85E0*value-1.2E0),6) AS fallback, round(greatest(0, coalesce(a*value+b, 0.85E0*value-1.2E0)),6) AS calibrated
FROM v_readings LEFT JOIN c USING (sensor_id) WHERE field='pm25'""")
def _(t):
    from ..operators.models import linear_calibration, active_coefficients
    r = t.v_readings.where(F.col("field") == "pm25")
    c = active_coefficients(t.v_calibration.where(F.col("pollutant") == "pm25"))
    j = r.join(c, "sensor_id", "left")
    return j.select("reading_id", F.round(linear_calibration(F.col("value")), 6).alias("fallback"),
                    F.round(linear_calibration(F.col("value"), F.col("coef_a"), F.col("coef_b")), 6).alias("calibrated"))


@query("fn_severity", """SELECT id, CASE WHEN anomaly_score-0.5E0 < -0.15E0 THEN 'danger' ELSE 'warning' END AS severity FROM v_anomalies""")
def _(t):
    from ..operators.detect import severity
    return t.v_anomalies.select("id", severity(F.col("anomaly_score") - 0.5).alias("severity"))


@query("fn_forecast_fields", """SELECT reading_id, h AS horizon_minutes, ts + INTERVAL 1 MINUTE * h AS target_timestamp, CASE WHEN h=60 THEN round(value-10,6) END AS ci_lower,
 CASE WHEN h=60 THEN round(value+10,6) END AS ci_upper, CASE WHEN h=60 AND value>50.1E0 THEN 'PM2.5 prédit à ' || CAST(CAST(round_even(value,0) AS INTEGER) AS VARCHAR) || ' µg/m³ dans 1h' END AS alert,
 CASE WHEN h=60 AND value>100.1E0 THEN 'danger' WHEN h=60 AND value>50.1E0 THEN 'warning' END AS gravite
FROM v_readings, unnest([60,360,1440]) u(h) WHERE field='pm25'""")
def _(t):
    from ..operators.models import forecast_fields
    f = t.v_readings.where(F.col("field") == "pm25").select("reading_id", "ts", F.col("value").alias("h1"))
    p = f.withColumns({"h6": F.col("h1"), "h24": F.col("h1"), "ci_lower_h1": F.col("h1") - 10, "ci_upper_h1": F.col("h1") + 10})
    return forecast_fields(p, ["reading_id"], "ts").select(
        "reading_id", "horizon_minutes", "target_timestamp", F.round("ci_lower", 6).alias("ci_lower"),
        F.round("ci_upper", 6).alias("ci_upper"), "alert", "gravite")


@query("fn_time_misc", """SELECT reading_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(ts)%1000 AS VARCHAR),3,'0') || 'Z' AS iso, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s,
 round(epoch($NOW - ts)/60,1) AS minutes_since, CASE WHEN s<60 THEN 'il y a '||s||'s' WHEN s<3600 THEN 'il y a '||(s//60)||' min' WHEN s<86400 THEN 'il y a '||(s//3600)||' h' ELSE 'il y a '||(s//86400)||' j' END AS rel
FROM (SELECT *, CAST(floor(epoch($NOW-ts)) AS BIGINT) AS s FROM v_readings)""")
def _(t):
    z = F.col("ts").cast("timestamp")
    return t.v_readings.select("reading_id", F.date_format(z, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"),
                               F.unix_timestamp(z).alias("epoch_s"),
                               F.round(timefeat.seconds_between(now(), F.col("ts")) / 60, 1).alias("minutes_since"),
                               timefeat.relative_age(F.col("ts"), now()).alias("rel"))


@query("fn_json_build", """SELECT id, '{"anomaly_id":'||id||',"pollutant":"'||pollutant||'"}' AS obj, '{"a":"1","b":"'||zone_id||'"}' AS merged,
 CASE WHEN zone_id % 2 = 0 THEN 'b' ELSE '' END AS changed FROM v_anomalies""")
def _(t):
    a = t.v_anomalies
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.when(F.col("zone_id") % 2 == 0, "x").otherwise(F.col("zone_id").cast("string")))
    new = F.create_map(F.lit("b"), F.col("zone_id").cast("string"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    return a.select("id", F.to_json(F.struct(F.col("id").alias("anomaly_id"), "pollutant")).alias("obj"),
                    F.to_json(merged).alias("merged"),
                    F.array_join(changed_keys(old, merged), ",").alias("changed"))


_PAD = ["".join(f"{b ^ pad:02x}" for b in b"secret".ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query("fn_pseudonym", f"SELECT c_custkey, left(sha256(from_hex('{_PAD[1]}') || from_hex(sha256(from_hex('{_PAD[0]}') || encode(c_name)))), 32) AS lookup, sha256(lower(trim(c_name))) AS email_hash FROM customer")
def _(t):
    return t.customer.select("c_custkey", text.pseudonym(F.col("c_name"), "secret").alias("lookup"),
                             F.sha2(F.lower(F.trim("c_name")), 256).alias("email_hash"))
