"""Citizen-report jobs and text search."""

import math

from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins, reports, similarity
from .joins_q import EDGE_SQL, HIT_SQL, zone_polygons
from .registry import query
from .scalars_q import HAV_SQL
from .views import POLLUTANT_TOKENS, URGENT_TOKENS

CLEAN = r"""regexp_replace(regexp_replace(trim(lower(texte), ' '), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s\.,!?''àáâãäåèéêëìíîïòóôõöùúûüçñ]', '', 'g')"""
HIGH = "(" + " OR ".join(f"contains(clean,'{u}')" for u in URGENT_TOKENS) + ")"
N_ENT = "(" + "+".join(f"CAST(contains(clean,'{k}') AS INTEGER)" for k in POLLUTANT_TOKENS) + ")"
NEAR = f"""n AS (SELECT r.report_id, r.created_at, z.zone_id, {HAV_SQL.format(lat1='r.lat', lon1='r.lon', lat2='z.lat_c', lon2='z.lon_c')} AS km FROM v_reports r CROSS JOIN v_zones z),
m AS (SELECT * FROM (SELECT n.report_id, a.id AS anomaly_id, row_number() OVER (PARTITION BY n.report_id ORDER BY a.detected_at DESC, a.id DESC) AS rank FROM n JOIN v_anomalies a ON a.zone_id=n.zone_id AND a.detected_at BETWEEN n.created_at - INTERVAL 2 HOUR AND n.created_at + INTERVAL 30 MINUTE WHERE km<=2) WHERE rank<=10)"""
WANTED = [math.sin(i + 1) for i in range(64)]


@query("txt_report_process", f"""WITH {NEAR}, c AS (SELECT report_id, {CLEAN} AS clean FROM v_reports WHERE nlp_status='pending')
SELECT report_id, CASE WHEN {HIGH} THEN 'high' WHEN {N_ENT}>=2 THEN 'medium' ELSE 'low' END AS urgency, {N_ENT} AS entities, coalesce((SELECT count(*) FROM m WHERE m.report_id=c.report_id),0) AS nearby, 'processed' AS nlp_status FROM c""")
def _(t):
    return reports.process(t.v_reports, t.v_anomalies, t.v_zones, POLLUTANT_TOKENS, URGENT_TOKENS)


@query("txt_citizen_alert", f"""WITH c AS (SELECT *, {CLEAN} AS clean FROM v_reports) SELECT report_id, coalesce(min(z.zone_id),1) AS zone_id, 'citizen_report' AS type, 'warning' AS gravite, 'Signalement citoyen urgent : ' || left(any_value(texte),100) AS message
FROM c LEFT JOIN v_zones z ON c.lon BETWEEN z.lon_c-z.half AND z.lon_c+z.half AND c.lat BETWEEN z.lat_c-z.half AND z.lat_c+z.half WHERE {HIGH} GROUP BY report_id""")
def _(t):
    return reports.citizen_alerts(reports.read(t.v_reports, POLLUTANT_TOKENS, URGENT_TOKENS), t.v_zones)


@query("txt_citizen_alert_polygons", f"""WITH {EDGE_SQL}, h AS ({HIT_SQL.format(p='v_reports')}), c AS (SELECT report_id, texte, {CLEAN} AS clean FROM v_reports)
SELECT c.report_id, coalesce(arg_min(h.zone_id, h.zone_id - 1000*h.niveau),1) AS zone_id, 'Signalement citoyen urgent : ' || left(any_value(texte),100) AS message FROM c LEFT JOIN h USING (report_id) WHERE {HIGH} GROUP BY 1""")
def _(t):
    return reports.citizen_alerts(reports.read(t.v_reports, POLLUTANT_TOKENS, URGENT_TOKENS), zone_polygons(t)).select("report_id", "zone_id", "message")


@query("txt_correlate", f"WITH {NEAR} SELECT id, handled OR id IN (SELECT anomaly_id FROM m) AS handled FROM v_anomalies")
def _(t):
    return reports.mark_handled(t.v_anomalies, joins.spatiotemporal(t.v_reports, t.v_anomalies, t.v_zones)).select("id", "handled")


@query("txt_similar", f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {WANTED}),6) AS similarity FROM embeddings ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return reports.similar(t.embeddings, "vec_id", "embedding", WANTED, 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("txt_fuzzy", """WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name),' ')) AS w FROM part), g AS (SELECT DISTINCT p_partkey, substr('  '||w||' ', i, 3) AS g FROM w, range(1,40) r(i) WHERE i <= length(w)+1),
q AS (SELECT DISTINCT substr('  '||w||' ', i, 3) AS g FROM (VALUES ('small'),('rings')) v(w), range(1,40) r(i) WHERE i <= length(w)+1), c AS (SELECT p_partkey, count(*) AS n, count(*) FILTER (g IN (SELECT g FROM q)) AS b FROM g GROUP BY 1)
SELECT p_partkey, round(b/CAST(n + (SELECT count(*) FROM q) - b AS DOUBLE),6) AS similarity FROM c WHERE b/CAST(n + (SELECT count(*) FROM q) - b AS DOUBLE) > 0.3E0""")
def _(t):
    return reports.fuzzy(t.part, F.col("p_name"), "small rings").select("p_partkey", F.round("similarity", 6).alias("similarity"))


@query("txt_fulltext", r"""SELECT report_id FROM v_reports WHERE list_contains(string_split(regexp_replace(lower(texte),'[^\p{L}\p{N}]+',' ','g'),' '),'the') AND list_contains(string_split(regexp_replace(lower(texte),'[^\p{L}\p{N}]+',' ','g'),' '),'with')""")
def _(t):
    return reports.fulltext(t.v_reports, F.col("texte"), ["the", "with"]).select("report_id")


#: What a run of the report job leaves behind: processed reports, alert rows, correlations and the summary.
@query("txt_report_job", f"""WITH {NEAR}, {EDGE_SQL}, hh AS ({HIT_SQL.format(p='v_reports')}), c AS (SELECT report_id, texte, {CLEAN} AS clean FROM v_reports WHERE nlp_status='pending'), u AS (SELECT *, {HIGH} AS high FROM c)
SELECT 'alert' AS kind, report_id AS id, coalesce(arg_min(hh.zone_id, hh.zone_id - 1000*hh.niveau),1) AS ref, 'Signalement citoyen urgent : ' || left(any_value(texte),100) AS detail FROM u LEFT JOIN hh USING (report_id) WHERE high GROUP BY 2
UNION ALL SELECT 'correlation', report_id, anomaly_id, NULL FROM m WHERE report_id IN (SELECT report_id FROM c) UNION ALL SELECT 'summary', count(*), count(*) FILTER (high), NULL FROM u""")
def _(t):
    _, alerts, matches, summary = reports.run(t.v_reports, t.v_anomalies, _both(t), POLLUTANT_TOKENS, URGENT_TOKENS)
    none = F.lit(None).cast("string").alias("detail")
    a = alerts.select(F.lit("alert").alias("kind"), F.col("report_id").alias("id"), F.col("zone_id").alias("ref"), F.col("message").alias("detail"))
    m = matches.select(F.lit("correlation").alias("kind"), F.col("report_id").alias("id"), F.col("anomaly_id").alias("ref"), none)
    return a.unionByName(m).unionByName(summary.select(F.lit("summary").alias("kind"), F.col("processed").alias("id"), F.col("high_urgency").alias("ref"), none))


def _both(t):
    """Polygon zones with the centroids that the search for anomalies nearby uses."""
    c = t.v_zones.select("zone_id", "lon_c", "lat_c", "half")
    return zone_polygons(t).join(c, "zone_id", "left")


#: The keyword lists of the job itself, on all reports.
@query("txt_report_keywords", f"""WITH c AS (SELECT report_id, {CLEAN} AS clean FROM v_reports), e AS (SELECT report_id, clean, list_filter({text.POLLUTANT_WORDS}, lambda w: contains(clean, w)) AS found FROM c)
SELECT report_id, array_to_string(found, ',') AS entities, CASE WHEN {" OR ".join(f"contains(clean, '{u}')" for u in text.URGENT_PHRASES)} THEN 'high' WHEN len(found)>=2 THEN 'medium' ELSE 'low' END AS urgency FROM e""")
def _(t):
    return reports.read(t.v_reports).select("report_id", F.array_join("entities", ",").alias("entities"), "urgency")


#: Learned vectors, which SQL cannot express (tests/test_word2vec.py); some components of the mean.
@query("txt_embed")
def _(t):
    e = F.col("embedding")
    return reports.embed(t.v_reports).select("report_id", F.size(e).alias("dims"), *[F.round(F.get(e, F.lit(b)), 6).alias(f"c{b}") for b in (0, 1, 31, 100, 255, 256, 299)])


_ENDINGS = "|".join(reports.FRENCH_ENDINGS)
_LEX = ("list_distinct(list_transform(list_filter(string_split(regexp_replace(lower({}),'[^\\p{{L}}\\p{{N}}]+',' ','g'),' '), lambda w: w <> '' AND NOT list_contains("
        + str(list(reports.FRENCH_STOP)) + ", w)), lambda w: regexp_replace(w, '^(.{{3,}}?)(?:" + _ENDINGS + ")$', '\\1')))")


#: Words are found in any inflexion: the text and what is looked for lose the same endings.
@query("txt_fulltext_french", f"SELECT report_id FROM v_reports WHERE len({_LEX.format(chr(39) + 'les ouelles' + chr(39))}) > 0 AND list_has_all({_LEX.format('texte')}, {_LEX.format(chr(39) + 'les ouelles' + chr(39))})")
def _(t):
    return reports.search(t.v_reports, F.col("texte"), "les ouelles").select("report_id")


def _grams(x):
    return f"(SELECT list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({x}),'[^\\p{{L}}\\p{{N}}]+',' ','g'),' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w)+2), lambda i: substr('  '||w||' ', i::INT, 3))))))"


#: All pairs of similar names of two tables.
@query("txt_fuzzy_join", f"""WITH a AS (SELECT DISTINCT c_name AS name, {_grams('c_name')} AS g FROM customer), b AS (SELECT DISTINCT s_name AS name, {_grams('s_name')} AS g FROM supplier),
p AS (SELECT a.name AS left_name, b.name AS right_name, len(list_intersect(a.g, b.g)) AS k, len(a.g) AS n, len(b.g) AS m FROM a, b)
SELECT left_name, right_name, round(k/CAST(n+m-k AS DOUBLE),6) AS similarity FROM p WHERE k/CAST(n+m-k AS DOUBLE) > 0.3E0""")
def _(t):
    p = similarity.name_pairs(t.customer.select(F.col("c_name").alias("name")), t.supplier.select(F.col("s_name").alias("name")))
    return p.withColumn("similarity", F.round("similarity", 6))


#: The ten most similar vectors of every fiftieth one, by inverted lists.
@query("txt_similar_many", """WITH s AS (SELECT q.vec_id AS query, v.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)
SELECT query, CAST(rank AS INTEGER) AS rank, round(s,6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM s) WHERE rank <= 10""")
def _(t):
    index = similarity.VectorIndex(t.embeddings, "vec_id", "embedding", cells=32)
    r = index.search(t.embeddings.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", 10, exact=True)
    return r.select("query", "rank", F.round("similarity", 6).alias("similarity"))
