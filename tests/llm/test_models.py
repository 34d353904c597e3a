"""Language ID and toxicity: held-out quality on the given tables, odd rows, tables without labels."""

from pyspark.sql import functions as F

from hazegrid.llm import langid, langid_q, toxicity, toxicity_q
from tests.llm.helpers import clashing, empty, odd, odd_rows

DIR = "/root/testdata/sf0.1"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    r = langid_q.op7(spark, DIR).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n, ok, rejected = r.agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert n > 3000 and ok > 0.99 and rejected < 0.05


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    said = docs.select("doc_id", F.col("text").rlike(r"(?i)\b(trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron)\b").alias("said"))
    r = toxicity_q.op8(spark, DIR).join(said, "doc_id").join(labels, "doc_id").where("held_out")
    got = {(x["said"], x["toxic"]): x["p"] for x in r.groupBy("said", "toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert got[True, 1] > 0.9 and got[False, 0] < 0.02


def test_misspellings_score_higher_than_plain_words(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(docs, labels, toxicity_q.fifth("doc_id") != 0)
    plain = "The and onesen erblest it hein inenan whou therouou thon the " * 3
    assert m.score(plain + "stupidd idiott worthles pathetik moronn") > 0.5 > m.score(plain)


def test_language_of_odd_rows(spark):
    d = clashing(odd(spark), "id", "_text", "score")
    m = langid.fit(d, F.lit(True))
    got = langid.predict(d, m).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["id"]: r["lang_pred"] for r in got if r["id"] in (3, 4, 5, 7)} == dict.fromkeys((3, 4, 5, 7), "und")
    assert {r["lang_pred"] for r in got} <= {"en", "de", "und"}
    nothing = langid.fit(empty(spark), F.lit(True))
    assert langid.predict(empty(spark), nothing).count() == 0
    assert {r["lang_pred"] for r in langid.predict(d, nothing).collect()} == {"und"}


def test_one_language_with_fewer_texts_than_centroids(spark):
    d = spark.createDataFrame([(1, "Eins zwei drei", "de"), (2, "vier fünf", "de"), (3, "one two", "en")], "doc_id long, text string, lang string")
    got = {r["id"]: r["lang_pred"] for r in langid.predict(d, langid.fit(d, F.lit(True))).collect()}
    assert got == {1: "de", 2: "de", 3: "en"}


def test_toxicity_of_odd_rows_and_few_labels(spark):
    d = clashing(odd(spark), "id", "_y", "score")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1), (1, 1), (6, None), (None, 1)], "doc_id long, toxic int"),
                   spark.createDataFrame([(1, 1), (2, 1), (6, 0), (8, 0), (3, 0), (4, 1)], "doc_id long, toxic int")):
        m = toxicity.fit(d, labels, F.lit(True))
        got = toxicity.predict(d, m).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.predict(empty(spark), m).count() == 0
