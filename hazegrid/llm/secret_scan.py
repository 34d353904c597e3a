"""Secret scans: candidates by form, false positives removed by a random forest.

Candidates are long runs of key characters with a digit in them. Each gets its length, the transitions between kinds of
characters, how much of it consists of words that are common in the documents, whether the document's path speaks of tests or
examples, and what the neighbouring words say. A random forest trained on labelled findings gives the probability that it is a
secret. Without a table of labelled findings those that rules can label serve: values of known formats or assigned to a name
like ``token`` are secrets; plain numbers, placeholders and values next to words like ``sha`` or ``example`` are none. Built-in
functions and Spark's own forest only.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, saved

LEAST = 16
#: A run of letters counts as a word if it occurs so often in a million runs of the documents, and more than once.
COMMON = 5.0
#: Labelled findings per class that the forest is fitted on.
SAMPLE = 5000
TREES, DEPTH, SEED = 30, 6, 7
CORE = r"[A-Za-z0-9_+/.-]{16,}={0,2}"
#: A run is also taken apart here: each piece that is long enough is a candidate of its own.
APART = r"[/.]+"
#: fixed values: published formats of keys
FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,})"
NAMES = r"(?i)(token|secret|passw|pwd|api_?key|access_?key|auth|credential|bearer|private)"
HARMLESS = r"(?i)(example|sample|dummy|placeholder|test|sha\d*|md5|hash|commit|checksum|uuid|isbn|card|phone|order|build)"
PATHS = r"(?i)(test|example|sample|fixture|doc|mock)"
FEATURES = ["length", "digits", "upper", "kinds", "kind_changes", "vowel_changes", "distinct", "covered", "path", "assigned", "quoted", "named", "harmless"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """``(id, at, nth, value, path, before, around)``: word number ``at`` holds candidates; null texts have none.

    Every long run of key characters in a word counts, numbered from 0, whole and each of the long pieces that slashes and dots cut
    it into; what stands before a value in its word belongs to ``before``. Equal values at different places are candidates each.
    """
    w = docs.select(F.col(id_col).alias("id"), F.col(path).alias("path"), F.split(flat(F.col(text)), " ", -1).alias("w"))
    word = F.col("w")
    long = F.filter(F.transform(word, lambda x, i: F.when(F.length(x) >= LEAST, i)), lambda i: i.isNotNull())
    w = w.select("id", "path", "w", F.explode_outer(long).alias("at")).where("at is not null")
    w = w.select("id", "path", "at", F.get(word, F.col("at")).alias("own"),
                 F.concat_ws(" ", F.get(word, F.col("at") - 2), F.get(word, F.col("at") - 1)).alias("before"), F.get(word, F.col("at") + 1).alias("after"))
    runs = F.transform(F.regexp_extract_all("own", F.lit(CORE), F.lit(0)), lambda r: F.regexp_replace(r, r"^[/.]+|[/.]+$", ""))
    pieces = F.flatten(F.transform(runs, lambda r: F.concat(F.array(r), F.filter(F.split(r, APART), lambda p: (F.length(p) >= LEAST) & (p != r)))))
    good = F.filter(F.array_distinct(pieces), lambda v: (F.length(v) >= LEAST) & v.rlike("[0-9]"))
    w = w.select("*", F.posexplode(good).alias("nth", "value"))
    lead = F.expr("substring(own, 1, locate(value, own) - 1)")
    return w.select("id", "at", "nth", "value", "path", F.concat_ws(" ", "before", lead).alias("before"), F.concat_ws(" ", "before", "own", "after").alias("around"))


def common_words(docs: DataFrame, text: str = "text", rate: float = COMMON) -> DataFrame:
    """Runs of four or more letters that occur often in the documents: in at least ``rate`` of a million such runs, over all of them."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z]+", " "), " ", -1)
    w = docs.select(F.explode(words).alias("word")).where(F.length("word") >= 4)
    n = saved(w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "words")
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
    return n.where(F.col("n") * F.lit(1e6) >= F.lit(rate) * total.scalar()).select("word")


def _count(value: str, pattern: str) -> Column:
    return F.regexp_count(F.col(value), F.lit(pattern))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the columns of ``FEATURES``."""
    n = F.greatest(F.length("value"), F.lit(1))
    kinds = sum((F.col("value").rlike(p).cast("double") for p in ("[a-z]", "[A-Z]", "[0-9]", "[_+/=-]")), F.lit(0.0))
    f = found.withColumns({
        "length": n.cast("double"), "digits": _count("value", "[0-9]") / n, "upper": _count("value", "[A-Z]") / n, "kinds": kinds,
        "kind_changes": (_count("value", "[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+") - 1) / n,
        "vowel_changes": _count("value", "(?i)[aeiou]+[b-df-hj-np-tv-z]+") / n,
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
        "path": F.coalesce(F.col("path").rlike(PATHS), F.lit(False)).cast("double"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"'`(\[{<]*$").cast("double"), "quoted": F.col("before").rlike(r"[\"'`]$").cast("double"),
        "named": F.col("before").rlike(NAMES).cast("double"), "harmless": F.col("around").rlike(HARMLESS).cast("double")})
    # share of letters in common words; by distinct value, as values may repeat very often
    runs = f.select("value").distinct().select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    got = runs.join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("in_words"))
    f = f.join(got, "value", "left")
    return f.withColumn("covered", F.coalesce(F.col("in_words") / n, F.lit(0.0))).drop("in_words")


def rule_labels(found: DataFrame) -> DataFrame:
    """``label`` by rules where they decide, else null."""
    known = F.col("value").rlike(FORMATS) | ((F.col("named") > 0) & (F.col("assigned") > 0) & (F.col("harmless") == 0) & (F.col("distinct") > 0.15))
    none = F.col("value").rlike(r"^[0-9=_+/-]+$") | ((F.col("harmless") > 0) & (F.col("named") == 0)) | (F.col("covered") > 0.5)
    return found.withColumn("label", F.when(known, 1.0).when(none, 0.0))


def fit(labelled: DataFrame, sample: int = SAMPLE):
    """The forest, from at most ``sample`` findings per label by a hash; None if only one label is there."""
    w = Window.partitionBy("label").orderBy(F.xxhash64("value", "before"), "id", "at", "nth")
    t = labelled.where("label is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample)
    t = saved(t.select("label", *FEATURES), "labelled")
    if t.select("label").distinct().count() < 2:
        return None
    t = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(t)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features").fit(t)


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """``(id, at, nth, length, value_sha256, probability, is_secret)`` for each candidate; the value itself is not given out.

    ``labelled(id, at, label)`` holds findings labelled by people, for all candidates of a word; of several labels for one the larger
    counts. Without it the rules label. If the labels are all the same, the rules' labels stand, and 0 where they do not decide. Repeated rows
    and rows without an id are scanned each by itself; very long texts are scanned whole.
    """
    cand = saved(candidates(docs, id_col, text, path), "found")
    found = saved(rule_labels(features(cand, common_words(docs, text))), "candidates")
    train = found if labelled is None else found.drop("label").join(labelled.groupBy("id", "at").agg(F.max("label").cast("double").alias("label")), ["id", "at"])
    model = fit(train)
    if model is None:
        p = found.withColumn("probability", F.coalesce("label", F.lit(0.0)))
    else:
        p = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found.drop("probability")))
        p = p.withColumn("probability", vector_to_array("probability")[1])
    return p.select("id", "at", "nth", F.col("length").cast("int").alias("length"), F.sha2("value", 256).alias("value_sha256"), "probability",
                    (F.col("probability") >= 0.5).alias("is_secret"))
