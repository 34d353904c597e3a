"""Helpers shared by the operators: words in SQL, written work tables, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.session import shared_dir

#: White space between words, as a regular expression.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: no part of it is computed twice, also after a lost executor."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flat(text: Column) -> Column:
    """The words of ``text`` joined by single blanks; the empty string if there is none or the text is null."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def n_words(flat_text: Column) -> Column:
    return F.when(flat_text == "", F.lit(0)).otherwise(
        F.length(flat_text) - F.length(F.replace(flat_text, F.lit(" "), F.lit(""))) + 1).cast("long")


def hidden(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Remainders by which rows are thinned before a join; as many longs are broadcast at most (some 100 MB).
SLOTS = 1 << 22


def thinned(df: DataFrame, of: Column, wanted: DataFrame, wanted_of: Column, slots: int = SLOTS) -> DataFrame:
    """The rows of ``df`` whose long ``of`` may be among ``wanted_of`` of ``wanted``, without shuffling them.

    Only remainders are compared, so that what is broadcast has a fixed bound; rows that remain by chance fall to the join that follows.
    """
    name = hidden(df, "_slot")
    few = wanted.select(F.pmod(wanted_of, F.lit(slots)).alias(name)).distinct()
    return df.withColumn(name, F.pmod(of, F.lit(slots))).join(F.broadcast(few), name, "left_semi").drop(name)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, root)``, root being the smallest node reachable; roots are left out.

    Alternating stars: every node hangs its larger neighbours, then its smaller ones, under the smallest node it knows. Only
    minima are aggregated, so a node with very many neighbours is combined before the shuffle. Each round is written out.
    """
    def sides(e):
        return F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")

    e = saved(edges.where(F.col("a") != F.col("b")).select(*sides(edges)).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select("hi", "lo"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        under = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(under, "hi").select("m", "lo", "hi")
        e = saved(small.select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi"))
                  .where("lo <> hi").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
