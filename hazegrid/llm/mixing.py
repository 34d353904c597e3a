"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources get shares of the whole mix by weight, none more than a number of passes over its own words; what is over is
shared again by weight. The documents of a source stand in a shuffled order and are cut into blocks of equally many words. The
slots of the mix are the points of the base-2 van der Corput sequence, mapped through the cumulative slot counts of the sources:
point j / 2**p is the slot number bit-reverse(j), so each source gets exactly the slots it needs and any stretch of the mix holds
all sources nearly in proportion. A slot takes the block of its rank within its source, pass after pass; the last one of a source
takes only what is left of the target.

Positions in a source and ranks of slots are sums over buckets plus sums within a bucket, so a hot source is spread over
many tasks. Everything follows from ids, texts and sources by hashing, so reruns and retried tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, hidden, n_words, saved

WEIGHTS = (3, 1, 2)
#: The mix in hundredths of all words, and the most passes over a source.
PERCENT, PASSES = 150, 2
BLOCK = 1024
SEED = "mix"
#: Slots are ranked in stretches of 2**RANK_BITS of the schedule, sources numbered in chunks of as many points.
RANK_BITS = 14


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, passes: int = PASSES) -> DataFrame:
    """``(source, n, weight, target)`` from ``(source, n)`` with one row per source.

    In the order of ``passes * n / weight`` a source is cut to its passes as long as its share of the remaining mix is above that;
    the others share what remains. All in whole numbers up to the last division. Sources number far fewer than documents.
    """
    dec = "decimal(38,0)"
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w)
    every = Window.partitionBy()
    order = Window.orderBy(F.col("n") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"total": F.sum("n").over(every), "all_w": F.sum("weight").over(every),
                       "n_before": F.coalesce(F.sum("n").over(order), F.lit(0)), "w_before": F.coalesce(F.sum("weight").over(order), F.lit(0))})
    mix = F.lit(percent) * F.col("total")
    left = (mix - F.lit(100 * passes) * F.col("n_before")).cast("decimal(19,0)")
    rest = (F.col("all_w") - F.col("w_before")).cast("decimal(18,0)")
    s = s.withColumn("cut", (left * F.col("weight").cast("decimal(4,0)")).cast(dec) > (F.lit(100 * passes) * F.col("n")).cast("decimal(19,0)") * rest)
    s = s.withColumns({"n_cut": F.sum(F.when(F.col("cut"), F.col("n")).otherwise(0)).over(every),
                       "w_rest": F.sum(F.when(F.col("cut"), F.lit(0)).otherwise(F.col("weight"))).over(every)})
    share = (F.col("weight") * (mix - F.lit(100 * passes) * F.col("n_cut"))).cast("double") / (F.lit(100) * F.greatest("w_rest", F.lit(1)))
    return s.select("source", "n", "weight", F.when(F.col("cut"), (F.lit(passes) * F.col("n")).cast("double")).otherwise(share).alias("target"))


def placed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """``(id, mark, source, size, a)``: the words of each row and its first word's place in its source's shuffled order."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    d = saved(docs.select(F.col(id_col).alias("id"), F.xxhash64(text, source).alias("mark"), F.col(source).alias("source"),
                          n_words(flat(F.col(text))).alias("size"), key.alias("h")), "sizes").withColumn("hb", F.substring("h", 1, 3))
    per = d.groupBy("source", "hb").agg(F.sum("size").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("hb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col("source").alias("_s"), F.col("hb").alias("_b"), before.alias("before"))
    w = Window.partitionBy("source", "hb").orderBy("h", "mark").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(w), F.lit(0)))
    d = d.join(per, d["source"].eqNullSafe(per["_s"]) & (F.col("hb") == F.col("_b")))
    return d.select("id", "mark", "source", "size", (F.col("before") + F.col("inside")).alias("a"))


def reverse_bits(j: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(j), max(bits, 1), "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def schedule(goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(source, slot, pass, start, stop)``: the words ``[start, stop)`` of its source that each slot of the mix takes.

    ``goal(source, n, target)`` has one row per source.
    """
    take = F.floor("target").cast("long")
    g = goal.where("n > 0").withColumn("take", take).withColumns({
        "full": F.expr("take div n"), "rem": F.expr("take % n"), "blocks": F.expr(f"(n + {block - 1}) div {block}")})
    g = g.withColumn("slots", F.expr(f"full * blocks + (rem + {block - 1}) div {block}")).where("slots > 0")
    g = saved(g.withColumn("hi", F.sum("slots").over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("lo", F.col("hi") - F.col("slots")), "goal")
    bits = max(0, (g.agg(F.max("hi")).first()[0] or 1) - 1).bit_length()
    chunk = 1 << RANK_BITS
    c = g.withColumn("c", F.explode(F.expr(f"sequence(0, (slots - 1) div {chunk})"))).repartition("source", "c")
    j = F.explode(F.expr(f"sequence(lo + c * {chunk}, least(lo + (c + 1) * {chunk}, hi) - 1)"))
    t = c.select("source", "n", "full", "rem", "blocks", j.alias("j")).withColumn("slot", reverse_bits(F.col("j"), bits))
    t = t.withColumn("stretch", F.shiftright("slot", RANK_BITS))
    per = t.groupBy("source", "stretch").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("source").alias("_s"), F.col("stretch").alias("_t"), F.coalesce(F.sum("k").over(w), F.lit(0)).alias("before"))
    t = t.withColumn("inside", F.row_number().over(Window.partitionBy("source", "stretch").orderBy("slot")) - 1)
    t = t.join(per, t["source"].eqNullSafe(per["_s"]) & (F.col("stretch") == F.col("_t")))
    t = t.withColumn("rank", F.col("before") + F.col("inside"))
    t = t.withColumns({"pass": F.expr("rank div blocks"), "start": F.expr(f"(rank % blocks) * {block}")})
    stop = F.least(F.col("start") + block, F.when(F.col("pass") == F.col("full"), F.col("rem")).otherwise(F.col("n")))
    return t.select("source", "slot", F.col("pass"), "start", stop.alias("stop"))


def takes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
          percent: int = PERCENT, passes: int = PASSES, block: int = BLOCK, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """What the mix takes: ``(id, mark, source, size, a, pass, first, last, slot)`` per document and pass with words taken (words
    ``[first, last)`` of the document, from its first slot on); and all documents ``(id, mark, source, size, a, n, target)``.

    A null text has no words and is never taken; a null source is a source of its own, the last one. Rows with the same id are
    documents of their own. An empty table gives empty results.
    """
    d = saved(placed(docs, id_col, text, source, seed), "placed")
    goal = saved(targets(d.groupBy("source").agg(F.sum("size").alias("n")), weights, percent, passes), "targets")
    slots = schedule(goal, block).withColumn("block", F.expr(f"start div {block}")).withColumnRenamed("source", "_s")
    pieces = d.where("size > 0").withColumn("b", F.explode(F.expr(f"sequence(a div {block}, (a + size - 1) div {block})")))
    m = pieces.join(slots, pieces["source"].eqNullSafe(slots["_s"]) & (F.col("b") == F.col("block")))
    m = m.withColumns({"first": F.greatest("a", "start") - F.col("a"), "last": F.least(F.col("a") + F.col("size"), F.col("stop")) - F.col("a")})
    m = m.where(F.col("last") > F.col("first")).groupBy("id", "mark", "source", "size", "a", "pass").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("slot").alias("slot"))
    g = goal.select(F.col("source").alias("_s"), "n", "target")
    return m, d.join(g, d["source"].eqNullSafe(g["_s"])).select("id", "mark", "source", "size", "a", "n", "target")


def amounts(docs: DataFrame, **how) -> DataFrame:
    """``(id, size, n, target, taken, first_slot)`` for each row of ``docs``; the slot in the mix at which it comes first, null if never."""
    m, d = takes(docs, **how)
    m = m.groupBy(F.col("source").alias("_s"), F.col("a").alias("_a")).agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.min("slot").alias("first_slot"))
    out = d.join(m, d["source"].eqNullSafe(m["_s"]) & (F.col("a") == F.col("_a")) & (F.col("size") > 0), "left")
    return out.select("id", "size", "n", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", n_chars: str | None = "n_chars", slot: str | None = None,
          **how) -> DataFrame:
    """The documents of the mix, one row for each pass that takes one: the whole text, or the words taken of it.

    With ``slot`` a column of that name tells at which slot of the schedule a row comes; in its order any stretch of the mix holds all
    sources nearly in proportion. Rows that share id, text and source are taken as often as all of them, with the other columns of one of them.
    """
    m, _ = takes(docs, id_col, text, source, **how)
    i, k, t, f = (hidden(docs, x) for x in ("_mix_id", "_mix_mark", "_takes", "_flat"))
    m = m.groupBy(F.col("id").alias(i), F.col("mark").alias(k)).agg(F.collect_list(F.struct("pass", "first", "last", "size", "slot")).alias(t))
    own = docs.withColumn(f, F.xxhash64(text, source)).dropDuplicates([id_col, f])
    out = own.join(m, own[id_col].eqNullSafe(m[i]) & (own[f] == m[k])).withColumn(t, F.explode(t))
    whole = (F.col(f"{t}.first") == 0) & (F.col(f"{t}.last") == F.col(f"{t}.size"))
    part = F.array_join(F.slice(F.split(flat(F.col(text)), " ", -1), (F.col(f"{t}.first") + 1).cast("int"),
                                (F.col(f"{t}.last") - F.col(f"{t}.first")).cast("int")), " ")
    out = out.withColumn(text, F.when(whole, F.col(text)).otherwise(part))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(whole, F.col(n_chars)).otherwise(F.length(text)).cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns, *([F.col(f"{t}.slot").alias(slot)] if slot else []))


def write_mixed(docs: DataFrame, path: str, **how) -> None:
    """Write the mix in the order of its slots: files in order, rows in order within each, and all sources in every file."""
    slot = hidden(docs, "_slot")
    m = mixed(docs, slot=slot, **how)
    m.repartitionByRange(F.col(slot)).sortWithinPartitions(slot).drop(slot).write.parquet(path)
