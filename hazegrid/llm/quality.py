"""Quality rules with adaptive thresholds.

Each document gets word and line counts and a few ratios in thousandths. Per language and source the ratios are gathered in
quantile sketches: counts of log-linear buckets, whose bounds depend on the value alone. Two sketches merge by adding counts, so
the sketch of a language is the sum over its sources, the result does not depend on the order of rows or on lost tasks, and a
hot source is combined map-side. The fences of a group come from the quartiles of its sketch, merged with those of its language and of all
documents at a small weight, and are joined back to the documents.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, flat, hidden, n_words, saved

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Words of a window that is looked up in its own text.
WINDOW = 5
#: ratio: least spread that a group is taken to have, in thousandths. Keeps a group of equal values from rejecting its neighbours.
RATIOS = {"chars_per_word": 250, "symbols_per_word": 50, "dup_lines_share": 100}
#: A ratio beyond the upper quartile by so many spreads is out.
SPREADS = 6
#: A group's sketch is merged with its language's, and that with the one of all documents, each weighing as many documents.
PRIOR = 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def bucket(v: Column) -> Column:
    """Lower bound of the bucket of a non-negative whole number: its five leading binary digits, the rest zero."""
    s = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, s), s)


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the counts and ratios as further columns, and the names given to them (apart from any column of ``docs``).

    A null text has no words. Windows are compared by 64-bit hashes within one text.
    """
    own = docs.columns
    n = {k: hidden(docs, f"_{k}") for k in [*BASE, *RATIOS, "flat", "lines", "words", "grams", "pairs", "starts"]}
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumns({
        n["flat"]: flat(F.col(text)),
        n["lines"]: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        n["n_symbols"]: (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long")})
    d = d.withColumns({
        n["n_words"]: n_words(F.col(n["flat"])),
        n["words"]: F.split(F.col(n["flat"]), " ", -1),
        n["n_dup_lines"]: (F.size(n["lines"]) - F.size(F.array_distinct(n["lines"]))).cast("long")})
    w, c = F.col(n["words"]), F.col
    d = d.select(*own, *(n[k] for k in ("flat", "n_words", "n_symbols", "n_dup_lines")), F.size(n["lines"]).alias(n["lines"]),
                 F.when(c(n["n_words"]) > WINDOW, F.transform(
                     F.sequence(F.lit(0), c(n["n_words"]).cast("int") - WINDOW),
                     lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))).alias(n["grams"]))
    g = c(n["grams"])
    d = d.withColumn(n["pairs"], F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(
        F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    p = c(n["pairs"])
    d = d.withColumn(n["starts"], F.sort_array(F.transform(F.filter(
        p, lambda x, j: (F.get(p, j - 1)["h"] == x["h"]) | F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["i"])))
    covered = F.aggregate(
        c(n["starts"]), F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")), lambda a: a["n"])
    words = c(n["n_words"])
    d = d.withColumns({
        n["word_chars"]: (F.length(n["flat"]) - F.greatest(words - 1, F.lit(0))).cast("long"),
        n["n_repeat_words"]: F.coalesce(covered, F.lit(0)).cast("long")})
    per = F.greatest(words, F.lit(1))
    d = d.withColumns({
        n["chars_per_word"]: F.expr(f"({n['word_chars']} * 1000) div greatest({n['n_words']}, 1)"),
        n["symbols_per_word"]: F.expr(f"({n['n_symbols']} * 1000) div greatest({n['n_words']}, 1)"),
        n["dup_lines_share"]: F.expr(f"({n['n_dup_lines']} * 1000) div greatest({n['lines']}, 1)")})
    return d.select(*own, *(n[k] for k in [*BASE, *RATIOS])), {k: n[k] for k in [*BASE, *RATIOS]}


def base_failed(words: Column, repeats: Column) -> Column:
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def fences(rows: DataFrame) -> DataFrame:
    """Upper fences from ``rows(lang, source, <ratios>)``: one row per group, from its sketch merged with those of its language and of all.

    The others weigh little beside a large group and much beside a small one, so no number of documents turns a fence over. A null
    language or source is a group of its own.
    """
    ratio = F.explode(F.array(*(F.struct(F.lit(k).alias("ratio"), F.col(k).alias("v")) for k in RATIOS))).alias("r")
    sketch = saved(rows.select("lang", "source", ratio).groupBy("lang", "source", "r.ratio", bucket(F.col("r.v")).alias("b"))
                   .agg(F.count(F.lit(1)).alias("n")), "sketches")

    dec = "decimal(38,0)"
    big = lambda c: F.col(c).cast("decimal(18,0)")
    groups = sketch.select("lang", "source", "ratio").distinct()
    by_lang = sketch.groupBy("lang", "ratio", "b").agg(F.sum("n").alias("n"))
    every = sketch.groupBy("ratio", "b").agg(F.sum("n").alias("n"))
    totals = by_lang.groupBy(F.col("lang").alias("_l"), F.col("ratio").alias("_r")).agg(F.sum("n").alias("in_lang"))
    totals = totals.join(every.groupBy(F.col("ratio").alias("_a")).agg(F.sum("n").alias("in_all")), F.col("_r") == F.col("_a")).drop("_a")
    of = lambda d: d.join(totals, d["lang"].eqNullSafe(totals["_l"]) & (d["ratio"] == totals["_r"])).drop("_l", "_r")
    # weights in whole numbers: own + PRIOR * (language + PRIOR * all / all's documents) / (language's documents + PRIOR), times both divisors
    own = of(sketch).select("lang", "source", "ratio", "b", (big("n").cast(dec) * ((F.col("in_lang") + PRIOR) * F.col("in_all")).cast("decimal(19,0)")).cast(dec).alias("w"))
    g, lg, ev = groups.alias("g"), by_lang.alias("l"), every.alias("e")
    mid = of(g.join(lg, F.col("g.lang").eqNullSafe(F.col("l.lang")) & (F.col("g.ratio") == F.col("l.ratio"))).select("g.lang", "g.source", "g.ratio", "l.b", "l.n"))
    mid = mid.select("lang", "source", "ratio", "b", (F.lit(PRIOR) * big("n") * big("in_all")).cast(dec).alias("w"))
    far = g.join(ev, F.col("g.ratio") == F.col("e.ratio")).select("g.lang", "g.source", "g.ratio", "e.b", (F.lit(PRIOR * PRIOR) * F.col("e.n")).cast(dec).alias("w"))
    m = own.unionByName(mid).unionByName(far).groupBy("lang", "source", "ratio", "b").agg(F.sum("w").cast(dec).alias("w"))
    w = Window.partitionBy("lang", "source", "ratio")
    m = m.withColumns({"cum": F.sum("w").over(w.orderBy("b")).cast("decimal(37,0)"), "whole": F.sum("w").over(w).cast("decimal(37,0)")})
    x = m.groupBy("lang", "source", "ratio").agg(F.min(F.when(F.col("cum") * 4 >= F.col("whole"), F.col("b"))).alias("q1"),
                                                 F.min(F.when(F.col("cum") * 4 >= F.col("whole") * 3, F.col("b"))).alias("q3"))
    least = F.element_at(F.create_map(*(F.lit(v) for kv in RATIOS.items() for v in kv)), F.col("ratio"))
    fence = F.col("q3") + SPREADS * F.greatest(F.col("q3") - F.col("q1"), least)
    return x.groupBy("lang", "source").agg(*(F.max(F.when(F.col("ratio") == k, fence)).alias(f"max_{k}") for k in RATIOS))


def judged(docs: DataFrame, keep: list[str] | None = None, text: str = "text", lang: str = "lang",
           source: str = "source") -> tuple[DataFrame, dict[str, str]]:
    """Columns ``keep`` (all) of ``docs`` with counts, ratios, ``base_failed`` and ``kept``; and the names of the added columns.

    kept: the base rules hold and no ratio is over the fence of the document's language and source. The measured rows are
    written out once with the columns asked for, as both the sketches and the verdicts read them.
    """
    rows, n = measured(docs, text)
    keep = docs.columns if keep is None else keep
    rows = saved(rows.select(*dict.fromkeys([*keep, lang, source]), *n.values()), "measured")
    limits = fences(rows.select(F.col(lang).alias("lang"), F.col(source).alias("source"), *(F.col(n[k]).alias(k) for k in RATIOS)))
    lim = {c: hidden(rows, f"_{c}") for c in limits.columns}
    limits = limits.select(*(F.col(c).alias(lim[c]) for c in limits.columns))
    out = rows.join(limits, rows[lang].eqNullSafe(limits[lim["lang"]]) & rows[source].eqNullSafe(limits[lim["source"]]), "left")
    n |= {k: hidden(rows, f"_{k}") for k in ("base_failed", "kept")}
    out = out.withColumn(n["base_failed"], base_failed(F.col(n["n_words"]), F.col(n["n_repeat_words"])))
    over = F.lit(False)
    for k in RATIOS:
        over = over | F.coalesce(F.col(n[k]) > F.col(lim[f"max_{k}"]), F.lit(False))
    out = out.withColumn(n["kept"], ~F.col(n["base_failed"]) & ~over)
    return out.select(*keep, *n.values()), n
