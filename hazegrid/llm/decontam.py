"""Benchmark decontamination by a prefix-filtered join of shingles.

An item's windows (10 consecutive words; all words of a shorter item) count where they occur word for word. The shingles of a
window are ordered by how often they occur in all documents. As the whole window must occur, its rarest shingle is the only one
that has to be looked up (a prefix of one). A match at position p fixes the window's place; it must fit the text's bounds, and
then the words are compared.

All texts are taken apart once: that pass counts a text's words and lets the shingles through whose hash falls into a slot that the
benchmark has. Slots are the remainders of the hashes by a fixed number, so what is broadcast is bounded whatever the benchmark's size;
a larger benchmark lets more foreign shingles through, which costs rows but no further pass. Joined with the benchmark's own shingles,
those few rows give rarity, prefixes and bounds, and only texts with a candidate are read again for the word-by-word check.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hidden, saved, thinned

WINDOW = 10
SHINGLE = 3
#: Shingle hashes are told apart by this many remainders before the join; as many longs are broadcast at most (some 100 MB).
SLOTS = 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def flat_words(text: Column) -> Column:
    """Words (runs of digits, a-z and anything beyond ASCII, after lower-casing A-Z only) joined by blanks; null has none."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def shingles(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles of a non-empty array of at least k words, by position."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))


def windows(bench: DataFrame, size: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """``(win, len, items)``: the distinct windows and the items that have them. Items without words give none."""
    w = bench.select(F.col(item).cast("string").alias("item"), flat_words(F.col(text)).alias("flat"))
    w = w.where("flat <> ''").select("item", F.split("flat", " ", -1).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    w = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("win"))
    return w.groupBy("win").agg(F.collect_set("item").alias("items")).withColumn("len", F.size("win"))


def scanned(docs: DataFrame, parts: DataFrame, keys: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(*keys, n_words)`` for each row of ``docs``, and ``(*keys, n_words, k, at, shingle)`` of its shingles that may be in ``parts(k, shingle)``."""
    sizes = sorted(r[0] for r in parts.select("k").distinct().collect())  # SHINGLE rows at most
    slot = F.coalesce(F.pmod(F.col("shingle"), F.lit(SLOTS)), F.lit(-1).cast("long"))
    slots = parts.select(slot.alias("slot")).union(parts.sparkSession.range(1).select(F.lit(-1).cast("long"))).distinct()
    words = docs.select(*keys, flat_words(F.col(text)).alias("flat")).select(*keys, F.when(F.col("flat") != "", F.split("flat", " ", -1)).alias("words"))
    words = words.withColumn("n_words", F.coalesce(F.size("words"), F.lit(0)))
    row = F.array(F.lit(None).cast("long"))  # stands for the row itself and comes first
    hashes = F.concat(row, *(F.when(F.col("n_words") >= k, shingles(F.col("words"), k)).otherwise(F.array().cast("array<long>")) for k in sizes))
    # *_outer: for the plain form the optimizer infers a filter on the hashes and computes it from the text for each shingle
    every = words.select(*keys, "n_words", F.posexplode_outer(hashes).alias("place", "shingle")).withColumn("slot", slot)
    few = saved(every.join(F.broadcast(slots), "slot").select(*keys, F.col("n_words").cast("long").alias("n_words"), "place", "shingle"), "scanned")
    before, k_of, at = F.lit(1), F.lit(0), F.lit(0)
    for k in sizes:  # the places of one size follow those of the smaller ones
        after = before + F.greatest(F.col("n_words") - k + 1, F.lit(0))
        mine = (F.col("place") >= before) & (F.col("place") < after)
        k_of, at, before = F.when(mine, k).otherwise(k_of), F.when(mine, (F.col("place") - before).cast("int")).otherwise(at), after
    own = few.where(F.col("place") == 0).select(*keys, "n_words")
    return own, few.where(F.col("place") > 0).select(*keys, "n_words", k_of.alias("k"), at.alias("at"), "shingle")


def hits(docs: DataFrame, wins: DataFrame, keys: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(*keys, n_words)`` of every row, and ``(*keys, start, stop, items)`` for each occurrence of a window in a text; rows with equal
    keys must have equal texts, and share their occurrences."""
    wins = saved(wins.withColumn("id", F.xxhash64("win")), "windows")
    k = F.least("len", F.lit(SHINGLE))
    of_size = [wins.where(k == n).select("id", "len", F.lit(n).alias("k"), F.posexplode(shingles(F.col("win"), n)).alias("offset", "shingle")) for n in range(1, SHINGLE + 1)]
    parts = of_size[0]
    for p in of_size[1:]:
        parts = parts.union(p)
    parts = saved(parts, "shingles")
    seen, m = scanned(docs, parts, keys, text)
    m = m.join(parts.select("k", "shingle").distinct(), ["k", "shingle"], "left_semi")
    count = m.groupBy("k", "shingle").agg(F.count(F.lit(1)).alias("n"))
    # a window with an unseen shingle cannot occur
    prefix = parts.join(count, ["k", "shingle"]).groupBy("id").agg(
        F.count(F.lit(1)).alias("present"), F.first("len").alias("len"), F.first("k").alias("k"), F.min(F.struct("n", "offset", "shingle")).alias("rarest"))
    prefix = prefix.where(F.col("present") == F.col("len") - F.col("k") + 1).select("id", "k", "rarest.offset", "rarest.shingle")
    prefix = prefix.join(wins, "id").select("k", "shingle", "offset", "win", "len", "items")
    start = F.col("at") - F.col("offset")
    c = m.join(prefix, ["k", "shingle"]).where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
    # a text has at most as many candidates as words and window lengths
    c = c.groupBy(*keys).agg(F.collect_set(F.struct(start.alias("start"), (start + F.col("len")).alias("stop"), "win", "items")).alias("candidates"))
    c = saved(c.select(*[F.col(x).alias(f"_{x}") for x in keys], "candidates"), "candidates")
    same = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in keys]
    few = thinned(docs.select(*keys, text), F.xxhash64(*keys), c, F.xxhash64(*(f"_{x}" for x in keys)))
    texts = few.join(c, same).select(*keys, F.split(flat_words(F.col(text)), " ", -1).alias("words"), "candidates")
    true = F.filter("candidates", lambda x: F.slice("words", x["start"] + 1, x["stop"] - x["start"]) == x["win"])
    return seen, texts.select(*keys, F.inline(true)).select(*keys, "start", "stop", "items")


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """``(id, mark, n_words, n_hit, n_items, items)`` for each row of ``docs``; ``mark`` is a hash of the text.

    Rows are told apart by id and text, so rows that share an id, or have none, keep their own results. Items without an id
    hit words but are not listed. Without benchmark items nothing is hit.
    """
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.col(text).alias("text"))
    seen, spans = hits(d, windows(bench, size, item, item_text), ["id", "mark"])
    per = spans.groupBy("id", "mark").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, s: F.struct(
        F.greatest(a["end"], s["stop"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["end"], s["start"]))).alias("n")), lambda a: a["n"])
    per = per.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), n_hit.cast("long").alias("n_hit"), "items")
    out = seen.select("id", "mark", "n_words").join(per, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("id", "mark", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.size(items).cast("long").alias("n_items"), items.alias("items"))


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    a, b = hidden(docs, "_hit_id"), hidden(docs, "_hit_mark")
    _, spans = hits(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.col(text).alias("text")),
                 windows(bench, **how), ["id", "mark"])
    bad = spans.select(F.col("id").alias(a), F.col("mark").alias(b)).distinct()
    mark = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(bad, docs[id_col].eqNullSafe(bad[a]) & (mark == bad[b]), "left_anti")
