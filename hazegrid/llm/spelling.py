"""Spelling variants: near words by tries whose levels are walked as joins.

The words of the lexicon hang in two tries, one of the words and one of the words read backwards. Edges are a table: an *inner* edge
leads from a node (a prefix of at least two words) by one character to another such node; a *leaf* edge carries the whole rest of the
single word below it, empty if the word ends at the node. A frontier of states (word, position, node, edits) is joined with the edges of
one level after the other. A state without edits goes on along its own path, or uses its one edit: a character replaced by a larger
one, or a character of the word deleted. A state with an edit goes on only where characters agree. At a leaf edge the two rests are
compared, and a state that ends with one edit names a neighbour. Insertions and smaller replacements are the same pairs seen from the
other word, so each pair is found from one side and then turned round.

The edit lies in the second half of the word, or in the second half of the word read backwards. So each word enters the frontier of
either trie at the node of its first half, and never branches at the shallow levels, where few nodes have all words below them.

The walk takes as many rounds as the longest prefix or ending that two words share. A node has at most as many edges as the alphabet has
letters, so one word's states cannot multiply beyond that; nodes with very many words are split by the join.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: One in so many (document, word) pairs loses a character.
DAMAGE = 199
#: Distinct words a task counts before it hands them on.
AT_ONCE = 200_000
RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def damaged(word: str, doc_id: int | str | None, every: int = DAMAGE) -> str:
    """``word`` of a document, without one of its code points if the CRC-32 of ``<doc_id>:<word>`` says so; never without an id."""
    if doc_id is None or not every:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % every:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1:]


def lexicon(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
            every: int = DAMAGE) -> DataFrame:
    """``(word, n)``: the words of all whole texts with at least ``min_length`` code points and ``min_count`` occurrences.

    Words are maximal runs of Latin letters, A-Z lower-cased. Null and empty texts have none; rows without an id keep their words as they are.
    """
    runs = re.compile(RUNS.pattern[:-1] + f"{{{min_length},}}")  # a shorter run cannot become long enough

    def run(batches):
        known: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array(list(known.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                if not t:
                    continue
                words = Counter(runs.findall(t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                if every and i is not None:
                    head = zlib.crc32(f"{i}:".encode())
                    for w in [w for w in words if zlib.crc32(w.encode(), head) % every == 0]:
                        n, cut = words.pop(w), damaged(w, i, every)
                        if len(cut) >= min_length:
                            known[cut] += n
                known.update(words)
                if len(known) >= AT_ONCE:
                    yield out()
                    known.clear()
        if known:
            yield out()

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def sides(words: DataFrame) -> DataFrame:
    """``(word, path, half)``: each word forwards, marked ``>``, and backwards, marked ``<``, and the level at which it enters that trie.

    An edit before the middle of a word lies at or behind ``half`` in the word read backwards.
    """
    n = F.length("word")
    half = F.floor(n / 2).cast("int")
    side = F.array(F.struct(F.concat(F.lit(">"), F.col("word")).alias("path"), half.alias("half")),
                   F.struct(F.concat(F.lit("<"), F.reverse("word")).alias("path"), (n - half).cast("int").alias("half")))
    return words.select("word", F.inline(side))


def edges(paths: DataFrame) -> DataFrame:
    """Both tries of ``paths(word, path, half)``: ``(level, node, label, child, leaf)``; ``child`` is a node's prefix, or a leaf's word.

    A word has edges from the level at which it enters on: words within one edit enter no later than one another's first edit.
    """
    steps = paths.select("word", "path", F.explode(F.sequence("half", F.length("path") - 1)).alias("level"))
    steps = steps.select("word", "path", "level", F.left("path", F.col("level") + 1).alias("node"), F.substring("path", F.col("level") + 2, F.lit(1)).alias("c"))
    e = steps.groupBy("level", "node", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "word")).alias("w"))
    below = e.groupBy("level", "node").agg(F.sum("n").alias("words")).where("words > 1")  # other nodes lie under a leaf edge
    e = e.join(below, ["level", "node"])
    leaf = F.col("n") == 1
    return e.select("level", "node", F.when(leaf, F.substring("w.path", F.col("level") + 2, F.length("w.path"))).otherwise(F.col("c")).alias("label"),
                    F.when(leaf, F.col("w.word")).otherwise(F.concat("node", "c")).alias("child"), leaf.alias("leaf"))


def _one_edit(rest: Column, label: Column) -> Column:
    """``label`` comes from ``rest`` by one replaced or one deleted character."""
    gap = F.length(rest) - F.length(label)
    return gap.between(0, 1) & (F.levenshtein(rest, label, 1) == 1)


def step(frontier: DataFrame, level_edges: DataFrame) -> DataFrame:
    """One level: the states after it and the words reached, as ``(word, rest, node, edits, near)``; ``near`` is null for states.

    ``rest`` is what is left of the path behind the state's position.
    """
    j = frontier.join(level_edges, "node")
    rest, label, fresh, leaf = F.col("rest"), F.col("label"), F.col("edits") == 0, F.col("leaf")
    c, d = F.left(rest, F.lit(1)), F.substring(rest, 2, 1)
    goes = F.when(leaf, F.when(fresh, _one_edit(rest, label)).otherwise(rest == label)).otherwise(
        (label == c) | (fresh & (((c != "") & (label > c)) | ((label == d) & (c != d)))))
    j = j.where(goes)
    state = F.struct(F.substring(rest, 2, 1 << 30).alias("rest"), F.when(label == c, F.col("edits")).otherwise(1).alias("edits"))
    cut = F.struct(F.substring(rest, 3, 1 << 30).alias("rest"), F.lit(1).alias("edits"))
    replaced = (label == c) | (fresh & (c != "") & (label > c))
    deleted = fresh & (label == d) & (c != d)
    states = F.when(leaf, F.array(state)).when(replaced & deleted, F.array(state, cut)).when(deleted, F.array(cut)).otherwise(F.array(state))
    j = j.select("word", "child", "leaf", F.inline(states))
    return j.select("word", "rest", F.when(~F.col("leaf"), F.col("child")).alias("node"), "edits", F.when(F.col("leaf"), F.col("child")).alias("near"))


def neighbours(words: DataFrame) -> DataFrame:
    """``(word, near)``: all pairs of ``words(word)`` that differ by exactly one inserted, deleted or replaced code point, both ways round."""
    paths = saved(sides(words.select("word").distinct()), "paths")
    trie = saved(edges(paths), "trie")
    levels = trie.agg(F.min("level"), F.max("level")).first()
    enter = paths.select("word", F.substring("path", F.col("half") + 2, F.length("path")).alias("rest"), F.left("path", F.col("half") + 1).alias("node"),
                         F.lit(0).alias("edits"), "half")
    found, frontier = [], None
    for level in range(levels[0] or 0, -1 if levels[1] is None else levels[1] + 1):
        here = enter.where(F.col("half") == level).drop("half")
        frontier = here if frontier is None else frontier.union(here)
        both = saved(step(frontier, trie.where(F.col("level") == level).select("node", "label", "child", "leaf")), "frontier")
        found.append(both.where("near IS NOT NULL").select("word", "near"))
        frontier = both.where("near IS NULL").select("word", "rest", "node", "edits")
    if not found:
        return words.where("false").select("word", F.col("word").alias("near"))
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.union(f)
    return pairs.select(F.inline(F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"))))).distinct()


def roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(word, root)``: from each word of ``forms(word, form)``, where ``form`` may be null, to the last; paths are doubled each round."""
    up = saved(forms.select("word", F.coalesce("form", "word").alias("root")), "forms")
    for _ in range(max_rounds):
        # only words that are another's form are looked up, and they have one row each
        far = up.alias("a").join(up.where("word <> root").alias("b"), F.col("a.root") == F.col("b.word"), "left")
        up, before = saved(far.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "forms"), up
        if up.where("moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")
    raise RuntimeError(f"forms did not settle in {max_rounds} rounds")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, n, form, form_n, root, n_near)`` for ``words(word, n)``, one row per word.

    A word's form is its near word of largest n, of equally large ones the smallest in code-point order, if that n is at least
    ``ratio`` times the word's own. Each step multiplies n, so forms never run in circles.
    """
    words = saved(words.select("word", "n"), "words")
    near = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("b"))
    w = words.join(best, "word", "left")
    to = F.when(-F.col("b.m") >= ratio * F.col("n"), F.col("b.near"))
    w = saved(w.select("word", "n", to.alias("form"), F.when(to.isNotNull(), -F.col("b.m")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")),
              "variants")
    return w.join(roots(w), "word").select("word", "n", "form", "form_n", "root", "n_near")
