"""Joins by similarity: names by their trigrams, and vectors by cosine."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut, spread


# ---- names

#: Names of one side that meet under one trigram in one group of a task.
BLOCK = 2_000


def _blocks(prefix: DataFrame, heavy: DataFrame, mine: str, other: str) -> DataFrame:
    """Rows of one side under ``(gram, lc, rc)``: a row stands in one block of its own side, beside each block of the other one."""
    d = prefix.join(F.broadcast(heavy), "gram", "left")
    of = {c: F.coalesce(c, F.lit(1).cast("long")) for c in ("nl", "nr")}
    d = d.withColumns({f"{mine}c": F.pmod(F.xxhash64("name"), of[f"n{mine}"]), f"{other}c": F.explode(F.sequence(F.lit(0).cast("long"), of[f"n{other}"] - 1))})
    return spread(d.drop("nl", "nr"), "gram", "lc", "rc")


def name_pairs(left: DataFrame, right: DataFrame, limit: float = 0.3) -> DataFrame:
    """``(left_name, right_name, similarity)`` of all pairs of distinct names of ``left(name)`` and ``right(name)`` whose trigram
    similarity is above ``limit`` (greater than 0).

    Trigrams that both tables have are ordered by rarity. Sets of sizes n and m that are similar enough share more than
    ``limit / (1 + limit) * (n + m)`` of them, so the first one they share stands so far in front on both sides that as many are left from it on
    (prefix filter, with the least m there is; sizes differ at most by the factor ``limit``). Names meet under the trigrams of their prefixes
    and are compared there at once: first by what is left behind, then by 64 bits of each set, which bound the shared ones, then in full.
    A pair comes from its first shared trigram only, so candidates are neither written nor gathered; a trigram that many names
    have is cut into blocks of both sides. Names without a letter or digit are similar to none.
    """
    both = left.select("name", F.lit(0).alias("side")).union(right.select("name", F.lit(1).alias("side"))).where(F.col("name").isNotNull()).distinct()
    g = both.select("name", "side", text.trigrams(F.col("name")).alias("grams")).where(F.size("grams") > 0)
    g = cut(g.withColumn("id", F.monotonically_increasing_id()))
    one = g.select("id", F.explode("grams").alias("gram"), "side")
    known = one.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.min("side").alias("a"), F.max("side").alias("b")).where("a < b")
    known = cut(known.orderBy("df", "gram").select("gram", F.monotonically_increasing_id().alias("rank")))
    sets = one.join(known, "gram").groupBy("id").agg(F.sort_array(F.collect_list("rank")).alias("x"))
    sets = g.select("id", "name", "side", F.size("grams").alias("n")).join(sets, "id").drop("id")
    bits = F.expr("aggregate(x, 0L, (a, v) -> a | shiftleft(1L, cast(pmod(xxhash64(v), 64L) as int)))")
    sets = cut(sets.withColumn("bits", bits))

    share = limit / (1 + limit)
    smallest = sets.groupBy((1 - F.col("side")).alias("side")).agg(F.min("n").alias("m"))
    least = F.ceil(share * (F.col("n") + F.greatest(F.col("m"), F.ceil(F.col("n") * limit - 1e-9))) - 1e-9)
    rest = F.size("x") - F.greatest(least, F.lit(1)) + 1
    prefix = sets.join(smallest, "side").withColumn("_to", rest.cast("int")).where("_to > 0")
    prefix = prefix.select("name", "side", "n", "x", "bits", F.posexplode(F.slice("x", 1, F.col("_to"))).alias("pos", "gram"))
    heavy = prefix.groupBy("gram").agg(*[F.ceil(F.count_if(F.col("side") == i) / BLOCK).alias(c) for i, c in enumerate(("nl", "nr"))]).where("least(nl, nr) > 0 and greatest(nl, nr) > 1")
    a, b = (_blocks(prefix.where(F.col("side") == i).drop("side"), heavy, *sides) for i, sides in enumerate((("l", "r"), ("r", "l"))))
    a = a.select("gram", "lc", "rc", F.col("name").alias("left_name"), "n", F.col("pos").alias("i"), "x", F.col("bits").alias("p"))
    b = b.select("gram", "lc", "rc", F.col("name").alias("right_name"), F.col("n").alias("m"), F.col("pos").alias("j"), F.col("x").alias("y"), F.col("bits").alias("q"))

    n, m, p, q = (F.col(c) for c in "nmpq")
    need = share * (n + m) - 1e-9
    may = ((m >= limit * n - 1e-9) & (n >= limit * m - 1e-9) & (F.size("x") - F.col("i") >= need) & (F.size("y") - F.col("j") >= need)
           & (F.size("x") - F.bit_count(p.bitwiseAND(F.bitwise_not(q))) >= need) & (F.size("y") - F.bit_count(q.bitwiseAND(F.bitwise_not(p))) >= need))
    both_have = F.array_intersect("x", "y")
    shared = F.size(both_have)
    s = shared / (n + m - shared)
    d = a.join(b, ["gram", "lc", "rc"]).where(F.when(may, (F.get(both_have, F.lit(0)) == F.col("gram")) & (s > limit)).otherwise(False))
    return d.select("left_name", "right_name", s.alias("similarity"))


# ---- vectors

def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centroids(vectors: DataFrame, vec: str, cells: int, sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Directions of ``cells`` clusters, fitted on at most ``sample`` vectors (those with the smallest hash)."""
    rows = vectors.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v")).orderBy(F.xxhash64("v"), "v").limit(sample)
    x = _unit(np.array([r["v"] for r in rows.collect()], float))
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        for k in range(len(c)):
            if (at == k).any():
                c[k] = x[at == k].mean(axis=0)
        c = _unit(c)
    return c


class VectorIndex:
    """Inverted lists of vectors by nearest direction, for the ``k`` most similar vectors of many queries at once.

    ``search`` first looks into the ``probes`` nearest lists of each query. That is an answer of high recall; ``exact`` also looks
    into every further list that can still hold a better vector: a list's widest angle bounds the similarity of all its members.
    """

    #: Vectors and queries that one task compares.
    PART, ASKED = 20_000, 5_000

    def __init__(self, vectors: DataFrame, id_col: str, vec: str, cells: int = 64):
        self.dirs = centroids(vectors, vec, cells)
        kind = vectors.schema[id_col].dataType.simpleString()
        dirs = self.dirs

        def run(batches):
            for b in batches:
                v = np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1)
                s = _unit(v) @ dirs.T
                at = s.argmax(axis=1)
                angle = np.arccos(np.clip(s[np.arange(len(at)), at], -1, 1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32)), pa.array(angle)], ["id", "v", "cell", "angle"])

        rows = vectors.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
        self.lists = cut(rows.mapInArrow(run, f"id {kind}, v array<double>, cell int, angle double"))
        per = self.lists.groupBy("cell").agg(F.max("angle").alias("w"), F.count(F.lit(1)).alias("n")).collect()  # one row per cell
        self.width, self.size = {r["cell"]: r["w"] for r in per}, {r["cell"]: r["n"] for r in per}
        self.kind = kind

    def _ask(self, wanted: DataFrame, k: int) -> DataFrame:
        """The best ``k`` of each wanted (query, list) by parts of lists and of queries, both of bounded size."""
        def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if q.empty or v.empty:
                return pd.DataFrame(columns=["query", "id", "similarity"])
            v = v.sort_values("id")
            ids, x, out = v["id"].to_numpy(), _unit(np.vstack(v["v"])), []
            for i in range(0, len(q), 256):
                part = q.iloc[i:i + 256]
                s = _unit(np.vstack(part["q"])) @ x.T
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]  # equal similarity: the smaller id
                out.append(pd.DataFrame({"query": np.repeat(part["query"].to_numpy(), best.shape[1]), "id": ids[best].ravel(), "similarity": np.take_along_axis(s, best, 1).ravel()}))
            return pd.concat(out)

        asked = {r["cell"]: r["count"] for r in wanted.groupBy("cell").count().collect()}  # one row per cell
        parts = lambda counts, at_once: F.try_element_at(F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, -(-n // at_once))]), F.col("cell"))
        if not asked or not self.size:
            return self.lists.where("false").select(F.col("id").alias("query"), "id", F.lit(0.0).alias("similarity"))
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        w = wanted.withColumn("qpart", F.pmod(F.xxhash64("query"), parts(asked, self.ASKED)).cast("int")).withColumn("vpart", every(parts(self.size, self.PART)))
        v = self.lists.withColumn("vpart", F.pmod(F.xxhash64("id"), parts(self.size, self.PART)).cast("int")).withColumn("qpart", every(parts(asked, self.ASKED)))
        by = ["cell", "qpart", "vpart"]
        return w.groupBy(*by).cogroup(v.groupBy(*by)).applyInPandas(run, f"query {self.kind}, id {self.kind}, similarity double")

    @staticmethod
    def _top(found: DataFrame, k: int) -> DataFrame:
        best = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("s"), "id"))), 1, k).alias("r"))
        return best.select("query", F.posexplode("r").alias("rank", "x")).select("query", (F.col("rank") + 1).alias("rank"), "x.id", (-F.col("x.s")).alias("similarity"))

    def search(self, queries: DataFrame, id_col: str, vec: str, k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
        """``(query, rank, id, similarity)``; of equally similar vectors the smaller id comes first."""
        dirs, width = self.dirs, self.width
        cells = np.array(sorted(width))
        widths = np.array([width[c] for c in cells])

        def nearest(batches):
            for b in batches:
                v = np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1)
                a = np.arccos(np.clip(_unit(v) @ dirs[cells].T, -1, 1))
                order = np.argsort(a, axis=1, kind="stable")
                best_case = np.cos(np.maximum(a - widths[None, :], 0.0)) + 1e-9
                n = len(cells)
                row = np.repeat(np.arange(b.num_rows), n)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(cells[order].ravel().astype(np.int32)),
                                                  pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows)), pa.array(np.take_along_axis(best_case, order, 1).ravel())],
                                                 ["query", "q", "cell", "nth", "bound"])

        q = queries.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("query"), F.col(vec).cast("array<double>").alias("q"))
        ways = cut(spread(q, "query").mapInArrow(nearest, f"query {self.kind}, q array<double>, cell int, nth int, bound double"))
        found = cut(self._top(self._ask(ways.where(F.col("nth") < probes).select("query", "q", "cell"), k), k))
        if not exact:
            return found
        worst = found.groupBy("query").agg(F.min("similarity").alias("worst"), F.count(F.lit(1)).alias("n"))
        more = ways.where(F.col("nth") >= probes).join(worst, "query", "left").where(F.col("worst").isNull() | (F.col("n") < k) | (F.col("bound") >= F.col("worst")))
        rest = self._ask(more.select("query", "q", "cell"), k)
        return self._top(found.select("query", "id", "similarity").union(rest.select("query", "id", "similarity")), k)
