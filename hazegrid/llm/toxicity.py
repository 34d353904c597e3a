"""Toxicity by a bag of subwords: embeddings averaged into a linear softmax, all trained together in numpy.

A text is the average of the embeddings of the character n-grams (three to six, with the blanks around words) of all its words; a
linear softmax gives the score. Embeddings and softmax are trained jointly on a bounded labelled sample. A misspelling shares most
of its n-grams with words seen in training and so most of their vectors. As both steps are linear, an n-gram's
share of the score is one number, and scoring is a table lookup and a mean over the whole text.

N-grams count by a power of their rarity, the bag is padded with empty n-grams so that a few words alone decide little, and training
stops after a few passes: gradient steps over blocks of mixed rows move first what agrees over many texts, before single texts are
learned by heart. A logistic step on scores of texts not trained on then sets the level.
"""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import letters
from .common import saved

BITS, SIZES = 16, range(3, 7)
#: Labelled documents per class that the model is fitted on, and the most n-gram entries taken of them.
SAMPLE, MAX_ENTRIES = 2000, 12_000_000
#: Entries of one gradient step; beside the sample itself only so many are held.
BLOCK = 1 << 18
DIM, EPOCHS, RATE, SOFT_RATE, MOMENTUM = 4, 5, 1000.0, 0.05, 0.9
#: An n-gram counts by its mean share to this negative power; empty n-grams that pad each bag.
RARITY, PAD = 0.4, 500
#: Share of class 1 for which 0.5 is the even score. Above its share among labels, as labels of class 1 are the rarer and noisier.
SHARE_OF_1 = 0.15


def bag(text: str | None) -> np.ndarray:
    return letters.grams(letters.codes(text), SIZES, BITS)


class Model:
    """``table``: an n-gram's share of the logit; ``bias``: the logit of an empty text."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def score(self, text: str | None) -> float:
        b = bag(text)
        z = self.bias + float(self.table[b].sum(dtype=np.float64)) / (len(b) + PAD)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _blocks(bags: list[tuple[np.ndarray, np.ndarray]]):
    """``(from, to, buckets, shares, rows)`` of a few bags after the other, about ``BLOCK`` entries each; rows count from ``from``."""
    n = np.array([len(b) for b, _ in bags])
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // BLOCK)) + 1
    for i, j in pairwise([0, *cuts.tolist(), len(bags)]):
        at, share = (np.concatenate([b[k] for b in bags[i:j]]).astype(kind) for k, kind in ((0, np.intp), (1, float)))
        yield i, j, at, share, np.repeat(np.arange(j - i), n[i:j])


def _embed(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Each n-gram's share of the logit, from gradient steps over blocks of shuffled rows; classes weigh the same."""
    order = np.random.default_rng(1).permutation(len(y))
    bags, y = [bags[i] for i in order], y[order]
    size, usual = 1 << BITS, np.zeros(1 << BITS)
    for _, _, at, share, _ in _blocks(bags):
        usual += np.bincount(at, share, size)
    usual /= len(y)
    scale = np.where(usual > 0, (usual + 1e-7) ** -RARITY, 0)
    scale /= max((usual * scale).sum(), 1e-12)
    even = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))[:, None]
    embed, soft, base = np.zeros((DIM, size)), np.random.default_rng(0).normal(0, 0.5, (DIM, 2)), np.zeros(2)
    speed = [np.zeros_like(x) for x in (embed, soft, base)]
    for _ in range(EPOCHS):
        for i, j, at, share, row in _blocks(bags):
            scaled = embed * scale
            doc = np.stack([np.bincount(row, share * e[at], j - i) for e in scaled], 1)
            z = doc @ soft + base
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(j - i), y[i:j]] -= 1
            q *= even[i:j] / (j - i)
            grams = np.stack([np.bincount(at, share * g[row], size) for g in (q @ soft.T).T])
            for v, x, g, rate in zip(speed, (embed, soft, base), (grams * scale, doc.T @ q, q.sum(axis=0)), (RATE, SOFT_RATE, SOFT_RATE)):
                v *= MOMENTUM
                v += g
                x -= rate * v
    return (soft[:, 1] - soft[:, 0]) @ embed * scale


def _averages(bags: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray) -> np.ndarray:
    return np.array([float(table[b] @ s) for b, s in bags])


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, share_of_1: float = SHARE_OF_1) -> Model:
    """The model of ``bags`` (a text's distinct buckets and the share of each in the padded bag) and their classes ``y``.

    The level is set on scores of texts that the scoring table was not trained on (two halves), with ``share_of_1`` as the
    share of class 1. With fewer than two rows of a class, all texts get a fixed score.
    """
    if not len(y) or min(y.sum(), len(y) - y.sum()) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0 if not len(y) else 3.0 if 2 * y.sum() > len(y) else -3.0)
    half = np.zeros(len(y), np.int64)
    for k in (0, 1):
        half[np.flatnonzero(y == k)[1::2]] = 1
    x = np.ones((len(y), 2))
    for h in (0, 1):
        out = np.flatnonzero(half == h)
        inside = np.flatnonzero(half != h)
        table = _embed([bags[i] for i in inside], y[inside])
        z = _averages([bags[i] for i in out], table)
        quiet = z[y[out] == 0]
        x[out, 0] = (z - quiet.mean()) / max(float(np.abs(table).max()), 1e-12)
    table = _embed(bags, y)
    quiet, unit = _averages([b for b, k in zip(bags, y) if k == 0], table).mean(), max(float(np.abs(table).max()), 1e-12)
    width = max(float(x[:, 0].std()), 1e-12)
    x[:, 0] /= width
    c, w = np.zeros(2), np.where(y == 1, share_of_1 / y.sum(), (1 - share_of_1) / (len(y) - y.sum()))
    for _ in range(50):  # Newton steps of a logistic regression, slightly damped
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        c += np.linalg.solve(x.T @ ((w * p * (1 - p))[:, None] * x) + 1e-4 * np.eye(2), x.T @ (w * (y - p)) - 1e-4 * c)
    k = c[0] / (width * unit)
    return Model((table * k).astype(np.float32), float(c[1] - quiet * k))


def fit(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents per class of those where ``learn`` (over the labels) is true, by a hash of ids.

    Whole texts are turned to n-gram shares on the executors and written; the driver reads those of the sample one partition after
    the other, at most ``MAX_ENTRIES`` entries of six bytes.
    """
    pool = labels.where(learn & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max((F.col(label) > 0).cast("int")).alias("_y")).withColumn("_h", F.xxhash64("_id"))
    pool = reduce(DataFrame.union, [pool.where(F.col("_y") == y).orderBy("_h", "_id").limit(sample) for y in (0, 1)])
    pool = pool.withColumn("_r", F.row_number().over(Window.partitionBy("_y").orderBy("_h", "_id"))).select("_id", "_y", "_r")
    rows = docs.select(F.col(id_col).alias("_d"), F.col(text).alias("_text")).join(F.broadcast(pool), F.col("_d") == F.col("_id"))

    def run(batches):
        for b in batches:
            got = [np.unique(bag(t), return_counts=True) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(x) for x, _ in got], pa.int64()), pa.array([x.astype("<u2").tobytes() for x, _ in got], pa.binary()),
                 pa.array([(c / (c.sum() + PAD)).astype("<f4").tobytes() for _, c in got], pa.binary())], ["y", "r", "n", "at", "share"])

    bags = saved(rows.select("_y", "_r", "_text").mapInArrow(run, "y int, r int, n long, at binary, share binary"), "bags")
    bags = bags.orderBy("r", "y", "n", F.xxhash64("at"))
    out, y, entries = [], [], 0
    for r in bags.toLocalIterator():
        if len(y) == 2 * sample or entries + r["n"] > MAX_ENTRIES:
            break
        entries += r["n"]
        out.append((np.frombuffer(r["at"], "<u2"), np.frombuffer(r["share"], "<f4")))
        y.append(r["y"])
    return train(out, np.array(y, np.int64))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *also, score, predicted)`` for each row; a null or empty text gets the score of an empty bag."""
    d = docs.select(F.col(id_col).alias("id"), *also, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])

    def run(batches):
        for b in batches:
            s = np.array([model.score(t) for t in b.column(b.num_columns - 1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             [*b.schema.names[:-1], "score", "predicted"])

    return d.mapInArrow(run, f"{kinds}, score double, predicted int")
