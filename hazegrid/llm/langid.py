"""Language by the nearest of several centroids per language.

A text is the vector of its character n-grams (two and three characters), weighted by (1 + log count) * idf and normalised. The
labelled sample of each language is clustered (spherical k-means), so that a language with several kinds of text has a centroid
for each. A text gets the language of the centroid of the greatest cosine, which is the score; texts further from it than almost
all of its training texts are marked as rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import letters

BITS, SIZES = 12, range(2, 4)
#: Labelled documents per language that the centroids are fitted on.
SAMPLE = 400
CENTROIDS = 4
ROUNDS = 12
#: A text is rejected if it is less similar to its centroid than this quantile of the training texts, less a margin.
REJECT_QUANTILE, REJECT_MARGIN = 0.01, 0.05


def counts(text: str | None) -> np.ndarray:
    return np.bincount(letters.grams(letters.codes(text), SIZES, BITS), minlength=1 << BITS).astype(np.int32)


def vectors(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised weights; the zero vector for texts without letters."""
    v = np.where(rows > 0, 1 + np.log(np.maximum(rows, 1)), 0).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def cluster(v: np.ndarray, k: int) -> np.ndarray:
    """Centroids of normalised rows; starts from rows far from each other, so it needs no random numbers."""
    at = [0]
    while len(at) < min(k, len(v)):
        at.append(int((v @ v[at].T).max(axis=1).argmin()))
    c = v[at]
    for _ in range(ROUNDS):
        near = (v @ c.T).argmax(axis=1)
        c = np.stack([v[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Model:
    def __init__(self, langs: list[str], rows: np.ndarray):
        self.idf = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1).astype(np.float32)
        v, langs = vectors(rows, self.idf), np.array(langs, object)
        self.lang, parts, self.least = [], [], []
        for name in sorted(set(langs)):
            mine = v[langs == name]
            c = cluster(mine, CENTROIDS)
            self.lang += [name] * len(c)
            parts.append(c)
            self.least += [float(np.quantile((mine @ c.T).max(axis=1), REJECT_QUANTILE)) - REJECT_MARGIN] * len(c)
        self.centroids = np.concatenate(parts) if parts else np.zeros((0, 1 << BITS), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection. ``und`` with score 0 for texts without letters, and if nothing was learned."""
        rows = np.stack([counts(t) for t in texts]) if texts else np.zeros((0, 1 << BITS), np.int32)
        if not self.lang:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cos = vectors(rows, self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(best)), best], 0, 1).astype(float)
        some = rows.any(axis=1)
        return ([self.lang[b] if s else "und" for b, s in zip(best, some)], np.where(some, score, 0.0),
                ~some | (score < np.array(self.least)[best]))


def fit(docs: DataFrame, learn, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents per language of those where ``learn`` is true, by a hash of their ids. Only their
    n-gram counts, of bounded size, leave the executors; texts are read whole."""
    pool = docs.where(learn & F.col(lang).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang).alias("lang"))
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = pool.withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample).select(F.col("id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    rows = docs.join(F.broadcast(ids), (docs[id_col] == ids["_id"]) & (docs[lang] == ids["_lang"]), "left_semi")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([counts(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["lang", "c"])

    got = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(run, "lang string, c binary").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    return Model([r[0] for r in got], np.stack([np.frombuffer(r[1], np.int32) for r in got]) if got else np.zeros((0, 1 << BITS), np.int32))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *also, lang_pred, score, rejected)`` for each row; only the text is looked at."""
    d = docs.select(F.col(id_col).alias("id"), *also, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for i in range(0, b.num_rows, 512):
                lang, score, rejected = model.predict(texts.slice(i, 512).to_pylist())
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)],
                                                 [*part.schema.names[:-1], "lang_pred", "score", "rejected"])

    return d.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")
