"""Word vectors learned from texts, and their means."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.functions import text
from hazegrid.operators import reports, word2vec


def cos(a, b):
    return a @ b / np.linalg.norm(a) / np.linalg.norm(b)


def vectors(d, size, passes=1, sizes=word2vec.Sizes()):
    words = d.select("report_id", text.spaced(text.normalize(F.col("texte"))).alias("w"))
    rows = (reports.embed(d, size, passes) if sizes == word2vec.Sizes() else word2vec.means(words, size, passes, sizes)).collect()
    assert len({r["report_id"] for r in rows}) == len(rows)
    return {r["report_id"]: np.array(r["embedding"]) for r in rows}


def frame(spark, texts, tasks=3):
    return spark.createDataFrame(list(enumerate(texts)), "report_id int, texte string").repartition(tasks, "report_id")


def topics(n):
    """Texts on smoke and on water; the two names of a topic never stand in one text, but among the same words."""
    rng, out = random.Random(1), []
    for i in range(n):
        names, others = (("incendie", "brasier"), ["fumée", "noire", "odeur", "gaz", "air"]) if i % 2 else (("fuite", "inondation"), ["eau", "pluie", "tuyau", "rue", "flaque"])
        some = [rng.choice(others) for _ in range(8)]
        out.append(" ".join([*some[:4], names[i // 2 % 2], *some[4:]]))
    return out


def test_words_used_alike_get_vectors_alike(spark):
    alone = ["incendie", "brasier", "fuite", "inondation"]
    v = vectors(frame(spark, alone + topics(1200), 1), 40, 8)
    assert cos(v[0], v[1]) > 0.8 and cos(v[2], v[3]) > 0.8
    assert max(cos(v[i], v[j]) for i in (0, 1) for j in (2, 3)) < 0.6
    fixed = [np.unpackbits(np.frombuffer(b"".join(hashlib.sha256(f"{i}:{w}".encode()).digest() for i in range(2)), np.uint8))[:40] * 2.0 - 1 for w in alone]
    assert cos(fixed[0], fixed[1]) < 0.5  # what the hashes of the words give


@pytest.mark.parametrize("sizes", [word2vec.Sizes(), word2vec.Sizes(40, 300, 7, 64)])  # the second: a text in many blocks, parts of few texts
def test_a_text_has_the_mean_of_its_words(spark, sizes):
    rng = random.Random(2)
    words = [f"mot{i}" for i in range(120)]
    texts = [" ".join(rng.choice(words[:rng.randrange(1, 121)]) for _ in range(rng.randrange(1, 60))) for _ in range(150)] + ["mot1 " * 5000, "rare", "", None, " \t "]
    v = vectors(frame(spark, texts + words), 24, 1, sizes)
    of = {w: v[len(texts) + i] for i, w in enumerate(words)}
    for i, t in enumerate(texts):
        some = [of.get(w, v[151]) for w in (t or "").split()]
        assert np.allclose(v[i], np.mean(some, axis=0) if some else 0, atol=1e-6), i
    assert all(x.any() for x in of.values()) and v[151].any() and len(v) == len(texts) + len(words)


def test_vectors_do_not_depend_on_the_number_of_shuffle_partitions(spark):
    d = frame(spark, topics(60) + [None])
    a, n = vectors(d, 20), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        b = vectors(d, 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert all((a[k] == b[k]).all() for k in a)


def test_ids_that_are_null_or_repeat_keep_their_rows(spark):
    d = spark.createDataFrame([(None, "gaz noir"), ("a", "gaz"), ("a", "gaz"), (None, None)], "report_id string, texte string")
    rows = reports.embed(d, 8).collect()
    assert sorted(map(str, (r["report_id"] for r in rows))) == ["None", "None", "a", "a"]
    assert len({tuple(r["embedding"]) for r in rows if r["report_id"] == "a"}) == 1
    assert reports.embed(d.where(F.lit(False)), 8).collect() == []


def test_a_word_that_fills_a_text_does_not_overshoot():
    at = np.r_[np.zeros(20000, np.int32), np.tile(np.array([1, 2], np.int32), 5000)]
    v = word2vec.train(at, np.zeros(len(at), np.int32), word2vec.first_vectors(["a", "b", "c"], 30), 2)
    assert np.isfinite(v).all() and np.abs(v).max() < 10


def test_steps_follow_the_gradient_of_the_pairs(monkeypatch):
    """The first steps against loops over pairs; nothing is drawn by chance but the windows and the words drawn against them, taken from the same generator."""
    monkeypatch.setattr(word2vec, "SPAN", 4)
    monkeypatch.setattr(word2vec, "SPANS", 1)
    at, of = np.array([0, 1, 2, 0, 3, 1, 2, 4, 0, 0, 3]), np.array([0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1])
    v, u = word2vec.first_vectors(list("abcde"), 12).astype(float), np.zeros((5, 12))
    got = word2vec.train(at, of, word2vec.first_vectors(list("abcde"), 12))
    rng, noise = np.random.default_rng(len(at)), np.cumsum(np.bincount(at) ** 0.75)
    for i in range(3):
        rate = word2vec.RATE * (1 - i / 3)
        reach = rng.integers(1, word2vec.WINDOW + 1, (1, 4))[0]
        drawn = np.searchsorted(noise, rng.random((1, word2vec.DRAWN))[0] * noise[-1], side="right")
        dv, du = np.zeros_like(v), np.zeros_like(u)
        for j in range(4 * i, min(len(at), 4 * i + 4)):
            near = [k for k in range(len(at)) if k != j and abs(k - j) <= reach[j - 4 * i] and of[k] == of[j]]
            for k, yes, w in [(at[k], 1, 1.0) for k in near] + [(k, 0, len(near) * word2vec.NEGATIVES / word2vec.DRAWN) for k in drawn]:
                g = w * (yes - 1 / (1 + np.exp(-v[at[j]] @ u[k])))
                dv[at[j]] += g * u[k]
                du[k] += g * v[at[j]]
        v, u = v + rate * dv, u + rate * du * 1.0
    assert np.allclose(got, v, rtol=1e-4, atol=1e-7)
