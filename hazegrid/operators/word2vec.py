"""Word2Vec (skip-gram with negative sampling) over texts of any number, and the mean vector of each text.

Texts are trained in blocks with a bounded number of distinct words, side by side, all from the same start, and a word's vector is the mean over the
blocks that it occurs in, weighted by its occurrences: what a data-parallel Word2Vec does with its partitions. Every word of every text is
trained and counted, however rare. The vectors of the words meet in a shuffle by word and go back to the texts in a shuffle by part (some
thousand texts), so neither the driver nor a task holds the vocabulary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Words to the left and right at most, words drawn against each pair, and first learning rate.
WINDOW, NEGATIVES, RATE = 5, 5, 0.025
#: A step trains ``SPANS`` spans of ``SPAN`` words; each span draws ``DRAWN`` words, which share the weight of the words drawn against its pairs.
SPAN, SPANS, DRAWN = 48, 10, 16
#: Above this weight of pairs in a step, a word's row moves by their mean instead of their sum (a word that fills a text would overshoot).
PAIRS = 128.0
#: Rows of a batch.
ROWS = 2048
DOC, VECTOR, PLACES = 0, 1, 2


class Sizes(NamedTuple):
    """A block is trained when it has so many distinct words or so many words, a part has so many texts, and so many characters are cut into words at once."""

    distinct: int = 1 << 17
    words: int = 1 << 21
    texts: int = 1 << 15
    piece: int = 1 << 15


def first_vectors(words: list[str], size: int) -> np.ndarray:
    """Where the training of words begins, the same in every block: components of one size, their signs by the bits of two SHA-256 digests."""
    raw = b"".join(hashlib.sha256(f"{i}:{w}".encode("utf-8", "surrogatepass")).digest() for w in words for i in range(2))
    out = np.empty((len(words), size), np.float32)
    for i in range(0, len(words), ROWS):
        bits = np.unpackbits(np.frombuffer(raw[64 * i:64 * (i + ROWS)], np.uint8).reshape(-1, 64), axis=1)[:, :size]
        out[i:i + ROWS] = (bits - np.float32(0.5)) / (size * 3 ** 0.5)
    return out


def _add(table: np.ndarray, at: np.ndarray, change: np.ndarray, pairs: np.ndarray, rate: float) -> None:
    """Adds to each row the changes of all places that name it."""
    at = at.ravel()
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    change, times = change.reshape(-1, table.shape[1])[order], np.diff(np.r_[first, len(at)])
    if times.max() > 64:
        total = np.add.reduceat(change, first, axis=0)
    else:  # the same sums, quicker where most rows are named once
        total = change[first]
        for k in range(1, times.max()):
            more = np.flatnonzero(times > k)
            total[more] += change[first[more] + k]
    much = np.add.reduceat(pairs.ravel()[order], first)
    table[at[first]] += total * (rate / np.maximum(1, much / PAIRS))[:, None].astype(np.float32)


def train(at: np.ndarray, text: np.ndarray, v: np.ndarray, passes: int = 1) -> np.ndarray:
    """Trains the rows ``v`` of the words ``at`` (row numbers in reading order) of the texts ``text``; windows end with a text."""
    n, size = len(at), v.shape[1]
    u, rng = np.zeros_like(v), np.random.default_rng(n)
    noise = np.cumsum(np.bincount(at, minlength=len(v)) ** 0.75)
    spans = -(-n // SPAN)
    ids, texts = np.zeros(spans * SPAN + 2 * WINDOW, np.int64), np.full(spans * SPAN + 2 * WINDOW, -1, np.int64)
    ids[WINDOW:WINDOW + n], texts[WINDOW:WINDOW + n] = at, text
    wide = SPAN + 2 * WINDOW
    off = np.abs(np.arange(wide) - WINDOW - np.arange(SPAN)[:, None])
    for p in range(passes):
        for i in range(0, spans, SPANS):
            rate = RATE * max(1e-4, 1 - (p * spans + i) / (passes * spans))
            start = np.arange(i, min(spans, i + SPANS))[:, None] * SPAN
            mid, around = start + WINDOW + np.arange(SPAN), start + np.arange(wide)
            reach = np.where(off > 0, off, WINDOW + 1) <= rng.integers(1, WINDOW + 1, mid.shape)[:, :, None]
            pair = reach & (texts[mid][:, :, None] == texts[around][:, None, :]) & (texts[mid] >= 0)[:, :, None]
            number = pair.sum(axis=2)
            drawn = np.searchsorted(noise, rng.random((len(start), DRAWN)) * noise[-1], side="right")
            there = np.concatenate([ids[around], np.minimum(drawn, len(v) - 1)], axis=1)
            x, y = v[ids[mid]], u[there]
            s = 1 / (1 + np.exp(-np.clip(x @ y.transpose(0, 2, 1), -30, 30)))
            weight = np.concatenate([pair, np.broadcast_to((number * (NEGATIVES / DRAWN))[:, :, None], (*number.shape, DRAWN))], axis=2).astype(np.float32)
            s[:, :, :wide] -= 1
            g = -s * weight
            _add(v, ids[mid], g @ y, weight.sum(axis=2), rate)
            _add(u, there, g.transpose(0, 2, 1) @ x, weight.sum(axis=1), rate)
    return v


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Pieces of the bytes of ``values`` that end at ``ends`` (in bytes)."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


class _Block:
    """Words and texts of a part that are trained together."""

    def __init__(self):
        self.at, self.words, self.texts, self.n = {}, [], [], 0

    def add(self, words: list[str], text: int) -> None:
        at = self.at
        self.words.append(np.fromiter((at.setdefault(w, len(at)) for w in words), np.int32, len(words)))
        self.texts.append(np.full(len(words), text, np.int32))
        self.n += len(words)

    def full(self, sizes: Sizes) -> bool:
        return len(self.at) >= sizes.distinct or self.n >= sizes.words

    def trained(self, part: int, block: int, size: int, passes: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """For each word a row with its vector (16-bit floats) and its occurrences, and one with its texts and how often it occurs in each."""
        if not self.n:
            return
        at, text, names = np.concatenate(self.words), np.concatenate(self.texts), list(self.at)
        self.__init__()
        v = train(at, text, first_vectors(names, size), passes).astype(np.float16)
        n = np.bincount(at, minlength=len(names))
        place, times = np.unique(at.astype(np.int64) << 32 | text, return_counts=True)
        ends = np.searchsorted(place, np.arange(1, len(names) + 1, dtype=np.int64) << 32)
        places = np.stack([place & 0xFFFFFFFF, times], axis=1).astype(np.int32)
        for i in range(0, len(names), ROWS):
            j = min(len(names), i + ROWS)
            some, begin = pa.array(names[i:j], pa.string()), ends[i - 1] if i else 0
            for what, data in ((VECTOR, _binary(v[i:j], np.arange(1, j - i + 1) * 2 * size)), (PLACES, _binary(places[begin:ends[j - 1]], (ends[i:j] - begin) * 8))):
                yield _rows([what] * (j - i), some, [part] * (j - i), [block] * (j - i), n[i:j], data, pa.nulls(j - i, kind))


def _rows(what, word, part, at, n, data, report) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(what, pa.int32()), word, pa.array(part, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int64()), data, report],
                                      ["kind", "word", "part", "at", "n", "data", "report_id"])


def learned(batches, size: int, passes: int = 1, sizes: Sizes = Sizes()):
    """Rows of the texts (number ``at`` within their part, ``n`` words) and of their words, from batches ``(id, words joined by blanks)``."""
    part, block, texts, now = TaskContext.get().partitionId() << 24, 0, 0, _Block()
    kind = None
    for b in batches:
        kind, done, counts = b.column(0).type, 0, []

        def ended():
            """The texts since the last call."""
            m = len(counts)
            out = _rows([DOC] * m, pa.nulls(m, pa.string()), [part] * m, range(texts - m, texts), counts, pa.nulls(m, pa.binary()), b.column(0).slice(done, m))
            return out, done + m

        for line in b.column(1):
            line, n, start = line.as_py() or "", 0, 0
            while start < len(line):
                stop = line.find(" ", start + sizes.piece)
                stop = len(line) if stop < 0 else stop
                words = [w for w in line[start:stop].split(" ") if w]
                start, n = stop + 1, n + len(words)
                now.add(words, texts)
                if now.full(sizes):
                    yield from now.trained(part, block, size, passes, kind)
                    block += 1
            texts += 1
            counts.append(n)
            if texts == sizes.texts:
                out, done = ended()
                yield out
                yield from now.trained(part, block, size, passes, kind)
                part, block, texts, counts = part + 1, 0, 0, []
        if counts:
            yield ended()[0]
    yield from now.trained(part, block, size, passes, kind)


def averaged(batches, size: int):
    """Rows of words, each word's vectors before its places, to rows of places with the mean vector; rows of texts as they are."""
    word, total, weight = None, np.zeros(size), 0
    for b in batches:
        kind, n, names, places = b.column(0).to_numpy(), b.column(4).to_numpy(), b.column(1).to_pylist(), np.flatnonzero(b.column(0).to_numpy() != VECTOR)
        at = np.flatnonzero(kind == VECTOR)
        means: dict = {word: (total / max(1, weight)).astype(np.float16).tobytes()}
        if len(at):
            v = np.frombuffer(b"".join(b.column(5).take(pa.array(at)).to_pylist()), np.float16).reshape(-1, size).astype(np.float64) * n[at, None]
            first = np.flatnonzero([not i or names[at[i]] != names[at[i - 1]] for i in range(len(at))])
            totals, weights = np.add.reduceat(v, first, axis=0), np.add.reduceat(n[at], first)
            if names[at[0]] == word:  # begun in an earlier batch
                totals[0] += total
                weights[0] += weight
            word, total, weight = names[at[-1]], totals[-1], weights[-1]
            for i, mean in zip(first, (totals / weights[:, None]).astype(np.float16)):
                means[names[at[i]]] = mean.tobytes()
        if len(places):
            vectors = pa.array([means[names[i]] if kind[i] == PLACES else None for i in places], pa.binary())
            b = b.take(pa.array(places))
            yield pa.RecordBatch.from_arrays([b.column(j) for j in (0, 2, 3, 4, 5, 6)] + [vectors], ["kind", "part", "at", "n", "data", "report_id", "vector"])


def summed(batches, size: int):
    """The mean vector of each text, from rows of a part's texts and then of its words."""
    part, sums, n, ids = None, None, [], []

    def ended():
        every, many = pa.concat_arrays(ids), np.concatenate(n)
        for i in range(0, len(many), ROWS):
            mean = (sums[i:i + ROWS] / np.maximum(1, many[i:i + ROWS])[:, None]).ravel()
            m = len(mean) // size
            yield pa.RecordBatch.from_arrays([every.slice(i, m), pa.ListArray.from_arrays(pa.array(np.arange(0, (m + 1) * size, size, dtype=np.int32)), pa.array(mean))],
                                             ["report_id", "embedding"])

    for b in batches:
        parts, start = b.column(1).to_numpy(), 0
        kinds = b.column(0).to_numpy()
        for key, rows in groupby(zip(parts.tolist(), kinds.tolist())):
            stop = start + sum(1 for _ in rows)
            some, start = b.slice(start, stop - start), stop
            if key[0] != part:
                if part is not None:
                    yield from ended()
                part, sums, n, ids = key[0], None, [], []
            if key[1] == DOC:
                n.append(some.column(3).to_numpy())
                ids.append(some.column(5))
                continue
            if sums is None:
                sums = np.zeros((sum(map(len, n)), size))
            for i in range(0, some.num_rows, 256):
                _sum(sums, some.slice(i, 256), size)
        del b
    if part is not None:
        sums = np.zeros((sum(map(len, n)), size)) if sums is None else sums
        yield from ended()


def _sum(sums: np.ndarray, rows: pa.RecordBatch, size: int) -> None:
    v = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.float16).reshape(-1, size).astype(np.float32)
    places = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in rows.column(4).to_pylist()]
    for x, p in zip(v, places):
        if len(p) > 8:
            for i in range(0, len(p), ROWS):
                q = p[i:i + ROWS]
                sums[q[:, 0]] += q[:, 1:] * x
    few = np.flatnonzero([len(p) <= 8 for p in places])
    if len(few):
        p, row = np.concatenate([places[i] for i in few]), np.repeat(few, [len(places[i]) for i in few])
        order = np.argsort(p[:, 0], kind="stable")
        p, row = p[order], row[order]
        first = np.flatnonzero(np.r_[True, p[1:, 0] != p[:-1, 0]])
        sums[p[first, 0]] += np.add.reduceat(v[row] * p[:, 1:].astype(np.float32), first, axis=0)


def means(texts: DataFrame, size: int, passes: int = 1, sizes: Sizes = Sizes()) -> DataFrame:
    """``(report_id, embedding)`` of ``texts`` ``(report_id, words joined by blanks)``, one row each; zeros where there are no words."""
    kind = texts.schema["report_id"].dataType.simpleString()
    d = texts.mapInArrow(lambda batches: learned(batches, size, passes, sizes), f"kind int, word string, part long, at int, n long, data binary, report_id {kind}")
    d = spread(d, F.coalesce("word", F.concat_ws(" ", "part", "at"))).sortWithinPartitions("word", "kind", "part", "at")
    d = d.mapInArrow(lambda batches: averaged(batches, size), f"kind int, part long, at int, n long, data binary, report_id {kind}, vector binary")
    # the order of a part's words is the one of their places, so that sums do not depend on how rows arrive
    d = spread(d, F.col("part")).sortWithinPartitions("part", "kind", "at", "data", "vector")
    return d.mapInArrow(lambda batches: summed(batches, size), f"report_id {kind}, embedding array<double>")
