"""Compact codes of vectors: one byte for each part of a vector, by per-dimension value dictionaries.

Components become integers. Rows are packed once into blocks; a block keeps, for each dimension, its distinct integers (the
dictionary) and every row's place in it. To assign a block, the squared differences of each distinct integer to all entries of its
part's codebook are tabulated; the distance of a part to all entries is then the sum of as many table rows, gathered by the
dictionary codes. A distinct value is thus compared with the entries once a block and round, however often it occurs, and memory is
bounded by the block, not by the number of distinct values of the whole table.

Each round sums the assigned parts by entry inside the tasks; only those sums, whose number is the codebook's size times the
number of tasks, are shuffled, and the codebooks themselves are all that reaches the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a block; codes in a dictionary take two bytes.
BLOCK = 4096
#: Tasks over which the rows of one label are spread.
SALTS = 32


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS) -> DataFrame:
    """``(id, label, vec)`` of the rows whose vector can be coded.

    A vector is left out if it is null, holds a null, a NaN or an infinity, or is not as long as most that can be cut into
    ``parts`` equal parts (of two lengths as frequent, the larger one counts).
    """
    finite = F.forall(vec_col, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    good = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & (F.size(vec_col) % parts == 0)).where(finite)
    good = good.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    length = good.groupBy(F.size("vec").alias("k")).count().agg(F.max(F.struct("count", "k"))).first()[0]
    return good.where(F.size("vec") == (length["k"] if length else 0))


def integers(flat: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` of finite numbers."""
    x = np.floor(flat.astype(np.float64) * scale)
    if len(x) and np.abs(x).max() >= 2.0 ** 62:
        raise OverflowError("components too large for 64-bit integers")
    return x.astype(np.int64)


def blocks(rows: DataFrame, dims: int, scale: int = SCALE) -> DataFrame:
    """``rows(id, label, vec)`` packed: ids, labels, distinct integers of each dimension, and the rows' places among them."""
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                b = batch.slice(i, BLOCK)
                n = b.num_rows
                x = integers(np.asarray(b.column(2).flatten()), scale).reshape(n, dims)
                places, values, sizes = np.empty((dims, n), "<u2"), [], []
                for j in range(dims):
                    v, places[j] = np.unique(x[:, j], return_inverse=True)
                    values.append(v)
                    sizes.append(len(v))
                whole = pa.array([0, n], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(whole, b.column(0)), pa.ListArray.from_arrays(whole, b.column(1)),
                     pa.array([np.concatenate(values).astype("<i8").tobytes()], pa.binary()), pa.array([np.array(sizes, "<i4").tobytes()], pa.binary()),
                     pa.array([places.tobytes()], pa.binary())], ["ids", "labels", "dictionary", "sizes", "places"])

    return rows.mapInArrow(run, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, dictionary binary, sizes binary, places binary")


def unpacked(dictionary: bytes, sizes: bytes, places: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """The dictionary of each dimension, and the places as (dimension, row)."""
    s = np.frombuffer(sizes, "<i4")
    return np.split(np.frombuffer(dictionary, "<i8"), np.cumsum(s)[:-1]), np.frombuffer(places, "<u2").reshape(len(s), -1)


def assign(values: list[np.ndarray], places: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row's parts and its squared distance, both (part, row); ties go to the lower entry.

    ``books`` is (part, entry, position within the part).
    """
    parts, _, width = books.shape
    most = max(int(max(abs(int(v[0])), abs(int(v[-1])))) for v in values)
    most = (most + int(np.abs(books).max())) ** 2 * len(values)
    if most >= 1 << 63:
        raise OverflowError("components too large: squared distances leave 64 bits")
    kind = np.int32 if most < 1 << 31 else np.int64
    nearest = np.empty((parts, places.shape[1]), np.int64)
    error = np.empty((parts, places.shape[1]), np.int64)
    for p in range(parts):
        total = None
        for k in range(width):
            j = p * width + k
            table = ((values[j][:, None] - books[p, :, k][None, :]) ** 2).astype(kind)
            got = table[places[j]]
            total = got if total is None else np.add(total, got, out=total)
        nearest[p] = total.argmin(axis=1)
        error[p] = total[np.arange(total.shape[0]), nearest[p]]
    return nearest, error


def _sums(packed: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """By part and entry that is used: the number of assigned parts and their componentwise sums."""
    parts, entries, width = books.shape

    def run(batches):
        n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            for row in b.to_pylist():
                values, places = unpacked(row["dictionary"], row["sizes"], row["places"])
                nearest, _ = assign(values, places, books)
                for p in range(parts):
                    n[p] += np.bincount(nearest[p], minlength=entries)
                    for k in range(width):
                        j = p * width + k
                        # entry and dictionary place are counted together, so sums are exact integers
                        m = len(values[j])
                        c = np.bincount(nearest[p] * m + places[j], minlength=entries * m).reshape(entries, m)
                        s[p, :, k] += c @ values[j]
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(s[p, e].tolist(), pa.list_(pa.int64()))],
                                             ["part", "entry", "n", "s"])

    per_task = packed.select("dictionary", "sizes", "places").mapInArrow(run, "part int, entry int, n long, s array<long>")
    total = per_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("s", F.lit(k))) for k in range(width))).alias("s"))
    return {(r["part"], r["entry"]): (r["n"], r["s"]) for r in total.collect()}  # at most parts x entries rows


def codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
          entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``(id, label, code, error)`` of every usable row, and the codebooks as (part, entry, position within the part).

    ``code`` has one byte per part. Each part's codebook starts as that part of the ``entries`` smallest ids, null ids last, rows
    with one id in the order of their vectors; fewer rows make fewer entries. Repeated rows are coded alike and weigh as often as they
    occur. An empty table gives no rows and empty codebooks. Squared distances beyond 64 bits raise ``OverflowError``.
    """
    if not 1 <= entries <= 256:
        raise ValueError("one byte holds 1 to 256 entries")
    rows = usable(vectors, id_col, vec_col, label_col, parts)
    start = [r["vec"] for r in rows.select("id", "vec").orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()]
    if not start:
        return rows.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    dims = len(start[0])
    books = integers(np.array(start), scale).reshape(len(start), parts, dims // parts).transpose(1, 0, 2).copy()
    packed = saved(blocks(rows, dims, scale), "blocks")
    for _ in range(rounds):
        for (p, e), (n, s) in _sums(packed, books).items():
            books[p, e] = [x // n for x in s]
    final = books

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                nearest, error = assign(*unpacked(*(b.column(c)[i].as_py() for c in (2, 3, 4))), final)
                raw = nearest.T.astype(np.uint8).copy()
                code = pa.array([x.tobytes() for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).flatten(), b.column(1).slice(i, 1).flatten(), code, pa.array(error.sum(axis=0))],
                                                 ["id", "label", "code", "error"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
    return packed.mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, code binary, error long"), books


def decoded(code: bytes, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for: the entries' lower corners over ``scale``."""
    return np.concatenate([books[p, e] for p, e in enumerate(code)]) / scale


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the error summed over the rows of the same label, nulls together.

    A label's rows are summed and joined in ``SALTS`` shares, so a label with very many rows is no single task's work.
    """
    rows = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)))
    share = rows.groupBy("label", "salt").agg(F.sum("error").alias("e"))
    total = share.groupBy(F.col("label").alias("l")).agg(F.sum("e").alias("label_error"))
    share = share.select(F.col("label").alias("m"), F.col("salt").alias("t")).join(total, F.col("m").eqNullSafe(F.col("l"))).select("m", "t", "label_error")
    out = rows.join(share, F.col("label").eqNullSafe(F.col("m")) & (F.col("salt") == F.col("t")))
    return out.select("id", "label", "code", "error", "label_error")
