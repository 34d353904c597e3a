"""SimHash near-dedup with anchor points of a covering code.

Fingerprints of 64 bits link when they differ in few bits. Anchors are the code words of a direct sum of perfect Golay codes
(23 bits, covering radius 3) over the leading bits; the other bits are not looked at until the comparison. Every value has an
anchor within the covering radius, and two fingerprints at distance t have a value half-way between them, so both lie within
the covering radius plus t/2 of the anchor of that value. Each fingerprint is therefore copied to every anchor within the covering
radius plus half the threshold, counted block by block as the excess over each block's radius, and compared there. No linked
pair is missed, and a fingerprint gets some 60 anchors for a threshold of four, not over a thousand as with the whole threshold
on one side only.

More blocks mean more anchors (two blocks: 2**24): fewer fingerprints meet at an anchor by chance, against more copies.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.session import spread as spread_rows

from .common import components, hidden, saved

SHINGLE = 4
MAX_BITS = 4
BLOCKS = 2
#: fixed values: the binary Golay code of length 23, dimension 12 and covering radius 3
LENGTH, CHECK_BITS, RADIUS, GENERATOR = 23, 11, 3, 0xC75
#: Buckets up to this size are compared by shifting the whole batch; larger ones by growing components.
SMALL = 16
BATCH = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 (seed 42) of all shingles of the lower-cased words; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    k = min(shingle, len(words))
    starts = [0, *(e + 1 for e in ends[:len(words) - k])]
    h = np.fromiter((xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[k - 1:])), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)`` for every row; ``fp`` is the fingerprint as a signed long."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of each block value by the generator; zero for code words."""
    v = v.astype(np.int64)
    for b in range(LENGTH - 1, CHECK_BITS - 1, -1):
        v ^= ((v >> b) & 1) * (GENERATOR << (b - CHECK_BITS))
    return v


@lru_cache(maxsize=4)
def patterns(slack: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each excess up to ``slack``: bounds by syndrome and the error patterns that lead from a value to code words."""
    v, by_weight = np.zeros(1, np.int64), [np.zeros(1, np.int64)]
    for _ in range(RADIUS + slack):
        v = np.unique((v[:, None] | (1 << np.arange(LENGTH))).ravel())
        v = v[np.bitwise_count(v) == by_weight.__len__()]
        by_weight.append(v)
    out = []
    for x in range(slack + 1):
        e = np.concatenate(by_weight[:RADIUS + 1]) if x == 0 else by_weight[RADIUS + x]
        s = syndrome(e)
        order = np.argsort(s, kind="stable")
        out.append((np.searchsorted(s[order], np.arange((1 << CHECK_BITS) + 1)), e[order]))
    return out


def anchors(fp: np.ndarray, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """``(anchor, row)``: every anchor within the covering radius plus half the threshold of each fingerprint."""
    slack = (max_bits + 1) // 2
    table = patterns(slack)
    state = {0: (np.zeros(len(fp), np.int64), np.arange(len(fp)))}  # excess so far: anchor so far, row
    for b in range(blocks):
        v = ((fp >> np.uint64(b * LENGTH)) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
        s = syndrome(v)
        grown: dict[int, list] = {}
        for used, (at, row) in state.items():
            for x in range(slack - used + 1):
                bounds, errors = table[x]
                lo = bounds[s[row]]
                n = bounds[s[row] + 1] - lo
                i = np.repeat(np.arange(len(row)), n)
                word = v[row[i]] ^ errors[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]]
                grown.setdefault(used + x, []).append(((at[i] << (LENGTH - CHECK_BITS)) | (word >> CHECK_BITS), row[i]))
        state = {x: tuple(map(np.concatenate, zip(*parts))) for x, parts in grown.items()}
    return tuple(map(np.concatenate, zip(*state.values())))


def _grow(fp: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join each component of ``fp``: a reached value takes all its unreached neighbours along, so a dense group of
    any size takes a few passes and gives one link per value."""
    out, left = [], fp
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count(left ^ front[-1]) <= max_bits
            at = front.pop()
            if near.any():
                got = left[near]
                out.append((np.full(len(got), at), got))
                front.extend(got)
                left = left[~near]
    return out


def links(anchor: np.ndarray, fp: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links between the distinct fingerprints that meet at an anchor; ``anchor`` is sorted."""
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[first, len(anchor)])
    out = []
    small = np.repeat(size <= SMALL, size)
    a, f = anchor[small], fp[small]
    i = np.arange(len(a))
    for k in range(1, SMALL):
        i = i[i + k < len(a)]
        i = i[a[i] == a[i + k]]
        if not len(i):
            break
        hit = i[np.bitwise_count(f[i] ^ f[i + k]) <= max_bits]
        out.append((f[hit], f[hit + k]))
    for j in np.flatnonzero(size > SMALL):
        out += _grow(fp[first[j]:first[j] + size[j]], max_bits)
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    x, y = map(np.concatenate, zip(*out))
    pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
    return pair[:, 0], pair[:, 1]


def linked(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Links ``(a, b)`` that join the distinct fingerprints of ``fps(fp)`` to components."""
    def spread(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 2048):
                part = fp[i:i + 2048]
                anchor, row = anchors(part, max_bits, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row].view(np.int64))], ["anchor", "fp"])

    def compare(batches):
        held: list = []

        def flush(a, f):
            x, y = links(a, f, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        n = 0
        for b in batches:
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            n += b.num_rows
            if n >= BATCH:
                a, f = map(np.concatenate, zip(*held))
                cut = int(np.searchsorted(a, a[-1]))  # the last anchor may go on
                if cut:
                    yield flush(a[:cut], f[:cut])
                held, n = [(a[cut:], f[cut:])], len(a) - cut
        if n:
            yield flush(*map(np.concatenate, zip(*held)))

    copies = spread_rows(fps.select("fp"), "fp").mapInArrow(spread, "anchor long, fp long")
    return copies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """``(id, fp, component_id)`` for each row of ``docs``; ``component_id`` is the smallest id reachable over links.

    Equal fingerprints are one node, whatever the number of documents, so exact copies cost one row each. A null id takes part
    and never becomes a component's id unless all its ids are null. An empty table gives no rows.
    """
    fps = saved(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = saved(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    comp = components(linked(nodes, max_bits, blocks))
    member = comp.withColumnRenamed("node", "fp").union(comp.select(F.col("root").alias("fp"), "root").distinct())
    member = member.join(nodes, "fp")
    least = member.groupBy("root").agg(F.min("least").alias("first"))
    member = member.join(least, "root").select("fp", "first")
    label = nodes.join(member, "fp", "left").select("fp", F.coalesce("first", "least").alias("component_id"))
    return fps.join(label, "fp").select("id", "fp", "component_id")


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The document with the smallest id of each component; one row of those that repeat its id.

    A row without an id stands behind all rows with one, under a stand-in made from its text.
    """
    mine, keep_id = hidden(docs, "_own"), hidden(docs, "_keep")
    behind = F.xxhash64(text_col).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
    d = docs.withColumn(mine, F.coalesce(F.col(id_col).cast("long"), behind))
    groups = near_dedup(d, mine, text_col, **how)
    keep = groups.where(F.col("id") == F.col("component_id")).select(F.col("id").alias(keep_id)).distinct()
    out = d.join(keep, d[mine] == keep[keep_id], "left_semi")
    return out.dropDuplicates([mine]).select(*docs.columns)
