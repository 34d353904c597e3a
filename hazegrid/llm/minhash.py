"""Near-duplicate documents by b-bit MinHash, confirmed on the full shingle sets.

A text's set holds the 64-bit hashes of its distinct word shingles. Texts with equal sets are one node. Of ``HASHES`` minima per
node, the whole values of ``ROWS`` at a time make ``BANDS`` bucket keys, and the lowest ``BITS`` bits of each are kept, packed into
a signature. Nodes that meet in a bucket are candidates. The number of equal bit fields of their signatures, corrected for
fields that agree by chance, estimates their similarity; candidates below a bound that a linked pair misses less than once in
10^9 are dropped, and all others are confirmed on the full sets.

Components need no pair of every two members. (1) Each node is confirmed with one leader of its buckets, which joins most of a group.
(2) Buckets that still hold several components are compared: a candidate pair between two components belongs to the first bucket its
members share. Members with a candidate, and only they, are sent there with their full sets, and there a pair is confirmed only while its
members are still apart, so a bucket of any size gives at most one link per member and no link between components is lost. A large
bucket is cut into chunks: each holds a share of the members, and those outside the leader's component visit every chunk.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved, thinned

SHINGLE, PERCENT = 3, 85
HASHES, ROWS, BITS = 128, 5, 2
#: A linked pair meets in none of the buckets with a chance below 10^-6.
BANDS = HASHES // ROWS
#: Shingles of a bucket's members held at once, partners of one node that are confirmed together, and pairs compared at once.
CHUNK, PARTNERS, AT_ONCE = 2_000_000, 256, 1 << 17
#: Chance that a pair at the threshold is dropped by its estimate.
MISS = 1e-9
REMEMBERED = 500_000
_ODD = np.random.default_rng(11).integers(0, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_FLIP = np.random.default_rng(12).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(13).integers(0, 2, HASHES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


_words = _Words()


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of the whole text, A-Z lower-cased; of all words if they are fewer, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = (h ^ w[i:len(w) - k + 1 + i]) * _ODD[i]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of a non-empty set under each of ``HASHES`` orders."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        x = (s[i:i + 4096, None] ^ _FLIP[None, :]) * _MIX
        np.minimum(out, x.min(axis=0), out=out)
    return out


def signature(m: np.ndarray) -> bytes:
    """The lowest ``BITS`` bits of the minima, packed."""
    bits = (m[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def band_keys(m: np.ndarray) -> np.ndarray:
    """One bucket key per band."""
    h = np.arange(BANDS, dtype=np.uint64)
    for part in m[:BANDS * ROWS].reshape(BANDS, ROWS).T:
        h = (h ^ part) * _MIX
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of bit fields that differ, between signatures as rows of 64-bit words (fields do not cross words)."""
    x = a ^ b
    for i in range(1, BITS):
        x = x | ((a ^ b) >> np.uint64(i))
    mask = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    return np.bitwise_count(x & mask).sum(axis=-1, dtype=np.int64)


def similarity(differ: int) -> float:
    """Estimated similarity: the share of equal fields less what agrees by chance."""
    by_chance = 2.0 ** -BITS
    return (1 - differ / HASHES - by_chance) / (1 - by_chance)


def most_differing(percent: int = PERCENT, miss: float = MISS) -> int:
    """The largest number of differing fields that a candidate may have: linked pairs exceed it with a chance below ``miss``."""
    p = (1 - percent / 100) * (1 - 2.0 ** -BITS)
    tail = 0.0
    for d in range(HASHES, -1, -1):
        tail += comb(HASHES, d) * p ** d * (1 - p) ** (HASHES - d)
        if tail > miss:
            return d
    return 0


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets reach the similarity."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, n, digest, sig, bands)`` of every row: size and 128-bit digest of its set, packed signature, bucket keys."""
    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                s = shingle_set(t.as_py(), shingle)
                if len(s):
                    m = minima(s)
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(m), band_keys(m)))
                else:
                    rows.append((0, None, None, None))
            n, digest, sig, bands = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()),
                                              pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "digest", "sig", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, digest binary, sig binary, bands array<long>")


def _differ_sql(a: str, b: str):
    """``differing`` of two packed signatures in SQL."""
    step, total = 16, F.lit(0)
    mask = F.conv(F.lit("5555555555555555"), 16, 10).cast("long")
    for i in range(1, HASHES * BITS // 4, step):
        # a word of 64 bits as two halves, so that no unsigned number leaves the range of long
        x = None
        for half in (0, 8):
            w = [F.conv(F.substring(F.hex(c), i + half, 8), 16, 10).cast("long") for c in (a, b)]
            d = w[0].bitwiseXOR(w[1])
            d = d.bitwiseOR(F.shiftright(d, 1)).bitwiseAND(mask)
            x = F.bit_count(d) if x is None else x + F.bit_count(d)
        total = total + x
    return total


def sets_of(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(nid, shingles)`` of ``nodes(nid, digest, least)``: full sets, recomputed from one text of each node."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                s = shingle_set(b.column(0)[i].as_py(), shingle)
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes())], pa.binary()), pa.array([s.tobytes()], pa.binary())], ["digest", "shingles"])

    want = nodes.select(F.col("least").alias("_least")).distinct()
    few = thinned(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()), F.xxhash64("_id"), want, F.xxhash64("_least"))
    texts = few.join(want, F.col("_id").eqNullSafe(F.col("_least")), "left_semi").select("text")
    # rows that repeat an id or a text give a set more than once
    found = texts.mapInArrow(run, "digest binary, shingles binary").join(nodes.select("nid", "digest"), "digest").select("nid", "shingles")
    return found.groupBy("nid").agg(F.min("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs of ``pairs(a, b)`` whose full sets reach the similarity.

    A node ``a`` with many partners is sent once to each share of them, and the partners' sets stream by.
    """
    def run(batches):
        at, held = None, None
        for batch in batches:
            a_out, b_out = [], []
            for a, salt, b, s in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                s = np.frombuffer(s.as_py(), np.uint64)
                if b is None:
                    at, held = (a, salt), s
                elif (a, salt) == at and linked(held, s, percent):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    shares = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("shares"))
    p = pairs.join(shares, F.col("a") == F.col("_a")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).alias("salt"))
    own = p.select("a", "salt").distinct().join(sets, F.col("a") == sets["nid"]).select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    rest = p.join(sets, F.col("b") == sets["nid"]).select("a", "salt", "b", "shingles")
    return own.union(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def similar_sizes(n_a, n_b, percent: int = PERCENT):
    """Whether two sets can reach the similarity by their sizes."""
    return 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)


class _Side:
    """Some members of a bucket as arrays."""

    NAMES = ("nid", "label", "n", "inner", "sig", "bands")

    def __init__(self, batch: pa.RecordBatch, lo: int, hi: int):
        part = batch.slice(lo, hi - lo)
        col = {c: part.column(part.schema.get_field_index(c)) for c in part.schema.names}
        self.nid, self.label, self.n = (col[c].to_numpy(zero_copy_only=False) for c in ("nid", "label", "n"))
        self.inner = col["inner"].to_numpy(zero_copy_only=False)
        self.sig = np.frombuffer(b"".join(col["sig"].to_pylist()), np.uint64).reshape(len(part), -1)
        self.bands = col["bands"].flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
        self.sets = [np.frombuffer(x.as_py(), np.uint64) for x in col["shingles"]] if "shingles" in col else None

    @staticmethod
    def joined(sides: list[_Side]) -> _Side:
        out = sides[0]
        if len(sides) > 1:
            for c in _Side.NAMES:
                setattr(out, c, np.concatenate([getattr(s, c) for s in sides]))
            if out.sets is not None:
                out.sets = [x for s in sides for x in s.sets]
        return out


def candidates(q: _Side, t: _Side, band: int, most: int, percent: int):
    """Blocks of candidate pairs ``(row of q, row of t, differing fields)`` whose first common bucket is that of ``band``.

    Members inside the leader's component (``inner``) are only asked about, never ask; two that both ask meet once.
    """
    at_once = max(1, AT_ONCE // max(1, len(t.nid)))
    for i in range(0, len(q.nid), at_once):
        part = slice(i, i + at_once)
        x, y = np.nonzero((q.label[part, None] != t.label[None, :]) & (t.inner[None, :] | (q.nid[part, None] < t.nid[None, :]))
                          & similar_sizes(q.n[part, None], t.n[None, :], percent))
        x += i
        d = differing(q.sig[x], t.sig[y])
        ok = np.flatnonzero(d <= most)
        x, y, d = x[ok], y[ok], d[ok]
        ok = np.flatnonzero((q.bands[x] == t.bands[y]).argmax(axis=1) == band)
        yield x[ok], y[ok], d[ok]


def shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of one sorted set with each of the others."""
    flat = np.concatenate(others)
    at = np.searchsorted(one, flat)
    hit = one[np.minimum(at, len(one) - 1)] == flat
    return np.add.reduceat(hit, np.cumsum([0, *map(len, others[:-1])]))


def grown(q: _Side, t: _Side, pairs, percent: int = PERCENT):
    """Links ``(a, b)`` that join whatever components of ``q`` and ``t`` are linked by the given pairs; most similar pairs first."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while root.get(k, k) != k:
            root[k] = root.get(root[k], root[k])
            k = root[k]
        return k

    for x, y, d in pairs:
        order = np.lexsort((d, x))
        x, y = x[order], y[order]
        for i, j in zip(np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else [], [*np.flatnonzero(x[1:] != x[:-1]) + 1, len(x)]):
            me, own, left = int(x[i]), q.sets[x[i]], y[i:j]
            while len(left):
                mine = find(int(q.label[me]))
                left = left[np.array([find(int(k)) != mine for k in t.label[left]], bool)]
                now, left = left[:64], left[64:]
                if not len(now):
                    break
                both = shared(own, [t.sets[k] for k in now])
                for k in now[100 * both >= percent * (len(own) + t.n[now] - both)].tolist():
                    a, b = find(int(q.label[me])), find(int(t.label[k]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        yield int(q.nid[me]), int(t.nid[k])


def _buckets(batches):
    """``(band, targets, queries)`` of each part of each (bucket, chunk), whose targets come first."""
    at, targets = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, band, chunk, role = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key", "band", "chunk", "role"))
        cuts = np.flatnonzero(np.r_[True, (np.diff(key) != 0) | (np.diff(band) != 0) | (np.diff(chunk) != 0) | (np.diff(role) != 0)])
        for lo, hi in zip(cuts, [*cuts[1:], len(key)]):
            if (key[lo], band[lo], chunk[lo]) != at:
                at, targets = (key[lo], band[lo], chunk[lo]), []
            side = _Side(batch, lo, hi)
            if role[lo] == 0:
                targets.append(side)
            elif targets:
                targets = [_Side.joined(targets)]
                yield at, targets[0], side


def across(live: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, most: int, percent: int) -> DataFrame:
    """Confirmed links ``(a, b)`` that join the components which share buckets of ``live(key, band, nid)`` and have a linked pair.

    ``labels(nid, label)`` leaves out nodes that are their own component.
    """
    kinds = "key long, band int, chunk int, role int, nid long"

    def involved(batches):
        for (key, band, chunk), t, q in _buckets(batches):
            in_q, in_t = np.zeros(len(q.nid), bool), np.zeros(len(t.nid), bool)
            for x, y, _ in candidates(q, t, band, most, percent):
                in_q[x] = in_t[y] = True
            for role, side, some in ((0, t, in_t), (1, q, in_q)):
                nid = side.nid[some]
                if len(nid):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nid), key)), pa.array(np.full(len(nid), band, np.int32)), pa.array(np.full(len(nid), chunk, np.int32)),
                                                      pa.array(np.full(len(nid), role, np.int32)), pa.array(nid)], ["key", "band", "chunk", "role", "nid"])

    def links(batches):
        for (_, band, _), t, q in _buckets(batches):
            found = list(grown(q, t, candidates(q, t, band, most, percent), percent))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    rows = live.join(labels, "nid", "left").select("key", "band", "nid", F.coalesce("label", "nid").alias("label")).join(nodes.select("nid", "n"), "nid")
    rows = saved(rows, "live")
    mixed = rows.groupBy("key", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct("nid", "label")).alias("first"), F.sum("n").alias("size"))
    mixed = mixed.where("lo <> hi").select("key", "band", F.col("first.label").alias("main"), F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    rows = rows.join(mixed, ["key", "band"]).select("*", (F.col("label") == F.col("main")).alias("inner"))
    target = rows.select("key", "band", F.pmod(F.xxhash64("nid"), F.col("chunks")).cast("int").alias("chunk"), F.lit(0).alias("role"), "nid", "label", "inner")
    query = rows.where(~F.col("inner")).select("key", "band", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("role"), "nid", "label", "inner")
    side = nodes.select("nid", "n", "sig", "bands")

    def met(df):
        by = ["key", "band", "chunk"]
        return df.repartition(*by).sortWithinPartitions(*by, "role", "nid")

    places = saved(target.union(query), "places")
    few = met(places.join(side, "nid")).mapInArrow(involved, kinds).distinct()
    few = saved(few, "involved").join(places, ["key", "band", "chunk", "role", "nid"]).join(side, "nid").join(sets, "nid")
    return met(few).mapInArrow(links, "a long, b long").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(id, n, component_id)`` for each row of ``docs``: the size of its set and the smallest id reachable over confirmed links.

    Rows without a word are linked with nothing. A null id takes part and is a component's id only if all its ids are null; rows that
    repeat an id are rows of their own. An empty table gives no rows.
    """
    sigs = saved(signatures(docs, id_col, text_col, shingle), "signatures")
    nodes = sigs.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = saved(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")  # written once, so the numbers stay
    band = nodes.select("nid", F.posexplode("bands").alias("band", "key"))
    buckets = band.groupBy("key").agg(F.min("nid").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "leader")
    buckets = saved(buckets, "buckets")
    live = saved(thinned(band, F.col("key"), buckets, F.col("key")).join(buckets, "key"), "live")
    most = most_differing(percent)

    involved = live.select("nid").distinct().join(nodes.select("nid", "digest", "least"), "nid")
    sets = saved(sets_of(involved, docs, id_col, text_col, shingle), "sets")
    side = nodes.select("nid", "n", "sig")
    star = live.where("nid <> leader").select("nid", "leader").distinct()
    star = star.join(side.select("nid", F.col("n").alias("n1"), F.col("sig").alias("s1")), "nid")
    star = star.join(side.select(F.col("nid").alias("leader"), F.col("n").alias("n2"), F.col("sig").alias("s2")), "leader")
    star = star.where(100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")).withColumn("d", _differ_sql("s1", "s2")).where(F.col("d") <= most)
    # any clearly similar leader will do, and the smallest is the one that most others have
    star = star.groupBy("nid").agg(F.min(F.struct(F.greatest("d", F.lit(most // 4)).alias("d"), "leader")).alias("to"))
    links = saved(confirmed(star.select(F.col("to.leader").alias("a"), F.col("nid").alias("b")), sets, percent), "links")
    def labelled(links):
        return components(links).select(F.col("node").alias("nid"), F.col("root").alias("label"))

    more = saved(across(live.select("key", "band", "nid"), labelled(links), nodes, sets, most, percent), "links")
    labels = labelled(links.union(more))
    member = nodes.join(labels, "nid", "left").select("digest", "least", F.coalesce("label", "nid").alias("label"))
    least = member.groupBy("label").agg(F.min("least").alias("component_id"))
    member = member.join(least, "label").select("digest", "component_id")
    out = sigs.select("id", "n", "digest").join(member, "digest", "left")
    return out.select("id", "n", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
