"""Near-duplicate passages by compact windows.

A document is a sequence of 5-word shingles. Under one hash function the subsequences of at least ``MIN_SHINGLES`` shingles fall
into compact windows (l, r): the nodes of the Cartesian tree over the hashes that are wide enough, inside which every such
subsequence has the same min-hash. There are about 2 n / MIN_SHINGLES of them; as passages are drawn out in the end, a window is
only kept as far as subsequences of the least length around its minimum reach. Windows of different documents with the same
min-hash under the same function are matched; matches of two documents whose intervals join up along one diagonal, under enough
of the hash functions, are a candidate passage, and the words of both sides decide: the passage is drawn out to both sides as
long as the words agree, must have ``MIN_WORDS`` words and a shingle similarity of ``SIMILARITY``.

Documents that share one shingle by chance are not compared: two windows of a signature meet if they also have the same min-hash, under
one function more, of the ``SIDE`` shingles before or of those after the minimum. A passage around the minimum holds one of these sides
whole. Windows that meet are a group. A small group gives all its pairs. A larger one is never expanded into pairs: its members are linked
to the smallest document among them, and where the words confirm that for all, it is done. Members that are not confirmed are compared, on
the shingles around the minimum, with the other members that are not joined to them yet, so any two passages of a group that agree there
are joined by links, few of them per member. Members that only share what very many share cannot agree and are left out by a prefix
filter. A large group is cut into chunks for that, and members of each chunk that are not confirmed ask those of every chunk. That is
quadratic where very many share one of their rarer shingles, or repeat shingles themselves, and still do not agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.session import spread

from .common import saved, thinned

SHINGLE, MIN_WORDS, SIMILARITY = 5, 50, 0.8
MIN_SHINGLES = MIN_WORDS - SHINGLE + 1
HASHES = 6
#: Shingles on one side of a minimum: a passage reaches at least that far to one of its sides.
SIDE = (MIN_SHINGLES - 1) // 2
#: Windows of a group that are all compared with each other, and members of a chunk of a large one.
SMALL, CHUNK = 6, 4096
#: Pairs of a large group, and cells of a table of its shingles, that are looked at at once.
AT_ONCE = 1 << 18
#: Bytes of text hashed at once, and rows (or, with words in them, bytes) of an Arrow batch that is handed on.
TEXT, ROWS, BYTES = 1 << 18, 1 << 16, 1 << 22
#: Words by which a candidate's two sides may be shifted against each other from one match to the next.
DRIFT = 8
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int):
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            cls.up, cls.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b), dtype=np.uint64)]) for b in (BASE, INVERSE))
        return cls.up, cls.down


def shingles_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every shingle of every list of words, from running sums over the bytes, and how many each list has."""
    words = np.array([len(w) for w in texts], np.int64)
    n = np.maximum(words - SHINGLE + 1, 0)
    if not n.any():
        return np.empty(0, np.uint64), n
    line = np.frombuffer(b" ".join([b" ".join(w) for w in texts if w]), np.uint8)
    up, down = _Powers.to(len(line) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((line.astype(np.uint64) + np.uint64(1)) * up[:len(line)], dtype=np.uint64)])
    blank = np.flatnonzero(line == 32)
    start, stop = np.r_[0, blank + 1], np.r_[blank, len(line)]
    i = np.arange(n.sum()) + np.repeat(np.cumsum(words) - words - (np.cumsum(n) - n), n)
    a, b = start[i], stop[i + SHINGLE - 1]
    return mix((run[b] - run[a]) * down[a] + (b - a).astype(np.uint64)), n


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every shingle; none for fewer words than a shingle has."""
    return shingles_of([words])[0]


def compact_windows(h: np.ndarray, width: int, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, l, at, r)`` of the windows of at least ``width`` values; ``at`` is the place of the minimum.

    Block-wise running minima give the minimum of every stretch of ``width`` values; a run of stretches with the same minimum is
    one node of the Cartesian tree, as far as such stretches hold its minimum. With ``sizes`` (each at least ``width``), ``h`` holds
    the values of several texts one after another, and no window goes over from one to the next.
    """
    n = len(h)
    if n < width:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    low, sizes = least(h, width), np.array([n]) if sizes is None else sizes
    stretches = sizes - width + 1
    owner = np.repeat(np.arange(len(sizes)), stretches)
    start = np.arange(len(owner)) + owner * (width - 1)
    low = low[start]
    new = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])])
    first, last = start[new], start[np.r_[new[1:], len(low)] - 1]
    at = first + h[first[:, None] + np.arange(width)].argmin(axis=1)
    return low[new], first, at, last + width - 1


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The minima of all stretches of ``width`` values."""
    pad = np.full(-len(h) % width, np.uint64(0xFFFFFFFFFFFFFFFF))
    block = np.concatenate([h, pad]).reshape(-1, width)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:len(h) - width + 1], left[width - 1:len(h)])


def signatures(texts: list[str | None]):
    """``(text, signature, place, sides, same)`` of all compact windows under all hash functions, ``text`` being the number of the text in
    the list; the signature tells the function too.

    ``place`` holds at, at - l and r - at; ``sides`` the min-hashes of both sides in 32 bits each, zero where the text ends before;
    ``same`` is equal for equal words as far as windows of that minimum can reach.
    """
    h, sizes = shingles_of([words_of(t) for t in texts])
    long = sizes >= MIN_SHINGLES
    h, number, sizes = h[np.repeat(long, sizes)], np.flatnonzero(long), sizes[long]
    if not len(h):
        return (np.empty(0, np.int64), *(np.empty(0, np.uint64),) * 4)
    ends = np.cumsum(sizes)
    side = mix(least(mix(h ^ mix(np.array([HASHES + 1], np.uint64))), SIDE)) >> np.uint64(32)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + BASE), dtype=np.uint64)])
    parts = []
    for k in range(HASHES):
        low, l, at, r = compact_windows(mix(h ^ mix(np.array([k + 1], np.uint64))), MIN_SHINGLES, sizes)
        text = np.searchsorted(ends, at, "right")
        begin, end = (ends - sizes)[text], ends[text]
        place = ((at - begin) << 14) | ((at - l) << 7) | (r - at)
        before = np.where(at - begin >= SIDE, side[np.maximum(at - SIDE, 0)], np.uint64(0))
        after = np.where(at + SIDE < end, side[np.minimum(at + 1, len(h) - SIDE)], np.uint64(0))
        lo, hi = np.maximum(at - MIN_SHINGLES + 1, begin), np.minimum(at + MIN_SHINGLES, end)
        same = mix((run[hi] - run[lo]) ^ mix((((at - lo) << 7) | (hi - at)).astype(np.uint64)))
        parts.append((number[text], (low & ~np.uint64(7)) | np.uint64(k), place.astype(np.uint64), (before << np.uint64(32)) | after, same))
    return tuple(map(np.concatenate, zip(*parts)))


def in_parts(texts: list[str | None], most: int):
    """Slices of the list, each of about ``most`` code points at most, or of one text."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield slice(first, i)
            first, size = i, 0
        size += len(t or "")
    yield slice(first, len(texts))


NAMES = ["rep", "doc", "rep_from", "rep_to", "from", "to", "hashes"]
WINDOW = "sig long, doc long, place long, sides long, rep long, rep_at long"
LINK = "rep long, doc long, k int, rep_at int, at int, l int, r int, grp long"


def _window_rows(sig, doc, place, sides, rep, rep_at):
    return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(doc), pa.array(place.view(np.int64)), pa.array(sides.view(np.int64)), rep, rep_at],
                                      [c.split()[0] for c in WINDOW.split(", ")])


def _link_rows(rep, doc, sig, rep_at, place, grp):
    place = place.astype(np.int64)
    at = place >> 14
    cols = [pa.array(rep), pa.array(doc), *(pa.array(x.astype(np.int32)) for x in (sig & np.uint64(7), rep_at, at, at - (place >> 7 & 127), at + (place & 127))), grp]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in LINK.split(", ")])


def met(sig, doc, place, side, salt):
    """Pairs of rows ``(first, second, group)`` whose windows have the same signature and side; the group is zero where it is small.

    The first one is of the smaller document.
    """
    o = np.lexsort((place, doc, side, sig))
    o = o[side[o] != 0]
    s, x, d = sig[o], side[o], doc[o]
    if not len(o):
        return (np.empty(0, np.int64),) * 3
    lead = np.r_[True, (s[1:] != s[:-1]) | (x[1:] != x[:-1])]
    first = np.flatnonzero(lead)
    size = np.diff(np.r_[first, len(o)])
    number = np.cumsum(lead) - 1
    out = []
    i = np.flatnonzero((size <= SMALL)[number])
    for k in range(1, SMALL):
        i = i[i + k < len(o)]
        i = i[number[i] == number[i + k]]
        hit = i[d[i] != d[i + k]]
        out.append((hit, hit + k, np.zeros(len(hit), np.int64)))
    i = np.flatnonzero((size > SMALL)[number])
    i = i[d[i] != d[first[number[i]]]]
    out.append((first[number[i]], i, mix(s[i] ^ mix(x[i] + np.uint64(salt))).view(np.int64) | 1))
    a, b, g = map(np.concatenate, zip(*out))
    return o[a], o[b], g


def window_rows(batches):
    """Windows of the texts of Arrow batches ``(id, text)``, some ``ROWS`` at a time whatever the texts hold."""
    def rows(doc, sig, place, sides, same):
        o = np.lexsort((place, doc, same, sig))
        sig, doc, place, sides, same = (x[o] for x in (sig, doc, place, sides, same))
        lead = np.r_[True, (sig[1:] != sig[:-1]) | (same[1:] != same[:-1])]
        to = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        # the same words as those of another document nearby: linked to that one, which stands for both
        linked = ~lead & (doc[to] != doc)
        for m in (lead, linked):
            i = np.flatnonzero(m)
            for i in np.split(i, range(ROWS, len(i), ROWS)):
                rep, rep_at = doc[to[i]], (place[to[i]] >> np.uint64(14)).astype(np.int64)
                yield _window_rows(sig[i], doc[i], place[i], sides[i], *(pa.array(x, mask=lead[i]) for x in (rep, rep_at)))

    held, n = [], 0
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, b.num_rows, 512):
            texts = b.column(1).slice(i, 512).to_pylist()
            for part in in_parts(texts, TEXT):
                text, *more = signatures(texts[part])
                held.append((ids[i + part.start + text], *more))
                n += len(text)
                if n >= 8 * ROWS:
                    yield from rows(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
    if n:
        yield from rows(*map(np.concatenate, zip(*held)))


def links(docs: DataFrame) -> DataFrame:
    """Matched windows ``(rep, doc, k, rep_at, at, l, r, grp)`` of ``docs(id, text)``, and the large group they are of, if any."""
    def meet(batches):
        held: list = []

        def flush(sig, doc, place, sides):
            lead = np.r_[True, sig[1:] != sig[:-1]]
            many = ~(lead & np.r_[lead[1:], True])
            sig, doc, place, sides = (x[many] for x in (sig, doc, place, sides))
            if not len(sig):
                return
            pairs = [met(sig, doc, place, sides >> np.uint64(32), 1), met(sig, doc, place, sides & np.uint64(0xFFFFFFFF), 2)]
            a, b, g = map(np.concatenate, zip(*pairs))
            o = np.lexsort((g, b, a))
            a, b, g = a[o], b[o], g[o]
            once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (g[1:] != g[:-1])][:len(a)]
            a, b, g = a[once], b[once], g[once]
            if len(a):
                yield _link_rows(doc[a], doc[b], sig[b], place[a] >> np.uint64(14), place[b], pa.array(g, mask=g == 0))

        n = 0
        for batch in batches:
            done = batch.filter(batch.column(4).is_valid())
            if done.num_rows:
                sig, doc, place, _, rep, rep_at = (c.to_numpy(zero_copy_only=False) for c in done.columns)
                yield _link_rows(rep, doc, sig.view(np.uint64), rep_at, place, pa.nulls(len(sig), pa.int64()))
            new = batch.filter(batch.column(4).is_null())
            if not new.num_rows:
                continue
            held.append([new.column(0).to_numpy().view(np.uint64), new.column(1).to_numpy(), *(new.column(i).to_numpy().view(np.uint64) for i in (2, 3))])
            n += new.num_rows
            if n >= 1 << 17 and held[0][0][0] != held[-1][0][-1]:
                cols = list(map(np.concatenate, zip(*held)))
                cut = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1  # the last signature may go on
                yield from flush(*(c[:cut] for c in cols))
                held = [[c[cut:] for c in cols]]
                n = len(held[0][0])
        if held:
            yield from flush(*map(np.concatenate, zip(*held)))

    w = docs.select("id", "text").mapInArrow(window_rows, WINDOW)
    # what is linked already goes anywhere
    w = w.repartition(F.when(F.col("rep").isNull(), F.col("sig")).otherwise(F.xxhash64("sig", "doc"))).sortWithinPartitions("sig")
    return w.mapInArrow(meet, LINK)


def candidates(matches: DataFrame) -> DataFrame:
    """``(rep, doc, rep_from, rep_to, from, to, hashes, places, rep_places)``: stretches of shingles in which matches join up, and
    the places of these matches on both sides."""
    def run(batches):
        held = None
        for b in batches:
            b = pa.Table.from_batches([b])
            t = pa.concat_tables([held, b]) if held is not None else b
            rep, doc = (t.column(i).to_numpy() for i in (0, 1))
            cut = int(np.flatnonzero(np.r_[True, (rep[1:] != rep[:-1]) | (doc[1:] != doc[:-1])])[-1])  # the last pair may go on
            if cut:
                yield from segments(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield from segments(held)

    def segments(t):
        rep, doc, k, rep_at, at, l, r = (t.column(i).to_numpy().astype(np.int64) for i in range(7))
        diag = at - rep_at
        new = np.r_[True, (rep[1:] != rep[:-1]) | (doc[1:] != doc[:-1]) | (l[1:] > r[:-1]) | (np.abs(diag[1:] - diag[:-1]) > DRIFT)]
        first = np.flatnonzero(new)
        bits = np.bitwise_or.reduceat(1 << k, first)
        n = np.bitwise_count(bits)
        cols = [rep[first], doc[first], np.minimum.reduceat(rep_at, first), np.maximum.reduceat(rep_at, first), at[first], np.maximum.reduceat(at, first), n]
        size = np.diff(np.r_[first, len(at)])
        bounds = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
        places = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (at, rep_at)]
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in cols), *places], [*NAMES, "places", "rep_places"])

    m = matches.drop("grp").repartition("rep", "doc").withColumn("diag", F.expr(f"(at - rep_at + {1 << 30}) div {DRIFT}"))
    m = m.sortWithinPartitions("rep", "doc", "diag", "at").drop("diag")
    return m.mapInArrow(run, ", ".join(f"`{n}` long" for n in NAMES) + ", places array<long>, rep_places array<long>")


def tuples(w: list) -> list[tuple]:
    """The shingles of a list of words."""
    return list(zip(*(w[k:] for k in range(SHINGLE))))


def drawn_out(a: list[str], b: list[str], i: int, j: int, x: int, y: int):
    """The stretches ``a[i:j]`` and ``b[x:y]`` to both sides as far as the words are equal."""
    for step in (256, 16, 1):
        while i >= step and x >= step and a[i - step:i] == b[x - step:x]:
            i, x = i - step, x - step
        while j + step <= len(a) and y + step <= len(b) and a[j:j + step] == b[y:y + step]:
            j, y = j + step, y + step
    return i, j, x, y


def agree(a: list[str], b: list[str], i: int, j: int, x: int, y: int):
    """Draw out the stretches ``a[i:j]`` and ``b[x:y]``: ``(i, j, x, y, similarity)``, or None if they are no such passage."""
    return alike(a, b, *drawn_out(a, b, i, j, x, y))


def alike(a: list[str], b: list[str], i: int, j: int, x: int, y: int):
    """As ``agree``, for stretches that are drawn out."""
    need = MIN_WORDS - min(j - i, y - x)
    if need <= 0:
        splits = [(0, 0)]
    else:  # past words that differ, as far as there are any, to one side or both
        most_back, most_on = min(i, x, need), min(len(a) - j, len(b) - y, need)
        if most_back + most_on < need:
            return None
        p, q = (tuples(w[s - most_back:e + most_on]) for w, s, e in ((a, i, j), (b, x, y)))
        known = set(p)
        hits = np.cumsum([0, *(k in known for k in q)])
        n = len(q) - (most_back + most_on - need)  # shingles of a stretch
        shared = {v: hits[most_back - v + n] - hits[most_back - v] for v in range(need - most_on, most_back + 1)}
        # most of it before, as far as that will do; else where most is shared
        order = sorted(shared, key=lambda v: (v != most_back, -shared[v]))
        splits = [(v, need - v) for v in order if v == most_back or shared[v] >= SIMILARITY * MIN_SHINGLES]
    for back, on in splits:
        v, w = a[i - back:j + on], b[x - back:y + on]
        if v == w and len(v) >= SHINGLE:
            return i - back, j + on, x - back, y + on, 1.0
        p, q = set(tuples(v)), set(tuples(w))
        shared = len(p & q)
        like = shared / max(1, len(p) + len(q) - shared)
        if like >= SIMILARITY:
            return i - back, j + on, x - back, y + on, like
    return None


def agreed(a: list, b: list, whole: tuple[int, int, int, int], places: list[tuple[int, int]]) -> list[tuple]:
    """The passages of a candidate: the whole stretch, or else each part of it around a match that is one."""
    v = agree(a, b, *whole)
    if v:
        return [v]
    out, done, failed = [], -1, {}
    for i, x in places:
        if i < done or i + SHINGLE <= failed.get(x - i, 0):  # within equal words that are no passage
            continue
        run = drawn_out(a, b, i, i + SHINGLE, x, x + SHINGLE)
        if v := alike(a, b, *run):
            out.append(v)
            done = v[1]
        elif a[i:i + SHINGLE] == b[x:x + SHINGLE]:
            failed[x - i] = run[1]
    return out


def around(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The shingles around each place, ``MIN_SHINGLES - 1`` to each side, in 32 bits; zero past the text."""
    i = at[:, None] + np.arange(1 - MIN_SHINGLES, MIN_SHINGLES)
    inside = (i >= 0) & (i < len(h))
    return np.where(inside, (h >> np.uint64(32))[np.where(inside, i, 0)] | np.uint64(1), np.uint64(0)).astype(np.uint32)


def reaches(a: list, b: list, first: int, i: int, j: int, last: int) -> bool:
    """Whether some stretch of the least length that holds ``i:j`` and lies in ``first:last`` has the similarity."""
    known = set(a[first:last])
    hit = np.cumsum([0, *(x in known for x in b)])
    for k in range(max(first, j - MIN_SHINGLES), min(i, last - MIN_SHINGLES) + 1):
        if hit[k + MIN_SHINGLES] - hit[k] >= SIMILARITY * MIN_SHINGLES or k == i - (MIN_SHINGLES - (j - i)):
            p, q = set(a[k:k + MIN_SHINGLES]), set(b[k:k + MIN_SHINGLES])
            if len(p & q) >= SIMILARITY * len(p | q):
                return True
    return False


def stand_ins(near, doc, here, inner, cell):
    """For every row the row with the same shingles that stands for it; rows of documents that come more than once stand for themselves."""
    weight = mix(np.arange(1, near.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    key = mix((mix(near.astype(np.uint64) + BASE) * weight).sum(axis=1, dtype=np.uint64))
    again = (doc[1:] == doc[:-1]) & (cell[1:] == cell[:-1])
    own = np.where(np.r_[False, again] | np.r_[again, False], np.arange(1, len(doc) + 1), 0)
    o = np.lexsort((~inner, ~here, own, key, cell))
    lead = np.r_[True, (key[o][1:] != key[o][:-1]) | (own[o][1:] != own[o][:-1]) | (cell[o][1:] != cell[o][:-1])]
    rep = np.empty(len(doc), np.int64)
    rep[o] = o[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
    return rep


def spread_out(lo, hi):
    """All numbers of the ranges ``lo:hi``, and the number of the range of each."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size), which


def grown(doc, inner, near, here, asks, cell=None):
    """Pairs ``(row, row)`` that join the members of a group as far as their shingles ``near`` a minimum agree, in the sense of ``agree``.

    ``inner`` ones are joined already, those of ``asks`` ask the ones ``here``, and of two that are not inner the first one asks.
    Rows are sorted by document and place; there may be several groups, one after another, told apart by the numbers ``cell``. Members with the same shingles are one; others are looked at if they have one of their rarest
    shingles in common. Two stretches of the least length that agree share ``enough`` shingles, so both have one of these
    among all but their ``enough - 1`` most frequent ones: what very many share is not looked at for itself.
    """
    mid, root = MIN_SHINGLES - 1, np.arange(len(doc))
    cell = np.zeros(len(doc), np.int64) if cell is None else cell
    _, lead, number = np.unique(cell[inner], return_index=True, return_inverse=True)
    root[inner] = np.flatnonzero(inner)[lead[number]]
    rep = stand_ins(near, doc, here, inner, cell)
    for x in np.flatnonzero((rep != np.arange(len(doc))) & here[rep] & (asks | asks[rep])).tolist():
        if root[x] != root[rep[x]]:
            root[root == root[x]] = root[rep[x]]
            yield x, int(rep[x])
    alone = rep == np.arange(len(doc))
    here, asks = here & alone, asks & alone
    before, after = (near[:, :mid] != 0).sum(axis=1), (near[:, mid + 1:] != 0).sum(axis=1)
    o = np.argsort(near, axis=1, kind="stable")
    line = np.take_along_axis(near, o, axis=1)
    again = np.zeros((len(doc), near.shape[1] + 1), bool)
    again[:, 1:-1] = (line[:, 1:] == line[:, :-1]) & (line[:, 1:] != 0)
    odd = again.any(axis=1)  # a shingle repeats
    earlier = np.empty(near.shape, np.int64)  # where a shingle comes before, if it does
    np.put_along_axis(earlier, o, np.where(again[:, :-1], np.roll(o, 1, axis=1), -1), axis=1)
    # the first stretch of the least length, of those around the minimum, in which a place is the first one with its shingle
    begin = np.minimum(np.maximum(earlier + 1, np.maximum(np.arange(near.shape[1]) - mid, 0)), MIN_SHINGLES)

    def different(x, hit):
        # how many different shingles each stretch has in the places that are hit
        run = np.cumsum(np.bincount((np.arange(len(x))[:, None] * (MIN_SHINGLES + 1) + begin[x])[hit], minlength=len(x) * (MIN_SHINGLES + 1)).reshape(len(x), -1), axis=1)
        run[:, 1:MIN_SHINGLES] -= np.cumsum(hit[:, :mid], axis=1)
        return run[:, :MIN_SHINGLES]

    n = different(np.arange(len(doc)), near != 0)
    enough = int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * MIN_SHINGLES - 1e-9))
    near_of = np.where(near != 0, near.astype(np.uint64) | (cell.astype(np.uint64) << np.uint64(32))[:, None], np.uint64(0))[alone]
    names, code, times = np.unique(near_of, return_inverse=True, return_counts=True)
    # 0: none, 1: of one member only, then by frequency
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, times))] = np.arange(2, len(names) + 2)
    rank = np.maximum(rank - (times == 1).sum(), 1)
    rank[names == 0] = 0
    code = np.zeros(near.shape, np.int64)
    code[alone] = rank[np.searchsorted(names, near_of)]
    width = int(code.max()) + 1
    order = np.sort(np.where(code == 0, width, code), axis=1)
    rare = (np.arange(near.shape[1]) < ((near != 0).sum(axis=1) - enough + 1)[:, None]) & (order > 1) & (order < width) & ~odd[:, None]
    row, col = np.nonzero(rare & here[:, None])
    key = order[row, col]
    o = np.argsort(key, kind="stable")
    key, row = key[o], row[o]
    strange, all_here = np.flatnonzero(odd & here), np.flatnonzero(here)

    def plausible(q):
        i, j = np.nonzero(rare[q])
        want = order[q][i, j]
        at, which = spread_out(np.searchsorted(key, want), np.searchsorted(key, want, "right"))
        pairs = [i[which] * len(doc) + row[at]]
        for of, whom in ((np.arange(len(q)), strange), (np.flatnonzero(odd[q]), all_here)):
            at, which = spread_out(np.searchsorted(cell[whom], cell[q[of]]), np.searchsorted(cell[whom], cell[q[of]], "right"))
            pairs.append(of[which] * len(doc) + whom[at])
        x, t = np.divmod(np.concatenate(pairs), len(doc))
        ok = (root[q[x]] != root[t]) & (doc[q[x]] != doc[t]) & (inner[t] | (t > q[x]))
        x, t = np.divmod(np.unique(x[ok] * len(doc) + t[ok]), len(doc))
        out = []
        at_once = int(min(4096, max(64, AT_ONCE * 64 // width)))
        for k in range(0, len(x), at_once):
            a, b = q[x[k:k + at_once]], t[k:k + at_once]
            ok = possible(a, b)
            out.append((a[ok], b[ok]))
        return tuple(map(np.concatenate, zip(*out))) if out else (x, t)

    def of_other(a, b):
        rows, i = np.unique(a, return_inverse=True)
        known = np.zeros((len(rows), width), bool)
        known[np.arange(len(rows))[:, None], code[rows]] = True
        known[:, :2] = False
        return known[i[:, None], code[b]]

    def possible(a, b):
        # in some stretch of the least length that holds the minimum, enough of the different shingles are in the other row
        most = np.minimum(different(a, of_other(b, a)), different(b, of_other(a, b)))
        k = np.arange(MIN_SHINGLES)
        whole = (k >= mid - np.minimum(before[a], before[b])[:, None]) & (k <= np.minimum(after[a], after[b])[:, None])
        return (whole & (most >= SIMILARITY * (n[a] + n[b] - most) - 1e-9)).any(axis=1)

    ask = np.flatnonzero(asks)
    if not len(ask):
        return
    want = np.where(rare[ask], order[ask], width)
    cost = (np.searchsorted(key, want, "right") - np.searchsorted(key, want)).sum(axis=1) + width + len(strange) + odd[ask] * len(doc)
    cost = np.cumsum(cost) // AT_ONCE
    for block in np.split(ask, np.flatnonzero(cost[1:] != cost[:-1]) + 1):
        q, t = plausible(block)
        if not len(q):
            continue
        differ = (near[q] != near[t]) | (near[q] == 0)
        end = np.ones((len(q), 1), bool)
        back = np.concatenate([differ[:, :mid][:, ::-1], end], axis=1).argmax(axis=1)
        on = np.concatenate([differ[:, mid + 1:], end], axis=1).argmax(axis=1)
        o = np.argsort(-back - on, kind="stable")
        for q, t, i, j in zip(*(x[o].tolist() for x in (q, t, back, on))):
            if root[t] == root[q]:
                continue
            need = MIN_SHINGLES - (i + j + 1)
            if need > 0 and not reaches(near[q].tolist(), near[t].tolist(), mid - i - min(before[q] - i, before[t] - i, need), mid - i,
                                        mid + j + 1, mid + j + 1 + min(after[q] - j, after[t] - j, need)):
                continue
            root[root == root[t]] = root[q]
            yield q, t


def across(matches: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """Matched windows, as of ``links``, that join the members of large groups whose match with the smallest is not ``found``."""
    m = matches.where("grp is not null")
    f = found.select(F.col("doc_id").alias("doc"), F.col("other_id").alias("rep"), "start", "words", "other_start", "other_words")
    ok = m.join(f, ["doc", "rep"]).where("at >= start and at < start + words and rep_at >= other_start and rep_at < other_start + other_words")
    ok = ok.select("grp", "doc", "at").distinct().withColumn("ok", F.lit(True))
    m = saved(m.join(ok, ["grp", "doc", "at"], "left").select("*", F.col("ok").isNotNull().alias("inner")).drop("ok"), "groups")
    live = m.groupBy("grp").agg(F.min("inner").alias("all"), F.count(F.lit(1)).alias("size"), F.first("rep").alias("rep"), F.first("rep_at").alias("rep_at"))
    live = live.where("not all").withColumn("chunks", F.ceil((F.col("size") + 1) / CHUNK).cast("int")).drop("all", "size")
    live = saved(live, "live")
    rows = m.drop("rep", "rep_at").join(live.select("grp", "chunks"), "grp")
    first = live.select("grp", F.col("rep").alias("doc"), F.lit(0).alias("k"), F.col("rep_at").alias("at"), F.col("rep_at").alias("l"), F.col("rep_at").alias("r"), F.lit(True).alias("inner"), "chunks")
    rows = rows.unionByName(first)
    need = rows.groupBy(F.col("doc").alias("id")).agg(F.collect_set(F.struct("grp", "k", "at", "l", "r", "inner", "chunks")).alias("c"))
    need = saved(need, "members")
    texts = thinned(docs, F.col("id"), need, F.col("id")).dropDuplicates(["id"])

    def clip(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                size, c = part.column(2).value_lengths().to_numpy(), part.column(2).flatten()
                grp, k, at, l, r, inner, n = (x.to_numpy(zero_copy_only=False) for x in c.flatten())
                doc, h = np.repeat(part.column(0).to_numpy(), size), [shingle_hashes(words_of(t)) for t in part.column(1).to_pylist()]
                text = np.repeat(np.arange(len(h)), size)
                own = (doc * 31 + at) % n
                # cells (chunk of those asked, chunk of those who ask)
                one = np.flatnonzero(n == 1)
                cells = [(i, a, q) for i in np.flatnonzero(n > 1).tolist()
                         for a, q in {(own[i], j) for j in range(n[i])} | (set() if inner[i] else {(j, own[i]) for j in range(n[i])})]
                row, asked, asking = np.concatenate([np.stack([one, 0 * one, 0 * one], 1), np.array(cells, np.int64).reshape(-1, 3)]).T
                for i in range(0, len(row), 4096):
                    x, a, q = row[i:i + 4096], asked[i:i + 4096], asking[i:i + 4096]
                    y = np.flatnonzero(np.r_[True, text[x][1:] != text[x][:-1]])
                    near = np.concatenate([around(h[text[x[u]]], at[x[u:v]]) for u, v in zip(y, [*y[1:], len(x)])])
                    near = pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * near.shape[1] * 4), pa.py_buffer(near.tobytes())])
                    cols = grp[x], a, q, a == own[x], ~inner[x] & (q == own[x]), doc[x], k[x], at[x], l[x], r[x], inner[x], near
                    yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(cols, kinds)], names)

    member = "grp long, asked int, asking int, here boolean, asks boolean, doc long, k int, at int, l int, r int, inner boolean, near binary"
    names = [c.split()[0] for c in member.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]] for c in member.split(", ")]

    def grow(batches):
        held = None
        for b in batches:
            t = pa.concat_tables([held, pa.Table.from_batches([b])]) if held is not None else pa.Table.from_batches([b])
            new = first_rows(t)
            cut = int(new[-1]) if len(new) else 0
            if cut:
                yield from cells(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield from cells(held)

    def first_rows(t):
        change = [x[1:] != x[:-1] for x in (t.column(i).to_numpy() for i in range(3))]
        return np.flatnonzero(np.r_[True, np.logical_or.reduce(change)][:t.num_rows])

    def cells(t):
        here, asks, doc, k, at, l, r, inner = (t.column(i).to_numpy() for i in range(3, 11))
        first = first_rows(t)
        size = np.diff(np.r_[first, t.num_rows])
        number = np.repeat(np.arange(len(first)), size)
        wanted = np.maximum.reduceat(asks, first)
        # small cells together, as it is one call for them
        for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(np.cumsum(size) // 2048)) + 1):
            rows = np.flatnonzero(wanted[number] & (number >= part[0]) & (number <= part[-1]))
            if not len(rows):
                continue
            near = np.frombuffer(b"".join(t.column(11).take(pa.array(rows)).to_pylist()), np.uint32).reshape(len(rows), -1)
            out = []
            for q, x in grown(doc[rows], inner[rows], near, here[rows], asks[rows], number[rows]):
                a, b = sorted((rows[q], rows[x]), key=lambda i: doc[i])
                out.append((doc[a], doc[b], k[b], at[a], at[b], l[b], r[b], None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([v for v in col], pa.int64() if n in ("rep", "doc", "grp") else pa.int32()) for col, n in zip(zip(*out), link)], link)

    link = [c.split()[0] for c in LINK.split(", ")]

    placed = texts.join(need, "id").select("id", "text", "c").mapInArrow(clip, member)
    return spread(placed, "grp", "asked", "asking").sortWithinPartitions("grp", "asked", "asking", "doc", "at").mapInArrow(grow, LINK)


def verified(matches: DataFrame, d: DataFrame) -> DataFrame:
    """The passages of matched windows of ``d(id, text)``, as ``repeated`` gives them."""
    c = saved(candidates(matches), "passages")
    # what each side needs, with a margin: the members' stretches one by one, a representative's all together; a text is sent for both once
    need = c.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("rep", "rep_from", "rep_to", "from", "to", "hashes", "places", "rep_places")).alias("c"))
    reps = c.groupBy(F.col("rep").alias("id")).agg(F.min("rep_from").alias("lo"), F.max("rep_to").alias("hi"))
    need = need.join(reps, "id", "full").select("id", "c", "lo", "hi")

    def clip(batches):
        got, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                doc, text, c, lo, hi = (b.column(k)[i] for k in range(5))
                doc, lo, hi, w = doc.as_py(), lo.as_py(), hi.as_py(), words_of(text.as_py())
                stretches = [] if lo is None else [(None, lo, hi)]
                for k in range(len(c.values) if c.is_valid else 0):
                    x = c.values[k]
                    stretches.append((x, x["from"].as_py(), x["to"].as_py()))
                for x, lo, hi in stretches:
                    lo = max(0, lo - MIN_WORDS)
                    got.append((doc, x, lo, b" ".join(w[lo:hi + SHINGLE + MIN_WORDS])))
                    size += len(got[-1][-1]) + 100
                    if size > BYTES:
                        yield span_rows(got)
                        got, size = [], 0
        if got:
            yield span_rows(got)

    def span_rows(got):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] and x[1].as_py() for x in got], span), pa.array([x[2] for x in got], pa.int64()),
                                           pa.array([x[3] for x in got], pa.binary())], ["id", "c", "offset", "words"])

    one = thinned(d, F.col("id"), need, F.col("id")).dropDuplicates(["id"])
    kind = "struct<rep:bigint,rep_from:bigint,rep_to:bigint,from:bigint,to:bigint,hashes:bigint,places:array<bigint>,rep_places:array<bigint>>"
    span = pa.struct([*((n, pa.int64()) for n in ("rep", "rep_from", "rep_to", "from", "to", "hashes")), ("places", pa.list_(pa.int64())), ("rep_places", pa.list_(pa.int64()))])
    spans = one.join(need, "id").select("id", "text", "c", "lo", "hi").mapInArrow(clip, f"id long, c {kind}, offset long, words binary")
    spans = saved(spans, "spans")
    a = spans.where("c is not null").select(F.col("c.rep").alias("rep"), "id", "c", "offset", "words")
    b = spans.where("c is null").select(F.col("id").alias("rep"), F.col("offset").alias("rep_offset"), F.col("words").alias("rep_words"))

    def verify(batches):
        names = ["doc_id", "start", "words", "other_id", "other_start", "other_words", "similarity", "hashes"]
        for batch in batches:
            out, seen = [], {}
            for x in (x for i in range(0, batch.num_rows, 64) for x in batch.slice(i, 64).to_pylist()):
                key = x["rep"]
                if key not in seen:
                    seen = {key: x["rep_words"].split(b" ")}
                a, b, c, o, p = x["words"].split(b" "), seen[key], x["c"], x["offset"], x["rep_offset"]
                places = sorted({(i - o, y - p) for i, y in zip(c["places"], c["rep_places"])})
                for v in agreed(a, b, (c["from"] - o, c["to"] + SHINGLE - o, c["rep_from"] - p, c["rep_to"] + SHINGLE - p), places):
                    out.append((x["id"], v[0] + o, v[1] - v[0], key, v[2] + p, v[3] - v[2], v[4], c["hashes"]))
            cols = zip(*out) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(v), pa.float64() if n == "similarity" else pa.int64()) for n, v in zip(names, cols)], names)

    j = a.join(b, "rep").select("id", "c", "offset", "words", "rep", "rep_offset", "rep_words")
    return j.mapInArrow(verify, "doc_id long, start long, words long, other_id long, other_start long, other_words long, similarity double, hashes long")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, words, other_id, other_start, other_words, similarity, hashes)``: a passage of a document and the same
    passage, or nearly so, in a document of smaller id. Places are word numbers from zero.

    Documents of one passage are joined by such links; where many hold it, a document is linked to few others. Rows without an id take no part, rows of the same id are one document (one of them). Documents of
    fewer than 50 words, null and empty texts have no passages.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    m = saved(links(d), "matches")
    found = saved(verified(m, d), "found")
    return found.union(verified(saved(across(m, found, d), "joins"), d)).distinct()
