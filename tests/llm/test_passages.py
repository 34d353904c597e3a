import random

import numpy as np
import pyarrow as pa

from hazegrid.llm import passages as P
from tests.llm.helpers import clashing, empty, odd


def slow_windows(h, width):
    out = set()
    for i in range(len(h) - width + 1):
        for j in range(i + width - 1, len(h)):
            c = i + int(np.argmin(h[i:j + 1]))
            l = c
            while l > 0 and h[l - 1] > h[c]:
                l -= 1
            r = c
            while r + 1 < len(h) and h[r + 1] > h[c]:
                r += 1
            out.add((int(h[c]), max(l, c - width + 1), c, min(r, c + width - 1)))
    return out


def test_windows_are_the_wide_nodes_of_the_cartesian_tree():
    rng = np.random.default_rng(0)
    for n, width in ((1, 1), (5, 3), (40, 7), (64, 8), (7, 8)):
        h = rng.permutation(1 << 12)[:n].astype(np.uint64)
        assert {tuple(map(int, x)) for x in zip(*P.compact_windows(h, width))} == slow_windows(h, width)


def text(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def pairs(rows):
    return {frozenset((r["doc_id"], r["other_id"])) for r in rows}


def joined(rows, ids):
    group = {i: i for i in ids}
    for _ in ids:
        for r in rows:
            if not {r["doc_id"], r["other_id"]} <= set(ids):
                continue
            a, b = group[r["doc_id"]], group[r["other_id"]]
            group = {i: min(a, b) if g in (a, b) else g for i, g in group.items()}
    return {group[i] for i in ids}


def test_repeated_passages_are_found_and_others_are_not(spark):
    rnd = random.Random(11)
    shared, near, short, copy = text(rnd, 60), text(rnd, 80), text(rnd, 30), text(rnd, 300)
    w = near.split()
    w[40] = "changed"
    docs = [(i, f"{text(rnd, 40 + i)} {shared} {text(rnd, 90)}") for i in range(12)]
    docs += [(20, f"{text(rnd, 70)} {near} {text(rnd, 30)}"), (21, f"{text(rnd, 10)} {' '.join(w)} {text(rnd, 200)}")]
    docs += [(30 + i, f"{text(rnd, 100)} {short} {text(rnd, 100)}") for i in range(4)]
    docs += [(40, copy), (41, copy.upper()), (42, copy + " tail"), (50, text(rnd, 500)), (51, ""), (52, None), (53, "x " * 400), (54, "x " * 300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = P.repeated(d).collect()
    assert len(joined(rows, range(12))) == 1 and frozenset((20, 21)) in pairs(rows) and len(joined(rows, [40, 41, 42])) == 1
    assert {i for p in pairs(rows) for i in p} <= {*range(12), 20, 21, 40, 41, 42, 53, 54}
    words = {i: P.words_of(t) for i, t in docs}
    for r in rows:
        a = words[r["doc_id"]][r["start"]:r["start"] + r["words"]]
        b = words[r["other_id"]][r["other_start"]:r["other_start"] + r["other_words"]]
        p, q = ({tuple(x[k:k + 5]) for k in range(len(x) - 4)} for x in (a, b))
        assert min(len(a), len(b)) >= 50 and len(p & q) / len(p | q) >= 0.8
        if r["doc_id"] < 12 and r["other_id"] < 12:
            assert " ".join(shared.split()).encode() in b" ".join(a)


def test_links_grow_with_the_group_not_with_its_pairs(spark):
    rnd = random.Random(2)
    shared = text(rnd, 60)
    d = spark.createDataFrame([(i, f"{text(rnd, 60)} {shared} {text(rnd, 60)}") for i in range(300)], "doc_id long, text string").repartition(6)
    rows = P.repeated(d).collect()
    assert len(joined(rows, range(300))) == 1 and len(pairs(rows)) < 3000


def test_odd_rows(spark):
    long = odd(spark)
    d = clashing(long.union(long.where("doc_id = 6").selectExpr("60L", "text", "lang", "source", "n_chars")), "id", "rep", "doc", "sig")
    assert pairs(P.repeated(d).collect()) == {frozenset((6, 60))}
    assert P.repeated(empty(spark)).count() == 0


def edited(rnd, words, n):
    """The words with one changed at ``n`` places."""
    w = list(words)
    for i in rnd.sample(range(len(w)), n):
        w[i] = text(rnd, 1)
    return w


def test_passages_alike_to_one_document_only_are_joined_on_any_layout(spark):
    rnd = random.Random(5)
    base = text(rnd, 50).split()
    # one word changed in each: similar to document 2, not to each other; document 0 shares half of it with all
    docs = [(0, f"{text(rnd, 60)} {' '.join(base[:30])} {text(rnd, 60)}"), (1, f"{text(rnd, 40)} {' '.join(base[20:])} {text(rnd, 60)}")]
    docs += [(i, f"{text(rnd, 30 + i)} {' '.join(base if i == 2 else edited(rnd, base, 1))} {text(rnd, 60)}") for i in range(2, 25)]
    found = []
    for n in (1, 4, 16):
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(n)
        found.append({tuple(r)[:6] for r in P.repeated(d).collect()})
        rows = [{"doc_id": r[0], "other_id": r[3]} for r in found[-1]]
        assert len(joined(rows, range(2, 25))) == 1, n
        assert not {0, 1} & {i for p in pairs(rows) for i in p}
    assert pairs([{"doc_id": r[0], "other_id": r[3]} for r in found[0]]) == pairs([{"doc_id": r[0], "other_id": r[3]} for r in found[2]])


def test_large_groups_of_several_passages_with_a_common_half(spark):
    """More documents share half a passage than a small group holds; each passage is one component, in one chunk or several."""
    rnd = random.Random(6)
    half = text(rnd, 28)
    ends = [text(rnd, 40) for _ in range(5)]
    docs = [(i, f"{text(rnd, 50)} {half} {ends[i % 5] if i >= 3 else text(rnd, 40)} {text(rnd, 50)}") for i in range(63)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for chunk in (P.CHUNK, 7):
        old, P.CHUNK = P.CHUNK, chunk
        try:
            rows = P.repeated(d).collect()
        finally:
            P.CHUNK = old
        for k in range(5):
            assert len(joined(rows, [i for i in range(3, 63) if i % 5 == k])) == 1, (chunk, k)
        assert all(a % 5 == b % 5 and min(a, b) >= 3 for a, b in map(sorted, pairs(rows)))


def test_members_are_joined_as_all_pairs_join_them():
    rnd = random.Random(7)
    base = [text(rnd, 100).split() for _ in range(3)]
    words = []
    for _ in range(120):
        w = edited(rnd, rnd.choice(base)[:48] + base[0][48:], rnd.randrange(6))
        w[48:53] = base[0][48:53]  # the minimum they share
        words.append([x.encode() for x in w])
    near = np.concatenate([P.around(P.shingle_hashes(w), np.array([48])) for w in words])
    doc, one, none = np.arange(120), np.ones(120, bool), np.zeros(120, bool)

    def classes(links):
        root = list(range(120))
        for a, b in links:
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        return root

    got = list(P.grown(doc, none, near, one, one))
    full = [(a, b) for a in range(120) for b in range(a) if P.agree(words[a], words[b], 48, 53, 48, 53)]
    assert classes(got) == classes(full) and len(got) == 120 - len(set(classes(full)))
    assert 3 < len(set(classes(full))) < 100


def test_recall_of_near_copies_against_brute_force(spark):
    rnd = random.Random(8)
    docs, n = [], 0
    for _ in range(40):
        base = text(rnd, 60).split()
        for _ in range(4):
            docs.append((n, f"{text(rnd, rnd.randrange(40, 90))} {' '.join(edited(rnd, base, rnd.randrange(2)))} {text(rnd, 50)}"))
            n += 1
    words = {i: P.words_of(t) for i, t in docs}

    def alike(a, b):
        shingles = {}
        for k in range(len(a) - 4):
            shingles.setdefault(tuple(a[k:k + 5]), k)
        places = [(shingles[s], k) for k in range(len(b) - 4) if (s := tuple(b[k:k + 5])) in shingles]
        return bool(P.agreed(a, b, (places[0][0], places[-1][0] + 5, places[0][1], places[-1][1] + 5), places)) if places else False

    true = {frozenset((a, b)) for a in words for b in range(a // 4 * 4, a) if alike(words[a], words[b])}
    rows = P.repeated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert len(true) > 100 and len(true & pairs(rows)) >= 0.95 * len(true)


def test_windows_of_many_texts_at_once_are_those_of_each_and_leave_in_small_batches():
    rnd = random.Random(9)
    texts = [text(rnd, rnd.choice((0, 3, 49, 50, 51, 400, 3000))) for _ in range(60)] + [None, "", "x " * 500]
    one = {(i, *map(int, x)) for i, t in enumerate(texts) for _, *x in zip(*P.signatures([t]))}
    assert one == {tuple(map(int, x)) for x in zip(*P.signatures(texts))} and len(one) > 5000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    old, P.ROWS = P.ROWS, 200
    try:
        out = list(P.window_rows(iter([batch])))
    finally:
        P.ROWS = old
    assert max(b.num_rows for b in out) <= 200
    got = [(x["doc"], x["sig"] % (1 << 64), x["place"]) for b in out for x in b.to_pylist()]
    assert set(got) <= {x[:3] for x in one} and len(got) == len(set(got))
    assert {x[:3] for x in one if x[0] < 60} <= set(got)


def around_minimum(words, at):
    return np.concatenate([P.around(P.shingle_hashes([x.encode() for x in w]), np.array([at])) for w in words])


def test_junk_that_shares_a_minimum_is_not_compared_pair_by_pair():
    rnd = random.Random(10)
    shared, lines = text(rnd, 10).split(), [text(rnd, 7).split() for _ in range(80)]
    near = around_minimum([line * 7 + shared + line * 7 for line in lines], 51)
    doc, one, none, asked, reaches = np.arange(80), np.ones(80, bool), np.zeros(80, bool), [], P.reaches
    P.reaches = lambda *a: asked.append(a) or reaches(*a)
    try:
        assert list(P.grown(doc, none, near, one, one)) == [] and len(asked) < 80
    finally:
        P.reaches = reaches


def test_groups_in_one_call_are_joined_as_one_by_one():
    rnd = random.Random(12)
    parts = []
    for g in range(6):
        base = text(rnd, 100).split() if g % 2 else text(rnd, 10).split() * 10
        words = []
        for _ in range(25):
            w = edited(rnd, base, rnd.randrange(4))
            w[48:53] = base[48:53]
            words.append(w)
        parts.append(around_minimum(words + words[:3], 48))
    parts.append(parts[0])  # the same shingles in another group
    n = [len(p) for p in parts]
    near, cell = np.concatenate(parts), np.repeat(np.arange(len(n)), n)
    doc = np.concatenate([np.arange(k) // (1 + g % 2) for g, k in enumerate(n)])
    inner = np.array([rnd.random() < 0.2 for _ in doc])
    one = np.ones(len(doc), bool)

    def classes(links):
        root = np.arange(len(doc))
        for g in range(len(n)):
            root[inner & (cell == g)] = min(np.flatnonzero(inner & (cell == g)), default=0)
        for a, b in links:
            root[root == root[b]] = root[a]
        return {frozenset(np.flatnonzero(root == r).tolist()) for r in root}

    together = list(P.grown(doc, inner, near, one, ~inner, cell))
    alone = []
    for g in range(len(n)):
        m, lo = cell == g, sum(n[:g])
        alone += [(lo + a, lo + b) for a, b in P.grown(doc[m], inner[m], near[m], one[m], ~inner[m])]
    assert classes(together) == classes(alone) and 10 < len(classes(alone)) < len(doc)
    assert all(cell[a] == cell[b] and doc[a] != doc[b] for a, b in together)
