"""The pipeline against a plain version in Python, stage by stage."""

import hashlib
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from hazegrid.llm import quality as Q
from tests.llm.helpers import SCHEMA, clashing, odd, odd_rows
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_mixing import slow_targets
from tests.llm.test_quality import brute as brute_counts
from tests.llm.test_simhash import slow_components, slow_fingerprint
from tests.llm.test_tokens import ids

DIR = "/root/testdata/sf0.001"


def bucket(v):
    s = max(v.bit_length() - 5, 0) if v else 0
    return v >> s << s


def quartile(own, lang, every, k):
    """Of the group's values, with those of its language and of all documents merged in at the weight of ``Q.PRIOR`` documents each."""
    weight = {}
    for values, w in ((own, Fraction(1)), (lang, Fraction(Q.PRIOR, len(lang) + Q.PRIOR)), (every, Fraction(Q.PRIOR ** 2, (len(lang) + Q.PRIOR) * len(every)))):
        for v in values:
            weight[bucket(v)] = weight.get(bucket(v), 0) + w
    total, upto = sum(weight.values()), 0
    for v in sorted(weight):
        upto += weight[v]
        if 4 * upto >= k * total:
            return v


def plain_quality(docs):
    ratios = {}
    for d in docs:
        n, chars, sym, dup, rep = brute_counts(d[1])
        lines = sum(1 for x in (d[1] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        ratios[d] = (n, rep, dict(chars_per_word=chars * 1000 // max(n, 1), symbols_per_word=sym * 1000 // max(n, 1), dup_lines_share=dup * 1000 // max(lines, 1)))
    out, known = [], {}
    for d in docs:
        n, rep, mine = ratios[d]
        ok = n >= 10 and 100 * rep <= 20 * n
        for k, least in Q.RATIOS.items():
            groups = ([x for x in docs if x[2:4] == d[2:4]], [x for x in docs if x[2] == d[2]], docs)
            key = (k, d[2], d[3])
            if key not in known:
                known[key] = [quartile(*([ratios[x][2][k] for x in g] for g in groups), i) for i in (1, 3)]
            q1, q3 = known[key]
            ok = ok and mine[k] <= q3 + Q.SPREADS * max(q3 - q1, least)
        if ok:
            out.append(d)
    return out


def plain_mix(docs):
    words = {d[0]: re.findall(r"[^\x20\x09-\x0D]+", d[1] or "") for d in docs}
    by = {}
    for d in docs:
        by.setdefault(d[3], []).append(d)
    goal, _ = slow_targets({s: sum(len(words[d[0]]) for d in ds) for s, ds in by.items()})
    out = []
    for s, ds in by.items():
        n, take = sum(len(words[d[0]]) for d in ds), int(goal[s] + 1e-6)
        at = 0
        for d in sorted(ds, key=lambda d: hashlib.md5(f"mix:{d[0]}".encode()).hexdigest()):
            w = words[d[0]]
            if w:
                out += [d] * (take // n)
                part = min(len(w), take % n - at)
                if part > 0:
                    out.append(d if part == len(w) else (d[0], " ".join(w[:part]), *d[2:]))
            at += len(w)
    return out


def test_equals_plain_version(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{DIR}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{DIR}/benchmark.parquet'").fetchall()
    docs = plain_quality(rows)
    comp = slow_components({d[0]: slow_fingerprint(d[1]) for d in docs})
    docs = [d for d in docs if comp[d[0]] == d[0]]
    bad = {i for i, _, n, _ in brute_hits([d[:2] for d in docs], items) if n}
    docs = plain_mix([d for d in docs if d[0] not in bad])
    want, start = [], 0
    for d in sorted(docs, key=lambda d: d[0]):
        x = ids(d[1]) + [0]
        want.append((d[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    got = sorted(corpus_pipeline.run(spark, DIR).collect(), key=lambda r: r["start"])
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns_and_stand_odd_rows(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    for docs in (odd(spark), odd(spark).where("false")):
        out = stage(spark, docs, DIR)
        assert out.schema.simpleString() == docs.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
        out.collect()


NAMES = ("id", "fp", "mark", "slot", "size", "key", "kept", "start", "n_words", "_hit_id", "label")


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_with_clashing_names(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = clashing(odd(spark), *NAMES)
    out = stage(spark, docs, DIR)
    assert out.columns == docs.columns and out.count() > 0


def test_token_ids_of_odd_rows(spark):
    stage = corpus_pipeline.STAGES[4][1]
    rows = stage(spark, clashing(odd(spark), *NAMES), DIR).collect()
    want = sorted(len(ids(t)) + 1 for _, t, *_ in odd_rows())
    assert sorted(r["n_tokens"] for r in rows) == want and sum(r["doc_id"] is None for r in rows) == 2
    assert stage(spark, odd(spark).where("false"), DIR).count() == 0
