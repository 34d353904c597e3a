import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hazegrid.llm import tokens as T
from hazegrid.llm.encoding import Encoder
from tests.llm.helpers import clashing, empty, odd, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
WEIRD = ["", "a", " a", "a ", "  ", "a  b", "x\n y", "x \ny", "x\n \n y", "tab\t z", "no break   em", "<|endoftext|> a<|endoftext|>b c", "it's I'll we 'd",
         "   x y", "é f", " \x1c y z", "\u0085 q", "日本 語。 x", "a" * 5000 + " " + "b" * 5000]


def ids(t):
    return TOK.encode(t or "", add_special_tokens=False).ids


def test_parts_give_the_ids_of_whole_texts():
    got = Encoder(PATH).encode(WEIRD + WEIRD[::-1])
    assert got == [np.array(ids(t), "<u2").tobytes() for t in WEIRD + WEIRD[::-1]]


def test_encoder_forgets_and_other_tokenizers(monkeypatch):
    from hazegrid.llm import encoding

    monkeypatch.setattr(encoding, "REMEMBERED", 3)
    monkeypatch.setattr(encoding, "AT_ONCE", 10)
    texts = [f"w{i} x{i % 3} y z" for i in range(50)]
    assert Encoder(PATH).encode(texts) == [np.array(ids(t), "<u2").tobytes() for t in texts]
    other = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(other)
    assert Encoder(other).encode(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


def test_digests_of_odd_rows(spark):
    d = clashing(odd(spark), "key", "value", "id", "shard")
    got = sorted(((r["id"] is not None, r["id"]), r["start"], r["n_tokens"], r["crc"]) for r in T.digests(d, PATH).collect())
    assert len(got) == len(odd_rows())
    assert [g[1] for g in got] == list(np.cumsum([0] + [g[2] for g in got[:-1]]))  # ids ascending, null first
    want = {}
    for i, t, *_ in odd_rows():
        x = ids(t) + [0]
        want.setdefault(i, []).append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    have = {}
    for (_, i), _, n, c in got:
        have.setdefault(i, []).append((n, c))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_no_documents(spark):
    assert T.digests(empty(spark), PATH).count() == 0


def test_keyed_reading(spark, tmp_path):
    d = spark.createDataFrame([(i * 7, f"text number {i} of many", "en", "s", 0) for i in range(500)], "doc_id long, text string, lang string, source string, n_chars long")
    path, _, _ = T.write(d, str(tmp_path / "ids"), PATH)
    got = {r["key"]: r["ids"] for r in T.read(spark, path, spark.createDataFrame([(0,), (7,), (3493,), (5,), (-1,), (10 ** 12,)], "key long")).collect()}
    assert got == {k: ids(f"text number {k // 7} of many") + [0] for k in (0, 7, 3493)}


def test_reading_opens_only_the_shards_that_the_index_names(spark, tmp_path):
    d = spark.createDataFrame([(i, f"text {i} of many") for i in range(400)], "doc_id long, text string")
    path, back, index = T.write(d, str(tmp_path / "ids"), PATH)
    everywhere = {r["shard"]: r["key"] for r in back.select("shard", "key").collect()}
    assert len(everywhere) > 3
    one = min(everywhere)
    (hit,) = T.lookup(index, spark.createDataFrame([(everywhere[one],)], "key long")).collect()
    assert (hit["shard"], hit["last"], hit["docs"]) == (one, one, 1)
    assert len(T.shard_paths(spark, path, {one})) == 1
    for f in (tmp_path / "ids" / "shards").glob("part-*"):  # any other shard would stop the read
        if int(f.name.split("-")[1]) != one:
            f.write_bytes(b"broken" * 9)
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    got = T.read(spark, path, spark.createDataFrame([(everywhere[one],), (-5,)], "key long")).collect()
    assert [(r["key"], r["ids"]) for r in got] == [(everywhere[one], ids(f"text {everywhere[one]} of many") + [0])]


def test_rows_without_an_id_fill_several_shards(spark, tmp_path):
    d = spark.createDataFrame([(None if i % 2 else i, f"text {i} of {i * i}") for i in range(2000)], "doc_id long, text string")
    path = str(tmp_path / "ids")
    got = sorted(((r["id"] is not None, r["id"]), r["start"], r["n_tokens"]) for r in T.digests(d, PATH, path=path).collect())
    starts = sorted((s, n) for _, s, n in got)
    assert [s for s, _ in starts] == list(np.cumsum([0] + [n for _, n in starts[:-1]])) and len(got) == 2000
    assert T.stored(spark, path).where(f"key = {T.NULL_KEY}").select("shard").distinct().count() > 1
    got = T.read(spark, path, spark.createDataFrame([(None,), (8,)], "key long")).collect()
    assert sorted(r["ids"] for r in got) == sorted(ids(f"text {i} of {i * i}") + [0] for i in range(2000) if i % 2 or i == 8)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_hash_is_minimal_and_perfect(n):
    k = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.int64)
    s = T.slots(k, *T.build(k))
    assert sorted(s.tolist()) == list(range(n))


def test_shard_table_round_trip():
    t = b"\0\0" * 7 + T.table([5, -9], [3, 4]) + b"\0\0"
    keys, counts = T.parse(t, 2)
    assert keys.tolist() == [5, -9] and counts.tolist() == [3, 4]
    with pytest.raises(ValueError):
        T.parse(b"\1" * 40, 2)
