import pytest

from hazegrid.llm import mixing as M
from tests.llm.helpers import clashing, empty, odd, odd_rows


def slow_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, left, open_, out = 1.5 * sum(sizes.values()), 1.5 * sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return {**out, **share}, total
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 5000, None: 7}, {"a": 5}, {"a": 3, "b": 3, "c": 3}, {str(i): i * i * 10 + 1 for i in range(30)}])
def test_targets_equal_repeated_sharing(spark, sizes):
    got = {r["source"]: r["target"] for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, n long")).collect()}
    want, total = slow_targets(sizes)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(total)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_schedule_takes_each_target_and_mixes_evenly(spark, block):
    goal = spark.createDataFrame([("a", 300, 600.0), ("b", 1000, 411.5), ("c", 90, 130.0), (None, 5, 0.0)], "source string, n long, target double")
    rows = M.schedule(goal, block).collect()
    assert len({r["slot"] for r in rows}) == len(rows)
    for s, n, t in (("a", 300, 600), ("b", 1000, 411), ("c", 90, 130)):
        mine = sorted((r for r in rows if r["source"] == s), key=lambda r: r["slot"])
        assert sum(r["stop"] - r["start"] for r in mine) == t
        # in the order of slots the source's stream is read on from end to start
        assert [r["pass"] * n + r["start"] for r in mine] == sorted(r["pass"] * n + r["start"] for r in mine)
        for k in range(10, len(rows), 10):  # any head of the mix holds the source's share
            top = max(r["slot"] for r in rows)
            head = sum(1 for r in mine if r["slot"] <= top * k / len(rows))
            assert abs(head - len(mine) * k / len(rows)) <= 6


def test_amounts_stay_under_twice_the_size_and_rerun(spark):
    d = spark.createDataFrame([(i, " ".join(["w"] * (i % 50)), "en", f"s{i % 7 % 4}", 0) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    a, b = ({r["id"]: r for r in M.amounts(x, block=16).collect()} for x in (d, d.repartition(5)))
    assert a == b and len(a) == 400
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in a.values())
    per = {}
    for r in a.values():
        per.setdefault((r["n"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(v) - t) <= 1 for (_, t), v in per.items())


def test_mixed_rows_hold_the_words_taken(spark):
    d = clashing(odd(spark), "a", "pass", "_takes", "n", "slot")
    out = M.mixed(d, block=32)
    rows = out.collect()
    assert out.columns == d.columns
    words = sum(len((r["text"] or "").split(" ")) for r in rows if r["doc_id"] == 6)
    taken = {r["id"]: r["taken"] for r in M.amounts(d, block=32).collect()}
    assert words == taken[6]
    assert M.amounts(odd(spark)).count() == len(odd_rows())
    assert M.mixed(empty(spark)).count() == 0 and M.amounts(empty(spark)).count() == 0


def test_mix_is_written_in_the_order_of_its_slots(spark, tmp_path):
    d = spark.createDataFrame([(i, " ".join(["w"] * 40), "en", "abc"[i % 3], 0) for i in range(600)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = M.mixed(d, slot="at", block=16).orderBy("at").collect()
    first = {r["id"]: r["first_slot"] for r in M.amounts(d, block=16).collect()}
    seen = set()
    for r in rows:
        if r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            assert r["at"] == first[r["doc_id"]]
    share = {s: sum(r["source"] == s for r in rows) / len(rows) for s in "abc"}
    for k in range(60, len(rows), 60):  # every stretch holds the sources in proportion
        assert all(abs(sum(r["source"] == s for r in rows[k - 60:k]) / 60 - share[s]) < 0.15 for s in "abc")
    M.write_mixed(d, str(tmp_path / "mix"), block=16)
    back = [r["doc_id"] for f in sorted((tmp_path / "mix").glob("part-*")) for r in spark.read.parquet(str(f)).collect()]
    assert sorted(back) == sorted(r["doc_id"] for r in rows)
