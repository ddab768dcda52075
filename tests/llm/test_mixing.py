import re
from collections import Counter

import pytest

from tablegrist.llm import mixing as M
from tablegrist.llm.rows import located

SCHEMA = "doc_id long, text string, source string, rank int, target string"


def rows():
    out, i = [], 0
    for source, n, words in (("a", 300, 20), ("b", 60, 9), ("c", 40, 30), ("é", 1, 500), (None, 20, 5)):
        for k in range(n):
            out.append((i, " ".join(["w"] * (words + k % 7)), source, 1, "x"))
            i += 1
    out += [(i, None, "a", 1, ""), (i + 1, " \t\n", "b", 1, ""), (i + 2, "", "zero", 1, ""), (None, "a b c", "c", 1, "")]
    return out + [(7, out[7][1], "a", 1, "x")] * 3


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes):
    """Round by round, as long as a target is over three times its source."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in names if s not in capped)
        share = {s: 3 * sizes[s] if s in capped else rest * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in capped and share[s] > 3 * sizes[s]}
        if not over:
            return share
        capped |= over


def mixed(df):
    return M.mix(located(df), M.by_rank(df))


def test_targets_and_taken_words(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    out = mixed(df).collect()
    sizes = Counter()
    for _, t, s, *_ in rows():
        sizes[s] += size(t)
    want, taken = targets(sizes), Counter()
    assert any(abs(want[s] - 3 * sizes[s]) < 1e-9 for s in want if sizes[s])  # a cap is met
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * r.repeats <= 3 * r.size
        assert len(r.positions) == r.repeats and all(0 <= p < 1 for p in r.positions)
        taken[r.source] += r.taken
    assert sorted(r.size for r in out) == sorted(size(t) for _, t, *_ in rows())
    for s in sizes:
        largest = max(size(t) for _, t, q, *_ in rows() if q == s)
        assert abs(taken[s] - want[s]) <= largest / 2 + 1e-9


def test_reruns_agree(spark):
    key = ("id", "source", "taken")
    runs = [
        sorted((tuple(r[k] for k in key) for r in mixed(spark.createDataFrame(rows(), SCHEMA).repartition(n)).collect()), key=str)
        for n in (1, 5)
    ]
    assert runs[0] == runs[1]


def test_positions_follow_the_schedule(spark):
    """A source whose weight is on only in the second half comes there; one with a
    falling weight comes early for the most part."""
    df = spark.createDataFrame([(i, "a b", "xyz"[i % 3], 0, "") for i in range(1500)], SCHEMA)
    schedule = spark.createDataFrame(
        [("x", 0.0, 0.0), ("x", 0.5, 2.0), ("y", 0.0, 3.0), ("y", 0.25, 1.0), ("z", 0.0, 1.0)], "source string, since double, weight double"
    )
    out = M.mix(located(df), schedule).collect()
    at = {s: sorted(p for r in out if r.source == s for p in r.positions) for s in "xyz"}
    assert at["x"][0] >= 0.5
    early = sum(p < 0.25 for p in at["y"]) / len(at["y"])
    assert early == pytest.approx(0.5, abs=0.05)
    assert sum(p < 0.5 for p in at["z"]) / len(at["z"]) == pytest.approx(0.5, abs=0.05)


def test_training_order_repeats_rows(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    docs = located(df)
    plan = M.mix(docs, M.by_rank(df))
    fed = M.training_order(docs, plan)
    assert fed.columns == df.columns
    total = plan.groupBy().sum("repeats").first()[0]
    assert fed.count() == total


def test_large_documents_do_not_spoil_the_target(spark):
    docs = [(i, "w " * n, "s", 0, "") for i, n in enumerate([700, 900, 400, *[10] * 200])] + [(999, "w " * 1500, "t", 0, "")]
    df = spark.createDataFrame(docs, SCHEMA)
    out = [r for r in mixed(df).collect() if r.source == "s"]
    assert abs(sum(r.taken for r in out) - out[0].target) <= 10


def test_empty_table_and_empty_sources(spark):
    assert mixed(spark.createDataFrame([], SCHEMA)).collect() == []
    out = mixed(spark.createDataFrame([(1, None, "a", 0, ""), (2, "", None, 0, "")], SCHEMA)).collect()
    assert [(r.size, r.taken, r.target) for r in out] == [(0, 0, 0.0)] * 2
