import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tablegrist.llm import segment_join as J
from tablegrist.llm.components import UnionFind

SCHEMA = "doc_id long, text string, id int, node string"


def shingles(t, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, percent):
    groups, sets = UnionFind(), [(i, shingles(t, width)) for i, t, *_ in rows]
    rep = {}
    for i, s in sets:
        if i is not None and s:
            rep[s] = min(i, rep.get(s, i))
    found = list(rep)
    for k, a in enumerate(found):
        groups.find((rep[a], k))
        for j, b in enumerate(found[:k]):
            if 100 * len(a & b) >= percent * len(a | b):
                groups.join((rep[a], k), (rep[b], j))
    at = {s: k for k, s in enumerate(found)}
    return sorted(
        ((i, len(s), None if i is None else groups.find((rep[s], at[s]))[0] if s else i) for i, s in sets), key=str
    )


def got(df, **options):
    return sorted((tuple(r) for r in J.jaccard_components(df, **options).collect()), key=str)


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for n, edits, size in ((40, 2, 80), (30, 4, 120), (30, 8, 100), (9, 0, 50), (3, 0, 3), (60, 1, 40), (60, 1, 12), (20, 30, 900)):
        words = rng.choices(vocabulary, k=size)
        for k in range(n):
            w = list(words)
            for _ in range(rng.randrange(edits + 1) if k else 0):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((i, " ".join(w[rng.randrange(2):]), 1, "x"))
            i += 1
    words = rng.choices(vocabulary, k=200)
    rows += [(i + k, " ".join(words[k : k + 60]), 1, "x") for k in range(0, 100, 2)]  # a chain
    passage = rng.choices(vocabulary, k=40)
    rows += [(i + 200 + k, " ".join(passage + rng.choices(vocabulary, k=rng.randrange(40))), 1, "x") for k in range(40)]
    rng.shuffle(rows)
    return rows + [
        (2000, None, 1, "x"), (2001, " \n", 1, "x"), (2002, "One", 1, "x"), (2003, "one", 1, "x"), (2004, "ONE\x0bone", 1, "x"),
        (2005, "É one", 1, "x"), (2006, "é one", 1, "x"), (2007, "long " * 50_000 + "end", 1, "x"),
        (2008, "LONG " * 49_000 + "end", 1, None), (None, rows[0][1], 1, "x"), (None, None, None, None),
        (3, "another text under an id that exists", 1, "x"), (3, "another text under an id that exists", 1, "x"),
        (2010, "another text under an id that exists", 1, "x"),
    ]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (1, 60)])
def test_brute_force(spark, width, percent):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df, width=width, percent=percent) == brute(rows, width, percent)


def test_blocks_and_rounds(spark, monkeypatch):
    """Buckets of several blocks, and components compared in several rounds."""
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "AT_FIRST", 1)
    monkeypatch.setattr(J, "NEAREST", 1)
    rows = corpus(6)
    assert got(spark.createDataFrame(rows, SCHEMA), width=2, percent=80) == brute(rows, 2, 80)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None, 1, ""), (2, "", 1, "")], SCHEMA)) == [(1, 0, 1), (2, 0, 2)]
    with pytest.raises(ValueError):
        J.jaccard_components(spark.createDataFrame([], SCHEMA), percent=20)


@pytest.mark.parametrize("percent", [50, 85, 99, 100])
def test_lookups_find_every_similar_pair(percent):
    """Whatever each set gives up, some lookup of either finds the other."""
    rng = np.random.default_rng(percent)
    of = J.Bands(percent, 4000)
    assert (of.first[1:-1] * percent <= 100 * of.first[2:]).all()
    for _ in range(300):
        size = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = a[rng.random(len(a)) < rng.uniform(percent / 100, 1)]
        b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, 2 + size * (100 - percent) // 100))).astype(np.uint64)]))
        if not len(b) or not J.alike(a, b, percent):
            continue
        small, large = sorted((a, b), key=len)
        band = of.of(np.array([len(small), len(large)]))
        assert band[0] == band[1] or band[0] == band[1] - 1 and of.also_below(np.array([len(large)]))[0]
        (e, w, n), (f, v, k) = J.segment_keys([small, large], np.array([band[0], band[0]]), of)
        # The weight of lookups that meet, of segments as they are and of neighbourhoods.
        met = 0
        for s in range(len(e)):
            near = s < of.neighboured[band[0]]
            mine, others = (w[:n], v[:k]) if s == 0 else (w[n:], v[k:])
            if e[s] == f[s]:
                met += 2 if near else 1
            elif near and (e[s] in others or f[s] in mine):
                met += 1
        assert met > of.spare[band[0]]


def test_sketches_are_below_the_distance():
    rng = np.random.default_rng(3)
    for _ in range(200):
        u = np.unique(rng.integers(0, 2**63, int(rng.integers(2, 700))).astype(np.uint64))
        a, b = u[rng.random(len(u)) < 0.8], u[rng.random(len(u)) < 0.8]
        for bits in (64, 1024):
            far = np.bitwise_count(J.odd_sketch(a, bits) ^ J.odd_sketch(b, bits)).sum(axis=1)
            assert len(far) == J.SKETCHES and far.max() <= len(np.setxor1d(a, b))


def test_near_pairs_of_two_sides():
    sets = [np.arange(1, 101, dtype=np.uint64) * np.uint64(7919), np.arange(3, 103, dtype=np.uint64) * np.uint64(7919)]

    def both(group, *members, asks=True, unit=0):
        for left in (False, True):
            for i, s in members:
                yield {"bucket": group, "i": 0, "j": 0, "left": left, "id": i, "label": i, "unit": unit, "asks": asks, "n": 100,
                       "sketch": J.odd_sketch(sets[s], 128).tobytes()}

    def pairs(*rows):
        return [tuple(p[:2]) for p in J.near_pairs(pa.Table.from_pylist(list(rows)), 90, 8).T.tolist()]

    assert pairs(*both(7, (1, 0), (2, 1)), *both(8, (3, 0), (4, 1))) == [(2, 1), (4, 3)]
    assert pairs(*both(7, (1, 0), (2, 1), asks=False)) == []
    assert pairs(*both(7, (1, 0), (2, 1), unit=-1)) == []


def test_a_pair_counts_in_the_first_bucket_both_ask_in():
    """Rows of single blocks are on both sides; the buckets of the pair are 7 and 9."""
    s = np.arange(1, 101, dtype=np.uint64) * np.uint64(7919)

    def pairs(bucket, *placed):
        rows = [{"bucket": bucket, "i": -1, "j": 0, "left": True, "id": k, "label": k, "unit": 0, "asks": True, "n": 100,
                 "sketch": J.odd_sketch(s, 128).tobytes()} for k in range(1, len(placed) + 1)]
        table = pa.Table.from_pylist(rows)
        for at, name in enumerate(("in", "met")):
            table = table.append_column(name, pa.array([p[at] for p in placed], pa.list_(pa.int64())))
        return [tuple(p[:2]) for p in J.near_pairs(table, 90, 8).T.tolist()]

    both = ([7, 9], [7, 9])
    assert pairs(7, both, both) == [(2, 1)]
    assert pairs(9, both, both) == []
    # One that asks is enough where the other is, too.
    assert pairs(9, both, ([7, 9], [9])) == pairs(9, ([7, 9], []), both) == []
    # None of them asks in 7, or one of them is not there.
    assert pairs(9, ([7, 9], [9]), ([7, 9], [9])) == pairs(9, both, ([9], [9])) == [(2, 1)]
    assert pairs(7, ([7], [7]), ([7], [7]), ([-3, 7], [-3, 7])) == [(2, 1), (3, 1), (3, 2)]


def test_pairs_of_near_copies_are_made_about_once(spark, monkeypatch):
    """Two hundred sets with a common part meet in many buckets each."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(200):
        own = list(words)
        for at in rng.sample(range(400), 8):
            own[at] = f"x{i}.{at}"
        rows.append((i, " ".join(own), 1, "x"))
    made = []
    monkeypatch.setattr(J, "components", lambda links: spark.createDataFrame([], "node bigint, label bigint"))
    monkeypatch.setattr(J, "_settled", lambda links, survivors, *rest: made.append(survivors) or links)
    grouped = type(spark.range(1)).groupBy
    counted = []

    def noted(self, *cols):
        if list(cols) == ["a", "b"]:
            counted.append(self.count())
        return grouped(self, *cols)

    monkeypatch.setattr(type(spark.range(1)), "groupBy", noted)
    monkeypatch.setattr(J, "_apart_pairs", lambda pairs, labels: pairs.limit(0))
    J.jaccard_components(spark.createDataFrame(rows, SCHEMA), width=4, percent=70).count()
    assert made and counted[0] <= 2 * made[0].count()


def test_candidates_of_a_set_are_bounded():
    """Forty sets of one bucket, all alike and each a component of its own."""
    base = np.arange(1, 201, dtype=np.uint64) * np.uint64(7919)
    rows = [{"bucket": 7, "i": -1, "j": 0, "left": True, "id": k, "label": k, "unit": 0, "asks": True, "n": 199,
             "sketch": J.odd_sketch(np.delete(base, k), 512).tobytes()} for k in range(40)]
    found = J.near_pairs(pa.Table.from_pylist(rows), 90, 2)
    assert found.shape[1] <= 2 * 40 and (found[3] == 1).all()
    assert set(found[:2].ravel().tolist()) == set(range(40))
