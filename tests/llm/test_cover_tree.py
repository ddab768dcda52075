import math
from fractions import Fraction

import numpy as np
import pytest

from tablegrist.llm.cover_tree import CoverTree, Search, top_k

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, k, every):
    vectors = {}
    for i, v, _ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        vectors.setdefault(i, set()).add(tuple(math.floor(256 * float(np.float32(x))) for x in v))
    out = []
    for i, own in vectors.items():
        if i % every:
            continue
        q = min(own)
        scores = {}
        for j, others in vectors.items():
            found = [sum(a * b for a, b in zip(q, w)) for w in others if len(w) == len(q)]
            if j != i and found:
                scores[j] = max(found)
        best = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
        out += [(i, r + 1, j, s) for r, (j, s) in enumerate(best)]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in top_k(df, **options).collect())


@pytest.mark.parametrize("n,spread", [(300, 1.0), (700, 0.05)])
def test_against_brute_force(spark, n, spread):
    rng = np.random.default_rng(n)
    centers = rng.normal(0, 1, (5, 6))
    rows = [(int(i), [float(x) for x in centers[i % 5] + rng.normal(0, spread, 6)], "a") for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(df, k=5, every=7) == brute(rows, 5, 7)


def test_ties_repeats_and_unfit_vectors(spark):
    same = [0.5, -0.25]
    rows = [(i, same, None) for i in range(0, 40)]
    rows += [(0, same, None), (3, same, None), (50, None, None), (100, [], None), (150, [None, 1.0], None),
             (200, [float("nan"), 1.0], None), (250, [float("inf"), 1.0], None), (None, same, None),
             (300, [1.0, 2.0, 3.0], None), (350, [1.0, 0.0, -3.0], None), (400, [9.0, 9.0], None), (400, [0.1, 0.1], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, k=5, every=50) == brute(rows, 5, 50)


def test_few_and_no_candidates(spark):
    one = spark.createDataFrame([(0, [1.0], None)], SCHEMA)
    assert got(one) == []
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(0, [1.0], None), (1, [2.0], None)], SCHEMA)) == [(0, 1, 1, 256 * 512)]


def test_radii_cover_and_buckets_hold_every_point():
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(0, 50, (900, 8)))
    tree = CoverTree(points)
    below = Search(tree, np.arange(900), 3).below
    assert sorted(below[tree.root]) == list(range(900))
    for node in range(len(tree.center)):
        far = np.linalg.norm(points[below[node]] - points[tree.center[node]], axis=1)
        assert far.max() <= tree.radius[node] + 1e-6


def test_pruning_leaves_out_far_blocks():
    rng = np.random.default_rng(4)
    near, far = rng.integers(90, 110, (500, 4)), -rng.integers(90, 110, (500, 4))
    search = Search(CoverTree(near[:64]), np.arange(64) + 10_000, 5)
    search.add(CoverTree(near), np.arange(500))
    scored = []
    search._score = lambda *a: scored.append(a)
    search.add(CoverTree(far), np.arange(500) + 1000)
    assert not scored


@pytest.mark.parametrize("kind,scale", [("float", 5e3), ("float", 1e6), ("double", 3e12), ("double", 1e25), ("double", 1e200), ("double", 1.7e308)])
def test_every_finite_vector_takes_part(spark, kind, scale):
    rng = np.random.default_rng(6)
    whole = lambda x: x.numerator * 256 // x.denominator
    values = rng.uniform(-1, 1, (240, 4)) * np.where(np.arange(240) % 3, 1.0, scale)[:, None]
    values[100:110] = values[99]  # ties of large scores
    rows = [(i, [float(np.float32(x)) if kind == "float" else float(x) for x in v]) for i, v in enumerate(values)]
    exact = [[whole(Fraction(x)) for x in v] for _, v in rows]
    want = []
    for q in range(0, 240, 5):
        scores = [(-sum(a * b for a, b in zip(exact[q], exact[d])), d) for d in range(240) if d != q]
        want += [(q, r + 1, d, -s if -(2**63) <= -s < 2**63 else None) for r, (s, d) in enumerate(sorted(scores)[:5])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    assert got(df, k=5, every=5) == want
