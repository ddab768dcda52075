import random
import re

import numpy as np
import pytest

from tablegrist.llm import shingles as H
from tablegrist.llm import super_minhash as S
from tablegrist.llm.components import UnionFind, components

SCHEMA = "doc_id long, text string, n int, label string"


def shingles(t, width):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, percent=80):
    groups = UnionFind()
    sets = [(i, shingles(t, width)) for i, t, *_ in rows]
    for x, (i, a) in enumerate(sets):
        if i is None:
            continue
        groups.find(i)
        for j, b in sets[:x]:
            if j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                groups.join(i, j)
    out = []
    for i, a in sets:
        component = None if i is None else groups.find(i)
        out.append((i, len(a), component, i is None or i == component))
    return sorted(out, key=str)


def got(df, **options):
    out = S.near_duplicates(df, **options)
    return sorted((tuple(r) for r in out.collect()), key=str)


def family(rng, i, words, n, edits):
    """A text and copies of it with a few words replaced."""
    out = []
    for k in range(n):
        w = list(words)
        for _ in range(edits if k else 0):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        out.append((i + k, " ".join(w), 1, "x"))
    return out


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for n, edits, size in ((30, 2, 80), (12, 5, 120), (8, 8, 100), (1, 0, 50), (1, 0, 3), (25, 1, 40)):
        rows += family(rng, i, rng.choices(vocabulary, k=size), n, edits)
        i += n
    # A chain whose ends are not alike, and texts that share a passage only.
    words = rng.choices(vocabulary, k=120)
    for k in range(20):
        rows.append((i, " ".join(words[k * 3 : k * 3 + 60]), 1, "x"))
        i += 1
    passage = rng.choices(vocabulary, k=40)
    for _ in range(20):
        rows.append((i, " ".join(passage + rng.choices(vocabulary, k=30)), 1, "x"))
        i += 1
    rows += [(500, None, 1, "x"), (501, " \n", 1, "x"), (502, "One", 1, "x"), (503, "one", 1, "x"), (504, "ONE\x0bone", 1, "x"),
             (505, "É one", 1, "x"), (506, "é one", 1, "x"), (507, "long " * 50_000 + "end", 1, "x"), (508, "LONG " * 49_000 + "end", 1, "x")]
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_components_against_brute_force(spark, width):
    rows = corpus()
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3), width=width) == brute(rows, width)


def test_blocks_find_what_the_hub_does_not(spark, monkeypatch):
    """With bands of one row all texts meet, and blocks of two hold few of them."""
    monkeypatch.setattr(S, "BLOCK", 2)
    monkeypatch.setattr(S, "BANDS", 240)
    monkeypatch.setattr(S, "ROWS", 1)
    rows = corpus()
    assert got(spark.createDataFrame(rows, SCHEMA), width=2) == brute(rows, 2)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, 1, ""), (None, text, 1, ""), (3, text, 1, ""), (3, text, 1, ""), (2, text + " x", 1, "")]
    assert got(spark.createDataFrame(rows, SCHEMA), width=2) == brute(rows, 2)
    # An id with two texts: each row goes with its own text.
    rows = [(1, text, 1, ""), (5, text, 1, ""), (5, "something else entirely", 1, ""), (7, "something else entirely", 1, "")]
    assert {r[:3] for r in got(spark.createDataFrame(rows, SCHEMA), width=2)} == {(1, 29, 1), (5, 29, 1), (5, 2, 5), (7, 2, 5)}


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(empty) == []
    df = spark.createDataFrame(corpus(), SCHEMA)
    out = S.one_of_each(df, width=5)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _, _, kept in brute(corpus(), 5) if kept)


def test_signatures_are_super_minhash():
    """The batched levels give what the element-by-element algorithm gives."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100):
        elements = rng.integers(0, 2**63, n).astype(np.uint64)
        least = np.full(S.PLACES, 2**64 - 1, dtype=object)
        for e in elements:
            order = list(range(S.PLACES))
            for level in range(S.PLACES):
                r = int(S.mixed(np.array([(int(e) + (level + 1) * S._BASE) % 2**64], np.uint64))[0])
                k = level + ((r & 0xFFFFFFFF) * (S.PLACES - level) >> 32)
                order[level], order[k] = order[k], order[level]
                least[order[level]] = min(least[order[level]], (level << 32) | (r >> 32))
        assert S.signatures([elements])[0].tolist() == least.tolist()


def test_estimates_vary_less_than_independent_hashes():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(150):
        u = rng.integers(0, 2**63, 40).astype(np.uint64)
        s = S.signatures([u[:30], u[10:]])
        errors.append((s[0] == s[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < np.sqrt(0.25 / S.PLACES) * 0.9


def test_word_hashes_do_not_depend_on_the_window(monkeypatch):
    text = "".join(random.Random(3).choices(["a", "B ", "\n", "É", "  ", "word "], k=3000))
    whole = H.word_hashes(text)
    monkeypatch.setattr(H, "_WINDOW", 100)
    assert (H.word_hashes(text) == whole).all()
    assert len(whole) == len(re.findall(r"[^\x20\x09-\x0D]+", text))


def test_components_of_chains_and_stars(spark):
    chain = [(i + 1, i) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1100)]
    links = spark.createDataFrame(chain + star + [(5, 5), (None, 3)], "a long, b long").repartition(7)
    out = {r.node: r.label for r in components(links).collect()}
    assert out == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1100)}
    assert components(links.limit(0)).collect() == []


def test_a_word_of_any_length_has_one_hash(spark, monkeypatch):
    rng = random.Random(8)
    run = "".join(rng.choices("abcdefghijklmnop", k=3 << 20))
    other = run[: 11 * H._WINDOW] + "".join(rng.choices("qrstuvwxyz", k=H._WINDOW))
    rows = [(1, run, 1, "x"), (2, other, 1, "x"), (3, run.upper() + " ", 1, "x"), (4, f"a {run} b", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, width=2) == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False), (4, 2, 4, True)]
    text = "".join(rng.choices("ab\t ", weights=[6, 6, 1, 1], k=3000))
    whole = H.word_hashes(text)
    assert len(whole) == len(text.split())
    for window in (1, 2, 7, 64):
        monkeypatch.setattr(H, "_WINDOW", window)
        assert (H.word_hashes(text) == whole).all()


def test_words_of_a_regular_build_stay_apart(spark):
    """Words whose letters cancel out in a polynomial modulo 2^64."""
    ab = "a"
    while len(ab) < 1024:
        ab += ab.translate({97: 98, 98: 97})
    ba = ab.translate({97: 98, 98: 97})
    assert H.word_hashes(ab)[0] != H.word_hashes(ba)[0]
    rows = [(1, ab, 1, "x"), (2, ba, 1, "x"), (3, ab, 1, "x")]
    assert got(spark.createDataFrame(rows, SCHEMA), width=2) == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False)]


def test_texts_side_by_side(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["a", "B ", "\n", "É", "  ", "word "], k=rng.randrange(40))) for _ in range(50)] + [None, "", " ", "x" * 300]
    for window in (1 << 18, 100):
        monkeypatch.setattr(H, "_WINDOW", window)
        for width in (1, 3):
            for got, text in zip(H.shingle_sets(texts, width), texts):
                assert got.tolist() == H.shingle_set(text, width).tolist()


def test_python_gets_few_rows_at_once(spark, monkeypatch):
    """Where batches of ten thousand texts are sent, both sides hold them whole."""
    slices, key = S.slices, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def short(batch):
        assert batch.num_rows <= 8
        return slices(batch)

    before = spark.conf.get(key)
    monkeypatch.setattr(S, "BATCH", 8, raising=False)
    monkeypatch.setattr(S, "slices", short)
    rows = corpus()
    assert got(spark.createDataFrame(rows, SCHEMA).coalesce(1), width=5) == brute(rows, 5)
    assert spark.conf.get(key) == before
