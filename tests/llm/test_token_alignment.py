import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tablegrist.llm import token_alignment as T
from tablegrist.llm.perfect_hash import PerfectHash

SCHEMA = "doc_id long, text string, pair string, n int"
TOOLS = T.Tokenizers(public_tokenizers.path(T.A_FILE), public_tokenizers.path(T.B_FILE))


def direct(text):
    """Both whole token lists, and groups by a walk over the bytes."""
    if not text:
        return None
    a = TOOLS.a.encode(" " + text, add_special_tokens=False).ids
    b = TOOLS.b.encode(text)
    if not TOOLS.spells(text, a, b):
        return None
    groups, i, j, x, y = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            groups[-1][0].append(a[i])
            x += len(TOOLS.a_bytes[a[i]])
            i += 1
        else:
            groups[-1][1].append(b[j])
            y += len(TOOLS.b_bytes[b[j]])
            j += 1
        if x == y and (i < len(a) or j < len(b)):
            groups.append(([], []))
    return a, b, groups


def brute(rows):
    found = [(r[0], direct(r[1])) for r in rows]
    counts = Counter((g[0][-1], g[1][-1]) for _, f in found if f for g in f[2])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, f in found:
        if not f:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(g[0][-1], g[1][-1]) for g in f[2]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        out.append((i, len(f[0]), len(f[1]), len(f[2]), len(links), sum(counts[p] == best[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    out = [(r["doc_id"], r["text"], "x", 1) for r in docs]
    return out + [
        (None, None, None, None), (-1, "", "", 1), (-2, " ", "", 1), (-2, " ", "", 1), (-3, "a\u2581b c", "x", 1),
        (-4, "<s> </s> <|endoftext|> <0x0A>  two   three\n four \n\n five ", "x", 1), (-5, "naïve 日本語 🙂 \x00 \t end", "x", 1),
        (-6, "long " * 20_000 + "x" * 20_000, "x", 1),
    ]


def test_brute_force(spark):
    data = rows(spark)
    expected = brute(data)
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    assert sorted((tuple(r) for r in T.aligned_documents(df).collect()), key=str) == expected
    assert sorted((tuple(r) for r in T.aligned_documents(df, most_bytes=0).collect()), key=str) == expected


def test_small_limits(spark, monkeypatch):
    """Parts are dropped and met again, vectors have several slices and shards."""
    data = rows(spark)[:60] + rows(spark)[-6:-1]
    monkeypatch.setattr(T, "PARTS", 50)
    monkeypatch.setattr(T, "GROUP", 2000)
    monkeypatch.setattr(T, "CALL", 300)
    monkeypatch.setattr(T, "SLICE", 64)
    monkeypatch.setattr(T, "SHARD", 100)
    got = T.aligned_documents(spark.createDataFrame(data, SCHEMA).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(data)


def test_every_text_is_read_once(spark):
    """The counts come from the links that were written, not from the texts again."""
    from pyspark.sql import functions as F

    read, data = spark.sparkContext.accumulator(0), rows(spark)[:40]

    @F.udf("string")
    def noted(text):
        read.add(1)
        return text

    df = spark.createDataFrame(data, SCHEMA).withColumn("text", noted("text"))
    assert sorted((tuple(r) for r in T.aligned_documents(df).collect()), key=str) == brute(data)
    assert read.value == 40


@pytest.mark.parametrize("narrow", [True, False])
def test_packed_links(narrow):
    """Texts without links among others, ids in 16 bits or whole."""
    parts = T.Parts(TOOLS)
    assert parts.narrow
    parts.narrow = narrow
    parts.clear()
    texts = [[], ["one", "two"], ["one"], [], ["naïve", "日本"]]
    parts.add(texts)
    n_a, n_b, n_links, digests, pairs = parts.rows(texts)
    batch = T.pa.RecordBatch.from_arrays([n_links, pairs], ["n_links", "pairs"])
    ((i, j, n, found),) = T.links_of(batch)
    expected = [direct(" ".join(t)) for t in texts]
    assert (i, j, n.tolist()) == (0, 5, [len(e[2]) if e else 0 for e in expected])
    assert found.tolist() == [g[0][-1] << 32 | g[1][-1] for e in expected if e for g in e[2]]
    assert [len(e[0]) if e else 0 for e in expected] == n_a.to_pylist()
    assert [len(e[1]) if e else 0 for e in expected] == n_b.to_pylist()


def test_empty(spark):
    out = T.aligned_documents(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns[0] == "doc_id"


@settings(max_examples=300, deadline=None)
@example("\u2581a b")
@example("a \n b  c\n  d \x1c e\x85 f")
@given(st.text(st.sampled_from(" \n\tab'sé.1\u3000\xa0\x1c\x85🙂"), max_size=40))
def test_parts_are_the_whole(text):
    """Tokens of the parts, one after the other, are those of the whole text."""
    a, b = TOOLS.encoded(T.parts_of(text))
    if text:
        assert sum(a, []) == TOOLS.a.encode(" " + text, add_special_tokens=False).ids
        assert sum(b, []) == TOOLS.b.encode(text)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**47, n))
    h = PerfectHash(keys)
    assert sorted(h.find(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(np.arange(1000) * 7919, keys)
    assert (h.find(others) == -1).all()
