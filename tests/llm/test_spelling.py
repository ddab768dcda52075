import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tablegrist.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n int"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, one_in=97):
    counts = Counter()
    for i, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w if h % one_in else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    form, out = {}, []
    nears = {w: [v for v in words if near(w, v)] for w in words}
    for w in words:
        best = min(nears[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(nears[w]), form[w] and words[form[w]]))
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in S.spelling_variants(df, **options).collect())


def corpus():
    rng = random.Random(11)
    alphabet = "abcéÿ÷"
    stems = ["".join(rng.choices(alphabet, k=rng.randrange(3, 12))) for _ in range(40)]
    rows = []
    for i in range(120):
        words = []
        for s in rng.choices(stems[: 5 + i // 4], k=60):
            if rng.random() < 0.3:
                at = rng.randrange(len(s))
                s = rng.choice([s[:at] + s[at + 1 :], s[:at] + rng.choice(alphabet) + s[at:], s[:at] + rng.choice(alphabet) + s[at + 1 :]])
            words.append(s.upper() if rng.random() < 0.1 else s)
        rows.append((i % 100, rng.choice([" ", "-", "1"]).join(words), "x", 1))
    long = "prefixes" * 5_000
    rows += [(None, "abcab " * 3, None, None), (7, None, None, None), (8, "", "", 1), (9, " \n1", "", 1),
             (10, f"{long}a {long}b {long} " * 3, "x", 1), (11, "aaaaaa aaaaaaa aaaaa " * 3, "x", 1)]
    return rows


def test_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for one_in in (97, 3):
        expected = brute(rows, one_in)
        assert got(df, one_in=one_in) == expected
    assert any(f and r != f for _, f, r, *_ in expected)


def test_chain_and_ties(spark):
    words = [("abcde", 3), ("abcdf", 6), ("abcdg", 6), ("abcdgg", 12), ("abcdggg", 30), ("zzzzz", 3), (None, 4), ("nulls", None)]
    df = spark.createDataFrame(words, "word string, n long")
    out = {r["word"]: (r["form"], r["root"], r["n_near"], r["form_n"]) for r in S.variants(df).collect()}
    assert out == {
        "abcde": ("abcdf", "abcdf", 2, 6), "abcdf": (None, "abcdf", 2, None), "abcdg": ("abcdgg", "abcdggg", 3, 12),
        "abcdgg": ("abcdggg", "abcdggg", 2, 30), "abcdggg": (None, "abcdggg", 1, None), "zzzzz": (None, "zzzzz", 0, None),
    }


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_windows(monkeypatch):
    monkeypatch.setattr(S, "WINDOW", 7)
    text = "Ab cdefghijklmnop q1rstuvwxyz É×÷ over the end"
    assert [w for part in S.runs(text) for w in part] == S.WORD.findall(text.translate(S._LOWER))


@settings(max_examples=30, deadline=None)
@given(st.sets(st.text("abÿ", min_size=1, max_size=12), max_size=30))
def test_common_pairs_are_neighbours(words):
    """Pairs of beginnings and endings meet exactly for neighbours."""
    for a in words:
        for b in words:
            skip = lambda w: {(w[:i], w[i + 1 :]) for i in range(len(w))}
            gap = lambda w: {(w[:i], w[i:]) for i in range(len(w) + 1)}
            assert (a != b and bool(skip(a) & skip(b) | gap(a) & skip(b) | skip(a) & gap(b))) == near(a, b)
