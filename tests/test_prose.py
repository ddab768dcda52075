"""Text, names, questions, grids, boilerplate and history."""

import math
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablegrist.functions import questions as Q
from tablegrist.functions import text as X
from tablegrist.operators import boilerplate as B
from tablegrist.operators import crosstable as CT
from tablegrist.operators import entities as E
from tablegrist.operators import grids as G
from tablegrist.operators import history as H


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_settled_characters_are_those_nfkc_leaves_alone():
    for c in map(chr, range(0x3000)):
        if not re.match(X.UNSETTLED, c):
            assert unicodedata.normalize("NFKC", c) == X.REPLACED.get(c, c) and not unicodedata.combining(c)


def test_nfkc_sends_only_unsettled_texts_to_python(spark):
    values = ["plain", "d\u00e9j\u00e0\u00a0vu\u2026 \u2013 \u201cx\u201d", "e\u0301\u00a0\u2026", "\uff11\ufb01", "a\u2009b", "", None] + ["\u00b2"] * 200
    assert apply(spark, X.nfkc, values) == [v and unicodedata.normalize("NFKC", v) for v in values]
    assert [bool(re.search(X.UNSETTLED, v or "")) for v in values[:7]] == [False, False, True, True, False, False, False]


def test_normalise_text(spark):
    cases = {
        "a b c": "a b c",
        "﻿x​y": "xy",
        "‘q’ “z”": "'q' \"z\"",
        "1–2—3": "1-2-3",
        "wait…": "wait...",
        "１２": "12",
        "expense-\nratio": "expenseratio",
        "x-\n y": "x-\n y",
        "a  \t\nb": "a\nb",
        "a\n\n\n\n\nb": "a\n\nb",
        "a\n\nb": "a\n\nb",
        "ﬁne": "fine",
        "": "",
    }
    assert apply(spark, X.normalise_text, cases) == list(cases.values())
    assert apply(spark, X.normalise_text, [None]) == [None]


def test_canonical_name(spark):
    cases = {
        "HDFC Top-100 Fund": "hdfc top 100",
        "The  Plan of A Scheme": "of",
        "  Mid-Cap: Growth (Direct) ": "mid cap growth direct",
        "Funding the planet": "funding planet",
        "ＡＢC": "abc",
        "fund": "",
        None: "",
    }
    assert apply(spark, X.canonical_name, cases) == list(cases.values())


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=20, max_size=40))
def test_canonical_name_is_idempotent(spark, values):
    once = apply(spark, X.canonical_name, values)
    assert apply(spark, X.canonical_name, once) == once


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \t\n\r\x0b\x0c\x1c\x85\xa0  　abé", max_size=25), min_size=30, max_size=60))
def test_blanks_and_lines_follow_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    got = df.select(X.strip("v"), X.strip_cell("v"), X.words("v"), X.lines("v")).collect()
    for v, (a, b, w, ls) in zip(values, got):
        assert a == v.strip() and b == v.strip()
        assert w == v.split()
        assert ls == (v.splitlines() or [""])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 60), st.integers(1, 12), st.integers(0, 14))
def test_word_windows(spark, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([(" ".join(words),)], "t string").select(X.words("t").alias("w"))
    got = df.select(X.window_bodies("w", size, overlap)).first()[0]
    step = max(1, size - overlap)
    assert len(got) == math.ceil(n / step)
    assert got == [" ".join(words[s : s + size]) for s in range(0, n, step)]


def test_excerpt(spark):
    assert apply(spark, lambda c: X.excerpt(c, 3), ["a b c", "a b c d", " "]) == ["a b c", "a b c...", ""]


def test_plain_numbers_read_like_python(spark):
    values = [0.1, 100.0, 1e7, 12345678.9, 123456789012.25, 1e15, 0.0001, 0.00012345, -2.5e8, 0.001, 3.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    assert [r[0] for r in df.select(X.plain_number(F.col("v"))).collect()] == [repr(v) for v in values]


QUESTIONS = [
    ("List all schemes", "list_distinct", [], None),
    ("Funds with NAV greater than 100", "numeric_threshold", [], (">", 100.0)),
    ("Top 5 funds by 1-year return", "aggregate", ["Top 5"], None),
    ("What is the NAV of HDFC Top 100?", "point_lookup", ["HDFC Top 100"], None),
    ("Hello there", "qualitative", [], None),
    ("What about HDFC Balanced Advantage Fund, doesnt that have the highest AUM?", "point_lookup", ["HDFC Balanced Advantage Fund"], None),
    ("HDFC Top 100 Fund has the highest AUM, right?", "aggregate", ["HDFC Top 100 Fund"], None),
    ("Show me funds where NAV regular is less than 100", "numeric_threshold", [], ("<", 100.0)),
    ("funds with sharpe ratio above 1.5", "numeric_threshold", [], (">", 1.5)),
    ("AUM > 5,000", "numeric_threshold", [], (">", 5000.0)),
    ("AUM >= 7", "numeric_threshold", [], (">=", 7.0)),
    ("size over 1.2.3", "qualitative", [], None),
    ("Return by year", "trend", [], None),
    ("Show me everything", "filter_rows", [], None),
    ("What Big Fund and Big Fund", "point_lookup", ["Big Fund", "Big Fund"][:1], None),
]


def test_question_plans(spark):
    df = spark.createDataFrame([(i, q[0]) for i, q in enumerate(QUESTIONS)], "i int, q string")
    got = df.withColumns(Q.plan_columns("q")).orderBy("i").collect()
    for r, (text, intent, phrases, threshold) in zip(got, QUESTIONS):
        assert r["intent"] == intent, text
        assert r["entity_phrases"] == phrases, text
        found = (r["threshold_op"], r["threshold_value"]) if r["threshold_op"] else None
        assert found == threshold, text
    windows = apply(spark, lambda c: Q.trend_window(c, Q.intent(c, Q.entity_phrases(c))), ["trend by year", "trend by month", "trend", "one year"])
    assert windows == ["365d", "90d", None, None]


def test_cell_predicates(spark):
    got = apply(spark, Q.cell_predicates, ["category = Large Cap", 'Benchmark: "Nifty 50"', "nothing here", "x, p_type is SMALL"])
    assert [[tuple(p) for p in ps] for ps in got] == [
        [("category", "Large Cap")], [("Benchmark", "Nifty 50")], [], [("p_type", "SMALL")],
    ]


def test_capabilities(spark):
    rows = [("average size", "auto", True, True), ("show me rows", "auto", True, True), ("hello", "auto", False, False),
            ("average", "chat", False, False), ("hello", "aggregate", True, False), ("hello", "query", False, True)]
    df = spark.createDataFrame([(i, q, m) for i, (q, m, _, _) in enumerate(rows)], "i int, q string, m string").orderBy("i")
    for has in (True, False):
        args = (F.col("q"), F.col("m"), F.lit(has))
        got = [tuple(r) for r in df.select(Q.wants_aggregate(*args), Q.wants_rows(*args)).collect()]
        assert got == [(a and has, b and has) for _, _, a, b in rows]


def test_column_resolution(spark):
    t = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0)], "`Scheme Name` string, `NAV Regular` double, `NAV Direct` double, `Daily AUM (Cr.)` double, `1-Year Return` double")
    asked = spark.createDataFrame(
        [(1, "NAV regular below 5"), (2, "aum over 9"), (3, "scheme name"), (4, "NAV please"), (5, "1 year return")], "query_id int, question string"
    )
    got = {r["query_id"]: r["column"] for r in CT.resolve_columns(asked, CT.column_catalogue({"t": t})).collect()}
    assert got == {1: "NAV Regular", 2: "Daily AUM (Cr.)", 4: "NAV Regular", 5: "1-Year Return"}


@pytest.fixture(scope="module")
def two_tables(spark):
    ddl = "name string, `Return 1 Year (%)` double"
    a = spark.createDataFrame([("A", 10.0), ("B", 30.0)], ddl)
    b = spark.createDataFrame([("C", 25.0), ("D", 5.0)], ddl)
    c = spark.createDataFrame([("x", "y")], "name string, other string")
    return {"a.csv": a, "b.csv": b, "c.csv": c}, {"a.csv": "name", "b.csv": "name", "c.csv": "name"}


def test_threshold_search(two_tables):
    got = CT.threshold_search("Funds with 1 year return above 20", *two_tables)
    assert sorted((r["Source File"], r["name"]) for r in got.rows.collect()) == [("a.csv", "B"), ("b.csv", "C")]
    assert {r["table"]: r["rows"] for r in got.counts.collect()} == {"a.csv": 1, "b.csv": 1}
    one = CT.threshold_search("return above 27", *two_tables)
    assert "Source File" not in one.rows.columns and [r["name"] for r in one.rows.collect()] == ["B"]
    none = CT.threshold_search("return above 99", *two_tables)
    assert none.rows.count() == 0 and none.counts.count() == 2
    assert CT.threshold_search("hello", *two_tables) is None
    assert CT.threshold_search("sharpe above 2", *two_tables) is None


def test_entity_resolution(spark):
    aliases = spark.createDataFrame(
        [("hdfc top 100", "HDFC Top 100 Fund"), ("big growth", "Old Name")], "canonical_id string, alias string"
    )
    ids = spark.createDataFrame([("axis",)], "canonical_id string")
    asked = spark.createDataFrame(
        [(1, ["HDFC Top 100 Fund Direct Growth"]), (2, ["old name"]), (3, ["Axis Bluechip"]), (4, ["Nobody"]),
         (5, ["Axis", "HDFC Top 100"]), (6, [])], "query_id int, entity_phrases array<string>"
    )
    got = {r["query_id"]: r["canonical_id"] for r in E.resolve_entities(asked, aliases, ids).collect()}
    assert got == {1: "hdfc top 100", 2: "big growth", 3: "axis", 4: None, 5: "hdfc top 100", 6: None}


def test_aliases(spark):
    df = spark.createDataFrame([("Big Fund",), ("big  fund",), ("Big Fund",), (None,), ("the",)], "n string")
    lists = E.alias_lists(E.register_aliases(E.alias_table(df, "n"), E.alias_table(df, "n"))).collect()
    assert [(r["canonical_id"], r["aliases"]) for r in lists] == [("big", ["Big Fund", "big  fund"])]


# --- grids ---


def grid(spark, *tables):
    rows = [(t, i, cells) for t, table in enumerate(tables) for i, cells in enumerate(table)]
    return spark.createDataFrame(rows, "table_id int, row int, cells array<string>")


def back(df):
    out = {}
    for r in df.orderBy("table_id", "row").collect():
        out.setdefault(r["table_id"], []).append(r["cells"])
    return out


def test_clean_grids(spark):
    got = back(G.clean_grids(grid(
        spark, [["  a ", " b "], ["c", "1"]], [["a", "n"], ["b", "x\ny  z"]], [["a", "b"], ["", ""], ["c", "d"]],
        [["a", "", "b"], ["c", " ", "d"]], [["a", "b", "c"], ["d", "e"]], [["a", None], [None, "b"]], [["", " "]],
    )))
    assert got == {
        0: [["a", "b"], ["c", "1"]], 1: [["a", "n"], ["b", "x y z"]], 2: [["a", "b"], ["c", "d"]],
        3: [["a", "b"], ["c", "d"]], 4: [["a", "b", "c"], ["d", "e", ""]], 5: [["a", ""], ["", "b"]],
    }


def test_clean_grids_across_blocks(spark):
    n = 3 * G.ROWS_PER_BLOCK + 7
    df = spark.range(n).select(
        F.lit(1).alias("table_id"), F.col("id").alias("row"),
        F.array(F.when(F.col("id") % 3 == 0, "").otherwise(F.col("id").cast("string"))).alias("cells"),
    )
    got = G.clean_grids(df).orderBy("row").collect()
    want = [i for i in range(n) if i % 3]
    assert [r["row"] for r in got] == list(range(len(want)))
    assert [int(r["cells"][0]) for r in got] == want


def test_valid_grids(spark):
    blank = ["", "", "", ""]
    got = G.valid_grids(grid(
        spark, [["a", "b"], ["c", "d"]], [["a", "b", "c"]], [["a"], ["b"]], [["a", "", "", ""], blank, blank, blank],
        [["a", "b"], ["c", ""], ["e", "f"]],
    ))
    assert set(back(got)) == {0, 4}


def test_titles_and_headers(spark):
    ready = G.fix_headers(G.strip_titles(grid(
        spark,
        [["Title", "", "", ""], ["Sub", "x", "", ""], ["fund", "nav", "nav", ""], ["A", "1", "2", "3"]],
        [["a", "b"], ["c", "d"]],
        [["T", "", ""], ["a", "b", "c"]],
        [["", ""], ["", ""]],
        [["x"], ["y"]],
    )))
    assert back(ready) == {
        0: [["Sub", "x", "col_3", "col_4"], ["fund", "nav", "nav", ""], ["A", "1", "2", "3"]],
        1: [["a", "b"], ["c", "d"]],
        2: [["T", "", ""], ["a", "b", "c"]],
    }
    named = G.fix_headers(grid(spark, [["nav", "nav", " nav ", ""], ["1", "2", "3", "4"]]))
    assert back(named)[0][0] == ["nav", "nav_2", "nav_3", "col_4"]


def test_pipe_and_csv(spark):
    df = grid(spark, [["a", "b"], ["x, y", 'q"r']])
    assert G.pipe_tables(df).first()["text"] == "| a | b |\n| --- | --- |\n| x, y | q\"r |\n"
    assert [r[0] for r in df.orderBy("row").select(G.csv_line(F.col("cells"))).collect()] == ["a,b", '"x, y","q""r"']


# --- boilerplate and history ---


def test_boilerplate(spark):
    pages = spark.createDataFrame(
        [("d", 1, "Secret — keep\nfirst\na\nPage 1 of 3"), ("d", 2, " Secret — keep\nsecond\na\n2 / 3\n5"),
         ("d", 3, "Secret — keep \nthird\na\nSecret — keep"), ("e", 1, "Secret — keep\n  alone  \npage of text")],
        "doc string, page int, text string",
    )
    repeated = B.repeated_lines(pages, "doc", "text")
    assert [(r["doc"], r["line"], r["pages"]) for r in repeated.collect()] == [("d", "Secret — keep", 3)]
    want = {("d", 1): "first\na", ("d", 2): "second\na", ("d", 3): "third\na", ("e", 1): "Secret — keep\n  alone  \npage of text"}
    for way in (B._strip_in_place(pages, "doc", "text", repeated), B._strip_by_join(pages, "doc", "text", repeated)):
        assert {(r["doc"], r["page"]): r["text"] for r in way.collect()} == want


def test_history(spark):
    rows = [("s", i, "user" if i % 2 == 0 else None, "x" * 500 if i == 11 else f" m{i} ") for i in range(12)] + [("t", 0, "user", "  ")]
    df = spark.createDataFrame(rows, "sid string, n int, role string, content string")
    assert {r["n"] for r in H.last_messages(df, "sid", "n").filter("sid = 's'").collect()} == set(range(4, 12))
    got = {r["sid"]: r["transcript"] for r in H.transcripts(df, "sid", "n").collect()}
    assert list(got) == ["s"]
    assert got["s"].split("\n") == ["user: m4", "?: m5", "user: m6", "?: m7", "user: m8", "?: m9", "user: m10", "?: " + "x" * 400]


def test_words_of_rare_and_latin_blanks(spark):
    texts = ["".join(f"a{b}" for b in X.WHITESPACE) + "z", *(f"{b}x{b}{b}y{b}" for b in X.WHITESPACE), "é—b ü\x1dß", " ", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", X.words("t").alias("w")).collect()}
    assert got == {i: None if t is None else t.split() for i, t in enumerate(texts)}
    assert "-" not in X.LATIN_RUN  # a range is a step of its own


def test_repeated_lines_by_join_move_no_text(spark):
    """Lines are matched by hashes; rows that repeat, blank and null ones come out as in place."""
    head = "Head line\n  same foot \r\n\npage 3\n"
    rows = [("a", i % 3, f"{head}own {i % 4}\nHead line\n") for i in range(9)] + [("a", 1, None), ("a", 2, ""), (None, 1, head), ("b", 1, head), ("b", 1, "\n")]
    df = spark.createDataFrame(rows, "d string, p int, t string")
    repeated = B.repeated_lines(df, "d", "t")
    there, here = B._strip_by_join(df, "d", "t", repeated), B._strip_in_place(df, "d", "t", repeated)
    key = lambda r: (r["d"] or "", r["p"], r["t"] or "", r["t"] is None)
    assert sorted(map(key, there.collect())) == sorted(map(key, here.collect()))
    plan = there._jdf.queryExecution().optimizedPlan().toString()
    assert "_line" not in plan
