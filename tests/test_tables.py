"""Filters, metrics, cleaning and profiles on small literal tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablegrist.operators import chunks as C
from tablegrist.operators import clean as CL
from tablegrist.operators import metrics as M
from tablegrist.operators import profile as P
from tablegrist.operators.query import filter_rows, query_table, run_query_request
from tablegrist.operators.ranks import exact_quantiles, order_statistics


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [("A", "eq", 100.0, 0.1), ("B", "debt", 200.0, 0.2), ("C", "Equity x", 50.0, None),
         ("D", None, None, 0.4), ("E", "eq", 300.0, 0.05)],
        "name string, kind string, size double, gain double",
    )


def names(df):
    return [r[0] for r in df.select("name").collect()]


def test_filters(items):
    def f(op, v, c="size"):
        return sorted(names(filter_rows(items, [{"column": c, "op": op, "value": v}])))

    assert f("==", 100) == ["A"]
    assert f("==", "100") == []  # equality does not turn text into numbers
    assert f("!=", 100) == ["B", "C", "D", "E"]  # a missing number differs
    assert f("!=", "eq", "kind") == ["B", "C"]  # a missing text does not
    assert f(">", "100") == ["B", "E"]
    assert f(">=", 100) == ["A", "B", "E"]
    assert f("<", 100) == ["C"]
    assert f("<=", "100") == ["A", "C"]
    assert f("contains", "EQ", "kind") == ["A", "C", "E"]
    assert f("contains", "e.t", "kind") == []
    assert f("in", ["A", "E"], "name") == ["A", "E"]
    assert f("in", "A", "name") == ["A"]
    assert f("contains", "00.0") == ["A", "B", "E"]


def test_filter_regex(items):
    got = filter_rows(items, [{"column": "kind", "op": "contains", "value": "^d.bt$"}], regex=True)
    assert names(got) == ["B"]


def test_conjunction_sort_select_limit(items):
    got = query_table(
        items, [{"column": "size", "op": ">", "value": 60}, {"column": "kind", "op": "==", "value": "eq"}],
        sort_by="size", select_columns=["name", "nope"],
    )
    assert got.columns == ["name"] and names(got) == ["E", "A"]
    assert query_table(items, select_columns=["nope"]).columns == items.columns
    assert names(query_table(items, sort_by="size")) == ["E", "B", "A", "C", "D"]
    assert names(query_table(items, sort_by="size", sort_desc=False)) == ["C", "A", "B", "E", "D"]
    assert query_table(items, limit=0).count() == 0
    assert query_table(items, limit=-1).count() == 5
    assert query_table(items, limit=2).count() == 2
    assert run_query_request(items, {"limit": 0}).count() == 5


@pytest.mark.parametrize(
    "bad", [{"column": "x", "op": "==", "value": 1}, {"column": "size", "op": "~", "value": 1},
            {"column": "size", "op": ">", "value": "many"}],
)
def test_filter_errors(items, bad):
    with pytest.raises(ValueError):
        filter_rows(items, [bad])


def test_sort_error_lists_columns(items):
    with pytest.raises(ValueError, match="name"):
        query_table(items, sort_by="nope")


def test_metrics(spark):
    df = spark.createDataFrame(
        [("A", 100.0, 2020), ("B", 110.0, 2020), ("A", 200.0, 2021), ("C", 210.0, 2021), ("D", 150.0, None)],
        "fund string, nav double, year bigint",
    )

    def scalar(op, c="nav"):
        return M.compute(df, op, c).first()["value"]

    assert scalar("mean") == 154 and scalar("sum") == 770 and scalar("count") == 5
    assert scalar("min") == 100 and scalar("max") == 210
    assert M.compute(df.filter("nav > 999"), "sum", "nav").first()["value"] == 0
    trend = [tuple(r) for r in M.compute(df, "trend", "nav", group_by="year").collect()]
    assert trend == [(2020, 105.0), (2021, 205.0)]
    assert [r["nav"] for r in M.compute(df, "top_n", "nav", n=2).collect()] == [210, 200]
    assert M.compute(df, "top_n", "nav", n=0).count() == 5
    for args in (("mean", "x"), ("trend", "nav"), ("trend", "nav", "x"), ("top_n", "fund"), ("median", "nav")):
        with pytest.raises(ValueError):
            M.compute(df, *args)


def column(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"`{name}` string")


def test_clean_names_and_nulls(spark):
    tidy, _ = CL.clean(spark.createDataFrame([("A", 1)], "`  Fund  ` string, `NAV ` int"))
    assert tidy.columns == ["Fund", "NAV"]
    tidy, _ = CL.clean(column(spark, ["x1", "N/A", "-", " n/a ", "", "#N/A", "\tNone "]))
    assert [r[0] for r in tidy.collect()] == ["x1"]


def test_clean_drops_empty_rows_and_columns(spark):
    df = spark.createDataFrame(
        [(1.0, None, 10.0), (None, None, None), (3.0, None, 30.0), (float("nan"), None, None)],
        "a double, b double, c double",
    )
    tidy, report = CL.clean(df)
    assert tidy.columns == ["a", "c"] and tidy.count() == 2
    assert report["rows_dropped"] == 2 and report["cols_dropped"] == 1


def test_clean_numbers(spark):
    tidy, report = CL.clean(column(spark, ["$1,234.56", "€2,345.67", "£ 3,456.78", "junk", "1e2"], "amount"))
    assert report["numeric_coerced"] == ["amount"]
    assert [r[0] for r in tidy.collect()] == [1234.56, 2345.67, 3456.78, None, 100.0]
    tidy, _ = CL.clean(column(spark, ["5.2%", "3.1%", "7.4"]))
    assert [r[0] for r in tidy.collect()] == pytest.approx([0.052, 0.031, 7.4])
    tidy, _ = CL.clean(column(spark, ["1", "2,000", "-3"]))
    assert tidy.dtypes == [("x", "bigint")] and [r[0] for r in tidy.collect()] == [1, 2000, -3]
    tidy, report = CL.clean(column(spark, ["alpha", "beta", "gamma", "delta", "5"]))
    assert report["numeric_coerced"] == [] and tidy.dtypes == [("x", "string")]
    # Java would read these as numbers.
    tidy, report = CL.clean(column(spark, ["1d", "2f", "0x10", "Infinityx"]))
    assert report["numeric_coerced"] == []


def test_clean_dates_need_a_hint(spark):
    values = ["2024-01-31", "1/15/2024", "Mar 5, 2024", "7 Apr 2024", "2024-05"]
    df = spark.createDataFrame([(v, v) for v in values], "`as of date` string, label string")
    tidy, report = CL.clean(df)
    assert report["date_coerced"] == ["as of date"]
    got = [r[0] for r in tidy.select(F.date_format("as of date", "yyyy-MM-dd")).collect()]
    assert got == ["2024-01-31", "2024-01-15", "2024-03-05", "2024-04-07", "2024-05-01"]
    assert dict(tidy.dtypes)["label"] == "string"


def test_more_dates_and_blanks_in_numbers(spark):
    dates = {
        "2024-01-05 10:00": "2024-01-05 10:00:00", "2024-01-05T10:00:00Z": "2024-01-05 10:00:00",
        "2024-01-05T10:00:00+02:00": "2024-01-05 08:00:00", "2024-01-05 10:00:00.250": "2024-01-05 10:00:00",
        "25/12/2024": "2024-12-25 00:00:00", "12/11/2024": "2024-12-11 00:00:00", "January 5, 2024": "2024-01-05 00:00:00",
        "5 January 2024": "2024-01-05 00:00:00", "Jan-2024": "2024-01-01 00:00:00", "05-01-2024": "2024-05-01 00:00:00",
        "20240105": "2024-01-05 00:00:00", "1/5/24": "2024-01-05 00:00:00", "25/1/24": "2024-01-25 00:00:00",
        "31-12-2024": "2024-12-31 00:00:00", "May 2024": "2024-05-01 00:00:00", "March 2024": "2024-03-01 00:00:00",
    }
    df = spark.createDataFrame([(d,) for d in dates], "d string")
    got = {r[0]: r[1] for r in df.select("d", F.date_format(CL.parse_date(F.col("d")), "yyyy-MM-dd HH:mm:ss")).collect()}
    assert got == dates
    numbers = {"1\xa0234": 1234.0, "\u202f5": 5.0, "12\u2009345,5": 123455.0, "1\xa0234%": 12.34}
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    assert {r[0]: r[1] for r in df.select("n", CL.parse_number(F.col("n"))).collect()} == numbers
    # Signs and marks do not count as digits: the column stays whole.
    tidy, _ = CL.clean(spark.createDataFrame([("$1,234,567,890,123,456",), ("2",)], "n string"))
    assert tidy.dtypes == [("n", "bigint")]


def test_enumerations(spark):
    df = spark.createDataFrame([(f"v{i % 3}", "same", f"u{i}") for i in range(600)], "a string, b string, c string")
    got = P.enumerations(df, "t.csv", high=500).collect()
    assert [(r["column"], r["n_values"], r["values"]) for r in got] == [("a", 3, ["v0", "v1", "v2"])]
    assert got[0]["text"] == "All distinct values in column 'a' from t.csv (3 total): v0, v1, v2."
    # A long list comes in numbered parts that together hold every value.
    parts = sorted((r["part"], r["n_values"], r["values"], r["text"]) for r in P.enumerations(df, "t.csv").collect() if r["column"] == "c")
    values = sorted(f"u{i}" for i in range(600))
    assert [p[:3] for p in parts] == [(1, 600, values[:500]), (2, 600, values[500:])]
    assert parts[1][3].startswith("All distinct values in column 'c' from t.csv (600 total, part 2 of 2): u")


def test_name_column(spark):
    df = spark.createDataFrame([(f"k{i % 4}", f"n{i}") for i in range(20)], "kind string, name string")
    assert P.pick_name_column(df) == "name"
    assert P.pick_name_column(df.select("kind")) is None
    close = spark.createDataFrame([(f"n{min(i, 7)}",) for i in range(10)], "x string")  # exactly 0.8
    assert P.pick_name_column(close) == "x"
    assert P.pick_name_column(spark.createDataFrame([("a",)], "x string")) is None


def test_order_statistics_end_on_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    values = [1e-100, 1e99, -inf, inf, nan, 0.0, -0.0, 5e-324, -1e308, *[7.0] * 50, *map(float, range(100))]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = sorted(values, key=lambda v: (v != v, v))
    ranks = [0, 1, 2, 3, 4, 5, 6, 40, 90, 155, 156, 157, 158]
    got = order_statistics(df, {"x": ranks})
    assert repr([got["x", r] + 0.0 for r in ranks]) == repr([want[r] + 0.0 for r in ranks])


def test_middle_of_wide_ordinals(spark):
    start = 2**60
    for kind in ("bigint", "timestamp", "string"):
        rows = spark.range(100).selectExpr("id", f"cast({start if kind == 'bigint' else 10**9} + id as {'bigint' if kind != 'timestamp' else 'timestamp'}) as o")
        if kind == "string":
            rows = rows.selectExpr("id", "concat('k', o) as o")
        middle = P.head_middle_tail(rows, "o").filter("sample = 'middle'").collect()
        assert sorted(r["id"] for r in middle) == [48, 49, 50, 51, 52]
    tied = spark.createDataFrame([(1, i) for i in range(60)] + [(2, i) for i in range(40)], "o int, id int")
    assert P.head_middle_tail(tied, "o").filter("sample = 'middle'").count() == 5


def test_order_statistics_match_sorting(spark):
    values = [((i * 7919) % 1000) / 7 for i in range(3000)] + [5.0] * 1000 + [1e12, -3.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ranks = [0, 1, 17, 1500, 2000, len(values) - 1]
    want = sorted(values)
    got = order_statistics(df, {"x": ranks})
    assert [got["x", r] for r in ranks] == [want[r] for r in ranks]
    import numpy as np

    q = exact_quantiles(df, {"x": len(values)}, [0.25, 0.5, 0.75])["x"]
    assert q == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])))


def test_quartiles_match_the_built_in_percentile(spark):
    df = spark.createDataFrame([(float(i * i % 97), i) for i in range(500)], "x double, y int")
    got = {r["column"]: [r["p25"], r["p50"], r["p75"]] for r in P.describe_numbers(df).collect()}
    for c in ("x", "y"):
        assert got[c] == df.agg(F.percentile(c, F.array(*map(F.lit, P.QUARTILES)))).first()[0]


@pytest.mark.parametrize("n,want", [(7, {"all": 7}), (20, {"head": 5, "tail": 5}), (50, {"head": 5, "tail": 5, "middle": 5})])
def test_samples(spark, n, want):
    df = spark.range(n).select((F.col("id") * 3).alias("k"))
    got = P.head_middle_tail(df, "k").collect()
    assert {s: sum(r["sample"] == s for r in got) for s in {r["sample"] for r in got}} == want
    if n == 50:
        assert sorted(r["k"] for r in got if r["sample"] == "middle") == [3 * i for i in range(23, 28)]


def test_summary_and_synopsis(spark):
    df = spark.createDataFrame(
        [("Alpha", dt.datetime(2020, 1, 1), 1.0, 0), ("Alpha", dt.datetime(2024, 12, 31), 2.0, 1), ("Beta", None, 3.0, 2)],
        "fund string, `as of date` timestamp, nav double, _o bigint",
    )
    facts = C.profile_table(df, "_o", hidden=["_o"])
    assert C.synopsis_text(facts, "f.csv") == (
        "f.csv is a tabular dataset with 3 rows and 3 columns. Text columns: fund. Numeric columns: nav. "
        "as of date ranges from 2020-01-01 to 2024-12-31. Common values in fund: Alpha, Beta."
    )
    text = C.summary_text(facts, "f.csv", {"rows_dropped": 1, "cols_dropped": 0, "numeric_coerced": ["nav"]})
    for part in ("Rows: 3, Columns: 3", "dropped 1 empty rows", "Alpha=2", "All rows:", "Date ranges:", "Coerced to numeric: nav"):
        assert part in text


def test_ordered_bits_of_doubles(spark):
    """The bits of the double itself, for values of every exponent."""
    import random
    import struct

    from tablegrist.operators.ranks import from_bits, ordered_bits

    rng = random.Random(2)
    values = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(63)))[0] for _ in range(4000)]
    values += [m * 2.0**e for e in range(-1074, 1024) for m in (1.0, 1 - 2**-53, 1 + 2**-52) if m * 2.0**e < float("inf")]
    values += [0.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), 0.1, 3.0, 1e15 + 0.3]
    values = [v for v in values if v == v]
    df = spark.createDataFrame([(v,) for v in values] + [(-v,) for v in values] + [(float("nan"),), (None,)], "x double")
    got = df.select("x", ordered_bits(F.col("x"), "double").alias("b")).collect()
    for r in got[:-2]:
        bits = struct.unpack("<Q", struct.pack("<d", abs(r["x"])))[0]
        assert abs(r["b"]) == bits and (r["b"] < 0) == (r["x"] < 0), r
        assert from_bits(r["b"]) == r["x"]
    assert got[-2]["b"] == 0x7FF8 << 48 and got[-1]["b"] is None


def test_values_at_ranks_of_any_type(spark):
    from tablegrist.operators.ranks import value_at

    df = spark.range(0, 5000).selectExpr(
        "(id * 7919 % 5000) * 4 + 1152921504606846976 as whole", "date_add(date '1960-01-01', cast(id % 4999 as int)) as day",
        "timestamp_micros(id * 1234567 - 1000000000) as moment", "concat('Customer#', lpad(id % 700, 6, '0')) as text",
        "cast(id as decimal(30,4)) as number", "cast(id % 13 as float) as small",
    )
    for c in df.columns:
        values = sorted(r[0] for r in df.select(c).collect())
        for rank in (0, 1, 2500, 4999):
            assert df.limit(1).select(value_at(df, c, rank)).first()[0] == values[rank], c


def test_date_cells(spark):
    want = {
        "25/12/2024 14:30": "2024-12-25 14:30:00", "01/05/2024 14:30": "2024-01-05 14:30:00", "5 JAN 2024": "2024-01-05 00:00:00",
        "Jan 5, 2024 2:30 PM": "2024-01-05 14:30:00", "Sept 2024": "2024-09-01 00:00:00", "12:00 AM": None,
        "12/31/2023 12:05 am": "2023-12-31 00:05:00", "3-Feb-24": "2024-02-03 00:00:00", "1st March 2024": "2024-03-01 00:00:00",
        "2024/2/3 04:05:06.5": "2024-02-03 04:05:06.500000", "20240203": "2024-02-03 00:00:00", "2024-02-03T04:05:06Z": "2024-02-03 04:05:06",
        "05.06.2024, 7:08": "2024-05-06 07:08:00", "MAY 7 2024 10:00 +02:00": "2024-05-07 08:00:00", "June 2024": "2024-06-01 00:00:00",
        "2024 aug 9": "2024-08-09 00:00:00", "1/2/24": "2024-01-02 00:00:00", "2024-01": "2024-01-01 00:00:00",
        "13/13/2024": None, "31/02/2024": None, "Janus 2024": None, "13:30 PM 1/2/2024": None, "1/2/2024 13:30 PM": None, "-5": None,
        "12": None, "hello": None, "": None, "1/2/2024 25:00": None, "Q1 2024": None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "c string").select("c", CL.parse_date(F.col("c")).cast("string").alias("t")).collect()
    got = {r["c"]: r["t"] for r in rows}
    assert {k: v and v.replace(".500000", ".5") for k, v in want.items()} == got


def test_a_date_is_taken_apart_once(spark):
    """Its steps are not written out again for each form and part of a date."""
    df = spark.createDataFrame([("1/31/2024",), ("5 March 2024 1:05 pm",), ("no date 1",)], "v string").select(CL.parse_date(F.col("v")).alias("d"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace(lower(") <= 2
    assert [r["d"] and str(r["d"]) for r in df.collect()] == ["2024-01-31 00:00:00", "2024-03-05 13:05:00", None]


def test_rank_keys_are_made_in_steps(spark, monkeypatch):
    """The bits of doubles are not written out once for each column and group."""
    import tablegrist.operators.ranks as R

    plans, cut = [], R.cut_lineage

    def seen(counts):
        plans.append(counts._jdf.queryExecution().optimizedPlan().toString())
        return cut(counts)

    monkeypatch.setattr(R, "cut_lineage", seen)
    df = spark.range(0, 3000).selectExpr("id / 7 as a", "sqrt(id) as b", "-1.0d * id as c", "if(id = 5, double('inf'), id * 1e300) as d", "id as e")
    got = R.order_statistics(df, {c: [0, 1500, 2998] for c in df.columns})
    rows = df.collect()
    assert got == {(c, r): float(sorted(x[c] for x in rows)[r]) for c in df.columns for r in (0, 1500, 2998)}
    assert len(plans) == 3 and all(p.count("LOG2(") == 1 for p in plans)
