"""Filters, metrics, cleaning, profiles and time series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegrist.operators import chunks as C
from tablegrist.operators import clean as CL
from tablegrist.operators import entities as E
from tablegrist.operators import metrics as M
from tablegrist.operators import profile as P
from tablegrist.operators import timeseries as TS
from tablegrist.operators.query import filter_rows, query_table, run_query_request
from tablegrist.operators.ranks import from_bits, rank_cells, select_ranks
from tablegrist.operators.vectors import fit_scaler
from tablegrist.plans.reports import report, sql_canonical, table
from tablegrist.session import small_table

DAY = "yyyy-MM-dd"


# --- filter, sort, limit ----------------------------------------------------


@report(
    """
    SELECT o_orderkey, c_name, c_mktsegment, o_totalprice
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_totalprice > 100000
    ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10
    """
)
def big_orders_with_customer(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return query_table(
        joined,
        [{"column": "o_totalprice", "op": ">", "value": "100000"}],
        sort_by="o_totalprice",
        select_columns=["o_orderkey", "c_name", "c_mktsegment", "o_totalprice", "no_such_column"],
        limit=10,
        tie_break=["o_orderkey"],
    )


@report(
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
    FROM orders
    WHERE o_totalprice >= 50000 AND o_totalprice < 400000 AND o_orderstatus = 'O'
      AND o_orderpriority <> '5-LOW'
    ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 50
    """
)
def filtered_orders(spark: SparkSession, sf: str) -> DataFrame:
    args = {
        "filters": [
            {"column": "o_totalprice", "op": ">=", "value": "50000"},
            {"column": "o_totalprice", "op": "<", "value": 400000},
            {"column": "o_orderstatus", "op": "==", "value": "O"},
            {"column": "o_orderpriority", "op": "!=", "value": "5-LOW"},
        ],
        "sort_by": "o_totalprice",
        "sort_desc": False,
        "select_columns": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"],
        "limit": 0,
    }
    return run_query_request(table(spark, sf, "orders"), args, tie_break=["o_orderkey"])


@report(
    """
    SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part
    WHERE contains(lower(p_name), 'ring') AND p_type IN ('ECONOMY', 'SMALL') AND p_size <> 11 AND p_size <= 40
    """
)
def filtered_parts_by_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = filter_rows(
        table(spark, sf, "part"),
        [
            {"column": "p_name", "op": "contains", "value": "RING"},
            {"column": "p_type", "op": "in", "value": ["ECONOMY", "SMALL"]},
            {"column": "p_size", "op": "!=", "value": 11},
            {"column": "p_size", "op": "<=", "value": 40},
        ],
    )
    return rows.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@report(
    """
    SELECT count(*) AS matching, round(sum(l_extendedprice), 2) AS price FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'
      AND l_discount > 0.03 AND l_returnflag = 'R' AND contains(lower(l_linestatus), 'o')
    """
)
def shipped_lineitems_in_year(spark: SparkSession, sf: str) -> DataFrame:
    rows = filter_rows(
        table(spark, sf, "lineitem"),
        [
            {"column": "l_shipdate", "op": ">=", "value": "1998-01-01"},
            {"column": "l_shipdate", "op": "<", "value": "1999-01-01"},
            {"column": "l_discount", "op": ">", "value": "0.03"},
            {"column": "l_returnflag", "op": "in", "value": "R"},
            {"column": "l_linestatus", "op": "contains", "value": "O"},
        ],
    )
    return rows.agg(
        F.count(F.lit(1)).alias("matching"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )


# --- metrics ----------------------------------------------------------------


@report(
    """
    SELECT 'mean' AS metric, round(avg(l_extendedprice), 4) AS value FROM lineitem
    UNION ALL SELECT 'sum', round(sum(l_quantity), 4) FROM lineitem
    UNION ALL SELECT 'count', count(l_discount)::DOUBLE FROM lineitem
    UNION ALL SELECT 'min', min(l_extendedprice) FROM lineitem
    UNION ALL SELECT 'max', max(l_extendedprice) FROM lineitem
    """
)
def lineitem_scalars(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    asked = [
        ("mean", "l_extendedprice"), ("sum", "l_quantity"), ("count", "l_discount"),
        ("min", "l_extendedprice"), ("max", "l_extendedprice"),
    ]
    parts = [M.compute(li, op, c) for op, c in asked]
    return C.union_all(parts).select("metric", F.round("value", 4).alias("value"))


@report(
    """
    SELECT c_mktsegment, round(avg(o_totalprice), 4) AS o_totalprice
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment
    """
)
def mean_order_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    out = M.compute(joined, "mean", "o_totalprice", group_by="c_mktsegment")
    return out.select("c_mktsegment", F.round("o_totalprice", 4).alias("o_totalprice"))


@report(
    """
    SELECT l_suppkey, round(sum(l_extendedprice), 2) AS l_extendedprice
    FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY l_suppkey
    """
)
def sales_by_supplier(spark: SparkSession, sf: str) -> DataFrame:
    out = M.compute(table(spark, sf, "lineitem"), "sum", "l_extendedprice", group_by="l_suppkey")
    return out.select("l_suppkey", F.round("l_extendedprice", 2).alias("l_extendedprice"))


@report(
    """
    SELECT 'count' AS op, o_orderpriority, count(o_totalprice)::DOUBLE AS value FROM orders GROUP BY 2
    UNION ALL SELECT 'min', o_orderpriority, min(o_totalprice) FROM orders GROUP BY 2
    UNION ALL SELECT 'max', o_orderpriority, max(o_totalprice) FROM orders GROUP BY 2
    """
)
def order_extremes_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return C.union_all(
        [
            M.compute(orders, op, "o_totalprice", group_by="o_orderpriority").select(
                F.lit(op).alias("op"), "o_orderpriority", F.col("o_totalprice").cast("double").alias("value")
            )
            for op in ("count", "min", "max")
        ]
    )


@report(
    """
    SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS value FROM events GROUP BY 1
    """
)
def daily_event_trend(spark: SparkSession, sf: str) -> DataFrame:
    daily = table(spark, sf, "events").select(F.date_format("ts", DAY).alias("day"), "value")
    return M.compute(daily, "trend", "value", group_by="day").select("day", F.round("value", 6).alias("value"))


@report(
    """
    SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part
    ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 25
    """
)
def dearest_parts(spark: SparkSession, sf: str) -> DataFrame:
    return M.compute(table(spark, sf, "part"), "top_n", "p_retailprice", n=25, tie_break=["p_partkey"])


# --- cleaning ---------------------------------------------------------------


def messy_lineitems(spark: SparkSession, sf: str) -> DataFrame:
    """Line items the way a spreadsheet export writes them."""
    li = table(spark, sf, "lineitem", costly=True)

    def cell(c):
        return F.when(F.col("l_quantity") == 50, F.lit(" -- ")).otherwise(c)

    usual = F.date_format("l_shipdate", DAY)
    return li.select(
        cell(F.concat(F.lit(" "), F.col("l_orderkey").cast("string"))).alias("  order ref "),
        cell(
            F.when(F.col("l_linenumber") == 7, "N/A").otherwise(
                F.concat(F.lit("$"), F.format_number("l_extendedprice", 2))
            )
        ).alias("price "),
        cell(F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))).alias("discount"),
        cell(
            F.when(F.col("l_linenumber") % 3 == 0, F.date_format("l_shipdate", "M/d/yyyy")).otherwise(usual)
        ).alias("Ship Date"),
        cell(F.when(F.col("l_linenumber") == 1, "5").otherwise(F.col("l_returnflag"))).alias("note"),
        cell(F.lit("#N/A")).alias("remark"),
        cell(usual).alias("shipped"),
    )


@report(
    """
    SELECT l_orderkey AS order_ref,
           CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS price,
           try_cast(round(l_discount * 100)::INT AS DOUBLE) / 100 AS discount,
           strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS ship_date,
           CASE WHEN l_linenumber = 1 THEN '5' ELSE l_returnflag END AS note,
           strftime(l_shipdate, '%Y-%m-%d') AS shipped
    FROM lineitem WHERE l_quantity <> 50
    """
)
def cleaned_lineitems(spark: SparkSession, sf: str) -> DataFrame:
    tidy, _ = CL.clean(messy_lineitems(spark, sf))
    return tidy.select(
        F.col("order ref").alias("order_ref"),
        "price",
        "discount",
        F.date_format("Ship Date", "yyyy-MM-dd HH:mm:ss").alias("ship_date"),
        "note",
        "shipped",
    )


@report(
    """
    WITH voted AS (
      SELECT count(*) AS filled,
             count(CASE WHEN l_linenumber <> 7 THEN 1 END) AS price_n,
             count(CASE WHEN l_linenumber = 1 THEN 1 END) AS note_numbers
      FROM lineitem WHERE l_quantity <> 50)
    SELECT 'lineitem' AS "table",
           (SELECT count(*) FROM lineitem WHERE l_quantity = 50) AS rows_dropped,
           CAST(1 AS BIGINT) AS cols_dropped,
           'order ref, price, discount' || CASE WHEN note_numbers >= 0.8 * filled THEN ', note' ELSE '' END AS numeric_coerced,
           'Ship Date' AS date_coerced
    FROM voted
    """
)
def cleaning_report(spark: SparkSession, sf: str) -> DataFrame:
    return CL.report_rows(messy_lineitems(spark, sf), "lineitem")


# --- profiles ---------------------------------------------------------------


@report(
    """
    SELECT 'part' AS "table", (SELECT count(*) FROM part) AS rows, position::INT AS position, "column", kind, filled
    FROM (SELECT 0 AS position, 'p_partkey' AS "column", 'number' AS kind, count(p_partkey) AS filled FROM part
          UNION ALL SELECT 1, 'p_name', 'text', count(p_name) FROM part
          UNION ALL SELECT 2, 'p_brand', 'text', count(p_brand) FROM part
          UNION ALL SELECT 3, 'p_type', 'text', count(p_type) FROM part
          UNION ALL SELECT 4, 'p_size', 'number', count(p_size) FROM part
          UNION ALL SELECT 5, 'p_retailprice', 'number', count(p_retailprice) FROM part)
    UNION ALL
    SELECT 'orders', (SELECT count(*) FROM orders), position::INT, "column", kind, filled
    FROM (SELECT 0 AS position, 'o_orderkey' AS "column", 'number' AS kind, count(o_orderkey) AS filled FROM orders
          UNION ALL SELECT 1, 'o_custkey', 'number', count(o_custkey) FROM orders
          UNION ALL SELECT 2, 'o_orderstatus', 'text', count(o_orderstatus) FROM orders
          UNION ALL SELECT 3, 'o_totalprice', 'number', count(o_totalprice) FROM orders
          UNION ALL SELECT 4, 'o_orderdate', 'datetime', count(o_orderdate) FROM orders
          UNION ALL SELECT 5, 'o_orderpriority', 'text', count(o_orderpriority) FROM orders)
    """
)
def table_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return C.union_all([P.shape(table(spark, sf, t), t) for t in ("part", "orders")])


def _sql_enumeration(t: str, c: str) -> str:
    return f"""
    SELECT '{c}' AS "column", n AS n_values, p::INT AS part,
           'All distinct values in column ''{c}'' from {t} (' || n || ' total'
             || CASE WHEN n > 500 THEN ', part ' || p || ' of ' || ((n + 499) // 500) ELSE '' END || '): '
             || string_agg({c}, ', ' ORDER BY {c}) || '.' AS text
    FROM (SELECT {c}, count(*) OVER () AS n, (row_number() OVER (ORDER BY {c}) - 1) // 500 + 1 AS p
          FROM (SELECT DISTINCT {c} FROM {t} WHERE {c} IS NOT NULL))
    WHERE n > 1 GROUP BY n, p"""


@report(" UNION ALL ".join(_sql_enumeration("part", c) for c in ("p_name", "p_brand", "p_type")))
def part_enumerations(spark: SparkSession, sf: str) -> DataFrame:
    return P.enumerations(table(spark, sf, "part"), "part").select("column", "n_values", "part", "text")


@report(
    " UNION ALL ".join(
        _sql_enumeration("customer", c) for c in ("c_name", "c_mktsegment")
    )
)
def customer_enumerations(spark: SparkSession, sf: str) -> DataFrame:
    return P.enumerations(table(spark, sf, "customer"), "customer").select("column", "n_values", "part", "text")


NAMED = {
    "customer": ("c_name", "c_mktsegment"),
    "supplier": ("s_name",),
    "part": ("p_name", "p_brand", "p_type"),
    "orders": ("o_orderstatus", "o_orderpriority"),
}


@report(
    """
    WITH shares AS ("""
    + " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", {i} AS position, '{c}' AS "column",
                   count(DISTINCT {c}) AS d, count({c}) AS n FROM {t}"""
        for t, cs in NAMED.items()
        for i, c in enumerate(cs)
    )
    + """), tables AS (SELECT DISTINCT "table" FROM shares)
    SELECT t."table", (SELECT min_by("column", position) FROM shares s
                       WHERE s."table" = t."table" AND d >= 2 AND d >= 0.8 * n) AS name_column
    FROM tables t
    """
)
def name_columns(spark: SparkSession, sf: str) -> DataFrame:
    picked = [(t, P.pick_name_column(table(spark, sf, t))) for t in NAMED]
    return small_table(spark, picked, "`table` string, name_column string")


def _sql_describe(t: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
                   round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min,
                   round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
                   round(quantile_cont({c}, 0.75), 6) AS p75, max({c})::DOUBLE AS max FROM {t}"""
        for c in cols
    )


def _rounded_description(df: DataFrame) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "std", "p25", "p50", "p75")]
    return df.select("column", "count", *rounded, "min", "max")


LINEITEM_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@report(_sql_describe("lineitem", LINEITEM_NUMBERS))
def lineitem_description(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_description(P.describe_numbers(table(spark, sf, "lineitem"), LINEITEM_NUMBERS))


@report(_sql_describe("orders", ["o_totalprice", "o_custkey"]))
def order_description_by_narrowing(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_description(P.describe_numbers(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"]))


# Places among the sorted values, as shares of the last place.
ODD_SHARES = (0.0, 0.001, 0.01, 0.25, 0.5, 0.9, 0.985, 1.0)


def _odd_values(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with infinities, NaN, NULL, ties and whole numbers beyond 2^53."""
    k = F.col("l_orderkey")
    odd = F.when(k % 50 == 0, float("nan")).when(k % 51 == 0, float("inf")).when(k % 52 == 0, float("-inf")).when(k % 53 != 0, F.col("l_extendedprice") - 20000)
    whole = F.when(k % 2 == 0, -1).otherwise(1) * (F.lit(1 << 60) + k * 8 + F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select(odd.alias("odd"), whole.cast("bigint").alias("whole"), F.col("l_quantity").alias("tied"))


_SQL_ODD = """
    WITH v AS (SELECT CASE WHEN l_orderkey % 50 = 0 THEN 'nan'::DOUBLE WHEN l_orderkey % 51 = 0 THEN 'inf'::DOUBLE
                           WHEN l_orderkey % 52 = 0 THEN '-inf'::DOUBLE WHEN l_orderkey % 53 <> 0 THEN l_extendedprice - 20000 END AS odd,
                      (CASE WHEN l_orderkey % 2 = 0 THEN -1 ELSE 1 END * (1152921504606846976 + l_orderkey * 8 + l_linenumber))::BIGINT AS whole,
                      l_quantity::DOUBLE AS tied
               FROM lineitem),
    s(share) AS (SELECT unnest([0.0, 0.001, 0.01, 0.25, 0.5, 0.9, 0.985, 1.0]::DOUBLE[])),
    o AS (SELECT odd::VARCHAR AS value, row_number() OVER (ORDER BY odd) - 1 AS place, count(*) OVER () AS n FROM v WHERE odd IS NOT NULL),
    w AS (SELECT whole::VARCHAR AS value, row_number() OVER (ORDER BY whole) - 1 AS place, count(*) OVER () AS n FROM v),
    t AS (SELECT tied::BIGINT::VARCHAR AS value, row_number() OVER (ORDER BY tied) - 1 AS place, count(*) OVER () AS n FROM v)
    SELECT 'odd' AS "column", share, CASE WHEN value IN ('nan', 'inf', '-inf') THEN value ELSE round(value::DOUBLE, 2)::DECIMAL(18,2)::VARCHAR END AS value
    FROM s JOIN o ON place = floor(share * (n - 1))::BIGINT
    UNION ALL SELECT 'whole', share, value FROM s JOIN w ON place = floor(share * (n - 1))::BIGINT
    UNION ALL SELECT 'tied', share, value FROM s JOIN t ON place = floor(share * (n - 1))::BIGINT
"""


@report(_SQL_ODD)
def values_at_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Exact values at given places of columns that sketches and doubles get wrong."""
    df = _odd_values(spark, sf)
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    place = {(c, s): math.floor(s * (counts[c] - 1)) for c in df.columns for s in ODD_SHARES}
    kinds = {c: df.schema[c].dataType.typeName() for c in df.columns}
    found = select_ranks(rank_cells(df, df.columns), {i: [place[c, s] for s in ODD_SHARES] for i, c in enumerate(df.columns)})
    show = {
        "odd": lambda k: f"{from_bits(k):.2f}" if math.isfinite(from_bits(k)) else str(from_bits(k)),
        "whole": str, "tied": lambda k: str(int(from_bits(k)) if kinds["tied"] == "double" else k),
    }
    rows = [(c, s, show[c](found[i, place[c, s]])) for i, c in enumerate(df.columns) for s in ODD_SHARES]
    return small_table(spark, rows, "column string, share double, value string")


def _sql_top(t: str, cols: tuple[str, ...], k: int) -> str:
    return " UNION ALL ".join(
        f"""(SELECT '{c}' AS "column", {c} AS value, count(*) AS n,
                    row_number() OVER (ORDER BY count(*) DESC, {c})::INT AS rank
             FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY rank <= {k})"""
        for c in cols
    )


@report(_sql_top("part", ("p_name", "p_brand", "p_type"), 5))
def common_part_values(spark: SparkSession, sf: str) -> DataFrame:
    freq = P.value_frequencies(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"])
    return P.top_values(freq, 5)


@report(
    """
    SELECT 'lineitem' AS "table", 'l_shipdate' AS "column", strftime(min(l_shipdate), '%Y-%m-%d') AS lo,
           strftime(max(l_shipdate), '%Y-%m-%d') AS hi FROM lineitem
    UNION ALL SELECT 'orders', 'o_orderdate', strftime(min(o_orderdate), '%Y-%m-%d'),
                     strftime(max(o_orderdate), '%Y-%m-%d') FROM orders
    UNION ALL SELECT 'events', 'ts', strftime(min(ts), '%Y-%m-%d'), strftime(max(ts), '%Y-%m-%d') FROM events
    """
)
def date_spans(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        P.date_ranges(table(spark, sf, t)).select(
            F.lit(t).alias("table"), "column",
            F.date_format("lo", DAY).alias("lo"), F.date_format("hi", DAY).alias("hi"),
        )
        for t in ("lineitem", "orders", "events")
    ]
    return C.union_all(parts)


@report(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {i}::INT AS position, round(coalesce(avg({c}), 0), 6) AS mean,
                   round(CASE WHEN coalesce(stddev_pop({c}), 0) > 1e-9 THEN stddev_pop({c}) ELSE 1 END, 6) AS std
            FROM lineitem"""
        for i, c in enumerate(LINEITEM_NUMBERS)
    )
)
def lineitem_scaler(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    fitted = fit_scaler(li, "lineitem", LINEITEM_NUMBERS).table(li)
    return fitted.select(
        "column", "position", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")
    )


@report(
    """
    WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i,
                      count(*) OVER () AS n FROM orders)
    SELECT 'head' AS sample, o_orderkey, o_totalprice FROM o WHERE i < 5
    UNION ALL SELECT 'tail', o_orderkey, o_totalprice FROM o WHERE i >= n - 5
    UNION ALL SELECT 'middle', o_orderkey, o_totalprice FROM o WHERE i >= n // 2 - 2 AND i < n // 2 + 3
    """
)
def order_samples(spark: SparkSession, sf: str) -> DataFrame:
    picked = P.head_middle_tail(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return picked.select("sample", "o_orderkey", "o_totalprice")


@report(
    """
    SELECT 'part is a tabular dataset with ' || (SELECT count(*) FROM part)
        || ' rows and 6 columns. Text columns: p_name, p_brand, p_type.'
        || ' Numeric columns: p_partkey, p_size, p_retailprice. Common values in p_name: '
        || string_agg(p_name, ', ' ORDER BY n DESC, p_name) || '.' AS text
    FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 3)
    """
)
def part_synopsis(spark: SparkSession, sf: str) -> DataFrame:
    facts = C.profile_table(table(spark, sf, "part"), "p_partkey")
    return C.synopsis_chunk(spark, facts, C.Source("part")).select("text")


@report()
def orders_summary(spark: SparkSession, sf: str) -> DataFrame:
    facts = C.profile_table(table(spark, sf, "orders"), "o_orderkey")
    return C.summary_chunk(spark, facts, C.Source("orders")).select("chunk_type", "text")


# --- time series and entities -----------------------------------------------


def customer_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.concat(F.lit("The Customer #"), F.col("o_custkey").cast("string")).alias("customer"),
        "o_orderdate", "o_totalprice", "o_orderkey",
    )


def user_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user"), "ts", "value", "event_id"
    )


@report(
    """
    SELECT 'orders' AS "table", CASE WHEN (SELECT max(d) FROM (SELECT count(DISTINCT o_orderdate) AS d
        FROM orders GROUP BY o_custkey)) > 1 THEN 'o_orderdate' END AS date_column
    UNION ALL
    SELECT 'events', CASE WHEN (SELECT max(d) FROM (SELECT count(DISTINCT ts) AS d
        FROM events GROUP BY event_id)) > 1 THEN 'ts' END
    """
)
def timeseries_columns(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("event", F.col("event_id").cast("string"))
    found = [
        ("orders", TS.detect_timeseries(customer_orders(spark, sf), "customer")),
        ("events", TS.detect_timeseries(events, "event")),
    ]
    return small_table(spark, found, "`table` string, date_column string")


def _sql_windows(rows: str) -> str:
    return f"""
    WITH r AS ({rows}), anchor AS (SELECT max(d) AS a FROM r),
    w AS (SELECT * FROM (VALUES ('30d', 30), ('90d', 90), ('365d', 365)) AS t(win, days)),
    slab AS (SELECT r.*, w.win FROM r, anchor, w WHERE r.d >= anchor.a - to_days(w.days)),
    stats AS (
      SELECT canonical_id, win, count(*) AS rows, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS mn, max(v) AS mx,
             count(v) AS n, arg_min(v, (d, o)) AS first, arg_max(v, (d, o)) AS last,
             floor((epoch_us(max(d)) - epoch_us(min(d))) / 86400000000.0) AS days
      FROM slab GROUP BY 1, 2)
    SELECT canonical_id, win AS "window", round(mean * n, 2) AS total, round(std, 5) AS std, mn AS min, mx AS max,
           n AS count, CASE WHEN g < 1000000 THEN round(g, 6) END AS growth,
           CASE WHEN g >= 1000000 THEN round(ln(g), 6) END AS log_growth
    FROM (SELECT *, CASE WHEN win = '365d' AND n >= 2 AND first > 0 AND last >= 0 AND days > 0
                         THEN pow(last / first, 365.25 / days) - 1 END AS g FROM stats)
    WHERE rows >= 2 AND n > 0
    """


def _rounded_windows(df: DataFrame) -> DataFrame:
    return df.select(
        "canonical_id", "window", F.round(F.col("mean") * F.col("count"), 2).alias("total"),
        F.round("std", 5).alias("std"), "min", "max", "count",
        F.when(F.col("cagr") < 1_000_000, F.round("cagr", 6)).alias("growth"),
        F.when(F.col("cagr") >= 1_000_000, F.round(F.ln("cagr"), 6)).alias("log_growth"),
    )


@report(
    _sql_windows(
        "SELECT 'customer ' || o_custkey AS canonical_id, o_orderdate AS d, o_totalprice AS v, o_orderkey AS o FROM orders"
    )
)
def order_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_windows(
        TS.trailing_windows(customer_orders(spark, sf), "customer", "o_orderdate", ["o_totalprice"], "o_orderkey")
    )


@report(
    _sql_windows(
        "SELECT 'user ' || user_id AS canonical_id, ts AS d, value AS v, event_id AS o FROM events"
    )
)
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_windows(
        TS.trailing_windows(user_events(spark, sf), "user", "ts", ["value"], "event_id")
    )


@report(
    """
    WITH r AS (SELECT o_custkey, o_totalprice AS v, o_orderdate AS d FROM orders),
    slab AS (SELECT * FROM r WHERE d >= (SELECT max(d) FROM r) - to_days(90))
    SELECT 'time_window' AS chunk_type, 'customer ' || o_custkey AS canonical_id, '90d' AS "window",
           'Time window 90d for customer ' || o_custkey || ' in orders: o_totalprice mean='
           || printf('%.4f', avg(v)) || ' std=' || printf('%.4f', stddev_pop(v)) || ' min=' || printf('%.4f', min(v))
           || ' max=' || printf('%.4f', max(v)) || '.' AS text
    FROM slab GROUP BY o_custkey HAVING count(*) >= 2 AND count(v) > 0
    """
)
def order_window_texts(spark: SparkSession, sf: str) -> DataFrame:
    chunks = C.time_window_chunks(
        customer_orders(spark, sf), C.Source("orders"), "customer", "o_orderdate", ["o_totalprice"], "o_orderkey"
    )
    return chunks.filter(F.col("window") == "90d").select("chunk_type", "canonical_id", "window", "text")


@report(
    """
    SELECT 'customer ' || o_custkey AS canonical_id, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice
    FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1
    """
)
def latest_order_per_customer(spark: SparkSession, sf: str) -> DataFrame:
    latest = E.latest_rows(customer_orders(spark, sf), "customer", "o_orderkey")
    return latest.select(
        "canonical_id", "o_orderkey", F.date_format("o_orderdate", DAY).alias("day"), "o_totalprice"
    )


@report(
    """
    SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 500
    """
)
def first_orders_per_priority(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return E.first_rows_per_table(orders, "o_orderpriority", "o_orderkey", 500)


@report(
    f"""
    SELECT {sql_canonical('p_brand')} AS canonical_id, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS aliases
    FROM part GROUP BY 1
    """
)
def brand_aliases(spark: SparkSession, sf: str) -> DataFrame:
    pairs = E.alias_table(table(spark, sf, "part"), "p_brand")
    return E.alias_lists(pairs).select("canonical_id", F.array_join("aliases", ", ").alias("aliases"))
