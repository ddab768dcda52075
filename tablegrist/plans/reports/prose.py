"""Text, names, documents, conversations, grids and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegrist.functions import questions as Q
from tablegrist.functions import text as X
from tablegrist.operators import boilerplate as B
from tablegrist.operators import chunks as C
from tablegrist.operators import crosstable as CT
from tablegrist.operators import entities as E
from tablegrist.operators import grids as G
from tablegrist.operators import history as H
from tablegrist.plans.reports import (
    SQL_BLANK,
    report,
    sql_canonical,
    sql_lines,
    sql_strip,
    sql_words,
    table,
)

# --- text -------------------------------------------------------------------


@report(
    f"""
    SELECT c_custkey, {sql_canonical("'The ' || c_name || ' (Plan) – ' || c_mktsegment")} AS canonical_id FROM customer
    """
)
def canonical_customers(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("The "), "c_name", F.lit(" (Plan) – "), "c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", X.canonical_name(raw).alias("canonical_id"))


def worn_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the look-alikes a word processor leaves behind."""
    worn = F.replace("text", F.lit(". "), F.lit(".\u00a0"))
    worn = F.replace(worn, F.lit(", "), F.lit("\u2026 \u2013 "))
    worn = F.replace(worn, F.lit(" the "), F.lit(" \u201cthe\u201d "))
    worn = F.replace(worn, F.lit(" de "), F.lit(" d-\ne \t\n\n\n\n"))
    return table(spark, sf, "documents", costly=True).select("doc_id", worn.alias("text"))


@report(
    r"""
    WITH worn AS (
      SELECT doc_id, replace(replace(replace(replace(text, '. ', '.' || chr(160)), ', ', chr(8230) || ' ' || chr(8211) || ' '),
             ' the ', ' ' || chr(8220) || 'the' || chr(8221) || ' '),
             ' de ', ' d-' || chr(10) || 'e ' || chr(9) || chr(10) || chr(10) || chr(10) || chr(10)) AS t FROM documents),
    ascii AS (
      SELECT doc_id, replace(replace(translate(t, chr(160) || chr(8201) || chr(8216) || chr(8217) || chr(8220) || chr(8221)
             || chr(8211) || chr(8212), '  ''''""--'), chr(8203), ''), chr(8230), '...') AS t FROM worn)
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'),
             '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM ascii
    """
)
def normalised_documents(spark: SparkSession, sf: str) -> DataFrame:
    return worn_documents(spark, sf).select("doc_id", X.normalise_text("text").alias("text"))


@report(
    f"""
    WITH w AS (SELECT doc_id, lang, source, {sql_words('text')} AS words FROM documents),
    s AS (SELECT doc_id, source, words, unnest(range(0, len(words), 140)) AS start FROM w)
    SELECT sha256(sha256(doc_id::VARCHAR) || '|text|' || (start // 140)) AS chunk_id,
           doc_id::VARCHAR AS file, start // 140 AS row_number, 'text' AS chunk_type,
           '[' || source || '] ' || doc_id || chr(10) || array_to_string(words[start + 1 : start + 180], ' ') AS text
    FROM s
    """
)
def document_windows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", costly=True)
    name = F.col("doc_id").cast("string")
    header = F.concat(F.lit("["), "source", F.lit("] "), name)
    chunks = C.text_chunks(docs, C.Source("documents"), name, "text", header=header)
    return chunks.select("chunk_id", "file", "row_number", "chunk_type", "text")


@report(
    f"""
    WITH w AS (SELECT doc_id, {sql_words('text')} AS words FROM documents)
    SELECT doc_id, array_to_string(words[1:120], ' ') || CASE WHEN len(words) > 120 THEN '...' ELSE '' END AS excerpt
    FROM w
    """
)
def document_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", costly=True).select("doc_id", X.excerpt("text").alias("excerpt"))


SQL_REPEATED = f"""
    each AS (SELECT source, doc_id, {sql_strip('u.line')} AS line
             FROM documents, unnest({sql_lines('text')}) AS u(line)),
    repeated AS (SELECT source, line, count(DISTINCT doc_id) AS pages FROM each
                 WHERE length(line) >= 3 GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3)
"""


@report(f"WITH {SQL_REPEATED} SELECT source, line, pages FROM repeated")
def repeated_source_lines(spark: SparkSession, sf: str) -> DataFrame:
    return B.repeated_lines(table(spark, sf, "documents", costly=True), "source", "text")


SQL_STRIPPED = f"""
    WITH {SQL_REPEATED},
    l AS (SELECT source, doc_id, unnest({sql_lines('text')}) AS line,
                 generate_subscripts({sql_lines('text')}, 1) AS pos FROM documents),
    kept AS (SELECT l.* FROM l ANTI JOIN repeated r ON l.source = r.source AND {sql_strip('l.line')} = r.line),
    body AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM kept
             WHERE NOT regexp_matches({sql_strip('line')}, '(?i)^\\s*(?:page\\s*)?\\d+(?:\\s*(?:of|/)\\s*\\d+)?\\s*$')
             GROUP BY 1)
    SELECT d.doc_id, coalesce(b.text, '') AS text FROM documents d LEFT JOIN body b USING (doc_id)
"""


@report(SQL_STRIPPED)
def documents_without_repeats(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", costly=True).select("source", "doc_id", "text")
    repeated = B.repeated_lines(docs, "source", "text")
    return B.strip_repeated(docs, "source", "doc_id", "text", repeated).select("doc_id", "text")


@report(SQL_STRIPPED)
def documents_without_repeats_by_join(spark: SparkSession, sf: str) -> DataFrame:
    """The way of a repeated-line table too large to send to every task."""
    docs = table(spark, sf, "documents", costly=True).select("source", "doc_id", "text")
    repeated = B.repeated_lines(docs, "source", "text")
    return B._strip_by_join(docs, "source", "text", repeated).select("doc_id", "text")


@report(
    """
    SELECT p_partkey, 'Row from part: p_partkey=' || p_partkey || '; p_name=' || p_name || '; p_brand=' || p_brand
           || coalesce('; p_type=' || CASE WHEN p_size <> 11 THEN p_type END, '') || '; p_size=' || p_size
           || '; p_retailprice=' || p_retailprice || '.' AS body
    FROM part
    """
)
def part_row_bodies(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumn("p_type", F.when(F.col("p_size") != 11, F.col("p_type")))
    return part.select("p_partkey", X.row_body("part", part.schema.fields).alias("body"))


@report(
    """
    SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ') AS tokens
    FROM benchmark
    """
)
def benchmark_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.array_join(F.sort_array(X.name_tokens("text")), " ")
    return table(spark, sf, "benchmark").select("item_id", tokens.alias("tokens"))


# --- conversations ----------------------------------------------------------


@report(
    """
    SELECT conv_id, turn, role, text FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4
    """
)
def latest_messages(spark: SparkSession, sf: str) -> DataFrame:
    return H.last_messages(table(spark, sf, "conversations"), "conv_id", "turn", history_turns=2).select(
        "conv_id", "turn", "role", "text"
    )


@report(
    f"""
    WITH recent AS (SELECT conv_id, turn, role, {sql_strip('text')} AS body FROM conversations
                    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8)
    SELECT conv_id, string_agg(coalesce(role, '?') || ': ' || substring(body, 1, 400), chr(10) ORDER BY turn) AS transcript
    FROM recent WHERE length(body) > 0 GROUP BY conv_id
    """
)
def conversation_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return H.transcripts(table(spark, sf, "conversations"), "conv_id", "turn", content="text")


# --- grids ------------------------------------------------------------------


def document_grids(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a ragged grid: a row per line, a cell per comma."""
    docs = table(spark, sf, "documents", costly=True)
    rows = docs.select("doc_id", F.posexplode(X.lines("text")).alias("row", "line"))
    return rows.select(
        F.col("doc_id").alias("table_id"), "row", F.split("line", ",").alias("cells")
    )


def _sql_cell(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SQL_BLANK}+', ' ', 'g'))"


SQL_GRIDS = f"""
    raw AS (SELECT doc_id AS t, unnest({sql_lines('text')}) AS line,
                   generate_subscripts({sql_lines('text')}, 1) AS r FROM documents),
    cell AS (SELECT t, r, unnest(string_split(line, ',')) AS c,
                    generate_subscripts(string_split(line, ','), 1) AS k FROM raw),
    clean AS (SELECT t, r, k, {_sql_cell('c')} AS c FROM cell),
    rws AS (SELECT t, r, row_number() OVER (PARTITION BY t ORDER BY r) - 1 AS rn
            FROM (SELECT DISTINCT t, r FROM clean WHERE c <> '')),
    cls AS (SELECT DISTINCT t, k FROM clean WHERE c <> ''),
    grid AS (SELECT rws.t, rws.rn AS r, cls.k, coalesce(clean.c, '') AS c
             FROM rws JOIN cls USING (t) LEFT JOIN clean ON clean.t = rws.t AND clean.r = rws.r AND clean.k = cls.k),
    fact AS (SELECT t, max(r) + 1 AS n_rows, count(DISTINCT k) AS n_cols,
                    avg(CASE WHEN c = '' THEN 1.0 ELSE 0.0 END) AS empty_share FROM grid GROUP BY t)
"""


@report(
    f"""WITH {SQL_GRIDS}
    SELECT t AS table_id, r AS row, string_agg(c, ' | ' ORDER BY k) AS cells FROM grid GROUP BY 1, 2"""
)
def cleaned_grids(spark: SparkSession, sf: str) -> DataFrame:
    return G.clean_grids(document_grids(spark, sf)).select(
        "table_id", "row", F.array_join("cells", " | ").alias("cells")
    )


@report(
    f"""WITH {SQL_GRIDS}
    SELECT t AS table_id, n_rows AS rows, n_cols::INT AS columns, round(empty_share, 6) AS empty_share
    FROM fact WHERE n_rows >= 2 AND n_cols >= 2 AND empty_share <= 0.7"""
)
def valid_grid_facts(spark: SparkSession, sf: str) -> DataFrame:
    valid = G.valid_grids(G.clean_grids(document_grids(spark, sf)))
    return G.grid_facts(valid).select(
        "table_id", "rows", "columns", F.round("empty_share", 6).alias("empty_share")
    )


SQL_CSV = f"""
    WITH {SQL_GRIDS},
    top AS (SELECT t, n_rows, n_cols,
              (SELECT count(*) FROM grid g WHERE g.t = f.t AND r = 0 AND c <> '') AS f0,
              (SELECT count(*) FROM grid g WHERE g.t = f.t AND r = 1 AND c <> '') AS f1,
              (SELECT count(*) FROM grid g WHERE g.t = f.t AND r = 2 AND c <> '') AS f2,
              (SELECT count(*) FROM grid g WHERE g.t = f.t AND r = 3 AND c <> '') AS f3
            FROM fact f WHERE n_rows >= 2 AND n_cols >= 2 AND empty_share <= 0.7),
    cut AS (SELECT *,
              CASE WHEN NOT (n_rows > 2 AND f0 * 2 < n_cols AND f1 > f0) THEN 0
                   WHEN NOT (n_rows > 3 AND f1 * 2 < n_cols AND f2 > f1) THEN 1
                   WHEN NOT (n_rows > 4 AND f2 * 2 < n_cols AND f3 > f2) THEN 2 ELSE 3 END AS dropped,
            FROM top),
    body AS (SELECT g.t, g.r - cut.dropped AS r, row_number() OVER (PARTITION BY g.t, g.r ORDER BY k) AS k, c, n_cols
             FROM grid g JOIN cut USING (t) WHERE g.r >= cut.dropped),
    dense AS (SELECT t, count(*) FILTER (c <> '') * 2 >= max(n_cols) AS dense FROM body WHERE r = 0 GROUP BY t),
    named AS (SELECT body.t, r, k, CASE WHEN r = 0 AND c = '' AND dense THEN 'col_' || k ELSE c END AS c
              FROM body JOIN dense USING (t)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY t, r, c ORDER BY k) AS nth FROM named),
    fixed AS (SELECT t, r, k, CASE WHEN r = 0 AND c <> '' AND nth > 1 THEN c || '_' || nth ELSE c END AS c FROM numbered)
"""


@report(
    SQL_CSV
    + """SELECT t AS table_id, r AS row,
           string_agg(CASE WHEN regexp_matches(c, '[,"\\r\\n]') THEN '"' || replace(c, '"', '""') || '"' ELSE c END,
                      ',' ORDER BY k) AS line
    FROM fixed GROUP BY 1, 2"""
)
def grid_csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    valid = G.valid_grids(G.clean_grids(document_grids(spark, sf)))
    ready = G.fix_headers(G.strip_titles(valid))
    return ready.select("table_id", "row", G.csv_line(F.col("cells")).alias("line"))


@report(
    f"""WITH {SQL_GRIDS},
    lines AS (SELECT t, r, '| ' || string_agg(c, ' | ' ORDER BY k) || ' |' || chr(10)
                 || CASE WHEN r = 0 THEN '| ' || string_agg('---', ' | ') || ' |' || chr(10) ELSE '' END AS line
              FROM grid JOIN fact USING (t) WHERE n_rows >= 2 AND n_cols >= 2 AND empty_share <= 0.7 GROUP BY t, r)
    SELECT t::VARCHAR AS file, 'table' AS chunk_type, string_agg(line, '' ORDER BY r) AS text
    FROM lines GROUP BY t, r // 10000"""
)
def grid_table_chunks(spark: SparkSession, sf: str) -> DataFrame:
    valid = G.valid_grids(G.clean_grids(document_grids(spark, sf)))
    chunks = C.table_chunks(G.pipe_tables(valid), C.Source("documents"), F.col("table_id").cast("string"))
    return chunks.select("file", "chunk_type", "text")


# --- questions --------------------------------------------------------------


def part_questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per part, in eight wordings by key."""
    p = table(spark, sf, "part")
    brand = F.replace("p_brand", F.lit("#"), F.lit(" "))
    price = F.col("p_retailprice").cast("string")
    size = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 8
    text = (
        F.when(kind == 0, F.concat(F.lit("What is the price of "), brand, F.lit(" "), F.col("p_type"), F.lit("?")))
        .when(kind == 1, F.concat(F.lit("Parts with retailprice greater than "), price))
        .when(kind == 2, F.concat(F.lit("Show me parts where p_size is less than "), size))
        .when(kind == 3, F.concat(F.lit("List all parts of type "), F.col("p_type")))
        .when(kind == 4, F.concat(F.lit("Average price by year for "), brand, F.lit(", please")))
        .when(kind == 5, F.concat(brand, F.lit(" Plan has the highest retail price, size > "), size))
        .when(kind == 6, F.concat(F.lit("Top "), size, F.lit(" parts, p_type = "), F.col("p_type")))
        .otherwise(F.concat(F.lit("Find the "), F.col("p_name"), F.lit(" size: "), size))
    )
    return p.select(F.col("p_partkey").alias("query_id"), text.alias("question"))


SQL_QUESTIONS = """
    q AS (SELECT p_partkey AS query_id, CASE p_partkey % 8
        WHEN 0 THEN 'What is the price of ' || replace(p_brand, '#', ' ') || ' ' || p_type || '?'
        WHEN 1 THEN 'Parts with retailprice greater than ' || p_retailprice
        WHEN 2 THEN 'Show me parts where p_size is less than ' || p_size
        WHEN 3 THEN 'List all parts of type ' || p_type
        WHEN 4 THEN 'Average price by year for ' || replace(p_brand, '#', ' ') || ', please'
        WHEN 5 THEN replace(p_brand, '#', ' ') || ' Plan has the highest retail price, size > ' || p_size
        WHEN 6 THEN 'Top ' || p_size || ' parts, p_type = ' || p_type
        ELSE 'Find the ' || p_name || ' size: ' || p_size END AS question FROM part)
"""


def _sql_any(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def _sql_plan(source: str) -> str:
    """SQL reading of ``question`` rows; RE2 has no look-ahead, so the end of a
    referred entity is matched as part of the pattern instead."""
    referred = (
        r"\b(?:of|for|about|regarding)\s+([A-Z][A-Za-z0-9 &\-]{2,80}?)"
        r"\s*(?:\?|$|,|\.|;|in\b|on\b|doesn|does|has\b|have\b|with\b)"
    )
    run = Q.CAPITALISED_RUN
    starters = ", ".join(f"'{w}'" for w in Q.SENTENCE_STARTERS)
    words = "|".join(Q.THRESHOLD_WORDS)
    above = ", ".join(f"'{w}'" for w, s in Q.THRESHOLD_WORDS.items() if s == ">")
    return f"""
    a AS (SELECT query_id, question, {sql_strip('question')} AS t,
            list_transform(regexp_extract_all({sql_strip('question')}, '{referred}', 1), lambda x: trim(x)) AS named,
            list_transform(regexp_extract_all({sql_strip('question')}, '{run}', 1), lambda x: trim(x)) AS runs
          FROM {source}),
    b AS (SELECT *, list_filter(list_transform(runs, lambda x, i:
              CASE WHEN list_contains(named, x) THEN ''
                   WHEN i = 1 AND starts_with(t, x) AND lower(regexp_extract(x, '^\\S+')) IN ({starters})
                   THEN regexp_replace(regexp_replace(x, '^\\S+\\s*', ''), '\\s+', ' ', 'g') ELSE x END),
              lambda x: x <> '') AS trimmed,
            lower(regexp_extract(t, '(?i)(\\b(?:{words})|>=|<=|>|<)\\s*(\\d[\\d,.]*)\\b', 1)) AS word,
            try_cast(replace(regexp_extract(t, '(?i)(\\b(?:{words})|>=|<=|>|<)\\s*(\\d[\\d,.]*)\\b', 2), ',', '') AS DOUBLE) AS v
          FROM a),
    c AS (SELECT query_id, question, lower(t) AS low, named, trimmed, v,
            list_filter(list_concat(named, trimmed), lambda x, i: list_position(list_concat(named, trimmed), x) = i) AS phrases,
            CASE WHEN v IS NULL THEN NULL WHEN word IN ('>', '<', '>=', '<=') THEN word
                 WHEN word IN ({above}) THEN '>' ELSE '<' END AS op FROM b),
    planned AS (SELECT query_id, question, low, phrases, op, v, CASE
          WHEN {_sql_any('low', Q.LIST_DISTINCT_PHRASES)} THEN 'list_distinct'
          WHEN {_sql_any('low', Q.TREND_PHRASES)} THEN 'trend'
          WHEN op IS NOT NULL THEN 'numeric_threshold'
          WHEN len(phrases) > 0 AND (starts_with(low, 'what') OR starts_with(low, 'how much')
               OR starts_with(low, 'tell me') OR contains(low, ' of ')) THEN 'point_lookup'
          WHEN {_sql_any('low', Q.AGGREGATE_WORDS)} THEN 'aggregate'
          WHEN {_sql_any('low', Q.FILTER_PHRASES)} THEN 'filter_rows' ELSE 'qualitative' END AS intent FROM c)
    """


SQL_PLAN_COLUMNS = """
    SELECT query_id, array_to_string(phrases, ' / ') AS phrases, intent, op AS threshold_op, v AS threshold_value,
           CASE WHEN intent = 'trend' THEN CASE WHEN contains(low, 'year') THEN '365d'
                                                WHEN contains(low, 'month') THEN '90d' END END AS trend_window
    FROM planned
"""


def _plan(questions: DataFrame) -> DataFrame:
    planned = questions.withColumns(Q.plan_columns("question"))
    return planned.select(
        "query_id", F.array_join("entity_phrases", " / ").alias("phrases"), "intent",
        "threshold_op", "threshold_value", "trend_window",
    )


@report(f"WITH {SQL_QUESTIONS}, {_sql_plan('q')} {SQL_PLAN_COLUMNS}")
def part_question_plans(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(part_questions(spark, sf))


SQL_MESSAGES = "m AS (SELECT conv_id * 1000 + turn AS query_id, text AS question FROM conversations)"


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question")
    )


@report(f"WITH {SQL_MESSAGES}, {_sql_plan('m')} {SQL_PLAN_COLUMNS}")
def message_plans(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(_messages(spark, sf))


@report(
    f"""WITH {SQL_QUESTIONS},
    p AS (SELECT query_id, unnest(regexp_extract_all(question, '{Q.CELL_PREDICATE}', 1)) AS c,
                 unnest(regexp_extract_all(question, '{Q.CELL_PREDICATE}', 2)) AS v FROM q)
    SELECT query_id, trim(c) AS "column", trim(v) AS value FROM p WHERE trim(c) <> '' AND trim(v) <> ''"""
)
def question_cell_predicates(spark: SparkSession, sf: str) -> DataFrame:
    found = part_questions(spark, sf).select("query_id", F.explode(Q.cell_predicates(F.col("question"))).alias("p"))
    return found.select("query_id", "p.column", "p.value")


CATALOGUE = {
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
}


@report(
    f"""WITH {SQL_QUESTIONS},
    cols AS (SELECT * FROM (VALUES {', '.join(f"('{t}', '{c}', {i})" for t, cs in CATALOGUE.items() for i, c in enumerate(cs))})
             AS x("table", "column", position)),
    tok AS (SELECT "table", "column", position, list_distinct(regexp_extract_all(lower("column"), '[a-z0-9]+')) AS c FROM cols),
    asked AS (SELECT query_id, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS a FROM q),
    s AS (SELECT query_id, "table", "column", position, len(list_intersect(a, c)) AS hits, len(c) AS n FROM asked, tok)
    SELECT query_id, "table", "column", round(hits / n + 0.001 * hits, 6) AS score FROM s WHERE hits > 0
    QUALIFY row_number() OVER (PARTITION BY query_id, "table" ORDER BY hits / n + 0.001 * hits DESC, position) = 1"""
)
def question_columns(spark: SparkSession, sf: str) -> DataFrame:
    catalogue = CT.column_catalogue({t: table(spark, sf, t) for t in CATALOGUE})
    found = CT.resolve_columns(part_questions(spark, sf), catalogue)
    return found.select("query_id", "table", "column", F.round("score", 6).alias("score"))


@report(
    f"""WITH {SQL_QUESTIONS}, {_sql_plan('q')},
    keys AS (SELECT DISTINCT {sql_canonical('p_brand')} AS k FROM part),
    ph AS (SELECT query_id, unnest(phrases) AS p, generate_subscripts(phrases, 1) AS pos FROM planned),
    tk AS (SELECT query_id, pos, length(p) AS len, string_split({sql_canonical('p')}, ' ') AS w FROM ph),
    tr AS (SELECT query_id, pos, len, cut, array_to_string(w[1 : len(w) - cut], ' ') AS k
           FROM (SELECT *, unnest(range(0, len(w))) AS cut FROM tk)),
    hit AS (SELECT query_id, arg_min(k, (-len, pos, cut)) AS canonical_id FROM tr JOIN keys USING (k) GROUP BY 1)
    SELECT q.query_id, canonical_id FROM q LEFT JOIN hit ON q.query_id = hit.query_id"""
)
def question_entities(spark: SparkSession, sf: str) -> DataFrame:
    questions = part_questions(spark, sf).withColumn("entity_phrases", Q.entity_phrases(F.col("question")))
    aliases = E.alias_table(table(spark, sf, "part"), "p_brand")
    ids = aliases.select("canonical_id").distinct()
    return E.resolve_entities(questions, aliases, ids).select("query_id", "canonical_id")


@report(
    f"""WITH {SQL_QUESTIONS}, m AS (SELECT query_id, lower(question) AS low,
        ['chat', 'aggregate', 'query', 'auto'][query_id % 4 + 1] AS mode FROM q),
    k AS (SELECT *, {_sql_any('low', Q.AGGREGATE_WORDS)} OR {_sql_any('low', Q.ROW_QUERY_PHRASES)} AS worded FROM m)
    SELECT query_id, mode, CASE mode WHEN 'chat' THEN false WHEN 'auto' THEN worded ELSE mode = 'aggregate' END AS aggregates,
           CASE mode WHEN 'chat' THEN false WHEN 'auto' THEN worded ELSE mode = 'query' END AS rows FROM k"""
)
def question_capabilities(spark: SparkSession, sf: str) -> DataFrame:
    modes = F.array(*[F.lit(m) for m in Q.MODES])
    q = part_questions(spark, sf).withColumn("mode", F.element_at(modes, (F.col("query_id") % 4 + 1).cast("int")))
    args = (F.col("question"), F.col("mode"), F.lit(True))
    return q.select(
        "query_id", "mode", Q.wants_aggregate(*args).alias("aggregates"), Q.wants_rows(*args).alias("rows")
    )


@report(
    f"""WITH {SQL_QUESTIONS}, {_sql_plan('q')},
    nxt AS (SELECT query_id, phrases, coalesce(lead(phrases) OVER (ORDER BY query_id), []) AS more FROM planned),
    both_ AS (SELECT query_id, list_concat(phrases, more) AS l FROM nxt)
    SELECT query_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' / ') AS phrases FROM both_"""
)
def merged_question_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Each question takes over the phrases of the next one as its rewriting."""
    q = part_questions(spark, sf).withColumn("entity_phrases", Q.entity_phrases(F.col("question")))
    rewritten = q.select((F.col("query_id") - 1).alias("query_id"), F.col("entity_phrases").alias("more"))
    more = F.coalesce("more", F.array().cast("array<string>"))
    merged = q.join(rewritten, "query_id", "left").withColumn("p", Q.merged_phrases(F.col("entity_phrases"), more))
    return merged.select("query_id", F.array_join("p", " / ").alias("phrases"))
