"""Vectors, postings, retrieval and questions across tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegrist.functions import questions as Q
from tablegrist.functions import text as X
from tablegrist.functions.vectors import l2_norm
from tablegrist.operators import chunks as C
from tablegrist.operators import crosstable as CT
from tablegrist.operators import entities as E
from tablegrist.operators import postings as P
from tablegrist.operators import retrieval as R
from tablegrist.operators import vectors as V
from tablegrist.session import small_table
from tablegrist.plans.reports import report, sql_canonical, table

# --- vectors ----------------------------------------------------------------


@report(
    """
    SELECT vec_id, round(sqrt(list_dot_product(e, e)), 4) AS norm, round(list_sum(e) / sqrt(list_dot_product(e, e)), 4) AS total
    FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7)) AS e FROM embeddings)
    """
    .replace("round(sqrt(list_dot_product(e, e)), 4) AS norm", "1.0::DOUBLE AS norm")
)
def unit_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    stretched = table(spark, sf, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)).alias("vec"),
    )
    unit = V.unit_vectors(stretched, "vec")
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return unit.select("vec_id", F.round(l2_norm("vec"), 4).alias("norm"), F.round(total, 4).alias("total"))


def label_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query vector per label: the unit mean of its embeddings."""
    emb = table(spark, sf, "embeddings").select("label", F.col("embedding").alias("vec"))
    means = V.unit_vectors(V.mean_vectors(emb, "label", "vec"), "vec")
    return means.select(F.col("label").alias("query_id"), "vec")


SQL_LABEL_QUERIES = """
    comp AS (SELECT label, u.pos, avg(u.x::DOUBLE) AS x
             FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) u
             GROUP BY 1, 2),
    mean AS (SELECT label AS query_id, list(x ORDER BY pos) AS m FROM comp GROUP BY 1),
    qv AS (SELECT query_id, list_transform(m, lambda x: (x / sqrt(list_dot_product(m, m)))::FLOAT::DOUBLE) AS q FROM mean),
    emb AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
"""


@report(
    f"""WITH {SQL_LABEL_QUERIES}
    SELECT query_id, vec_id AS chunk_id, round(list_dot_product(q, e), 4) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q, e) DESC, vec_id)::INT AS rank
    FROM qv, emb QUALIFY rank <= 10"""
)
def nearest_to_label_means(spark: SparkSession, sf: str) -> DataFrame:
    corpus = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    found = V.top_k(label_queries(spark, sf), corpus, 10)
    return found.select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


@report(
    f"""WITH {SQL_LABEL_QUERIES}
    SELECT query_id, vec_id AS chunk_id, round(list_dot_product(q, e), 4) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q, e) DESC, vec_id)::INT AS rank
    FROM qv, emb QUALIFY rank <= 10"""
)
def nearest_to_label_means_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The way of more queries than may be sent to every task."""
    corpus = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    found = V.top_k(label_queries(spark, sf), corpus, 10, max_shipped=4)
    return found.select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


@report(
    """
    WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp,
                      stddev_pop(l_extendedprice) AS sp, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(((l_quantity - mq) / sq)::FLOAT::DOUBLE, 5) AS quantity,
           round(CASE WHEN l_returnflag = 'N' THEN 0 ELSE ((l_extendedprice - mp) / sp)::FLOAT::DOUBLE END, 5) AS price,
           round(((l_discount - md) / sd)::FLOAT::DOUBLE, 5) AS discount
    FROM lineitem, s
    """
)
def scaled_lineitems(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    scaler = V.fit_scaler(li, "lineitem", ["l_quantity", "l_extendedprice", "l_discount"])
    gaps = li.withColumn("l_extendedprice", F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")))
    scaled = gaps.select("l_orderkey", "l_linenumber", V.scaled_vector(gaps, scaler).alias("vec"))
    return scaled.select(
        "l_orderkey", "l_linenumber",
        *[F.round(F.col("vec")[i].cast("double"), 5).alias(n) for i, n in enumerate(("quantity", "price", "discount"))],
    )


def _file_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Scaled vectors of two tables of different width, and per table one query
    vector per category (its mean)."""
    corpus, queries = [], []
    for t, key, columns, by in (
        ("part", "p_partkey", ["p_size", "p_retailprice"], "p_type"),
        ("customer", "c_custkey", ["c_acctbal", "c_nationkey", "c_custkey"], "c_mktsegment"),
    ):
        df = table(spark, sf, t)
        scaler = V.fit_scaler(df, t, columns)
        vec = df.select(key, by, V.scaled_vector(df, scaler).alias("vec"))
        corpus.append(vec.select(F.lit(t).alias("file_id"), F.col(key).alias("chunk_id"), "vec"))
        mean = V.mean_vectors(vec, by, "vec")
        queries.append(mean.select(F.lit(t).alias("file_id"), F.concat_ws("/", F.lit(t), by).alias("query_id"), "vec"))
    return C.union_all(queries), C.union_all(corpus)


def _sql_z(t: str, key: str, cols: list[str], by: str) -> str:
    cells = ", ".join(
        f"(({c} - (SELECT avg({c}) FROM {t})) / (SELECT stddev_pop({c}) FROM {t}))::FLOAT::DOUBLE" for c in cols
    )
    return f"SELECT '{t}' AS f, {key} AS id, {by} AS grp, [{cells}] AS v FROM {t}"


@report(
    f"""WITH c AS ({_sql_z('part', 'p_partkey', ['p_size', 'p_retailprice'], 'p_type')}
                   UNION ALL {_sql_z('customer', 'c_custkey', ['c_acctbal', 'c_nationkey', 'c_custkey'], 'c_mktsegment')}),
    x AS (SELECT f, grp, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM c),
    m AS (SELECT f, grp, pos, avg(x) AS x FROM x GROUP BY ALL),
    q AS (SELECT f, grp, list(x ORDER BY pos) AS q FROM m GROUP BY ALL),
    d AS (SELECT c.f || '/' || q.grp AS query_id, id AS chunk_id, list_distance(v, q) AS d
          FROM c JOIN q ON c.f = q.f)
    SELECT query_id, chunk_id, round(d, 4) AS distance,
           row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id)::INT AS rank FROM d QUALIFY rank <= 5"""
)
def nearest_rows_per_table(spark: SparkSession, sf: str) -> DataFrame:
    queries, corpus = _file_vectors(spark, sf)
    found = V.top_k(queries, corpus, 5, metric=V.EUCLIDEAN, group="file_id")
    return found.select("query_id", "chunk_id", F.round("score", 4).alias("distance"), "rank")


@report(
    """
    SELECT vec_id AS chunk_id, label, round(list_sum(embedding)::DOUBLE, 3) AS total FROM embeddings
    WHERE label NOT IN (SELECT label FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
    UNION ALL
    SELECT vec_id + 1000000, label, round(list_sum(embedding)::DOUBLE, 3) FROM embeddings
    """
)
def vectors_after_append_and_delete(spark: SparkSession, sf: str) -> DataFrame:
    """The largest label is deleted, then all vectors come again under new ids."""
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", F.col("embedding").alias("vec"))
    largest = emb.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(1)
    deleted = emb.join(largest, "label", "left_semi")
    again = emb.withColumn("chunk_id", F.col("chunk_id") + 1000000)
    kept = V.append_vectors(V.keep_vectors(emb, deleted), again, dim=64)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return kept.select("chunk_id", "label", F.round(total, 3).alias("total"))


# --- postings ---------------------------------------------------------------


def part_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``part`` as row chunks (all of them) and the source frame."""
    source = C.Source("part.parquet")
    rows = C.row_frame(table(spark, sf, "part", costly=True), source, "p_partkey", "p_name", cap=None)
    return rows, C.row_chunks(rows, source, "p_partkey")


PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def part_postings(spark: SparkSession, sf: str) -> DataFrame:
    rows, chunks = part_rows(spark, sf)
    listed = C.enumeration_chunks(table(spark, sf, "part"), C.Source("part.parquet"))
    return (
        P.cell_postings(rows, PART_COLUMNS)
        .unionByName(P.id_postings(chunks))
        .unionByName(P.enum_postings(listed))
    )


SQL_POSTINGS = f"""
    src AS (SELECT *, sha256(sha256('part.parquet') || '|row|' || p_partkey) AS chunk_id FROM part),
    cells AS (
      {' UNION ALL '.join(f"SELECT '{c}' AS key, {sql_canonical(c + '::VARCHAR')} AS value, chunk_id FROM src WHERE {c} IS NOT NULL" for c in PART_COLUMNS)}),
    posts AS (
      SELECT 'cell' AS kind, key, value, chunk_id FROM cells WHERE value <> ''
      UNION ALL SELECT 'id', {sql_canonical('p_name')}, '', chunk_id FROM src WHERE {sql_canonical('p_name')} <> ''
      UNION ALL
      {' UNION ALL '.join(f"SELECT 'enum', '{c}', '', sha256(sha256('part.parquet') || '|enumeration|{c}') FROM (SELECT count(DISTINCT {c}) AS d FROM part) WHERE d > 1" for c in ('p_name', 'p_brand', 'p_type'))})
"""


@report(f"WITH {SQL_POSTINGS} SELECT kind, key, value, chunk_id FROM posts")
def part_postings_built(spark: SparkSession, sf: str) -> DataFrame:
    return part_postings(spark, sf)


@report(f"WITH {SQL_POSTINGS} SELECT count(*) AS postings FROM posts")
def part_postings_total(spark: SparkSession, sf: str) -> DataFrame:
    return P.total_postings(part_postings(spark, sf))


@report(
    f"""WITH {SQL_POSTINGS},
    keys AS (SELECT DISTINCT 'brand/' || p_brand AS query_id, 'cell' AS kind, 'p_brand' AS key, {sql_canonical('p_brand')} AS value FROM part
             UNION ALL SELECT DISTINCT 'name/' || p_name, 'id', {sql_canonical('p_name')}, '' FROM part
             UNION ALL SELECT DISTINCT 'enum/' || p_type, 'enum', 'p_type', '' FROM part)
    SELECT query_id, kind, count(DISTINCT chunk_id) AS hits, min(chunk_id) AS first_chunk
    FROM posts JOIN keys USING (kind, key, value) GROUP BY 1, 2"""
)
def part_posting_hits(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    shouted = F.concat(F.lit("  The "), F.upper("p_brand"), F.lit(" "))
    asked = C.union_all(
        [
            part.select(
                F.concat(F.lit("brand/"), "p_brand").alias("query_id"), F.lit("cell").alias("kind"),
                F.lit("P_BRAND").alias("column"), shouted.alias("value"),
            ).distinct(),
            part.select(
                F.concat(F.lit("name/"), "p_name").alias("query_id"), F.lit("id").alias("kind"),
                F.lit("").alias("column"), X.canonical_name("p_name").alias("value"),
            ).distinct(),
            part.select(
                F.concat(F.lit("enum/"), "p_type").alias("query_id"), F.lit("enum").alias("kind"),
                F.lit("P_Type").alias("column"), F.lit("").alias("value"),
            ).distinct(),
        ]
    )
    hits = P.lookup(part_postings(spark, sf), P.lookup_keys(asked))
    return hits.groupBy("query_id", "kind").agg(
        F.count(F.lit(1)).alias("hits"), F.min("chunk_id").alias("first_chunk")
    )


@report(
    f"""WITH {SQL_POSTINGS}, gone AS (SELECT chunk_id FROM src WHERE p_type = 'ECONOMY')
    SELECT kind, key, count(*) AS postings FROM posts WHERE chunk_id NOT IN (SELECT chunk_id FROM gone) GROUP BY 1, 2"""
)
def part_postings_after_delete(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = part_rows(spark, sf)
    deleted = rows.filter(F.col("p_type") == "ECONOMY").select("chunk_id")
    left = P.remove_chunks(part_postings(spark, sf), deleted)
    return left.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("postings"))


@report(
    f"""
    SELECT p_partkey, {sql_canonical('p_brand')} AS canonical_id FROM part
    """
)
def brands_resolved_by_alias(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    phrases = part.select("p_partkey", F.concat(F.lit("the "), F.upper("p_brand"), F.lit("  plan")).alias("phrase"))
    return E.resolve_aliases(phrases, E.alias_table(part, "p_brand")).select("p_partkey", "canonical_id")


# --- retrieval --------------------------------------------------------------

K = 5


def retrieval_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Questions, chunks, postings, vectors. A question per embedding label,
    about the first part of that label; chunk vectors are the embeddings of the
    parts with the same key."""
    part = table(spark, sf, "part")
    rows, chunks = part_rows(spark, sf)
    emb = table(spark, sf, "embeddings")
    vectors = rows.join(emb, F.col("p_partkey") == F.col("vec_id")).select(
        "chunk_id", F.col("embedding").alias("vec")
    )
    about = (
        emb.join(part, F.col("vec_id") == F.col("p_partkey"))
        .groupBy("label")
        .agg(F.min_by("p_name", "p_partkey").alias("name"), F.min_by("p_type", "p_partkey").alias("type"))
    )
    wording = F.when(
        F.col("label") % 3 == 0, F.concat(F.lit("Show me parts, p_type = "), "type")
    ).when(F.col("label") % 3 == 1, F.concat(F.lit("What is the price of "), "name", F.lit("?"))).otherwise(
        F.concat(F.lit("Hello, p_type: "), "type")
    )
    entity = F.when(F.col("label") % 3 == 1, X.canonical_name("name"))
    asked = about.select(
        F.col("label").alias("query_id"), wording.alias("question"), entity.alias("canonical_id")
    )
    intents = Q.intent(F.col("question"), Q.entity_phrases(F.col("question")))
    questions = asked.join(label_queries(spark, sf), "query_id").withColumn("intent", intents)
    postings = P.cell_postings(rows, PART_COLUMNS).unionByName(P.id_postings(chunks))
    return questions, chunks, postings, vectors


def _sql_retrieval(k: int) -> str:
    return f"""
    {SQL_POSTINGS}, {SQL_LABEL_QUERIES},
    about AS (SELECT label, arg_min(p_name, p_partkey) AS name, arg_min(p_type, p_partkey) AS type
              FROM embeddings JOIN part ON vec_id = p_partkey GROUP BY 1),
    qs AS (SELECT label AS query_id, CASE label % 3 WHEN 0 THEN 'Show me parts, p_type = ' || type
                  WHEN 1 THEN 'What is the price of ' || name || '?' ELSE 'Hello, p_type: ' || type END AS question,
                  CASE WHEN label % 3 = 1 THEN {sql_canonical('name')} END AS canonical_id,
                  CASE label % 3 WHEN 0 THEN 'filter_rows' ELSE 'qualitative' END AS intent,
                  CASE WHEN label % 3 <> 1 THEN {sql_canonical('type')} END AS cell FROM about),
    sim AS (SELECT qv.query_id, src.chunk_id, list_dot_product(q, e) AS s
            FROM qv, emb JOIN src ON vec_id = p_partkey
            QUALIFY row_number() OVER (PARTITION BY qv.query_id ORDER BY list_dot_product(q, e) DESC, src.chunk_id) <= {max(4 * k, 20)}),
    sig AS (SELECT query_id, chunk_id, true AS id, false AS cell, NULL::DOUBLE AS s FROM posts JOIN qs ON kind = 'id' AND key = canonical_id
            UNION ALL SELECT query_id, chunk_id, false, true, NULL FROM posts JOIN qs ON kind = 'cell' AND key = 'p_type' AND value = qs.cell
            UNION ALL SELECT query_id, chunk_id, false, false, s FROM sim),
    cand AS (SELECT query_id, chunk_id, bool_or(id) AS exact_id, bool_or(cell) AS exact_cell, coalesce(max(s), 0) AS text_sim
             FROM sig GROUP BY 1, 2),
    scored AS (SELECT cand.*, intent, question, p_partkey, p_name,
                 CASE WHEN exact_id THEN 1.0 ELSE 0 END + CASE WHEN exact_cell THEN 0.4 ELSE 0 END + 0.5 * text_sim
                 + 0.2 * CASE intent WHEN 'filter_rows' THEN 1.0 ELSE 0.1 END AS score,
                 'Row from part.parquet: p_partkey=' || p_partkey || '; p_name=' || p_name || '; p_brand=' || p_brand
                 || '; p_type=' || p_type || '; p_size=' || p_size || '; p_retailprice=' || p_retailprice || '.' AS text
               FROM cand JOIN qs USING (query_id) JOIN src USING (chunk_id)),
    linear AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, exact_id ORDER BY score DESC, chunk_id) AS place
               FROM scored),
    judged AS (SELECT *, CASE WHEN NOT exact_id AND place <= 20
                 THEN len(list_intersect(string_split(lower(question), ' '), string_split(lower(text), ' '))) END AS ce FROM placed),
    final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact_id DESC, ce DESC NULLS LAST, place) AS rank
              FROM judged),
    top AS (SELECT *, CASE WHEN exact_id THEN 1.0 WHEN exact_cell THEN 0.95 ELSE round(text_sim, 3) END AS shown
            FROM final WHERE rank <= {k})
"""


SQL_RETRIEVAL = _sql_retrieval(K)


@report(
    f"""WITH {SQL_RETRIEVAL}
    SELECT query_id, chunk_id, exact_id, exact_cell, round(text_sim, 4) AS text_sim FROM cand"""
)
def merged_candidates(spark: SparkSession, sf: str) -> DataFrame:
    questions, _, postings, vectors = retrieval_inputs(spark, sf)
    return R.candidates(questions, postings, vectors, K).select(
        "query_id", "chunk_id", "exact_id", "exact_cell", F.round("text_sim", 4).alias("text_sim")
    )


def scored_candidates(spark: SparkSession, sf: str, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    questions, chunks, postings, vectors = retrieval_inputs(spark, sf)
    found = R.candidates(questions, postings, vectors, k)
    return R.score_candidates(found, chunks), questions, chunks


@report(
    f"""WITH {SQL_RETRIEVAL}
    SELECT query_id, chunk_id, intent, round(score, 4) AS score, rank::INT AS rank FROM linear WHERE rank <= {K}"""
)
def linear_ranking(spark: SparkSession, sf: str) -> DataFrame:
    scored, _, _ = scored_candidates(spark, sf)
    return R.linear_top_k(scored, K).select(
        "query_id", "chunk_id", "intent", F.round("score", 4).alias("score"), "rank"
    )


def final_ranking(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    scored, questions, chunks = scored_candidates(spark, sf)
    return questions, R.second_stage(scored, questions, chunks, K)


SQL_RANKED = """
    SELECT query_id, chunk_id, ce::DOUBLE AS ce_score, rank::INT AS rank, shown::DOUBLE AS source_score,
           CASE WHEN exact_id THEN 'exact' WHEN exact_cell THEN 'field' ELSE 'semantic' END AS match FROM top"""


@report(f"WITH {SQL_RETRIEVAL} {SQL_RANKED}")
def second_stage_ranking(spark: SparkSession, sf: str) -> DataFrame:
    _, ranked = final_ranking(spark, sf)
    return R.with_source_score(ranked).select(
        "query_id", "chunk_id", "ce_score", "rank", "source_score", "match"
    )


@report(f"WITH {_sql_retrieval(60)} {SQL_RANKED}")
def second_stage_ranking_of_sixty(spark: SparkSession, sf: str) -> DataFrame:
    """More results than the second stage judges: the others follow in linear order."""
    scored, questions, chunks = scored_candidates(spark, sf, 60)
    return R.with_source_score(R.second_stage(scored, questions, chunks, 60)).select(
        "query_id", "chunk_id", "ce_score", "rank", "source_score", "match"
    )


@report(
    f"""WITH {SQL_RETRIEVAL},
    t AS (SELECT query_id, bool_and(exact_id) AS ex, avg(shown) AS a FROM top WHERE rank <= 3 GROUP BY 1)
    SELECT query_id, CASE WHEN ex THEN 'deterministic' WHEN a >= 0.85 THEN 'grounded' ELSE 'semantic' END AS tier,
           CASE WHEN ex THEN 1.0 ELSE round(a, 3) END::DOUBLE AS value,
           CASE WHEN ex THEN 'all top sources are exact entity matches'
                WHEN a >= 0.85 THEN 'strong source overlap (avg ' || round(a * 100)::INT || '%)'
                ELSE 'semantic-only retrieval (avg ' || round(a * 100)::INT || '%)' END AS reason FROM t"""
)
def answer_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return R.confidence(*final_ranking(spark, sf))


@report(
    f"""WITH {SQL_RETRIEVAL}
    SELECT query_id, string_agg('[' || rank || '] part.parquet' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
    FROM top GROUP BY 1"""
)
def answer_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return R.contexts(*final_ranking(spark, sf))


# --- across tables ----------------------------------------------------------


def _balance_tables(spark: SparkSession, sf: str) -> tuple[dict, dict]:
    """Two tables with a balance, one without."""
    tables = {
        "customers.csv": table(spark, sf, "customer").select(
            F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"),
            F.col("c_acctbal").alias("Account Balance (USD)"),
        ),
        "suppliers.csv": table(spark, sf, "supplier").select(
            F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"),
            F.col("s_acctbal").alias("Balance"),
        ),
        "nations.csv": table(spark, sf, "nation").select("n_nationkey", "n_name"),
    }
    return tables, {"customers.csv": "name", "suppliers.csv": "name", "nations.csv": "n_nationkey"}


BALANCE_QUESTION = "Accounts with balance greater than 9,000"


@report(
    """
    SELECT * FROM (SELECT 'customers.csv' AS "Source File", c_custkey::VARCHAR AS id, c_name AS name,
                          c_acctbal AS "Account Balance (USD)", NULL::DOUBLE AS "Balance"
                   FROM customer WHERE c_acctbal > 9000)
    UNION ALL
    SELECT * FROM (SELECT 'suppliers.csv', s_suppkey::VARCHAR, s_name, NULL, s_acctbal
                   FROM supplier WHERE s_acctbal > 9000)
    """
)
def balances_across_tables(spark: SparkSession, sf: str) -> DataFrame:
    tables, order_by = _balance_tables(spark, sf)
    answer = CT.threshold_search(BALANCE_QUESTION, tables, order_by)
    rows = answer.rows
    # A single contributing table comes without its name; the report keeps one
    # set of columns either way.
    if CT.SOURCE not in rows.columns:
        only = answer.counts.filter(F.col("rows") > 0).first()["table"]
        rows = rows.withColumn(CT.SOURCE, F.lit(only))
    absent = [c for c in answer.columns.values() if c not in rows.columns]
    return rows.withColumns({c: F.lit(None).cast("double") for c in absent})


BALANCE_QUESTIONS = [
    (1, BALANCE_QUESTION), (2, "balance below 100"), (3, "Which accounts have a balance above 5000?"), (4, "hello there"),
]


@report(
    """
    WITH q(query_id, low, high) AS (VALUES (1, 9000.0, NULL), (2, NULL, 100.0), (3, 5000.0, NULL))
    SELECT query_id, 'customers.csv' AS "table", 'Account Balance (USD)' AS "column", c_name AS row, c_acctbal AS value
    FROM q JOIN customer ON c_acctbal > low OR c_acctbal < high
    UNION ALL
    SELECT query_id, 'suppliers.csv', 'Balance', s_name, s_acctbal FROM q JOIN supplier ON s_acctbal > low OR s_acctbal < high
    """
)
def balance_questions_across_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A table of questions against all tables at once."""
    tables, order_by = _balance_tables(spark, sf)
    questions = small_table(spark, BALANCE_QUESTIONS, "query_id int, question string")
    return CT.threshold_hits(questions, tables, order_by)


@report(
    """
    WITH q AS (SELECT i AS query_id, i % 2 = 0 AS above, CASE WHEN i % 2 = 0 THEN 9000 + (i * 7919) % 1000 ELSE (i * 7919) % 300 END AS bound
               FROM range(10000) AS t(i)),
    v AS (SELECT 'customers.csv' AS t, c_acctbal AS x FROM customer UNION ALL SELECT 'suppliers.csv', s_acctbal FROM supplier)
    SELECT query_id, t AS "table", count(*) AS rows, min(x) AS least, max(x) AS most
    FROM q JOIN v ON CASE WHEN above THEN x > bound ELSE x < bound END GROUP BY ALL
    """
)
def ten_thousand_balance_questions(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows each of many questions finds in each table."""
    tables, order_by = _balance_tables(spark, sf)
    i = F.col("id")
    bound = F.pmod(i * 7919, F.when(i % 2 == 0, 1000).otherwise(300))
    asked = spark.range(10_000).select(
        i.alias("query_id"),
        F.when(i % 2 == 0, F.format_string("balance above %d", 9000 + bound)).otherwise(F.format_string("balance below %d", bound)).alias("question"),
    )
    found = CT.threshold_hits(asked, tables, order_by)
    return found.groupBy("query_id", "table").agg(
        F.count(F.lit(1)).alias("rows"), F.min("value").alias("least"), F.max("value").alias("most")
    )


@report(
    """
    SELECT 'customers.csv' AS "table", 'Account Balance (USD)' AS "column",
           (SELECT count(*) FROM customer WHERE c_acctbal > 9000) AS rows
    UNION ALL SELECT 'suppliers.csv', 'Balance', (SELECT count(*) FROM supplier WHERE s_acctbal > 9000)
    """
)
def balance_counts_across_tables(spark: SparkSession, sf: str) -> DataFrame:
    return CT.threshold_search(BALANCE_QUESTION, *_balance_tables(spark, sf)).counts
