"""One registered query for each corpus operator, and SQL where it can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegrist.llm import html_text, toxicity
from tablegrist.llm.cover_tree import top_k
from tablegrist.llm.exact_dedup import grouped
from tablegrist.llm.language_id import held_out, identified
from tablegrist.llm.mixing import by_rank, mix
from tablegrist.llm.rows import located
from tablegrist.llm.segment_join import jaccard_components
from tablegrist.llm.sentence_pieces import with_tokens
from tablegrist.llm.spelling import spelling_variants
from tablegrist.llm.super_minhash import near_duplicates
from tablegrist.llm.token_alignment import aligned_documents
from tablegrist.llm.toxicity import scored
from tablegrist.llm.url_filter import Rule, judged
from tablegrist.llm.warc import archived

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(run: Run) -> Run:
    QUERIES[run.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return with_tokens(
        _table(spark, sf_dir, "documents"), derive=_digests,
        columns="n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


def _digests(ids: list[bytes], decoded: list[str]) -> list[pa.Array]:
    sha256 = lambda x: hashlib.sha256(x).hexdigest()
    return [
        pa.array([len(x) // 4 for x in ids], pa.int64()),
        pa.array([sha256(x) for x in ids]),
        pa.array([sha256(x.encode()) for x in decoded]),
    ]


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and survivor of every document among equal texts."""
    out = grouped(located(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL["op5_exact_dedup"] = r"""
with d as (
  select doc_id, coalesce(text, '') as t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as n
  from documents
)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by n) as group_size,
       row_number() over w = 1 as kept,
       sha256(n) as text_sha256
from d
window w as (partition by n order by length(t) desc, doc_id
             rows between unbounded preceding and unbounded following)
"""


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix with weights 1, 2, 3 takes of every document."""
    docs = _table(spark, sf_dir, "documents")
    out = mix(located(docs), by_rank(docs))
    return out.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "position"
    )


URL_RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record after writing archives and reading them back."""
    out = archived(_table(spark, sf_dir, "pages"))
    return out.select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), "refers_to",
    )


@query
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one by integer inner product."""
    return top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


SQL["op2_top_k"] = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select q.vec_id as query_id, d.vec_id as vec_id,
         cast(list_dot_product(cast(q.v as double[]), cast(d.v as double[])) as bigint) as score
  from v as q join v as d on q.vec_id % 50 = 0 and d.vec_id <> q.vec_id and len(q.v) = len(d.v)
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 5
"""


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    out = identified(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept_out = held_out(F.col("doc_id"))
    labels = _table(spark, sf_dir, "labels").filter(~kept_out)
    out = scored(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", kept_out.alias("held_out"), "score", "predicted")


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document among those that share 80 of 100 word pairs."""
    out = near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_text.with_main_text(pages, html_text.fit(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of the documents."""
    return spelling_variants(_table(spark, sf_dir, "documents"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned tokens of every document and how common their pairs are."""
    return aligned_documents(_table(spark, sf_dir, "documents"))


@query
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document among those that share 85 of 100 runs of four words."""
    out = jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


SQL["op11_jaccard_join"] = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
),
s as (
  select doc_id, case when len(w) < 4 then list_filter([array_to_string(w, ' ')], lambda x: x <> '')
                      else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
  from w
),
d as (select doc_id, len(s) as n, md5(array_to_string(list_sort(s), '|')) as class, s from s),
c as (select class, min(doc_id) as rep, any_value(n) as n, any_value(s) as s from d where n > 0 group by class),
e as (select rep, n, unnest(s) as e from c),
links as (
  select a.rep as a, b.rep as b from e as a join e as b on a.e = b.e and a.rep <> b.rep
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reach(a, b) as (select rep, rep from c union select reach.a, links.b from reach join links on reach.b = links.a),
least as (select a, min(b) as component from reach group by a)
select d.doc_id, d.n as n_shingles, coalesce(least.component, d.doc_id) as component_id
from d left join c on d.class = c.class and d.n > 0 left join least on least.a = c.rep
"""
