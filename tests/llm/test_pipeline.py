"""The pipeline's stages and the registered queries against SQL or brute force."""

import os

import harness
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tablegrist.llm.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score int"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert harness.differences(df, harness.duck(SF), SQL[name]) == []
    else:
        table = "pages" if "page_id" in df.columns else "documents"
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.fixture(scope="module")
def steps(spark):
    """Each stage's rows over the sample with odd rows added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'x' as kept", "1 as score")
    odd = [(None, None, None, None, None, None, None), (9001, "", "en", None, 0, None, None), (9002, "12 34", "en", "src1", 5, None, None),
           (9003, "привет мир, это длинный русский текст без других букв", "en", "src1", 5, None, None)]
    docs = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame(odd, SCHEMA))
    found = [("documents", docs.cache())]
    for name, stage in corpus_pipeline.STAGES:
        found.append((name, stage(spark, found[-1][1], SF).cache()))
    return dict(found)


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_order_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "sentence_pieces"]
    for name in ("language_id", "exact_dedup", "near_dedup", "mixing"):
        assert steps[name].columns == steps["documents"].columns


def test_only_what_has_no_known_language_goes(steps, spark):
    clean = ids(spark.read.parquet(f"{SF}/documents.parquet"))
    assert set(ids(steps["language_id"])) == set(clean)


def test_copies_go(steps):
    import re

    def normal(r):
        return re.sub(r"[\x20\x09-\x0D]", "", r.text)

    before, after = steps["language_id"].collect(), steps["exact_dedup"].collect()
    assert sorted(map(normal, after)) == sorted(set(map(normal, before)))


def test_near_copies_go(steps):
    from test_super_minhash import brute

    before = [(r.doc_id, r.text) for r in steps["exact_dedup"].collect()]
    assert ids(steps["near_dedup"]) == sorted(i for i, _, _, kept in brute(before, 5) if kept)


def test_mix_feeds_documents_up_to_three_times(steps):
    before, after = ids(steps["near_dedup"]), ids(steps["mixing"])
    assert set(after) <= set(before)
    assert max(after.count(i) for i in set(after)) <= 3


def test_ids_are_the_librarys(steps):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in steps["mixing"].collect()}
    for r in steps["sentence_pieces"].collect():
        got = np.frombuffer(r.ids, "<u4").tolist()
        assert got == library.encode(texts[r.doc_id], add_bos=True, add_eos=True) and r.n_tokens == len(got)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "position", "n_tokens", "ids"]


def test_rows_stay_in_training_order(spark, tmp_path):
    """Ten files of range-sorted rows, the smallest ones first."""
    from pyspark.sql import functions as F

    from tablegrist.llm.rows import in_written_order

    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('some words ', 1 + cast(id % 7 as int)) as text", "id as n_chars")
    path = str(tmp_path / "sorted")
    cut = F.when(F.col("doc_id") < 30, F.col("doc_id")).otherwise(30 + F.col("doc_id") / 200)
    docs.withColumn("__cut", cut).repartitionByRange(10, "__cut").sortWithinPartitions("doc_id").drop("__cut").write.parquet(path)
    read = spark.read.parquet(path)
    assert len(read.inputFiles()) == 10
    placed = in_written_order(read).select("doc_id", "position").collect()
    assert [r["doc_id"] for r in sorted(placed, key=lambda r: r["position"])] == list(range(3000))
    assert sorted(r["position"] for r in placed) == list(range(3000))
    out = corpus_pipeline.encoded(spark, read, SF)
    assert all(r["doc_id"] == r["position"] for r in out.select("doc_id", "position").collect())


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == [] and docs.columns[0] == "doc_id", name
