"""Time windows, vectors, postings, retrieval, chunk families, store, files."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablegrist.operators import catalog as K
from tablegrist.operators import chunks as C
from tablegrist.operators import entities as E
from tablegrist.operators import postings as P
from tablegrist.operators import retrieval as R
from tablegrist.operators import timeseries as TS
from tablegrist.operators import vectors as V
from tablegrist.plans.ingest import document_family, table_family
from tablegrist.sources.grid_files import pack_grids, write_grids
from tablegrist.sources.store import ChunkStore, load_aliases, save_aliases
from tablegrist.sources.folder import choose_header, header_names
from tablegrist.sources.tables import read_tables, sheet_name
from tablegrist.streaming.ingest import ingest_stream


def day(s):
    return dt.datetime.fromisoformat(s)


# --- time windows ---


@pytest.fixture(scope="module")
def series(spark):
    rows = [("Fund Q", day("2023-01-31"), 100.0, 0), ("Fund Q", day("2023-06-30"), 110.0, 1),
            ("fund q", day("2023-11-15"), 115.0, 2), ("Fund Q", day("2023-12-31"), 120.0, 3),
            ("Fund B", day("2023-12-31"), -5.0, 4), ("Fund B", day("2023-12-01"), 5.0, 5), (None, day("2023-12-30"), 1.0, 6)]
    return spark.createDataFrame(rows, "name string, d timestamp, nav double, o bigint")


def test_detection(spark, series):
    assert TS.detect_timeseries(series, "name") == "d"
    assert TS.detect_timeseries(series.filter("o in (0, 4)"), "name") is None
    assert TS.detect_timeseries(series.drop("d"), "name") is None


def test_trailing_windows(series):
    got = {(r["canonical_id"], r["window"]): r for r in TS.trailing_windows(series, "name", "d", ["nav"], "o").collect()}
    assert set(got) == {("q", "90d"), ("q", "365d"), ("b", "30d"), ("b", "90d"), ("b", "365d")}
    year = got["q", "365d"]
    assert (year["mean"], year["min"], year["max"], year["count"]) == (111.25, 100.0, 120.0, 4)
    assert year["std"] == pytest.approx(np.std([100, 110, 115, 120]))
    days = (day("2023-12-31") - day("2023-01-31")).days
    assert year["cagr"] == pytest.approx((120 / 100) ** (365.25 / days) - 1, abs=1e-9)
    assert got["q", "90d"]["cagr"] is None
    assert got["b", "365d"]["cagr"] is None  # ends below zero


def test_windows_of_many_columns(spark):
    """Ordinals that no double tells apart order equal moments; the plan stays one hash
    aggregate whatever the number of columns."""
    rows = [("Fund Z", day("2023-12-31"), 2**62 + i, 10.0 + i) for i in (1, 0, 2)] + [("Fund Z", day("2023-01-31"), 5, 4.0)]
    df = spark.createDataFrame(rows, "name string, d timestamp, o bigint, v0 double")
    names = [f"v{i}" for i in range(200)]
    wide = df.select("name", "d", "o", *[(F.col("v0") + i).alias(n) for i, n in enumerate(names)])
    got = TS.trailing_windows(wide, "name", "d", names, "o")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    year = {r["column"]: r for r in got.filter("window = '365d'").collect()}
    assert len(year) == 200
    days = (day("2023-12-31") - day("2023-01-31")).days
    assert year["v7"]["cagr"] == pytest.approx((19 / 11) ** (365.25 / days) - 1, abs=1e-9)
    text = df.withColumn("o", F.col("o").cast("string"))
    assert TS.trailing_windows(text, "name", "d", ["v0"], "o").filter("window = '365d'").first()["max"] == 12.0
    assert TS.trailing_windows(df, "name", "d", [], "o").count() == 0


def test_far_pages_and_like_file_ids(spark):
    pages = spark.createDataFrame([("f", 2**31 + i, f"one {i}") for i in range(3)] + [("f", None, "two")], "file string, page bigint, text string")
    got = document_family(pages, C.Source("docs"), "file", "page", "text").chunks.collect()
    assert {r["page"] for r in got} == {None, 2**31, 2**31 + 1, 2**31 + 2} and len({r["chunk_id"] for r in got}) == 4
    one = spark.range(1).select(C.chunk_id("f", "row", F.lit(1)).alias("a"), C.chunk_id(F.lit("f"), "row", F.lit(1)).alias("b")).first()
    assert one["a"] == one["b"]


def test_window_text(series):
    got = TS.window_stats(TS.trailing_windows(series, "name", "d", ["nav"], "o"), "f.csv").filter("canonical_id = 'b' and window = '30d'").first()
    assert got["text"] == "Time window 30d for b in f.csv: nav mean=0.0000 std=5.0000 min=-5.0000 max=5.0000."
    assert got["stats"]["nav"]["count"] == 2


def test_latest_rows(spark, series):
    got = {r["canonical_id"]: r["o"] for r in E.latest_rows(series, "name", "o").collect()}
    assert got == {"q": 3, "b": 4}
    undated = {r["canonical_id"]: r["o"] for r in E.latest_rows(series.drop("d"), "name", "o").collect()}
    assert undated == {"q": 3, "b": 5}
    with_gap = series.withColumn("d", F.when(F.col("o") != 3, F.col("d")))
    assert {r["canonical_id"]: r["o"] for r in E.latest_rows(with_gap, "name", "o").collect()}["q"] == 2


# --- vectors ---


@pytest.mark.parametrize("metric", [V.COSINE, V.EUCLIDEAN])
def test_many_queries(spark, metric):
    """20,000 queries in blocks against a corpus with structure, ties and groups."""
    rng = np.random.default_rng(3)
    means = rng.normal(size=(40, 8))
    # Sixty-fourths, whose sums are exact and often tie.
    corpus = ((means[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 0.05) * 64).round() / 64
    corpus[3000:3050] = corpus[:50]
    queries = ((means[rng.integers(0, 40, 20_000)] + rng.normal(size=(20_000, 8)) * 0.05) * 64).round() / 64
    c_group, q_group = np.where(rng.random(4000) < 0.8, "a", "b"), np.where(rng.random(20_000) < 0.6, "a", "b")
    c = spark.createDataFrame(pd.DataFrame({"chunk_id": np.arange(4000), "vec": corpus.tolist(), "g": c_group})).repartition(5)
    q = spark.createDataFrame(pd.DataFrame({"query_id": np.arange(20_000), "vec": queries.tolist(), "g": q_group}))
    got = V.top_k(q, c, 4, metric, group="g", max_shipped=3000).toPandas().sort_values(["query_id", "rank"])
    assert len(got) == 80_000
    got = got["chunk_id"].to_numpy().reshape(-1, 4)
    for g in "ab":
        own, asked = np.flatnonzero(c_group == g), np.flatnonzero(q_group == g)
        for at in range(0, len(asked), 500):
            rows = asked[at : at + 500]
            near = queries[rows] @ corpus[own].T if metric == V.COSINE else -((queries[rows][:, None] - corpus[own]) ** 2).sum(axis=2)
            want = own[np.lexsort((np.broadcast_to(own, near.shape), -near), axis=1)[:, :4]]
            assert (got[rows] == want).all()


def test_clusters_are_passed_over():
    """Far clusters are not compared, and what is found is the same."""
    from tablegrist.operators import vector_blocks as B

    rng = np.random.default_rng(1)
    means = rng.normal(size=(30, 6)) * 10
    x = means[rng.integers(0, 30, 20_000)] + rng.normal(size=(20_000, 6)) * 0.1
    clusters, met = B.Clusters(x, np.arange(len(x))), []
    meet = clusters._meet
    clusters._meet = lambda j, active, *rest: (met.append(len(active)), meet(j, active, *rest))
    q = means[rng.integers(0, 30, 500)]
    best, ranks = clusters.search(q, 3, False)
    d = ((q[:, None] - x) ** 2).sum(axis=2)
    assert (ranks == np.argsort(d, axis=1)[:, :3]).all() and np.allclose(-best, np.sort(d, axis=1)[:, :3])
    assert sum(met) < 0.3 * len(q) * len(clusters.ends)


def vectors(spark, n, dim, seed, name, groups=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)).round(1)  # coarse, so that scores tie
    m[n // 2] = m[0]
    rows = [(f"{name}{i:04d}", [float(x) for x in m[i]], str(i % groups)) for i in range(n)]
    return spark.createDataFrame(rows, f"{'query_id' if name == 'q' else 'chunk_id'} string, vec array<float>, file_id string"), rows


@pytest.mark.parametrize("metric", [V.COSINE, V.EUCLIDEAN])
@pytest.mark.parametrize("shipped", [1000, 3])
def test_top_k_against_brute_force(spark, metric, shipped):
    q, qs = vectors(spark, 11, 3, 1, "q", groups=2)
    c, cs = vectors(spark, 300, 3, 2, "c", groups=2)
    got = {}
    for r in V.top_k(q, c.repartition(7), 5, metric, group="file_id", max_shipped=shipped).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["chunk_id"], r["score"])
    for name, vec, g in qs:
        every = []
        for cid, cv, cg in cs:
            if cg != g:
                continue
            a, b = np.float64(np.float32(vec)), np.float64(np.float32(cv))
            s = float(a @ b) if metric == V.COSINE else float(np.sqrt(((a - b) ** 2).sum()))
            every.append((-round(s, 9) if metric == V.COSINE else round(s, 9), cid))
        want = [cid for _, cid in sorted(every)[:5]]
        assert [got[name][i][0] for i in range(1, 6)] == want


def test_top_k_edges(spark):
    q, _ = vectors(spark, 2, 3, 1, "q")
    c, _ = vectors(spark, 4, 3, 2, "c")
    assert V.top_k(q, c, 0).count() == 0
    assert V.top_k(q, c.limit(0), 3).count() == 0
    assert V.top_k(q.limit(0), c, 3).count() == 0
    assert V.top_k(q, c, 99).count() == 8


def test_scaler(spark):
    df = spark.createDataFrame([(float(i), 7.0, None, str(i)) for i in range(1, 6)] + [(None, 7.0, None, "x")], "x double, k double, e double, t string")
    s = V.fit_scaler(df, "f", ["x", "k", "e"])
    assert (s.mean, s.std) == ({"x": 3.0, "k": 7.0, "e": 0.0}, {"x": pytest.approx(np.sqrt(2)), "k": 1.0, "e": 1.0})
    got = [r[0] for r in df.select(V.scaled_vector(df, s)).collect()]
    assert got[0] == pytest.approx([-np.sqrt(2), 0, 0]) and got[5] == [0, 0, 0]
    assert V.Scaler.load(s.table(df), "f") == V.Scaler("f", s.columns, s.mean, s.std)


def test_append_checks_length(spark):
    known, _ = vectors(spark, 3, 4, 1, "c")
    more, _ = vectors(spark, 3, 5, 1, "c")
    with pytest.raises(Exception, match="expected 4 components"):
        V.append_vectors(known, more, 4).collect()
    assert V.keep_vectors(known, known.limit(1)).count() == 2


# --- postings and retrieval ---


@pytest.fixture(scope="module")
def funds(spark):
    rows = [(0, "HDFC Top 100 Fund", "Nifty 100", 101.5, 5000.0), (1, "Axis Bluechip Fund", "Nifty 50", 55.0, 900.0),
            (2, "SBI Small Cap", "BSE 250", 140.0, None), (3, None, "Nifty 50", 10.0, 1.0), (4, "Quant Mid-Cap Plan", "Nifty 50", 20.0, 2.0)]
    return spark.createDataFrame(rows, "_o bigint, `Scheme Name` string, Benchmark string, `NAV Regular` double, `Daily AUM (Cr.)` double")


@pytest.fixture(scope="module")
def family(spark, funds):
    return table_family(funds, C.Source("funds.csv", time=day("2024-01-01")), "_o", hidden=["_o"])


def test_family(family):
    counts = {r["chunk_type"]: r["chunks"] for r in K.count_by_type(family.chunks).collect()}
    assert counts == {"synopsis": 1, "tabular_summary": 1, "enumeration": 2, "row": 5, "entity": 4, "numeric_vector": 5}
    assert family.name_col == "Scheme Name" and family.date_col is None
    rows = {r["row_number"]: r for r in family.chunks.filter("chunk_type = 'row'").collect()}
    assert rows[2]["text"] == "Row from funds.csv: Scheme Name=SBI Small Cap; Benchmark=BSE 250; NAV Regular=140.0."
    assert rows[2]["canonical_id"] == "sbi small cap" and rows[3]["canonical_id"] is None
    entity = family.chunks.filter("chunk_type = 'entity' and canonical_id = 'quant mid cap'").first()
    assert entity["aliases"] == ["Quant Mid-Cap Plan"] and "NAV Regular=20.0" in entity["text"]
    for r in family.chunks.collect():
        assert all(r[c] is not None for c in ("chunk_id", "file", "file_id", "chunk_type", "ingestion_time", "version"))
    assert family.chunks.select("chunk_id").distinct().count() == family.chunks.count()
    assert family.numeric_vectors.count() == 5 and family.text_vectors.count() == 0


def test_hot_postings_stay_in_their_tasks(spark):
    """Keys that look large before they are counted, but are few."""
    n = 10_000_000
    kind, value = F.lit("cell").alias("kind"), F.concat(F.lit("v"), F.col("id") % 2).alias("value")
    asked = spark.range(n).filter("id < 4").select(F.col("id").alias("query_id"), kind, value.alias("key"), value).distinct()
    posts = spark.range(n).filter("id < 3").select(kind, value.alias("key"), value, F.col("id").alias("chunk_id"))
    found = P.matches(posts, asked)
    assert found.count() == 6
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_postings(spark, family):
    asked = spark.createDataFrame(
        [(1, "id", "", "hdfc top 100"), (2, "cell", "BENCHMARK", " nifty-50 "), (3, "enum", "Benchmark", ""), (4, "cell", "NAV regular", "140.0"), (5, "id", "", "zzz")],
        "query_id int, kind string, column string, value string",
    )
    hits = P.lookup(family.postings, P.lookup_keys(asked)).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in hits} == {1: 3, 2: 3, 3: 1, 4: 1}
    gone = family.chunks.filter("chunk_type = 'row'").select("chunk_id")
    left = P.remove_chunks(family.postings, gone)
    assert left.filter("kind = 'cell'").count() == 0 and left.filter("kind = 'id'").count() == 8


def test_retrieval_end_to_end(spark, family):
    ids = [r["chunk_id"] for r in family.chunks.filter("text is not null").orderBy("chunk_id").collect()]
    rng = np.random.default_rng(0)
    unit = rng.normal(size=(len(ids), 8))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, unit)], "chunk_id string, vec array<double>")
    asked = spark.createDataFrame(
        [(1, "What is the NAV of HDFC Top 100?", "hdfc top 100", "point_lookup", [0.0] * 8),
         (2, "Benchmark = Nifty 50", None, "filter_rows", unit[1].tolist()),
         (3, "hello", None, "qualitative", unit[2].tolist())],
        "query_id int, question string, canonical_id string, intent string, vec array<double>",
    )
    found = R.candidates(asked, family.postings, vec, 5)
    scored = R.score_candidates(found, family.chunks)
    ranked = R.second_stage(scored, asked, family.chunks, 5)
    top = ranked.filter("query_id = 1 and rank = 1").first()
    assert top["chunk_type"] == "row" and top["canonical_id"] == "hdfc top 100" and top["ce_score"] is None
    first = ranked.filter("query_id = 1").orderBy("rank").collect()
    assert [r["exact_id"] for r in first] == [True, True, True, False, False]
    assert scored.filter("query_id = 2 and exact_cell").count() == 3
    tiers = {r["query_id"]: (r["tier"], r["value"]) for r in R.confidence(asked, ranked).collect()}
    assert tiers[1] == ("deterministic", 1.0) and tiers[3][0] == "semantic"
    text = {r["query_id"]: r["context"] for r in R.contexts(asked, ranked).collect()}
    assert text[1].startswith("[1] funds.csv\nRow from funds.csv: Scheme Name=HDFC Top 100 Fund")
    empty = R.contexts(asked, ranked.filter("query_id = 1")).filter("query_id = 3").first()
    assert empty["context"] == "(no relevant context found)"
    assert R.confidence(asked, ranked.filter("query_id = 1")).filter("query_id = 3").first()["value"] == 0.0


def test_second_stage_keeps_exact_rows_first(spark):
    rows = [(1, "a", True, 0.2, "x", "alpha"), (1, "b", False, 0.9, "x", "alpha beta"), (1, "c", False, 0.1, "x", "alpha beta gamma"), (1, "d", True, 0.5, "x", "")]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, exact_id boolean, score double, chunk_type string, text string")
    scored = df.drop("text")
    chunks = df.selectExpr("chunk_id", "chunk_type", "text", "cast(null as string) canonical_id", "cast(null as array<string>) numeric_columns", "cast(null as string) window")
    asked = spark.createDataFrame([(1, "Alpha beta GAMMA")], "query_id int, question string")
    got = [r["chunk_id"] for r in R.second_stage(scored, asked, chunks, 10).orderBy("rank").collect()]
    assert got == ["d", "a", "c", "b"]
    # Rows beyond the second stage keep their place behind those it read.
    assert [r["chunk_id"] for r in R.second_stage(scored, asked, chunks, 10, rows=1).orderBy("rank").collect()] == ["d", "a", "b", "c"]


def test_source_scores_and_distance(spark):
    rows = [(True, False, 0.1, None), (False, True, 0.1, None), (False, False, 0.4567, 50.0)]
    df = spark.createDataFrame(rows, "exact_id boolean, exact_cell boolean, text_sim double, d double")
    got = [(r["source_score"], r["match"]) for r in R.with_source_score(df).collect()]
    assert got == [(1.0, "exact"), (0.95, "field"), (0.457, "semantic")]
    score = R.linear_score(F.col("exact_id"), F.col("exact_cell"), F.col("text_sim"), F.col("d"), F.lit("trend"), F.lit("time_window"))
    assert [r[0] for r in df.select(score).collect()] == pytest.approx([1.25, 0.65, 0.22835 - 0.297 + 0.2])


def test_hot_posting_key(spark):
    """A third of all rows under one key; the ranked result is still exact."""
    n = 6000
    chunks = spark.range(n).select(
        F.format_string("c%06d", "id").alias("chunk_id"), F.lit("row").alias("chunk_type"), F.lit("t").alias("text"),
        F.lit(None).cast("string").alias("canonical_id"), F.lit(None).cast("array<string>").alias("numeric_columns"), F.lit(None).cast("string").alias("window"))
    posts = spark.range(n).select(
        F.lit("cell").alias("kind"), F.lit("k").alias("key"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("value"), F.format_string("c%06d", "id").alias("chunk_id"))
    asked = spark.createDataFrame([(i, "xx, k = hot", None, "filter_rows", [1.0]) for i in range(3)], "query_id int, question string, canonical_id string, intent string, vec array<double>").withColumn("question", F.lit("kk = hot"))
    posts = posts.withColumn("key", F.lit("kk"))
    none = spark.createDataFrame([], "chunk_id string, vec array<double>")
    top = R.linear_top_k(R.score_candidates(R.candidates(asked, posts, none, 4), chunks), 4)
    for q in range(3):
        assert [r["chunk_id"] for r in top.filter(F.col("query_id") == q).orderBy("rank").collect()] == [f"c{i:06d}" for i in (0, 3, 6, 9)]


# --- store and files ---


def test_store(spark, tmp_path, family, funds):
    store = ChunkStore(spark, str(tmp_path / "s"))
    assert store.read("chunks").count() == 0
    n = family.chunks.count()
    store.add(family)
    store.add(family)  # again: nothing doubles
    assert store.read("chunks").count() == n
    assert store.read("postings").count() == family.postings.count()
    other = table_family(funds, C.Source("other.csv"), "_o", hidden=["_o"])
    store.add(other)
    assert {r["file"] for r in K.list_files(store.read("chunks")).collect()} == {"funds.csv", "other.csv"}
    assert store.delete_file("nope.csv") == 0
    assert store.delete_file("funds.csv") == n
    assert store.read("chunks").count() == n and store.read("postings").count() == other.postings.count()
    assert store.read("scalers").select("file_id").distinct().count() == 1
    assert K.total_rows(store.read("file_stats")).first()[0] == 5
    def broken():
        raise ValueError("unreadable")

    report = store.rebuild({"funds": lambda: family, "bad": broken, "other": lambda: other}).collect()
    assert [(r["file"], r["error"]) for r in report if r["error"]] == [("bad", "ValueError: unreadable")]
    assert len(report) == 13 and store.read("aliases").count() == 4
    assert store.read("chunks").count() == 2 * n
    assert K.total_rows(store.read("file_stats").limit(0)).first()[0] == 0
    # Compaction keeps what is in force and nothing else.
    store.delete_file("other.csv")
    small = store.compact(str(tmp_path / "compact"))
    for t in ("chunks", "postings", "numeric_vectors", "file_stats"):
        assert small.read(t).count() == store.read(t).count() == spark.read.parquet(f"{small.root}/{t}").count()


def test_text_vectors_have_one_length(spark, tmp_path, funds):
    ids = table_family(funds, C.Source("v.csv"), "_o", hidden=["_o"]).chunks.filter("chunk_type = 'row'").select("chunk_id")

    def embedded(n):
        vec = F.array(*[F.lit(1.0)] * n).cast("array<float>")
        return table_family(funds, C.Source("v.csv"), "_o", hidden=["_o"], text_vectors=ids.withColumn("vec", vec))

    store = ChunkStore(spark, str(tmp_path / "v"))
    store.add(embedded(3))
    assert store.read("text_vectors").count() == 5 and store.read("numeric_vectors").count() == 5
    with pytest.raises(ValueError):
        store.add(embedded(4))
    assert store.read("text_vectors").count() == 5


def test_aliases_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "A Fund"), ("a", "a"), ("b", "B")], "canonical_id string, alias string")
    save_aliases(pairs, str(tmp_path / "al"))
    assert sorted(load_aliases(spark, str(tmp_path / "al")).collect()) == sorted(pairs.collect())


def test_choose_header():
    assert choose_header(["a,b,c", "1,2,3"]) == 0
    assert choose_header(["Report,,,", "fund,nav,ret,x", "A,1,2,3"]) == 1
    assert choose_header(["Report", "fund,nav,ret", "A,1,2"]) == 1
    assert choose_header(["R,,,", ",,,", "a,b,c,d", "1,2,3,4"]) == 2
    assert choose_header(["a,b,", "1,2,3"]) == 0 or choose_header(["a,b,", "1,2,3"]) == 0
    assert choose_header(["a,,,", "b,,,"]) == 0
    assert header_names(["a", "", "a", " b "], 5) == ["a", "Unnamed: 1", "a.1", "b", "Unnamed: 4"]
    assert sheet_name("w.xlsx", "S", 2) == "w.xlsx :: S" and sheet_name("w.xlsx", "S", 1) == "w.xlsx"


def test_read_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Fund Report,,\n\nfund,nav,as of date\n\"A, x\",\"$1,000\",2024-01-01\n\nB,200,2024-02-01\n")
    (tmp_path / "b.csv").write_text("name,n\n" + "\n".join(f"r{i},{i}" for i in range(50)))
    (tmp_path / "empty.csv").write_text("x,y\n")
    got = {t.logical_name: t for t in read_tables(spark, str(tmp_path), names={"b.csv": ("book.xlsx :: S1", "S1")})}
    assert set(got) == {"a.csv", "book.xlsx :: S1"}
    a = got["a.csv"]
    assert a.df.dtypes[:3] == [("fund", "string"), ("nav", "bigint"), ("as of date", "timestamp")]
    assert [(r[0], r[1], r["_ordinal"]) for r in a.df.orderBy("_ordinal").collect()] == [("A, x", 1000, 0), ("B", 200, 1)]
    b = got["book.xlsx :: S1"]
    assert [r["n"] for r in b.df.orderBy(b.order_by).collect()] == list(range(50)) and b.sheet == "S1"


def test_grid_files(spark, tmp_path):
    rows = [("t1", 0, ["Title", ""]), ("t1", 1, ["a", "b"]), ("t1", 2, ["1,5", "2"]), ("t2", 0, ["x", "x"]), ("t2", 1, ["1", "2"])]
    write_grids(spark.createDataFrame(rows, "table_id string, row int, cells array<string>"), str(tmp_path / "g"))

    def text(t):
        files = sorted((tmp_path / "g" / f"table_id={t}").glob("part-*"))
        return "".join(f.read_text() for f in files)

    assert text("t2") == "x,x_2\n1,2\n"
    assert text("t1") == 'Title,col_2\na,b\n"1,5",2\n'


def test_many_grids_share_few_files(spark, tmp_path):
    grids = spark.range(3000).select(
        F.col("id").alias("table_id"), F.posexplode(F.array(*[F.array(F.lit("a"), F.concat(F.lit(f"{i},"), "id")) for i in range(2)])).alias("row", "cells")
    )
    path = str(tmp_path / "g")
    pack_grids(grids, path)
    assert len(list((tmp_path / "g").rglob("*.parquet"))) <= 64
    got = spark.read.parquet(path)
    assert got.count() == 6000 and got.select("table_id").distinct().count() == 3000
    assert [r["value"] for r in got.filter("table_id = 7").orderBy("row").collect()] == ['a,"0,7"', 'a,"1,7"']


def test_stream(spark, tmp_path):
    schema = spark.createDataFrame([], "file string, text string").schema
    src = str(tmp_path / "in")

    def drop(name, text):
        spark.createDataFrame([(name, text)], schema).coalesce(1).write.mode("append").parquet(src)

    store = ChunkStore(spark, str(tmp_path / "store"))

    def family(batch):
        pages = batch.withColumn("page", F.lit(None).cast("int"))
        return document_family(pages, C.Source("docs"), "file", "page", "text", paged=False, size=5, overlap=2)

    def run():
        ingest_stream(spark, src, schema, store, family, str(tmp_path / "cp")).awaitTermination()

    drop("one", " ".join(f"w{i}" for i in range(20)))
    drop("two", "short text")
    run()
    assert store.read("chunks").groupBy("file").count().orderBy("file").collect() == [("one", 7), ("two", 1)]
    drop("three", "more")
    run()
    run()
    assert store.read("chunks").count() == 9


def test_paged_documents(spark):
    pages = spark.createDataFrame([("d.pdf", i, f"Header line\nbody {i}\nPage {i} of 3") for i in (1, 2, 3)], "file string, page int, text string")
    got = document_family(pages, C.Source("docs"), "file", "page", "text").chunks.orderBy("page").collect()
    assert [r["text"] for r in got] == [f"[d.pdf] page {i}\nbody {i}" for i in (1, 2, 3)]
    assert [r["page"] for r in got] == [1, 2, 3] and len({r["chunk_id"] for r in got}) == 3


def test_a_stored_family_is_made_once(spark, tmp_path):
    """Postings and vectors are made of the stored chunks, not of the texts again."""
    made = tmp_path / "made"

    @F.udf("string")
    def noted(text):
        with open(made, "a") as f:
            f.write(".")
        return text

    docs = spark.range(0, 40, 1, 4).select(F.concat(F.lit("d"), "id").alias("file"), F.lit(None).cast("bigint").alias("page"), F.lit("some words").alias("text"))
    docs = docs.withColumn("text", noted.asNondeterministic()("text"))
    store = ChunkStore(spark, str(tmp_path / "store"))
    embed = lambda chunks: chunks.select("chunk_id", F.array(F.lit(1.0)).cast("array<float>").alias("vec"))
    store.add(document_family(docs, C.Source("d"), "file", "page", "text", paged=False, vectors=embed))
    assert made.stat().st_size == 40
    assert store.read("text_vectors").join(store.read("chunks"), "chunk_id").count() == 40
