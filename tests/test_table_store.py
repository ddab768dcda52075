import shutil

import pytest

from tablegrist.sources.folder import ORDINAL, SOURCE, text_lines
from tablegrist.sources.table_store import TableStore
from tablegrist.streaming.tables import ingest_tables

BATCHES = [
    {"a1.csv": 'k,n,d,late\n1,10,2024-01-01,7\n2,20,2024-01-02,8\n', "b1.csv": "name,x\np,1\n"},
    {"a2.csv": 'Title,,,\nk,n,d,late\n3,2.5,2024-02-01,"nine\nor ten"\n4,none,2024-02-02,x\n', "empty.csv": ""},
    {"b2.csv": "name,x\nq,\nr,$1\n", "a3.csv": "k,n,d,late\n5,30,2024-03-01,z\n"},
]


def rows(store, columns):
    (signature,) = [s for s, c in store.signatures().items() if c == columns]
    df = store.read(signature)
    return dict(df.drop(SOURCE, ORDINAL).dtypes), sorted((tuple(r)[1:] for r in df.drop(ORDINAL).collect()), key=str)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stream")
    (top / "in").mkdir()
    store = TableStore(spark, str(top / "store"))
    for files in BATCHES:
        for name, text in files.items():
            (top / "in" / name).write_text(text)
        ingest_tables(spark, str(top / "in"), store, str(top / "checkpoint")).awaitTermination()
    return store, top


def test_types_get_wider(store):
    store, _ = store
    types, got = rows(store, ["k", "n", "d", "late"])
    assert types == {"k": "bigint", "n": "double", "d": "string", "late": "string"}
    assert got == [
        (1, 10.0, "2024-01-01", "7"), (2, 20.0, "2024-01-02", "8"), (3, 2.5, "2024-02-01", "nine\nor ten"),
        (4, None, "2024-02-02", "x"), (5, 30.0, "2024-03-01", "z"),
    ]
    types, got = rows(store, ["name", "x"])
    assert types == {"name": "string", "x": "bigint"} and got == [("p", 1), ("q", None), ("r", 1)]
    history = [(r["batch"], r["kind"]) for r in store._stored("types").filter("column = 'late'").orderBy("batch").collect()]
    assert history == [(0, "integer"), (1, "text"), (2, "text")]


def test_a_batch_again_changes_nothing(spark, store):
    store, top = store
    before = {c: rows(store, list(c)) for c in (("k", "n", "d", "late"), ("name", "x"))}
    types = sorted(map(tuple, store.types().collect()))
    for number in (1, 0, 2):
        names = [str(top / "in" / n) for n in BATCHES[number]]
        store.add(text_lines(spark.read.text(names)), number)
    assert {c: rows(store, list(c)) for c in before} == before
    assert sorted(map(tuple, store.types().collect())) == types
    # The stream itself run anew from the start, into the same store.
    shutil.copytree(top / "in", top / "again")
    ingest_tables(spark, str(top / "again"), TableStore(spark, str(top / "other")), str(top / "fresh"), files_per_batch=10).awaitTermination()
    other = TableStore(spark, str(top / "other"))
    assert rows(other, ["k", "n", "d", "late"]) == before["k", "n", "d", "late"]
