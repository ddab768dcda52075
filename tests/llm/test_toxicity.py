import numpy as np
import pytest

from tablegrist.llm import toxicity as T

DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, toxic int"
PLAIN = "the a house river walk green field stone light water over under morning paper".split()
RUDE = ["blorkhead", "snargface", "mugwumpet"]


def corpus(n=240):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(PLAIN, 60))
        if i % 4 == 0:
            words[rng.integers(60)] = str(rng.choice(RUDE))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(i % 4 == 0)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus()
    odd = [(900, 1, None), (None, 1, 1), (901, 1, 1), (902, 1, 0), (0, 1, 1)]
    return T.fit(
        spark.createDataFrame(docs + [(901, None, None), (None, "x", None), (902, "", None)], DOCS),
        spark.createDataFrame(labels + odd, LABELS),
    )


def test_learnt_and_misspelt_words(model):
    plain = " ".join(PLAIN * 3)
    assert model.score(plain) < T.THRESHOLD
    for word in (*RUDE, "blorkhed", "snargfaces", "MUGWUMPET!"):
        assert model.score(f"{plain} {word} {plain}") >= T.THRESHOLD, word


def test_odd_rows(spark, model):
    rows = [(1, None, "old"), (2, "", None), (None, "blorkhead", None), (None, "blorkhead", None), (3, "green field " * 40_000, None)]
    out = T.scored(spark.createDataFrame(rows, DOCS), model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert by[1].score == by[2].score and by[1].predicted == 0
    assert by[None].predicted == 1 and by[3].predicted == 0
    assert T.scored(spark.createDataFrame([], DOCS), model).collect() == []


def test_nothing_or_one_class_to_learn_from(spark):
    docs, labels = corpus(40)
    df = spark.createDataFrame(docs, DOCS)
    for some in ([], [x for x in labels if not x[2]]):
        m = T.fit(df, spark.createDataFrame(some, LABELS))
        assert m.score("blorkhead") < T.THRESHOLD


def test_reruns_agree(spark):
    docs, labels = corpus(80)
    models = [
        T.fit(spark.createDataFrame(docs, DOCS).repartition(n), spark.createDataFrame(labels, LABELS)) for n in (1, 5)
    ]
    assert np.array_equal(models[0].weight, models[1].weight) and models[0].bias == models[1].bias


def test_subwords_stay_within_words():
    slots = lambda t: {int(x) for part in T.subwords(t) for x in part}
    assert slots("ab cd") == slots("cd, AB") == slots("ab") | slots("cd")
    assert slots("") == set() and slots("a") == slots(" a ")
