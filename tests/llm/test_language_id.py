import base64
import random

import numpy as np
import pytest

from tablegrist.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, score string"
WORDS = {"en": "the quick house and of with that", "de": "der schnelle und nicht haus ist eine",
         "es": "el rápido casa y que los una"}
MORE = {"en": "this there which would people before other their think through", "de": "auch schon wird durch zwischen menschen gegen werden nicht ihrer",
        "es": "pero cuando también había nosotros entre después muchos ellos donde"}


def rows():
    rng = np.random.default_rng(1)
    out, i = [], 0
    for lang, words in WORDS.items():
        for _ in range(30):
            out.append((i, " ".join(rng.choice(words.split(), 12)), lang, "x"))
            i += 1
    return out


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(900, None, "en", None), (901, "", None, None), (902, "123 $$$", "de", None), (None, "the house of that", None, None),
           (903, "привет как дела мой друг", "en", None), (904, "the house " * 60000, None, None), (904, "the house " * 60000, None, None)]
    return spark.createDataFrame(rows() + odd, SCHEMA)


def test_predictions_and_odd_rows(docs):
    out = L.identified(docs).collect()
    assert len(out) == docs.count()
    by = {r.doc_id: r for r in out}
    wrong = [r for r in out if r.doc_id is not None and r.doc_id < 900 and r.lang_pred != r.lang]
    assert not wrong
    for i in (900, 901, 902):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[None].lang_pred == "en" and not by[None].rejected
    assert by[904].lang_pred == "en"
    assert by[903].rejected  # far from every centroid
    assert all(0 <= r.score <= 1 for r in out)


def test_rejected_rows_go_and_columns_stay(docs):
    out = L.accepted(docs)
    assert out.columns == docs.columns
    left = {r.doc_id for r in out.collect()}
    assert left == {r[0] for r in rows()} | {None, 904}


def test_held_out_rows_teach_nothing(spark, docs):
    first = L.identified(docs)
    import pyspark.sql.functions as F

    lied = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    key = ["doc_id", "lang_pred", "score"]
    a = sorted(first.select(key).collect(), key=str)
    assert a == sorted(L.identified(lied).select(key).collect(), key=str)


def test_empty_and_unlabelled(spark):
    assert L.identified(spark.createDataFrame([], SCHEMA)).collect() == []
    out = L.identified(spark.createDataFrame([(1, "some text", None, None)], SCHEMA)).collect()
    assert [r.lang_pred for r in out] == ["und"]


def test_windows_count_like_the_whole(monkeypatch):
    text = "ein langes haus und der weg " * 40
    whole = L.counts([text])[0]
    from tablegrist.llm import grams

    monkeypatch.setattr(grams, "WINDOW", 100)
    parts = L.counts([text])[0]
    # Only grams at the seams may differ.
    assert np.abs(whole - parts).sum() < 0.2 * whole.sum()


def test_a_very_long_text_teaches_like_the_others(spark):
    # Its blanks and vowels are counted over 65,520 times; all rows are in the sample.
    long = (1000, "the quick house and of with that " * 40_000, "en", "x")
    model = L.fit(spark.createDataFrame(rows() + [long], SCHEMA), "doc_id", "text", "lang")
    assert np.isfinite(model.centroids).all()
    out = model.predict([r[1] for r in rows()])
    assert out["lang"].tolist() == [r[2] for r in rows()]
    assert np.isfinite(out["score"]).all() and not out["rejected"].any()
    assert model.predict(["привет как дела мой друг"])["rejected"].all()


def test_gibberish_and_unseen_latin_languages_go_and_clean_texts_stay():
    rng = random.Random(4)

    def clean(lang):
        return " ".join(rng.choices(WORDS[lang].split() + MORE[lang].split(), k=rng.choice([8, 20, 60])))

    # One text of each hundred is none of its language.
    sample = [(lang, clean(lang)) for lang in sorted(WORDS) for _ in range(99)]
    sample += [(lang, base64.b64encode(rng.randbytes(90)).decode()) for lang in sorted(WORDS)]
    table, _ = L.counts([t for _, t in sample])
    order = sorted(range(len(sample)), key=lambda i: (sample[i][0], table[i].tobytes()))
    model = L.trained(np.array([sample[i][0] for i in order], dtype=object), table[order])
    held_out = [(lang, clean(lang)) for lang in WORDS for _ in range(50)]
    out = model.predict([t for _, t in held_out])
    assert out["lang"].tolist() == [lang for lang, _ in held_out] and not out["rejected"].any()
    odd = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz   ", k=n)) for n in (60, 200, 1000)]
    odd += [base64.b64encode(rng.randbytes(n)).decode() for n in (60, 200, 1000)]
    odd += ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
            "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
            "Bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar"]
    assert model.predict(odd)["rejected"].all()


def test_a_language_with_one_text_has_the_least_bound():
    table, _ = L.counts(["the quick house", "the quick house", "el rápido casa que", "el casa y que los", "los una casa que"])
    model = L.trained(np.array(["en", "en", "es", "es", "es"], dtype=object), table)
    assert (model.reject_below == model.reject_below[-1]).all() and model.reject_below[0] > 0


def test_one_language_at_a_time_is_whole_vectors_on_the_driver(spark):
    """Eight languages of 100 rows each; all of them would be 26 MB of counts."""
    import tracemalloc

    texts = [(i, f"wort{i} " * (i % 7 + 1) + "mehr", f"l{i % 8}") for i in range(800)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    L.fit(df, "doc_id", "text", "lang")  # what is loaded once
    tracemalloc.start()
    model = L.fit(df, "doc_id", "text", "lang")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(model.names)) == 8
    assert peak < 20e6
