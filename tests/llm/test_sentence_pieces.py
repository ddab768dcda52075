import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tablegrist.llm import sentence_pieces as P

PARTS = ["a", "b", "th", "e", " ", "  ", "\n", "\t", "▁", "é", "ß", "梦", "😀", "́", "<s>", "<0x41>", "的", "ing", "1",
         "...", "\x00", "\r\n", "{", " " * 18, "Ⅷ", "​", "the", " of"]


@pytest.fixture(scope="module")
def model():
    return P.PieceModel(P.model_file())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.MODEL))


def unpacked(b):
    return np.frombuffer(b, "<u4").tolist()


def texts(n):
    rng = random.Random(n)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(n)]


def test_ids_and_texts_as_the_library_gives_them(model, library):
    for t in [*texts(4000), "", " ", "▁", "x" * 5000, " " * 5000, "ab" * 3000]:
        ids = library.encode(t, add_bos=True, add_eos=True)
        packed = model.encode(t)
        assert unpacked(packed) == ids, t
        assert model.decode(packed) == library.decode(ids), t


def test_any_ids_decode_as_in_the_library(model, library):
    rng = random.Random(1)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(rng.randint(0, 10))]
        assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_full_caches_change_nothing(monkeypatch, library):
    monkeypatch.setattr(P, "CACHED_WORDS", 5)
    monkeypatch.setattr(P, "CACHED_PAIRS", 7)
    small = P.PieceModel(P.model_file())
    for t in texts(300):
        assert unpacked(small.encode(t)) == library.encode(t, add_bos=True, add_eos=True)


def test_tables(spark, library):
    rows = [(1, "Hello there 梦", 5), (None, None, 6), (3, "", 7), (1, "Hello there 梦", 5), (4, "many words " * 30_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = P.with_tokens(df).withColumn("list", P.ids_array(F.col("ids"))).collect()
    want = sorted((str(i), library.encode(t or "", add_bos=True, add_eos=True), t or "") for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.list, r.decoded) for r in out) == want
    assert P.with_tokens(df.limit(0)).collect() == []
