"""Language identification by nearest centroid.

A text is a vector of its letter n-grams (hashed, one to three characters, words
bounded by blanks), weighted by 1 + log of the count and inverse document
frequency, of length one. Every language has several centroids, found by
spherical k-means over a bounded sample of its texts. The language of the nearest
centroid by cosine is predicted. Every language has a bound, a margin below what
nearly all texts of its sample reach with centroids they had no part in; a text
whose cosine is below the bound of its language is rejected.

The sample is the only thing that is bounded: about ``SAMPLE`` rows of each
language, chosen by a hash of the key over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegrist.llm.grams import code_points, is_letter, mixed, windows
from tablegrist.llm.tidy import give_back, tidy
from tablegrist.session import cut_lineage, small_table

BUCKETS = 8192
ORDERS = (1, 2, 3)
SAMPLE = 400
#: Rows of all languages together.
MOST_SAMPLED = 10_000
CENTROIDS = 4
ROUNDS = 10
#: Rejected is what has less than MARGIN of the cosine that all but a share of LOW
#: of a language's sample have to it, each text left out with its fold.
LOW, MARGIN, FOLDS = 0.02, 0.6, 4
#: The bound if no language has two different texts.
ALONE = 0.25
UNKNOWN = "und"


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams of each text, and its number of letters."""
    table = np.zeros((len(texts), BUCKETS), np.float32)
    letters = np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        for piece in windows(text.lower(), max(ORDERS) - 1):
            c = code_points(f" {piece} ")
            known = is_letter()[c]
            letters[row] += int(known.sum())
            c = np.where(known, c, 32)
            # One blank between words, whatever stands between them.
            c = c[(c != 32) | np.append(True, c[:-1] != 32)].astype(np.uint64)
            gram = np.zeros(len(c), np.uint64)
            for n in ORDERS:
                part = c[n - 1 :]
                gram = gram[: len(part)] * np.uint64(0x110000) + part
                if n == 1:
                    buckets = gram[gram != 32]
                else:
                    buckets = gram
                slots = (mixed(buckets + np.uint64(n << 61)) % np.uint64(BUCKETS)).astype(np.int64)
                table[row] += np.bincount(slots, minlength=BUCKETS).astype(np.float32)
    return table, letters


@dataclass
class LanguageModel:
    names: list[str]
    """The language of each centroid."""
    centroids: np.ndarray
    idf: np.ndarray
    reject_below: np.ndarray
    """The bound of each centroid's language."""

    def vectors(self, table: np.ndarray) -> np.ndarray:
        return unit(np.log1p(table) * self.idf)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """``lang`` (``und`` without a letter), cosine and whether it is rejected."""
        table, letters = counts([t or "" for t in texts])
        if not self.names:
            cosine, best = np.zeros(len(texts)), np.full(len(texts), -1)
            far = np.ones(len(texts), bool)
        else:
            similar = self.vectors(table) @ self.centroids.T
            best = similar.argmax(axis=1)
            cosine = np.clip(similar.max(axis=1).astype(np.float64), 0, 1)
            far = cosine < self.reject_below[best]
        none = (letters == 0) | (best < 0)
        lang = [UNKNOWN if n else self.names[b] for n, b in zip(none, best)]
        cosine[none] = 0.0
        return pd.DataFrame({"lang": lang, "score": cosine, "rejected": none | far})


def unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(length, 1e-12)


def clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of at most ``k`` clusters of unit vectors by spherical k-means,
    begun with vectors far from each other."""
    chosen = [0]
    nearest = x @ x[0]
    while len(chosen) < min(k, len(x)):
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-6:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, x @ x[far])
    centers = x[chosen]
    for _ in range(ROUNDS):
        own = (x @ centers.T).argmax(axis=1)
        centers = unit(np.stack([
            x[own == j].sum(axis=0) if (own == j).any() else centers[j] for j in range(len(centers))
        ]))
    return centers


def fit(labelled: DataFrame, key: str, text: str, lang: str, sample: int = SAMPLE) -> LanguageModel:
    """A model from the rows of ``labelled`` with a language and a letter.

    The sample is chosen by a hash of key and text, evenly from all rows of a
    language, so its expected size is ``sample``; rows that repeat both count once,
    and the languages share ``MOST_SAMPLED`` rows if they are many. Of its n-gram
    counts only those above 0 come to the driver: 6 bytes for each n-gram of a text,
    48 KB at most.
    """
    rows = labelled.filter(F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"),
        F.xxhash64(F.col(key), F.col(text)).alias("rank"),
    ).filter("text is not null")
    sizes = rows.groupBy("lang").count().collect()
    # Every language has its share of the 2^64 hash values.
    if not sizes:
        return LanguageModel([], np.zeros((0, BUCKETS)), np.zeros(BUCKETS), np.zeros(0))
    sample = min(sample, max(1, MOST_SAMPLED // len(sizes)))
    share = small_table(
        labelled.sparkSession, [(r["lang"], min(1.0, sample / r["count"])) for r in sizes], "lang string, share double"
    )
    place = (F.col("rank") / F.lit(2.0**64)) + 0.5
    chosen = rows.join(share, "lang").filter(place <= F.col("share")).dropDuplicates(["lang", "rank"]).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                table, letters = counts(part.column("text").to_pylist())
                keep = letters > 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang").filter(pa.array(keep)),
                     pa.array([np.flatnonzero(x).astype(np.uint16).tobytes() for x in table[keep]], pa.binary()),
                     pa.array([x[x > 0].tobytes() for x in table[keep]], pa.binary())],
                    ["lang", "slots", "counts"],
                )

    found = cut_lineage(chosen.mapInArrow(tidy(vectors), "lang string, slots binary, counts binary")).toArrow()
    slots, counted = (found.column(c).combine_chunks() for c in ("slots", "counts"))
    langs = np.array(found.column("lang").to_pylist(), dtype=object)
    del found
    seen = np.zeros(BUCKETS, np.int64)
    for cell in slots:
        seen[np.frombuffer(cell.as_buffer(), np.uint16)] += 1

    def table(name: str) -> np.ndarray:
        rows = np.flatnonzero(langs == name).tolist()
        own = np.zeros((len(rows), BUCKETS), np.float32)
        for row, i in zip(own, rows):
            row[np.frombuffer(slots[i].as_buffer(), np.uint16)] = np.frombuffer(counted[i].as_buffer(), np.float32)
        # The order in which tasks end must not matter.
        return own[sorted(range(len(own)), key=lambda i: own[i].tobytes())]

    model = _learnt(sorted(set(langs)), _idf(len(langs), seen), table)
    del slots, counted, table
    give_back()
    return model


def _idf(rows: int, seen: np.ndarray) -> np.ndarray:
    return np.log((1 + rows) / (1 + seen)).astype(np.float32) + 1


def trained(langs: np.ndarray, table: np.ndarray) -> LanguageModel:
    """A model from counts by language; of a language, equal rows stand together."""
    return _learnt(sorted(set(langs)), _idf(len(table), (table > 0).sum(axis=0)), lambda name: table[langs == name])


def _learnt(languages: list[str], idf: np.ndarray, table: Callable[[str], np.ndarray]) -> LanguageModel:
    """``table`` makes the counts of a language; only one language's rows are held
    as whole vectors at a time."""
    if not languages:
        return LanguageModel([], np.zeros((0, BUCKETS)), np.zeros(BUCKETS), np.zeros(0))
    names, centers, bounds = [], [], []
    for name in languages:
        own = table(name)
        np.log1p(own, out=own)
        own *= idf
        own /= np.maximum(np.sqrt(np.einsum("ij,ij->i", own, own))[:, None], 1e-12)
        reached = left_out(own)
        bound = MARGIN * float(np.quantile(reached, LOW)) if len(reached) else np.nan
        # What would be rejected itself must not draw its like in.
        c = clusters(own if np.isnan(bound) else own[_first_of_equals(own)][reached >= bound], CENTROIDS)
        names += [name] * len(c)
        centers.append(c)
        bounds += [bound] * len(c)
    # A language with one text has the least bound of the others.
    known = [b for b in bounds if not np.isnan(b)]
    reject_below = np.nan_to_num(np.array(bounds), nan=min(known, default=ALONE))
    return LanguageModel(names, np.concatenate(centers).astype(np.float32), idf, reject_below)


def _first_of_equals(x: np.ndarray) -> np.ndarray:
    """Whether a row of ``x``, whose equal rows stand together, is the first of its equals."""
    return np.append(True, (x[1:] != x[:-1]).any(axis=1))


def left_out(own: np.ndarray) -> np.ndarray:
    """The cosine of each distinct row to the nearest centroid of those in other
    folds; nothing if there are fewer than two."""
    x = own[_first_of_equals(own)]
    if len(x) < 2:
        return np.zeros(0)
    fold = np.arange(len(x)) % FOLDS
    out = np.zeros(len(x))
    for f in range(min(FOLDS, len(x))):
        out[fold == f] = (x[fold == f] @ clusters(x[fold != f], CENTROIDS).T).max(axis=1)
    return out


def predicted(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    Null texts and texts without a letter are ``und`` with score 0 and rejected.
    Other rows get a language of the model even if rejected. Of equally near
    centroids the first language by name wins. Columns of ``docs`` with the
    names of the new ones are replaced; repeated rows are judged alike.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    found = _judged(docs.select(*[F.col(f"`{c}`") for c in kept]), model, text)
    return found.select(
        *[F.col(f"`{c}`") for c in kept], F.col("__found.lang").alias("lang_pred"),
        F.col("__found.score").alias("score"), F.col("__found.rejected").alias("rejected"),
    )


def _judged(docs: DataFrame, model: LanguageModel, text: str) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            parts = [shipped.value.predict(batch.iloc[i : i + 64].tolist()) for i in range(0, len(batch), 64)]
            yield pd.concat(parts, ignore_index=True) if parts else _NOTHING
        give_back()

    return docs.withColumn("__found", judge(F.col(text)))


_NOTHING = pd.DataFrame({"lang": [], "score": [], "rejected": []}).astype({"lang": str, "score": float, "rejected": bool})


def held_out(key: Column) -> Column:
    """Rows that models never learn from: crc32 of the key as text leaves 1 on
    division by 3. A null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with predictions of a model learnt from those not held out."""
    model = fit(docs.filter(~held_out(F.col(key))), key, text, lang)
    return predicted(docs, model, text)


def accepted(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    model = fit(docs.filter(~held_out(F.col(key))), key, text, lang)
    return _judged(docs, model, text).filter("not __found.rejected").drop("__found")
