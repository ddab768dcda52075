"""Toxicity by subword-bag embeddings and a linear softmax.

A text is the weighted average of the embeddings of its subwords: the hashed byte
n-grams (three to five) of its words with their bounds, so a misspelling shares
most of its parts with the word it stands for. A subword weighs the square of its
log odds between the classes, so the many that say nothing do not drown a few
words in a long text. Embeddings and softmax weights are trained together in
numpy on a bounded, balanced sample of labelled texts. Scoring needs one number
per subword, the difference of the two logits it adds.

The sample is the only thing that is bounded: ``SAMPLE`` labelled rows of each
class, chosen by a hash of the id over all labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegrist.llm.grams import mixed, windows
from tablegrist.session import cut_lineage

SLOTS = 1 << 18
ORDERS = (3, 4, 5)
SAMPLE = 2000
#: Subwords met in fewer texts of the sample, or in a smaller share of them, have
#: no embedding.
MIN_TEXTS, MIN_SHARE = 3, 0.005
DIM = 4
EPOCHS, BATCH, RATE = 15, 256, 0.05
#: Averages are multiplied by this: a few words in a long text move them little.
GAIN = 100.0
THRESHOLD = 0.7

#: Bytes of words: ASCII letters and digits, and all bytes of other characters.
_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def subwords(text: str) -> Iterator[np.ndarray]:
    """Slots of the subwords of a text, in pieces for long texts."""
    for piece in windows(text, 64):
        b = np.frombuffer(b" " + piece.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)
        b = np.where(_WORD[b], b, 32)
        b = b[(b != 32) | np.append(True, b[:-1] != 32)]
        blanks = np.cumsum(b == 32)
        c = b.astype(np.uint64)
        gram = np.zeros(len(c), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            part = c[n - 1 :]
            gram = (gram[: len(part)] << np.uint64(8)) | part
            if n in ORDERS:
                # Blanks only at the ends: none from the second to the last but one.
                inner = blanks[n - 2 : len(c) - 1] == blanks[: len(part)]
                yield (mixed(gram[inner] + np.uint64(n << 59)) & np.uint64(SLOTS - 1)).astype(np.int64)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a text and the share of each."""
    parts = list(subwords(text))
    slots, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, int),) * 2
    return slots.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


@dataclass
class ToxicityModel:
    weight: np.ndarray
    """What a subword adds to the difference of the logits."""
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for slots in subwords(text or ""):
            total += float(self.weight[slots].sum(dtype=np.float64))
            n += len(slots)
        z = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def trained(bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, seed: int = 7) -> ToxicityModel:
    """Embeddings and softmax weights by gradient steps with per-weight rates."""
    if not len(bags) or toxic.min() == toxic.max():
        # Nothing to tell apart: no text is toxic, or all that is known is.
        return ToxicityModel(np.zeros(SLOTS, np.float32), -3.0 if not len(bags) or not toxic.max() else 0.0)
    rng = np.random.default_rng(seed)
    texts, in_toxic = (
        np.bincount(np.concatenate([s for (s, _), t in zip(bags, toxic) if t or every]), minlength=SLOTS)
        for every in (True, False)
    )
    n, n_toxic = len(bags), int(toxic.sum())
    odds = ((in_toxic + 1) / (n_toxic + 2)) / ((texts - in_toxic + 1) / (n - n_toxic + 2))
    weigh = (np.log(odds) ** 2).astype(np.float32)
    used = np.nonzero(texts >= max(MIN_TEXTS, MIN_SHARE * n))[0]
    dense = np.full(SLOTS, -1)
    dense[used] = np.arange(len(used))
    data = []
    for slots, share in bags:
        at = dense[slots]
        data.append((at[at >= 0], (share * weigh[slots] * np.float32(GAIN))[at >= 0]))
    # Both classes count alike however many texts they have.
    even = np.where(toxic == 1, n / (2 * n_toxic), n / (2 * (n - n_toxic)))
    e = rng.normal(0, 0.01, (len(used), DIM)).astype(np.float32)
    w = rng.normal(0, 1, (2, DIM)).astype(np.float32)
    b = np.zeros(2, np.float32)
    past_e, past_w, past_b = np.full_like(e, 1e-6), np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    target = np.stack([1 - toxic, toxic], axis=1).astype(np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            ids = np.concatenate([data[r][0] for r in rows])
            share = np.concatenate([data[r][1] for r in rows])
            row = np.repeat(np.arange(len(rows)), [len(data[r][0]) for r in rows])
            hidden = np.stack([
                np.bincount(row, e[ids, d] * share, minlength=len(rows)) for d in range(DIM)
            ], axis=1).astype(np.float32)
            logits = hidden @ w.T + b
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = ((p - target[rows]) * (even[rows] / len(rows))[:, None]).astype(np.float32)
            back = g @ w
            grad_e = np.stack([
                np.bincount(ids, back[row, d] * share, minlength=len(e)) for d in range(DIM)
            ], axis=1).astype(np.float32)
            for x, grad, past in ((e, grad_e, past_e), (w, g.T @ hidden, past_w), (b, g.sum(axis=0), past_b)):
                past += grad * grad
                x -= np.float32(RATE) * grad / np.sqrt(past)
    weight = np.zeros(SLOTS, np.float32)
    weight[used] = GAIN * weigh[used] * (e @ (w[1] - w[0]))
    return ToxicityModel(weight, float(b[1] - b[0]))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    sample: int = SAMPLE,
) -> ToxicityModel:
    """A model from the ``docs`` whose key has a ``label`` 0 or 1 in ``labels``.

    Rows without key, text or label teach nothing; a key with both labels counts
    as toxic. The chosen keys, at most two times ``sample``, are sent to all
    tasks; the bags of their texts (at most SLOTS numbers each) come back.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(
        F.col(key).alias("key")
    ).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    known = cut_lineage(known)
    some = [
        known.filter(F.col("toxic") == t).orderBy(F.xxhash64("key"), "key").limit(sample) for t in (0, 1)
    ]
    chosen = cut_lineage(some[0].unionByName(some[1]))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [bag(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("toxic"),
                     pa.array([s.tobytes() for s, _ in found], pa.binary()),
                     pa.array([n.tobytes() for _, n in found], pa.binary())],
                    ["key", "toxic", "slots", "share"],
                )

    kind = rows.schema["key"].dataType.simpleString()
    table = cut_lineage(
        rows.join(F.broadcast(chosen), "key").select("key", "toxic", "text").mapInArrow(
            bags, f"key {kind}, toxic int, slots binary, share binary"
        )
    ).toArrow()
    lines = list(zip(*(table.column(c).to_pylist() for c in ("key", "toxic", "slots", "share"))))
    lines.sort()  # the order in which tasks end must not matter
    found = [(np.frombuffer(s, np.int32), np.frombuffer(n, np.float32)) for _, _, s, n in lines]
    return trained(found, np.array([t for _, t, _, _ in lines], dtype=np.int64))


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on).

    Null and empty texts have the score of the bias alone. Repeated rows are
    scored alike; columns of ``docs`` with the names of the new ones are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shipped.value.score(t) for t in batch], dtype="float64")

    found = docs.select(*[F.col(f"`{c}`") for c in kept], score(F.col(text)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
