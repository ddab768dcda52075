"""Alignment of two tokenizers over a corpus, with corpus-wide counts of the pairs.

A byte-level tokenizer (A) and one of pieces (B) cut the same bytes; where tokens
of both end, their last tokens are linked. The documents are aligned once and their
links written, packed, to the shared folder. A pass over these counts the links of
every pair of ids. The distinct pairs get the numbers of a minimal perfect hash, so
the counts of a task are a dense vector, and vectors are summed slice by slice in a
tree. A last pass over the links looks up the count of each; a pair's key is kept at
its number and compared.

Neither tokenizer has a token that goes from another character on to a blank, so
texts are cut at each blank that follows a character other than white space. A
task encodes each distinct part once, many parts at a time.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegrist.llm.grams import mixed
from tablegrist.llm.perfect_hash import PerfectHash
from tablegrist.llm.reuse import compacted
from tablegrist.llm.rows import FILE, ROW, located
from tablegrist.llm.tidy import tidy
from tablegrist.session import cut_lineage

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLANK = "▁"
#: Distinct parts a worker holds before it starts anew (some 300 bytes each), and
#: the characters of those encoded in one call.
PARTS, CALL = 700_000, 1 << 17
#: Characters of the texts that are taken apart at once.
GROUP = 1 << 22
#: Links that are looked up at once, and distinct pairs that a task counts before
#: it passes them on.
LINKS, COUNTED = 1 << 20, 1 << 20
#: Pairs of one perfect hash.
SHARD = 1 << 18
#: Counters of a slice of the vectors, and first-level sums of each slice.
SLICE, BRANCHES = 1 << 16, 32
#: Bytes of hash, keys and counts that may be sent to every task. Beyond them the
#: second pass joins its links with the counts.
BROADCAST_BYTES = 128 << 20

_CUT = re.compile(r"(?<=\S) ")
#: Where a text has none of these it is cut at every blank.
_SPACED = [c + " " for c in map(chr, range(0x3001)) if c.isspace()]
_SPACED_ASCII = [c for c in _SPACED if c.isascii()]


@dataclass
class Aligned:
    """The tokens of some parts, all after each other, and where both end.
    ``a_to`` and ``b_to`` are the tokens of each part as ends of ranges."""

    a: np.ndarray
    b: np.ndarray
    a_to: np.ndarray
    b_to: np.ndarray
    #: Of each link: its part, and its tokens by place.
    part: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray

    @property
    def pairs(self) -> np.ndarray:
        return self.a[self.a_at] << 32 | self.b[self.b_at]


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in enumerate(_byte_characters())}
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        spelled = lambda name: bytes(byte_of[c] for c in name) if byte_of.keys() >= set(name) else b""
        self.a_bytes = [spelled(names.get(i, "")) for i in range(max(names) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.blank = self.b.piece_to_id(BLANK)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(BLANK, " ").encode()

    def encoded(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a blank and each part."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        b = self.b.encode(parts, num_threads=1)
        return a, [ids if p else [self.blank] for p, ids in zip(parts, b)]

    def spells(self, part: str, a: list[int], b: list[int]) -> bool:
        """Whether both lists of ids stand for a blank and the part."""
        raw = b" " + part.encode()
        return raw == b"".join(map(self.a_bytes.__getitem__, a)) == b"".join(map(self.b_bytes.__getitem__, b))

    def aligned(self, parts: list[str], plain: bool) -> tuple[Aligned, np.ndarray]:
        """The alignment of the parts, and which of them both tokenizers spell as
        they are; the others have no tokens. ``plain`` parts are encoded as one text."""
        text = " ".join(parts)
        if text.isascii():
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        else:
            sizes = np.array([len(p.encode()) for p in parts], np.int64) + 1
        ((a,), (b,)) = self.encoded([text]) if plain else ([None], [None])
        if plain and self.spells(text, a, b):
            a, b, fine = np.array(a, np.int64), np.array(b, np.int64), np.ones(len(parts), bool)
        else:
            many_a, many_b = self.encoded(parts)
            fine = np.array([self.spells(*x) for x in zip(parts, many_a, many_b)], bool)
            sizes = np.where(fine, sizes, 0)
            keep = np.flatnonzero(fine).tolist()
            a = np.array([t for k in keep for t in many_a[k]], np.int64)
            b = np.array([t for k in keep for t in many_b[k]], np.int64)
        a_end, b_end, end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), np.cumsum(sizes)
        both, a_at, b_at = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
        return Aligned(
            a, b, np.searchsorted(a_end, end, "right"), np.searchsorted(b_end, end, "right"),
            np.searchsorted(end, both), a_at, b_at,
        ), fine


def _byte_characters() -> list[str]:
    """The character a byte-level vocabulary writes for each byte: printable ones
    stand for themselves, the others for the characters from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


def parts_of(text: str) -> list[str]:
    """The text cut at each blank that follows a character other than white space;
    with a blank before each part they are a blank and the text."""
    if text[:1] != " " and not any(c in text for c in (_SPACED_ASCII if text.isascii() else _SPACED)):
        return text.split(" ")
    return _CUT.split(text)


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def loaded(a_path: str, b_path: str) -> Tokenizers:
    """One pair of tokenizers per Python worker."""
    if (a_path, b_path) not in _LOADED:
        _LOADED.clear()
        _LOADED[a_path, b_path] = Tokenizers(a_path, b_path)
    return _LOADED[a_path, b_path]


def _calls(parts: set[str]) -> Iterator[tuple[list[str], bool]]:
    """Parts for one call each, and whether they can be encoded side by side, which
    takes that they have no white space at their ends."""
    plain = [p for p in parts if p and not p[0].isspace() and not p[-1].isspace()]
    for group, side_by_side in ((plain, True), (list(parts.difference(plain)), False)):
        ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
        cuts = np.flatnonzero(np.diff(ends // CALL)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)]):
            if j > i:
                yield group[i:j], side_by_side


class Parts:
    """The distinct parts of texts a worker has met, as long as they are no more
    than ``PARTS``, with their sizes, links and groups."""

    def __init__(self, tools: Tokenizers):
        self.tools = tools
        self.narrow = max(len(tools.a_bytes), len(tools.b_bytes)) <= 1 << 16
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.bad: set[str] = set()
        self.groups: list[str] = []
        self._sizes = [np.zeros((0, 3), np.int64)]
        self._pairs = [np.zeros(0, np.uint32 if self.narrow else np.int64)]

    def full(self) -> bool:
        return len(self.index) >= PARTS

    def add(self, texts: list[list[str]]) -> None:
        """Number the parts that are new."""
        new: set[str] = set()
        for words in texts:
            new.update(words)
        new.difference_update(self.index.keys())
        for call, side_by_side in _calls(new):
            since = len(self.index)
            aligned, fine = self.tools.aligned(call, side_by_side)
            self.index.update(zip(call, range(since, since + len(call))))
            self.bad.update(p for p, f in zip(call, fine.tolist()) if not f)
            sizes, strings = _part_results(aligned)
            self.groups += strings
            self._sizes.append(sizes)
            self._pairs.append(_packed(aligned.pairs) if self.narrow else aligned.pairs)

    @property
    def sizes(self) -> np.ndarray:
        """``n_a``, ``n_b`` and ``n_links`` of each part."""
        self._sizes = [np.concatenate(self._sizes)] if len(self._sizes) > 1 else self._sizes
        return self._sizes[0]

    @property
    def pairs(self) -> np.ndarray:
        """The pairs of all links, part after part."""
        self._pairs = [np.concatenate(self._pairs)] if len(self._pairs) > 1 else self._pairs
        return self._pairs[0]

    def spelled(self, words: list[str]) -> bool:
        return not self.bad or self.bad.isdisjoint(words)

    def rows(self, texts: list[list[str]]) -> list[pa.Array]:
        """``n_a``, ``n_b``, ``n_links``, the digest of the groups and the packed
        pairs of each text."""
        places, digests = [], []
        for words in texts:
            at = list(map(self.index.__getitem__, words)) if self.spelled(words) else []
            digests.append(hashlib.sha256(";".join(map(self.groups.__getitem__, at)).encode()).hexdigest() if at else "")
            places.append(at)
        ends = np.cumsum([len(at) for at in places])
        at = np.fromiter(chain.from_iterable(places), np.int64, int(ends[-1]))
        sizes = self.sizes[at]
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(sizes, axis=0)])[np.append(0, ends)]
        totals = np.diff(sums, axis=0)
        n = sizes[:, 2]
        since = np.cumsum(self.sizes[:, 2]) - self.sizes[:, 2]
        link = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(since[at], n)
        pairs = self.pairs[link]
        offsets = pa.py_buffer((sums[:, 2] * pairs.itemsize).astype(np.int64))
        packed = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, offsets, pa.py_buffer(pairs)])
        return [*(pa.array(x) for x in totals.T), pa.array(digests, pa.string()), packed.cast(pa.binary())]


def _packed(pairs: np.ndarray) -> np.ndarray:
    """Both ids in 16 bits each."""
    return (pairs >> 16 | pairs & 0xFFFF).astype(np.uint32)


def links_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of the rows of a batch with some ``LINKS`` links, how many each row has,
    and the pairs of all of them. Packed ids are told by their width."""
    n = batch.column("n_links").to_numpy()
    groups = np.cumsum(n) // LINKS
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(n)]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            raw = b"".join(batch.column("pairs").slice(i, j - i).to_pylist())
            own = n[i:j]
            if len(raw) == 8 * own.sum():
                yield i, j, own, np.frombuffer(raw, np.int64)
            else:
                ids = np.frombuffer(raw, np.uint32).astype(np.int64)
                yield i, j, own, (ids >> 16 << 32) | ids & 0xFFFF


#: What a worker keeps from task to task.
_KEPT: dict[tuple[str, str], Parts] = {}


def _parts(a_path: str, b_path: str) -> Parts:
    if (a_path, b_path) not in _KEPT:
        _KEPT.clear()
        _KEPT[a_path, b_path] = Parts(loaded(a_path, b_path))
    return _KEPT[a_path, b_path]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Slices of a batch of about so many characters, and their texts in parts."""
    texts, size, since = [], 0, 0
    for i, cell in enumerate(batch.column("text")):
        value = cell.as_py()
        texts.append(parts_of(value) if value else [])
        size += len(value or "")
        if size > GROUP:
            yield batch.slice(since, len(texts)), texts
            texts, size, since = [], 0, i + 1
    if texts:
        yield batch.slice(since, len(texts)), texts


def aligned_links(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The columns of ``rows`` but ``text``, with ``n_a``, ``n_b``, ``n_links``,
    ``groups_sha256`` and ``pairs``, those of all links of the text one after the
    other. A text with a part that is not spelled as it is has no tokens."""
    named = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(a_path, b_path)
        for batch in batches:
            for piece, texts in _groups(batch):
                if parts.full():
                    parts.clear()
                parts.add(texts)
                columns = [piece.column(c) for c in named] + parts.rows(texts)
                yield pa.RecordBatch.from_arrays(columns, [*named, "n_a", "n_b", "n_links", "groups_sha256", "pairs"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in named)
    return rows.mapInArrow(tidy(run), f"{schema}, n_a bigint, n_b bigint, n_links bigint, groups_sha256 string, pairs binary")


def counted_pairs(found: DataFrame) -> DataFrame:
    """``pair`` and ``n``, links over all rows; a pair may come several times from
    each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pair", "n"])

        for batch in batches:
            for _, _, _, pairs in links_of(batch):
                new, times = np.unique(pairs, return_counts=True)
                keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([sums, times]), len(keys)).astype(np.int64)
                if len(keys) >= COUNTED:
                    yield counted()
                    keys, sums = keys[:0], sums[:0]
        yield counted()

    return found.select("n_links", "pairs").mapInArrow(tidy(run), "pair bigint, n bigint")


class PairNumbers:
    """Perfect hashes of all pairs, each over the pairs of one shard."""

    def __init__(self, shards: list[PerfectHash]):
        self.shards = shards
        self.since = np.concatenate([[0], np.cumsum([len(s) for s in shards])]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.since[-1])

    @property
    def keys(self) -> np.ndarray:
        return np.concatenate([s.keys for s in self.shards])

    def find(self, pairs: np.ndarray) -> np.ndarray:
        of = shard_of(pairs, len(self.shards))
        out = np.full(len(pairs), -1, np.int64)
        for k, shard in enumerate(self.shards):
            here = np.flatnonzero(of == k)
            found = shard.find(pairs[here])
            out[here] = np.where(found < 0, -1, found + self.since[k])
        return out


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(pairs.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def numbered(distinct: DataFrame, n: int) -> PairNumbers:
    """The perfect hash of ``n`` distinct ``pair`` values; each shard is made in a
    task of its own."""
    shards = n // SHARD + 1

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = batch.column("pair").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(pairs, shards)), batch.column("pair")], ["shard", "pair"])

    def build(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": group["shard"].head(1), "hash": [pickle.dumps(PerfectHash(group["pair"].to_numpy()).state())]})

    made = distinct.mapInArrow(placed, "shard bigint, pair bigint").groupBy("shard").applyInPandas(
        build, "shard bigint, hash binary"
    )
    hashes = [PerfectHash(np.zeros(0, np.int64))] * shards
    for row in made.collect():
        hashes[row["shard"]] = PerfectHash.restored(pickle.loads(row["hash"]))
    return PairNumbers(hashes)


def summed(partial: DataFrame, numbers: PairNumbers) -> np.ndarray:
    """The sum of ``n`` for each number. A task adds up its rows in a dense vector;
    slices of the vectors are added in two levels."""
    shipped = partial.sparkSession.sparkContext.broadcast(numbers)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(len(shipped.value), np.int64)
        for batch in batches:
            at = shipped.value.find(batch.column("pair").to_numpy())
            if (at < 0).any():
                raise ValueError("a pair without a number")
            np.add.at(vector, at, batch.column("n").to_numpy())
        slices = [(k, vector[k * SLICE : (k + 1) * SLICE]) for k in range(-(-len(vector) // SLICE))]
        slices = [(k, x) for k, x in slices if x.any()]
        branch = TaskContext.get().partitionId() % BRANCHES
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in slices], pa.int64()), pa.array([branch] * len(slices), pa.int32()),
             pa.array([x.tobytes() for _, x in slices], pa.binary())],
            ["slice", "branch", "counts"],
        )

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in group["counts"])
        return group.head(1).assign(counts=[total.tobytes()])

    kind = "slice bigint, branch int, counts binary"
    first = partial.mapInArrow(dense, kind).groupBy("slice", "branch").applyInPandas(added, kind)
    out = np.zeros(len(numbers), np.int64)
    for row in first.groupBy("slice").applyInPandas(added, kind).collect():
        values = np.frombuffer(row["counts"], np.int64)
        out[row["slice"] * SLICE :][: len(values)] = values
    return out


@dataclass
class PairCounts:
    """Counts by the numbers of pairs, and whether each is the highest of its B id."""

    numbers: PairNumbers
    counts: np.ndarray

    def __post_init__(self) -> None:
        b = self.numbers.keys & 0xFFFFFFFF
        highest = np.zeros(int(b.max()) + 1 if len(b) else 0, np.int64)
        np.maximum.at(highest, b, self.counts)
        self.best = self.counts == highest[b]

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.numbers.find(pairs)
        return np.where(at < 0, 0, self.counts[at]), (at >= 0) & self.best[at]


def _group_strings(found: Aligned) -> list[str]:
    """`a1,a2|b1` for each group, in order."""
    a, b = list(map(str, found.a.tolist())), list(map(str, found.b.tolist()))
    a_to, b_to = (found.a_at + 1).tolist(), (found.b_at + 1).tolist()
    return [
        f"{a[i] if k - i == 1 else ','.join(a[i:k])}|{b[j] if m - j == 1 else ','.join(b[j:m])}"
        for i, k, j, m in zip([0, *a_to], a_to, [0, *b_to], b_to)
    ]


def _part_results(found: Aligned) -> tuple[np.ndarray, list[str]]:
    """A row of sizes for each part, and its groups."""
    n = len(found.a_to)
    ends = np.searchsorted(found.part, np.arange(n), "right")
    sizes = np.stack([np.diff(x, prepend=0) for x in (found.a_to, found.b_to, ends)], axis=1).astype(np.int64)
    strings, ends = _group_strings(found), ends.tolist()
    return sizes, [";".join(strings[x:y]) for x, y in zip([0, *ends], ends)]


def _looked_up(found: DataFrame, counts) -> DataFrame:
    """``found`` with ``n_best`` and ``count_sum`` in place of the pairs."""
    named = [c for c in found.columns if c != "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, n, pairs in links_of(batch):
                distinct, at = np.unique(pairs, return_inverse=True)
                number, best = counts.value.of(distinct)
                to = np.append(0, np.cumsum(n))
                sums = [np.diff(np.append(0, np.cumsum(x[at], dtype=np.int64))[to]) for x in (best, number)]
                columns = [batch.column(c).slice(i, j - i) for c in named]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sums)], [*named, "n_best", "count_sum"])

    schema = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in named)
    return found.mapInArrow(tidy(run), f"{schema}, n_best bigint, count_sum bigint")


def aligned_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    a_path: str | None = None, b_path: str | None = None, most_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """A row per row of ``docs``: ``key``, ``n_a`` and ``n_b`` (tokens), ``n_groups``,
    ``n_links``, ``n_best`` (links whose pair no other pair of the same B id comes
    before by its count in all documents), ``count_sum`` (counts of the pairs of all
    links) and ``groups_sha256`` (of ids in groups; '' without tokens).

    Null and empty texts, and texts that one of the tokenizers does not spell as
    they are, have no tokens and count nowhere. Keys may be null or repeat, each row
    counts. Texts of any length are cut into parts, a part without a blank is
    encoded in one piece. Other columns are not read; an empty table gives no rows.
    The links are written to the shared folder, 4 bytes each (8 if a vocabulary has
    more than 65,536 ids). Hash, keys and counts are sent to the tasks up to
    ``most_bytes`` (24 a pair); beyond that the links are joined with the counts.
    """
    a_path = a_path or public_tokenizers.path(A_FILE)
    b_path = b_path or public_tokenizers.path(B_FILE)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = cut_lineage(aligned_links(rows, a_path, b_path))
    partial = cut_lineage(counted_pairs(found))
    distinct = compacted(partial.select("pair").distinct())
    n = distinct.count()
    if n * 24 > most_bytes:
        out = _by_join(found, partial)
    else:
        numbers = numbered(distinct, n)
        out = _looked_up(found, docs.sparkSession.sparkContext.broadcast(PairCounts(numbers, summed(partial, numbers))))
    return out.select(
        F.col("key").alias(key), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256"
    )


def _by_join(found: DataFrame, partial: DataFrame) -> DataFrame:
    """The same as ``_looked_up`` with counts that are too many to be sent to every task."""
    counts = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    highest = counts.groupBy(of_b).agg(F.max("n").alias("highest"))
    counts = counts.withColumn("b", of_b).join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    found = located(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, n, pairs in links_of(batch):
                own = [np.unique(x, return_counts=True) for x in np.split(pairs, np.cumsum(n)[:-1])]
                of = pa.array(np.repeat(np.arange(i, j), [len(p) for p, _ in own]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(FILE).take(of), batch.column(ROW).take(of), *(pa.array(np.concatenate(x)) for x in zip(*own))],
                    [FILE, ROW, "pair", "times"],
                )

    links = found.select(FILE, ROW, "n_links", "pairs").mapInArrow(
        tidy(run), f"{FILE} string, {ROW} bigint, pair bigint, times bigint"
    ).join(counts, "pair")
    sums = links.groupBy(FILE, ROW).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    return found.drop("pairs").join(sums, [FILE, ROW], "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")}
    )
