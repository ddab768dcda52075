"""Exact encoding and decoding with a merge-type (BPE) sentencepiece model.

The tokens of a text are the only sequence that covers it and in which every two
neighbours, merged again on their own, give back exactly these two. So a text is
covered from left to right with the longest piece that fits its left neighbour;
where nothing fits, the last piece is taken back and the position is marked as
failed, so that no position is tried twice. An Aho-Corasick automaton finds the
pieces at all positions in one pass.

No piece holds the blank mark after another character (checked when the model is
loaded), so merges never cross from a word to the next blank and words are
encoded one by one; a bounded cache keeps the words met before.
"""

from __future__ import annotations

import gc
import re
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tablegrist.llm.tidy import tidy

BLANK = "▁"
MODEL = "piece_bpe_32k.model"
#: Words and pairs of pieces kept in memory by each Python worker.
CACHED_WORDS = 100_000
CACHED_PAIRS = 200_000

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PieceModel:
    """The tables of a model file, and encoding and decoding by them."""

    def __init__(self, serialized: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(serialized)
        spec = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if (
            proto.trainer_spec.model_type != 2
            or not proto.trainer_spec.byte_fallback
            or proto.trainer_spec.treat_whitespace_as_suffix
            or spec.precompiled_charsmap
            or spec.remove_extra_whitespaces
            or not spec.add_dummy_prefix
            or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}
        ):
            raise ValueError("not a merge-type model with byte fallback and plain text")
        self.piece = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        self.id_of = {p: i for i, p in enumerate(self.piece) if self.kind[i] == NORMAL}
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.id_of):
            raise ValueError("a piece crosses from a word to a blank")
        self.begin, self.end = self.piece.index("<s>"), self.piece.index("</s>")
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if self.kind[i] == BYTE}
        self.length = [len(p) for p in self.piece]
        self.raw = [self._raw(i) for i in range(len(self.piece))]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.chars = {p for p in self.id_of if len(p) == 1}
        self.words = _WordCache(self)
        self.pairs: dict[int, bool] = {}

    def _raw(self, i: int) -> bytes:
        if self.kind[i] == BYTE:
            return bytes([int(self.piece[i][3:5], 16)])
        if self.kind[i] == CONTROL:
            return b""
        if self.kind[i] == UNKNOWN:
            return " ⁇ ".encode()
        return self.piece[i].replace(BLANK, " ").encode()

    def merged(self, text: str) -> list[int]:
        """Tokens of a short text of known characters by merging pairs: the best
        score first, the leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                t = self.id_of.get(parts[i] + parts[i + 1])
                if t is not None and (best is None or self.score[t] > best):
                    best, at = self.score[t], i
            if best is None:
                return [self.id_of[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when their text is merged anew.
        A negative left one stands for the start."""
        known = self.pairs.get(left << 32 | right)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            if left < 0:
                known = self.merged(self.piece[right]) == [right]
            else:
                known = self.merged(self.piece[left] + self.piece[right]) == [left, right]
            self.pairs[left << 32 | right] = known
        return known

    def run(self, text: str) -> list[int]:
        """Tokens of a text all of whose characters are pieces."""
        n = len(text)
        starts: list[list[int]] = [[] for _ in range(n)]
        length, pairs = self.length, self.pairs
        for last, i in self.automaton.iter(text):
            starts[last + 1 - length[i]].append(i)  # shorter ones come first
        failed = bytearray(n // 8 + 1)
        tokens: list[int] = []
        tried: list[int] = []
        at, choice, left = 0, len(starts[0]) - 1, -1
        while at < n:
            here = starts[at]
            while choice >= 0:
                t = here[choice]
                to = at + length[t]
                if not failed[to >> 3] >> (to & 7) & 1:
                    known = pairs.get(left << 32 | t)
                    if known or known is None and self.fits(left, t):
                        break
                choice -= 1
            if choice >= 0:
                tokens.append(t)
                tried.append(choice)
                left, at = t, to
                choice = len(starts[at]) - 1 if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= length[tokens.pop()]
                choice = tried.pop() - 1
                left = tokens[-1] if tokens else -1
        return tokens

    def word(self, text: str) -> list[int]:
        """Tokens of blanks followed by a word; characters without a piece become
        their bytes and part what stands beside them."""
        if self.chars.issuperset(text):
            return self.run(text)
        out: list[int] = []
        since = 0
        for k, c in enumerate(text):
            if c not in self.chars:
                if k > since:
                    out += self.run(text[since:k])
                out += [self.byte_id[b] for b in c.encode()]
                since = k + 1
        return out + self.run(text[since:]) if since < len(text) else out

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, packed as little-endian unsigned 32-bit numbers."""
        middle = b""
        if text:
            middle = b"".join(map(self.words.__getitem__, words(text)))
        return _pack([self.begin]) + middle + _pack([self.end])

    def decode(self, packed: bytes) -> str:
        """The text of packed ids. Begin and end are empty, one leading blank is
        the one that encoding put there, bytes that are no UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed, "<u4").tolist()
        raw = b"".join(map(self.raw.__getitem__, ids))
        first = next((i for i in ids if self.kind[i] != CONTROL), None)
        if first is not None and self.piece[first].startswith(BLANK):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _mended(raw)


def _mended(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that belongs to no character."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[: e.start].decode(), "�"]
            raw = raw[e.start + 1 :]
    return "".join(out)


class _WordCache(dict):
    """Packed ids by word, without the first blank. When it is full, its words
    become the older half, and those of them that are met again come back."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            found = _pack(self.model.word(BLANK + word))
        if len(word) < 64:
            self[word] = found
        return found


def words(text: str) -> list[str]:
    """The text cut before each run of blanks, each part without its first blank.
    The blank that encoding puts before the text is the first part's."""
    if BLANK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    marked = BLANK + text.replace(" ", BLANK)
    return [w[1:] for w in re.findall(f"{BLANK}+[^{BLANK}]*", marked)]


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def model_file(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        return f.read()


_MODELS: dict[int, PieceModel] = {}


def _loaded(serialized: bytes) -> PieceModel:
    """One model per Python worker, whatever number of tasks it runs."""
    key = hash(serialized)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PieceModel(serialized)
        gc.freeze()  # the tables stay; collections need not walk them
    return _MODELS[key]


def _forget() -> None:
    """What a task leaves to the next one are pairs and the words it met last."""
    for model in _MODELS.values():
        model.words.older = {}


Derive = Callable[[list[bytes], list[str]], list[pa.Array]]


def counted(ids: list[bytes], decoded: list[str]) -> list[pa.Array]:
    """How many ids, and the ids."""
    return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]


def full(ids: list[bytes], decoded: list[str]) -> list[pa.Array]:
    return [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]


def with_tokens(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    derive: Derive = full,
    columns: str = "ids binary, decoded string",
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """``key`` with the packed ids of the text (``ids``, binary, little-endian
    unsigned 32-bit) and the text these ids decode to (``decoded``), or with the
    ``columns`` that ``derive`` makes of both where they are made, so that long
    values need not leave the Python workers.

    A null text is read as an empty one, whose ids are begin and end. Rows and
    keys may repeat or be null; each row is encoded on its own. An empty table gives
    no rows, texts may be of any length. Of the other columns those ``carried`` follow
    the key. The model file is read on the driver and sent to the workers.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model_file(path))
    rows = docs.select(F.col(key).alias("key"), *carried, F.col(text).alias("text"))
    names = ["key", *carried, *(c.split()[0] for c in columns.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(shipped.value)
        for batch in batches:
            for part in _bounded(batch):
                ids = [model.encode(t.as_py() or "") for t in part.column("text")]
                made = derive(ids, [model.decode(x) for x in ids])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names)
            pa.default_memory_pool().release_unused()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema.fields)
    return rows.mapInArrow(tidy(run, _forget), f"{schema}, {columns}").withColumnRenamed("key", key)


def _bounded(batch: pa.RecordBatch, most: int = 64) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


def ids_array(packed: Column) -> Column:
    """Packed ids as an array of int."""
    n = F.octet_length(packed).cast("int") / 4

    def one(i: Column) -> Column:
        at = lambda k: F.conv(F.hex(F.substring(packed, i * 4 + k + 1, 1)), 16, 10).cast("int")
        return at(0) + at(1) * 256 + at(2) * 65536

    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), one)).otherwise(
        F.array().cast("array<int>")
    )
