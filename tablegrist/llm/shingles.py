"""Sets of word shingles of whole texts, as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

from tablegrist.llm.grams import mixed

_WINDOW = 1 << 18
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: The blanks between words, `[\x20\x09-\x0D]`.
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
#: Places of a word up to this one have their bytes' values in a table.
_NEAR = 64
_NONE = np.zeros(0, np.uint64)


def _byte_values(places: np.ndarray, raw: np.ndarray) -> np.ndarray:
    return mixed((places.astype(np.uint64) << np.uint64(8) | raw) * _GOLD + _GOLD)


_TABLE = _byte_values(np.repeat(np.arange(_NEAR), 256), np.tile(np.arange(256, dtype=np.uint64), _NEAR))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case: the sum of a random value for
    each byte at its place in the word, mixed. Values of different places have
    nothing in common, so words of a regular build do not cancel out. The sum of a
    word that goes on in the next window is carried there."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    found, begun, length = [], 0, 0
    for at in range(0, len(raw), _WINDOW):
        b = np.frombuffer(raw, np.uint8, min(_WINDOW, len(raw) - at), at)
        on = length > 0 and not _BLANK[b[0]]
        if length and not on:
            found.append(np.array([begun], np.uint64))
        starts, ends, sums = _sums(b, length if on else 0)
        if on:
            sums[0] += np.uint64(begun)
        if len(b) and not _BLANK[b[-1]] and at + len(b) < len(raw):
            length = int(ends[-1] - starts[-1]) + (length if on and len(starts) == 1 else 0)
            begun, sums = int(sums[-1]), sums[:-1]
        else:
            length = 0
        found.append(sums)
    return mixed(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _sums(b: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and sum of each word of some bytes; the first word has ``before``
    bytes in front of them."""
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    places = np.arange(int(lengths.sum()), dtype=np.int32)
    places -= np.repeat(first.astype(np.int32), lengths)
    if before:
        places[: lengths[0]] += before
    raw = b[inside[1:-1]]
    if before or int(lengths.max()) > _NEAR:
        values = _TABLE.take(np.minimum(places, _NEAR - 1) << 8 | raw)
        far = np.flatnonzero(places >= _NEAR)
        values[far] = _byte_values(places[far], raw[far].astype(np.uint64))
    else:
        values = _TABLE.take(places << 8 | raw)
    return starts, ends, np.add.reduceat(values, first)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """``shingle_set`` of each text. Short ones are read side by side."""
    raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    out: list[np.ndarray] = [_NONE] * len(raws)
    held: list[int] = []

    def read() -> None:
        starts, _, sums = _sums(np.frombuffer(b" ".join(raws[i] for i in held), np.uint8))
        words = mixed(sums)
        ends = np.cumsum([len(raws[i]) + 1 for i in held])
        runs = _runs(words, width)
        cuts = np.searchsorted(starts, ends).tolist()
        for i, a, z in zip(held, [0, *cuts], cuts):
            out[i] = _distinct(runs[a : z - width + 1]) if z - a >= width else _set_of(words[a:z], width)
        held.clear()

    size = 0
    for i, raw in enumerate(raws):
        if len(raw) > _WINDOW:
            out[i] = shingle_set(texts[i], width)
            continue
        if held and size + len(raw) > _WINDOW:
            read()
            size = 0
        held.append(i)
        size += len(raw) + 1
    if held:
        read()
    return out


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``width`` words; of a text with fewer
    words, its only run; empty without words."""
    return _set_of(word_hashes(text or ""), width)


def _set_of(words: np.ndarray, width: int) -> np.ndarray:
    if not len(words):
        return words
    return _distinct(_runs(words, min(width, len(words))))


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = max(0, len(words) - width + 1)
    run = words[:n]
    for k in range(1, width):
        run = mixed(run * _GOLD + words[k : n + k])
    return run + np.uint64(width)


def _distinct(values: np.ndarray) -> np.ndarray:
    found = np.sort(values)
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found[new]


def slices(batch: pa.RecordBatch, bytes_each: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many bytes of ``text``."""
    sizes = pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // bytes_each
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    n = common(a, b)
    return 100 * n >= percent * (len(a) + len(b) - n)
