"""Hashed character n-grams of whole texts, counted with numpy."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np

#: Characters of a text counted at once; longer texts are counted piece by piece.
WINDOW = 1 << 18

_IS_LETTER: np.ndarray | None = None


def is_letter() -> np.ndarray:
    """Whether a code point is a letter, by code point."""
    global _IS_LETTER
    if _IS_LETTER is None:
        _IS_LETTER = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])
    return _IS_LETTER


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers, the same on every machine."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(text: str, overlap: int) -> Iterator[str]:
    """The text in pieces that overlap by ``overlap`` characters."""
    if len(text) <= WINDOW:
        yield text
        return
    for at in range(0, len(text) - overlap, WINDOW - overlap):
        yield text[at : at + WINDOW]
