"""Counts over a whole text that several quality operators use."""

from __future__ import annotations

import numpy as np

#: Fixed values of the rules: symbol characters, and words per repeated window.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
#: UTF-8 continuation bytes start no character.
_STARTS = np.ones(256, bool)
_STARTS[0x80:0xC0] = False
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def byte_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256)


def word_chars(counts: np.ndarray) -> int:
    """Code points outside white space."""
    return int(counts[_STARTS & ~_IS_SPACE].sum())


def symbols(counts: np.ndarray) -> int:
    return int(counts[_IS_SYMBOL].sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def word_ids(words: list[bytes]) -> np.ndarray:
    """Words numbered by first occurrence."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(word, len(numbers)) for word in words), np.int64, len(words))


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words covered by windows that occur twice or more.

    Runs of 1, 2, 4 and 8 words get exact numbers by pairing the numbers of their halves.
    ``window`` is a power of two.
    """
    if len(ids) <= window:
        return 0
    runs, size = ids, 1
    while size < window:
        pairs = runs[:len(runs) - size] * (len(ids) + 1) + runs[size:]
        runs = np.unique(pairs, return_inverse=True)[1]
        size *= 2
    again = np.bincount(runs)[runs] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[:len(again)] += again
    edges[window:window + len(again)] -= again
    return int((np.cumsum(edges)[:len(ids)] > 0).sum())
