"""Token ids of whole texts, with each distinct unit of text encoded once per worker.

A unit is a piece of text that the tokenizer's own splitting never joins with its neighbours: a run
of letters, of digits or of other characters, with the space before it where the tokenizer keeps
white space. Units are cut with numpy over the bytes of many texts at once; the tokenizers
library encodes each unit that the worker has not seen, and a text's ids are those of its units in
order. This holds for texts of ASCII, Latin-1 letters and common punctuation, on whose classes
all engines agree; any other text is encoded whole by the library.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct units that a worker keeps before it starts afresh; a bound on memory only.
CACHE_UNITS = 1_200_000
#: Characters of text that are cut at a time.
CHUNK = 8_000_000

_SAFE = re.compile("[\t-\r -~À-ÖØ-öø-ÿ¿¡«»–—’“”…]*")
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(0x30, 0x3A)]] = _DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = _LETTER
_ONE, _TWO = np.zeros(256, bool), np.zeros((256, 256), bool)
for _end in ("s", "t", "m", "d"):
    _ONE[ord(_end)] = True
for _end in ("re", "ve", "ll"):
    _TWO[ord(_end[0]), ord(_end[1])] = True


def cut_units(data: np.ndarray, text_starts: np.ndarray, spaced: bool) -> np.ndarray:
    """Offsets at which units start in the joined bytes of safe, non-empty texts."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data == 0xC3)
    kind[lead + 1] = _LETTER
    first = np.zeros(len(data) + 1, bool)
    first[text_starts] = True
    first[-1] = True
    start = first.copy()
    start[1:-1] |= kind[1:] != kind[:-1]
    if not spaced:
        start[:-1] |= kind == _DIGIT
    # An apostrophe that starts a unit takes a short English ending with it.
    at = np.flatnonzero(data == 0x27)
    if len(at):
        before = np.where(first[at], _SPACE, kind[at - 1])
        at = at[(before != _OTHER) & (first[at] | (not spaced) | (data[at - 1] != 0x20))]
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        inside = ~first[at + 1]
        one = inside & _ONE[padded[at + 1]]
        two = inside & ~first[np.minimum(at + 2, len(data))] & _TWO[padded[at + 1], padded[at + 2]]
        for some, length in ((at[one], 2), (at[two], 3)):
            start[some + 1] = first[some + 1]
            start[some + length] = True
    if spaced:
        # A last space belongs to what follows it; other white space before it is a unit.
        space = kind == _SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:-1])
        start[last] = True
        start[last + 1] = data[last] != 0x20
    return np.flatnonzero(start)


class UnitEncoder:
    """``ids(texts)`` gives all ids in one array and the offsets of each text in it.

    ``spaced`` tells whether the tokenizer keeps white space and case, or drops white space and
    lowers letters.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.values = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _slots(self, units: list[bytes]) -> np.ndarray:
        """Number of each distinct unit in the store; those not seen before are encoded."""
        known = self.known
        fresh = [unit for unit in units if unit not in known]
        if len(known) + len(fresh) > CACHE_UNITS and known:
            self._forget()
            known, fresh = self.known, units
        if fresh:
            ids = self._library([unit.decode() for unit in fresh])
            held = len(known)
            ends = (self.ends[held] if held else 0) + np.cumsum([len(x) for x in ids])
            while len(self.ends) <= held + len(fresh):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            while len(self.values) < ends[-1]:
                self.values = np.concatenate([self.values, np.empty_like(self.values)])
            self.values[self.ends[held]:ends[-1]] = [x for own in ids for x in own]
            self.ends[held + 1:held + 1 + len(fresh)] = ends
            known.update(zip(fresh, range(held, held + len(fresh))))
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))

    def _safe_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [(text if self.spaced else text.lower()).encode() for text in texts]
        sizes = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        text_starts = np.cumsum(sizes) - sizes
        offsets = cut_units(data, text_starts, self.spaced)
        units = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        coded = pc.dictionary_encode(units)
        slots = self._slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        low = self.ends[slots]
        count = self.ends[slots + 1] - low
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.values[np.repeat(low - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(offsets, np.concatenate([text_starts, [len(data)]]))]

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[np.ndarray] = []
        lengths = np.zeros(len(texts), np.int64)
        waiting: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal waiting, size
            if waiting:
                ids, offsets = self._safe_ids([texts[row] for row in waiting])
                for at, row in enumerate(waiting):
                    parts[row] = ids[offsets[at]:offsets[at + 1]]
            waiting, size = [], 0

        parts = [np.empty(0, np.uint32)] * len(texts)
        for row, text in enumerate(texts):
            if not text:
                continue
            if _SAFE.fullmatch(text) and not any(token in text for token in self.special):
                waiting.append(row)
                size += len(text)
                if size >= CHUNK:
                    flush()
            else:
                parts[row] = np.array(self._library([text])[0], np.uint32)
        flush()
        lengths[:] = [len(part) for part in parts]
        return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), np.concatenate([[0], np.cumsum(lengths)])


@functools.lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> UnitEncoder:
    """One encoder for the life of a worker process."""
    return UnitEncoder(path, spaced)
