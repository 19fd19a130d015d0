"""Words and word-window hashes of many texts at once, in numpy.

A word is a maximal run of bytes other than space and \\x09-\\x0D. Its hash is a
sum of 64-bit values, one for each byte and its place in the word, as random
as a mixing function makes them: words of repeating patterns, on which a
polynomial modulo 2^64 fails for every base, are words like others here. A
window's hash is a polynomial over its words' hashes, built by doubling. Hash
function 1 shares nothing with function 0, words' hashes included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: The same words as a regular expression (Java and Python).
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP, _SEEDS = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xDA942042E4DD58B5))
_BASES = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
_LUMP, _GAP = 1 << 18, re.compile(rb"[\x20\x09-\x0D]")


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _values(places: np.ndarray, which: int) -> np.ndarray:
    """The value of each (place in the word, byte), given as place * 256 + byte."""
    return mixed(places.astype(np.uint64) * _STEP + _SEEDS[which])


#: Of the first places in a word, the values are looked up.
_LOOKED_UP = 1 << 14
_TABLES = tuple(_values(np.arange(_LOOKED_UP), which) for which in (0, 1))


def _lumps(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts' numbers and contents, of bounded size together; a longer text comes in parts, cut at white space."""
    numbers, lump, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            cut = _GAP.search(text, at + _LUMP)
            part = text[at : cut.start() if cut else len(text)]
            at += max(1, len(part))
            numbers.append(i)
            lump.append(part)
            size += len(part)
            if size >= _LUMP:
                yield numbers, lump
                numbers, lump, size = [], [], 0
    if lump:
        yield numbers, lump


def hash_words(texts: list[bytes], which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one more entry than texts). ``which`` picks one of two hash functions."""
    hashes, counts = [np.zeros(0, dtype=np.uint64)], np.zeros(len(texts) + 1, dtype=np.int64)
    for numbers, lump in _lumps(texts):
        data = np.frombuffer(b"\n".join(lump), dtype=np.uint8)
        space = _SPACE[data]
        edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(starts):
            lengths = ends - starts
            first = np.cumsum(lengths) - lengths
            letters = data[~space]
            places = np.arange(len(letters))
            places -= np.repeat(first, lengths)
            places = (places << 8) + letters
            values = _TABLES[which].take(places, mode="clip")
            if lengths.max() << 8 > _LOOKED_UP:
                late = np.flatnonzero(places >= _LOOKED_UP)
                values[late] = _values(places[late], which)
            hashes.append(mixed(np.add.reduceat(values, first)))
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in lump])))
        np.add.at(counts, np.array(numbers) + 1, np.diff(np.searchsorted(starts, offsets)))
    return np.concatenate(hashes), np.cumsum(counts)


def _rolled(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomials modulo 2^64 of all windows of ``width`` consecutive hashes: those of a + b hashes come from those of a and of b."""
    shift = lambda n: np.uint64(pow(base, n, 1 << 64))
    out, have, part, size = None, 0, hashes, 1
    while True:
        if width & size:
            out = part if out is None else out[: max(0, len(part) - have)] * shift(size) + part[have:][: len(out)]
            have += size
        if have == width:
            return out[: max(0, len(hashes) - width + 1)]
        part = part[: max(0, len(part) - size)] * shift(size) + part[size:]
        size *= 2


def windows(hashes: np.ndarray, first: np.ndarray, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts (word indices) and hashes of all windows of ``width`` words that lie in one text, of hashes of function ``which``."""
    until = np.repeat(first[1:], np.diff(first))
    starts = np.flatnonzero(np.arange(len(hashes)) + width <= until)
    return starts, mixed(_rolled(hashes, width, _BASES[which])[starts])
