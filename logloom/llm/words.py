"""Words of a whole Arrow batch at once: byte positions and 64-bit hashes as numpy arrays, no work for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken together up to so many bytes; a longer one comes alone, whole.
CHUNK_BYTES = 1 << 18

_STEP = 0x9E3779B97F4A7C15
_ODD = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Alphabet:
    """Which bytes of UTF-8 belong to words, and whether A-Z fold to a-z."""

    def __init__(self, words: str, fold: bool):
        if words == "space":  # [^\x20\x09-\x0D]+
            inside = [b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)]
        elif words == "alnum":  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are a-z
            inside = [0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)]
        else:
            raise ValueError(words)
        folded = np.arange(256, dtype=np.uint64)
        if fold:
            folded[0x41:0x5B] += np.uint64(32)
        self.inside = np.array(inside)
        self.value = mix((folded + np.uint64(1)) * np.uint64(_STEP))


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and those of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        inverse = pow(_ODD, -1, 1 << 64)
        steps = np.full((2, max(n, CHUNK_BYTES + 1)), 1, np.uint64)
        steps[0, 1:], steps[1, 1:] = np.uint64(_ODD), np.uint64(inverse)
        _powers = tuple(np.cumprod(steps, axis=1, dtype=np.uint64))
    return _powers


@dataclass
class Words:
    """Words of consecutive texts: byte starts and ends in ``data``, hashes, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(texts) + 1

    def of(self, text: int) -> slice:
        return slice(self.first[text], self.first[text + 1])

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = alphabet.inside[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < n]] = False
    after[edges[edges > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _powers_to(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(alphabet.value[data] * up[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(_STEP))
    return Words(data, start, end, hashed, np.searchsorted(start, offsets))


def chunks(texts: pa.Array, alphabet: Alphabet) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words) over a whole column; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        yield at, to, words_of(body[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], alphabet)
        at = to


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, also those that cross texts: len(hashes) - k + 1 values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = out * np.uint64(_ODD) + hashes[i : i + n]
    return mix(out)


def inside_text(words: Words, k: int) -> np.ndarray:
    """Which of the runs of ``k`` words lie in one text."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    text = words.text_of_word()
    return text[:n] == text[k - 1 :]


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Least value of every ``w`` consecutive ones, by doubling."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
