"""Sets of hashed word shingles, computed with NumPy on the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
# Bytes of text hashed at once: bounds the arrays of 8 bytes per byte of text. A longer text is hashed alone.
AT_ONCE = 1 << 19
_STEP, _JOIN, _SHORT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0x2545F4914F6CDD1D))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# A random number per byte, that of its lower case for A-Z, none for white space.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_BYTES[_SPACE] = 0


def _word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words in ``data`` and, per text, how many words end before it does. Texts are parted by a space."""
    is_word = ~_SPACE[data]
    starts = np.flatnonzero(is_word & ~np.concatenate(([False], is_word[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    stops = np.concatenate((starts[1:], [len(data)]))
    # Of every byte, its place in its word; the white space before the first word counts for nothing.
    place = np.zeros(len(data), np.int64)
    place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, stops - starts)
    powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(place.max()), _STEP))))
    return mixed(np.add.reduceat(_BYTES[data] * powers[place], starts)), np.searchsorted(starts, ends)


def _sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    hashes, behind = _word_hashes(data, ends)
    joined = hashes[: max(0, len(hashes) - words + 1)].copy()
    for k in range(1, words):
        joined = joined * _JOIN + hashes[k : len(hashes) - words + 1 + k]
    joined = mixed(joined)
    first = 0
    for last in behind.tolist():
        n = last - first
        if n >= words:
            yield np.unique(joined[first : last - words + 1])
        elif n:
            short = np.uint64(n) * _SHORT
            for h in hashes[first:last]:
                short = short * _JOIN + h
            yield mixed(np.array([short]))
        else:
            yield np.zeros(0, np.uint64)
        first = last


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """Per text its distinct shingles as sorted 64-bit hashes: ``words`` lower-cased words each, all words of a shorter text, none without words."""
    with np.errstate(over="ignore"):
        block, size = [], 0
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            if block and size + len(raw) > AT_ONCE:
                yield from _sets(block, words)
                block, size = [], 0
            block.append(raw)
            size += len(raw) + 1
        if block:
            yield from _sets(block, words)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed numbers."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(shingles))
        first = mixed(shingles.sum(dtype=np.uint64, keepdims=True) + n) if len(shingles) else np.zeros(1, np.uint64)
        second = mixed(mixed(shingles ^ _STEP).sum(dtype=np.uint64, keepdims=True)) if len(shingles) else np.zeros(1, np.uint64)
    return int(first.view(np.int64)[0]), int(second.view(np.int64)[0])
