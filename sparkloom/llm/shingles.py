"""Sets of hashed word shingles, computed with numpy over whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WORDS = 5
#: Bytes hashed at a time; pieces end at white space.
PIECE = 1 << 18
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: A random value for each byte at each of the first PLACES positions of a word.
PLACES = 64
_VALUES = np.random.default_rng(0x5EED).integers(0, 1 << 64, PLACES << 8, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit hash for each word of some lower-cased texts, and the number of words of each text.

    A word's hash is the mixed sum of a random value for each (place, byte), so no two words collide but by chance.
    """
    raw = raws[0] if len(raws) == 1 else b"\n".join(raws)
    found, places = [], []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + 2 * PIECE)
        while end < len(raw) and not _WHITE[raw[end]]:
            end += 1
        piece = np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at)
        white = np.ones(len(piece) + 2, dtype=bool)
        np.take(_WHITE, piece, out=white[1:-1])
        edges = np.flatnonzero(white[1:] != white[:-1])
        starts, ends = edges[::2], edges[1::2]
        # The place of each byte in its word; that of white space doesn't matter.
        index = np.arange(len(piece), dtype=np.int64)
        first = np.zeros(len(piece), dtype=np.int64)
        first[starts] = starts
        index -= np.maximum.accumulate(first, out=first)
        values = _VALUES.take(((index & (PLACES - 1)) << 8) | piece)
        if len(starts) and int((ends - starts).max()) > PLACES:
            far = np.flatnonzero(index >= PLACES)
            values[far] = mix(values[far] + mix((index[far] >> (PLACES.bit_length() - 1)).astype(np.uint64)))
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(values, out=sums[1:])
        found.append(mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64)))
        places.append(starts + at)
        at = end
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(raws), dtype=np.int64)
    bounds = np.cumsum([0] + [len(r) + 1 for r in raws])
    return np.concatenate(found), np.diff(np.searchsorted(np.concatenate(places), bounds))


def _combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words."""
    size = len(hashes) - width + 1
    sums = np.full(size, width, dtype=np.uint64)
    for k in range(width):
        sums += hashes[k : k + size]
        sums ^= sums >> np.uint64(29)
        sums *= np.uint64(0xBF58476D1CE4E5B9)
        sums ^= sums >> np.uint64(32)
    return mix(sums)


def shingle_sets(texts: Iterable[str | None], words: int = WORDS, group: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For groups of successive texts: (the number of distinct shingles of each text, these shingles).

    The shingles are 64-bit hashes, sorted within each text.  A text with fewer words than a shingle has is one
    shingle; one that is null or has no word has none.  Groups have about as many bytes as given; a longer text
    is a group of its own.
    """
    part: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
        if part and size + len(raw) > group:
            yield _sets_of(part, words)
            part, size = [], 0
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield _sets_of(part, words)


def _sets_of(raws: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, n_words = word_hashes(raws)
    ends = np.cumsum(n_words)
    owner = np.repeat(np.arange(len(raws)), n_words)
    if len(hashes) >= words:
        whole = owner[: len(owner) - words + 1] == owner[words - 1 :]
        flat, of = _combine(hashes, words)[whole], owner[: len(whole)][whole]
    else:
        flat, of = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(short):
        extra = np.array([_combine(hashes[ends[i] - n_words[i] : ends[i]], int(n_words[i]))[0] for i in short], dtype=np.uint64)
        at = np.searchsorted(of, short)
        flat, of = np.insert(flat, at, extra), np.insert(of, at, short)
    cuts = np.searchsorted(of, np.arange(len(raws) + 1))
    for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        flat[start:end].sort()
    if len(flat):
        keep = np.append(True, (flat[1:] != flat[:-1]) | (of[1:] != of[:-1]))
        flat, of = flat[keep], of[keep]
    return np.bincount(of, minlength=len(raws)), flat


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingles of one text."""
    return next(shingle_sets([text], words))[1]
