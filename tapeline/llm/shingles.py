"""Hashed word shingles of whole texts, for Arrow batches in tasks.

Words are hashed over a buffer of many texts at once: a running polynomial over the bytes, divided by the power at
the word's start, is the same for the same word wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Lower-cases A-Z in UTF-8 bytes and leaves the rest.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
IS_GAP = np.isin(np.arange(256), [32, *range(9, 14)])
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at once.
SPAN = 1 << 20
BASE = 0x5851F42D4C957F2D
_tables: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX[0]
    x ^= x >> np.uint64(27)
    x *= MIX[1]
    x ^= x >> np.uint64(31)
    return x


def tables() -> list[np.ndarray]:
    """A random value per byte; powers of BASE and of its inverse."""
    if not _tables:
        value = mixed(np.arange(1, 257, dtype=np.uint64) * STEP)
        powers = [np.cumprod(np.r_[np.uint64(1), np.full(SPAN - 1, x, dtype=np.uint64)], dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64))]
        _tables.extend([value, *powers])
    return _tables


def word_hashes(buffer: bytes, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of lower-cased bytes that end in a gap; with ``prefixes``, a row of hashes for
    each word: the whole, then its first so many bytes."""
    value, power, inverse = tables()
    data = np.frombuffer(buffer, dtype=np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(data):
        gap = IS_GAP[data[at : at + SPAN]]
        last = np.flatnonzero(gap)
        if not len(last):  # a word longer than the span
            rest = np.flatnonzero(IS_GAP[data[at:]])
            end = at + int(rest[0])
            hashes.append(np.full((1, 1 + len(prefixes)), xxhash.xxh3_64_intdigest(buffer[at:end]), dtype=np.uint64))
            starts.append(np.array([at]))
            at = end + 1
            continue
        n = int(last[-1]) + 1
        gap = gap[:n]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        edge = edge if gap[0] else np.r_[0, edge]
        first, end = edge[0::2], edge[1::2]
        run = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(value[data[at : at + n]] * power[:n], out=run[1:])
        stops = [end, *(np.minimum(end, first + p) for p in prefixes)]
        hashes.append(np.stack([mixed((run[stop] - run[first]) * inverse[first]) for stop in stops], 1))
        starts.append(first + at)
        at += n
    made = np.concatenate(hashes) if hashes else np.empty((0, 1 + len(prefixes)), np.uint64)
    return made if prefixes else made[:, 0], np.concatenate(starts) if starts else np.empty(0, np.int64)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    out = np.full(n, size, dtype=np.uint64) * STEP
    for i in range(size):
        out = mixed(out + hashes[i : i + n] + STEP)
    return out


def grouped(raw: list[bytes], width: int) -> Iterator[np.ndarray]:
    hashes, starts = word_hashes(b"\n".join(raw) + b"\n")
    ends = np.cumsum([len(r) + 1 for r in raw])
    text = np.searchsorted(ends, starts, side="right")
    words = np.bincount(text, minlength=len(raw))
    first = np.r_[0, np.cumsum(words)]
    if len(hashes) >= width:
        same = text[: len(text) - width + 1] == text[width - 1 :]
        shingle = runs(hashes, width)[same]
    else:
        shingle = np.empty(0, np.uint64)
    at = 0
    for k, n in enumerate(words.tolist()):
        if n < width:
            yield runs(hashes[first[k] : first[k + 1]], n) if n else np.empty(0, np.uint64)
            continue
        own = shingle[at : at + n - width + 1]
        at += n - width + 1
        own.sort()
        keep = np.ones(len(own), dtype=bool)
        np.not_equal(own[1:], own[:-1], out=keep[1:])
        yield own[keep]


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Per text its distinct hashes, sorted, of ``width`` consecutive words (lower-cased in A-Z, split at space and the
    characters 9 to 13); of all words where there are fewer; none without words."""
    part: list[bytes] = []
    size = 0
    for text in texts:
        part.append(text.encode("utf-8", "surrogatepass").translate(LOWER) if text else b"")
        size += len(part[-1]) + 1
        if size >= SPAN // 2:
            yield from grouped(part, width)
            part, size = [], 0
    if part:
        yield from grouped(part, width)


def set_name(hashes: np.ndarray) -> bytes:
    """16 bytes that name a set of hashes."""
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else bytes(16)
