"""Words of many texts as 64-bit codes, computed on whole byte buffers with numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered. Equal words have equal
codes. The code of a word up to 64 bytes is a polynomial hash modulo 2**64 of its bytes, mixed:
such polynomials collide only for far longer words, built for it. A longer word's code is a digest
(BLAKE2b, 8 bytes). Unequal words share a code with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_K = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407], dtype=np.uint64)
#: Bytes that are coded at once; a longer text is one piece of its own.
PIECE = 1 << 20
#: Bytes from which on a word is digested; polynomials of structured words collide from some hundreds on.
LONG = 64
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _K[0]
    x ^= x >> np.uint64(27)
    x *= _K[1]
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * PIECE)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _codes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and first byte of each word."""
    data = np.frombuffer(buffer.lower(), dtype=np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    up, down = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    codes = mix(raw + (ends - starts).astype(np.uint64) * _K[2])
    for k in np.flatnonzero(ends - starts > LONG):
        codes[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return codes, starts


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of all texts in order, and how many each text has."""
    codes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), dtype=np.int64)
    for first, last, buffer, bounds in _pieces(texts):
        c, starts = _codes(buffer)
        codes.append(c)
        counts[first:last] = np.diff(np.searchsorted(starts, bounds))
    return np.concatenate(codes), counts


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        held.append(raw)
        size += len(raw) + 1
        if size >= PIECE or k == len(texts) - 1:
            yield first, k + 1, b"\n".join(held) + b"\n", np.cumsum([0, *(len(x) + 1 for x in held)])
            first, held, size = k + 1, [], 0


def shingles(codes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of `size` words (all its words as one, if it has fewer), sorted, and how many each text has.

    codes, counts: as words() gives them.
    """
    n_texts = len(counts)
    owner = np.repeat(np.arange(n_texts), counts)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
    value = np.zeros(len(codes), dtype=np.uint64)
    short = counts < size
    for k in range(size):
        shifted = np.zeros(len(codes), dtype=np.uint64)
        if k < len(codes):
            shifted[: len(codes) - k] = codes[k:]
        if short.any():  # shorter texts: words beyond the end don't count
            shifted[place + k >= counts[owner]] = 0
        value = mix(value * _K[3] + shifted + np.uint64(k + 1))
    keep = place == 0 if not len(counts) else np.where(short[owner], place == 0, place + size <= counts[owner])
    value, owner = value[keep], owner[keep]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.bincount(owner, minlength=n_texts).astype(np.int64)
