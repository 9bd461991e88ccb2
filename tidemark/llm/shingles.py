"""Sets of word shingles as 64-bit hashes, computed on whole byte buffers with numpy."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Longer texts are hashed in parts of about so many bytes, cut at white space.
PART_BYTES = 1 << 20

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random number for each byte; capital ASCII letters share their small one's.
_LETTER = _rng.integers(0, 1 << 63, size=256, dtype=np.uint64) * U(2) + U(1)
_LETTER[65:91] = _LETTER[97:123]
_BASE = U(0x9E3779B97F4A7C15) | U(1)
_BASE_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            step = np.full(2 * n, base, dtype=np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def _spans(b: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = between[b]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(b) + 1)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_LETTER[b] * up[: len(b)], dtype=np.uint64)])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    return starts, ends, hashes


def word_spans(b: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words between the given bytes (ASCII white space), A-Z as a-z."""
    if len(b) <= PART_BYTES:
        return _spans(b, between)
    parts, start = [], 0
    while start < len(b):
        end = min(start + PART_BYTES, len(b))
        while end < len(b):
            after = np.flatnonzero(between[b[end : end + PART_BYTES]])
            if len(after):
                end += int(after[0])
                break
            end = min(end + PART_BYTES, len(b))
        s, e, h = _spans(b[start:end], between)
        parts.append((s + start, e + start, h))
        start = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def word_hashes(text: str, between: np.ndarray = _SPACE) -> np.ndarray:
    return word_spans(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), between)[2]


def shingle_list(w: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of a sequence of words, by place; with fewer words the whole sequence is one; without words none."""
    if not len(w):
        return w
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, U(k), dtype=np.uint64)
    for i in range(k):
        h = mix(h * U(0xFF51AFD7ED558CCD) + w[i : len(w) - k + 1 + i])
    return h


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(shingle_list(word_hashes(text or ""), size))
