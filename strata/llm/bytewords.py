"""Vectorised hashing of the words of UTF-8 texts, on numpy arrays of bytes.

Words are runs of bytes other than 0x20 and 0x09-0x0D, lower-cased over A-Z only. A
multi-byte character never holds such bytes, so working on bytes equals working on
code points.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_SEGMENT = 1 << 21
_PIECE = 1 << 12
_ODD = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    code = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    for b in range(65, 91):
        code[b] = code[b + 32]
    return code, np.cumprod(np.full(_PIECE, 0x5851F42D4C957F2D, np.uint64), dtype=np.uint64)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each [start, end) of data; the runs are in order and apart. Memory is bounded for texts and runs of any length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    long = np.flatnonzero(lens > _PIECE)
    if len(long):
        out, short = np.zeros(len(lens), np.uint64), lens <= _PIECE
        out[short] = hash_runs(data, starts[short], ends[short])
        out[long] = [_long_run(data[starts[k] : ends[k]]) for k in long]
        return out
    total = np.cumsum(lens)
    if total[-1] > _SEGMENT and len(lens) > 1:
        cuts = [0, *(int(np.searchsorted(total, t)) for t in range(_SEGMENT, int(total[-1]), _SEGMENT)), len(lens)]
        parts = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
        return np.concatenate([_hash_runs(data, starts[a:b], lens[a:b]) for a, b in parts])
    return _hash_runs(data, starts, lens)


def _hash_runs(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    code, power = _tables()
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    within = np.arange(int(lens.sum())) - np.repeat(first, lens)
    at = within + np.repeat(starts, lens)
    return mix(np.add.reduceat(code[data[at]] * power[within], first) + lens.astype(np.uint64))


def _long_run(run: np.ndarray) -> np.uint64:
    """A run of more than _PIECE bytes: its pieces are hashed, and then the sequence of their hashes."""
    code, power = _tables()
    state = np.array([len(run)], np.uint64)
    for at in range(0, len(run), _PIECE):
        piece = run[at : at + _PIECE]
        state = mix(state * _ODD + (code[piece] * power[: len(piece)]).sum(dtype=np.uint64))
    return state[0]


def word_hashes(text) -> np.ndarray:
    """Hashes of the words of one text (bytes or an Arrow buffer), in order. Works through long texts piece by piece."""
    data, out, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(data):
        end = min(len(data), at + _SEGMENT)
        if end < len(data):
            blank = np.flatnonzero(SPACE[data[at:end]])
            if not len(blank):  # the segment lies in one word: look for its end
                while end < len(data):
                    blank = np.flatnonzero(SPACE[data[end : end + _SEGMENT]])
                    end = end + int(blank[0]) if len(blank) else min(len(data), end + _SEGMENT)
                    if len(blank):
                        break
                out.append(hash_runs(data, np.array([at]), np.array([end])))
                at = end
                continue
            end = at + int(blank[-1]) + 1
        out.append(hash_runs(data[at:end], *runs(~SPACE[data[at:end]])))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n words in a row; of fewer words, the whole sequence."""
    if not len(words):
        return words
    size = min(n, len(words))
    h = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9DDFEA08EB382D69) + words[k : k + len(h)]
        h ^= h >> np.uint64(29)
    h = np.sort(mix(h + np.uint64(size)))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def utf8(scalar):
    """The UTF-8 bytes of an Arrow string value without a copy; None where null or empty."""
    b = scalar.as_buffer() if scalar.is_valid else None
    return b if b is not None and b.size else None
