"""Hashes of words and of runs of words, for whole texts at once in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)
_INVERSE = {int(b): _U(pow(int(b), -1, 1 << 64)) for b in (_BASE, _STEP)}
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}
_SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 4096), base, np.uint64)
        out[0] = 1
        have = _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def _runs(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """Prefix sums of value i times base to the power i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(int(base), len(values)), out=out[1:])
    return out


def _span(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _powers(int(_INVERSE[int(base)]), int(start[-1]) + 1)[start] + (end - start).astype(np.uint64) * _BASE)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each word, in order. Long texts go in segments that end between words."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + _SEGMENT)
        while end < len(text) and not _SEP[text[end]]:
            end += 1
        buf = np.frombuffer(text, np.uint8, end - at, at)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SEP[buf], [True])).view(np.int8)))
        start, stop = edge[::2], edge[1::2]
        if len(start):
            out.append(_span(_runs(_BYTES[buf], _BASE), start, stop, _BASE))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def run_hashes(words: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hash of words[start : start + length] for each start, from prefix sums."""
    return _span(_runs(words, _STEP), start, start + length, _STEP) if len(start) else np.empty(0, np.uint64)
