"""Polynomial prefix hashes of byte strings, modulo 2**64, and what is built from them with numpy."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
#: BASE times INVERSE is 1 modulo 2**64.
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        held = np.ones(size, dtype=np.uint64)
        known = 1
        while known < size:
            step = np.uint64(pow(base, known, 1 << 64))
            held[known:2 * known] = held[:known] * step
            known *= 2
        _POWERS[base] = held
    return held[:n]


def prefix(codes: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes, the empty one first: the sum of (code + 1) * BASE**i."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(codes)), out=out[1:])
    return out


def spans(prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the strings between ``starts`` and ``ends``, equal for equal strings anywhere."""
    return (prefixes[ends] - prefixes[starts]) * _powers(INVERSE, len(prefixes))[starts]


def mixed(values: np.ndarray, seed: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """The bits spread over the whole word."""
    factor = np.uint64(seed)
    values = (values ^ (values >> np.uint64(31))) * factor
    values = (values ^ (values >> np.uint64(32))) * factor
    return values ^ (values >> np.uint64(32))
