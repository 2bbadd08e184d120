"""Sets of hashed word shingles and their MinHash signatures, for slices of Arrow rows."""

from __future__ import annotations

import numpy as np

from pagelake.llm.common import BLANKS, U64, mix, words

K = 5
_PLACE = mix(np.arange(101, 101 + K, dtype=U64)) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the five-word shingles of each row; a shorter text is one shingle, an empty one none."""
    s, _, h, row = words(data, offsets, BLANKS)
    n = len(h)
    whole = np.zeros(max(0, n - K + 1), U64)
    for j in range(K):
        whole += h[j:n - K + 1 + j] * _PLACE[j] if n >= K else whole
    whole = mix(whole)
    out = []
    for a, b in zip(row[:-1].tolist(), row[1:].tolist()):
        if b - a >= K:
            out.append(np.unique(whole[a:b - K + 1]))
        elif b > a:
            part = (h[a:b] * _PLACE[:b - a]).sum(dtype=U64) + U64(b - a)
            out.append(mix(np.array([part], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def minhash(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """Signature of each nonempty set: for every factor the upper 16 bits of a mix of the smallest product."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    out = np.empty((len(sets), len(factors)), np.uint16)
    step = np.empty_like(flat)
    for p, f in enumerate(factors):
        np.multiply(flat, f, out=step)
        out[:, p] = mix(np.minimum.reduceat(step, first)) >> U64(48)
    return out


def set_key(x: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a = x.sum(dtype=U64)
    b = mix(x ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
    return int(a.view(np.int64)), int(b.view(np.int64))
