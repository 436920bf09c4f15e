"""Hashes of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """64-bit hashes of the text's word shingles, in their order; fewer words than a shingle are one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], dtype="<u8")


def simhash(hashes: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint: the bits that are set in over half of the hashes; none: zero."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])
