"""Word-shingle sets as 64-bit hashes, computed for blocks of documents at a time.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A set holds the distinct hashes of
``width`` consecutive words; a text with fewer words, but not none, is one shingle. Two shingles that differ share a
hash with a chance of 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import blocks, mix64, prefix_hash, span_hash

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TERMS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts]
    for i, j in blocks(raw):
        data = np.frombuffer(b" ".join(raw[i:j]) + b" ", np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        start, end = edge[::2], edge[1::2]
        hashes = span_hash(prefix_hash(data), start, end) if len(start) else np.zeros(0, np.uint64)
        ends = np.cumsum([len(x) + 1 for x in raw[i:j]])
        bound = np.concatenate([[0], np.searchsorted(start, ends)])
        full = len(hashes) - width + 1
        every = np.zeros(max(full, 0), np.uint64)
        for k in range(width if full > 0 else 0):
            every += hashes[k : k + full] * _TERMS[k]
        every = mix64(every)
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            if b - a >= width:
                yield np.unique(every[a : b - width + 1])
            elif b > a:
                yield mix64(np.sum(hashes[a:b] * _TERMS[: b - a], keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(size of the intersection, size of the union) of two sorted distinct arrays."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common, len(both) - common
