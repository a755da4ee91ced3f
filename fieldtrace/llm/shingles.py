"""Sets of word shingles as sorted 64-bit hashes (signed, as Spark has them)."""

from __future__ import annotations

import numpy as np

from fieldtrace.llm.hashing import IS_SPACE, LOWER, RangeHash, combine

_WORDS = RangeHash(11)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (A-Z as a-z), and where each text's words begin in them."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    edges = np.diff(IS_SPACE[data].view(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    found = _WORDS(LOWER[data], starts, ends)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return found, np.searchsorted(starts, begins)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted by hash.

    A text with fewer words than `width` has one shingle, the whole sequence; one without words none.
    """
    words, at = word_hashes(texts)
    if len(words) >= width:
        rows = combine([words[i : len(words) - width + 1 + i] for i in range(width)]).view(np.int64)
    found = []
    for start, end in zip(at[:-1], at[1:], strict=True):
        if end - start >= width:
            found.append(np.unique(rows[start : end - width + 1]))
        elif end > start:
            found.append(combine([words[i : i + 1] for i in range(start, end)]).view(np.int64))
        else:
            found.append(np.empty(0, dtype=np.int64))
    return found
