"""Sets of word n-grams as 64-bit hashes, and sorted integers in few bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import Words, mix, windows


def gram_ids(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram's hash and document, in order; a document of 1 to n - 1 words has one gram, all its words."""
    h, lengths = w.hashes, np.diff(w.offsets)
    owner = np.repeat(np.arange(len(w)), lengths)
    g = windows(h, n)
    inside = owner[: len(g)] == owner[n - 1 :] if len(g) else np.zeros(0, bool)
    g, doc = g[inside], owner[: len(g)][inside]
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    if len(short):
        whole = np.array([mix(windows(w.of(i), int(lengths[i])), n)[0] for i in short], np.uint64)
        g, doc = np.concatenate([g, whole]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    return g, doc


def gram_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each document, ascending, and where each document's begin (len(w) + 1 numbers)."""
    g, doc = gram_ids(w, n)
    order = np.argsort(g)
    order = order[np.argsort(doc[order], kind="stable")]
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(w) + 1))


def planes(x: np.ndarray) -> bytes:
    """Bytes of uint32 values by significance, so that the exchange's compression drops the empty ones."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def squeeze(ascending: np.ndarray) -> bytes:
    """uint32 in ascending order as planes of their differences."""
    return planes(np.diff(ascending.astype(np.uint32), prepend=np.uint32(0)))


def unsqueeze(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b), dtype=np.uint64).astype(np.uint32)


def blobs(a: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return a.to_pylist()
