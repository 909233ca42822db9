"""Document fingerprints by consistent weighted sampling.

Each document is a bag of words with weights (term counts). For every one of the
`samples` positions, gamma and uniform variates that depend on (term, position)
alone pick one (term, quantised weight) of the bag; two documents pick the same
one with probability sum(min weights) / sum(max weights), their generalised
Jaccard similarity. Map-only: no shuffle, memory bound by the slice of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import narrow, trim
from .words import Words, mix, slices

SAMPLES = 64


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    return ((mix(h, salt) >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def sample(terms: np.ndarray, weights: np.ndarray, starts: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """int64 signatures, one row for each run of terms that begins at starts (none is empty)."""
    if not len(starts):
        return np.zeros((0, samples), np.int64)
    distinct, code = np.unique(terms, return_inverse=True)
    logw, lengths = np.log(weights).astype(np.float32), np.diff(np.append(starts, len(terms)))
    owner = np.repeat(np.arange(len(starts)), lengths)
    out = np.empty((len(starts), samples), np.int64)
    for k in range(samples):
        u = [_uniform(distinct, 5 * k + i + 1) for i in range(5)]
        r, logc, beta = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]
        rk, bk = r[code], beta[code]
        t = np.floor(logw / rk + bk)
        score = logc[code] - rk * (t - bk) - rk
        least = np.minimum.reduceat(score, starts)
        at = np.flatnonzero(score == least[owner])
        first = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])] if len(at) else at
        out[:, k] = mix(terms[first] ^ mix(t[first].astype(np.int64).view(np.uint64), k), 11).view(np.int64)
    return out


def bags(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """terms, counts, starts of the non-empty documents' runs, and number of distinct terms of every document; terms ascend in each run."""
    terms, counts, n = [], [], np.zeros(len(w), np.int64)
    for i in range(len(w)):
        t, c = np.unique(w.of(i), return_counts=True)
        n[i] = len(t)
        terms.append(t)
        counts.append(c)
    full = n[n > 0]
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(terms, np.uint64), cat(counts, np.int64), np.concatenate([[0], np.cumsum(full)[:-1]]).astype(np.int64) if len(full) else np.zeros(0, np.int64), n


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_terms (distinct words) and signature (array of `samples` longs) of every row.

    A null text has a null signature and null n_terms; a text without words has an
    empty signature and 0. A null doc_id stays null. Repeated rows are repeated.
    Extra columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                w = Words(b.column("text"))
                terms, counts, starts, n = bags(w)
                rows = sample(terms, counts, starts, samples)
                null = ~np.asarray(b.column("text").is_valid())
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, samples, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, mask=null), lists], names=["doc_id", "n_terms", "signature"])
        trim()

    return narrow(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(run, "doc_id bigint, n_terms bigint, signature array<bigint>")
