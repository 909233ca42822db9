"""Vectorised words: lower-cased runs of letters, digits and underscores, as 64-bit hashes.

A word is a maximal run of ASCII letters, digits, `_` and non-ASCII characters in
the lower-cased text; typographic punctuation (PUNCTUATION) separates words too.
Hashes depend on the word alone, so they agree between tasks and runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Non-ASCII characters that separate words (RE2 and java.util.regex read this class alike).
PUNCTUATION = "[\u0080-©«-±´¶-¸»¿×÷ -⁯　-〿！-／：-＠]"
_WORD = np.zeros(256, bool)
for _c in b"0123456789_abcdefghijklmnopqrstuvwxyz":
    _WORD[_c] = True
_WORD[128:] = True
_PIECE = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Splitmix finaliser: a bijection of uint64."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x += np.uint64((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & _M64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


_BYTE = mix(np.arange(256, dtype=np.uint64), 77)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


_POWERS = [None]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS[0] is None:
        _POWERS[0] = _powers(_PIECE + 1)
    return _POWERS[0] if n <= _PIECE + 1 else _powers(n)


class Words:
    """hashes of all words, in order; offsets: document i has words offsets[i] to offsets[i + 1]; starts and ends: their bytes in data."""

    def __init__(self, texts: pa.Array, hashes: bool = True):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        data, at = self._bytes(low)
        if data.size and data.max() >= 128:
            data, at = self._bytes(pc.replace_substring_regex(low, PUNCTUATION, " "))
        n = data.size
        self.data = data
        word = _WORD[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        begin = at[:-1][at[:-1] < at[1:]]
        before[begin] = False
        after[at[1:][at[:-1] < at[1:]] - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.offsets = np.searchsorted(self.starts, at)
        self.hashes = self._hash() if hashes else None

    @staticmethod
    def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(a, pa.ChunkedArray):
            a = a.combine_chunks()
        _, offsets, data = a.buffers()
        at = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        return raw, at - at[0]

    def _hash(self) -> np.ndarray:
        s, e, out, i = self.starts, self.ends, np.empty(len(self.starts), np.uint64), 0
        with np.errstate(over="ignore"):
            while i < len(s):
                j = max(i + 1, int(np.searchsorted(e, s[i] + _PIECE, "right")))
                a, b = int(s[i]), int(e[j - 1])
                up, down = _tables(b - a + 1)
                total = np.zeros(b - a + 1, np.uint64)
                np.cumsum(_BYTE[self.data[a:b]] * up[: b - a], out=total[1:])
                out[i:j] = (total[e[i:j] - a] - total[s[i:j] - a]) * down[s[i:j] - a]
                i = j
            return mix(out + (e - s).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.offsets[i] : self.offsets[i + 1]]

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The batch in runs of rows of about `most` bytes of text, so that memory doesn't depend on the batch size."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    total, i = np.concatenate([[0], np.cumsum(lengths)]), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def windows(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of n words of h; empty where h has fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out *= np.uint64(0x100000001B3 * 2 + 0x9E3779B97F4A7C15 & _M64 | 1)
            out += h[k : k + m]
        return mix(out, salt)


def rolling(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """As windows, by prefix sums: its cost doesn't depend on n."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    up, down = _tables(len(h) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h, 5) * up[: len(h)], out=total[1:])
        return mix((total[n:] - total[:m]) * down[:m], salt + n)
