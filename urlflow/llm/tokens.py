"""Byte-level BPE from a file of ranks: one base64 token and its rank a line."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import tiktoken

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words with the space before them, numbers, other signs, white space; contractions apart.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str = RANKS, pattern: str = PATTERN) -> tiktoken.Encoding:
    """Without special tokens: control strings in a text are ordinary text."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def widths(path: str = RANKS, pattern: str = PATTERN) -> np.ndarray:
    """Bytes of every token."""
    e = encoding(path, pattern)
    out = np.zeros(e.n_vocab, np.int64)
    for token, rank in e._mergeable_ranks.items():
        out[rank] = len(token)
    return out


#: The pattern's white space, in runs that its backtracking has no stack for.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def encode(text: str, path: str = RANKS, pattern: str = PATTERN) -> np.ndarray:
    """Ids of a text. Of a long run of white space the pattern takes all but the last sign (all at the end of the text) as one piece; such runs are cut out here and encoded as that piece, which gives the same ids."""
    e = encoding(path, pattern)
    if len(text) < 10_000 or pattern != PATTERN:
        return np.asarray(e.encode_ordinary(text), np.uint32)
    ids, at = [], 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        ids += [e.encode_ordinary(text[at : m.start()]), e._encode_single_piece(text[m.start() : end])]
        at = end
    return np.concatenate([np.asarray(x, np.uint32) for x in [*ids, e.encode_ordinary(text[at:])]])
