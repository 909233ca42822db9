"""Chat formatting by tokens.

Every turn's text is encoded by itself, so a control string in it can never become a
control id; its opening signs are escaped as well, so it doesn't look like one when
decoded. A conversation is then spliced from reserved ids and the turns' ids:

    BEGIN  (OPEN role LINE text CLOSE LINE)*

Which ids are learned (an assistant's text and its CLOSE) is marked at the borders by
+1 and -1; prefix sums of the marks give the mask. Turns meet by one shuffle on conv_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import narrow
from .tokens import PATTERN, RANKS, encode, encoding
from .words import slices

#: Reserved ids come after the vocabulary's, in this order.
CONTROL = ("<|begin|>", "<|open|>", "<|close|>")
LEARNED = frozenset({"assistant"})
_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""<| becomes <\|, and <\| becomes <\\|: every opening sign gets one more backslash."""
    return _OPENING.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def reserved(ranks: str = RANKS, pattern: str = PATTERN) -> dict[str, int]:
    n = encoding(ranks, pattern).n_vocab
    return {name: n + i for i, name in enumerate(CONTROL)}


def splice(turns: list[tuple[str, np.ndarray]], learned: frozenset = LEARNED, ranks: str = RANKS, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of turns (role, ids of the text)."""
    c = reserved(ranks, pattern)
    line = encode("\n", ranks, pattern)
    parts, marks, at = [np.array([c["<|begin|>"]])], [], 1
    for role, ids in turns:
        head = np.concatenate([[c["<|open|>"]], encode(role, ranks, pattern), line])
        parts += [head, ids, np.array([c["<|close|>"]]), line]
        start = at + len(head)
        if role in learned:
            marks += [(start, 1), (start + len(ids) + 1, -1)]
        at = start + len(ids) + 1 + len(line)
    ids, step = np.concatenate(parts).astype(np.int32), np.zeros(at + 1, np.int64)
    for where, by in marks:
        step[where] += by
    return ids, np.cumsum(step[:-1]).astype(np.int8)


def unsplice(ids: np.ndarray, ranks: str = RANKS, pattern: str = PATTERN) -> list[tuple[str, str]]:
    """Roles and texts of a conversation's ids."""
    c, e = reserved(ranks, pattern), encoding(ranks, pattern)
    ids = np.asarray(ids)
    out = []
    for a in np.flatnonzero(ids == c["<|open|>"]):
        b = a + int(np.flatnonzero(ids[a:] == c["<|close|>"])[0])
        role, _, text = e.decode_bytes(ids[a + 1 : b].tolist()).decode("utf-8").partition("\n")
        out.append((role, unescape(text)))
    return out


def format_chats(conversations: DataFrame, learned: frozenset = LEARNED, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    r"""conv_id, n_turns, ids and mask (1: learned) of every conversation.

    Turns are ordered by turn (null first), then role, then a hash of the text. A null text or role is
    an empty one; line breaks in a role become spaces and its control signs are escaped.
    Turns that repeat are repeated. A turn without conv_id is a conversation of its own.
    A conversation is one row, so its turns meet in one task. Extra columns are
    dropped; no turns, no conversations.
    """
    turns = narrow(conversations, {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}).fillna("", ["role", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                ids = [encode(escape(t), ranks, pattern).astype("<i4").tobytes() for t in part.column("text").to_pylist()]
                role = [escape(re.sub(r"[\r\n]+", " ", r)) for r in part.column("role").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turn"), pa.array(role, pa.string()), part.column("text"), pa.array(ids, pa.binary())], names=["conv_id", "turn", "role", "text", "ids"])

    encoded = turns.mapInArrow(run, "conv_id bigint, turn bigint, role string, text string, ids binary")
    order = F.struct("turn", "role", F.xxhash64("text").alias("h"), "ids")
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    chats = encoded.groupBy("conv_id", alone).agg(F.sort_array(F.collect_list(order)).alias("turns")).drop("alone")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                n, ids, mask = [], [], []
                for turns in part.column("turns").to_pylist():
                    x, y = splice([(t["role"], np.frombuffer(t["ids"], "<i4")) for t in turns], learned, ranks, pattern)
                    n.append(len(turns))
                    ids.append(x)
                    mask.append(y)
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array(n, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(mask, pa.list_(pa.int8()))], names=["conv_id", "n_turns", "ids", "mask"])

    return chats.mapInArrow(assemble, "conv_id bigint, n_turns int, ids array<int>, mask array<tinyint>")
