"""Mixing of sources to target weights in blocks of tokens.

1. The documents of a source stand in the order of a hash of the row; each is followed by
   an end mark. Their tokens, end to end, are cut into blocks of `block` tokens; a source's
   last block is filled up with end marks. Blocks depend on the rows alone, not on how
   they are partitioned. Documents are sorted by a range exchange, and their places among
   the tokens are prefix sums of the partitions' counts.
2. Every output shard draws its numbers of blocks from the sources by the weights
   (multinomial, seeded by shard), so any shard can be computed alone.
3. The k-th block that the shards take from a source is block permutation(k mod n) of
   the source's n, a keyed permutation of its own for each pass over the source.
4. Slots and blocks are joined by (source, number): unique keys on one side, at most one
   a pass on the other, so that a large source is spread over all partitions.

Only rows by source, never by document or block, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import DOCUMENT, discard, made, narrow, small, stage_table, trim
from .sharding import permute
from .tokens import PATTERN, RANKS, encode, encoding, widths
from .words import slices

BLOCK = 2_048
SHARD_BLOCKS = 1_024
ALPHA = 0.7
SEED = 20_240_611
#: Shards whose draws are summed up first, so that prefix sums over all shards are short.
GROUP = 1_024
#: Slots that may be broadcast to the blocks; more are joined by a shuffle of both.
MOST_BROADCAST = 1 << 20
_PIECE = "struct<doc_id:bigint,lang:string,begin:bigint,n_tokens:int,text:string>"
_BLOCKS = f"source string, number bigint, at int, n_tokens int, tokens binary, pieces array<{_PIECE}>"
_PIECES = pa.list_(pa.struct([("doc_id", pa.int64()), ("lang", pa.string()), ("begin", pa.int64()), ("n_tokens", pa.int32()), ("text", pa.string())]))
_SCHEMA = pa.schema([("source", pa.string()), ("number", pa.int64()), ("at", pa.int32()), ("n_tokens", pa.int32()), ("tokens", pa.binary()), ("pieces", _PIECES)])
_ENCODED = "source string, part int, offset bigint, n bigint, doc_id bigint, lang string, text string, tokens binary"


def dtype(ranks: str = RANKS, pattern: str = PATTERN) -> str:
    """Of stored tokens: 16 bits if the vocabulary and the end mark fit, else 32, little-endian."""
    return "<u2" if encoding(ranks, pattern).n_vocab < 1 << 16 else "<u4"


def order_keys() -> list[Column]:
    """Two hashes of doc_id, text and lang; rows that have both alike are alike."""
    held = [x for c in ("doc_id", "text", "lang") for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(salt), *held) for salt in (101, 102)]


def _characters(text: bytes, a: int, b: int) -> str:
    """The characters whose first byte is in text[a:b]."""
    while a < len(text) and text[a] & 0xC0 == 0x80:
        a += 1
    while b < len(text) and text[b] & 0xC0 == 0x80:
        b += 1
    return text[a:b].decode("utf-8")


def _encode(with_text: bool, ranks: str, pattern: str):
    """Tokens of sorted documents and where they begin among those of their source in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, offset, kind = TaskContext.get().partitionId(), {}, dtype(ranks, pattern)
        end = np.array([encoding(ranks, pattern).n_vocab], np.uint32)
        for whole in batches:
            for b in slices(whole, "text"):
                at, n, tokens = [], [], []
                for text, source in zip(b.column("text").to_pylist(), b.column("source").to_pylist(), strict=True):
                    ids = np.concatenate([encode(text, ranks, pattern), end])
                    at.append(offset.get(source, 0))
                    n.append(len(ids))
                    tokens.append(ids.astype(kind).tobytes())
                    offset[source] = at[-1] + len(ids)
                text = b.column("text") if with_text else pa.nulls(b.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([b.column("source"), pa.array([part] * b.num_rows, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), b.column("doc_id"), b.column("lang"), text, pa.array(tokens, pa.binary())], names=["source", "part", "offset", "n", "doc_id", "lang", "text", "tokens"])
        trim()

    return run


def _cut(block: int, ranks: str, pattern: str):
    """Blocks of documents at their places; a block of which a task has only a part is given out as that part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, width = dtype(ranks, pattern), np.append(widths(ranks, pattern), 0)
        rows: list[dict] = []
        now: dict = {}

        def close() -> None:
            if now:
                rows.append({**now, "tokens": b"".join(now["tokens"])})
                now.clear()

        for whole in batches:
            for b in slices(whole, "tokens"):
                for r in b.to_pylist():
                    ids = np.frombuffer(r["tokens"], kind)
                    raw = None if r["text"] is None else r["text"].encode()
                    byte = None if raw is None else np.concatenate([[0], np.cumsum(width[ids])])
                    i = 0
                    while i < len(ids):
                        number, at = divmod(r["begin"] + i, block)
                        j = min(len(ids), i + block - at)
                        if now and not (now["source"] == r["source"] and now["number"] == number and now["at"] + now["n_tokens"] == at):
                            close()
                        if not now:
                            now |= {"source": r["source"], "number": number, "at": at, "n_tokens": 0, "tokens": [], "pieces": []}
                        now["tokens"].append(ids[i:j].tobytes())
                        now["n_tokens"] += j - i
                        now["pieces"].append({"doc_id": r["doc_id"], "lang": r["lang"], "begin": i, "n_tokens": j - i, "text": None if raw is None else _characters(raw, int(byte[i]), int(byte[j]))})
                        i = j
                        if now["at"] + now["n_tokens"] == block:
                            close()
                    if len(rows) >= 512:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows = []
        close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
        trim()

    return run


def _assemble(block: int, end: int, kind: str):
    """Whole blocks of the parts that tasks had; a source's last is filled up with end marks."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        parts = sorted(t.to_pylist(), key=lambda r: r["at"])
        n = sum(r["n_tokens"] for r in parts)
        tokens = b"".join(r["tokens"] for r in parts) + np.full(block - n, end, kind).tobytes()
        return pa.Table.from_pylist([parts[0] | {"at": 0, "n_tokens": n, "tokens": tokens, "pieces": [x for r in parts for x in r["pieces"]]}], _SCHEMA)

    return run


def pack(docs: DataFrame, block: int = BLOCK, with_text: bool = False, ranks: str = RANKS, pattern: str = PATTERN) -> tuple[DataFrame, DataFrame]:
    """Blocks: source, number (from 0 in each source), n_tokens (without fill), tokens (as dtype()) and pieces; and the tokens of each source."""
    first, second = order_keys()
    # Rows that are alike may be many: they are spread by their place, which leaves the tokens' order as it is.
    rows = docs.where("text IS NOT NULL").select("source", "doc_id", "lang", "text", first.alias("__a"), second.alias("__b"), F.monotonically_increasing_id().alias("__place"))
    order = ["source", "__a", "__b", "__place"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("source", "doc_id", "lang", "text")
    held = stage_table(placed.mapInArrow(_encode(with_text, ranks, pattern), _ENCODED), "encoded")
    encoded_at = made()[-1]
    counts = stage_table(held.groupBy("source", "part").agg(F.sum("n").alias("n")), "counts")  # a row a source and partition, mostly a row a partition
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = stage_table(counts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("base")), "bases")
    begun = held.join(small(bases), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    cut = begun.select("source", (F.col("base") + F.col("offset")).alias("begin"), "doc_id", "lang", "text", "tokens")
    raw = stage_table(cut.mapInArrow(_cut(block, ranks, pattern), _BLOCKS), "blocks")
    discard(docs.sparkSession, encoded_at)
    whole = F.col("n_tokens") == block
    rest = raw.where(~whole).groupBy("source", "number").applyInArrow(_assemble(block, encoding(ranks, pattern).n_vocab, dtype(ranks, pattern)), _BLOCKS)
    return raw.where(whole).unionByName(rest).drop("at"), counts.groupBy("source").agg(F.sum("n").alias("tokens"))


def draw(shard: int, blocks: int, p: np.ndarray, seed: int) -> np.ndarray:
    """Blocks that a shard takes from each source."""
    return np.random.default_rng([seed, shard]).multinomial(blocks, p)


def _permute(k: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """permute() of each k among its n by its seed."""
    out = np.empty(len(k), np.int64)
    for a, b in set(zip(n.tolist(), seed.tolist(), strict=True)):
        at = (n == a) & (seed == b)
        out[at] = permute(k[at], a, b)
    return out


def slots(n_blocks: list[int], p: np.ndarray, shard_blocks: int, seed: int, spark) -> DataFrame:
    """shard, slot, source_no, number, epoch of every slot, from the sources' numbers of blocks alone; as many slots as blocks."""
    total = sum(n_blocks)
    size = lambda shard: np.minimum(shard_blocks, total - shard * shard_blocks)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["id"]:
                c = draw(int(s), int(size(s)), p, seed)
                yield pd.DataFrame({"shard": s, "source_no": np.arange(len(c), dtype=np.int32), "taken": c, "place": np.cumsum(c) - c})

    drawn_all = spark.range(-(-total // shard_blocks)).mapInPandas(drawn, "shard bigint, source_no int, taken bigint, place bigint").where("taken > 0")
    counts = stage_table(drawn_all.withColumn("of", F.floor(F.col("shard") / GROUP)), "draws")  # a row a shard and source
    upto = lambda w, order: F.coalesce(F.sum("taken").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("source_no", "of").agg(F.sum("taken").alias("taken"))
    groups = groups.select("source_no", "of", upto(Window.partitionBy("source_no"), "of").alias("base"))
    near = counts.withColumn("near", upto(Window.partitionBy("source_no", "of"), "shard"))
    each = near.join(groups, ["source_no", "of"]).select("shard", "source_no", "place", "taken", (F.col("base") + F.col("near")).alias("before"))
    each = each.repartition("shard").select("shard", "source_no", "place", "before", F.posexplode(F.sequence(F.lit(1).cast("bigint"), "taken")).alias("i", "_"))
    each = each.select("shard", "source_no", (F.col("place") + F.col("i")).alias("place"), (F.col("before") + F.col("i")).alias("k"))

    @F.pandas_udf("slot bigint, number bigint, epoch bigint")
    def at(shard: pd.Series, source_no: pd.Series, place: pd.Series, k: pd.Series) -> pd.DataFrame:
        s, k = source_no.to_numpy(), k.to_numpy()
        n = np.array(n_blocks, np.int64)[s]
        epoch = k // n
        number = _permute(k % n, n, seed + 1_000_003 * (s + 1) + epoch * 7_919)
        slot = _permute(place.to_numpy(), size(shard.to_numpy()), seed + 31 * shard.to_numpy())
        return pd.DataFrame({"slot": slot, "number": number, "epoch": epoch})

    return each.withColumn("at", at("shard", "source_no", "place", "k")).select("shard", "at.slot", "source_no", "at.number", "at.epoch")


def _mixed(docs: DataFrame, weights, alpha, block, shard_blocks, seed, with_text, ranks, pattern) -> DataFrame | None:
    spark = docs.sparkSession
    blocks, tokens = pack(narrow(docs, DOCUMENT), block, with_text, ranks, pattern)
    rows = sorted(tokens.collect(), key=lambda r: (r["source"] is not None, r["source"] or ""))  # a row a source
    if not rows:
        return None
    want = np.array([weights.get(r["source"], 0.0) if weights is not None else float(r["tokens"]) ** alpha for r in rows])
    if not want.sum() > 0:
        return None
    n_blocks = [-(-r["tokens"] // block) for r in rows]
    names = spark.createDataFrame([(i, r["source"]) for i, r in enumerate(rows)], "source_no int, name string")
    where = slots(n_blocks, want / want.sum(), shard_blocks, seed, spark)
    numbered = blocks.join(small(names), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    few = sum(n_blocks) <= MOST_BROADCAST  # Spark's own estimate doesn't count what explode() makes
    return (F.broadcast(where) if few else where.hint("merge")).join(numbered, ["source_no", "number"])


def mix_blocks(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """shard, slot, source, number, epoch, n_tokens, tokens and doc_ids: as many slots as there are blocks, `shard_blocks` in every shard but the last.

    weights: expected share of each source among the slots; sources that it lacks, or
    that have no block, get none. Without it a source's share is (its tokens) ** alpha,
    normalised. Tokens are little-endian, of 16 bits, or 32 for a vocabulary that needs
    it. Null texts give no tokens; an empty text is its end mark; a null source is a
    source; a null doc_id stays null in doc_ids. Rows that repeat are repeated. Extra
    columns are dropped. No blocks, no shards. The same rows give the same result
    however they are partitioned.
    """
    mixed = _mixed(docs, weights, alpha, block, shard_blocks, seed, False, ranks, pattern)
    if mixed is None:
        return docs.sparkSession.createDataFrame([], "shard bigint, slot bigint, source string, number bigint, epoch bigint, n_tokens int, tokens binary, doc_ids array<bigint>")
    return mixed.select("shard", "slot", "source", "number", "epoch", "n_tokens", "tokens", F.col("pieces.doc_id").alias("doc_ids"))


def mix_documents(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """mix_blocks() as columns of documents: a row for each document's part of each slot's block, n_chars its characters.

    A character belongs to the block of its first byte. Parts without characters (an end
    mark alone) are left out, unless their document is empty.
    """
    mixed = _mixed(docs, weights, alpha, block, shard_blocks, seed, True, ranks, pattern)
    if mixed is None:
        return narrow(docs, DOCUMENT).limit(0)
    part = mixed.select("source", F.explode("pieces").alias("x")).where("x.text <> '' OR x.begin = 0 AND x.n_tokens = 1")
    return part.select("x.doc_id", "x.text", "x.lang", "source", F.length("x.text").cast("bigint").alias("n_chars"))
