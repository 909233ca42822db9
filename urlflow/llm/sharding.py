"""Reproducible shuffle: a Feistel permutation of global row numbers with cycle walking.

Row numbers follow (doc_id, hash of the row): one range exchange sorts the rows, and
the numbers of rows per range are the only thing the driver sees. The permutation
needs no data: `permute` gives the place of a row number, `invert` the row number of
a place, so shard and slot can be computed anywhere.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import DOCUMENT, narrow, row_key, small, stage_table, tmp

ROUNDS = 6
PRIME = 2_147_483_647
SEED = 20_240_607
SHARD_ROWS = 8_192


def halves(n: int) -> tuple[int, int]:
    """Sizes a and b of the halves; a * b is n at least and less than n + a. Right up to n = 4e18."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Multiplier and addend of each round, from 1 to PRIME - 1."""
    out, x = [], seed % PRIME
    for _ in range(rounds):
        pair = []
        for _ in range(2):
            x = (x * 48_271 + 11) % PRIME
            pair.append(x % (PRIME - 1) + 1)
        out.append((pair[0], pair[1]))
    return out


def _round(r, key: tuple[int, int]):
    """Works on integers and int64 arrays; stays below 2 ** 63."""
    m, c = key
    x = (r % PRIME * m + c) % PRIME
    y = (x * x + x) % PRIME
    return (y * (m % 65_521 + 1) + c) % PRIME


def _forward(i, n: int, seed: int):
    a, b = halves(n)
    left, right = i // b, i % b
    for j, key in enumerate(keys(seed)):
        if j % 2 == 0:
            left = (left + _round(right, key)) % a
        else:
            right = (right + _round(left, key)) % b
    return left * b + right


def _backward(p, n: int, seed: int):
    a, b = halves(n)
    left, right = p // b, p % b
    for j, key in reversed(list(enumerate(keys(seed)))):
        if j % 2 == 0:
            left = (left - _round(right, key)) % a
        else:
            right = (right - _round(left, key)) % b
    return left * b + right


def _walk(step, i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Steps every value until it is below n: at most a steps, for the permutation has no more values beyond n."""
    out = step(np.asarray(i, np.int64), n, seed)
    while len(at := np.flatnonzero(out >= n)):
        out[at] = step(out[at], n, seed)
    return out


def permute(i: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Places of row numbers i of n rows."""
    return _walk(_forward, i, n, seed)


def invert(p: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Row numbers of places p."""
    return _walk(_backward, p, n, seed)


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with a column __uf_row, from 0 without gaps in the given order (nulls first; rows alike in all of it in any order), and the number of rows."""
    local = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(tmp("at"), F.monotonically_increasing_id())
    held = stage_table(local, "numbered")
    part, before, n = F.shiftright(tmp("at"), 33), {}, 0
    for r in held.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row per range of the exchange
        before[r["part"]] = n
        n += r["count"]
    if not n:
        return held.withColumn(tmp("row"), F.lit(0).cast("bigint")).drop(tmp("at")), 0
    spark = df.sparkSession
    base = small(spark.createDataFrame(list(before.items()), f"{tmp('part')} bigint, {tmp('base')} bigint"))
    row = F.col(tmp("base")) + F.col(tmp("at")).bitwiseAND((1 << 33) - 1)
    return held.join(base, part == F.col(tmp("part"))).withColumn(tmp("row"), row).drop(tmp("at"), tmp("part"), tmp("base")), n


def shard(docs: DataFrame, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """The columns of documents with row_number, shard and slot.

    row_number counts from 0 by doc_id (null first), then by a hash of the row; of
    identical rows each gets its own number. The place is permute(row_number); shard
    and slot are its quotient and remainder by shard_rows, so all shards but the last
    are full. Any column may be null. Extra columns are dropped. No rows, no shards.
    """
    rows = narrow(docs, DOCUMENT).withColumn(tmp("hash"), row_key())
    numbered, n = number_rows(rows, ["doc_id", tmp("hash")])

    @F.pandas_udf("bigint")
    def place(i: pd.Series) -> pd.Series:
        return pd.Series(permute(i.to_numpy(), n, seed))

    out = numbered.drop(tmp("hash")).withColumnRenamed(tmp("row"), "row_number").withColumn(tmp("place"), place("row_number"))
    at = F.col(tmp("place"))
    return out.withColumns({"shard": F.floor((at - at % shard_rows) / shard_rows).cast("bigint"), "slot": at % shard_rows}).drop(tmp("place"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet for each shard, its rows in order of slot."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def oracle(shard_rows: int = SHARD_ROWS, seed: int = SEED) -> str:
    """DuckDB SQL for shard(): the same arithmetic, the walk as a recursive query."""

    def step(i: str) -> str:
        left, right = f"({i} // b)", f"({i} % b)"
        parts, names = [f"SELECT k, n, a, b, {left} AS l0, {right} AS r0 FROM src"], (0, 0)
        for j, (m, c) in enumerate(keys(seed)):
            t, other = ("l", "r") if j % 2 == 0 else ("r", "l")
            size = "a" if j % 2 == 0 else "b"
            src = f"{other}{names[1] if j % 2 == 0 else names[0]}"
            old = f"{t}{names[0] if j % 2 == 0 else names[1]}"
            x = f"(({src} % {PRIME} * {m} + {c}) % {PRIME})"
            parts.append(f"SELECT *, ({old} + ((({x} * {x} + {x}) % {PRIME}) * {m % 65_521 + 1} + {c}) % {PRIME}) % {size} AS {t}{j + 1} FROM ({parts[-1]})")
            names = (j + 1, names[1]) if j % 2 == 0 else (names[0], j + 1)
        return f"SELECT k, n, a, b, l{names[0]} * b + r{names[1]} AS p FROM ({parts[-1]})"

    first, again = step("k"), step("p").replace("FROM src", "FROM walk WHERE p >= n")
    return f"""
    WITH RECURSIVE numbered AS (
      SELECT *, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_number FROM documents),
    total AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(greatest(1, ceil(sqrt(count(*)))) AS BIGINT) AS a FROM documents),
    src AS (SELECT row_number AS k, n, a, CAST(greatest(1, (n + a - 1) // a) AS BIGINT) AS b FROM numbered, total),
    walk AS ({first} UNION ALL {again})
    SELECT doc_id, text, lang, source, n_chars, row_number, p // {shard_rows} AS shard, p % {shard_rows} AS slot
    FROM numbered JOIN (SELECT k, p FROM walk WHERE p < n) ON k = row_number"""
