"""Distinct requests by fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.url import fingerprint, is_static, without_fragment


def with_fingerprint(df: DataFrame, url: str = "url", method: str = "method") -> DataFrame:
    return df.withColumn("fp", fingerprint(F.col(url), F.col(method)))


def first_wins(df: DataFrame, order: str, url: str = "url", method: str = "method") -> DataFrame:
    """One row of each fingerprint, the first by `order`, with fp; static resources and URLs that can't be parsed have none.

    An aggregate, not a window: the row is reduced before the exchange, and no
    fingerprint has to fit into memory.
    """
    keyed = with_fingerprint(df.where(~is_static(without_fragment(F.col(url)))), url, method).where("fp IS NOT NULL")
    rest = [F.col(c) for c in df.columns]
    first = keyed.groupBy("fp").agg(F.min_by(F.struct(*rest), F.struct(order, url, method)).alias("row"))
    return first.select("row.*", "fp")


def bad_urls(df: DataFrame, url: str = "url", method: str = "method") -> DataFrame:
    """What first_wins() leaves out because it can't be parsed."""
    return with_fingerprint(df, url, method).where("fp IS NULL").drop("fp")
