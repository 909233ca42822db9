"""Term vectors in long form (key, term, tf) and their cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_terms


def term_counts(pages: DataFrame, key: str = "page_id", terms: Column | None = None) -> DataFrame:
    terms = text_terms(F.col("html")) if terms is None else terms
    return pages.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def cosine(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """pairs(a, b) with cos; a(a, term, tf) and b(b, term, tf). 0 where either has no terms."""
    na = a.groupBy("a").agg(F.sum(F.col("tf") * F.col("tf")).alias("na"))
    nb = b.groupBy("b").agg(F.sum(F.col("tf") * F.col("tf")).alias("nb"))
    dot = pairs.join(a.withColumnRenamed("tf", "ta"), "a").join(b.withColumnRenamed("tf", "tb"), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("ta") * F.col("tb")).alias("dot"))
    out = pairs.join(dot, ["a", "b"], "left").join(na, "a", "left").join(nb, "b", "left")
    return out.select("a", "b", F.round(F.coalesce(F.col("dot") / (F.sqrt("na") * F.sqrt("nb")), F.lit(0.0)), 6).alias("cos"))


def _vectors(pages: DataFrame, key: str = "a") -> DataFrame:
    """key, g, v (map from term to count) and norm of pages(key, g, html), by one exchange on the key."""
    each = pages.select(key, "g", F.explode_outer(text_terms(F.col("html"))).alias("term")).repartition(key)
    counts = each.groupBy(key, "g", "term").agg(F.count("*").alias("tf"))
    entries = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf")))
    return counts.groupBy(key, "g").agg(F.map_from_entries(entries).alias("v"), F.sqrt(F.sum(F.when(F.col("term").isNotNull(), F.col("tf") * F.col("tf")))).alias("norm"))


def to_baseline(pages: DataFrame, group: Column, key: str = "page_id") -> DataFrame:
    """page (a), baseline (b) and cos of every page against the least page of its group: linear in the pages, unlike all pairs.

    A group's baseline is one vector, joined to its pages; products are taken in the row.
    """
    v = _vectors(pages.select(F.col(key).alias("a"), group.alias("g"), "html"))
    base = v.groupBy("g").agg(F.min("a").alias("a")).join(v.select("a", "v", "norm"), "a").toDF("b", "g", "w", "norm_b")
    both = v.join(base, "g")
    dot = F.aggregate(F.map_entries("v"), F.lit(0).cast("bigint"), lambda s, x: s + x["value"] * F.coalesce(F.col("w")[x["key"]], F.lit(0).cast("bigint")))
    return both.select("a", "b", F.round(F.coalesce(dot / (F.col("norm") * F.col("norm_b")), F.lit(0.0)), 6).alias("cos"))


def soft_404(pages: DataFrame, group: Column, key: str = "page_id", threshold: float = 0.95) -> DataFrame:
    """Pages that look like their group's baseline (the answer to a URL that can't exist), the baseline among them."""
    return to_baseline(pages, group, key).where(F.col("cos") > threshold)
