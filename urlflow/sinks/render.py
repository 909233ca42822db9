"""Results as columns: one value a row, ready for any writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_line(method: Column, url: Column) -> Column:
    return F.concat(F.lit("["), method, F.lit("]"), url)


def json_line(*columns: str) -> Column:
    """Compact JSON; <, > and & escaped as in HTML-safe JSON."""
    x = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    for c, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        x = F.replace(x, F.lit(c), F.lit(code))
    return x


def without_bodies(log: DataFrame) -> DataFrame:
    """Results without requests' and responses' text: the scan doesn't read them."""
    return log.drop("ResponseBody", "RequestStr")


def host_report(results: DataFrame, host: Column) -> DataFrame:
    """host and count of results."""
    return results.groupBy(host.alias("host")).agg(F.count("*").alias("count"))


def envelope(results: DataFrame, host: Column, order: str, most: int | None = 10_000) -> DataFrame:
    """host, count, chunk and results, in order: what a report shows. A host of more than `most` results has as many chunks as that asks for, by a hash of the order column; without `most` every host is one row."""
    held = results.withColumn("__host", host)
    rows = F.sort_array(F.collect_list(F.struct(order, *[c for c in results.columns if c != order])))
    if most is None:
        return held.groupBy(F.col("__host").alias("host")).agg(F.count("*").alias("count"), rows.alias("results")).select("host", "count", F.lit(0).alias("chunk"), "results")
    counts = held.groupBy(F.col("__host").alias("__of")).agg(F.count("*").alias("__count"))
    parts = held.join(counts, F.col("__host").eqNullSafe(F.col("__of")))
    chunk = F.pmod(F.xxhash64(order), F.ceil(F.col("__count") / most)).cast("int").alias("chunk")
    return parts.groupBy(F.col("__host").alias("host"), F.col("__count").alias("count"), chunk).agg(rows.alias("results"))
