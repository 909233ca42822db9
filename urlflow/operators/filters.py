"""Row filters over request logs and frontiers, and their anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_not_found
from ..functions.url import fingerprint, is_static, is_static_for_frontier

UNREACHABLE = (401, 403, 404, 503, 504)


def in_scope(url: Column, host: Column) -> Column:
    """Traffic: the URL contains the host name."""
    return F.contains(url, host)


def in_scope_prefix(url: Column, host: Column) -> Column:
    """Results: http or https on exactly this host (with port)."""
    return F.startswith(url, F.concat(F.lit("http://"), host)) | F.startswith(url, F.concat(F.lit("https://"), host))


def in_frontier_scope(url: Column, host: Column) -> Column:
    return (url != "") & ~(url.contains("http") & ~F.contains(url, host))


def is_reachable(status: Column) -> Column:
    return status.isNotNull() & ~status.isin(*UNREACHABLE)


def loaded_types(df: DataFrame, kind: str = "rtype") -> DataFrame:
    """Without fonts and images."""
    return df.where(~F.coalesce(F.col(kind).isin("Font", "Image"), F.lit(False)))


def request_results(log: DataFrame, host: str, soft_404: DataFrame | None = None, probe_url: str | None = None) -> DataFrame:
    """The exchanges of a log that become results: in scope, not 404 by status, words or likeness, not the probe. soft_404 has a column url."""
    url = F.col("URL")
    out = log.where(in_scope(url, F.lit(host)) & (F.col("Status") != 404) & in_scope_prefix(url, F.lit(host)))
    if "ResponseBody" in log.columns:
        out = out.where(~F.coalesce(is_not_found(F.decode(F.unbase64("ResponseBody"), "UTF-8")), F.lit(False)))
    if probe_url is not None:
        out = out.where(url != probe_url)
    if soft_404 is not None:
        out = out.join(soft_404.select(F.col("url").alias("URL")).distinct(), "URL", "left_anti").select(*log.columns)
    return out.withColumn("Data", F.when(F.col("Method") == "POST", F.col("Data")).otherwise(""))


def unvisited(urls: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose fingerprint isn't in visited(fp); Spark broadcasts visited only below its threshold."""
    keyed = urls.withColumn("__fp", fingerprint(F.col(url), F.lit("GET")))
    return keyed.join(visited.select(F.col("fp").alias("__fp")), "__fp", "left_anti").select(*urls.columns)


def without_static(df: DataFrame, url: str = "url", frontier: bool = False) -> DataFrame:
    return df.where(~(is_static_for_frontier if frontier else is_static)(F.col(url)))


def enough_rows(df: DataFrame, least: int = 2) -> bool:
    """A report needs two rows; reads no more than that."""
    return df.limit(least).count() >= least
