"""Depth-bounded expansion of a link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage

MAX_DEPTH = 5


def expand(seeds: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """url and depth, the least number of links from a seed, of all within max_depth. seeds(url), edges(src, dst).

    A level a round: children of the last level that no level holds. Each level is
    written to the shared folder, so plans stay short and lost executors cost nothing;
    only the last level is expanded, and the levels read for the anti-join are columns of URLs.
    """
    level = stage(seeds.select("url").where("url IS NOT NULL").distinct(), "frontier")
    seen, out = level, level.withColumn("depth", F.lit(0))
    links = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    for depth in range(1, max_depth + 1):
        children = level.join(links, level["url"] == links["src"]).select(F.col("dst").alias("url")).distinct()
        level = stage(children.join(seen, "url", "left_anti"), "frontier")
        if level.isEmpty():
            break
        seen = seen.union(level)
        out = out.union(level.withColumn("depth", F.lit(depth)))
    return out


def seeds(targets: DataFrame, metadata: DataFrame, probe_token: str = "urlflow") -> DataFrame:
    """Frontier rows of depth 0: URLs from robots and site maps, home pages, and a URL that can't exist for each target. targets(url), metadata(target, url)."""
    from ..functions.text import probe_token as token

    row = lambda url, kind, source: [url.alias("Url"), F.lit(kind).alias("SourceType"), F.lit("").alias("Match"), source.alias("SourceUrl"), F.lit(0).alias("Depth")]
    found = metadata.select(*row(F.col("url"), "metadata parse", F.col("target")))
    home = targets.select(*row(F.col("url"), "homePage", F.col("url")))
    probe = targets.select(*row(F.concat(F.regexp_replace("url", "/*$", ""), F.lit("/"), token(probe_token, F.col("url"))), "404", F.col("url")))
    return found.unionByName(home).unionByName(probe)


def dispatch(rows: DataFrame, host: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Frontier rows that are given to a tab: in scope and on the host, within the depth. rows: Url, Depth and others."""
    from .filters import in_frontier_scope

    url = F.col("Url")
    return rows.where(in_frontier_scope(url, F.lit(host)) & url.contains(host) & (F.col("Depth") <= max_depth))


def admit(found: DataFrame, visited: DataFrame, host: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Frontier rows that are opened: in scope, not static, within the depth, on the host, and the first of a fingerprint that `visited`(fp) lacks. found: Url, Depth and others."""
    from .dedup import first_wins
    from .filters import unvisited, without_static

    kept = without_static(dispatch(found, host, max_depth), "Url", frontier=True)
    fresh = unvisited(kept, visited, "Url").withColumn("__m", F.lit("GET"))
    return first_wins(fresh, "Depth", "Url", "__m").drop("__m", "fp")
