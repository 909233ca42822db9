"""robots.txt and site maps, as tables of (url, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import absolute_url, host, scheme

_SITEMAP = "url array<struct<loc string>>, sitemap array<struct<loc string>>"


def robots_rules(files: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """url and rule (absolute) of every Allow and Disallow, in order, duplicates kept."""
    lines = files.select(url, F.posexplode(F.split(body, "\r?\n")).alias("line_no", "line"))
    name, value = F.lower(F.substring_index("line", ": ", 1)), F.trim(F.expr("substring(line, instr(line, ': ') + 2)"))
    kept = lines.where(F.col("line").contains(": ")).withColumn("name", name).withColumn("value", absolute_url(value))
    kept = kept.where(F.col("name").startswith("allow") | (F.col("name") == "disallow"))
    root = F.concat(scheme(F.col(url)), F.lit("://"), host(F.col(url)))
    rule = F.concat(root, F.when(F.col("value").startswith("/"), "").otherwise("/"), F.col("value"))
    return kept.select(url, "line_no", rule.alias("rule"))


def sitemap_urls(files: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """url, pos and loc of every location: pages first, then nested maps. Malformed files give none."""
    parsed = F.from_xml(F.col(body), _SITEMAP, {"mode": "PERMISSIVE"})
    one = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: F.regexp_replace(x["loc"], "^[ \t\r\n]+|[ \t\r\n]+$", ""))
    both = F.filter(F.concat(one(parsed["url"]), one(parsed["sitemap"])), lambda x: x.isNotNull())
    return files.select(url, F.posexplode(both).alias("pos", "loc"))


def metadata(robots: DataFrame, sitemaps: DataFrame, url: str = "url") -> DataFrame:
    """Rules, then locations, of each site; duplicates kept."""
    return robots_rules(robots, url).select(F.col(url).alias("target"), F.col("rule").alias("url")).union(sitemap_urls(sitemaps, url).select(F.col(url), "loc"))


def fetched(log: DataFrame, name: str) -> DataFrame:
    """url and body of a log's exchanges for a file at the host's root that were answered with 200."""
    body: Column = F.decode(F.unbase64("ResponseBody"), "UTF-8")
    return log.where((F.col("Status") == 200) & F.col("URL").rlike(rf"^https?://[^/]+/{name.replace('.', '[.]')}$")).select(F.col("URL").alias("url"), body.alias("body"))
