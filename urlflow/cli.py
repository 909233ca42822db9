"""Command line: a request log (or pages) in, a crawl's reports out."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.url import host
from .operators.dedup import first_wins
from .operators.filters import request_results
from .session import session
from .sinks.files import save, write_stdout
from .sinks.render import without_bodies
from .sources.files import config, request_log, targets


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("urlflow", description="Distinct results of each target, from a recorded request log.")
    p.add_argument("log", help="request log: a folder of JSON lines, or .parquet")
    p.add_argument("-t", "--target")
    p.add_argument("-f", "--targetsfile")
    p.add_argument("--config", action="append")
    for name in ("format", "outputdir", "save", "mergedoutput"):
        p.add_argument(f"--{name}")
    p.add_argument("--norrs", action="store_true", default=None)
    p.add_argument("--quiet", action="store_true", default=None)
    p.add_argument("--master")
    return p


def results(log: DataFrame, target_host: str) -> DataFrame:
    """A target's distinct results; arrival order is the log's order."""
    kept = request_results(log, target_host).withColumn("__seq", F.monotonically_increasing_id())
    return first_wins(kept, "__seq", "URL", "Method").drop("__seq", "fp")


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    c = config(args.config, format=args.format, outputdir=args.outputdir, save=args.save, mergedoutput=args.mergedoutput, norrs=args.norrs, quiet=args.quiet)
    log, made = request_log(spark, args.log), []
    date = f"{datetime.now():%Y-%m-%d %H:%M:%S}"
    for row in targets(spark, args.target, args.targetsfile).select(host(F.col("target")).alias("host")).toLocalIterator():
        out = results(log, row["host"])
        out = without_bodies(out) if c.norrs else out
        if c.quiet:
            write_stdout(out)
        made += save(out, row["host"], c.format, c.outputdir, c.save, c.mergedoutput, date)
    return made


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session(args.master)
    for path in run(spark, args):
        print(path)


if __name__ == "__main__":
    main()
