"""The crawl's stream: request logs arrive as files and leave as distinct results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.url import fingerprint, is_static, without_fragment
from ..sinks.render import json_line
from ..storage import new_path


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int = 100) -> DataFrame:
    """`files` a trigger at most: back pressure by batch size."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(path)


def distinct_requests(stream: DataFrame, url: str = "url", method: str = "method", time: str | None = None, within: str | None = None) -> DataFrame:
    """With fp, once for each fingerprint.

    State is kept by fingerprint: for ever, or with `time` and `within` only as long as
    the watermark asks. A time without zone is read in the session's zone.
    """
    keyed = stream.where(~is_static(without_fragment(F.col(url)))).withColumn("fp", fingerprint(F.col(url), F.col(method))).where("fp IS NOT NULL")
    if time is None:
        return keyed.dropDuplicates(["fp"])
    return keyed.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within).dropDuplicatesWithinWatermark(["fp"])


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Processes all there is and returns what was written."""
    spark = stream.sparkSession
    out = new_path(spark, name)
    query = stream.writeStream.format("parquet").option("checkpointLocation", new_path(spark, f"{name}-state")).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_quiet(stream: DataFrame, out=print) -> StreamingQuery:
    """Every result as a line of JSON as soon as it arrives."""
    lines = stream.select(json_line(*stream.columns).alias("line"))

    def each(batch: DataFrame, _: int) -> None:
        for r in batch.toLocalIterator():
            out(r["line"])

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", new_path(stream.sparkSession, "quiet-state")).trigger(availableNow=True).start()
