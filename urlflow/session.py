"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; extra settings have underscores for dots."""
    b = SparkSession.builder.appName("urlflow").config(map=SETTINGS)
    if master:
        b = b.master(master)
    for k, v in extra.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()
