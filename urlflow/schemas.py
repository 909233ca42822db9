"""Record layouts. Absent strings are '', absent numbers 0."""

from __future__ import annotations

from pyspark.sql import types as T

_HEADERS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

#: One observed HTTP exchange.
REQUEST_LOG = T.StructType(
    [
        T.StructField("URL", T.StringType()),
        T.StructField("Method", T.StringType()),
        T.StructField("Host", T.StringType()),
        T.StructField("Headers", _HEADERS),
        T.StructField("Data", T.StringType()),
        T.StructField("Status", T.IntegerType()),
        T.StructField("ResponseHeaders", _HEADERS),
        T.StructField("ResponseBody", T.StringType()),
        T.StructField("RequestStr", T.StringType()),
    ]
)

#: One URL that waits to be opened.
FRONTIER = T.StructType([T.StructField(n, T.IntegerType() if n == "Depth" else T.StringType()) for n in ("Url", "SourceType", "Match", "SourceUrl", "Depth")])

PAGES = "page_id bigint, url string, html string"
