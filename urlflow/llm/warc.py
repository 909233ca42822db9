"""WARC archives: reading, revisit resolution by payload digest, deduplicated writing.

Only headers are shuffled by digest: each digest's first response is its original, and
every other record of the digest is joined to it. The list of responses that change
(later copies) is joined back to the payloads, by broadcast while it is short, so that
payloads stay where they were read; revisits have none and are joined to their originals
directly. Archives are written by task, a gzip member a record, under another name first
and renamed when complete: a task that runs again replaces its file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import narrow, new_path, small, stage_table, trim

RECORD = {"record_id": "string", "type": "string", "uri": "string", "date": "string", "digest": "string", "refers_to": "string", "refers_to_uri": "string", "refers_to_date": "string", "source_id": "string", "http": "binary", "payload": "binary"}
_FIELDS = {"WARC-Record-ID": "record_id", "WARC-Type": "type", "WARC-Target-URI": "uri", "WARC-Date": "date", "WARC-Payload-Digest": "digest", "WARC-Refers-To": "refers_to", "WARC-Refers-To-Target-URI": "refers_to_uri", "WARC-Refers-To-Date": "refers_to_date", "WARC-Source-Record-ID": "source_id"}
_NAMES = {k.lower(): v for k, v in _FIELDS.items()}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DDL = ", ".join(f"{c} {k}" for c, k in RECORD.items())
#: What tells records apart.
_SAME = ("record_id", "uri", "date", "type", "digest")
_GZIP = b"\x1f\x8b"
LEVEL = 1


def digest(payload: Column) -> Column:
    """Of the payload's bytes; a null payload's is that of no bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(payload, F.lit(b"")), 256))


def page_records(pages: DataFrame, revisits: bool = False) -> DataFrame:
    """Pages as response records, a second of archive time apart by page_id; with `revisits`, each as a revisit record of a day later too.

    A null page_id is as 0 in time, a null url or html counts as empty; copies of a row
    are copies of a record, rows that differ in html alone are records of their own.
    """
    p = narrow(pages, {"page_id": "bigint", "url": "string", "html": "string"}).fillna({"url": "", "html": ""})
    body = F.encode("html", "UTF-8")
    http = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html"), F.lit("\r\n\r\n")), "UTF-8")
    none = F.lit(None).cast("string")

    def records(kind: str, after: int, payload: Column) -> DataFrame:
        date = F.date_format(F.timestamp_seconds(F.lit(1_577_836_800 + after) + F.greatest("page_id", F.lit(0))).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), digest(body), F.lit(">"))
        values = [name, F.lit(kind), F.col("url"), date, digest(body), none, none, none, none, http, payload]
        return p.select(*[v.alias(c) for c, v in zip(RECORD, values, strict=True)])

    got = records("response", 0, body)
    return got.unionByName(records("revisit", 86_400, F.lit(None).cast("binary"))) if revisits else got


def originals(headers: DataFrame) -> DataFrame:
    """Each digest's first response: least date, then record_id, then uri."""
    first = F.min(F.struct("date", "record_id", "uri"))
    return headers.where("type = 'response' AND digest IS NOT NULL").groupBy("digest").agg(first.alias("first"))


def later(headers: DataFrame) -> DataFrame:
    """The responses that aren't their digest's original: record_id, uri, date, digest, type and the original's first (date, record_id, uri)."""
    rest = headers.where("type = 'response'").select(*_SAME)
    same = F.struct("date", "record_id", "uri").eqNullSafe(F.col("first"))
    return rest.join(originals(headers), "digest").where(~same)


def _key(*columns: Column) -> Column:
    """A record's key from what tells it apart; nulls are told from other values and from each other by place."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for c, n in zip(columns, _SAME, strict=True)])), 256)


def _uuid(key: Column) -> Column:
    cut = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def deduplicate(records: DataFrame) -> DataFrame:
    """Records with fresh ids: one response a digest, revisits that name it for all others.

    A revisit with an original refers to it, whatever it referred to before; one without
    stays as it is. Records that are alike in id, uri, date, type and digest are the same
    record: the one with the least other headers and content stays. Other types pass
    unchanged but for the id. Records without a digest get that of their payload. The
    old id stays in source_id. Extra columns are dropped.
    """
    r = narrow(records, RECORD).withColumn("digest", F.coalesce("digest", digest(F.col("payload"))))
    r = r.withColumn("__key", _key(*map(F.col, _SAME)))
    headers = r.drop("http", "payload")
    twice = stage_table(headers.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key", F.lit(True).alias("__twice")), "twice")
    if not twice.isEmpty():
        marked = r.join(small(twice), "__key", "left")
        rest = F.struct("refers_to", "refers_to_uri", "refers_to_date", "source_id", "http", "payload")
        one = marked.where("__twice").groupBy("__key").agg(F.min(F.struct(rest.alias("rest"), *[c for c in RECORD if c in _SAME])).alias("x"))
        one = one.select("__key", "x.rest.*", *[f"x.{c}" for c in RECORD if c in _SAME])
        r = marked.where("__twice IS NULL").drop("__twice").unionByName(one)
    changes = stage_table(later(headers).select(_key(*map(F.col, _SAME)).alias("__key"), F.col("first").alias("__first")).dropDuplicates(["__key"]), "later")
    whole = r.where("type IS NULL OR type <> 'revisit'").join(small(changes, 1 << 18), "__key", "left")
    first = originals(headers).toDF("__digest", "__first")
    again = r.where("type = 'revisit'").join(first, F.col("digest") == F.col("__digest"), "left").drop("__digest")
    found = F.col("__first").isNotNull()
    of = F.col("__first")
    out = {
        "record_id": _uuid(F.col("__key")),
        "type": F.when(found, "revisit").otherwise(F.col("type")),
        "refers_to": F.when(found, _uuid(_key(of["record_id"], of["uri"], of["date"], F.lit("response"), F.col("digest")))).otherwise(F.col("refers_to")),
        "refers_to_uri": F.when(found, of["uri"]).otherwise(F.col("refers_to_uri")),
        "refers_to_date": F.when(found, of["date"]).otherwise(F.col("refers_to_date")),
        "source_id": F.col("record_id"),
        "payload": F.when(~found & F.coalesce(F.col("type") != "revisit", F.lit(True)), F.col("payload")),
    }
    return whole.unionByName(again).select(*[out.get(c, F.col(c)).alias(c) for c in RECORD])


def encode_record(r: dict) -> bytes:
    """A record as it stands in an archive, uncompressed, with its length set from its content."""
    head = ["WARC/1.1"]
    for name, c in _FIELDS.items():
        if r[c] is not None:
            head.append(f"{name}: " + r[c].replace("\r", " ").replace("\n", " "))
    if r["type"] == "revisit":
        head.append(f"WARC-Profile: {_PROFILE}")
    block = (r["http"] or b"") + (r["payload"] or b"")
    head.append(f"Content-Type: {'application/http; msgtype=response' if r['http'] else 'application/octet-stream'}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """Writes the records of each partition to one .warc.gz below path; file, records and bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        at, base = fs.FileSystem.from_uri(path)
        at.create_dir(base, recursive=True)
        name = f"{base}/part-{context.partitionId():06d}.warc.gz"
        partial, n, size = f"{name}.{context.taskAttemptId()}.partial", 0, 0
        with at.open_output_stream(partial, compression=None) as out:
            for row in (r for b in batches for i in range(0, b.num_rows, 256) for r in b.slice(i, 256).to_pylist()):
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = z.compress(encode_record(row)) + z.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
        if n:
            at.move(partial, name)
        else:
            at.delete_file(partial)
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

    return narrow(records, RECORD).mapInArrow(run, "file string, records bigint, bytes bigint")


class Damaged(Exception):
    """Bytes that can't be decompressed; reading goes on at the next member."""


class _Members:
    """Bytes of a file of gzip members, or of a plain file, read as asked for. What isn't a member is skipped."""

    def __init__(self, raw):
        self.raw, self.held, self.z, self.rest = raw, BytesIO(), None, b""
        self.plain, self.damaged = None, False

    def _more(self) -> bytes:
        while True:
            data = self.rest or bytes(self.raw.read(1 << 18))
            self.rest = b""
            if not data:
                return b""
            if self.plain is None:
                self.plain = data[:2] != _GZIP
            if self.plain:
                return data
            if self.z is None:
                at = data.find(_GZIP)
                if at:
                    keep = at if at > 0 else len(data) - (data[-1:] == _GZIP[:1])
                    self.damaged |= bool(data[:keep].strip(b"\0"))  # zeros are padding
                    more = b"" if at > 0 else bytes(self.raw.read(1 << 18))
                    self.rest = data[keep:] + more
                    if at < 0 and not more:
                        self.damaged |= bool(self.rest)
                        return b""
                    continue
                self.z = zlib.decompressobj(31)
            try:
                out = self.z.decompress(data)
            except zlib.error:
                self.z, self.rest, self.held = None, data[1:], BytesIO()
                at = self.rest.find(_GZIP)
                self.rest = self.rest[at:] if at >= 0 else self.rest[-1:]
                raise Damaged from None
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, None
            if out:
                return out

    def line(self) -> bytes:
        got = self.held.readline()
        while not got.endswith(b"\n"):
            if not (more := self._more()):
                break
            self.held = BytesIO(more)
            got += self.held.readline()
        return got

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            got = self.held.read(left)
            if not got:
                if not (more := self._more()):
                    break
                self.held = BytesIO(more)
                continue
            parts.append(got)
            left -= len(got)
        return b"".join(parts)


def parse(raw, errors: list[str] | None = None) -> Iterator[dict]:
    """Records of an open archive. Damaged ones and one cut off at the end are left out, and named in errors."""
    m, errors = _Members(raw), [] if errors is None else errors
    while True:
        try:
            if not (line := m.line()):
                break
            if not line.startswith(b"WARC/"):
                continue
            head: dict[str, str] = {}
            while line := m.line():
                if not (text := line.rstrip(b"\r\n")):
                    break
                name, _, value = text.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            n = head.get("content-length", "")
            if not (n.isascii() and n.isdigit()):
                errors.append("no length" if line else "cut off")
                continue
            block = m.take(int(n))
            if len(block) < int(n):
                errors.append("cut off")
                break
        except Damaged:
            errors.append("damaged")
            continue
        r = dict.fromkeys(RECORD)
        r |= {c: head[k] for k, c in _NAMES.items() if k in head}
        http, sep, payload = block.partition(b"\r\n\r\n") if "application/http" in head.get("content-type", "") else (b"", b"", block)
        r["http"], r["payload"] = http + sep, None if r["type"] == "revisit" else payload
        yield r
    if m.damaged:
        errors.append("not a member")


def _archives(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(path)
    return files.where("NOT path LIKE '%.partial'").select("path")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below path; damaged ones are left out (see damage()). A file is read as a stream by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.binary() if k == "binary" else pa.string()) for c, k in RECORD.items()])
        for b in batches:
            for name in b.column("path").to_pylist():
                at, base = fs.FileSystem.from_uri(name)
                rows, held = [], 0
                with at.open_input_stream(base, compression=None) as raw:
                    for r in parse(raw):
                        rows.append(r)
                        held += len(r["payload"] or b"")
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
        trim()

    return _archives(spark, path).mapInArrow(run, _DDL)


def damage(spark: SparkSession, path: str) -> DataFrame:
    """file, records read and errors of every archive below path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("path").to_pylist():
                at, base = fs.FileSystem.from_uri(name)
                errors: list[str] = []
                with at.open_input_stream(base, compression=None) as raw:
                    n = sum(1 for _ in parse(raw, errors))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([len(errors)], pa.int64())], names=["file", "records", "errors"])
        trim()

    return _archives(spark, path).mapInArrow(run, "file string, records bigint, errors bigint")


def rewrite_pages(pages: DataFrame) -> DataFrame:
    """Two captures of every page, the second as revisit records, written as a deduplicated archive and read from it again: page_id, url, date, type, digest, refers_to_uri, refers_to_date and n_bytes of the payload.

    Of rows alike in page_id, url and html one stays in each capture. No pages, no archive and no rows.
    """
    spark, path = pages.sparkSession, new_path(pages.sparkSession, "archives")
    written = stage_table(write_archives(deduplicate(page_records(pages, revisits=True)), path), "archive-index")
    kind = "page_id bigint, url string, date string, type string, digest string, refers_to_uri string, refers_to_date string, n_bytes bigint"
    if not written.where("records > 0").limit(1).count():
        return spark.createDataFrame([], kind)
    page = F.regexp_extract("source_id", "^<urn:page:(-?[0-9]+):", 1).try_cast("bigint")
    return read_archives(spark, path).select(page.alias("page_id"), F.col("uri").alias("url"), "date", "type", "digest", "refers_to_uri", "refers_to_date", F.coalesce(F.octet_length("payload"), F.lit(0)).cast("bigint").alias("n_bytes"))


def oracle() -> str:
    """DuckDB SQL for rewrite_pages()."""
    return """
    WITH r AS (SELECT DISTINCT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, url, html, 'sha256:' || sha256(html) AS digest, make_timestamp(1577836800000000 + greatest(coalesce(page_id, 0), 0) * 1000000) AS captured FROM r),
    n AS (SELECT *, row_number() OVER w AS i, first_value(url) OVER w AS first_url, strftime(first_value(captured) OVER w, '%Y-%m-%dT%H:%M:%SZ') AS first_date FROM d
          WINDOW w AS (PARTITION BY digest ORDER BY captured, '<urn:page:' || coalesce(page_id::VARCHAR, 'none') || ':' || digest || '>', url))
    SELECT page_id, url, strftime(captured, '%Y-%m-%dT%H:%M:%SZ') AS date, CASE WHEN i = 1 THEN 'response' ELSE 'revisit' END AS type, digest,
      CASE WHEN i > 1 THEN first_url END AS refers_to_uri, CASE WHEN i > 1 THEN first_date END AS refers_to_date, CASE WHEN i = 1 THEN CAST(strlen(html) AS BIGINT) ELSE 0 END AS n_bytes
    FROM n
    UNION ALL
    SELECT page_id, url, strftime(captured + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ'), 'revisit', digest, first_url, first_date, 0 FROM n"""
