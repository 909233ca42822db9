"""Targets, merged results, playback scripts, configuration, page scripts and directories."""

from __future__ import annotations

import zipfile
from dataclasses import dataclass, field, fields
from pathlib import Path
from xml.etree import ElementTree

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import REQUEST_LOG


def targets(spark: SparkSession, target: str | None = None, file: str | None = None) -> DataFrame:
    """pos and target: the one given, then the file's lines that aren't empty, in order; neither trimmed nor distinct."""
    one = spark.createDataFrame([(-1, target)] if target else [], "pos bigint, target string")
    if not file:
        return one
    lines = spark.read.text(file, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "target")).where("target <> ''")
    return one.unionByName(lines.withColumn("pos", F.col("pos").cast("bigint")))


def request_log(spark: SparkSession, path: str) -> DataFrame:
    """A written log: JSON lines, or Parquet by its name."""
    reader = spark.read.schema(REQUEST_LOG)
    return reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.json(path)


def merged_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array written before; a malformed one is an error."""
    return spark.read.schema(REQUEST_LOG).option("multiLine", True).option("mode", "FAILFAST").json(path)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def xlsx_rows(path: str) -> list[list[str]]:
    """Cells of the first sheet, with inline or shared strings."""
    with zipfile.ZipFile(path) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        rows = []
        for row in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{{{_NS['m']}}}row"):
            cells = []
            for c in row.findall("m:c", _NS):
                if c.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")))
                else:
                    v = c.find("m:v", _NS)
                    text = "" if v is None else v.text or ""
                    cells.append(shared[int(text)] if c.get("t") == "s" else text)
            rows.append(cells)
        return rows


def xlsx(spark: SparkSession, path: str) -> DataFrame:
    """A report's workbook: the header's columns, all strings."""
    head, *rows = xlsx_rows(path)
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{h}` string" for h in head))


def playback(spark: SparkSession, path: str) -> DataFrame:
    """step_no, xpath, value and action of a YAML script's steps, in order; the matcher isn't used."""
    script = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    steps = [s for group in script.get("steps") or [] for s in group.get("setp") or []]
    rows = [(i, *(None if s.get(k) is None else str(s.get(k)) for k in ("xpath", "value", "action"))) for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, "step_no int, xpath string, value string, action string")


@dataclass
class Config:
    """Explicit settings count before the file's, the file's before these defaults."""

    username: str = "admin"
    password: str = "password"
    email: str = ""
    phone: str = ""
    unheadless: bool = False
    trace: bool = False
    proxy: str = ""
    tab_count: int = 10
    tab_timeout: int = 15
    browser_timeout: int = 600
    max_depth: int = 5
    slow: float = 1000.0
    filter: list[str] = field(default_factory=lambda: ["lougout", "登出", "reset"])
    format: str = "txt,json"
    outputdir: str = ""
    save: str = ""
    mergedoutput: str = ""
    norrs: bool = False
    quiet: bool = False


def config(paths: list[str] | None = None, **explicit) -> Config:
    """The first file that exists; none is written where none does."""
    names = {f.name for f in fields(Config)}
    found: dict = {}
    for p in paths or ["configs/config.yml", "config.yml"]:
        if Path(p).is_file():
            for section in (yaml.safe_load(Path(p).read_text(encoding="utf-8")) or {}).values():
                if isinstance(section, dict):
                    found |= {k.replace("tabcount", "tab_count"): v for k, v in section.items() if v is not None}
            break
    merged = found | {k: v for k, v in explicit.items() if v is not None}
    return Config(**{k: v for k, v in merged.items() if k in names})


def scripts(spark: SparkSession, path: str) -> DataFrame:
    """name (without suffix), stage (the folder) and content of every page script below path."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.js").text(path, wholetext=True).withColumn("file", F.input_file_name())
    return raw.select(F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("name"), F.regexp_extract("file", "([^/]*)/[^/]*$", 1).alias("stage"), F.col("value").alias("content"))


def directories(path: str) -> list[str]:
    """path and all folders below it."""
    return sorted([str(path), *(str(p) for p in Path(path).rglob("*") if p.is_dir())])


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member and content of the files in all zip and tar.gz files below path."""
    import io
    import tarfile

    import pandas as pd

    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                if name.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(name, i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
                else:
                    with tarfile.open(fileobj=io.BytesIO(content)) as t:
                        rows = [(name, m.name, t.extractfile(m).read()) for m in t if m.isfile()]
                yield pd.DataFrame(rows, columns=["archive", "member", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{zip,tar.gz,tgz}").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, content binary")
