import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from urlflow.schemas import REQUEST_LOG
from urlflow.sinks import files as sinks
from urlflow.sources import files, metadata
from urlflow.streaming import pipeline

ROBOTS = "User-agent: *\nDisallow: /one/known.txt\n\nUser-agent: x\nALLOW: two/\n# Allow: /random/\nDisallow:/nospace\nDisallow: /f#frag\nAllow: #only\nSitemap: https://s.example/sitemap.xml"


def test_robots(spark):
    df = spark.createDataFrame([("http://local.example/robots.txt", ROBOTS), ("http://e/robots.txt", ""), ("http://n/robots.txt", None)], "url string, body string")
    got = [r.rule for r in metadata.robots_rules(df).orderBy("line_no").collect()]
    assert got == ["http://local.example/one/known.txt", "http://local.example/two/", "http://local.example/f", "http://local.example/"]


def test_sitemap(spark):
    body = '<sitemapindex xmlns="urn:site-map"><sitemap><loc>\n\t http://s.example/found.xml \n</loc><lastmod>2020-01-01</lastmod></sitemap><url><loc>http://s.example/p</loc></url></sitemapindex>'
    df = spark.createDataFrame([("u", body), ("v", "<broken"), ("w", None)], "url string, body string")
    assert [(r.url, r.loc) for r in metadata.sitemap_urls(df).orderBy("pos").collect()] == [("u", "http://s.example/p"), ("u", "http://s.example/found.xml")]
    assert metadata.metadata(df.limit(0), df).count() == 2


def log(spark, n=3):
    rows = [(f"http://h/{i}?a=<b>&c", "GET", "h", {"A": ["1", "2"]}, f"d{i}", 200, {}, "", "") for i in range(n)]
    return spark.createDataFrame(rows, REQUEST_LOG)


def test_save_and_merge(spark, tmp_path):
    df = log(spark)
    assert sinks.save(log(spark, 1), "h", "txt", str(tmp_path)) == []
    made = sinks.save(df, "h", "txt,json,xlsx,html,odd", str(tmp_path), "out", date="2024-01-01 00:00:00")
    assert [p.rsplit(".", 1)[1] for p in made] == ["txt", "json", "xlsx", "html"]
    assert (tmp_path / "out.txt").read_text() == "".join(f"[GET]http://h/{i}?a=<b>&c\n" for i in range(3))
    raw = (tmp_path / "out.json").read_text()
    assert "\\u003cb\\u003e\\u0026" in raw and raw.startswith('[\n    {\n        "URL"')
    assert json.loads(raw)[1]["Headers"] == {"A": ["1", "2"]}
    assert files.merged_json(spark, str(tmp_path / "out.json")).collect() == df.collect()
    assert files.xlsx(spark, str(tmp_path / "out.xlsx")).count() == 3
    page = (tmp_path / "out.html").read_text()
    assert "count: 3" in page and "&lt;b&gt;" in page and "<b>" not in page
    for _ in range(2):
        sinks.save(df, "h", "txt,json,xlsx,html", merged=str(tmp_path / "all"))
    assert len((tmp_path / "all.txt").read_text().splitlines()) == 6
    assert len(json.loads((tmp_path / "all.json").read_text())) == 6
    assert len(files.xlsx_rows(str(tmp_path / "all.xlsx"))) == 7
    assert sinks.save(df, "h", "txt", merged=str(tmp_path / "one.json")) == [str(tmp_path / "one.json")]


def test_malformed_merge_target_stays(spark, tmp_path):
    (tmp_path / "m.json").write_text("{nope")
    with pytest.raises(ValueError):
        sinks.write_json(log(spark), str(tmp_path / "m.json"), append=True)
    assert (tmp_path / "m.json").read_text() == "{nope"


def test_stdout(spark):
    out = []
    sinks.write_stdout(log(spark, 2).select("URL", "Status"), out.append)
    assert [json.loads(x)["Status"] for x in out] == [200, 200]


def test_targets(spark, tmp_path):
    (tmp_path / "t.txt").write_text("http://a\n\n http://b \nhttp://a\n")
    assert [r.target for r in files.targets(spark, "http://z", str(tmp_path / "t.txt")).orderBy("pos").collect()] == ["http://z", "http://a", " http://b ", "http://a"]
    assert files.targets(spark).count() == 0


def test_playback_and_config(spark, tmp_path):
    (tmp_path / "p.yml").write_text("id: x\nsteps:\n  - setp:\n      - {xpath: //a, value: admin, action: input}\n      - {xpath: //b, action: click}\n")
    assert [tuple(r) for r in files.playback(spark, str(tmp_path / "p.yml")).collect()] == [(0, "//a", "admin", "input"), (1, "//b", None, "click")]
    (tmp_path / "c.yml").write_text("browser:\n  max_depth: 9\n  tab_count: 3\nlogin:\n  username: me\n")
    c = files.config([str(tmp_path / "none.yml"), str(tmp_path / "c.yml")], tab_count=7)
    assert (c.max_depth, c.tab_count, c.username, c.tab_timeout) == (9, 7, "me", 15)
    assert files.config([]).max_depth == 5


def test_archives_scripts_and_folders(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/y.txt", "hi")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        i = tarfile.TarInfo("z.txt")
        i.size = 2
        t.addfile(i, io.BytesIO(b"yo"))
    assert {(r.member, bytes(r.content)) for r in files.archive_members(spark, str(tmp_path)).collect()} == {("x/y.txt", b"hi"), ("z.txt", b"yo")}
    (tmp_path / "after").mkdir()
    (tmp_path / "after" / "hook.js").write_text("var a;")
    assert [tuple(r) for r in files.scripts(spark, str(tmp_path)).collect()] == [("hook", "after", "var a;")]
    assert files.directories(str(tmp_path)) == [str(tmp_path), str(tmp_path / "after")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"http://h/{i % 4}x", "GET") for i in range(20)] + [(99, "http://h/a.png", "GET")]
    df = spark.createDataFrame(rows, "page_id long, url string, method string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    s = pipeline.read_stream(spark, str(tmp_path / "in"), df.schema, files=1)
    got = pipeline.run_to_table(pipeline.distinct_requests(s).select("fp"), "t")
    assert got.count() == got.distinct().count() == 1
    timed = pipeline.read_stream(spark, str(tmp_path / "in"), df.schema).withColumn("ts", F.timestamp_seconds("page_id").cast("timestamp_ntz"))
    assert pipeline.run_to_table(pipeline.distinct_requests(timed, time="ts", within="1 hour").select("fp"), "t2").count() == 1
    out = []
    pipeline.run_quiet(pipeline.read_stream(spark, str(tmp_path / "in"), df.schema), out.append).awaitTermination()
    assert len(out) == 21


def test_command_line(spark, tmp_path):
    from urlflow import cli

    df = log(spark, 4).unionByName(log(spark, 2)).withColumn("URL", F.concat(F.lit("http://h/a"), F.when(F.col("Data") == "d0", "1").otherwise("2"), F.lit("x")))
    df.write.json(str(tmp_path / "log"))
    (tmp_path / "t.txt").write_text("http://h/\nhttp://none/\n")
    args = cli.parser().parse_args([str(tmp_path / "log"), "-f", str(tmp_path / "t.txt"), "--outputdir", str(tmp_path / "out"), "--format", "txt,json", "--norrs"])
    made = cli.run(spark, args)
    assert made == []  # both URLs have one fingerprint: too few rows for a report
    df.withColumn("URL", F.concat(F.lit("http://h/"), F.when(F.col("Data") == "d0", "p").otherwise("q"))).write.mode("overwrite").json(str(tmp_path / "log"))
    assert [p.rsplit("/", 1)[1] for p in cli.run(spark, args)] == ["h.txt", "h.json"]
    assert "ResponseBody" not in json.loads((tmp_path / "out" / "h.json").read_text())[0]


def test_array_elements_are_read_one_at_a_time(tmp_path):
    path = str(tmp_path / "a.json")
    for held in ([], [{"a": 1}], [{"a": [1, {"b": "x]},"}]}, 2, "s" * 3_000_000, None, 12345] * 3):
        for indent in (None, 4):
            (tmp_path / "a.json").write_text(json.dumps(held, indent=indent) + "\n", encoding="utf-8")
            assert list(sinks._elements(path)) == held
    for bad in ("", "{}", "[1", "[1 2]", "[1,]", "[,1]", "[1] x", "[tru]"):
        (tmp_path / "a.json").write_text(bad)
        with pytest.raises(ValueError):
            list(sinks._elements(path))


def test_unknown_formats_are_logged(spark, tmp_path, caplog):
    assert [p.rsplit(".", 1)[1] for p in sinks.save(log(spark), "h", "odd,txt", str(tmp_path))] == ["txt"]
    assert "odd" in caplog.text


def test_large_hosts_have_chunks(spark):
    from urlflow.sinks.render import envelope

    df = spark.range(250).selectExpr("id", "IF(id % 5 = 0, NULL, 'h') AS host", "concat('u', id) AS url")
    got = envelope(df.select("id", "url", "host"), F.col("host"), "id", most=60).collect()
    assert {r.host: r["count"] for r in got} == {"h": 200, None: 50}
    assert sorted(x.id for r in got for x in r.results) == list(range(250)) and len({(r.host, r.chunk) for r in got}) == len(got) == 5
    assert all([x.id for x in r.results] == sorted(x.id for x in r.results) for r in got)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from urlflow.storage import shared_dir

    off = lambda at: N(conf=N(get=lambda *_: at), sparkContext=N(master="yarn", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False)))))
    assert shared_dir(off("hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(RuntimeError):
        shared_dir(off(None))


def test_report_envelope_has_one_row_a_host(spark, tmp_path):
    from urlflow.plans.catalog import QUERIES

    spark.range(10_050).selectExpr("id AS page_id", "concat('http://h.com/', id) AS url", "'' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    (row,) = QUERIES["report_envelope"](spark, str(tmp_path)).collect()
    assert tuple(row) == ("h.com", 10_050, 0, ",".join(f"{i} http://h.com/{i}" for i in range(10_050)))
