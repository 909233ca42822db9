from pyspark.sql import functions as F

from urlflow.operators import classify, dedup, filters, frontier, similarity


def test_first_wins(spark):
    df = spark.createDataFrame([(3, "http://h/p/1", "GET"), (1, "http://h/p/2#x", "POST"), (2, "http://h/a.png", "GET"), (4, None, "GET"), (5, "http://h/%zz", "GET")], "seq int, url string, method string")
    assert [(r.seq, r.url) for r in dedup.first_wins(df, "seq").collect()] == [(1, "http://h/p/2#x")]
    assert {r.seq for r in dedup.bad_urls(df).collect()} == {4, 5}
    assert dedup.first_wins(df.limit(0), "seq").count() == 0


def test_first_wins_plans_one_exchange(spark):
    df = spark.createDataFrame([(1, "http://h/", "GET")], "seq int, url string, method string")
    plan = dedup.first_wins(df, "seq")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_frontier_with_cycles_and_several_seeds(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "c"), (None, "q"), ("d", None)], "src string, dst string")
    s = spark.createDataFrame([("a",), ("x",), ("a",), (None,)], "url string")
    assert {(r.url, r.depth) for r in frontier.expand(s, e, 5).collect()} == {("a", 0), ("x", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {r.url for r in frontier.expand(s, e, 0).collect()} == {"a", "x"}
    assert frontier.expand(s.limit(0), e).count() == 0


def test_cosine(spark):
    def long(name, d):
        return spark.createDataFrame([(k, t, n) for k, v in d.items() for t, n in v.items()], f"{name} int, term string, tf long")

    a, b = long("a", {1: {"x": 1, "y": 2}, 2: {"x": 1}}), long("b", {7: {"x": 1, "y": 2}, 8: {"z": 5}})
    pairs = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (3, 7)], "a int, b int")
    assert {(r.a, r.b): r.cos for r in similarity.cosine(pairs, a, b).collect()} == {(1, 7): 1.0, (1, 8): 0.0, (2, 7): 0.447214, (3, 7): 0.0}


def test_soft_404(spark):
    p = spark.createDataFrame([(1, "g", "<p>gone</p>"), (2, "g", "<b>Gone </b>"), (3, "g", "<p>other</p>")], "page_id long, host string, html string")
    assert {r.a for r in similarity.soft_404(p, F.col("host")).collect()} == {1, 2}


def test_login_fields(spark):
    html = '<input type="text" placeholder="User name" name="u"><input type="email" placeholder=""><input type="password" placeholder="密码 password"><input type="text"><input placeholder="user"><button type="submit">x</button><button type="button">Login 登录</button><button>login</button>'
    p = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = sorted((r.role, r.pos, r.keyword) for r in classify.login_inputs(classify.inputs(p)).collect())
    assert got == [("email", 1, ""), ("password", 2, "password"), ("password", 2, "密码"), ("username", 0, "name"), ("username", 0, "user")]
    assert sorted((r.pos, r.keyword) for r in classify.submit_buttons(p).collect()) == [(0, ""), (1, "login"), (1, "登录")]


def test_status_and_types(spark):
    df = spark.createDataFrame([(s,) for s in (200, 302, 500, 401, 403, 404, 503, 504, None)], "s int")
    assert [r[0] for r in df.select(filters.is_reachable(F.col("s"))).collect()] == [True] * 3 + [False] * 6
    kinds = spark.createDataFrame([("Font",), ("Image",), ("Script",), (None,)], "rtype string")
    assert [r[0] for r in filters.loaded_types(kinds).collect()] == ["Script", None]


def test_request_results(spark):
    import base64

    def b(x):
        return base64.b64encode(x.encode()).decode()

    rows = [("http://h/a", "POST", "d", 200, b("ok")), ("http://h/b", "GET", "d", 200, b("Not Found")), ("http://h/c", "GET", "d", 404, b("ok")), ("http://x/?u=h", "GET", "d", 200, b("ok")), ("http://h/p", "GET", "", 200, b("ok")), ("http://h/s", "GET", "", 200, b("ok")), ("http://h/g", "GET", "d", 200, None)]
    log = spark.createDataFrame(rows, "URL string, Method string, Data string, Status int, ResponseBody string")
    soft = spark.createDataFrame([("http://h/s",)], "url string")
    assert sorted((r.URL, r.Data) for r in filters.request_results(log, "h", soft, "http://h/p").collect()) == [("http://h/a", "d"), ("http://h/g", "")]
    assert not filters.enough_rows(log.limit(1)) and filters.enough_rows(log)


def test_frontier_seeds(spark):
    t = spark.createDataFrame([("http://h/",)], "url string")
    m = spark.createDataFrame([("http://h/", "http://h/r")], "target string, url string")
    got = {r.SourceType: r for r in frontier.seeds(t, m).collect()}
    assert set(got) == {"homePage", "404", "metadata parse"} and all(r.Depth == 0 for r in got.values())
    assert got["404"].Url.startswith("http://h/") and len(got["404"].Url) == 19


def test_terms_of_a_batch_are_made_in_slices(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from urlflow.functions import html

    monkeypatch.setattr(html, "page_terms", lambda x: None if x is None else [f"{x[:9]}{k}" for k in range(300)])
    pages = pa.array([f"{i:09}" + "x" * 5000 for i in range(1500)] + [None])
    tracemalloc.start()
    got = html.vector_terms.func(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1501 and got[1499].as_py() == [f"000001499{k}" for k in range(300)] and got[1500].as_py() is None
    assert peak < 12_000_000  # the lists of all pages are some 30 MB
