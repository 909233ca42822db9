import random
import time

import pytest
from pyspark.sql import functions as F

from urlflow.functions import html, mining, text, url
from urlflow.functions.stem import stem


def one(spark, values, f, schema="x string"):
    rows = [(v,) if not isinstance(v, tuple) else v for v in values]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.select("i", f.alias("y")).orderBy("i").select("y").collect()]


KEYS = [
    ("GET", "http://h/page/1", "|http://h/page/@"),
    ("POST", "http://h/page/2?x=9", "|http://h/page/@"),
    ("GET", "http://h/page/1/", "GET|h/page/number/"),
    ("GET", "http://h/a?name=x&id=5", "GET|h/a/id=@name=$"),
    ("GET", "http://h/a", "GET|h/a/"),
    ("GET", "http://H/a/", "GET|h/a/"),
    ("GET", "http://h", "GET|h"),
    ("GET", "http://h/", "GET|h/"),
    ("POST", "http://h/item12/view", "POST|h/itemnumber/view/"),
    ("GET", "http://h/?a=1&a=b", "GET|h/a=@a=$"),
    ("GET", "http://h/?id=-5", "GET|h/id=@"),
    ("GET", "http://h/?id=5.0", "GET|h/id=$"),
    ("GET", "HTTP://user:pw@H:8080/7", "|http://H:8080/@"),
    ("GET", "http://h/x?a=1;b=2&c=%zz&d=%31", "GET|h/x/d=@"),
    ("GET", "http://h/x?q=99999999999999999999", "GET|h/x/q=$"),
    ("GET", "http://h/x?q=+5&r=%2B5", "GET|h/x/q=$r=@"),
    ("GET", "http://h/x#frag#2", "GET|h/x/"),
    ("GET", "http://h/%zz", None),
    ("GET", "http://h/a\x01", None),
    ("GET", None, None),
    ("GET", "", "GET|"),
]


def test_fingerprint_keys(spark):
    got = one(spark, [(m, u) for m, u, _ in KEYS], url.fingerprint_key(F.col("u"), F.col("m")), "m string, u string")
    assert got == [k for _, _, k in KEYS]


def test_fingerprint_doesnt_depend_on_parameter_order_digits_or_a_last_slash(spark):
    rng, cases = random.Random(1), []
    for _ in range(60):
        names = rng.sample("abcdefgh", rng.randint(0, 4))
        pairs = [f"{n}={rng.choice(['1', 'x', ''])}" for n in names]
        path = "/" + "/".join(rng.choice(["a", "b7c", "d"]) for _ in range(rng.randint(1, 3)))
        first = f"http://h{path}" + ("?" + "&".join(pairs) if pairs else "")
        rng.shuffle(pairs)
        cases.append((first, f"http://h{path.replace('7', '123')}/" + ("?" + "&".join(pairs) if pairs else "")))
    get = F.lit("GET")
    same = one(spark, cases, url.fingerprint(F.col("a"), get) == url.fingerprint(F.col("b"), get), "a string, b string")
    assert all(same)


RESOLVED = [
    ("go.php?a=ok&b=12", "http://site.example/dir/?b=12", "http://site.example/dir/go.php?a=ok&b=12"),
    ("/x", "http://h/a/", "http://h/x"),
    ("x", "http://h/page", "http://h/pagex"),
    ("x", "http://h/a/i.php", "http://h/a/x"),
    ("x", "http://h/a/i.aspx", "http://h/a/i.aspxx"),
    ("app.js", "http://h/a/", "http://happ.js"),
    ("//c/x", "https://h/", "https://c/x"),
    ("../x", "http://h/a/b/", "http://h/a/b/../x"),
    ("r?u=http://z", "http://h/", ""),
    ("x.html", "http://a.b.c.d/", "http://x.html"),
    ("https://z/1", "http://h/", "https://z/1"),
    ("", "http://h/", ""),
    ("%zz", "http://h/", "http://%zz"),
]


def test_resolution(spark):
    got = one(spark, [(r, c) for r, c, _ in RESOLVED], url.resolve(F.col("r"), F.col("c")), "r string, c string")
    assert got == [x for *_, x in RESOLVED]
    assert [html.resolve(r, c) for r, c, _ in RESOLVED] == got


def test_resolve_all_keeps_the_first_of_each(spark):
    df = spark.createDataFrame([(["/a", "", "/a", "b", "/a"], "http://h/")], "r array<string>, c string")
    assert df.select(url.resolve_all(F.col("r"), F.col("c"))).first()[0] == ["http://h/a", "http://h/b"]


def test_rfc_resolution(spark):
    assert one(spark, [("../x", "http://h/a/b/"), (None, "http://h")], html.resolve_rfc3986(F.col("r"), F.col("c")), "r string, c string") == ["http://h/a/x", None]


def test_static_suffixes(spark):
    assert len(url.STATIC_SUFFIXES) == 83
    cases = {
        "http://site.example/main.css": True,
        "http://site.example/dir/list.php?p=ok&pp=7": False,
        "http://site.example/A/main.css#99": True,
        "https://cdn.example.net/up/pic/oc2d.png&#34;,&#34;name&#34;:1": True,
        "http://h/a.CSS": False,
        "http://h/app.js": False,
        "http://h/a.png/b": False,
        None: True,
    }
    assert one(spark, list(cases), url.is_static(F.col("x"))) == list(cases.values())
    assert one(spark, ["http://h/app.js", "http://h/a"], url.is_static_for_frontier(F.col("x"))) == [True, False]


def test_decomposition(spark):
    u = F.col("x")
    parts = F.concat_ws("|", url.scheme(u), url.host(u), url.path(u), url.query(u), url.fragment(u))
    assert one(spark, ["HTTPS://me:pw@Ex.com:81/a%20b+c/?q=1#f", "mailto:x", "//h/p", ""], parts) == ["https|Ex.com:81|/a b+c/|q=1|f", "mailto||x||", "|h|/p||", "||||"]


def test_integers(spark):
    cases = {"5": True, "+5": True, "-0": True, " 5 ": False, "": False, "5.0": False, "9223372036854775807": True, "9223372036854775808": False, "٣": False}
    assert one(spark, list(cases), url.is_integer(F.col("x"))) == list(cases.values())


def test_small_expressions(spark):
    u = F.col("x")
    assert one(spark, ["#a", "http://h/a#b", "http://h/%zz"], url.absolute_url(u)) == ["", "http://h/a", ""]
    assert one(spark, ["http://h/a/b?c=1", "http://h", "http://h/"], url.parent_url(u)) == ["http://h/a/", "http://h/", "http://h/"]
    assert one(spark, ["http://h/a/", "http://h/a/b"], url.snapshot_base(u)) == ["http://h/a/", "http://h/"]
    assert one(spark, ["/a/b.tar.gz", "b", "/a/"], url.basename(u)) == ["b.tar", "b", ""]
    assert one(spark, ["x" * 200], text.base64_text(u)) == [__import__("base64").b64encode(b"x" * 200).decode()]
    assert one(spark, ["content-TYPE"], text.canonical_header(u)) == ["Content-Type"]


MINED = {
    "see http://a.b/c_(d). and (www.x.com/y)": ["http://a.b/c_(d)", "www.x.com/y"],
    "/关于http://中文.cn/路径。": ["http://中文.cn/路径。"],
    "a.b/ c.com/dx, none": ["c.com/dx"],
    "nothing": [],
    "HTTP://X.y/?q=1!": ["HTTP://X.y/?q=1"],
}


def test_mining(spark):
    import duckdb

    got = one(spark, list(MINED), mining.mine_urls(F.col("x")))
    assert got == list(MINED.values())
    for t, found in MINED.items():
        assert duckdb.execute("SELECT regexp_extract_all(?, ?, 1)", [t, mining.LINEAR_PATTERN]).fetchall()[0][0] == found


def test_mining_is_fast_on_hostile_text(spark):
    began = time.time()
    got = one(spark, ["http://" + "a" * 40 + "(" + "b" * 2000], mining.mine_urls(F.col("x")))
    assert got == [["http://" + "a" * 40]] and time.time() - began < 10


def test_page_links():
    page = '<a href="x">t</a><!-- http://a.b/c --><p>go http://d.e/f?y=1&amp;z=2 now</p><link href="/s.css"/><form action="go"><a href="#"><a href="javascript:1"><script src="q.js">'
    assert html.page_links(page, "http://h/a/") == ["http://h/a/go", "http://h/a/x", "http://a.b/c", "http://d.e/f?y=1&amp;z=2"]
    assert html.page_links("", "http://h/") == [] and html.page_links(None, "x") is None


@pytest.mark.parametrize(("word", "to"), [("running", "run"), ("Caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("generously", "generous"), ("relational", "relat"), ("hoped", "hope"), ("skies", "sky"), ("be", "be"), ("Page Not Found", "page not found"), ("feed", "feed"), ("agreed", "agre"), ("consistency", "consist"), ("knightly", "knight")])
def test_stemmer(word, to):
    assert stem(word) == to


def test_terms():
    assert html.page_terms("<p> Running </p><script>Var x</script><b>\n</b>") == ["run", "var x"]


def test_page_flags(spark):
    u, h = F.col("u"), F.col("h")
    rows = [("http://h/LOGIN", ""), ("http://h", "<title>登录</title>"), ("http://h", "忘记密码"), ("http://h", "登录"), ("http://h", "登录 密码"), ("http://h", "<TITLE>My LogIn")]
    assert one(spark, rows, text.is_login_page(u, h), "u string, h string") == [True, True, True, False, True, False]
    assert one(spark, ["NOT FOUND", "页面不存在", "<title>404 x", "fine", "<title>Error 404</title>"], text.is_not_found(F.col("x"))) == [True, True, True, False, False]
    assert one(spark, ["<title>Error 404</title>"], text.is_not_found_titled(F.col("x"))) == [True]


def test_texts_of_raw_elements_have_no_tags():
    at = "http://h/"
    assert html.page_links("<!--http://x.com/a-->", at) == ["http://x.com/a--"]  # as serialised, with its signs
    assert html.page_links('<!-- http://x.com/?a=1&amp;b=2 http://y.z/?a&b -->', at) == ["http://x.com/?a=1&amp;b=2", "http://y.z/?a&amp;b"]
    for tag in ("title", "textarea", "iframe", "noembed", "noframes", "xmp", "style", "script"):
        assert html.page_links(f'<{tag}><a href="in"></{tag}><a href="out">', at) == ["http://h/out"], tag
        assert html.page_links(f'<{tag}>www.x.y/z<a href="in">', at)[-1].endswith("www.x.y/z&lt;a") or html.page_links(f"<{tag}>www.x.y/z", at) == ["http://h/www.x.y/z"], tag
    assert html.page_links('<plaintext></plaintext><a href="in">', at) == []
    assert html.page_links("<p>http://a.b/c<3 d</p>", at) == ["http://a.b/c&lt;3"]  # one text
    assert html.page_terms("<title>A &amp; B</title><style>a &amp; b</style>") == ["a & b", "a &amp; b"]


def test_reference_in_a_directory_with_a_query():
    assert html.resolve("list.php?q=ok", "http://shop.example/cat/?n=3") == "http://shop.example/cat/list.php?q=ok"
