import gzip
import hashlib
import math
import random
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from urlflow.llm import chat as C
from urlflow.llm import url_filter as U
from urlflow.llm import warc as W
from urlflow.llm.frames import new_path
from urlflow.llm.tokens import encode

TURN = "conv_id bigint, turn bigint, role string, text string"


def test_ids_and_mask_are_those_of_a_plain_assembly(spark):
    rows = [(c, t, role, f"turn {t} of {c} <|open|> ü" * (1 + t % 3)) for c in range(6) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"][: 2 + c])]
    n, e = C.encoding().n_vocab, C.encoding()
    for r in C.format_chats(spark.createDataFrame(rows, TURN).repartition(4)).collect():
        ids, mask = [n], [0]
        for _, _, role, text in [x for x in rows if x[0] == r.conv_id]:
            body = e.encode_ordinary(text.replace("<|", "<\\|"))
            head = [n + 1, *e.encode_ordinary(role), *e.encode_ordinary("\n")]
            learned = int(role == "assistant")
            ids += head + body + [n + 2] + e.encode_ordinary("\n")
            mask += [0] * len(head) + [learned] * (len(body) + 1) + [0]
        assert r.ids == ids and r.mask == mask and r.n_turns == sum(x[0] == r.conv_id for x in rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.one_of(st.text(max_size=30), st.sampled_from(["<|close|>", "<\\|open|> x", "a<|", ""]))), max_size=5))
def test_round_trip_and_mask(turns):
    ids, mask = C.splice([(r, encode(C.escape(t)).astype(np.int32)) for r, t in turns])
    assert C.unsplice(ids) == turns
    control = C.reserved()
    assert (ids == control["<|open|>"]).sum() == (ids == control["<|close|>"]).sum() == len(turns)
    want = []
    for r, t in turns:
        if r == "assistant":
            want += [*encode(C.escape(t)).tolist(), control["<|close|>"]]
    assert ids[mask == 1].tolist() == want and len(ids) == len(mask)


def test_chats(spark):
    rows = [(1, 1, "assistant", "hi"), (1, 0, "user", "hello <|close|>"), (1, 1, "assistant", "hi"), (None, 0, "user", "x"), (2, None, None, None), (2, 0, "us\ner", "y" * 100_000)]
    df = spark.createDataFrame(rows, TURN).select("*", F.lit(1), F.lit(2)).toDF("conv_id", "turn", "role", "text", "TURN", "ids")
    got = {r.conv_id: r for r in C.format_chats(df).collect()}
    lost = C.format_chats(spark.createDataFrame([(None, i, "assistant", f"t{i}") for i in range(50)] + [(None, 3, "user", " " * 3_000_000)], TURN)).collect()
    assert len(lost) == 51 and all(r.conv_id is None and r.n_turns == 1 for r in lost)
    assert C.unsplice(np.array(got[1].ids)) == [("user", "hello <|close|>"), ("assistant", "hi"), ("assistant", "hi")]
    assert got[1].n_turns == 3 and C.unsplice(np.array(got[None].ids)) == [("user", "x")]
    assert C.unsplice(np.array(got[2].ids)) == [("", ""), ("us er", "y" * 100_000)]
    assert C.format_chats(df.limit(0)).count() == 0


PAGE = "page_id bigint, url string, html string"


def crawl(spark, n=300):
    rng, rows = random.Random(2), []
    for i in range(n):
        good = rng.random() < 0.6
        name = "/".join(rng.choice(["article", "story", "guide"] if good else ["tag", "login", "cart"]) for _ in range(2))
        prose = " ".join(f"word{'abcdefghij'[rng.randrange(10)]}{'klmnopqrst'[rng.randrange(10)]}" for _ in range(60))
        rows.append((i, f"http://h.example/{name}/{rng.randrange(1000)}", f"<p>{prose}</p>" if good else "<p>12 % 34</p>"))
    return spark.createDataFrame(rows, PAGE)


def brute(rows, order, least):
    """Scores by the definition, with dictionaries; rows: (url, accepted, half)."""
    counts = {(c, h): Counter() for c in (True, False) for h in (0, 1)}
    text = lambda u: b"\x02" * order + u.encode() + b"\x03"
    for u, c, h in rows:
        t = text(u)
        for i in range(order, len(t)):
            for n in range(order + 1):
                counts[c, h][t[i - n : i + 1]] += 1
    follow = {}
    for k, c in counts.items():
        n, t = Counter(), Counter()
        for g, x in c.items():
            n[g[:-1]] += x
            t[g[:-1]] += 1
        follow[k] = n, t
    out = []
    for u, _, h in rows:
        t, total = text(u), 0.0
        for i in range(order, len(t)):
            p = {}
            for c in (True, False):
                n, f = follow[c, 1 - h]
                q = 1 / 257
                for k in range(order + 1):
                    ctx = t[i - k : i]
                    if n[ctx] < least:
                        break
                    q = (counts[c, 1 - h][t[i - k : i + 1]] + f[ctx] * q) / (n[ctx] + f[ctx])
                p[c] = q
            total += math.log(p[True] / p[False])
        out.append(total / (len(t) - order))
    return out


def test_scores_equal_the_definition_and_both_ways_agree(spark):
    pages = crawl(spark)
    got = sorted(U.url_filter(pages, 4, 2).collect())
    assert got == sorted(U.url_filter(pages, 4, 2, most_rows=0).collect())
    half = {r.page_id: r.h for r in pages.select("page_id", F.pmod(F.xxhash64("url", F.lit(7)), F.lit(2)).cast("int").alias("h")).collect()}
    want = brute([(r.url, r.accepted, half[r.page_id]) for r in got], 4, 2)
    assert max(abs(r.score - x) for r, x in zip(got, want, strict=True)) < 1e-8


def test_pieces_of_long_urls_have_all_runs():
    urls = pa.array(["http://h/" + "abc/é" * 50, None, "", "x", "http://h/" + "z" * 300])
    whole = list(U.pieces(urls, 3, 1 << 20))
    assert len(whole) == 1
    for most in (1, 2, 7, 64, 309):
        parts = list(U.pieces(urls, 3, most))
        assert len(parts) > 1 and np.array_equal(np.concatenate([p.url for p in parts]), whole[0].url)
        for name in ("keys", "context"):
            for n, want in enumerate(getattr(whole[0], name)[: 5 if name == "keys" else 4]):
                assert np.array_equal(np.concatenate([getattr(p, name)[n] for p in parts]), want)


def test_long_urls_are_scored_in_little_memory():
    urls = pa.array([f"http://h/{i}/" + "abcdefgh" * 250 for i in range(1024)])
    tracemalloc.start()
    keys = np.sort(np.unique(np.concatenate([k for r in U.pieces(urls.slice(0, 2), 5, 1 << 15) for k in r.keys])))
    U.likelihood(urls, np.zeros(1024, np.int64), keys, np.ones((len(keys), len(U._MODEL)), np.int64), 5, 2)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_held_out_accuracy_and_calibration(spark):
    got = U.url_filter(crawl(spark)).collect()  # each half is scored by the other's counts
    assert sum((r.score > 0) == r.accepted for r in got) > 0.97 * len(got)
    yes = [r.kept for r in got if r.accepted]
    assert 0.95 <= sum(yes) / len(yes) < 1


def test_awkward_pages(spark):
    rows = [(1, None, "<p>x</p>"), (2, "", None), (None, "http://h/é", None), (3, "http://h/" + "a" * 50_000, "<p>y</p>"), (3, "http://h/x", ""), (3, "http://h/x", "")]
    df = spark.createDataFrame(rows, PAGE).select("*", F.lit(1)).toDF("page_id", "url", "html", "URL")
    for most in (0, 1 << 20):
        got = U.url_filter(df, most_rows=most).collect()
        assert len(got) == 6 and [r.score is None and r.kept is None for r in got if r.page_id == 1] == [True]
        assert all(r.kept for r in got if r.page_id != 1)
        assert U.url_filter(df.where("html IS NULL"), most_rows=most).count() == 2 and U.url_filter(df.limit(0), most_rows=most).count() == 0


def test_archives_round_trip(spark):
    rows = [(i, f"http://h/{i}", ["same ü", "other\r\n\r\nWARC/1.1\r\n", "", None][i % 4] if i < 20 else f"own {i} " * 500) for i in range(60)]
    pages = spark.createDataFrame(rows, PAGE)
    both = W.rewrite_pages(pages.repartition(4)).collect()
    got, again = ({r.page_id: r for r in both if r.date.startswith("2020-01-02") == late} for late in (False, True))
    first = {}
    for i, u, h in rows:
        h = h or ""
        o = first.setdefault(h, (i, u))
        assert got[i].type == ("response" if o[0] == i else "revisit") and got[i].n_bytes == (len(h.encode()) if o[0] == i else 0)
        assert got[i].refers_to_uri == (None if o[0] == i else o[1])
        assert (again[i].type, again[i].refers_to_uri, again[i].n_bytes) == ("revisit", o[1], 0)
    assert len(both) == 120


def records(spark, rows):
    names = ["record_id", "type", "uri", "date", "digest", "payload"]
    return spark.createDataFrame(rows, ", ".join(f"{c} {W.RECORD[c]}" for c in names))


def test_revisits_find_their_original(spark):
    d = "sha256:" + "0" * 64
    r = records(
        spark,
        [("<b>", "response", "http://b", "2020-01-02", d, b"x"), ("<a>", "response", "http://a", "2020-01-01", d, b"x"), ("<v>", "revisit", "http://v", "2019-01-01", d, None), ("<o>", "revisit", "http://o", "2020-01-01", "sha256:none", None), ("<m>", "metadata", "http://m", "2020-01-01", d, b"meta"), ("<n>", "response", None, None, None, b"n"), ("<n>", "response", None, None, None, b"n"), (None, None, None, None, None, None)],
    )
    got = {x.source_id: x for x in W.deduplicate(r).collect()}
    assert len(got) == 7 and W.deduplicate(r).count() == 7
    assert got["<a>"].type == "response" and bytes(got["<a>"].payload) == b"x" and got["<a>"].refers_to_uri is None
    for k in ("<b>", "<v>"):
        assert (got[k].type, got[k].refers_to_uri, got[k].refers_to_date, got[k].payload) == ("revisit", "http://a", "2020-01-01", None)
    assert got["<o>"].refers_to_uri is None and bytes(got["<m>"].payload) == b"meta"
    assert len({x.record_id for x in got.values()}) == 7 and all(x.record_id.startswith("<urn:uuid:") for x in got.values())


def test_written_archives_are_read_as_they_were(spark):
    at = new_path(spark, "test-archive")
    r = W.deduplicate(records(spark, [(f"<{i}>", "response", f"http://{i}", "d", None, bytes([i % 256]) * (i * 97)) for i in range(50)]))
    assert W.write_archives(r.repartition(3), at).agg(F.sum("records")).first()[0] == 50
    assert sorted((x.record_id, bytes(x.payload), x.digest) for x in W.read_archives(spark, at).collect()) == sorted((x.record_id, bytes(x.payload), x.digest) for x in r.collect())


def test_reader_takes_plain_cut_and_foreign_files(spark, tmp_path):
    one = W.encode_record(dict.fromkeys(W.RECORD) | {"type": "response", "uri": "http://h", "http": b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n", "payload": b"body \r\n\r\n more"})
    (tmp_path / "a.warc").write_bytes(one + one[:-30])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one + one))
    (tmp_path / "c.warc.gz").write_bytes(b"")
    got = W.read_archives(spark, str(tmp_path)).collect()
    assert len(got) == 4 and all(bytes(r.payload) == b"body \r\n\r\n more" and bytes(r.http).endswith(b"A: b\r\n\r\n") for r in got)


def test_awkward_pages_as_archives(spark):
    rows = [(None, None, None), (1, "http://h/1", ""), (1, "http://h/1", ""), (2, "http://h/2", "z" * 1_000_000)]
    df = spark.createDataFrame(rows, PAGE).select("*", F.lit(1)).toDF("page_id", "url", "html", "HTML")
    both = W.rewrite_pages(df).collect()
    got = {r.page_id: r for r in both if r.date.startswith("2020-01-01")}
    assert len(both) == 6 and len(got) == 3 and got[2].n_bytes == 1_000_000 and got[None].url == "" and {got[1].type, got[None].type} == {"response", "revisit"}
    assert W.rewrite_pages(df.limit(0)).count() == 0


def test_recrawls_of_a_page_keep_their_payloads(spark):
    rows = [(1, "http://h/1", "first"), (1, "http://h/1", "second"), (1, "http://h/1", "second"), (2, "http://h/2", "second"), (None, "http://h/n", "x"), (None, "http://h/n", "y"), (None, None, "z"), (None, None, "y"), (-1, "http://h/n", "x")]
    both = W.rewrite_pages(spark.createDataFrame(rows, PAGE).repartition(3)).collect()
    got = [r for r in both if r.date.startswith("2020-01-01")]
    assert len(both) == 16 and len(got) == 8 and sorted(r.n_bytes for r in got if r.type == "response") == [1, 1, 1, 5, 6]
    held = {r.digest for r in got if r.type == "response"}
    assert len(held) == 5 and all(r.digest in held for r in got) and sum(r.page_id is None for r in got) == 4
    assert [(r.page_id, r.refers_to_uri) for r in got if r.page_id == 2] == [(2, "http://h/1")]


def test_pages_with_one_id_and_url_are_kept_apart(spark):
    rows = [(None, None, "a"), (None, None, "b"), (None, "", "c"), (7, "u", "v1"), (7, "u", "v2"), (8, "u8", "z")]
    got = W.rewrite_pages(spark.createDataFrame(rows, PAGE)).where("type = 'response'").collect()
    assert sorted(r.digest for r in got) == sorted("sha256:" + hashlib.sha256(h.encode()).hexdigest() for _, _, h in rows)


def test_rewritten_pages_match_sql(spark):
    rows = [(1, "http://h/1", "first"), (1, "http://h/1", "second"), (1, "http://h/1", "second"), (2, "http://h/2", "second"), (None, "http://h/n", "x"), (None, None, "z"), (None, None, None), (-1, "http://h/n", "x"), (3, None, ""), (4, "", ""), (4, "", "")]
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, W.rewrite_pages(spark.createDataFrame(rows, PAGE)).collect()), key=key) == sorted(db.execute(W.oracle()).fetchall(), key=key)


def test_revisits_name_the_fresh_id_of_their_original(spark):
    d = "sha256:" + "0" * 64
    got = W.deduplicate(records(spark, [("<a>", "response", "http://a", "1", d, b"x"), ("<b>", "response", "http://b", "2", d, b"x"), ("<v>", "revisit", None, None, d, None)])).collect()
    first = {r.record_id for r in got if r.type == "response"}
    assert len(first) == 1 and [r.refers_to for r in got if r.type == "revisit"] == [*first] * 2


def test_the_least_of_records_with_one_name_stays(spark):
    at = dict.fromkeys(W.RECORD) | {"record_id": "<r>", "type": "response", "uri": "u", "date": "1", "digest": "d", "payload": b"p"}
    rows = [at | {"http": h} for h in (b"c", b"a", b"b")] + [at | {"record_id": None, "uri": "<r>"}, at | {"record_id": "<r>", "uri": None}]
    df = spark.createDataFrame([tuple(r[c] for c in W.RECORD) for r in rows], W._DDL)
    got = W.deduplicate(df.repartition(3)).collect()
    assert len(got) == 3 and [bytes(r.http) for r in got if r.source_id == "<r>" and r.uri == "u"] == [b"a"]


def test_reader_goes_on_after_damage(spark, tmp_path):
    one = lambda i: W.encode_record(dict.fromkeys(W.RECORD) | {"type": "response", "uri": f"http://{i}", "http": b"HTTP/1.1 200 OK\r\n\r\n", "payload": f"body {i} ".encode() * 50})
    z = [gzip.compress(one(i)) for i in range(4)]
    broken = bytearray(z[1])
    broken[40:60] = b"\xff" * 20
    bad = one(1).replace(b"Content-Length: ", b"Content-Length: x")
    files = {
        "zeros": (z[0] + z[1] + b"\0" * 512, [0, 1], 0),
        "broken": (z[0] + bytes(broken) + z[2] + z[3], [0, 2, 3], 1),
        "length": (gzip.compress(bad) + z[2], [2], 1),
        "plain": (one(0) + bad + one(2), [0, 2], 1),
        "missing": (one(0).replace(b"Content-Length", b"Other") + one(2), [2], 1),
        "cut": (z[0] + z[1][:-40], [0], 1),
        "head": (one(0) + one(1)[:60], [0], 1),
        "junk": (z[0] + b"junk" + z[2], [0, 2], 1),
        "nothing": (b"\0" * 100, [], 0),
    }
    for name, (data, _, _) in files.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
    got = {}
    for r in W.read_archives(spark, str(tmp_path)).collect():
        got.setdefault(r.uri, []).append(bytes(r.payload))
    want = [i for _, have, _ in files.values() for i in have]
    assert {u: len(x) for u, x in got.items()} == {f"http://{i}": want.count(i) for i in set(want)}
    assert all(p == f"body {u[7:]} ".encode() * 50 for u, x in got.items() for p in x)
    for r in W.damage(spark, str(tmp_path)).collect():
        name = r.file.rpartition("/")[2].removesuffix(".warc")
        assert (name, r.records, r.errors) == (name, len(files[name][1]), files[name][2])


def test_second_captures_join_their_first(spark):
    rows = [(i, f"http://h/{i}", f"body {i % 40}") for i in range(120)]
    pages = W.page_records(spark.createDataFrame(rows, PAGE))
    second = pages.selectExpr(*[{"record_id": "concat('<again:', uri, '>') AS record_id", "type": "'revisit' AS type", "date": "concat('2021', substr(date, 5)) AS date", "payload": "CAST(NULL AS BINARY) AS payload"}.get(c, c) for c in W.RECORD])
    got = W.deduplicate(pages.unionByName(second)).collect()
    assert len(got) == 240 and sum(r.type == "response" for r in got) == 40
    for r in got:
        first = int(r.uri.rpartition("/")[2]) % 40
        again = r.source_id.startswith("<again:") or r.uri != f"http://h/{first}"
        assert (r.type, r.refers_to_uri) == (("revisit", f"http://h/{first}") if again else ("response", None))
        assert (r.payload is None) == again
