import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, documents, empty

from urlflow.llm import ngram_join as J
from urlflow.llm.frames import made, row_key
from urlflow.llm.grams import planes


def grams(text, n=3):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, t, n=3):
    out = {}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            s, u = grams(x, n), grams(y, n)
            if s and u and a != b and len(s & u) >= t * len(s | u) - 1e-12:
                out[min(a, b), max(a, b)] = len(s & u) / len(s | u)
    return out


def corpus(seed, n=120, words=40, size=60):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(words)}"
            texts.append(" ".join(w[: rng.randint(max(1, len(w) - 5), len(w))]))
        else:
            texts.append(" ".join(f"v{rng.randrange(words)}" for _ in range(rng.randint(1, size))))
    return texts


@pytest.mark.parametrize(("seed", "t", "n", "how"), [(1, 0.5, 3, {}), (2, 0.3, 2, {}), (3, 0.8, 1, {}), (4, 0.5, 3, {"levels": (1,)}), (5, 0.5, 2, {"filter_bits": 256, "top": 4}), (6, 0.5, 2, {"levels": (8,), "top": 1}), (7, 0.5, 2, {"block": 4})])
def test_equals_brute_force(spark, seed, t, n, how):
    texts = corpus(seed)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in J.join(documents(spark, texts), t, n, **how).collect()}
    want = brute(list(enumerate(texts)), t, n)
    assert len(want) > 10 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


@pytest.mark.parametrize("seed", [1, 7])
def test_links_lose_no_pair_of_texts(spark, seed):
    texts = corpus(seed)
    texts += random.Random(seed).choices(texts, k=60)
    rows = list(enumerate(texts))
    least = {}
    for i, x in rows:
        least.setdefault(x, i)
    want = {(min(least[x], least[y]), max(least[x], least[y])) for (a, b), _ in brute(rows, 0.5).items() if (x := texts[a]) != (y := texts[b])}
    want |= {(least[x], i) for i, x in rows if least[x] < i}
    got = [tuple(r) for r in J.links(documents(spark, texts)).collect()]
    assert {g[:2] for g in got} == want and len(got) == len(want) > 60
    assert all(abs(j - len(grams(texts[a]) & grams(texts[b])) / len(grams(texts[a]) | grams(texts[b]))) < 1e-12 for a, b, j in got)


@pytest.mark.parametrize("seed", [1, 7])
def test_classes_and_their_links(spark, seed):
    texts = corpus(seed) + ["", "lone words of its own here"]
    texts += random.Random(seed).choices(texts, k=60)
    rows = [(i if i != 5 else 4, x) for i, x in enumerate(texts)] + [(3, texts[3])]  # id 4 has two texts
    links, root = {}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    distinct = sorted(set(rows))
    near = {(x, y) for k, x in enumerate(texts) for y in texts[:k] if x != y and (s := grams(x)) and (u := grams(y)) and len(s & u) >= 0.5 * len(s | u) - 1e-12}
    near |= {(y, x) for x, y in near}
    for i, x in distinct:
        links[i] = links.get(i, 0) + sum((x, y) in near for y in set(texts))
        for j, y in distinct:
            if i != j and grams(x) and (x == y or (x, y) in near):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    copies = {i: sum(j != i and x == y for k, x in distinct if k == i and grams(x) for j, y in distinct) for i in root}
    size = {}
    for i in root:
        size[find(i)] = size.get(find(i), 0) + 1
    want = {(i, find(i), links[i], copies[i]) for i in root if size[find(i)] > 1}
    got = [tuple(r) for r in J.classes(documents(spark, [x for _, x in rows], ids=[i for i, _ in rows])).collect()]
    assert set(got) == want and len(got) == len(want) > 60


def test_links_of_an_id_with_two_texts(spark):
    a = " ".join(f"a{i}" for i in range(40))
    docs = documents(spark, [a, a + " b", a, None, a], ids=[1, 1, 2, 3, None])
    assert sorted((r.doc_a, r.doc_b) for r in J.links(docs).collect()) == [(1, 1), (1, 2)]


def test_rows_that_differ_by_the_place_of_a_null_are_kept_apart(spark):
    df = spark.createDataFrame([(1, "some words here", "en", None, 3), (1, "some words here", None, "en", 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert df.select(row_key()).distinct().count() == 2 and J.keep_one(df).count() == 1


def test_awkward_rows(spark):
    got = J.join(awkward(spark)).collect()
    assert [tuple(r) for r in got] == [(4, 5, 1.0)]
    assert J.join(empty(spark)).count() == J.classes(empty(spark)).count() == 0
    assert sorted(tuple(r) for r in J.classes(awkward(spark)).collect()) == [(4, 4, 0, 1), (5, 4, 0, 1)]
    kept = J.keep_one(awkward(spark))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 6, 7, 8, 9, 10)] + [(True, 0), (True, 0)]
    assert J.keep_one(empty(spark)).count() == 0


def test_keep_one_of_each_group(spark):
    texts = corpus(11)
    kept = {r.doc_id for r in J.keep_one(documents(spark, texts)).collect()}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in brute(list(enumerate(texts)), 0.5):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert kept == {find(i) for i in range(len(texts))}


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 70)] + [(200, 100), (5, 5)], "u bigint, v bigint")
    assert {(r.node, r.root) for r in J.components(e).collect()} == {(i, 0) for i in range(1, 71)} | {(200, 100)}


def test_a_large_group_of_copies(spark):
    w = [f"a{i}" for i in range(80)]
    texts = [" ".join(w[:k] + [f"x{k}"] + w[k + 1 :]) for k in range(40)] * 2
    assert J.join(documents(spark, texts)).count() == 80 * 79 // 2
    assert {tuple(r)[1:] for r in J.classes(documents(spark, texts)).collect()} == {(0, 39, 1)}
    assert J.links(documents(spark, texts)).count() == 40 * 39 // 2 + 40
    assert J.keep_one(documents(spark, texts)).count() == 1


@pytest.mark.parametrize(("seed", "how"), [(1, {"hot": 1}), (2, {"hot": 3, "block": 4}), (3, {"hot": 2, "block": 2}), (7, {"hot": 6, "block": 1})])
def test_hot_grams_lose_no_pair(spark, seed, how):
    texts = corpus(seed)
    want = brute(list(enumerate(texts)), 0.5)
    docs = documents(spark, texts)
    got = [tuple(r) for r in J.join(docs, **how).collect()]
    assert {g[:2]: pytest.approx(g[2]) for g in got} == want and len(got) == len(want)
    assert sorted(map(tuple, J.classes(docs, **how).collect())) == sorted(map(tuple, J.classes(docs, hot=1 << 30).collect()))
    assert sorted(r.doc_id for r in J.keep_one(docs, **how).collect()) == sorted(r.doc_id for r in J.keep_one(docs, hot=1 << 30).collect())


def test_common_counts_of_frequent_and_rare_grams():
    rng = random.Random(5)
    a, b = ([np.array(sorted(rng.sample(range(most), rng.randint(1, size))), np.uint64) for _ in range(n)] for n, most, size in ((60, 150, 90), (70, 4000, 300)))
    assert J.common(a, b).tolist() == [[len({*x} & {*y}) for y in b] for x in a]
    assert J.common(a, a).tolist() == [[len({*x} & {*y}) for y in a] for x in a]


def test_a_group_of_near_copies_sends_no_pairs_by_the_square():
    n, grams = 4000, np.arange(10, 20, dtype=np.uint64)
    row = {"grams": np.repeat(grams, n).tobytes(), "doc": planes(np.tile(np.arange(n), len(grams))), "sig": np.arange(n).tobytes(), "size": planes(np.full(n, 20)), "level": np.ones(n, np.uint8).tobytes()}
    batch = pa.RecordBatch.from_pylist([row])
    out = list(J._pairs_of(0.5, J.HOT)((pa.scalar(0),), iter([batch])))
    assert sum(b.num_rows for b in out) == n * len(grams) and all(b.num_rows <= 1 << 17 for b in out)


def test_grams_that_one_text_has_are_sent_packed_and_go_first():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(3000)) for _ in range(40)]
    texts += [f"{x} one{i} more{i} word{i}" for i, x in enumerate(texts[:2])]
    crowded = SimpleNamespace(value=SimpleNamespace(least=5, frequency=lambda bucket, low: np.zeros(len(low), np.int64)))  # the filter has no room for grams of two texts
    batch = pa.RecordBatch.from_pydict({"text": texts, "sig": np.arange(len(texts))})
    out = [b for b in J._emit_postings(3, 8, 1, 0.5, crowded, J.LEVELS)(iter([batch]))]
    n = sum(len(b.column("doc")[0].as_py()) // 4 for b in out)
    assert n > 50_000 and sum(len(zlib.compress(b.column("grams")[0].as_py(), 1)) for b in out) < 4 * n
    got = pa.Table.from_batches(J._met(0.5, J.HOT)((pa.scalar(0),), iter(out)))
    assert {(a, b) for a, b in zip(got["sa"].to_pylist(), got["sb"].to_pylist(), strict=True)} == {(0, 40), (1, 41)}
    assert list(J._met(0.5, J.HOT)((pa.scalar(0),), iter(J._emit_postings(3, 8, 1, 0.5, crowded, J.LEVELS)(iter([batch.slice(0, 40)]))))) == []


def test_sets_of_a_group_of_near_copies_are_held_once(spark):
    w = [f"a{i}" for i in range(80)]
    texts = [" ".join(w[:k] + [f"x{k}"] + w[k + 1 :]) for k in range(72)]
    before = len(made())
    assert {tuple(r)[1:] for r in J.classes(documents(spark, texts), block=4).collect()} == {(0, 71, 0)}
    (folder,) = [x for x in made()[before:] if "urlflow-sets-" in x]
    at, base = J.fs.FileSystem.from_uri(folder)
    held = []
    for f in at.get_file_info(J.fs.FileSelector(base)):
        with at.open_input_stream(f.path) as x, pa.ipc.open_stream(x) as t:
            held += t.read_all()["sig"].to_pylist()
    assert len(held) == len(set(held)) == 72
