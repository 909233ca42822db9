import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import awkward, documents, empty

from urlflow.llm import suffix_dedup as S


def brute(rows, length):
    """rows: (id, words); rows that share an id are one document."""
    seen = defaultdict(set)
    for i, w in rows:
        for k in range(len(w) - length + 1):
            seen[tuple(w[k : k + length])].add(i)
    spans = defaultdict(set)
    for i, w in rows:
        for k in range(len(w) - length + 1):
            if len(seen[tuple(w[k : k + length])]) > 1:
                spans[i] |= set(range(k, k + length))
    out = []
    for i, words in spans.items():
        at = sorted(words)
        start = at[0]
        for x, y in zip(at, [*at[1:], None], strict=True):
            if y != x + 1:
                out.append((i, start, x - start + 1))
                start = y
    return sorted(out)


def corpus(seed, n=60):
    rng, texts = random.Random(seed), []
    for _ in range(n):
        w = [f"w{rng.randrange(2000)}" for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            if texts:
                src = rng.choice(texts)
                a = rng.randint(0, len(src))
                part = src[a : a + rng.randint(1, 60)]
                at = rng.randint(0, len(w))
                w[at:at] = part
        if rng.random() < 0.1:
            w += ["same"] * rng.randint(1, 120)
        texts.append(w)
    return texts


@pytest.mark.parametrize(("seed", "length", "depth", "batches"), [(1, 50, 25, 8), (2, 20, 10, 3), (3, 20, 20, 4), (4, 12, 3, 1), (5, 8, 1, 5)])
def test_equals_brute_force(spark, seed, length, depth, batches):
    texts = corpus(seed)
    want = brute(list(enumerate(texts)), length)
    got = sorted(tuple(r) for r in S.repeats(documents(spark, [" ".join(w) for w in texts]), length, depth, batches).collect())
    assert got == want and len(want) > 8


def test_levels_merge_geometrically(spark):
    docs = documents(spark, [" ".join(w) for w in corpus(6)])
    family = S.Family.create(docs, length=20, depth=10)
    arrays = family.arrays(docs, 6)
    for i in range(6):
        family._add(arrays.where(f"batch = {i}"))
        assert sorted(family.levels) == [k for k in range(4) if (i + 1) >> k & 1]
    path = family.levels[2]
    t = spark.read.parquet(path).orderBy("bucket").collect()
    keys = np.concatenate([np.frombuffer(r.suffixes, f"S{S.n_codes(10)}") for r in t])
    assert len(t) > 2 and (keys[1:] >= keys[:-1]).all()  # one order over all buckets
    family.drop()
    assert family.levels == {}


def test_a_new_batch_finds_what_an_opened_index_holds(spark, tmp_path):
    a, b = " ".join(f"x{i}" for i in range(80)), " ".join(f"y{i}" for i in range(80))
    old, new = documents(spark, [a, b], ids=[1, 2]), documents(spark, ["pre " + a, b + " post", "nothing " * 60], ids=[3, 4, 5])
    at = f"file://{tmp_path}/index"
    assert S.Family.create(old, at).add(old).count() == 0
    family = S.Family.open(spark, at)
    got = family.add(new)
    assert {r.doc_id for r in got.collect()} == {1, 2, 3, 4} and sorted(S.Family.open(spark, at).levels) == [1]
    assert sorted(tuple(r) for r in S.verify(old.union(new), got).collect()) == [(1, 0, 80), (2, 0, 80), (3, 1, 80), (4, 0, 80)]
    third = S.Family.open(spark, at).add(documents(spark, [a], ids=[6]))
    assert 6 in {r.doc_id for r in third.collect()}


def test_order_prefixes_and_merges():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (400, 8), dtype=np.uint8)
    x[np.maximum.accumulate(x == 0, axis=1)] = 0
    e = [S.ordered(S.Entries(np.ascontiguousarray(y).view("S8").ravel(), rng.integers(0, 9, len(y)), rng.integers(0, 3, len(y)))) for y in (x[:150], x[150:])]
    both = S.merged(*e)
    assert (both.keys[1:] >= both.keys[:-1]).all() and sorted(zip(*map(list, both), strict=True)) == sorted([t for a in e for t in zip(*map(list, a), strict=True)])
    for i, n in enumerate(S.common(both.keys).tolist()):
        a, b = both.keys[i], both.keys[i + 1]
        assert n == next((k for k in range(8) if a[k : k + 1] != b[k : k + 1] or not a[k : k + 1]), 8)
    kept, others = S.collapse(both)
    for key in np.unique(both.keys):
        docs = set(both.docs[both.keys == key].tolist())
        assert set(kept.docs[kept.keys == key].tolist()) == {min(docs), max(docs)}
        assert sorted(others.docs[others.keys == key].tolist()) == sorted(docs - {min(docs), max(docs)})


def test_a_passage_in_very_many_documents(spark):
    p = " ".join(f"x{i}" for i in range(55))
    df = spark.range(20_000).selectExpr("id AS doc_id", f"concat('a', id, ' {p} b', id) AS text")
    got = S.repeats(df)
    assert got.count() == 20_000 and got.where("first_word = 1 AND n_words = 55").count() == 20_000
    family = S.Family.create(df)
    arrays = family.arrays(df, 1).where("bucket IS NOT NULL")
    assert sum(len(r.docs) // 8 for r in arrays.collect()) < 500  # not one a document
    family.drop()


def test_repeats_within_a_document_dont_count(spark):
    a = " ".join(f"x{i}" for i in range(60))
    assert S.repeats(documents(spark, [a + " " + a, a, a], ids=[1, 2, 2])).orderBy("doc_id").collect() == [(1, 0, 120), (2, 0, 60)]
    assert S.repeats(documents(spark, [a, a], ids=[1, 1])).count() == 0
    assert S.repeats(documents(spark, [a.upper(), a.replace(" ", ", ")])).count() == 2


def test_awkward_rows(spark):
    assert S.repeats(awkward(spark)).count() == 0 and S.repeats(empty(spark)).count() == 0
    both = documents(spark, ["go " * 90_000, "go " * 60, None], ids=[1, 2, 3])
    assert sorted(tuple(r) for r in S.repeats(both).collect()) == [(1, 0, 90_000), (2, 0, 60)]
