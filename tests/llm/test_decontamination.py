import random

import numpy as np
import pyarrow as pa
from helpers import awkward, documents, empty

from urlflow.llm import decontamination as D
from urlflow.llm.words import Words


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")


def distance(item, text):
    """Edits to the closest run of text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def planted(seed, n_docs=150):
    rng = random.Random(seed)
    items = [[f"i{k}w{j}" if rng.random() < 0.7 else f"c{rng.randrange(20)}" for j in range(rng.randint(15, 50))] for k in range(12)]
    docs = []
    for _ in range(n_docs):
        w = [f"c{rng.randrange(20)}" if rng.random() < 0.3 else f"d{rng.randrange(5000)}" for _ in range(rng.randint(20, 120))]
        if rng.random() < 0.6:
            p = list(rng.choice(items))
            for _ in range(rng.randint(0, 9)):
                i, kind = rng.randrange(len(p)), rng.randrange(3)
                p[i : i + 1] = [["zz"], [], [p[i], "zz"]][kind]
                p = p or ["zz"]
            at = rng.randint(0, len(w))
            w[at:at] = p
        docs.append(w)
    return items, docs


def test_recall_and_precision_against_brute_force(spark):
    want, got = set(), set()
    for seed in (1, 2, 3):
        items, docs = planted(seed)
        for i, w in enumerate(docs):
            for k, it in enumerate(items):
                if distance(it, w) <= D.allowed(len(it)):
                    want.add((seed, i, k))
        rows = D.matches(documents(spark, [" ".join(w) for w in docs]), bench(spark, [" ".join(x) for x in items])).collect()
        got |= {(seed, r.doc_id, r.item_id) for r in rows}
        for r in rows:
            w = docs[r.doc_id][r.first_word : r.first_word + r.n_words]
            assert r.edits <= D.allowed(len(items[r.item_id])) and distance(items[r.item_id], w) <= r.edits
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 100


def test_seeds_lose_nothing():
    items, docs = planted(7)
    index = D.Index([D.Item(k, Words(pa.array([" ".join(x)])).of(0), D.allowed(len(x))) for k, x in enumerate(items)])
    for w in docs:
        words = Words(pa.array([" ".join(w)]))
        found = {k for _, k, *_ in index.search(words.hashes, words.offsets, lsh=False)}
        assert found == {k for k, it in enumerate(items) if distance(it, w) <= D.allowed(len(it))}


def test_closest():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 8))] for _ in range(2))
        texts = np.array([b + [99] * (8 - len(b)), [7] * 8])
        e, first, n = (x.tolist() for x in D.closest(np.array([a, a]), texts, np.array([len(b), 0])))
        assert e == [distance(a, b), len(a)] and 0 <= first[0] <= first[0] + n[0] <= len(b)
        assert distance(a, b) == min(e[0], distance(a, b[first[0] : first[0] + n[0]]))


def test_case_punctuation_and_copies(spark):
    item = "The quick brown fox jumps over the lazy dog and runs away from the angry bear"
    docs = documents(spark, [f"Start. {item.upper().replace(' ', ', ')}! End", "nothing of it", f"x {item}", f"x {item}"], ids=[1, 2, 3, 3])
    b = bench(spark, [item, item])
    assert sorted((r.doc_id, r.item_id, r.first_word, r.n_words, r.edits) for r in D.matches(docs, b).collect()) == [(1, 0, 1, 16, 0), (1, 1, 1, 16, 0)] + [(3, i, 1, 16, 0) for i in (0, 0, 1, 1)]
    assert [r.doc_id for r in D.decontaminate(docs, b).collect()] == [2]


def test_short_items_match_exactly(spark):
    docs = documents(spark, ["alpha beta gamma", "alpha gamma", "ALPHA", "alphabet"])
    got = {(r.doc_id, r.item_id) for r in D.matches(docs, bench(spark, ["alpha", "beta gamma", "", None, "..."])).collect()}
    assert got == {(0, 0), (1, 0), (2, 0), (0, 1)}


def test_portions_give_the_same(spark):
    items, docs = planted(5, 60)
    d, b = documents(spark, [" ".join(w) for w in docs]), bench(spark, [" ".join(x) for x in items])
    assert sorted((r.doc_id, r.item_id) for r in D.matches(d, b, portion=60).collect()) == sorted((r.doc_id, r.item_id) for r in D.matches(d, b).collect())


def test_awkward_rows(spark):
    b = bench(spark, ["one two three four five six seven eight nine"])
    assert D.matches(awkward(spark), b).count() == 0
    assert D.decontaminate(awkward(spark), b).count() == 13
    assert D.matches(empty(spark), b).count() == D.matches(awkward(spark), b.limit(0)).count() == D.decontaminate(empty(spark), b).count() == 0


def test_recall_of_every_size_with_all_edits():
    rng = np.random.default_rng(11)
    words = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    sizes = [5, 8, 15, 20, 40, 60, 100, 128, 129, 200, 400]
    items = [D.Item(k, words(n), D.allowed(n)) for k, n in enumerate(sizes * 3)]
    texts, want = [], []
    for k, item in enumerate(items):
        for _ in range(40 if len(item.words) <= 128 else 6):
            p = list(item.words)
            for _ in range(item.d):
                i, kind, new = int(rng.integers(0, len(p))), int(rng.integers(0, 3)), int(rng.integers(1, 1 << 62))
                p[i : i + 1] = [[new], [], [new, p[i]]][kind]
            want.append((len(texts), k))
            texts.append(np.concatenate([words(30), np.array(p, np.uint64), words(30)]))
    index = D.Index(items)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = index.search(np.concatenate(texts), offsets)
    found = {(doc, k) for doc, k, *_ in got}
    assert found <= set(want) and all(e <= items[k].d for _, k, _, _, e in got)
    for n in sizes:
        own = [w for w in want if len(items[w[1]].words) == n]
        assert sum(w in found for w in own) >= (0.96 if n <= 128 else 1) * len(own)  # of 120 trials at a recall of 0.99
    assert len(found) >= 0.985 * len(want)
    assert {s.n: s.samples.shape[1] > 0 for s in index.sizes} == {n: n <= D.LONG for n in sizes}


def test_a_recall_out_of_reach_is_an_error(monkeypatch):
    monkeypatch.setattr(D, "SAMPLES", (3,))
    item = D.Item(0, np.arange(1, 7, dtype=np.uint64) << np.uint64(20), 6)
    try:
        D.repeats([item], 1, 1.0)
        raise AssertionError("no error")
    except ValueError as e:
        assert "recall" in str(e)


def test_run_length_follows_from_tolerance():
    for n in range(1, 200):
        d = D.allowed(n)
        assert 1 <= D.seed_length(n, d) <= D.SEED and D.seed_length(n, d) * (d + 1) <= n
    assert [D.allowed(n) for n in (4, 5, 10, 15, 400)] == [0, 1, 2, 3, 80]
