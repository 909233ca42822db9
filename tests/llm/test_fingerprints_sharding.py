import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from urlflow.llm import fingerprints as P
from urlflow.llm import sharding as H
from urlflow.llm.words import Words, mix


def test_collisions_estimate_generalised_jaccard():
    rng = np.random.default_rng(4)
    terms = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    for _ in range(4):
        a, b = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
        got = P.sample(np.concatenate([terms[a > 0], terms[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), np.array([0, (a > 0).sum()]), 3000)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((got[0] == got[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 3000)


def test_signatures_are_those_of_the_definition(spark):
    texts = ["a b c a a d", "Ünï b B b c!", "x " * 500 + "y", "one"]
    rows = {r.doc_id: r for r in P.fingerprint(documents(spark, texts), 16).collect()}
    f = np.float32
    for i, text in enumerate(texts):
        words = Words(pa.array([text])).of(0).tolist()
        assert rows[i].n_terms == len(set(words))
        for k in range(16):
            best = None
            for term in sorted(set(words)):
                u = [f(((int(mix(np.array([term], np.uint64), 5 * k + j + 1)[0]) >> 40) + 0.5) * 2.0**-24) for j in range(5)]
                r, logc = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3]))
                t = np.floor(f(np.log(words.count(term))) / r + u[4])
                score = logc - r * (t - u[4]) - r
                if best is None or score < best[0]:
                    best = score, term, int(t)
            t = mix(np.array([best[2]], np.int64).view(np.uint64), k)[0]
            assert rows[i].signature[k] == int(mix(np.array([np.uint64(best[1]) ^ t], np.uint64), 11).view(np.int64)[0])


def test_fingerprints_of_awkward_rows(spark):
    rows = P.fingerprint(awkward(spark), 8).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 13 and by[1].signature is None and by[1].n_terms is None
    assert by[2].signature == by[3].signature == [] and by[2].n_terms == 0
    assert by[4].signature == by[5].signature and len(by[6].signature) == 8 and by[6].n_terms == 7919
    assert P.fingerprint(empty(spark)).count() == 0


def test_fingerprints_dont_depend_on_the_partition(spark):
    docs = documents(spark, [f"a b c {i} {i % 3}" for i in range(40)])
    assert sorted(P.fingerprint(docs.repartition(1), 4).collect()) == sorted(P.fingerprint(docs.repartition(7), 4).collect())


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 40))
def test_permutation_is_a_bijection_with_an_inverse(n, seed):
    p = H.permute(np.arange(n), n, seed)
    assert np.array_equal(np.sort(p), np.arange(n)) and np.array_equal(H.invert(p, n, seed), np.arange(n))


@pytest.mark.parametrize("n", [10**9 + 7, 4 * 10**18])
def test_large_permutations_invert(n):
    i = np.array([0, 1, n // 2, n - 1])
    p = H.permute(i, n)
    assert (p >= 0).all() and (p < n).all() and np.array_equal(H.invert(p, n), i)


def test_shards_are_full_and_reproducible(spark):
    docs = documents(spark, [f"t{i}" for i in range(103)])
    a = H.shard(docs.repartition(5), 10).collect()
    assert sorted((r.shard, r.slot) for r in a) == [(i // 10, i % 10) for i in range(103)]
    assert sorted(r.row_number for r in a) == list(range(103)) and all(r.row_number == r.doc_id for r in a)
    assert sorted(a) == sorted(H.shard(docs.repartition(2), 10).collect())


def test_sharding_of_awkward_rows(spark):
    rows = H.shard(awkward(spark), 4).collect()
    assert sorted(r.row_number for r in rows) == list(range(13)) and {r.doc_id for r in rows if r.row_number < 2} == {None}
    assert sorted((r.shard, r.slot) for r in rows) == [(i // 4, i % 4) for i in range(13)]
    assert H.shard(empty(spark)).count() == 0


def test_written_shards(spark, tmp_path):
    H.write_shards(H.shard(documents(spark, ["a", "b", "c", "d", "e"]), 2), str(tmp_path / "s"))
    got = [r.slot for r in spark.read.parquet(str(tmp_path / "s")).where("shard = 1").collect()]
    assert got == [0, 1]
