import re
from types import SimpleNamespace as N

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from urlflow.llm import frames
from urlflow.llm.grams import gram_sets, squeeze, unsqueeze
from urlflow.llm.toxicity import _TOKEN
from urlflow.llm.words import Words, rolling, slices, windows


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=6))
def test_words_equal_those_of_the_pattern(texts):
    w = Words(pa.array(texts, pa.string()))
    import pyarrow.compute as pc

    low = pc.utf8_lower(pc.fill_null(pa.array(texts, pa.string()), "")).to_pylist()
    want = [_TOKEN.findall(t) for t in low]
    assert [w.offsets[i + 1] - w.offsets[i] for i in range(len(w))] == [len(x) for x in want]
    names = [x for ws in want for x in ws]
    assert len(set(zip(names, w.hashes.tolist(), strict=True))) == len(set(names)) == len(set(w.hashes.tolist()))


def test_hashes_dont_depend_on_the_place():
    a, b = Words(pa.array(["alpha beta"])), Words(pa.array(["x " * 3_000_000 + "Beta, ALPHA"]))
    assert a.hashes.tolist() == b.hashes[-2:][::-1].tolist()


def test_windows_and_rolling_agree_on_what_is_equal():
    h = Words(pa.array(["a b c a b c a b"])).hashes
    for f in (windows, rolling):
        g = f(h, 3)
        assert g[0] == g[3] and len(set(g.tolist())) == 3 and len(f(h, 9)) == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_squeeze(x):
    a = np.sort(np.array(x, np.uint32))
    assert unsqueeze(squeeze(a)).tolist() == a.tolist()


def test_gram_sets():
    w = Words(pa.array(["a b c d", "a b", None, "", "a b c a b c", "b c d"]))
    g, at = gram_sets(w, 3)
    assert np.diff(at).tolist() == [2, 1, 0, 0, 3, 1]
    sets = [set(g[at[i] : at[i + 1]].tolist()) for i in range(6)]
    assert len(sets[0] & sets[4]) == 1 and sets[5] < sets[0] and not sets[1] & sets[0]


def test_slices_cover_the_batch():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 100, None, "", "y" * 50] * 10)], names=["text"])
    parts = list(slices(b, "text", 120))
    assert sum(p.num_rows for p in parts) == 40 and pa.Table.from_batches(parts).column(0).to_pylist() == b.column(0).to_pylist()
    assert re.match("x", parts[0].column(0)[0].as_py())


def test_a_cluster_needs_a_shared_folder():
    off = lambda at: N(conf=N(get=lambda *_: at), sparkContext=N(master="yarn", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False)))))
    assert frames.shared_dir(off("hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(RuntimeError):
        frames.shared_dir(off(None))


def test_what_is_made_can_be_discarded_and_released(spark):
    before = len(frames.made())
    a, b = (frames.stage_table(spark.range(3), n) for n in "ab")
    at = frames.made()[before:]
    frames.discard(spark, at[0])
    assert b.count() == 3 and frames.made()[before:] == at[1:]
    frames.release(spark, before)
    assert len(frames.made()) == before and not any(p in frames._LEFT for p in at)
