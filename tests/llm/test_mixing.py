import base64

import numpy as np
from helpers import awkward, documents, empty

from urlflow.llm import mixing as M
from urlflow.llm.sharding import permute
from urlflow.llm.tokens import RANKS, encode, encoding


def texts(spark, n=60):
    return documents(spark, [f"Über den Text {i} " * (1 + i % 17) + "日本" * (i % 5) for i in range(n)], source=[None if i % 7 == 0 else f"s{i % 3}" for i in range(n)])


def test_blocks_hold_all_tokens_once(spark):
    docs = texts(spark)
    blocks = M.pack(docs.repartition(3), 64)[0].collect()
    end = encoding().n_vocab
    by_doc, total = {}, 0
    for r in blocks:
        ids = np.frombuffer(r.tokens, "<u2")
        assert len(ids) == 64 and r.n_tokens == sum(p.n_tokens for p in r.pieces) <= 64 and (ids[r.n_tokens :] == end).all()
        at = 0
        for p in r.pieces:
            by_doc.setdefault(p.doc_id, []).append((p.begin, ids[at : at + p.n_tokens]))
            at += p.n_tokens
        total += r.n_tokens
    for r in docs.collect():
        parts = sorted(by_doc[r.doc_id], key=lambda x: x[0])
        assert np.concatenate([p for _, p in parts]).tolist() == [*encode(r.text).tolist(), end]
    for s in {r.source for r in blocks}:
        assert sorted(r.number for r in blocks if r.source == s) == list(range(sum(r.source == s for r in blocks)))


def by_definition(docs, block, shard_blocks, seed, alpha):
    """Rows of mix_blocks() with plain loops; only the order of the rows is taken from order_keys()."""
    end, tokens, owners = encoding().n_vocab, {}, {}
    for r in sorted(docs.where("text IS NOT NULL").select("*", *[k.alias(f"k{i}") for i, k in enumerate(M.order_keys())]).collect(), key=lambda r: (r.k0, r.k1)):
        ids = [*encoding().encode_ordinary(r.text), end]
        tokens.setdefault(r.source, []).extend(ids)
        owners.setdefault(r.source, []).extend([(r.doc_id, len(tokens[r.source]))] * len(ids))
    names = sorted(tokens, key=lambda s: (s is not None, s or ""))
    p = np.array([float(len(tokens[s])) ** alpha for s in names])
    n = [-(-len(tokens[s]) // block) for s in names]
    left, taken, out = sum(n), [0] * len(names), []
    for shard in range(-(-sum(n) // shard_blocks)):
        size, place = min(shard_blocks, left), 0
        left -= size
        for i, many in enumerate(M.draw(shard, size, p / p.sum(), seed)):
            for _ in range(many):
                epoch, k = divmod(taken[i], n[i])
                number = int(permute(np.array([k]), n[i], seed + 1_000_003 * (i + 1) + epoch * 7_919)[0])
                slot = int(permute(np.array([place]), size, seed + 31 * shard)[0])
                a, b = number * block, min((number + 1) * block, len(tokens[names[i]]))
                ids = tokens[names[i]][a:b]
                docs_in = [x[0] for j, x in enumerate(owners[names[i]][a:b]) if j == 0 or owners[names[i]][a + j - 1] != x]
                out.append((shard, slot, names[i], number, epoch, len(ids), np.array(ids + [end] * (block - len(ids)), "<u2").tobytes(), docs_in))
                taken[i], place = taken[i] + 1, place + 1
    return sorted(out, key=lambda r: r[:2])


def test_rows_are_those_of_the_definition_however_partitioned(spark):
    docs = texts(spark, 90).union(documents(spark, ["same", "same", "", None], ids=[7, 7, 8, 9], source=["s0"] * 4))
    want = by_definition(docs, 32, 16, M.SEED, M.ALPHA)
    assert len(want) > 64
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (2, 5, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = M.mix_blocks(docs.repartition(n), block=32, shard_blocks=16).collect()
            assert sorted(((r.shard, r.slot, r.source, r.number, r.epoch, r.n_tokens, bytes(r.tokens), list(r.doc_ids)) for r in got), key=lambda r: r[:2]) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_offsets_of_groups_of_shards(spark, monkeypatch):
    rows = lambda: sorted(tuple(r) for r in M.slots([50, 20, 400], np.array([0.5, 0.3, 0.2]), 10, 5, spark).collect())
    a = rows()
    monkeypatch.setattr(M, "GROUP", 3)
    assert rows() == a and len(a) == 470


def test_tokens_of_a_larger_vocabulary_have_32_bits(spark, tmp_path):
    with open(RANKS, "rb") as f:
        lines = f.read().splitlines()
    have = {line.split()[0] for line in lines}
    more = (base64.b64encode(f"zq{i}".encode()) for i in range(20_000))
    lines += [x + b" " + str(len(lines) + i).encode() for i, x in enumerate(y for y in more if y not in have)]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(lines))
    assert M.dtype(str(path)) == "<u4" and M.dtype() == "<u2"
    got = {(r.source, r.number): r for r in M.pack(texts(spark, 20), 32, ranks=str(path))[0].collect()}
    for r in M.pack(texts(spark, 20), 32)[0].collect():
        wide = np.frombuffer(got[r.source, r.number].tokens, "<u4")
        assert len(wide) == 32 and [x for x in wide.tolist() if x < len(have)] == [x for x in np.frombuffer(r.tokens, "<u2").tolist() if x < len(have)]


def test_slots_are_drawn_by_weight_and_permuted(spark):
    rows = M.slots([50, 20, 400], np.array([0.5, 0.3, 0.2]), 100, 5, spark).collect()
    assert len(rows) == 470
    for s in range(5):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) == (100 if s < 4 else 70)
        assert [sum(r.source_no == k for r in own) for k in range(3)] == M.draw(s, len(own), np.array([0.5, 0.3, 0.2]), 5).tolist()
    for k, n in enumerate([50, 20, 400]):
        numbers = {}
        for r in rows:
            if r.source_no == k:
                numbers.setdefault(r.epoch, []).append(r.number)
        for e, x in numbers.items():
            assert len(set(x)) == len(x) <= n and max(x) < n and (len(x) == n or e == max(numbers))
    a, b = (sorted((r.shard, r.slot, r.number) for r in M.slots([50, 20, 400], np.array([0.5, 0.3, 0.2]), 100, 5, spark).collect()) for _ in range(2))
    assert a == b


def test_shares_come_near_the_weights(spark):
    rows = M.slots([1000, 1000, 1000], np.array([0.7, 0.2, 0.1]), 500, 1, spark).groupBy("source_no").count().collect()
    assert all(abs(r["count"] / 3000 - p) < 0.04 for r in rows for p in [[0.7, 0.2, 0.1][r.source_no]])


def test_join_by_broadcast_and_by_shuffle_agree(spark, monkeypatch):
    rows = lambda: sorted((r.shard, r.slot, r.source or "", r.number, bytes(r.tokens)) for r in M.mix_blocks(texts(spark), block=32, shard_blocks=16).collect())
    a = rows()
    monkeypatch.setattr(M, "MOST_BROADCAST", 0)
    assert rows() == a and len(a) > 32


def test_weights_by_name(spark):
    got = {r.source for r in M.mix_blocks(texts(spark), {"s1": 1.0, None: 1.0, "nope": 5.0}, block=32).collect()}
    assert got == {"s1", None}
    assert M.mix_blocks(texts(spark), {"nope": 1.0}).count() == 0


def test_documents_come_back_whole(spark):
    docs = texts(spark, 40)
    got = M.mix_documents(docs, {s: 1.0 for s in ("s0", "s1", "s2", None)}, block=40, shard_blocks=16)
    assert got.columns == docs.columns and all(r.n_chars == len(r.text) for r in got.collect())
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text in whole[r.doc_id] for r in got.collect())
    pieces = M.pack(docs.repartition(2), 40, with_text=True)[0].collect()
    text = {}
    for r in pieces:
        for p in r.pieces:
            text.setdefault(p.doc_id, []).append((p.begin, p.text))
    assert {k: "".join(t for _, t in sorted(v)) for k, v in text.items()} == whole


def test_awkward_rows(spark):
    got = M.mix_blocks(awkward(spark), block=256)
    assert got.count() > 100 and M.mix_documents(awkward(spark), block=256).count() > 100
    assert M.mix_blocks(empty(spark)).count() == M.mix_documents(empty(spark)).count() == 0
    assert M.mix_blocks(documents(spark, [None])).count() == 0
    only = M.mix_documents(documents(spark, [""])).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in only] == [(0, "", 0)]
