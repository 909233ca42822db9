import random
import re

import numpy as np
import pytest
from helpers import DOCUMENTS, awkward, empty
from test_decontamination import distance
from test_ngram_join import brute as similar
from test_toxicity import score_of

import corpus_pipeline as L
from urlflow.llm import decontamination, mixing, ngram_join, sharding, toxicity
from urlflow.llm.frames import row_key
from urlflow.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def tables(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_each_stage_does_its_part(spark, tmp_path):
    clean = [f"clean{i} " + " ".join(f"c{i}x{j}" for j in range(60)) for i in range(12)]
    texts = [*clean, clean[0], clean[1].replace("c1x30", "changed"), "you idiot " + clean[2], "Read: alpha, beta, gamma, delta, epsilon, zeta, eta, theta, iota, kappa, lambda, mu, nu, xi, omicron, pi, rho. " + " ".join(f"z{j}" for j in range(60)), None, ""]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)], DOCUMENTS)
    at = tables(spark, tmp_path, docs)
    kept, ids = docs, []
    for name, stage in L.STAGES[:3]:
        kept = stage(spark, kept, at)
        assert kept.columns == docs.columns, name
        ids.append({r.doc_id for r in kept.collect()})
    assert [set(range(18)) - x for x in ids] == [{14}, {12, 13, 14}, {12, 13, 14, 15}]
    rows = L.run(spark, at).collect()
    assert {r.doc_id for r in rows} <= ids[2] and sorted(r.row_number for r in rows) == list(range(len(rows)))
    assert all(r.text in texts[r.doc_id] for r in rows)


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in L.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(docs.collect()) == sorted(L.run(spark, SF).collect())


def parts_of_slots(docs):
    """Rows of mix_documents() with plain loops; only the order of documents is taken from order_keys()."""
    e, held, names = mixing.encoding(), {}, []
    for r in sorted(docs.where("text IS NOT NULL").select("*", *[k.alias(f"k{i}") for i, k in enumerate(mixing.order_keys())]).collect(), key=lambda r: (r.k0, r.k1)):
        starts, at = {}, 0
        for c in r.text:
            starts[at] = c
            at += len(c.encode())
        at = 0
        own = held.setdefault(r.source, [])
        for n, token in enumerate([*e.encode_ordinary(r.text), None]):
            size = 0 if token is None else len(e.decode_single_token_bytes(token))
            own.append((len(own) - n, r, "".join(starts.get(i, "") for i in range(at, at + size)), token is None and n == 0))
            at += size
    names = sorted(held, key=lambda s: (s is not None, s or ""))
    p = np.array([float(len(held[s])) ** mixing.ALPHA for s in names])
    n = [-(-len(held[s]) // mixing.BLOCK) for s in names]
    left, taken, out = sum(n), [0] * len(names), []
    for shard in range(-(-sum(n) // mixing.SHARD_BLOCKS)):
        size = min(mixing.SHARD_BLOCKS, left)
        left -= size
        for i, many in enumerate(mixing.draw(shard, size, p / p.sum(), mixing.SEED)):
            for _ in range(many):
                epoch, k = divmod(taken[i], n[i])
                taken[i] += 1
                number = int(sharding.permute(np.array([k]), n[i], mixing.SEED + 1_000_003 * (i + 1) + epoch * 7_919)[0])
                parts = {}
                for key, r, text, bare in held[names[i]][number * mixing.BLOCK : (number + 1) * mixing.BLOCK]:
                    was = parts.get(key, (r, "", False))
                    parts[key] = (r, was[1] + text, was[2] or bare)
                out += [(r.doc_id, text, r.lang, r.source, len(text)) for r, text, bare in parts.values() if text or bare]
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".lower().split()
    texts = []
    for i in range(70):
        w = [f"wörd{rng.randrange(3000)}" for _ in range(rng.randint(5, 120))]
        if texts and rng.random() < 0.3:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(3000)}"
        if rng.random() < 0.15:
            w.insert(rng.randrange(len(w)), rng.choice(["morom", "estupido", '"idiot"', "crown", "you scum"]))
        if rng.random() < 0.15:
            p = list(item)
            for _ in range(rng.randint(0, 5)):
                p[rng.randrange(len(p))] = "other"
            w[3:3] = p
        texts.append(" ".join(w))
    rows = [(i, t, "de" if i % 3 else None, [None, "a", "b"][i % 3], len(t)) for i, t in enumerate(texts)] + [(70, None, "en", "a", None), (71, "", "en", "a", 0), (72, "...", "en", "b", 3), (73, texts[0], "en", "b", 9)]
    at = tables(spark, tmp_path, spark.createDataFrame(rows, DOCUMENTS))
    words = lambda t: re.findall(r"\w+", t.lower())
    kept = [r for r in rows if r[1] is None or score_of(r[1], toxicity.automaton())[2] < toxicity.THRESHOLD]
    root = {r[0]: r[0] for r in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in similar([(r[0], r[1]) for r in kept if r[1] is not None], ngram_join.THRESHOLD):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    one = [r for r in kept if find(r[0]) == r[0]]
    clean = [r for r in one if r[1] is None or distance(item, words(r[1])) > decontamination.allowed(len(item))]
    assert len(rows) > len(kept) + 2 > len(one) + 4 > len(clean) + 5
    parts = parts_of_slots(spark.createDataFrame(clean, DOCUMENTS))
    keyed = spark.createDataFrame(parts, DOCUMENTS).select("*", row_key().alias("k")).collect()
    order = sorted(keyed, key=lambda r: (r.doc_id, r.k.a, r.k.b))
    place = sharding.permute(np.arange(len(order)), len(order))
    want = [(*r[:5], i, int(place[i]) // sharding.SHARD_ROWS, int(place[i]) % sharding.SHARD_ROWS) for i, r in enumerate(order)]
    got = [tuple(r) for r in L.run(spark, at).select("doc_id", "text", "lang", "source", "n_chars", "row_number", "shard", "slot").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > len(clean)


@pytest.mark.parametrize("make", [awkward, empty])
def test_stages_stand_odd_tables(spark, tmp_path, make):
    docs = make(spark)
    docs = docs.toDF(*[c if i < 5 else f"extra{i}" for i, c in enumerate(docs.columns)])
    at = tables(spark, tmp_path, docs)
    rows = L.run(spark, at).collect()
    assert (len(rows) > 0) == (make is awkward) and all(r.text is not None for r in rows)


def test_names_and_order():
    assert [n for n, _ in L.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources", "sharding"]
    assert [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert all(m for m in (mixing, ngram_join, sharding, toxicity))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    names = ", ".join(f'"{x}"' for x in sorted(df.columns))
    want = c.execute(f"SELECT {names} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
