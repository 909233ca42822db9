import random
import time
import unicodedata

import numpy as np
import pytest
from helpers import awkward, documents, empty

from urlflow.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def swaps(t):
    return {t[:i] + t[i + 1] + t[i] + t[i + 2 :] for i in range(1, len(t) - 1)}


def fold(word):
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def brute(word):
    """Fewest edits of letters to a term within its tolerance, first letters equal; None if there is none."""
    best = [e for t in X.LEXICON if word[0] == t[0] and (e := distance(word[1:], t[1:])) <= X.tolerance(t)]
    best += [1 for t in X.LEXICON if X.tolerance(t) and word in swaps(t)]
    return min(best, default=None)


def matched(word, a):
    raw = np.frombuffer(word.encode(), np.uint8)
    _, e, _ = a.match(raw, np.array([0]), np.array([len(raw)]))
    return int(e[0]) if len(e) else None


def test_automaton_equals_brute_force():
    rng, a = random.Random(3), X.automaton()
    for _ in range(1500):
        w = list(rng.choice(X.LEXICON))
        for _ in range(rng.randint(0, 3)):
            i, kind = rng.randrange(len(w) or 1), rng.randrange(3)
            if kind == 0 and w:
                w[i] = rng.choice("abeioxzéúсж中")
            elif kind == 1 and len(w) > 1:
                del w[i]
            else:
                w.insert(i, rng.choice("abeioxzéúсж中"))
        word = "".join(w)
        assert matched(word, a) == brute(word), word


def test_an_accent_is_one_edit(spark):
    a = X.automaton()
    for w in ("estupido", "cabron", "maricon", "encule", "cretin", "imbecil", "éstupid", "idiót", "estupidо"):
        assert matched(w, a) == (1 if w not in ("éstupid", "estupidо") else brute(w)), w
    for t in ("enculé", "idiot"):
        assert matched(t, a) == 0
    apart = unicodedata.normalize("NFD", "quel crétin, un enculé")
    assert len(apart) > len("quel crétin, un enculé") and X.context(apart, a)[3] == ["crétin", "enculé"]
    assert [r.n_hits for r in X.toxicity(documents(spark, [apart, "a carbon copy"])).orderBy("doc_id").collect()] == [2, 0]


def score_of(text, a, window=X.WINDOW):
    """context() by its definition, word by word and mark by mark."""
    low, words, at = text.lower(), [], []
    for m in X._TOKEN.finditer(low):
        words.append(m.group())
        at.append(m.start())
    quoted, i = set(), 0
    for line in low.splitlines(keepends=True):
        k = 0
        while k < len(line):
            end = X.QUOTES.get(line[k])
            if end and end in line[k + 1 :]:
                j = line.index(end, k + 1)
                quoted |= set(range(i + k + 1, i + j))
                k = j
            k += 1
        i += len(line)
    hits = []
    for n, w in enumerate(words):
        raw = np.frombuffer(w.encode(), np.uint8)
        _, e, x = a.match(raw, np.array([0]), np.array([len(raw)]))
        if len(e) and not (e[0] > 0 and w in X.HARMLESS):
            hits.append((n, int(e[0]), float(x[0])))
    n_quoted, total, most, known = 0, 0.0, 0.0, {}
    for n, e, x in hits:
        s = x if e < 0 else 1 - 0.1 * e
        q = at[n] in quoted or any(w in X.REPORTING for w in words[max(0, n - 3) : n])
        n_quoted += q
        s *= 0.3 if q else 1.2 if any(w in X.ADDRESS for w in words[max(0, n - window) : n + window + 1]) else 1
        s *= 1.2 if any(m != n and abs(m - n) <= window for m, *_ in hits) else 1
        if e < 0:
            known[n] = s / 2 if q else s
        else:
            total, most = total + s, max(most, s)
    best = 0.0
    for n in known:
        own = [s for m, s in known.items() if n <= m < n + X.SPAN]
        best = max(best, sum(own) * min(1, len(own) / (X.RATE * min(X.SPAN, len(words)))))
    return len(hits), n_quoted, max(most, total / 2, best), [words[n] for n, *_ in hits]


def test_scores_are_those_of_the_definition():
    a = X.automaton(X.LEXICON, (("drumbelig", 0.8), ("drumberg", 0.0), ("quarzel", 0.4), ("größe", 0.8), ("grosse", 0.0)))
    rng = random.Random(4)
    pool = ["idiot", "estupido", "morom", "drumbelig", "drumbeilg", "drumberg", "quarzel", "große", "grosse", "you", "said", "crown", "w1", "w2", "w3", "w4"] + ["fine"] * 10
    for _ in range(300):
        text = "".join(rng.choice(pool) + rng.choice([" "] * 8 + ['"', ' "', " «", "» ", "„", "“ ", "\n"]) for _ in range(rng.randint(1, 60)))
        got, want = X.context(text, a), score_of(text, a)
        assert got[:2] == want[:2] and got[3] == want[3] and got[2] == pytest.approx(want[2], abs=2e-6), text


def test_many_hits_and_marks_take_linear_time():
    a = X.automaton()
    for text in ("idiot " * 300_000, '"idiot" said ' * 150_000, "«" * 1_000_000 + " idiot", '"' * 1_000_000 + " moron " * 100_000):
        start = time.time()
        assert X.context(text, a)[0] >= 1
        assert time.time() - start < 20


@pytest.mark.parametrize(("text", "toxic"), [("you are an idi0t", True), ("what an IDOIT he is", True), ('they called it "idiot" in the paper', False), ("he said idiot", False), ("a crown for the closer", False), ("so worthles and patheticc", True), ("clean words only", False), ("“moron” is a word", False)])
def test_contexts(spark, text, toxic):
    assert X.toxicity(documents(spark, [text])).first().toxic is toxic


def test_awkward_rows(spark):
    got = X.toxicity(awkward(spark)).collect()
    assert len(got) == 13 and not any(r.toxic for r in got) and sum(r.toxic is None for r in got) == 2
    assert all(r.n_hits == 0 and r.terms == [] for r in got if r.toxic is False)
    assert X.keep_clean(awkward(spark)).count() == 13
    assert X.toxicity(empty(spark)).count() == X.keep_clean(empty(spark)).count() == 0


def test_a_late_hit_in_a_long_text_counts(spark):
    df = documents(spark, ["fine " * 400_000 + "you scum", "fine " * 400_000])
    assert [r.doc_id for r in X.keep_clean(df).collect()] == [1]


def corpus(spark, n=400):
    """Toxic documents of a language use 12 words of their own, 5 in 100; one of them has 30 copies with rare words."""
    rng = random.Random(9)
    plain = [f"plain{i}" for i in range(300)]
    bad = [f"böse{i}" for i in range(12)]
    texts, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [rng.choice(bad) if toxic and rng.random() < 0.05 else rng.choice(plain) for _ in range(rng.randint(40, 200))]
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    copy = " ".join(f"rare{i}" for i in range(60)) + " böse1 böse2 böse3"
    for _ in range(30):
        labels.append((len(texts), 1))
        texts.append(copy)
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_learned_words_find_held_out_documents(spark):
    docs, labels = corpus(spark)
    learned = X.learn(docs, labels.where("doc_id % 2 = 0"))
    assert {w for w, _ in learned} <= {f"böse{i}" for i in range(12)} and len(learned) >= 10
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r.toxic for r in X.toxicity(docs, labels.where("doc_id % 2 = 0")).collect() if r.doc_id % 2 == 1}
    caught = [got[i] for i in got if truth[i]]
    assert sum(caught) >= 0.9 * len(caught) and not any(got[i] for i in got if not truth[i])


def test_labels_may_be_missing_or_odd(spark):
    odd = spark.createDataFrame([(None, 1), (1, None), (4, 1), (4, 0), (99, 1)], "doc_id bigint, toxic int")
    assert X.learn(awkward(spark), odd) == () and X.learn(empty(spark), odd.limit(0)) == ()


def test_learned_words_are_misspelt_and_quoted_like_terms():
    a = X.automaton(X.LEXICON, (("drumbelig", 0.8), ("drumbeligen", 0.4), ("drumberg", 0.0), ("quarzel", 0.8)))
    score = lambda text: X.context(text, a)[2]
    assert score("drumbelg dumm drumbeilg") >= X.THRESHOLD and X.context("der drumbleig da", a)[3] == ["drumbleig"]
    assert score("quarzel") == 0.8 and score("quarzle") == score("quarzzel") == 0.72 and score("quarter") == 0
    assert score("drumbeligen") == 0.4 and X.context("am drumberg", a)[0] == 0
    assert X.context("man las „quarzel, drumbelig und quarzel“ auf dem Blatt", a)[:2] == (3, 3) and score("man las „quarzel, drumbelig und quarzel“ auf dem Blatt") < X.THRESHOLD <= score("quarzel, drumbelig und quarzel auf dem Blatt")
    assert score("sie sagte quarzel") < score("ein quarzel") < score("du quarzel")


def test_usual_words_near_learned_ones_are_no_misspelling(spark):
    texts = [f"quarzeln{'xyz'[i % 3]} w{i} quarzeln und u{i} quarzeln" for i in range(40)] + [f"ein quarzels am {i}" for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(100)], "doc_id bigint, toxic int")
    learned = dict(X.learn(documents(spark, texts), labels))
    assert learned["quarzeln"] == 0.8 and learned["quarzels"] == 0.0
    a = X.automaton(X.LEXICON, tuple(sorted(learned.items())))
    assert X.context("ein quarzels", a)[0] == 0 and X.context("ein quarzelm", a)[0] == 1


def test_a_passage_of_learned_words_counts_in_a_text_of_any_length():
    a = X.automaton(X.LEXICON, (("quarzel", 0.8),))
    passage = " ".join("quarzel und so weiter mit vielen Worten davor und danach".split()) + " "
    for k in (0, 30_000):
        text = "gut " * k + passage * 7 + "gut " * (500 - 70 + k)
        got = X.context(text, a)
        assert got[0] == 7 and got[2] == pytest.approx(5.6, abs=1e-5), k
    assert X.context(("quarzel " + "gut " * 499) * 40, a)[2] < X.THRESHOLD


def test_query_returns_every_document(spark, tmp_path):
    from urlflow.llm.queries import op1_toxicity

    documents(spark, ["you idiot", "they called it “idiot”", "clean", None]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in op1_toxicity(spark, str(tmp_path)).collect()}
    assert [got[i].toxic for i in range(4)] == [True, False, False, None] and got[1].n_quoted == 1
