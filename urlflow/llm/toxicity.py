"""Toxicity by a lexicon that tolerates misspelling, scored in context.

The lexicon is a trie over characters. Its intersection with the Levenshtein automaton
of each term's tolerance is made deterministic once (subset construction over trie node
and errors so far), so that a word costs one table lookup a character and most words
leave the automaton after two or three. A letter without its accent is one edit; whether
accents are composed or combining marks is the same. All words of a slice of texts
step together in numpy. Documents with a hit are then read again around each hit:
quotation marks and verbs of reporting lower its score, direct address and other
hits nearby raise it. Map-only: no shuffle; the table depends on the lexicon alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import DOCUMENT, narrow, small, stage_table, trim
from .words import PUNCTUATION, Words, slices

#: Terms; their tolerance follows from their length (see tolerance()).
LEXICON = (
    "idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "stupidity", "worthless", "pathetic", "disgusting", "scum", "scumbag", "trash", "clown", "clowns", "loser", "losers",
    "imbecile", "imbeciles", "asshole", "assholes", "bastard", "bastards", "bitch", "bitches", "bullshit", "cunt", "dickhead", "dumbass", "fuck", "fucker", "fucking", "jackass", "motherfucker", "retard", "retarded", "shithead", "slut", "whore", "wanker", "dipshit",
    "arschloch", "dummkopf", "hurensohn", "schlampe", "vollidiot", "wichser", "missgeburt", "drecksau",
    "connard", "connards", "connasse", "enculé", "salope", "abruti", "crétin", "ordure",
    "gilipollas", "cabrón", "pendejo", "imbécil", "estúpido", "maricón", "puta", "malparido",
)
#: Words within a term's tolerance that mean something else.
HARMLESS = frozenset("idiom idioms boron crown crowns clone closer carbon marion cretan schlappe schlappen lose loses lower laser user loner poser losel chows clows cloan clow stupor torpid studied stupe scam scud scut scup tras thrash tracsh brash crash trust trasher pathétique".split())
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›", "”": "”"}
REPORTING = frozenset("said says say wrote writes called calls calling word words term terms quote quoted quotes quoting allegedly insult insults slur slurs sagte sagt nannte schrieb wort dit écrit appelé mot terme dijo dice escribió llamó palabra término".split())
ADDRESS = frozenset("you your youre yourself u ur du dich dir dein ihr euch tu te toi ton vous votre tú usted ustedes eres".split())
#: As keyboards and evasion write letters.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t"}
#: Terms among whose neighbours are too many harmless words: only as they are.
STRICT = frozenset("whore ordure salope".split())
WINDOW = 8
THRESHOLD = 0.8
#: Labelled documents that words are learned from, at most; taken by the hash of doc_id.
SAMPLE = 50_000
#: Words before a learned word, at least, and as a share of a language's toxic documents.
LEAST, SHARE = 6, 0.05
#: Clean documents that have a word near a learned one, from which on it is no misspelling.
USUAL = 2
#: How much more frequent a learned word is in toxic documents.
RATIO = 30
#: Share of learned words from which they count in full.
RATE = 0.01
#: Words that learned words are summed over at once, so that the rest of a long text doesn't matter.
SPAN = 500
#: Letters of a learned word, at most: they bound the automaton.
LETTERS = 64
Learned = tuple[tuple[str, float], ...]
_SEPARATOR = "(?:[\\x{0}-\\x{7F}&&[^0-9a-z_]]|" + PUNCTUATION + ")+"
_MARK = re.compile(f"[{''.join(QUOTES)}]")
_TOKEN = re.compile(r"(?:[0-9A-Za-z_]|(?!" + PUNCTUATION + r")[^\x00-\x7f])+")


def composed(texts: pa.Array) -> pa.Array:
    """Texts with accents composed, where they have combining marks (U+0300 to U+036F begin with bytes 0xCC and 0xCD)."""
    a = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    raw = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    if not ((raw == 0xCC) | (raw == 0xCD)).any():
        return a
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in a.to_pylist()], a.type)


def characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and places in them for places in the bytes; bytes that aren't UTF-8 stand for themselves."""
    if not data.size or data.max() < 128:
        return data, starts, ends
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        return data, starts, ends
    before = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    return points, before[starts], before[ends]


def tolerance(term: str) -> int:
    """Edits that a term admits: none below 5 letters or in STRICT, 1 up to 9, then 2. The first letter is never edited."""
    return 0 if len(term) < 5 or term in STRICT else 1 if len(term) < 10 else 2


class Automaton:
    """step[state, character class]; state 0 is dead; best[state] is 1 + the edits of the closest term that ends here, 0 if none; extra[state] the weight of the closest learned word, less 0.1 of it an edit, 0 if none.

    Learned words have the terms' tolerance. Those of weight 0 are words near a learned
    one that mean something else: as they are, they aren't hits of learned words.
    """

    def __init__(self, lexicon: tuple[str, ...] = LEXICON, learned: Learned = ()):
        self.terms = sorted(set(lexicon))
        weight = {t: w for t, w in learned if t not in self.terms}
        used = sorted({ord(c) for t in [*self.terms, *weight] for c in t} | {ord(d) for d in LEET})
        self.classes = np.zeros(max(256, used[-1] + 2), np.int16)  # 0: a character that no term has
        for i, c in enumerate(used):
            self.classes[c] = i + 1
        nodes: list[dict[int, int]] = [{}]
        allow, final = [0], [-1]
        swaps = lambda words: {t[:i] + t[i + 1] + t[i] + t[i + 2 :]: t for t in words if tolerance(t) for i in range(1, len(t) - 1)}
        swapped = swaps(self.terms).keys() - set(self.terms)
        spelled = [(t, tolerance(t), 0) for t in self.terms] + [(t, 0, 1) for t in sorted(swapped - set(weight))]  # two letters exchanged: one edit
        spelled += [(t, tolerance(t) if w else 0, 0) for t, w in sorted(weight.items())]
        near = {t: weight[of] for t, of in swaps(sorted(w for w in weight if weight[w])).items() if t not in swapped and t not in weight and t not in self.terms}
        spelled += [(t, 0, 1) for t in sorted(near)]
        for k, (t, d, _) in enumerate(spelled):
            at = 0
            for b in map(ord, t):
                if b not in nodes[at]:
                    nodes[at][b] = len(nodes)
                    nodes.append({})
                    allow.append(0)
                    final.append(-1)
                at = nodes[at][b]
                allow[at] = max(allow[at], d)
            final[at] = k
        leet = {ord(d): {ord(c) for c in letters} for d, letters in LEET.items()}
        limit = [spelled[k][1] if k >= 0 else -1 for k in final]
        cost = [spelled[k][2] if k >= 0 else 0 for k in final]

        def close(states: dict[int, int]) -> frozenset:
            """Adds what omitted letters reach; keeps the fewest errors of each node."""
            todo = list(states.items())
            while todo:
                node, e = todo.pop()
                if node and e == states.get(node):
                    for child in nodes[node].values():
                        if e + 1 <= allow[child] and states.get(child, 99) > e + 1:
                            states[child] = e + 1
                            todo.append((child, e + 1))
            return frozenset(states.items())

        def move(now: frozenset, letter: int) -> frozenset:
            out: dict[int, int] = {}

            def put(node: int, e: int) -> None:
                if e <= allow[node] and out.get(node, 99) > e:
                    out[node] = e

            for node, e in now:
                for b, child in nodes[node].items():
                    put(child, e if b == letter or b in leet.get(letter, ()) else e + 1 if node else 99)
                if node:
                    put(node, e + 1)
            return close(out)

        alphabet = [-1, *used]
        start = frozenset({(0, 0)})
        number, order, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []
        at = 0
        while at < len(order):
            row = []
            for letter in alphabet:
                to = move(order[at], letter)
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            rows.append(row)
            at += 1
        self.step = np.array(rows, np.int32)
        own = [(weight | near).get(spelled[k][0]) if k >= 0 else None for k in final]
        self.best = np.array([min([e + 1 + cost[node] for node, e in s if final[node] >= 0 and e <= limit[node] and own[node] is None], default=0) for s in order], np.int8)

        def closest(s: frozenset) -> float:
            """The weight of the learned word with the fewest edits, the greatest of as many."""
            _, w, e = min([(e + cost[node], -own[node], e + cost[node]) for node, e in s if own[node] is not None and e <= limit[node]], default=(0, 0.0, 0))
            return -w * (1 - 0.1 * e)

        self.extra = np.array([closest(s) for s in order])

    def match(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words that match, their edits (-1: a learned word) and learned words' weights, less what their edits take."""
        points, starts, ends = characters(data, starts, ends)
        cls = self.classes[points if points.dtype == np.uint8 else np.minimum(points, len(self.classes) - 1)]
        alive, state, at = np.arange(len(starts)), np.ones(len(starts), np.int32), starts.copy()
        found, edits, extra = [], [], []
        while len(alive):
            state = self.step[state, cls[at]]
            live = state > 0
            alive, state, at = alive[live], state[live], at[live] + 1
            over = at == ends[alive]
            if over.any():
                hit = over & ((self.best[state] > 0) | (self.extra[state] > 0))
                found.append(alive[hit])
                edits.append(self.best[state[hit]] - 1)
                extra.append(self.extra[state[hit]])
                alive, state, at = alive[~over], state[~over], at[~over]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0)
        f, e, x = np.concatenate(found), np.concatenate(edits), np.concatenate(extra)
        order = np.argsort(f)
        return f[order], e[order], x[order]


@lru_cache(maxsize=4)
def automaton(lexicon: tuple[str, ...] = LEXICON, learned: Learned = ()) -> Automaton:
    return Automaton(lexicon, learned)


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """What stands between a quotation mark and its counterpart in the same line; ascending and apart."""
    out, base = [], 0
    for line in text.splitlines(keepends=True):
        missing, at = set(), 0
        for m in _MARK.finditer(line):
            end = QUOTES[m.group()]
            if m.start() < at or end in missing:
                continue
            if (j := line.find(end, m.end())) > 0:
                out.append((base + m.start(), base + j))
                at = j + 1
            else:
                missing.add(end)
        base += len(line)
    return out


def context(text: str, a: Automaton, window: int = WINDOW) -> tuple[int, int, float, list[str]]:
    """Hits, quoted hits, score and terms of a text with a hit.

    A hit counts 1, or a learned word's weight, less 0.1 of it an edit. In quotation
    marks, or within 3 words after a verb of reporting, it counts 0.3 times that. A word
    of address in the window adds 0.2 times, another hit there too. The score is the
    greater of the highest hit and half the sum of all, of the terms. Learned words are
    summed instead, quoted ones by half, over every SPAN words (a shorter text's words),
    and scaled down where they are fewer than RATE of these; the greatest of such sums
    counts if it is greater.
    """
    low = unicodedata.normalize("NFC", text.lower())
    spans = [m.span() for m in _TOKEN.finditer(low)]
    words = [low[x:y] for x, y in spans]
    raw = [w.encode("utf-8", "replace") for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(size)
    hits, edits, extra = a.match(np.frombuffer(b"".join(raw), np.uint8), ends - size, ends)
    keep = [i for i, h in enumerate(hits.tolist()) if not (edits[i] > 0 and words[h] in HARMLESS)]
    hits, edits, extra = hits[keep], edits[keep], extra[keep]
    marks = np.array(quoted_spans(low) if len(hits) else [], np.int64).reshape(-1, 2)
    place = np.array([spans[h][0] for h in hits.tolist()], np.int64)
    inside = np.searchsorted(marks[:, 0], place, "left") - 1
    in_marks = (inside >= 0) & (place < np.append(marks[:, 1], 0)[inside])
    others = np.searchsorted(hits, hits + window, "right") - np.searchsorted(hits, hits - window, "left") > 1
    n_quoted, total, most, known, terms = 0, 0.0, 0.0, [], []
    for h, e, x, quoted, other in zip(hits.tolist(), edits.tolist(), extra.tolist(), in_marks.tolist(), others.tolist(), strict=True):
        s = x if e < 0 else 1 - 0.1 * e
        if quoted := quoted or not REPORTING.isdisjoint(words[max(0, h - 3) : h]):
            n_quoted += 1
            s *= 0.3
        elif not ADDRESS.isdisjoint(words[max(0, h - window) : h + window + 1]):
            s *= 1.2
        if other:
            s *= 1.2
        if e < 0:
            known.append((h, s / 2 if quoted else s))
        else:
            total, most = total + s, max(most, s)
        terms.append(words[h])
    return len(hits), n_quoted, round(max(most, total / 2, _densest(known, len(words))), 6), terms


def _densest(known: list[tuple[int, float]], n_words: int) -> float:
    """The greatest scaled sum of learned words over SPAN words that begin with one; known: place and score of each."""
    if not known:
        return 0.0
    at, s = (np.array(x) for x in zip(*known, strict=True))
    upto, i = np.concatenate([[0.0], np.cumsum(s)]), np.arange(len(at))
    j = np.searchsorted(at, at + SPAN, "left")
    return float(((upto[j] - upto[i]) * np.minimum(1.0, (j - i) / (RATE * min(SPAN, n_words)))).max())


def _judge(batch: pa.RecordBatch, lexicon: tuple[str, ...], window: int, learned: Learned = ()) -> dict[int, tuple[int, int, float, list[str]]]:
    """Row number to context(), for rows with a hit."""
    a, out = automaton(lexicon, learned), {}
    w = Words(composed(batch.column("text")), hashes=False)
    hits, *_ = a.match(w.data, w.starts, w.ends)
    for i in np.unique(np.searchsorted(w.offsets, hits, "right") - 1).tolist():
        got = context(batch.column("text")[i].as_py(), a, window)
        if got[0]:
            out[i] = got
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: int = LEAST, share: float = SHARE, ratio: float = RATIO, usual: int = USUAL, letters: int = LETTERS) -> Learned:
    """Words of toxic documents and their weights, from `sample` labelled documents at most.

    A word is learned in a language if toxic documents have `least` different words before
    it (so that copies of one document count once), and as many as `share` of the
    language's toxic documents, and if its share of these (by documents or places, which
    are fewer) is `ratio` times its share of the clean ones.
    Words that clean documents never have weigh 0.8, others 0.4. Words within the
    tolerance of a learned one that `usual` clean documents have weigh 0: they mean
    something else. Words of more than `letters` letters aren't learned. Null ids, labels and texts teach nothing; of an id's labels the
    greatest counts.
    """
    marked = narrow(labels, {"doc_id": "bigint", "toxic": "int"}).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    held = narrow(docs, {"doc_id": "bigint", "text": "string", "lang": "string"}).where("text IS NOT NULL")
    words = F.filter(F.split(F.lower("text"), _SEPARATOR), lambda x: x != "")
    rows = held.join(F.broadcast(marked), "doc_id").select(F.coalesce("lang", F.lit("")).alias("lang"), (F.col("toxic") > 0).alias("toxic"), words.alias("words"))  # `sample` rows
    rows = stage_table(rows, "labelled")
    pair = F.arrays_zip(F.concat(F.array(F.lit("")), "words").alias("before"), F.col("words").alias("word"))
    places = rows.where("toxic").select("lang", F.explode(pair).alias("p")).select("lang", "p.before", "p.word").where(F.length("word") <= letters).distinct()
    many = places.groupBy("lang", "word").agg(F.count("*").alias("places")).where(F.col("places") >= least)
    size = rows.groupBy("lang").agg(F.sum(F.col("toxic").cast("bigint")).alias("n_toxic"), F.sum((~F.col("toxic")).cast("bigint")).alias("n_clean"))
    often = stage_table(many.join(F.broadcast(size), "lang").where(F.col("places") >= share * F.col("n_toxic")), "learnable")  # a row a language
    each = rows.select("lang", "toxic", F.explode(F.array_distinct("words")).alias("word")).join(small(often.select("lang", "word")), ["lang", "word"], "left_semi")
    both = often.join(each.groupBy("lang", "word").agg(*[F.sum(c.cast("bigint")).alias(n) for c, n in ((F.col("toxic"), "documents"), (~F.col("toxic"), "clean"))]), ["lang", "word"])
    times = ((F.least("places", "documents") + 0.5) / (F.col("n_toxic") + 1)) / ((F.col("clean") + 0.5) / (F.col("n_clean") + 1))
    found = both.where(times >= ratio).groupBy("word").agg(F.min(F.when((F.col("clean") == 0) & (F.col("places") >= 8), 0.8).otherwise(0.4)).alias("weight"))
    learned = {r["word"]: r["weight"] for r in found.collect()}  # of `sample` documents
    if not learned:
        return ()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton((), tuple(sorted(learned.items())))
        for b in batches:
            counts = b.column("words").flatten().value_counts()
            words = Words(counts.field(0), hashes=False)
            at = np.unique(np.searchsorted(words.offsets, a.match(words.data, words.starts, words.ends)[0], "right") - 1)
            yield pa.RecordBatch.from_arrays([x.take(pa.array(at)) for x in counts.flatten()], names=["word", "n"])

    usual_words = rows.where("NOT toxic").select(F.array_distinct("words").alias("words")).mapInArrow(near, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= usual)
    return tuple(sorted(({r["word"]: 0.0 for r in usual_words.collect()} | learned).items()))


def toxicity(docs: DataFrame, labels: DataFrame | None = None, lexicon: tuple[str, ...] = LEXICON, threshold: float = THRESHOLD, window: int = WINDOW, **how) -> DataFrame:
    """doc_id, n_hits, n_quoted, score, toxic and terms (as written, lower-cased, in order) of every row.

    toxic: score >= threshold. A null text has nulls but for doc_id; a text without
    words or hits has 0, 0, 0.0, false and an empty list. A null doc_id stays null.
    Repeated rows are repeated. Extra columns are dropped. labels (doc_id, toxic): see learn().
    """
    learned = learn(docs, labels, **how) if labels is not None else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                got, null = _judge(b, lexicon, window, learned), ~np.asarray(b.column("text").is_valid())
                rows = [got.get(i, (0, 0, 0.0, [])) for i in range(b.num_rows)]
                col = lambda k, kind: pa.array([r[k] for r in rows], kind, mask=null)  # noqa: B023, E731
                toxic = pa.array([r[2] >= threshold for r in rows], pa.bool_(), mask=null)
                terms = pa.array([None if z else r[3] for r, z in zip(rows, null, strict=True)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), col(0, pa.int32()), col(1, pa.int32()), col(2, pa.float64()), toxic, terms], names=["doc_id", "n_hits", "n_quoted", "score", "toxic", "terms"])
        trim()

    return narrow(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(run, "doc_id bigint, n_hits int, n_quoted int, score double, toxic boolean, terms array<string>")


def keep_clean(docs: DataFrame, labels: DataFrame | None = None, lexicon: tuple[str, ...] = LEXICON, threshold: float = THRESHOLD, window: int = WINDOW, **how) -> DataFrame:
    """The columns of documents, without the rows that toxicity() calls toxic; null texts stay."""
    learned = learn(docs, labels, **how) if labels is not None else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                keep = np.ones(b.num_rows, bool)
                for i, got in _judge(b, lexicon, window, learned).items():
                    keep[i] = got[2] < threshold
                yield b.filter(pa.array(keep))
        trim()

    return narrow(docs, DOCUMENT).mapInArrow(run, ", ".join(f"{c} {k}" for c, k in DOCUMENT.items()))
