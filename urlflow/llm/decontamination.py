"""Benchmark decontamination: passages of documents within a few word edits of a benchmark item.

Windows of an item's size are compared with it in four steps:

1. Seeds. An item of n words that may differ in d edits is d + 1 pieces, one of which
   occurs unchanged, so a window near an item shares a run of q = n // (d + 1) words with
   it (SEED at most). Runs are looked up in a bitmap, then in a sorted table; a run's
   offsets give where the window begins. An edit breaks q runs at most, so windows with
   fewer of the item's runs around them than d edits leave are passed over. This step
   loses nothing; it spares embedding every window of the corpus for every size.
2. CGK. A random walk over the window's words writes each word zero, one or more times
   (a bit of (position, word) says when to move on) and maps edit to Hamming distance.
3. LSH. Each repetition samples positions of the embedding; a window whose sample
   equals the item's is a candidate. For each size of items, positions a sample and
   repetitions are chosen so that `recall` of items edited up to their limit are found:
   fewer positions where many edits leave few of them alike, and as many repetitions as
   it takes, measured on edited items and again on fresh ones. Beyond LONG words the
   count of runs alone, which loses nothing, is the filter.
4. Candidates are verified by exact edit distance, ends free, at the window and d words
   around it.

Map-only over documents; items are broadcast in portions of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import DOCUMENT, narrow, small, stage_table, trim
from .words import Words, mix, slices, windows

RATE = 0.2
SEED = 4
#: Positions a sample, from the most selective; the last is used with as many repetitions as it takes.
SAMPLES = (3, 2, 1)
#: Repetitions from which fewer positions are tried.
MANY = 48
RECALL = 0.99
#: Words of items beyond which runs are counted but embeddings not sampled.
LONG = 128
PORTION_WORDS = 1 << 22


def allowed(n: int, rate: float = RATE) -> int:
    """Edits that an item of n words may have."""
    return int(rate * n + 1e-9)


def seed_length(n: int, d: int, seed: int = SEED) -> int:
    """Words of a run that d edits leave whole somewhere in n words."""
    return min(seed, max(1, n // (d + 1)))


def embed(x: np.ndarray, steps: int, repeat: int) -> np.ndarray:
    """CGK embeddings of rows of words, `steps` long; 0 past the end."""
    m, n = x.shape
    padded = np.concatenate([x, np.zeros((m, 1), np.uint64)], axis=1)
    at, out, rows = np.zeros(m, np.int64), np.empty((m, steps), np.uint64), np.arange(m)
    for j in range(steps):
        c = padded[rows, at]
        out[:, j] = c
        at = np.minimum(at + (mix(c, 1000 * repeat + j) & np.uint64(1)).astype(np.int64), n)
    return out


def positions(n: int, repeat: int, sample: int) -> np.ndarray:
    """Sampled positions of the embedding of n words in a repetition; ascending. They fall where nearly every walk still has words."""
    return np.sort((mix(np.arange(sample, dtype=np.uint64), 7919 * (repeat + 1) + n) % np.uint64(max(1, 2 * n - n // 4))).astype(np.int64))


def sampled(x: np.ndarray, repeat: int, sample: int) -> np.ndarray:
    """The samples of rows of words in a repetition."""
    p = positions(x.shape[1], repeat, sample)
    return embed(x, int(p[-1]) + 1, repeat)[:, p]


def _edited(words: np.ndarray, d: int, rng: np.random.Generator) -> np.ndarray:
    """The words with d random edits, between d and more words of other text."""
    out = words.tolist()
    for place, kind, new in zip(rng.random(d).tolist(), rng.integers(0, 3, d).tolist(), rng.integers(1, 1 << 62, d).tolist(), strict=True):
        i = int(place * len(out))
        if kind == 0:
            out[i] = new
        elif kind == 1 and len(out) > 1:
            del out[i]
        else:
            out.insert(i, new)
    side = lambda k: rng.integers(1, 1 << 62, k).astype(np.uint64)
    return np.concatenate([side(d + 1), np.array(out, np.uint64), side(len(words) + d)])


class Item(NamedTuple):
    key: int
    words: np.ndarray
    d: int


def _trials(items: list[Item], q: int, trials: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of the trials, windows at which seeds find them when edited, and trial of each window."""
    n, x, y, of = len(items[0].words), [], [], []
    for k in range(trials):
        item = items[k * len(items) // trials] if len(items) > trials else items[k % len(items)]
        text = _edited(item.words, item.d, rng)
        same = np.ones((n - q + 1, len(text) - q + 1), bool)
        for j in range(q):
            same &= item.words[j : n - q + 1 + j, None] == text[None, j : len(text) - q + 1 + j]
        offset, at = np.nonzero(same)
        start = np.unique(at - offset)
        start = start[(start >= 0) & (start + n <= len(text))]
        x.append(text[start[:, None] + np.arange(n)])
        y.append(item.words)
        of.append(np.full(len(start), k))
    return np.stack(y), np.concatenate(x), np.concatenate(of)


def _needed(trial: tuple[np.ndarray, np.ndarray, np.ndarray], sample: int, recall: float, most: int) -> int | None:
    """Repetitions after which `recall` of the trials have a window with the item's sample; None if `most` are too few."""
    items, x, of = trial
    missed = np.ones(len(items), bool)
    for r in range(most):
        got = sampled(items[missed], r, sample)
        same = (sampled(x, r, sample) == got[np.cumsum(missed)[of] - 1]).all(axis=1)
        missed[of[same]] = False
        x, of = x[missed[of]], of[missed[of]]
        if missed.sum() <= (1 - recall) * len(items):
            return r + 1
    return None


def repeats(items: list[Item], q: int, recall: float = RECALL, trials: int = 200) -> tuple[int, int]:
    """Positions a sample and repetitions for items of one size. Raises ValueError if no number of repetitions reaches `recall`."""
    n = len(items[0].words)
    rng = np.random.default_rng(5)
    first, fresh = (_trials(items, q, trials, rng) for _ in range(2))
    for sample in SAMPLES:
        most = MANY if sample > SAMPLES[-1] else 64 * n
        got = [_needed(t, sample, recall, most) for t in (first, fresh)]
        if None not in got:
            return sample, max(got)
    raise ValueError(f"decontamination: items of {n} words don't reach a recall of {recall}")


class Size(NamedTuple):
    """Items of n words with d edits: their rows in items, words, and samples (item, repetition, position), none beyond LONG words."""

    n: int
    d: int
    q: int
    own: np.ndarray
    words: np.ndarray
    samples: np.ndarray


class Index:
    def __init__(self, items: list[Item], seed: int = SEED, recall: float = RECALL):
        self.items, by_size = items, {}
        for k, i in enumerate(items):
            by_size.setdefault((len(i.words), i.d), []).append(k)
        self.sizes: list[Size] = []
        self.size_of, self.row_of = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        for (n, d), own in sorted(by_size.items()):
            q, words = seed_length(n, d, seed), np.stack([items[k].words for k in own])
            if n > LONG:
                samples = np.zeros((len(own), 0, 0), np.uint64)
            else:
                sample, times = repeats([items[k] for k in own], q, recall)
                samples = np.stack([sampled(words, r, sample) for r in range(times)], axis=1)
            self.size_of[own], self.row_of[own] = len(self.sizes), np.arange(len(own))
            self.sizes.append(Size(n, d, q, np.array(own), words, samples))
        self.seeds = {}
        for q in sorted({s.q for s in self.sizes}):
            runs, owner, offset = [], [], []
            for s in self.sizes:
                for k in s.own.tolist() if s.q == q else ():
                    w = windows(items[k].words, q)
                    runs.append(w)
                    owner.append(np.full(len(w), k))
                    offset.append(np.arange(len(w)))
            runs, owner, offset = np.concatenate(runs), np.concatenate(owner), np.concatenate(offset)
            by = np.argsort(runs, kind="stable")
            bits = np.zeros(max(1 << 20, 1 << int(8 * len(runs)).bit_length()), bool)
            bits[(runs & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            self.seeds[q] = (bits, runs[by], owner[by], offset[by])

    def windows(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items and where they would begin, for every run of words of h that an item has, each once and in order; and how many runs each has."""
        keys, shift = [], 1 << 24
        for q, (bits, runs, owner, offset) in self.seeds.items():
            g = windows(h, q)
            at = np.flatnonzero(bits[(g & np.uint64(len(bits) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(runs, g[at], "left"), np.searchsorted(runs, g[at], "right")
            n = hi - lo
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            keys.append((owner[which].astype(np.int64) << 32) + (np.repeat(at, n) - offset[which] + shift))
        key, count = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64),) * 2
        return key >> 32, (key & 0xFFFFFFFF) - shift, count

    def search(self, h: np.ndarray, offsets: np.ndarray, lsh: bool = True) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first word, words, edits) of the best passage of each document and item within reach."""
        item, start, runs = self.windows(h)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        ends, size_of = offsets[1:], self.size_of[item]
        for z in np.unique(size_of).tolist():
            s, mine = self.sizes[z], size_of == z
            k, at, have = item[mine], start[mine], np.concatenate([[0], np.cumsum(runs[mine])])
            # Of n - q + 1 runs an edit breaks q at most; the others begin within d words of each other's start.
            key = (k << 32) + at
            near = have[np.searchsorted(key, key + s.d, "right")] - have[np.searchsorted(key, key - s.d, "left")]
            enough = near >= s.n - s.q + 1 - s.q * s.d
            k, at = k[enough], at[enough]
            # A run lies in the document of its words: for a start before it or an end after it, other documents' words are masked.
            docs = [np.searchsorted(ends, np.clip(x, 0, len(h) - 1), "right") for x in (at, at + s.n - 1)]
            several = range_union(*docs)
            spans = np.unique(np.concatenate([np.stack([k, at, x], axis=1) for x in several]), axis=0) if len(several) > 1 else np.stack([k, at, docs[0]], axis=1)
            step = max(1, min(4096, (1 << 20) // s.n))
            for i in range(0, len(spans), step):
                self._some(h, offsets, s, spans[i : i + step], best, lsh)
        return [(doc, k, first, length, e) for (doc, k), (e, first, length) in sorted(best.items())]

    def _some(self, h: np.ndarray, offsets: np.ndarray, s: Size, spans: np.ndarray, best: dict, lsh: bool) -> None:
        k, start, doc = spans.T
        lo, hi, row = offsets[doc], offsets[doc + 1], self.row_of[k]
        pick = start[:, None] + np.arange(s.n)
        own = (pick >= lo[:, None]) & (pick < hi[:, None])
        x = np.where(own, h[np.clip(pick, 0, len(h) - 1)], np.uint64(0))
        keep = own.sum(axis=1) >= s.n - s.d
        if lsh and s.samples.shape[1]:
            near = (x == s.words[row]).all(axis=1)  # the sample of equal windows is equal
            for r in range(s.samples.shape[1]):
                left = np.flatnonzero(keep & ~near)
                if not len(left):
                    break
                near[left] = (sampled(x[left], r, s.samples.shape[2]) == s.samples[row[left], r]).all(axis=1)
            keep &= near
        i = np.flatnonzero(keep)
        if not len(i):
            return
        a, b = np.maximum(lo[i], start[i] - s.d), np.minimum(hi[i], start[i] + s.n + s.d)
        text = a[:, None] + np.arange(s.n + 2 * s.d)
        e, first, length = closest(s.words[row[i]], h[np.minimum(text, len(h) - 1)], b - a)
        for j in np.flatnonzero(e <= s.d).tolist():
            got, key = (int(e[j]), int(a[j] + first[j] - lo[i[j]]), int(length[j])), (int(doc[i[j]]), int(k[i[j]]))
            if key not in best or got < best[key]:
                best[key] = got


def range_union(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Numbers of every document from a to b, elementwise, as arrays as long as a (the last repeated)."""
    return [np.minimum(a + i, b) for i in range(int((b - a).max(initial=0)) + 1)]


def closest(items: np.ndarray, texts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits, begin and length of the run of each row's first `sizes` words of text that is closest to the row's item; the first of the least."""
    m, w = texts.shape
    cols = np.arange(w + 1)
    row, begin = np.zeros((m, w + 1), np.int32), np.tile(cols, (m, 1))
    edge = np.zeros((m, 1), np.int32)
    for i in range(items.shape[1]):
        take = np.concatenate([edge + (i + 1), row[:, :-1] + (texts != items[:, i : i + 1])], axis=1)
        skip = row + 1
        least = np.minimum(take, skip)
        start = np.where(take <= skip, np.concatenate([edge, begin[:, :-1]], axis=1), begin)
        run = np.minimum.accumulate(least - cols, axis=1)
        src = np.maximum.accumulate(np.where(least - cols == run, cols, 0), axis=1)
        row, begin = (run + cols).astype(np.int32), np.take_along_axis(start, src, 1)
    row = np.where(cols <= sizes[:, None], row, np.iinfo(np.int32).max)
    e, at = row.argmin(axis=1), np.arange(m)
    return row[at, e], begin[at, e], e - begin[at, e]


def _items(benchmark: DataFrame, portion: int, rate: float) -> Iterator[list[Item]]:
    """Items with words, in portions of about `portion` words; an item's id and text may repeat."""
    now, held, rows = [], 0, []

    def read() -> None:
        nonlocal held
        w = Words(pa.array([r["text"] for r in rows], pa.string()))
        for k, r in enumerate(rows):
            if len(w.of(k)):
                now.append(Item(r["item_id"], w.of(k), allowed(len(w.of(k)), rate)))
                held += len(w.of(k))
        rows.clear()

    for row in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        rows.append(row)
        if len(rows) >= 256:
            read()
        if held >= portion:
            yield now
            now, held = [], 0
    if rows:
        read()
    if now:
        yield now


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, seed: int = SEED, recall: float = RECALL, portion: int = PORTION_WORDS) -> DataFrame:
    """doc_id, item_id, first_word, n_words and edits of the closest passage of each document and item within allowed() edits: rate * n for an item of n words.

    Words are compared, so case, punctuation and white space don't count. Of passages as
    close the first counts. Items without words, null items and null item_ids
    match nothing; null texts and texts without words have no passage. A null doc_id
    stays null. Rows that repeat are repeated; an item_id that repeats with another
    text is an item of its own. Extra columns are dropped.
    """
    docs = narrow(docs, {"doc_id": "bigint", "text": "string"})
    spark, kind = docs.sparkSession, "doc_id bigint, item_id bigint, first_word bigint, n_words int, edits int"
    out = spark.createDataFrame([], kind)
    for items in _items(narrow(benchmark, {"item_id": "bigint", "text": "string"}), portion, rate):
        index = spark.sparkContext.broadcast(Index(items, seed, recall))  # of `portion` words at most

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in slices(whole, "text"):
                    w = Words(b.column("text"))
                    rows = index.value.search(w.hashes, w.offsets) if len(w.hashes) else []
                    if rows:
                        doc, item, first, n, e = zip(*rows, strict=True)
                        keys = [index.value.items[k].key for k in item]
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(keys, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int32()), pa.array(e, pa.int32())], names=["doc_id", "item_id", "first_word", "n_words", "edits"])
            trim()

        out = out.unionByName(docs.mapInArrow(run, kind))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The columns of documents, without the rows that have a passage of the benchmark."""
    docs = narrow(docs, DOCUMENT)
    key = F.xxhash64("doc_id", "text")
    found = stage_table(matches(docs.select(key.alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias("__row")).distinct(), "contaminated")
    return docs.withColumn("__row", key).join(small(found), "__row", "left_anti").select(*DOCUMENT)
