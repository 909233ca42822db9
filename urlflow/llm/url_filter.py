"""URL filter: character models of accepted and rejected URLs, compared by likelihood.

URLs are accepted or rejected by what their page holds (page_labels). Over all labelled
URLs, every run of 1 to ORDER + 1 bytes is counted by class and by half of the URLs; the
counts grow with the input and are summed by a shuffle. The model of a class backs off
from the longest context seen LEAST times or more to shorter ones (Witten-Bell), so its
order varies by place. A URL is scored by the counts of the other half, which it took no
part in: mean over its bytes of the logarithm of P(byte | accepted) / P(byte | rejected).
The threshold keeps KEEP of the accepted URLs, by the exact distribution of their scores.

Counts of up to `most_rows` runs are broadcast and scoring needs no shuffle; beyond that
each URL's runs are joined with the counts. Both ways give the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import narrow, stage_table, trim
from .words import mix, slices

ORDER = 5
LEAST = 2
KEEP = 0.95
MOST_ROWS = 1 << 20
#: Bytes of URLs scored at once: some 1,200 bytes of tables each.
_AT_ONCE = 1 << 15
_PAD, _END = 2, 3
#: Classes and halves: c counts a run, t the distinct bytes seen after it, n its occurrences as context.
GROUPS = ("a0", "a1", "r0", "r1")
_MODEL = [f"{k}{g}" for g in GROUPS for k in "cnt"]


def page_labels(html: Column) -> Column:
    """True for pages with 200 characters or more of prose in paragraphs, nine tenths of them letters and spaces and three tenths of its words distinct; null for a null page."""
    prose = F.array_join(F.regexp_extract_all(html, F.lit("<p>([^<]*)</p>"), F.lit(1)), " ")
    words = F.split(F.trim(prose), "\\s+")
    letters = F.length(F.regexp_replace(prose, "[^\\p{L}\\s]", ""))
    return (F.length(prose) >= 200) & (letters >= 0.9 * F.length(prose)) & (F.size(F.array_distinct(words)) >= 0.3 * F.size(words))


class Runs:
    """Keys of the runs that end at some bytes of a batch of URLs, and of their contexts, by length; url has the bytes' URLs."""

    def __init__(self, data: np.ndarray, own: np.ndarray, url: np.ndarray, order: int):
        self.url, at = url, np.flatnonzero(own)
        self.keys = [np.full(len(at), mix(np.zeros(1, np.uint64), 40)[0])]
        self.context = [self.keys[0]]
        data, h = data.astype(np.uint64), np.zeros(len(data), np.uint64)
        with np.errstate(over="ignore"):
            power = np.uint64(1)
            for n in range(1, order + 2):
                shifted = np.zeros(len(data), np.uint64)
                shifted[n - 1 :] = data[: len(data) - n + 1]
                h = h + (shifted + np.uint64(1)) * power
                power = power * np.uint64(0x100000001B3)
                k = mix(h, 40 + n)
                self.keys.append(k[at])
                self.context.append(k[at - 1])


def pieces(urls: pa.Array, order: int, most: int) -> Iterator[Runs]:
    """Runs of all bytes, of about `most` at a time, however long a URL is. An end mark follows each URL, `order` marks precede it."""
    parts = [bytes([_PAD]) * order + u.encode() + bytes([_END]) for u in pc.fill_null(urls.cast(pa.large_string()), "").to_pylist()]
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(size) - size
    own = np.ones(len(data), bool)
    for k in range(order):
        own[first + k] = False
    for a in range(0, len(data), most):
        b, lead = min(a + most, len(data)), min(a, order + 1)
        mine = own[a - lead : b].copy()
        mine[:lead] = False
        at = np.flatnonzero(mine)
        if len(at):
            yield Runs(data[a - lead : b], mine, np.searchsorted(first, at + a - lead, "right") - 1, order)


def _count(order: int):
    """Runs of a partition's labelled URLs: key, context key, and counts by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "url", 1 << 20):
                group = np.where(b.column("accepted").to_numpy(zero_copy_only=False).astype(bool), 0, 2) + b.column("half").to_numpy(zero_copy_only=False)
                for r in pieces(b.column("url"), order, 1 << 18):
                    g = np.tile(group[r.url], order + 1)
                    key, ctx = np.concatenate(r.keys[1:]), np.concatenate(r.context[: order + 1])
                    uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
                    counts = np.bincount(inverse * 4 + g, minlength=4 * len(uniq)).reshape(-1, 4)
                    yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(ctx[first].view(np.int64))] + [pa.array(counts[:, i]) for i in range(4)], names=["key", "context", *(f"c{x}" for x in GROUPS)])
        trim()

    return run


def train(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """Staged model: key, and c, n, t by group. labelled: url, accepted, half."""
    kind = "key bigint, context bigint, " + ", ".join(f"c{g} bigint" for g in GROUPS)
    runs = stage_table(labelled.mapInArrow(_count(order), kind).groupBy("key").agg(F.first("context").alias("context"), *[F.sum(f"c{g}").alias(f"c{g}") for g in GROUPS]), "url-runs")
    follow = runs.groupBy(F.col("context").alias("key")).agg(*[x for g in GROUPS for x in (F.sum(f"c{g}").alias(f"n{g}"), F.sum((F.col(f"c{g}") > 0).cast("bigint")).alias(f"t{g}"))])
    return stage_table(runs.drop("context").join(follow, "key", "full").select("key", *[F.coalesce(c, F.lit(0)).alias(c) for c in _MODEL]), "url-model")


def likelihood(urls: pa.Array, half: np.ndarray, keys: np.ndarray, table: np.ndarray, order: int, least: int, salt: np.ndarray | None = None) -> np.ndarray:
    """Score of each URL. keys ascend; table has their counts as in _MODEL; salt is mixed into the keys of each URL."""
    total, size = np.zeros(len(half)), np.zeros(len(half), np.int64)
    for r in pieces(urls, order, _AT_ONCE):
        other = 1 - half[r.url]
        out = []
        look = lambda k: _find(keys, table, k if salt is None else mix(k ^ salt[r.url]))  # noqa: B023, E731
        ctx, run = [look(x) for x in r.context[:-1]], [look(x) for x in r.keys[1:]]
        for c in (0, 2):
            at = 3 * (c + other)
            p, live = np.full(len(r.url), 1 / 257), np.ones(len(r.url), bool)
            for x, y in zip(ctx, run, strict=True):
                seen, n, t = np.take_along_axis(y, at[:, None], 1)[:, 0], np.take_along_axis(x, at[:, None] + 1, 1)[:, 0], np.take_along_axis(x, at[:, None] + 2, 1)[:, 0]
                live &= n >= least
                p = np.where(live, (seen + t * p) / np.maximum(n + t, 1), p)
            out.append(np.log(p))
        total += np.bincount(r.url, out[0] - out[1], len(half))
        size += np.bincount(r.url, minlength=len(half))
    return total / np.maximum(size, 1)


def _find(keys: np.ndarray, table: np.ndarray, k: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros((len(k), len(_MODEL)), np.int64)
    i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    return np.where((keys[i] == k)[:, None], table[i], 0)


def _score(b: pa.RecordBatch, keys: np.ndarray, table: np.ndarray, order: int, least: int, salt: np.ndarray | None = None) -> pa.RecordBatch:
    s = np.round(likelihood(b.column("url"), b.column("half").to_numpy(zero_copy_only=False), keys, table, order, least, salt), 9)
    null = ~np.asarray(b.column("url").is_valid())
    return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("accepted"), pa.array(s, mask=null)], names=["page_id", "url", "accepted", "score"])


_SCORED = "page_id bigint, url string, accepted boolean, score double"


def _by_broadcast(urls: DataFrame, model: DataFrame, order: int, least: int) -> DataFrame:
    t = model.toArrow()
    keys = t.column("key").to_numpy().view(np.uint64)
    by = np.argsort(keys)
    held = urls.sparkSession.sparkContext.broadcast((keys[by], np.stack([t.column(c).to_numpy()[by] for c in _MODEL], axis=1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "url", 1 << 20):
                yield _score(b, *held.value, order, least)
        trim()

    return urls.mapInArrow(run, _SCORED)


def _by_join(urls: DataFrame, model: DataFrame, order: int, least: int) -> DataFrame:
    urls = urls.withColumn("u", F.xxhash64("url"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "url", 1 << 20):
                for r in pieces(b.column("url"), order, 1 << 18):
                    key, owner = np.concatenate(r.keys + r.context), np.tile(r.url, len(r.keys) + len(r.context))
                    by = np.lexsort((key, owner))
                    key, owner = key[by], owner[by]
                    new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
                    u = b.column("u").to_numpy()[owner[new]]
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(key[new].view(np.int64))], names=["u", "key"])
        trim()

    # A run that two pieces of a long URL have comes twice, which does no harm.
    runs = urls.select("url", "u").where("url IS NOT NULL").distinct().mapInArrow(explode, "u bigint, key bigint")
    own = runs.join(model, "key").groupBy("u").agg(F.collect_list(F.struct("key", *_MODEL)).alias("model"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for b in batches for s in slices(b, "url", 1 << 16)):
            lists = part.column("model")
            m, n = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            salt = mix(np.arange(part.num_rows, dtype=np.uint64), 3)  # each URL sees its own runs alone
            keys = mix(m.field("key").to_numpy().view(np.uint64) ^ np.repeat(salt, n))
            by = np.argsort(keys)
            yield _score(part, keys[by], np.stack([m.field(c).to_numpy()[by] for c in _MODEL], axis=1), order, least, salt)

    return urls.join(own, "u", "left").mapInArrow(run, _SCORED)


def url_filter(pages: DataFrame, order: int = ORDER, least: int = LEAST, keep: float = KEEP, most_rows: int = MOST_ROWS) -> DataFrame:
    """page_id, url, accepted (its page's label), score and kept of every page.

    kept: score >= the threshold, the greatest (to 3 digits, rounded down) that keeps
    `keep` of the accepted URLs. A null url has a null score and kept; a null html has a
    null label and trains nothing. An empty url is its end mark. Without labelled pages
    every score is 0. Without accepted ones all URLs are kept. Repeated rows count as
    often as they occur. Extra columns are dropped.
    """
    p = narrow(pages, {"page_id": "bigint", "url": "string", "html": "string"})
    half = F.pmod(F.xxhash64("url", F.lit(7)), F.lit(2)).cast("int")
    urls = stage_table(p.select("page_id", "url", page_labels(F.col("html")).alias("accepted"), half.alias("half")), "urls")
    model = train(urls.where("url IS NOT NULL AND accepted IS NOT NULL").select("url", "accepted", "half"), order)
    way = _by_broadcast if model.count() <= most_rows else _by_join
    scored = stage_table(way(urls, model, order, least), "scored")
    steps = scored.where("accepted AND score IS NOT NULL").groupBy(F.floor(F.col("score") * 1000).alias("step")).agg(F.count("*").alias("n"))
    rows = sorted(steps.collect(), key=lambda r: r["step"])  # a row a thousandth of score: at most some 10,000
    total, below, threshold = sum(r["n"] for r in rows), 0, None
    for r in rows:
        if below <= (1 - keep) * total:
            threshold = r["step"] / 1000
        below += r["n"]
    kept = F.col("score") >= F.lit(threshold) if threshold is not None else F.col("score").isNotNull()
    return scored.withColumn("kept", F.when(F.col("score").isNotNull(), kept))
