"""Passages that repeat across documents, by a logarithmic family of sparse suffix arrays.

A passage of `length` words holds `length - depth + 1` suffixes that share their first
`depth` words with those of its copy. Of every such run of suffixes the ones whose first
`depth` words hash lowest are indexed, so that two copies of a passage index the same
suffix: about one in thirteen is. A suffix is held as the codes (a byte each, never 0,
which ends a document) of its first words, and suffixes are in lexicographic order of
their words' codes. Equal words have equal codes, so the common prefix of two entries is
never shorter than that of their suffixes.

A new batch of documents gets a suffix array, cut into buckets by ranges of the order. In
one pass it is merged bucket by bucket with the levels of the family and scanned:
neighbours with a common prefix of `depth` words, at least one of them new, are matches,
and the greater prefix with a neighbour bounds how far a match goes. The batch enters at
level 0, and levels of equal size merge into the next in the same pass, so that a suffix is
rewritten a logarithmic number of times. Of a beginning that many documents have in full, an array keeps the
least and the greatest document, before it is first sent: the others are matches anyway.

Matches are verified in the texts: the windows of `length` words that a match's bound
allows around its suffix are compared by hash, and equal windows of different documents
mark their words. Each task sends a window once, with its least document, and learns
whether others have it; so a passage that many documents share is no large group.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import discard, made, narrow, new_path, remove, stage_table, trim
from .grams import planes, unplanes
from .ngram_join import _parts, buckets, estimated
from .words import Words, mix, rolling, slices

LENGTH = 50
DEPTH = 25
BATCHES = 4
#: Bytes of text, for each bucket, from which the bounds of the buckets are taken; they affect balance alone.
SAMPLE_BYTES = 1_000
_FLUSH = 1 << 20
_ARRAY = "bucket int, suffixes binary, docs binary"
_PASS = ("bucket", "suffixes", "docs", "found_docs", "found_suffixes", "shared")
_MATCHES = "doc_id bigint, suffix bigint, shared int"
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def n_codes(depth: int) -> int:
    """Words whose codes an entry holds."""
    return 8 * (depth // 8 + 1)


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each w neighbours, from the left; len(x) - w + 1 values."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def lowest(w: Words, length: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the first `depth` words at every word (_NONE where a document ends before), the least of each window of `length` words from its first, and documents of the words."""
    h = w.hashes
    owner = np.repeat(np.arange(len(w)), np.diff(w.offsets))
    first = np.full(len(h), _NONE)
    g = rolling(h, depth)
    if len(g):
        inside = owner[: len(g)] == owner[depth - 1 :]
        first[: len(g)][inside] = np.minimum(g[inside], _NONE - np.uint64(1))
    span = length - depth + 1
    padded = np.concatenate([first, np.full(span - 1, _NONE)])
    return first, _sliding(padded, span, np.minimum), owner


def sampled(w: Words, length: int, depth: int, of: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words at which suffixes to index begin, and their documents; documents of fewer than `length` words have none."""
    first, least, owner = of or lowest(w, length, depth)
    span = length - depth + 1
    full = (w.offsets[owner + 1] - np.arange(len(owner))) >= length if len(owner) else np.zeros(0, bool)
    least = np.where(full, least, np.uint64(0))  # windows inside a document choose
    most = _sliding(np.concatenate([np.zeros(span - 1, np.uint64), least]), span, np.maximum)
    at = np.flatnonzero((first != _NONE) & (most == first))
    return at, owner[at]


def codes(w: Words, at: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Codes of the first k words of the suffixes at the given words, as strings of k bytes."""
    code = np.concatenate([(w.hashes >> np.uint64(56)) % np.uint64(255) + np.uint64(1), np.zeros(k, np.uint64)]).astype(np.uint8)
    out = np.lib.stride_tricks.sliding_window_view(code, k)[at]
    out[np.arange(k) >= (w.offsets[doc + 1] - at)[:, None]] = 0
    return np.ascontiguousarray(out).view(f"S{k}").ravel()


def names(keys: np.ndarray) -> np.ndarray:
    """64-bit hashes of entries' codes."""
    out = np.zeros(len(keys), np.uint64)
    for i, column in enumerate(np.ascontiguousarray(keys).view("<u8").reshape(len(keys), keys.dtype.itemsize // 8).T):
        out = mix(out ^ mix(column, 60 + i))
    return out


#: What an entry is in a pass: of a level that stays, of one that is merged, or new.
STAYS, MERGED, NEW = 0, 1, 2


class Entries(NamedTuple):
    """Suffixes in order: their codes, documents and what they are in a pass."""

    keys: np.ndarray
    docs: np.ndarray
    role: np.ndarray

    def take(self, i: np.ndarray) -> Entries:
        return Entries(self.keys[i], self.docs[i], self.role[i])


def ordered(e: Entries) -> Entries:
    return e.take(np.argsort(e.keys, kind="stable"))


def merged(a: Entries, b: Entries) -> Entries:
    """Two arrays in order as one."""
    if len(a.keys) < len(b.keys):
        a, b = b, a
    place = np.searchsorted(a.keys, b.keys, "right") + np.arange(len(b.keys))
    rest = np.ones(len(a.keys) + len(b.keys), bool)
    rest[place] = False
    out = []
    for x, y in zip(a, b, strict=True):
        z = np.empty(len(rest), x.dtype)
        z[place], z[rest] = y, x
        out.append(z)
    return Entries(*out)


def _begins(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def collapse(e: Entries) -> tuple[Entries, Entries]:
    """The least and the greatest document of every beginning, and the other documents' entries, each once."""
    group = np.repeat(np.arange(len(begin := _begins(e.keys))), np.diff(np.append(begin, len(e.keys))))
    e = e.take(np.lexsort((e.docs, group)))
    new = np.ones(len(e.keys), bool)
    new[1:] = (e.keys[1:] != e.keys[:-1]) | (e.docs[1:] != e.docs[:-1])
    e = e.take(np.flatnonzero(new))
    begin = _begins(e.keys)
    ends = np.zeros(len(e.keys), bool)
    ends[begin] = True
    ends[np.append(begin[1:], len(e.keys))[: len(begin)] - 1] = True
    return e.take(np.flatnonzero(ends)), e.take(np.flatnonzero(~ends))


def common(keys: np.ndarray) -> np.ndarray:
    """Words that each entry's codes have in common with the next one's."""
    k = keys.dtype.itemsize
    if len(keys) < 2:
        return np.zeros(0, np.int64)
    x = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, k)
    other = (x[1:] != x[:-1]) | (x[1:] == 0)
    return np.where(other.any(axis=1), other.argmax(axis=1), k)


def scan(e: Entries, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of an array that share their first `depth` words with another document's, one of such neighbours new; and the most words they share with a neighbour."""
    near = common(e.keys)
    begin = np.flatnonzero(np.concatenate([[True], near < depth])) if len(e.keys) else np.zeros(0, np.int64)
    if not len(begin):
        return begin, begin
    several = np.minimum.reduceat(e.docs, begin) != np.maximum.reduceat(e.docs, begin)
    several &= np.maximum.reduceat(e.role, begin) == NEW
    hit = np.repeat(several, np.diff(np.append(begin, len(e.keys))))
    shared = np.maximum(np.append(near, 0), np.concatenate([[0], near]))
    at = np.flatnonzero(hit)
    return at, shared[at]


def _load(t: pa.Table, k: int) -> Entries:
    """One array of all rows, each of which is in order."""
    rows = [Entries(np.frombuffer(x, f"S{k}"), d := np.frombuffer(y, np.int64), np.full(len(d), r, np.int8)) for x, y, r in zip(*(t.column(c).to_pylist() for c in ("suffixes", "docs", "role")), strict=True)]
    while len(rows) > 1:
        rows = sorted(rows, key=lambda e: len(e.keys))
        rows = [merged(rows[0], rows[1]), *rows[2:]] if len(rows) % 2 else [merged(a, b) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    return rows[0]


def _emit_suffixes(length: int, depth: int, bounds: np.ndarray):
    """Arrays of a task's suffixes by batch and bucket, in order; what collapse() takes out of them as rows without a bucket."""
    k = n_codes(depth)
    schema = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("suffixes", pa.binary()), ("docs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            batch, keys, docs = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for b in np.unique(batch).tolist():
                own = batch == b
                e, others = collapse(ordered(Entries(keys[own], docs[own], np.full(own.sum(), NEW, np.int8))))
                bucket = bucket_of(e.keys, bounds)
                rows = [(b, p, e.keys[i:j].tobytes(), e.docs[i:j].tobytes()) for p, i, j in _parts(bucket, len(bounds) + 1)]
                if len(others.keys):
                    rows.append((b, None, names(others.keys).tobytes(), others.docs.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for whole in batches:
            for b in slices(whole, "text"):
                w = Words(b.column("text"))
                at, doc = sampled(w, length, depth)
                ids, no = b.column("doc_id").to_numpy(), b.column("batch").to_numpy()
                held.append((no[doc].astype(np.int64), codes(w, at, doc, k), ids[doc]))
                if sum(len(x) for _, x, _ in held) > _FLUSH:
                    yield from flush()
        if held:
            yield from flush()
        trim()

    return run


def _leading(keys: np.ndarray) -> np.ndarray:
    """The first eight codes as numbers of the same order."""
    return np.ascontiguousarray(np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), keys.dtype.itemsize)[:, :8]).view(">u8").ravel().astype(np.uint64)


def bucket_of(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, _leading(keys), "right")


def bucket_bounds(docs: DataFrame, length: int, depth: int, r: int) -> np.ndarray:
    """r - 1 bounds between buckets, from about SAMPLE_BYTES of text a bucket (4 MB at least); they affect balance alone."""
    want, k = max(4 << 20, r * SAMPLE_BYTES), n_codes(depth)
    if (size := estimated(docs)) is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    some = docs.select("text") if size <= want else docs.select("text").sample(fraction=want / size, seed=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                w = Words(b.column("text"))
                got = np.unique(_leading(codes(w, *sampled(w, length, depth), k)))
                yield pa.RecordBatch.from_arrays([pa.array([got.tobytes()], pa.binary())], names=["leading"])

    rows = some.mapInArrow(run, "leading binary").toArrow()
    got = np.sort(np.concatenate([np.zeros(1, np.uint64), *[np.frombuffer(x, np.uint64) for x in rows.column(0).to_pylist()]]))
    return got[np.linspace(0, len(got) - 1, r + 1).astype(np.int64)[1:-1]]


class Family:
    """A suffix index that lasts: levels of suffix arrays below a folder that all executors share. Level i holds 2 ** i batches.

    create() makes one for documents like those given, open() finds one by its folder,
    add() enters a batch. A state is written when its levels are complete, and levels are
    removed only after that, so that the index survives a driver that is lost.
    """

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path, state
        self.length, self.depth, self.bounds = state["length"], state["depth"], np.array(state["bounds"], np.uint64)

    @classmethod
    def create(cls, docs: DataFrame, path: str | None = None, length: int = LENGTH, depth: int = DEPTH) -> Family:
        spark, docs = docs.sparkSession, _usable(docs)
        bounds = bucket_bounds(docs, length, depth, buckets(docs))
        family = cls(spark, path or new_path(spark, "family"), {"version": 0, "length": length, "depth": depth, "bounds": bounds.tolist(), "levels": {}})
        family._save({})
        return family

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Family:
        newest = spark.read.text(f"{path}/state-*").selectExpr("value", "get_json_object(value, '$.version') + 0 AS v").orderBy("v", ascending=False).first()
        return cls(spark, path, json.loads(newest["value"]))

    def _save(self, levels: dict[str, str]) -> None:
        before = self.state["version"]
        self.state = self.state | {"version": before + 1, "levels": levels}
        self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.text(f"{self.path}/state-{before + 1}")
        remove(self.spark, f"{self.path}/state-{before}")

    @property
    def levels(self) -> dict[int, str]:
        return {int(i): at for i, at in self.state["levels"].items()}

    def _write(self, df: DataFrame, name: str) -> str:
        at = f"{self.path}/{name}"
        remove(self.spark, at)  # of a call that didn't end
        df.write.option("compression", "zstd").parquet(at)
        return at

    def _read(self, at: str) -> DataFrame:
        return self.spark.read.schema(_ARRAY).parquet(at)

    def arrays(self, docs: DataFrame, batches: int) -> DataFrame:
        """batch, bucket, suffixes and docs: the arrays of all batches as tasks made them, staged; rows without a bucket are matches already."""
        tagged = _usable(docs).select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
        return stage_table(tagged.mapInArrow(_emit_suffixes(self.length, self.depth, self.bounds), "batch int, " + _ARRAY), "suffixes")

    def add(self, docs: DataFrame) -> DataFrame:
        """Enters documents as one batch; doc_id, suffix and shared of the matches in it and between it and the family, staged."""
        arrays = self.arrays(docs, 1)
        at = made()[-1]
        found = self._add(arrays)
        discard(self.spark, at)
        return found

    def _add(self, batch: DataFrame) -> DataFrame:
        n, k, depth, levels = self.state["version"], n_codes(self.depth), self.depth, self.levels
        i, gone = 0, []
        while i in levels:
            gone.append(levels.pop(i))
            i += 1
        whole = batch.where("bucket IS NULL").select("docs", "suffixes", F.lit(None).cast("binary").alias("shared"))  # they share all that entries hold
        both = batch.where("bucket IS NOT NULL").select("bucket", "suffixes", "docs", F.lit(NEW).alias("role"))
        for old, role in [(x, MERGED) for x in gone] + [(x, STAYS) for x in levels.values()]:
            both = both.unionByName(self._read(old).withColumn("role", F.lit(role)))

        def one_pass(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            e = _load(t, k)
            at, shared = scan(e, depth)
            kept = collapse(e.take(np.flatnonzero(e.role >= MERGED)))[0]
            trim()
            row = (kept.keys.tobytes(), kept.docs.tobytes(), e.docs[at].tobytes(), names(e.keys[at]).tobytes(), shared.astype(np.uint8).tobytes())
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32())} | {c: pa.array([x], pa.binary()) for c, x in zip(_PASS[1:], row, strict=True)})

        at = self._write(both.groupBy("bucket").applyInArrow(one_pass, "bucket int, " + ", ".join(f"{c} binary" for c in _PASS[1:])), f"level-{n}-{i}")
        found = self.spark.read.parquet(at).select(F.col("found_docs").alias("docs"), F.col("found_suffixes").alias("suffixes"), "shared")

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for d, s, x in zip(*(b.column(c).to_pylist() for c in ("docs", "suffixes", "shared")), strict=True):
                    docs, suffix = np.frombuffer(d, np.int64), np.frombuffer(s, np.int64)
                    shared = np.full(len(docs), k) if x is None else np.frombuffer(x, np.uint8)
                    for i in range(0, len(docs), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + (1 << 16)]), pa.array(suffix[i : i + (1 << 16)]), pa.array(shared[i : i + (1 << 16)].astype(np.int32))], names=["doc_id", "suffix", "shared"])

        matches = stage_table(found.unionByName(whole).mapInArrow(unpack, _MATCHES), "matches")
        self._save({str(j): x for j, x in (levels | {i: at}).items()})
        for old in gone:
            remove(self.spark, old)
        return matches

    def drop(self) -> None:
        remove(self.spark, self.path)
        self.state = self.state | {"levels": {}}


def _usable(docs: DataFrame) -> DataFrame:
    return narrow(docs, {"doc_id": "bigint", "text": "string"}).where("doc_id IS NOT NULL AND text IS NOT NULL")


# Verification


def marked(w: Words, length: int, depth: int, doc: np.ndarray, suffix: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (their first words, in order) that matches (document in w, suffix, words shared) allow, their documents and lowest hashes."""
    of = lowest(w, length, depth)
    at, own = sampled(w, length, depth, of)
    k = n_codes(depth)
    tag = lambda s, d: mix(s ^ mix(d.astype(np.uint64), 9), 10)
    keys, have = tag(suffix.view(np.uint64), doc), tag(names(codes(w, at, own, k)), own)
    by = np.argsort(keys)
    keys, bound = keys[by], shared[by]
    j = np.minimum(np.searchsorted(keys, have), max(len(keys) - 1, 0))
    hit = np.flatnonzero(keys[j] == have) if len(keys) else np.zeros(0, np.int64)
    at, own, bound = at[hit], own[hit], bound[j[hit]]
    # A window that has o words before the suffix shares length - o from it on.
    lo = np.maximum(at - (length - depth), w.offsets[own])
    hi = np.minimum(np.where(bound < k, at - np.maximum(length - bound, 0), at), w.offsets[own + 1] - length)
    edge = np.zeros(len(w.hashes) + 1, np.int64)
    good = lo <= hi
    np.add.at(edge, lo[good], 1)
    np.add.at(edge, hi[good] + 1, -1)
    windows = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    return windows, of[2][windows], of[1][windows]


def _emit_windows(length: int, depth: int, r: int):
    """What a slice of documents asks of a bucket: distinct windows with their least document and whether it has more, and where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            for b in slices(whole, "text", 16 << 20):
                w, lists = Words(b.column("text")), b.column("found")
                found = lists.flatten()
                doc = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                at, own, least = marked(w, length, depth, doc, found.field("suffix").to_numpy(), found.field("shared").to_numpy())
                if not len(at):
                    continue
                g, ids = rolling(w.hashes, length), b.column("doc_id").to_numpy()
                bucket = (least % np.uint64(r)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                at, own, bucket = at[by], own[by], bucket[by]
                rows, n = [], n + 1
                for p, i, j in _parts(bucket, r):
                    some, mine = at[i:j], ids[own[i:j]]
                    uniq, first, no = np.unique(g[some], return_index=True, return_inverse=True)
                    order = np.argsort(first)  # as they come, so that documents and numbers compress
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    no = rank[no]
                    low, high = np.full(len(uniq), np.iinfo(np.int64).max), np.full(len(uniq), np.iinfo(np.int64).min)
                    np.minimum.at(low, no, mine)
                    np.maximum.at(high, no, mine)
                    new = np.concatenate([[True], (np.diff(some) != 1) | (mine[1:] != mine[:-1])])
                    start = np.flatnonzero(new)
                    word = some[start] - w.offsets[own[i:j][start]]
                    rows.append((task + n, p, uniq[order].tobytes(), low.tobytes(), np.packbits(low != high).tobytes(), planes(np.diff(no, prepend=0).astype(np.int32).view(np.uint32)), mine[start].tobytes(), planes(word), planes(np.diff(np.append(start, j - i)))))
                kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "bucket", "windows", "least", "several", "places", "docs", "words", "runs"])
        trim()

    return run


_ASKED = "id bigint, bucket int, windows binary, least binary, several binary, places binary, docs binary, words binary, runs binary"


def _answer(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """For each row, which of its windows several documents have."""
    g = [np.frombuffer(x, np.uint64) for x in t.column("windows").to_pylist()]
    size = np.cumsum([0, *map(len, g)])
    doc = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("least").to_pylist()])
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)) for x, y in zip(t.column("several").to_pylist(), g, strict=True)])
    g = np.concatenate(g)
    by = np.argsort(g, kind="stable")
    begin = _begins(g[by])
    several = (np.minimum.reduceat(doc[by], begin) != np.maximum.reduceat(doc[by], begin)) | (np.maximum.reduceat(many[by], begin) > 0)
    hit = np.zeros(len(g), bool)
    hit[by] = np.repeat(several, np.diff(np.append(begin, len(g))))
    trim()
    return pa.table({"id": t.column("id"), "bucket": t.column("bucket"), "shared": pa.array([np.packbits(hit[a:b]).tobytes() for a, b in zip(size[:-1], size[1:], strict=True)], pa.binary())})


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, first and last window of every run of windows that another document has too."""
    for b in batches:
        for row in range(b.num_rows):
            get = lambda c: b.column(c)[row].as_py()  # noqa: B023, E731
            no = np.cumsum(unplanes(get("places")).view(np.int32))
            hit = np.unpackbits(np.frombuffer(get("shared"), np.uint8))[no] > 0
            if not hit.any():
                continue
            docs, word, size = np.frombuffer(get("docs"), np.int64), unplanes(get("words")).astype(np.int64), unplanes(get("runs")).astype(np.int64)
            run = np.repeat(np.arange(len(size)), size)
            at = word[run] + np.arange(len(no)) - np.repeat(np.cumsum(size) - size, size)
            i = np.flatnonzero(hit)
            new = np.concatenate([[True], (np.diff(run[i]) != 0) | (np.diff(at[i]) != 1)])
            start = np.flatnonzero(new)
            end = np.append(start[1:], len(i)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(docs[run[i[start]]]), pa.array(at[i[start]]), pa.array(at[i[end]])], names=["doc_id", "first", "last"])
    trim()


def verify(docs: DataFrame, matches: DataFrame, length: int = LENGTH, depth: int = DEPTH) -> DataFrame:
    """doc_id, first_word and n_words of the repeated passages that matches (of a family, over the same documents) lead to."""
    docs = _usable(docs)
    best = matches.groupBy("doc_id", "suffix").agg(F.max("shared").alias("shared"))
    found = stage_table(best.groupBy("doc_id").agg(F.collect_list(F.struct("suffix", "shared")).alias("found")), "found")
    asked = docs.join(found.hint("merge"), "doc_id").select("doc_id", "text", "found").mapInArrow(_emit_windows(length, depth, buckets(docs)), _ASKED)
    asked = stage_table(asked, "windows")
    answers = asked.select("id", "bucket", "windows", "least", "several").groupBy("bucket").applyInArrow(_answer, "id bigint, bucket int, shared binary")
    runs = asked.drop("windows", "least", "several").join(answers, ["id", "bucket"]).mapInArrow(_runs, "doc_id bigint, first bigint, last bigint")
    spans = runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, rs in zip(b.column("doc_id").to_pylist(), b.column("runs").to_pylist(), strict=True):
                a = np.array([x["first"] for x in rs])
                z = np.maximum.accumulate(np.array([x["last"] for x in rs]) + length)
                start = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))
                end = np.append(start[1:], len(a)) - 1
                out += [(doc_id, int(x), int(y - x)) for x, y in zip(a[start], z[end], strict=True)]
            if out:
                x = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in x], names=["doc_id", "first_word", "n_words"])

    return spans.mapInArrow(join, "doc_id bigint, first_word bigint, n_words bigint")


def repeats(docs: DataFrame, length: int = LENGTH, depth: int = DEPTH, batches: int = BATCHES) -> DataFrame:
    """doc_id, first_word and n_words of every longest run of words of which each is in a passage of `length` words that another document has too.

    Words and windows are compared by 64-bit hashes, windows within the bucket of their
    lowest suffix. Case, punctuation and white space don't count. Documents of fewer than
    `length` words, null texts and rows without doc_id have no passage. Rows that share a
    doc_id are one document: what they repeat among themselves doesn't count. Extra
    columns are dropped; no documents, no passages.
    """
    docs = _usable(docs)
    family, found = Family.create(docs, length=length, depth=depth), None
    arrays = family.arrays(docs, batches)
    arrays_at = made()[-1]
    for i in range(batches):  # the family grows a batch at a time
        hits = family._add(arrays.where(F.col("batch") == i))
        found = hits if found is None else found.unionByName(hits)
    family.drop()
    discard(docs.sparkSession, arrays_at)
    return verify(docs, found, length, depth)
