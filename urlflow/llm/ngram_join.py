"""All pairs of documents whose word n-gram sets have a Jaccard similarity of at least t.

Prefix filter with adaptive multi-match prefixes. Every document orders its n-grams
the same way, rare ones first; with a prefix of n - ceil(t n) + l grams, two
documents as similar as t share at least min(l, l') prefix grams. Each document
takes the l whose estimated cost is least: postings to read for its prefix, and
candidates left to verify.

1. Document frequencies of all n-grams of all documents: hashes are packed by bucket
   into sorted arrays, so that the exchange moves about three bytes a gram. Each
   bucket returns its part of a filter of the grams that occur twice or more, and its
   most frequent grams. Both are of bounded size, `filter_bits` and `top`, and affect
   only the order and the choice of l, never the result: where a filter would be
   overfull it takes the grams above a higher frequency.
2. Prefix grams, packed alike, meet by bucket; runs of the same gram give pairs, with
   the length filter, and how many grams the bucket saw them share. A gram that more
   than `hot` texts have there gives no pairs but its texts, a row each: pairs would be
   sent by the square of a group of near copies, once for each of its grams.
3. Texts are put in blocks: by the least of their hot grams' hashes, so that near copies
   are together, else by their pairs. Two blocks that hold a good part of a hot gram's
   texts are compared whole, all texts with all, by a product of matrices; of other
   blocks the pairs that share a hot gram, or min(l, l') of the other prefix grams, are
   verified one by one. Either is exact. A block that is compared whole is a file of the
   shared folder, which its comparisons read: its sets are sent and held once, however
   many blocks a group of near copies has. A cell has the sets of some other pairs, so
   that a document's grams are sent once a cell, not once a pair.
4. A cell or two blocks return its similar pairs, or what classes need of them: each text's number
   of similar ones and the least text that it is connected to in the cell.

Copies of a text are joined once, through the hash of the text, and multiplied at the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import DOCUMENT, narrow, new_path, row_key, small, stage_table, trim
from .grams import gram_sets, planes, squeeze, unplanes, unsqueeze
from .words import PUNCTUATION, Words, mix, slices

N = 3
THRESHOLD = 0.5
LEVELS = (1, 2, 3, 4, 6, 8)
FILTER_BITS = 1 << 27
TOP = 1 << 20
_CHUNK = 1 << 20
_HAS_WORD = "[0-9A-Za-z_[^\\x{0}-\\x{7F}" + PUNCTUATION[1:-1] + "]]"
_FLUSH = 1 << 20
#: Texts of a block.
BLOCK = 512
#: Texts with the same prefix gram, in a bucket, from which their pairs aren't sent one by one.
HOT = 32
#: Blocks are compared whole where a hot gram is in one in so many of their pairs.
_WHOLE = 64
#: Pairs held by a bucket, rows of a batch, bytes of a batch of sets, grams of a block by its texts, columns of a matrix.
_HELD, _ROWS, _BYTES, _WIDE, _COLUMNS = 1 << 21, 1 << 17, 4 << 20, 512, 4096


def estimated(df: DataFrame) -> int | None:
    """Bytes of input by Spark's estimate; None where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def buckets(df: DataFrame) -> int:
    """One for each shuffle partition, but no more than 32 MB of input a bucket by Spark's estimate: they bound the memory of a group."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min((estimated(df) or 0) >> 25, 1 << 20))


def _split(ids: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and the rest of a gram's hash; together they identify it."""
    return ((ids >> np.uint64(32)) % np.uint64(r)).astype(np.int64), ids & np.uint64(0xFFFFFFFF)


def _parts(bucket: np.ndarray, r: int) -> list[tuple[int, int, int]]:
    at = np.searchsorted(bucket, np.arange(r + 1))
    return [(b, int(at[b]), int(at[b + 1])) for b in range(r) if at[b] < at[b + 1]]


# 1. Document frequencies


def _emit_grams(n: int, r: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            bucket, low = _split(np.concatenate(held), r)
            held.clear()
            key = np.sort((bucket.astype(np.uint64) << np.uint64(32)) | low)
            bucket, low = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            parts = _parts(bucket, r)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in parts], pa.int32()), pa.array([squeeze(low[i:j]) for _, i, j in parts], pa.binary())], names=["bucket", "grams"])

        for whole in batches:
            for b in slices(whole, "text"):
                held.append(gram_sets(Words(b.column("text")), n)[0])
                if sum(map(len, held)) > _FLUSH:
                    yield from flush()
        yield from flush()
        trim()

    return run


def _count_bucket(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    low = np.sort(np.concatenate([unsqueeze(x) for x in t.column("grams").to_pylist()]))
    at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    df = np.diff(np.append(at, len(low)))
    keep = df > 1
    low, df = low[at[keep]], np.minimum(df[keep], 0xFFFFFFFF)
    hist = np.bincount(np.minimum(df, 1023), minlength=1024).astype(np.int64)
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "hist": pa.array([hist.tolist()], pa.list_(pa.int64())), "grams": pa.array([squeeze(low)], pa.binary()), "df": pa.array([planes(df)], pa.binary())})


class Order:
    """Filter of the grams with a frequency of `least` or more, and the frequencies of the most frequent, by bucket."""

    def __init__(self, r: int, least: int, bits: int, parts: pa.Table):
        self.r, self.least, self.bits = r, least, bits
        self.filter = np.zeros(r * (bits >> 3), np.uint8)
        keys, dfs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        cell = lambda c, i: memoryview(parts.column(c)[i].as_buffer())
        for i in np.argsort(parts.column("bucket").to_numpy()):
            b = parts.column("bucket")[i].as_py()
            self.filter[b * (bits >> 3) : (b + 1) * (bits >> 3)] = np.frombuffer(cell("filter", i), np.uint8)
            keys.append(unsqueeze(cell("grams", i)).astype(np.uint64) | np.uint64(b << 32))
            dfs.append(unplanes(cell("df", i)))
        self.keys, self.df = np.concatenate(keys), np.concatenate(dfs)

    @staticmethod
    def probes(low: np.ndarray, bits: int) -> list[np.ndarray]:
        return [mix(low, salt) % np.uint64(bits) for salt in (91, 92)]

    def frequency(self, bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
        """0: below `least`, most likely; `least`: in the filter; else the frequency."""
        base = bucket.astype(np.uint64) * np.uint64(self.bits)
        hit = np.ones(len(low), bool)
        for p in self.probes(low, self.bits):
            at = base + p
            hit &= (self.filter[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        out = np.where(hit, self.least, 0).astype(np.int64)
        if len(self.keys):
            i = np.flatnonzero(hit)
            key = (bucket[i].astype(np.uint64) << np.uint64(32)) | low[i]
            j = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            same = self.keys[j] == key
            out[i[same]] = self.df[j[same]]
        return out


def frequencies(texts: DataFrame, n: int, r: int, filter_bits: int, top: int) -> Order:
    """texts has a row for every document: its frequencies cover all of them."""
    spark = texts.sparkSession
    counted = stage_table(texts.select("text").mapInArrow(_emit_grams(n, r), "bucket int, grams binary").groupBy("bucket").applyInArrow(_count_bucket, "bucket int, hist array<bigint>, grams binary, df binary"), "frequencies")
    hist = np.zeros(1024, np.int64)
    for row in counted.select(F.posexplode("hist").alias("df", "n")).groupBy("df").agg(F.sum("n").alias("n")).collect():  # 1024 rows
        hist[row["df"]] = row["n"]
    above = np.cumsum(hist[::-1])[::-1]  # grams of that frequency or more
    least = int(next((f for f in range(2, 1024) if above[f] * 6 <= filter_bits), 1023))
    bits = max(1024, min(filter_bits, 1 << int(above[least] * 8 + 1).bit_length()) // r + 7) & ~7
    many = int(next((f for f in range(least, 1024) if above[f] <= top), 1023))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, grams, df in zip(b.column("bucket").to_pylist(), b.column("grams").to_pylist(), b.column("df").to_pylist(), strict=True):
                low, count = unsqueeze(grams), unplanes(df)
                low, count = low[count >= least], count[count >= least]
                mask = np.zeros(bits, np.uint8)
                for p in Order.probes(low.astype(np.uint64), bits):
                    mask[p.astype(np.int64)] = 1
                often = count >= many
                if often.sum() > 2 * top // r + 64:  # equal frequencies at the end of the scale
                    often = np.zeros(len(count), bool)
                    often[np.argsort(-count.astype(np.int64), kind="stable")[: 2 * top // r + 64]] = True
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(mask, bitorder="little").tobytes()], pa.binary()), pa.array([squeeze(low[often])], pa.binary()), pa.array([planes(count[often])], pa.binary())], names=["bucket", "filter", "grams", "df"])

    got = counted.select("bucket", "grams", "df").mapInArrow(part, "bucket int, filter binary, grams binary, df binary").toArrow()  # filter_bits / 8 + 8 top bytes at most
    return Order(r, least, bits, got)


# 2. Candidates


def prefix(df: np.ndarray, key: np.ndarray, t: float, levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, int]:
    """The grams of the chosen prefix, as positions, and its l."""
    n = len(key)
    need = int(np.ceil(t * n - 1e-9))
    order = np.argsort(key)
    others = np.cumsum(np.maximum(df[order] - 1, 0))
    best, at = None, (1, n)
    for level in levels:
        if level > max(1, need):
            break
        p = min(n, n - need + level)
        cost = p + others[p - 1] + 2 * n * others[p - 1] / level
        if best is None or cost < best:
            best, at = cost, (level, p)
    return order[: at[1]], at[0]


def _emit_postings(n: int, r: int, r2: int, t: float, order, levels: tuple[int, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o: Order = order.value
        ids: list[np.ndarray] = []
        doc: list[np.ndarray] = []
        info: list[tuple[int, int, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not ids:
                return
            g, d = np.concatenate(ids), np.concatenate(doc)
            key = ((mix(g, 17) % np.uint64(r2)) << np.uint64(32)) | (g & np.uint64(0xFFFFFFFF))
            by = np.argsort(key, kind="stable")
            low, d, bucket = (key[by] & np.uint64(0xFFFFFFFF)).astype(np.uint32), d[by], (key[by] >> np.uint64(32)).astype(np.int64)
            sig, size, level = (np.array(x, np.int64) for x in zip(*info, strict=True))
            rows = []
            for b, i, j in _parts(bucket, r2):
                own, local = np.unique(d[i:j], return_inverse=True)
                rows.append((b, squeeze(low[i:j]), planes(local), sig[own].tobytes(), planes(size[own]), level[own].astype(np.uint8).tobytes()))
            ids.clear()
            doc.clear()
            info.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(zip(*rows, strict=True))], names=["bucket", "grams", "doc", "sig", "size", "level"])

        for whole in batches:
            for b in slices(whole, "text"):
                g, at = gram_sets(Words(b.column("text")), n)
                bucket, low = _split(g, r)
                df = o.frequency(bucket, low)
                key = (np.minimum(df, 0xFFFFF).astype(np.uint64) << np.uint64(44)) | (mix(g, 23) >> np.uint64(20))
                sigs = b.column("sig").to_pylist()
                for i in range(b.num_rows):
                    lo, hi = int(at[i]), int(at[i + 1])
                    if lo == hi:
                        continue
                    take, level = prefix(df[lo:hi], key[lo:hi], t, levels)
                    if o.least == 2:  # then a gram outside the filter is in this document alone
                        take = take[df[lo:hi][take] > 0]
                    ids.append(g[lo:hi][take])
                    doc.append(np.full(len(take), len(info)))
                    info.append((sigs[i], hi - lo, level))
                if sum(map(len, ids)) > _FLUSH:
                    yield from flush()
        yield from flush()
        trim()

    return run


def _met(t: float, hot: int) -> Callable:
    """_pairs_of() of packed postings. Grams are 32 bits in their bucket here; two that are taken for one give candidates too many, none too few. What only one posting has goes before the rest is unpacked."""
    pairs = _pairs_of(t, hot)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        low = np.sort(np.concatenate([unsqueeze(row["grams"]) for row in rows]))
        low = low[np.flatnonzero(low[1:] == low[:-1])]
        low, bucket = low[np.diff(low, prepend=low[:1] + 1) != 0], np.uint64(key[0].as_py() << 32)

        def unpacked() -> Iterator[pa.RecordBatch]:
            while rows:
                row = rows.pop()
                own = unsqueeze(row["grams"])
                keep = low[np.minimum(np.searchsorted(low, own), len(low) - 1)] == own
                of, doc = np.unique(unplanes(row["doc"])[keep], return_inverse=True)
                sig, size, level = np.frombuffer(row["sig"], np.int64)[of], unplanes(row["size"])[of], np.frombuffer(row["level"], np.uint8)[of]
                yield pa.RecordBatch.from_pylist([{"grams": (own[keep] | bucket).tobytes(), "doc": planes(doc), "sig": sig.tobytes(), "size": planes(size), "level": level.tobytes()}])

        if len(low):
            yield from pairs(key, unpacked())

    return run


def _pairs_of(t: float, hot: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, doc, sig, size, level, base = [], [], [], [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                g.append(np.frombuffer(row["grams"], np.uint64))
                doc.append(unplanes(row["doc"]).astype(np.int64) + base)
                sig.append(np.frombuffer(row["sig"], np.int64))
                size.append(unplanes(row["size"]))
                level.append(np.frombuffer(row["level"], np.uint8))
                base += len(sig[-1])
        g, doc, sig, size, level = (np.concatenate(x) for x in (g, doc, sig, size, level))
        sig, first, same = np.unique(sig, return_index=True, return_inverse=True)  # copies become one
        size, level = size[first].astype(np.int64), level[first]
        by = np.argsort(size, kind="stable")  # documents are numbered by size from here on
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        sig, size, level, doc = sig[by], size[by], level[by], rank[same[doc]]
        order = np.argsort(g)
        g, doc = g[order], doc[order]
        new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
        g, run_no = g[new], np.cumsum(new) - 1
        k = np.unique((run_no.astype(np.uint64) << np.uint64(32)) | doc.astype(np.uint64))
        doc, run_no = (k & np.uint64(0xFFFFFFFF)).astype(np.int64), (k >> np.uint64(32)).astype(np.int64)
        often = np.bincount(run_no, minlength=len(g))[run_no] > hot

        def rows(is_hot: bool, sa: np.ndarray, sb: np.ndarray, shared: np.ndarray, need: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(sa), _ROWS):
                x = [v[i : i + _ROWS] for v in (sa, sb, shared.astype(np.int32), need.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x[0]), is_hot)), *map(pa.array, x)], names=["hot", "sa", "sb", "shared", "need"])

        at = doc[often]
        yield from rows(True, g[run_no[often]].view(np.int64), sig[at], size[at], np.zeros(len(at)))
        k, doc, run_no = k[~often], doc[~often], k[~often] >> np.uint64(32)
        largest = np.searchsorted(size, np.floor(size / t + 1e-9), "right") - 1
        end = np.searchsorted(k, (run_no << np.uint64(32)) | largest[doc].astype(np.uint64), "right")
        count = end - np.arange(len(k)) - 1
        keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def fold() -> None:
            nonlocal keys, sums
            new, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            sums = np.bincount(where, weights=np.concatenate([sums, c]), minlength=len(keys)).astype(np.int64)

        def pairs() -> Iterator[pa.RecordBatch]:
            a, b = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            yield from rows(False, np.minimum(sig[a], sig[b]), np.maximum(sig[a], sig[b]), sums, np.minimum(level[a], level[b]))

        live = np.flatnonzero(count > 0)
        total, i, size_held = np.concatenate([[0], np.cumsum(count[live])]), 0, 0
        while i < len(live):
            j = max(i + 1, int(np.searchsorted(total, total[i] + _CHUNK, "right")) - 1)
            some = live[i:j]
            c = count[some]
            left = np.repeat(some, c)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
            held.append((doc[left].astype(np.uint64) << np.uint64(32)) | doc[right].astype(np.uint64))
            size_held += len(left)
            if size_held >= _CHUNK:
                fold()
                size_held = 0
                if len(keys) >= _HELD:  # their counts are summed after the exchange
                    yield from pairs()
                    keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            i = j
        fold()
        yield from pairs()
        trim()

    return run


# 3. Verification


def _emit_sets(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["filed", "cell", "sig", "grams"])
            rows.clear()

        for whole in batches:
            for b in slices(whole, "text"):
                g, at = gram_sets(Words(b.column("text")), n)
                held = 0
                for i, (sig, block, cells) in enumerate(zip(*(b.column(c).to_pylist() for c in ("sig", "block", "cells")), strict=True)):  # block: of those that become files
                    own = g[at[i] : at[i + 1]].tobytes()
                    for filed, c in [(False, c) for c in cells or ()] + [(True, block)] * (block is not None):
                        rows.append((filed, c, sig, own))
                        held += len(own)
                        if held > _BYTES:
                            yield from flush()
                            held = 0
                yield from flush()
        trim()

    return run


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many grams each set of a has in common with each of b. Grams that many have go through products of matrices, the others through their pairs."""
    out = np.zeros((len(a), len(b)), np.float32)  # whole numbers to 2^24 are exact
    cat = np.concatenate([*a, *b])
    doc = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(cat, kind="stable")  # a gram's documents of a, then those of b
    cat, doc = cat[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], cat[1:] != cat[:-1]]))
    of_a = np.add.reduceat((doc < len(a)).astype(np.int64), start)
    of_b = np.diff(np.append(start, len(cat))) - of_a
    dense = np.flatnonzero((of_a * of_b >= 1024) & (of_a > 0))
    for i in range(0, len(dense), _COLUMNS):
        some = dense[i : i + _COLUMNS]
        x, y = np.zeros((len(a), len(some)), np.float32), np.zeros((len(b), len(some)), np.float32)
        for m, n, first, less in ((x, of_a[some], start[some], 0), (y, of_b[some], start[some] + of_a[some], len(a))):
            m[doc[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())] - less, np.repeat(np.arange(len(some)), n)] = 1
        out += x @ y.T
    rare = np.flatnonzero((of_a * of_b < 1024) & (of_a * of_b > 0))
    total, i, flat = np.cumsum((of_a * of_b)[rare]), 0, out.reshape(-1)
    while i < len(rare):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _CHUNK, "right")))
        u, v, at = of_a[rare[i:j]], of_b[rare[i:j]], start[rare[i:j]]
        left = np.repeat(at - np.cumsum(u) + u, u) + np.arange(u.sum())  # each gram's places in a, and for each those in b
        times, right = np.repeat(v, u), np.repeat(at + u, u)
        pair = np.repeat(doc[left], times) * len(b) + doc[np.repeat(right - np.cumsum(times) + times, times) + np.arange(times.sum())] - len(a)
        flat += np.bincount(pair, minlength=len(flat)).astype(np.float32)
        i = j
    return out


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a and b in root, which names the least of each group for all."""
    while len(a):
        x, y = root[a], root[b]
        other = x != y
        a, b, x, y = a[other], b[other], x[other], y[other]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root[:] = up


class _Found:
    """The similar pairs of some texts, or if not whole each text's least connected text and number of similar ones. sig ascends."""

    def __init__(self, sig: np.ndarray, t: float, whole: bool):
        self.sig, self.t, self.whole = sig, t, whole
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.root, self.links = np.arange(len(sig)), np.zeros(len(sig), np.int64)

    def take(self, a: np.ndarray, b: np.ndarray, j: np.ndarray) -> None:
        keep = j >= self.t - 1e-12
        a, b = a[keep], b[keep]
        if self.whole:
            self.pairs.append((self.sig[np.minimum(a, b)], self.sig[np.maximum(a, b)], j[keep]))
        else:
            self.links += np.bincount(a, minlength=len(self.sig)) + np.bincount(b, minlength=len(self.sig))
            _unite(self.root, a, b)

    def rows(self) -> dict[str, np.ndarray]:
        if self.whole:
            parts = zip(*self.pairs, strict=True) if self.pairs else ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
            return dict(zip(("sa", "sb", "jaccard"), map(np.concatenate, parts), strict=True))
        some = self.links > 0
        return {"sig": self.sig[some], "root": self.sig[self.root[some]], "links": self.links[some]}


def _sets(t: pa.Table) -> list[np.ndarray]:
    grams = t.column("grams").combine_chunks()
    grams = grams.chunk(0) if isinstance(grams, pa.ChunkedArray) else grams
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in grams]


def _block_file(folder: str, block: int) -> tuple[fs.FileSystem, str]:
    at, base = fs.FileSystem.from_uri(folder)
    return at, f"{base}/{block & 0xFFFFFFFFFFFFFFFF:016x}"


def _verify(t: float, whole: bool, folder: str) -> Callable:
    """What a cell's pairs have found; a block's sets are filed in the folder instead."""

    def run(key: tuple[pa.Scalar, ...], pairs: pa.Table, sets: pa.Table) -> pa.Table:
        sets = sets.select(["sig", "grams"]).sort_by("sig")
        found = _Found(sets.column("sig").to_numpy(), t, whole)
        if key[0].as_py():
            at, path = _block_file(folder, key[1].as_py())
            at.create_dir(path.rpartition("/")[0], recursive=True)
            own = f"{path}-{uuid.uuid4().hex}"  # another attempt may write the same
            with at.open_output_stream(own) as f, pa.ipc.new_stream(f, sets.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(sets)
            at.move(own, path)
        elif len(pairs):
            get = _sets(sets).__getitem__
            a, b = (np.searchsorted(found.sig, pairs.column(c).to_numpy()) for c in ("sa", "sb"))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            j = np.zeros(len(a))
            for lo, hi in zip(at := np.flatnonzero(np.diff(a, prepend=-1)), np.append(at[1:], len(a))[: len(at)], strict=True):
                x = get(a[lo])
                for k in range(lo, hi, 512):
                    other = [get(i) for i in b[k : min(k + 512, hi)]]
                    sizes = np.array([len(y) for y in other])
                    cat = np.concatenate(other)
                    hit = x[np.minimum(np.searchsorted(x, cat), len(x) - 1)] == cat
                    both = np.add.reduceat(hit, np.cumsum(sizes) - sizes)
                    j[k : k + len(other)] = both / (len(x) + sizes - both)
            found.take(a, b, j)
        trim()
        return pa.table(found.rows())

    return run


def _compare_blocks(t: float, whole: bool, folder: str) -> Callable:
    """What is found between two filed blocks, or in one, for each row of ba and bb."""

    def read(block: int) -> tuple[np.ndarray, list[np.ndarray]]:
        at, path = _block_file(folder, block)
        with at.open_input_stream(path) as f, pa.ipc.open_stream(f) as sets:
            got = sets.read_all()
        return got.column("sig").to_numpy(), _sets(got)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for x, y in zip(batch.column("ba").to_pylist(), batch.column("bb").to_pylist(), strict=True):
                if x != last:
                    last, held = x, read(x)
                (sa, u), (sb, v) = held, held if x == y else read(y)
                both = common(u, v).astype(np.float64)
                j = both / (np.array([len(i) for i in u])[:, None] + np.array([len(i) for i in v]) - both)
                p, q = np.nonzero(j >= t - 1e-12)
                if x == y:
                    p, q = p[p < q], q[p < q]
                found = _Found(np.union1d(sa, sb), t, whole)
                found.take(np.searchsorted(found.sig, sa[p]), np.searchsorted(found.sig, sb[q]), j[p, q])
                rows = found.rows()
                for i in range(0, len(rows["sa" if whole else "sig"]), _ROWS):
                    yield pa.RecordBatch.from_pydict({c: pa.array(v[i : i + _ROWS]) for c, v in rows.items()})
        trim()

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and sig of the documents with words; sig identifies a text."""
    return docs.where(F.col("text").rlike(_HAS_WORD)).withColumn("sig", F.xxhash64("text"))


def _compared(docs: DataFrame, whole: bool, threshold: float = THRESHOLD, n: int = N, levels: tuple[int, ...] = LEVELS, filter_bits: int = FILTER_BITS, top: int = TOP, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    spark, texts = docs.sparkSession, _texts(docs)
    r = buckets(docs)
    r2 = max(6, r // 3)
    order = spark.sparkContext.broadcast(frequencies(texts, n, r, filter_bits, top))  # of bounded size: see Order
    postings = texts.select("sig", "text").mapInArrow(_emit_postings(n, r, r2, threshold, order, levels), "bucket int, grams binary, doc binary, sig binary, size binary, level binary")
    met = postings.groupBy("bucket").applyInArrow(_met(threshold, hot), "hot boolean, sa bigint, sb bigint, shared int, need int")
    found = stage_table(met.groupBy("hot", "sa", "sb").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).where("hot OR shared >= need").select("hot", "sa", "sb", "shared"), "candidates")
    order.unpersist()
    few = found.where("NOT hot").select("sa", "sb")
    member = found.where("hot").select(F.col("sa").alias("gram"), F.col("sb").alias("sig"), F.col("shared").alias("size"))

    ends = few.select(F.col("sa").alias("sig"), F.col("sb").alias("other")).union(few.select("sb", "sa"))
    by_pair = ends.groupBy("sig").agg(F.lit(False).alias("hot"), F.least(F.col("sig"), F.min("other")).alias("label"), F.lit(0).cast("bigint").alias("size"))
    by_gram = member.groupBy("sig").agg(F.lit(True).alias("hot"), F.min(F.xxhash64("gram")).alias("label"), F.max("size").alias("size"))
    label = by_pair.union(by_gram).groupBy("sig").agg(F.max(F.struct("hot", "label", "size")).alias("of")).select("sig", "of.*")
    sizes = label.groupBy("hot", "label").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / (block * _WIDE))).alias("blocks"))
    placed = stage_table(label.join(sizes, ["hot", "label"]).select("sig", F.xxhash64("hot", "label", F.pmod("sig", "blocks")).alias("block")), "blocks")

    in_blocks = placed.join(placed.groupBy("block").agg(F.count("*").alias("texts")), "block")
    own = stage_table(member.join(in_blocks, "sig").groupBy("gram", "block", "texts").agg(F.count("*").alias("n"), F.collect_list(F.struct("sig", "size")).alias("own")), "hot")
    two = own.toDF("gram", "ba", "ta", "na", "a").join(own.toDF("gram", "bb", "tb", "nb", "b"), "gram").where("ba <= bb").withColumn("full", F.expr(f"na * nb * {_WHOLE} >= ta * tb"))
    full = stage_table(two.where("full").select("ba", "bb").distinct(), "full")
    n_full = full.count()
    thin = two.where("NOT full").drop("full").join(small(full), ["ba", "bb"], "left_anti")
    some = thin.select("ba", "bb", F.explode("a").alias("a"), "b").select("ba", "bb", "a", F.explode("b").alias("b")).where(F.col("a.sig") != F.col("b.sig")).where(F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * F.lit(threshold - 1e-9))
    x, y = placed.toDF("sa", "xa"), placed.toDF("sb", "xb")
    rest = few.join(x, "sa").join(y, "sb").select(F.least("xa", "xb").alias("ba"), F.greatest("xa", "xb").alias("bb"), "sa", "sb").join(small(full), ["ba", "bb"], "left_anti")
    rest = rest.union(some.select("ba", "bb", F.least("a.sig", "b.sig"), F.greatest("a.sig", "b.sig"))).distinct()
    cell = F.pmod(F.xxhash64("ba", "bb"), F.lit(max(r2, 1 + placed.count() // block))).alias("cell")
    pairs = stage_table(rest.select(F.lit(False).alias("filed"), cell, "sa", "sb"), "cells")
    cells = pairs.select("cell", F.explode(F.array("sa", "sb")).alias("sig")).groupBy("sig").agg(F.collect_set("cell").alias("cells"))
    filed = placed.join(full.select(F.explode(F.array("ba", "bb")).alias("block")).distinct(), "block")
    first = texts.groupBy("sig").agg(F.min(F.struct(F.xxhash64("doc_id"), "doc_id")).alias("one"))
    chosen = stage_table(cells.join(filed, "sig", "full").join(first, "sig").select("sig", "block", "cells", F.col("one.doc_id").alias("__id")), "chosen")
    picked = texts.join(small(chosen), ["sig"]).where(F.col("doc_id").eqNullSafe(F.col("__id"))).select("sig", "block", "text", "cells")
    sets = picked.mapInArrow(_emit_sets(n), "filed boolean, cell bigint, sig bigint, grams binary")
    folder, kind = new_path(spark, "sets"), "sa bigint, sb bigint, jaccard double" if whole else "sig bigint, root bigint, links bigint"
    similar = stage_table(pairs.groupBy("filed", "cell").cogroup(sets.groupBy("filed", "cell")).applyInArrow(_verify(threshold, whole, folder), kind), "similar")
    if not n_full:
        return similar
    tasks = min(n_full, max(r2, n_full >> 4))
    return similar.union(stage_table(full.repartition(tasks, "ba", "bb").sortWithinPartitions("ba", "bb").mapInArrow(_compare_blocks(threshold, whole, folder), kind), "similar"))


def similar_texts(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, **how) -> DataFrame:
    """sa < sb and jaccard of every pair of different texts that is similar; sa and sb are xxhash64 of the text. Staged."""
    return _compared(docs, True, threshold, n, **how)


def linked_texts(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, **how) -> DataFrame:
    """similar_texts() without the pairs: sig, root and links of the texts that have a similar one, some rows each. A text is similar to as many others as its links sum to, and every connected group is connected by sig and root. Staged."""
    return _compared(docs, False, threshold, n, **how)


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, **how) -> DataFrame:
    """doc_a < doc_b and jaccard of every pair of documents with a similarity of `threshold` or more.

    Exact. A text of 1 to n - 1 words has one gram, all its words. Null texts and texts
    without words are in no pair, nor are rows without doc_id. Rows alike count once;
    an id that has several texts is paired through each of them, never with itself.
    Extra columns are dropped; an empty table gives no pairs.
    """
    docs = narrow(docs, {"doc_id": "bigint", "text": "string"})
    similar = similar_texts(docs, threshold, n, **how)
    ids = stage_table(_texts(docs.where("doc_id IS NOT NULL")).select("sig", "doc_id").distinct(), "ids")
    ids = small(ids)
    a, b = ids.toDF("sa", "a"), ids.toDF("sb", "b")
    near = similar.join(a, "sa").join(b, "sb").where("a <> b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "jaccard")
    same = a.join(b, F.expr("sa = sb AND a < b")).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(same)


def links(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, **how) -> DataFrame:
    """join() without the pairs that follow from copies: doc_a < doc_b and jaccard.

    Every text is stood for by its least doc_id. There is a pair for every two different
    texts with a similarity of `threshold` or more (also where one id has both: then
    doc_a = doc_b), and one of similarity 1 from each text's least doc_id to each other
    document that has it. Rows alike count once. Otherwise as join().
    """
    docs = narrow(docs, {"doc_id": "bigint", "text": "string"}).where("doc_id IS NOT NULL")
    similar = similar_texts(docs, threshold, n, **how)
    ids = stage_table(_texts(docs).select("sig", "doc_id").distinct(), "ids")
    least = stage_table(ids.groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "least")
    first = small(least.select("sig", "least"))
    near = similar.join(first.toDF("sa", "a"), "sa").join(first.toDF("sb", "b"), "sb").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "jaccard")
    same = ids.join(small(least.where("n > 1")), "sig").where("doc_id > least").select(F.col("least").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(same)


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, of all nodes but the roots. Large-star and small-star in turn, until nothing changes; edges has bigint columns u and v."""

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now, seen = stage_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"), None
    while True:
        if (m := mark(now)) == seen:
            return now.toDF("node", "root")
        seen = m
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        now = stage_table(star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m"))).distinct(), "edges")


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, **how) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every document that has a similar one.

    A class is a connected group of similar documents, class_id its least doc_id; n_links
    is the number of different texts that the document's text is similar to, n_copies
    that of other documents with its very text. An id that has several texts is one
    document: it links them, and its numbers are sums. Rows alike count once. Null texts,
    texts without words and rows without doc_id are in no class.
    """
    docs = narrow(docs, {"doc_id": "bigint", "text": "string"}).where("doc_id IS NOT NULL")
    linked = linked_texts(docs, threshold, n, **how)
    ids = stage_table(_texts(docs).select("sig", "doc_id").distinct(), "ids")
    several = ids.groupBy("doc_id").agg(F.min("sig").alias("v"), F.count("*").alias("texts")).where("texts > 1")
    own = ids.join(small(stage_table(several, "several")), "doc_id").where("sig <> v").select(F.col("sig").alias("u"), "v")
    root = components(linked.select(F.col("sig").alias("u"), F.col("root").alias("v")).unionByName(own)).toDF("sig", "root")
    degree = linked.groupBy("sig").agg(F.sum("links").alias("links"))
    copies = ids.groupBy("sig").agg((F.count("*") - 1).alias("copies"))
    texts = copies.join(degree, "sig", "left").join(root, "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
    rows = stage_table(ids.join(texts, "sig").groupBy("doc_id").agg(F.min("root").alias("root"), F.sum("links").alias("n_links"), F.sum("copies").alias("n_copies")), "members")
    groups = stage_table(rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members")).where("members > 1").select("root", "class_id"), "classes")
    return rows.join(small(groups), "root").select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, **how) -> DataFrame:
    """The columns of documents; of each connected group of similar documents the row with the least doc_id stays (nulls last, then by the row's hash).

    Null texts and texts without words are in no group: all stay. Of rows that are
    alike one stays, if they have words.
    """
    docs = narrow(docs, DOCUMENT)
    linked = linked_texts(docs, threshold, n, **how)
    root = components(linked.select(F.col("sig").alias("u"), F.col("root").alias("v")))
    row = row_key().alias("__row")
    rows = stage_table(_texts(docs).select("sig", "doc_id", row).groupBy("sig", "doc_id", "__row").agg(F.count("*").alias("times")), "rows")
    grouped = rows.join(root.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "__row")).alias("first"), F.count("*").alias("n"))
    # What isn't a group's only row: to be dropped, or alike with others and kept once.
    multiple = stage_table(grouped.join(first, "root").where("n > 1 OR times > 1").select("__row", (F.col("__row") == F.col("first.__row")).alias("one"), "times").where("NOT one OR times > 1").groupBy("__row").agg(F.max("one").alias("one")), "dropped")
    marked = docs.withColumn("__row", row_key()).join(small(multiple), "__row", "left")
    alone = marked.where("one IS NULL").select(*DOCUMENT)
    if multiple.where("one").isEmpty():
        return alone
    return alone.unionByName(marked.where("one").dropDuplicates(["__row"]).select(*DOCUMENT))
