"""Exact Jaccard join of documents on sets of word shingles, with count vectors in R-trees.

A document's set holds its distinct five-word shingles, as 64-bit hashes. Shingles are hashed into groups; the numbers of
a set's shingles in each group are its point. The sum over groups of the smaller of two counts bounds the overlap of two
sets from above, and the upper corner of an R-tree node does so for all points below it. The number of groups follows
the size of a set (a group for one or two shingles), so the bound tells sets of all sizes apart; points of neighbouring
resolutions are compared by folding the finer one.

One tree over a corpus prunes nothing near its root in so many dimensions, so the index is a forest. Sets of the wanted
similarity share one of the rarest quarter of their shingles (their prefix, in any one order of all shingles). Documents
that share such a shingle are a block, and blocks that have their document of smallest hash in common are one tree's
points. Every document of a tree's searches it, its leaves are ordered by size, and pairs that the tree lets through are
verified on the sets themselves.

The order of shingles puts those first whose hash is in a fixed part of its range (CLASS) and that few documents have.
Their document frequencies are counted exactly. A document that has as many shingles there that no document of similar
size shares as its prefix is long has no partner and goes no further, so what is left grows with the repetition in a
corpus. Shingles that are known to be common come last. The position of a shared shingle bounds what can follow it, and so
the size of a partner that meets the document there first.

No group's pairs are all written. A tree with few candidate pairs gives all of them; one with many gives, of each
document, the likeliest and one that all are likely to share, and stays open. Once those are verified and components
known, open trees are searched again for pairs across components: first the likeliest of each document and component,
then, as long as components stay apart, all the rest. Trees have a bounded size. Blocks beyond are cut into parts, a few
rows of each part meet in a block of a higher level, and the whole is searched across components in tiles of parts.
Components are found by label propagation over tables.

Hashes: two different shingles of a corpus of s distinct ones agree by chance with probability s * s / 2^65, which
matters only to a pair whose link hangs on that one.

Defined cases: null, empty and blank texts have an empty set and link to nothing; fewer than five words are one shingle;
repeated ids and rows give one row each, and ids stand for all their rows; a null id takes part in nothing and is its own
(null) component; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.common import done_with, map_arrow, stored, table

WORDS = 5
CLASS = 3 << 61  # hashes below, three eighths of all, come first in the order of shingles
BLOCK = 256  # documents of a block
SMALL = 64  # documents of a stretch of a block up to which it is looked into pair by pair
TREE = 4  # blocks' worth of documents of a tree
BLOCK_SHINGLES = 1 << 22  # their shingles
TOPS = 3  # documents of a part that stand for it on the next level
HOT = 8192  # documents from which a known shingle is dealt to several tasks
COMMON = 200_000  # shingles whose frequency the workers know
FANOUT = 16
LEAST_GROUPS, MOST_GROUPS = 4, 16  # powers of two
_CELLS = 1 << 22  # of points compared at once
_U = np.uint64
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = int(_RANDOM.integers(1 << 62, 1 << 63)) | 1
_POSITION = _RANDOM.integers(1, 1 << 63, WORDS, dtype=np.uint64) | _U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        _powers.clear()
        base, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        _powers[size] = np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    return _powers[size]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8).copy()
    data[(data >= 65) & (data <= 90)] += 32
    inside = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13)))])
    edge = np.nonzero(inside[1:] != inside[:-1])[0]
    start, end = edge[0::2], edge[1::2]
    power, inverse = _power(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
    words = _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    n = max(0, len(words) - WORDS + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(WORDS):
        runs += words[k : k + n] * _POSITION[k]
    runs = _mix(runs)
    lengths = np.array([len(p) + 1 for p in parts])
    bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(runs[a : b - WORDS + 1]))
        elif b > a:
            out.append(_mix((words[a:b] * _POSITION[: b - a]).sum(keepdims=True) + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _chunks(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """ids and texts of parts of a batch, of about `most` characters each."""
    ids, texts, held = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        ids.append(i)
        texts.append(t.as_py())
        held += len(texts[-1] or "")
        if held > most:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def needed(a, b, percent: int):
    """Smallest overlap of sets of sizes a and b with percent / 100 similarity: 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def counts_of(s: np.ndarray) -> bytes:
    """The point of a set: how many of its shingles each group has, in the smallest width that holds them."""
    power = int(power_of(np.array([len(s)]))[0])
    c = np.bincount((s & _U((1 << power) - 1)).astype(np.int64), minlength=1 << power)
    width = 1 if c.max(initial=0) < 256 else 4
    return bytes([width]) + c.astype(f"<u{width}").tobytes()


def point(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1)


def folded(p: np.ndarray) -> np.ndarray:
    """Points (rows) of half the resolution."""
    half = p.shape[-1] // 2
    wide = p.astype(np.uint32)
    out = wide[..., :half] + wide[..., half:]
    return out.astype(np.uint8) if out.max(initial=0) < 256 else out


class CountVectorTree:
    """A packed R-tree over points of group counts; a node keeps the upper corner of all points below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes)) if len(points) else np.zeros(0, np.int64)
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > FANOUT:
            p, least, most = self.levels[-1]
            at = np.arange(0, len(p), FANOUT)
            self.levels.append((np.maximum.reduceat(p, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def search(self, q: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of queries at points q: positions of queries and of points whose sets may be similar, and bounds of their
        overlaps."""
        top = len(self.levels[-1][0])
        at, node = np.repeat(np.arange(len(q)), top), np.tile(np.arange(top), len(q))
        bound = np.zeros(0, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            corners, least, most = self.levels[depth]
            ok = (percent * least[node] <= 100 * sizes[at]) & (100 * most[node] >= percent * sizes[at])
            at, node = at[ok], node[ok]
            step = max(1, _CELLS // corners.shape[1])
            bound = np.concatenate([np.zeros(0, np.int64), *(np.minimum(corners[node[k : k + step]], q[at[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(at), step))])
            ok = bound >= needed(sizes[at], least[node], percent)
            at, node, bound = at[ok], node[ok], bound[ok]
            if depth:
                below = node[:, None] * FANOUT + np.arange(FANOUT)
                real = below < len(self.levels[depth - 1][0])
                at, node = np.repeat(at, FANOUT)[real.ravel()], below[real]
        return at, self.order[node], bound


def power_of(n: np.ndarray) -> np.ndarray:
    """The resolution of the points of sets of these sizes, as a power of two."""
    return np.clip(np.floor(np.log2(np.maximum(n, 1))).astype(np.int64), LEAST_GROUPS, MOST_GROUPS)


def matrix(points: list[np.ndarray]) -> np.ndarray:
    return np.array(points, np.uint8 if all(x.dtype == np.uint8 for x in points) else np.uint32)


def candidates(asks: np.ndarray, held: np.ndarray, n: np.ndarray, points: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in asks and in held of documents whose sets may be similar, and how similar they are at most.

    A tree holds points of one resolution. Similar sets are at most one power of two apart, so documents search the tree
    of their own resolution, folded the one below, and the one above with that tree's points folded.
    """
    power = power_of(n)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    for g in np.unique(power[held]):
        js = held[power[held] == g]
        own = matrix([points[j] for j in js])
        tree = CountVectorTree(own, n[js])
        for h in (g - 1, g, g + 1):
            qs = asks[power[asks] == h]
            if len(qs):
                q = matrix([points[i] for i in qs])
                i, j, bound = (CountVectorTree(folded(own), n[js]) if h < g else tree).search(folded(q) if h > g else q, n[qs], percent)
                found.append((qs[i], js[j], bound))
    i, j, bound = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j, bound / np.maximum(1, n[i] + n[j] - bound)


def common_shingles(docs: DataFrame) -> dict[int, int]:
    """Frequencies of the most common shingles, as far as single tasks see them: they only order prefixes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept, seen = [], 0, set()

        def out() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            often = c >= 4
            return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(c[often])], names=["h", "c"])

        for batch in batches:
            for _, texts in _chunks(batch):
                for s in shingle_sets(texts):
                    if len(s) and (key := (len(s), int(s[0]), int(s[-1]))) not in seen:  # copies count once
                        seen.add(key)
                        held.append(s)
                        kept += len(s)
                if kept > 1_500_000:
                    yield out()
                    held, kept = [], 0
                    seen.clear()
        yield out()

    found = stored(map_arrow(docs, count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")), "common", few=True)
    step = F.floor(F.log2("c") * 8).cast("int")
    least, held = 1 << 30, 0
    for r in sorted(found.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        held += r["n"]
        if held > COMMON:
            break
        least = r["step"]
    return {r["h"]: r["c"] for r in found.where(step >= least).collect()}  # at most COMMON rows


def _salt(h: int, part: int) -> int:
    """The key under which a part of a hot shingle's documents are dealt."""
    return int(_mix(np.array([(h + 0x9E3779B97F4A7C15 * (part + 1)) % (1 << 64)], np.uint64)).view(np.int64)[0])


_DOCS = "id bigint, n bigint, digest binary, d bigint, point binary, p int, ahead int, first array<bigint>, rest array<bigint>"


def described(docs: DataFrame, common: dict[int, int], percent: int) -> DataFrame:
    """Of each document the size and digest of its set and, of the first of equal sets in a task, the point, the length p
    of its prefix, all shingles that come first in the order (by CLASS) and their number, and, if they are fewer than p, the
    next ones.

    A shingle that is known to be hot is replaced by one of its keys, by the document's id.
    """
    keys = np.array(sorted(common, key=lambda k: k % (1 << 64)), np.int64)
    times = np.array([common[int(k)] for k in keys], np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((keys.view(np.uint64), times))
    hot_from, first_class = HOT, _U(CLASS)

    def beyond(i: int, s: np.ndarray, t: np.ndarray, most: int) -> np.ndarray:
        """Keys of the rarest `most` of known shingles s, which t documents have."""
        order = np.lexsort((s, t))[:most]
        keys = s[order].view(np.int64).copy()
        for k in np.nonzero(t[order] > hot_from)[0]:
            parts = -(-int(t[order[k]]) // hot_from)
            keys[k] = _salt(int(keys[k]), int(_mix(np.array([i], np.int64).view(np.uint64))[0] % _U(parts)))
        return keys

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = sent.value
        known: set[bytes] = set()
        for batch in batches:
            for ids, texts in _chunks(batch):
                n, digests, points, lengths, aheads, firsts, rests = [], [], [], [], [], [], []
                for i, s in zip(ids, shingle_sets(texts), strict=True):
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    n.append(len(s))
                    digests.append(digest)
                    if i is None or not len(s) or digest in known:
                        for column in (points, lengths, aheads, firsts, rests):
                            column.append(None)
                        continue
                    if len(known) > 300_000:
                        known.clear()
                    known.add(digest)
                    points.append(counts_of(s))
                    p = len(s) - (-(-percent * len(s) // 100)) + 1
                    at = np.minimum(np.searchsorted(often, s), max(0, len(often) - 1))
                    is_common = often[at] == s if len(often) else np.zeros(len(s), bool)
                    rare = s[~is_common]
                    cut = int(np.searchsorted(rare, first_class))
                    rest = rare[cut : cut + max(0, p - cut)].view(np.int64)
                    if cut + len(rest) < p:
                        rest = np.concatenate([rest, beyond(i, s[is_common], times[at[is_common]], p - cut - len(rest))])
                    lengths.append(p)
                    aheads.append(cut)
                    firsts.append(rare[:cut].view(np.int64))
                    rests.append(rest)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                d = [int.from_bytes(x[:8], "little", signed=True) for x in digests]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip((ids, n, digests, d, points, lengths, aheads, firsts, rests), kinds, strict=True)], names=["id", "n", "digest", "d", "point", "p", "ahead", "first", "rest"]
                )

    return map_arrow(docs, describe, _DOCS)


def spare_rows(nodes: DataFrame) -> DataFrame:
    """Rows of sets that another row stands for: of those that describe one set, the row of the smallest id stays."""
    first = nodes.where("first")
    several = first.groupBy("digest").agg(F.min(F.struct("id", "row"))["row"].alias("stays"), F.count("*").alias("rows")).where("rows > 1").select("digest", "stays")
    return first.join(several, "digest").where("row <> stays").select("row")


def prefixes(whole: DataFrame, spare: DataFrame, percent: int) -> DataFrame:
    """key, id, n, d and m for every shingle of a document's prefix that some similar document may share; spare rows, whose
    sets other rows have, only count. m is the size of
    the largest document of which, by the shingle's position, it may be the first shared one.

    Of the shingles that come first in the order, those that no other document of a similar size has are counted, not
    listed: the prefix holds them before all others. That keeps the prefix's promise, as similar documents need to agree
    on the order of the shingles that they share, and on no other. Only row numbers and sizes travel with the shingles.
    """
    rows = whole.where("p is not null")
    met = rows.select(F.explode("first").alias("key"), "row", "n")
    by_size = Window.partitionBy("key").orderBy("n")
    neighbours = {"df": F.count("*").over(by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "below": F.lag("n").over(by_size), "above": F.lead("n").over(by_size)}
    near = (100 * F.col("below") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("above"))
    shared = met.withColumns(neighbours).where(near).select("key", "row", "df")
    own = Window.partitionBy("row")
    placed = shared.withColumns({"place": F.row_number().over(own.orderBy("df", "key")), "all": F.count("*").over(own)})
    known = placed.join(rows.select("row", "id", "n", "d", "p", "ahead").join(spare, "row", "left_anti"), "row")
    chosen = known.where(F.col("place") <= F.col("p") - F.col("ahead") + F.col("all")).withColumn("at", F.col("ahead") - F.col("all") + F.col("place"))
    listed = rows.where(F.size("rest") > 0).select("rest", "row", "id", "n", "d", "ahead").join(spare, "row", "left_anti")
    others = listed.select(F.posexplode("rest").alias("k", "key"), "id", "n", "d", "ahead").withColumn("at", F.col("ahead") + F.col("k") + 1)
    # the overlap with a document of size m must not exceed what comes from here on: percent (n + m) <= (100 + percent) (n + 1 - at)
    most = (F.floor((100 + percent) * (F.col("n") + 1 - F.col("at")) / percent) - F.col("n")).cast("long").alias("m")
    return chosen.select("key", "id", "n", "d", most).unionByName(others.select("key", "id", "n", "d", most))


_BLOCKS = "kind int, hub bigint, ids array<bigint>, h bigint, id bigint, n bigint, d bigint, m bigint"
_BLOCK, _TOP, _LONG = 0, 1, 2


class _Cutter:
    """Cuts rows that share a key into blocks. Gathers rows of _BLOCKS: blocks (ids, and that with the smallest hash), and
    of what is too long for one block, all rows and the few that stand for a part on the next level."""

    def __init__(self, percent: int, shingle_of: dict[int, int], size: int):
        self.percent, self.shingle_of, self.size = percent, shingle_of, size
        self.seen: set[tuple[int, int]] = set()
        self.rows: list[tuple] = []

    def run(self, key: int, ids: np.ndarray, n: np.ndarray, d: np.ndarray, m: np.ndarray, long: bool) -> None:
        """All rows of a key, or, if it is long, some: in parts of a bounded size."""
        long = long or key in self.shingle_of
        h = self.shingle_of.get(key, key)
        start, total = 0, np.cumsum(n)
        while start < len(ids):
            end = int(np.searchsorted(total, (total[start - 1] if start else 0) + BLOCK_SHINGLES, "right"))
            end = min(max(end, start + 1), start + self.size, len(ids))
            long = long or end < len(ids)
            self.parts(np.zeros(end - start, np.int64), ids[start:end], n[start:end], d[start:end], m[start:end], h if long else None)
            start = end

    def parts(self, run: np.ndarray, ids: np.ndarray, n: np.ndarray, d: np.ndarray, m: np.ndarray, h: int | None) -> None:
        """Rows of parts (numbered by run), each sorted by d: equal sets are one row; sizes that are too far apart do not
        share a block, and a document that can have no partner there is left out. h: the shingle of a part of a long
        key."""
        new = np.nonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (d[1:] != d[:-1]) | (n[1:] != n[:-1])]))[0]
        run, ids, n, d, m = run[new], np.minimum.reduceat(ids, new), n[new], d[new], np.maximum.reduceat(m, new)
        order = np.lexsort((d, n, run))
        run, ids, n, d, m = run[order], ids[order], n[order], d[order], m[order]
        if h is not None:
            self.rows += [(_LONG, None, None, h, int(i), int(x), None, None) for i, x in zip(ids, n, strict=True)]
        starts, ends = self.cuts(run, n)
        if h is not None:
            for a, b in zip(starts, ends, strict=True):
                self.rows += [(_TOP, None, None, h, int(ids[k]), int(n[k]), int(d[k]), int(m[k])) for k in a + np.argsort(d[a:b], kind="stable")[:TOPS]]
        keep = np.repeat(ends - starts > 1, ends - starts)
        for x in np.nonzero(ends - starts > 1)[0]:
            a, b = starts[x], ends[x]
            size, most = n[a:b], m[a:b]
            if b - a > SMALL:  # at least the smallest other document of a similar size must fit
                own = np.arange(b - a)
                least = np.searchsorted(size, -(-self.percent * size // 100))
                keep[a:b] = size[np.minimum(np.where(least == own, own + 1, least), b - a - 1)] <= most
                continue
            fits = (size[None, :] <= most[:, None]) & (100 * size[None, :] >= self.percent * size[:, None])
            fits &= fits.T
            np.fill_diagonal(fits, False)
            keep[a:b] = fits.any(1)
        run, ids, n = run[keep], ids[keep], n[keep]
        if not len(run):
            return
        starts, ends = self.cuts(run, n)
        hashes = _mix(ids.view(np.uint64))
        keys = np.add.reduceat(hashes, starts), np.add.reduceat(_mix(hashes), starts)
        several = np.nonzero(ends - starts > 1)[0]
        _, first = np.unique(keys[0][several], return_index=True)
        for x in several[first]:
            key = int(keys[0][x]), int(keys[1][x])
            if key not in self.seen:
                if len(self.seen) > 200_000:
                    self.seen.clear()
                self.seen.add(key)
                a, b = starts[x], ends[x]
                self.rows.append((_BLOCK, int(ids[a + hashes[a:b].argmin()]), ids[a:b], None, None, None, None, None))

    def cuts(self, run: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of stretches of one part whose sizes lie close."""
        starts = np.nonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (100 * n[:-1] < self.percent * n[1:])]))[0]
        return starts, np.concatenate([starts[1:], [len(run)]])

    def out(self) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * 5)
        cols = list(zip(*self.rows, strict=True)) or [()] * len(kinds)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "hub", "ids", "h", "id", "n", "d", "m"])


def blocks(rows: DataFrame, percent: int, shingle_of: dict[int, int], size: int) -> DataFrame:
    """Rows of _BLOCKS from rows of key, id, n, d and m, which come by key, sorted by key and d. No more than a part of a
    key's rows, or a batch, is held."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(percent, shingle_of, size)
        known = np.array(sorted(shingle_of), np.int64)
        none = [np.zeros(0, np.int64)] * 5
        held, long = none, False  # rows of the last key so far; whether parts of it are cut already
        for batch in batches:
            key, ids, n, d, m = (np.concatenate([x, y.to_numpy(zero_copy_only=False)]) for x, y in zip(held, batch.columns, strict=True))
            edges = np.nonzero(key[1:] != key[:-1])[0] + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
            special = (ends - starts > size) | np.isin(key[starts], known)
            special[0] |= long
            plain = (ends - starts > 1) & ~special
            plain[-1] = special[-1] = False
            for k in np.nonzero(special)[0]:
                a, b = starts[k], ends[k]
                cutter.run(int(key[a]), ids[a:b], n[a:b], d[a:b], m[a:b], long and k == 0)
            if plain.any():
                lengths = ends - starts
                at = np.repeat(plain, lengths)
                run = np.repeat(np.arange(len(starts)), lengths)[at]
                heavy = np.bincount(run, n[at], len(starts)) > BLOCK_SHINGLES
                for k in np.nonzero(heavy)[0]:
                    a, b = starts[k], ends[k]
                    cutter.run(int(key[a]), ids[a:b], n[a:b], d[a:b], m[a:b], False)
                light = ~heavy[run]
                if light.any():
                    cutter.parts(run[light], ids[at][light], n[at][light], d[at][light], m[at][light], None)
            long = long and len(starts) == 1
            a = int(starts[-1])
            if len(key) - a > size:  # whole parts of a key that goes on
                b = a + (len(key) - a) // size * size
                b -= size if b == len(key) else 0
                cutter.run(int(key[a]), ids[a:b], n[a:b], d[a:b], m[a:b], True)
                a, long = b, True
            held = [x[a:] for x in (key, ids, n, d, m)]
            if len(cutter.rows) > 20_000:
                yield cutter.out()
        if len(held[0]) > 1 or long or (len(held[0]) and int(held[0][0]) in shingle_of):
            cutter.run(int(held[0][0]), *held[1:], long)
        yield cutter.out()

    return map_arrow(rows, cut, _BLOCKS)


def packed(lists: DataFrame, most: int) -> DataFrame:
    """k, k2 and id: the documents of each tree, of blocks (hub, ids) that have their hub in common. A hub has several
    trees if its blocks have more than `most` documents; every block is in one as a whole."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, number, held = None, 0, set()
        rows: list[np.ndarray] = []

        def close() -> None:
            rows.append(np.stack([np.full(len(held), hub), np.full(len(held), number), np.fromiter(held, np.int64, len(held))]))

        def out() -> pa.RecordBatch:
            found = np.concatenate([np.zeros((3, 0), np.int64), *rows], axis=1)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["k", "k2", "id"])

        for batch in batches:
            values = batch.column(1)
            for key, ids in zip(batch.column(0).to_pylist(), values, strict=True):
                more = ids.values.to_numpy()
                if key != hub:
                    if held:
                        close()
                    hub, number, held = key, 0, set(more.tolist())
                    continue
                grown = held.union(more.tolist())
                if len(grown) > most and len(grown) > len(held):
                    close()
                    number, held = number + 1, set(more.tolist())
                else:
                    held = grown
            if sum(x.shape[1] for x in rows) > 50_000:
                yield out()
        if held:
            close()
        yield out()

    return map_arrow(lists.select("hub", "ids").repartition("hub").sortWithinPartitions("hub"), pack, "k bigint, k2 bigint, id bigint")


def forest(rows: DataFrame, percent: int, shingle_of: dict[int, int], size: int = BLOCK) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The documents of all trees (k, k2, id); those of shingles whose documents are no single block (hub, id); tables to
    remove."""
    dealt = lambda rows: rows.repartition("key").sortWithinPartitions("key", "d")
    found = [stored(blocks(dealt(rows), percent, shingle_of, size), "blocks", few=True)]
    before = None
    while True:  # each level has far fewer rows
        tops = found[-1].where(F.col("kind") == _TOP)
        n = tops.count()
        if not n or (before is not None and n >= before):
            break
        before = n
        found.append(stored(blocks(dealt(tops.select(F.col("h").alias("key"), "id", "n", "d", "m").distinct()), percent, {}, size), "blocks", few=True))
    every = found[0].where(F.col("kind") == _BLOCK)
    for more in found[1:]:
        every = every.unionByName(more.where(F.col("kind") == _BLOCK))
    trees = stored(packed(every, TREE * size), "forest", few=True)
    long = found[0].where(F.col("kind") == _LONG).select("h", "id")
    # shingles with a document in common, that of the smallest hash, are one
    hubs = stored(long.groupBy("h").agg(F.min_by("id", F.xxhash64("id")).alias("hub")), "hubs", few=True)
    return trees, stored(long.join(hubs, "h").select("hub", "id").distinct(), "long", few=True), [*found, hubs]


_FIRST, _BEST, _REST = 0, 1, 2
_FOUND = "a bigint, b bigint, k bigint, k2 bigint"


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come sorted by keys, in tables that cut no group, with the start of each group and the end."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        columns = [rows.column(k).to_numpy() for k in keys]
        edges = np.nonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))[0] + 1
        if not len(edges):
            held = rows
            continue
        held = rows.slice(edges[-1])
        yield rows.slice(0, edges[-1]).combine_chunks(), np.concatenate([[0], edges])
    if held is not None and len(held):
        yield held.combine_chunks(), np.array([0, len(held)])


def points_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Points without a copy."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        offsets = np.frombuffer(chunk.buffers()[1], np.int32, len(chunk) + 1, 4 * chunk.offset)
        data = np.frombuffer(chunk.buffers()[2], np.uint8)
        out += [data[a + 1 : b] if data[a] == 1 else data[a + 1 : b].copy().view("<u4") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def search(members: DataFrame, percent: int, mode: int) -> DataFrame:
    """Pairs a, b that the trees of each block let through; members has k, k2, id, n, point, side (1 asks, 2 is held, 3
    both) and label. Blocks that have more than the pairs given come as a row of k and k2 alone.

    Mode _FIRST gives all pairs of a block with few, else of each document the likeliest and that with the smallest hash
    (so that documents of many blocks agree on it). The other modes give pairs across labels: of each document the
    likeliest with each label, or all.
    """

    def block(ids: np.ndarray, n: np.ndarray, points: list[np.ndarray], side: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        i, j, likely = candidates(np.nonzero(side & 1)[0], np.nonzero(side & 2)[0], n, points, percent)
        ok = (ids[i] != ids[j]) if mode == _FIRST else (ids[i] != ids[j]) & (label[i] != label[j])
        i, j, likely = i[ok], j[ok], likely[ok]
        if not len(i) or mode == _REST or (mode == _FIRST and len(i) <= 4 * len(ids)):
            return i, j, False
        if mode == _BEST:
            order = np.lexsort((ids[j], -likely, label[j], i))
            i, j = i[order], j[order]
            new = np.concatenate([[True], (i[1:] != i[:-1]) | (label[j][1:] != label[j][:-1])])
            return i[new], j[new], False
        out = []
        hashes = _mix(ids.view(np.uint64))
        for order in (np.lexsort((ids[j], -likely, i)), np.lexsort((hashes[j], i))):
            x, y = i[order], j[order]
            new = np.concatenate([[True], x[1:] != x[:-1]])
            out.append((x[new], y[new]))
        down = hashes[out[1][1]] < hashes[out[1][0]]
        return np.concatenate([out[0][0], out[1][0][down]]), np.concatenate([out[0][1], out[1][1][down]]), True

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[np.ndarray] = []
        more: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            both = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), axis=0)
            a, b = [*both[:, 0], *[None] * len(more)], [*both[:, 1], *[None] * len(more)]
            k, k2 = [[*[None] * len(both), *(x[c] for x in more)] for c in (0, 1)]
            pairs.clear(), more.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, k, k2)], names=["a", "b", "k", "k2"])

        for rows, edges in whole_groups(batches, ("k", "k2")):
            ids, n, side, k, k2 = (rows.column(c).to_numpy() for c in ("id", "n", "side", "k", "k2"))
            label = ids if mode == _FIRST else rows.column("label").to_numpy()
            points = points_of(rows.column("point"))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    i, j, still_open = block(ids[a:b], n[a:b], points[a:b], side[a:b], label[a:b])
                    if len(i):
                        x, y = ids[a:b][i], ids[a:b][j]
                        pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
                    if still_open:
                        more.append((int(k[a]), int(k2[a])))
            if sum(map(len, pairs)) > 20_000:
                yield out()
        yield out()

    rows = members.select("k", "k2", "id", "n", "point", "side", F.coalesce("label", "id").alias("label")).repartition("k").sortWithinPartitions("k", "k2")
    return map_arrow(rows, find, _FOUND)


def tiles(long: DataFrame, labels: DataFrame, size: int = BLOCK) -> DataFrame:
    """k, k2, id and side: of each long block whose documents are in several components, the documents outside its largest
    component against all, in tiles of bounded parts."""
    own = long.join(labels, "id", "left").select("hub", "id", F.coalesce("label", "id").alias("label"))
    sizes = own.groupBy("hub", "label").agg(F.count("*").alias("rows"))
    main = sizes.groupBy("hub").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), F.max("rows").alias("most"), F.sum("rows").alias("rows")).where("rows > most")
    main = stored(main.select("hub", "main", F.ceil(F.col("rows") / size).cast("int").alias("parts"), F.ceil((F.col("rows") - F.col("most")) / size).cast("int").alias("outer")), "main", few=True)
    both = own.join(main, "hub")
    part = lambda col, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(col)).cast("int")
    each = lambda col: F.explode(F.sequence(F.lit(0), F.col(col) - 1))
    asks = both.where("label <> main").select("hub", "id", part("outer", "i").alias("i"), each("parts").alias("j"), F.lit(1).alias("side"))
    held = both.select("hub", "id", each("outer").alias("i"), part("parts", "j").alias("j"), F.lit(2).alias("side"))
    return asks.unionByName(held).select(F.xxhash64("hub", "i", "j").alias("k"), F.xxhash64("j", "hub", "i").alias("k2"), "id", "side")


BITS = 1 << 23


def _slot(ids: np.ndarray) -> np.ndarray:
    return (_mix(ids.astype(np.int64).view(np.uint64)) % _U(BITS)).astype(np.int64)


def sets_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """id and set of (at least) all documents that occur in pairs. A bitmap of fixed size keeps most others out."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for batch in batches:
            bits[_slot(batch.column(0).to_numpy())] = True
            bits[_slot(batch.column(1).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    # at most 8 bitmaps of a fixed size
    marks = map_arrow(pairs.select("a", "b").coalesce(8), mark, "bits binary").collect()
    all_bits = np.zeros(BITS // 8, np.uint8)
    for r in marks:
        all_bits |= np.frombuffer(r["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(all_bits.tobytes())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(wanted[_slot(batch.column(0).to_numpy())]))
            for ids, texts in _chunks(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], names=["id", "set"])

    return map_arrow(docs, build, "id bigint, set binary")


SETS_PER_BATCH = 256


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sets are similar enough, as a stored table."""
    sets = stored(sets_of(docs, pairs), "sets")
    of = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "set_a", "set_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                same = int((q[at] == p).sum())
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = stored(map_arrow(both, verify, "a bigint, b bigint").distinct(), "links", SETS_PER_BATCH, few=True)
    done_with(sets)
    return links


def components(edges: DataFrame) -> DataFrame:
    """id and label (smallest reachable id) of all ids in edges a, b: neighbours' smallest labels, then the label's
    own label, until nothing changes. Every round is a written table."""
    arcs = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "arcs", few=True)
    old = labels = stored(arcs.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels", few=True)
    while True:
        near = arcs.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        jumped = least.join(labels.select(F.col("id").alias("next"), F.col("label").alias("jump")), "next", "left")
        new = stored(jumped.select("id", F.coalesce("jump", "next").alias("label"), (F.coalesce("jump", "next") != F.col("label")).alias("moved")), "labels", few=True)
        done_with(old)
        old, labels = new, new.select("id", "label")
        if not new.where("moved").limit(1).count():
            done_with(arcs)
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after further links: components of the few labels that the links join."""
    of = lambda x: labels.select(F.col("id").alias(x), F.col("label").alias(f"in_{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("in_a", "a").alias("a"), F.coalesce("in_b", "b").alias("b")).where("a <> b")
    joined = components(ends)
    moved = labels.join(joined.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return stored(moved.unionByName(joined.join(labels, "id", "left_anti").select("id", "label")), "labels", few=True)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_shingles and component_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    common = common_shingles(rows)
    shingle_of = {_salt(h, part): h for h, c in common.items() if c > HOT for part in range(-(-c // HOT))}
    whole = stored(described(rows, common, percent).withColumn("row", F.monotonically_increasing_id()), "described")
    nodes = stored(whole.select("row", "id", "n", "digest", F.col("point").isNotNull().alias("first")), "nodes", few=True)
    spare = stored(spare_rows(nodes), "spare", few=True)
    points = stored(whole.where("point is not null").select("id", "n", "point"), "points")
    trees, long, spent = forest(prefixes(whole, spare, percent), percent, shingle_of, block)
    done_with(whole, spare)
    # ids of equal sets, and of several sets under one id
    same = stored(nodes.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "copied", few=True)
    several = nodes.where("n > 0 and id is not null").groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("id")
    twice = nodes.join(same, "digest").select("id", "least", "first")
    equal = twice.where("first").select(F.col("least").alias("a"), F.col("id").alias("b")).unionByName(twice.join(several, "id").select(F.col("least").alias("a"), F.col("id").alias("b")))
    first = trees.join(points, "id").select("*", F.lit(3).alias("side"), F.lit(None).cast("long").alias("label"))
    found = stored(search(first, percent, _FIRST), "found", few=True)
    tested = stored(found.where("a is not null").select("a", "b").distinct(), "pairs", few=True)
    still_open = found.where("k is not null").select("k", "k2").distinct()
    labels = components(verified(tested, rows, percent).unionByName(equal.where("a <> b").distinct()))
    for mode in (_BEST, _REST):
        own = trees.join(still_open, ["k", "k2"], "left_semi").join(labels, "id", "left").select("k", "k2", "id", F.coalesce("label", "id").alias("label"))
        apart = own.groupBy("k", "k2").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("k", "k2")
        asked = own.join(apart, ["k", "k2"], "left_semi").select("k", "k2", "id", F.lit(3).alias("side"))
        asked = stored(asked.unionByName(tiles(long, labels, block)), "asked", few=True)
        if not asked.limit(1).count():
            break
        across = search(asked.join(points, "id").join(labels, "id", "left"), percent, mode)
        more = stored(across.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs", few=True)
        if more.limit(1).count():
            labels = merged(labels, verified(more, rows, percent))
            tested = tested.unionByName(more)
        done_with(asked)
    done_with(points, *spent)
    vertex = nodes.select("id", "n", "digest").join(same, "digest", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("vertex"))
    both = vertex.join(labels.withColumnRenamed("id", "vertex"), "vertex", "left")
    return both.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "vertex").alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
