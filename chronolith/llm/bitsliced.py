"""Exact top-k inner-product search with a bit-sliced index.

Rows are packed into blocks. A block stores each quantised attribute as bit slices: one bitmap over the block's rows for
each bit. For a query the weighted sum of all attributes is formed by bitmap arithmetic (carry-save adders over whole
bitmaps, for many queries at once); the best rows are then taken from the most significant slice of the sum downward.
Rows within the quantisation error of the k-th best sum are the boundary: their exact integer scores decide.

Row blocks are dealt once to lanes of a bounded number of rows. A lane builds the slices of its blocks once and streams
all queries past them, in blocks; only queries (a hundredth of the rows, say) are copied to lanes. What a lane keeps of a
query is its k best, so a later block of the lane has a floor to beat.

Defined cases: vectors that are null or empty, or hold null or non-finite components, take no part, nor do rows without
an id, nor vectors of d components of which one exceeds the square root of 2^62 / d in size after scaling, as sums of
their products need not fit 64 bits; in a block shorter vectors are filled with zeros; repeated query ids are one query
(the smallest vector); repeated rows are separate candidates; fewer than k candidates: all; empty table: empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.common import map_arrow, table

ROWS = 4096  # rows of a block
QUERIES = 1024  # queries of a block
LANE = 1 << 18  # rows of a lane
STEP = 64  # queries whose sums are formed at once
BITS = 6  # of a quantised attribute

_PACKED = "ids binary, dims int, data binary"


def _matrix(ids: pa.Array, vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer vectors of the rows that take part."""
    rows, kept = [], []
    for i, v in zip(ids.to_pylist(), vectors, strict=True):
        if i is None or not v.is_valid or v.values is None or not len(v.values) or v.values.null_count:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all() and np.abs(x).max() * scale <= math.sqrt((1 << 62) / len(x)):
            kept.append(i)
            rows.append(x)
    dims = max(map(len, rows), default=0)
    out = np.zeros((len(rows), dims), np.int64)
    for k, x in enumerate(rows):
        out[k, : len(x)] = np.floor(scale * x)
    return np.array(kept, np.int64), out


def _pack(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    """A block in the smallest width that holds its integers."""
    top = max(1, int(np.abs(m).max(initial=0)))
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    data = bytes([width]) + m.astype(f"<i{width}").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([m.shape[1]], pa.int32()), pa.array([data], pa.binary())], names=["ids", "dims", "data"])


def _unpack(ids: bytes, dims: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(-1, dims)


def _wide(m: np.ndarray, dims: int) -> np.ndarray:
    return m if m.shape[1] == dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))


def pack_rows(vectors: DataFrame, scale: int, size: int = ROWS) -> DataFrame:
    """Blocks of at most size rows, packed where the rows are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                held.append(batch.slice(i, size))
                if sum(b.num_rows for b in held) >= size:
                    yield from packed(held)
                    held = []
        yield from packed(held)

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, m = _matrix(t.column(0).combine_chunks(), t.column(1).combine_chunks(), scale)
            for i in range(0, len(ids), size):
                yield _pack(ids[i : i + size], m[i : i + size])

    return map_arrow(vectors.select("id", "vector"), pack, _PACKED)


class BitSlicedBlock:
    """Bit slices of the quantised attributes of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, bits: int = BITS):
        self.ids, self.m = ids, m
        top = int(max(m.max(initial=0), -(m.min(initial=0) + 1)))
        self.shift = max(0, top.bit_length() + 1 - bits)
        self.bits = max(1, top.bit_length() + 1 - self.shift)
        u = (m.astype(np.int64) >> self.shift) + (1 << (self.bits - 1))  # from 0
        n = len(ids)
        self.words = max(1, -(-n // 64))
        flat = np.zeros((m.shape[1], self.bits, self.words * 64), np.uint8)
        for k in range(self.bits):
            flat[:, k, :n] = ((u >> k) & 1).T
        self.slices = np.packbits(flat, axis=-1, bitorder="little").view(np.uint64)
        valid = np.zeros(self.words * 64, np.uint8)
        valid[:n] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    def sums(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum of |q_d| * v_d for each query (row of q) and row of the block;
        v_d is the quantised attribute, or its complement where q_d is negative."""
        shape = (len(q), self.words)
        waits: list[list[np.ndarray]] = []

        def add(at: int, x: np.ndarray) -> None:
            while True:
                while len(waits) <= at:
                    waits.append([])
                waits[at].append(x)
                if len(waits[at]) < 3:
                    return
                a, b, c = waits[at]
                ab = a ^ b
                waits[at] = [ab ^ c]
                x = (a & b) | (ab & c)
                at += 1

        size = np.abs(q)
        negative = np.where(q < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        for d in range(q.shape[1]):
            flip = negative[:, d, None]
            own = [flip ^ self.slices[d, k][None, :] for k in range(self.bits)]
            for j in range(int(size[:, d].max(initial=0)).bit_length()):
                used = -((size[:, d] >> j) & 1).astype(np.uint64)[:, None]
                for k in range(self.bits):
                    add(j + k, own[k] & used)
        out, carry, at = [], None, 0
        while at < len(waits) or carry is not None:
            terms = (waits[at] if at < len(waits) else []) + ([carry] if carry is not None else [])
            carry = None
            if len(terms) == 3:
                a, b, c = terms
                out.append(a ^ b ^ c)
                carry = (a & b) | ((a ^ b) & c)
            elif len(terms) == 2:
                out.append(terms[0] ^ terms[1])
                carry = terms[0] & terms[1]
            else:
                out.append(terms[0] if terms else np.zeros(shape, np.uint64))
            at += 1
        return out

    def top(self, query_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, exact score) of all rows that may be among a query's k best, none of them its own.

        floor: for each query a score that k rows elsewhere reach.
        """
        slices = self.sums(q)
        alive = np.repeat(self.valid[None, :], len(q), 0)
        order = np.argsort(self.ids, kind="stable")
        at = np.searchsorted(self.ids, query_ids, sorter=order)
        for i, p in enumerate(at):
            while p < len(order) and self.ids[order[p]] == query_ids[i]:
                r = int(order[p])
                alive[i, r // 64] &= ~np.uint64(1 << (r % 64))
                p += 1
        # the k-th largest sum, bit by bit from the most significant slice
        more, tied, kth = np.zeros_like(alive), alive.copy(), [0] * len(q)
        for i in range(len(slices) - 1, -1, -1):
            here = tied & slices[i]
            enough = np.bitwise_count(more | here).sum(1) >= k
            more = np.where(enough[:, None], more, more | here)
            tied = np.where(enough[:, None], here, tied & ~slices[i])
            kth = [t | (1 << i) if e else t for t, e in zip(kth, enough.tolist(), strict=True)]
        # score = 2^shift * (sum + base) + rest, where rest lies between the two bounds
        size, negative = np.abs(q), np.minimum(q, 0)
        base = -(-negative).sum(1) * ((1 << self.bits) - 1) - (q.sum(1) << (self.bits - 1))
        least, most = negative.sum(1) * ((1 << self.shift) - 1), np.maximum(q, 0).sum(1) * ((1 << self.shift) - 1)
        del size
        bound = []
        for i in range(len(q)):
            reach = max(((kth[i] + int(base[i])) << self.shift) + int(least[i]), int(floor[i]))
            bound.append(max(0, -(-(reach - int(most[i])) // (1 << self.shift)) - int(base[i])))
        # rows whose sum is at least the bound
        over, equal = np.zeros_like(alive), alive
        for i in range(max(len(slices), max(x.bit_length() for x in bound)) - 1, -1, -1):
            s = slices[i] if i < len(slices) else np.zeros_like(alive)
            one = np.array([(x >> i) & 1 for x in bound], bool)[:, None]
            over = np.where(one, over, over | (equal & s))
            equal = np.where(one, equal & s, equal & ~s)
        found = np.unpackbits((over | equal).view(np.uint8), axis=1, bitorder="little")
        qi, ri = np.nonzero(found)
        return qi, ri, np.einsum("ij,ij->i", q[qi], self.m[ri].astype(np.int64))


def _best(k: int, qi: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Positions of each query's k best: highest score, ties to the smaller id."""
    order = np.lexsort((ids, -scores, qi))
    q = qi[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


def search(blocks: Iterator[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Top k of each query over the rows of each lane. Blocks come by lane: part 0 are rows, the others are queries."""
    lane: int | None = None
    sliced: list[BitSlicedBlock] = []
    for batch in blocks:
        cols = batch.to_pydict()
        for own, part, ids, dims, data in zip(*(cols[c] for c in ("lane", "part", "ids", "dims", "data")), strict=True):
            if own != lane:
                lane, sliced = own, []
            row_ids, m = _unpack(ids, dims, data)
            if part == 0:
                sliced.append(BitSlicedBlock(row_ids, m, bits))
            else:
                yield from _over(sliced, row_ids, m.astype(np.int64), k, bits)


def _over(sliced: list[BitSlicedBlock], query_ids: np.ndarray, q: np.ndarray, k: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query over all blocks."""
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for block in sliced:
        dims = max(block.m.shape[1], q.shape[1])
        if block.m.shape[1] < dims:
            block = BitSlicedBlock(block.ids, _wide(block.m, dims), bits)
        asked = _wide(q, dims)
        floor, low = np.full(len(q), -(1 << 62), np.int64), np.full(len(q), 1 << 62, np.int64)
        count = np.bincount(best[0], minlength=len(q))
        np.minimum.at(low, best[0], best[2])
        floor[count >= k] = low[count >= k]
        parts = [best]
        for i in range(0, len(q), STEP):
            qi, ri, score = block.top(query_ids[i : i + STEP], asked[i : i + STEP], k, floor[i : i + STEP])
            parts.append((qi + i, block.ids[ri], score))
        merged = tuple(np.concatenate([p[c] for p in parts]) for c in range(3))
        keep = _best(k, *merged)
        best = tuple(x[keep] for x in merged)
    if len(best[0]):
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, bits: int = BITS) -> DataFrame:
    """query_id, rank, id_col and score of each query's k highest integer inner products with other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null and vector is not null").groupBy("id").agg(F.min("vector").alias("vector"))
    lanes = max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / LANE))
    dealt = pack_rows(rows, scale).select(F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int").alias("lane"), F.lit(0).alias("part"), "ids", "dims", "data")
    packed = pack_rows(asked, scale, QUERIES).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).select("lane", F.lit(1).alias("part"), "ids", "dims", "data")
    by_lane = dealt.unionByName(packed).repartition(lanes, "lane").sortWithinPartitions("lane", "part")
    best = map_arrow(by_lane, lambda blocks: search(blocks, k, bits), "query_id bigint, id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
