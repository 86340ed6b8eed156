"""Exact top-k search by inner product on a bit-sliced index.

Components are quantised to floor(1024 * x). For each block of vectors the index holds, for
every dimension, one bitmap of the block's rows for each bit of the value (less the dimension's
least value, so that it is not negative). For a query the slices are added with bitmap
arithmetic: each slice counts by the bits of the query's component (complemented slices where
that is negative), slices of equal weight are added three at a time by a full adder until one
bitmap is left for each weight. The sum's slices are then walked from the most significant one
down to select the rows; rows that tie at the boundary are resolved exactly by vec_id. Sums are
whole numbers, so nothing is lost.

A block's index is built once and written to the shared folder. Packs of queries are sent to
every block, and all that a block's task gets is answered from one copy of its index; a block with
very many queries is dealt to several tasks. Only k rows for each query and block go on.

Defined results: vectors that are null, or hold a null or non-finite component, or whose id is
null, take no part; of rows with one id a query uses the least vector, and all rows of its id are
its own; shorter vectors count as ended by zeros; ties go to the smaller vec_id, equal rows are
each a candidate; an empty table gives no row. Vectors of any length are used whole. A component
of which floor(1024 * x) leaves 64 bits counts as the end of that range. Scores are added up and
ranked exactly up to 38 decimal digits (larger ones are equal to the largest), and returned as the
end of the range of 64 bits where they leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import cut

BLOCK = 1 << 15
#: Queries in a pack, and the most that one task is to answer for a block.
QUERIES = 64
TASK_QUERIES = 1 << 14
SCALE = 1024
#: Scores at most, either way: what a decimal of 38 digits holds.
MOST = 10**38 - 1
INDEX = "block int, ids binary, low binary, bits binary, slices binary"


def quantised(vector: Column) -> Column:
    """floor(1024 * x) of each component; null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE)))))


class Slices:
    """The bit-sliced index of one block."""

    def __init__(self, values: np.ndarray):
        """values: int64, a row for each vector."""
        self.rows, self.dims = values.shape
        self.low = values.min(axis=0) if self.rows else np.zeros(self.dims, np.int64)
        span = values.view(np.uint64) - self.low.view(np.uint64)  # right for any 64 bits, as it wraps
        self.bits = [int(m).bit_length() for m in span.max(axis=0)] if self.rows else [0] * self.dims
        self.words = -(-self.rows // 64)
        self.valid = self._packed(np.ones((self.rows, 1), bool))[0]
        self.slices = [self._packed((span[:, d : d + 1] >> np.arange(b, dtype=np.uint64)) & np.uint64(1)) for d, b in enumerate(self.bits)]

    @classmethod
    def read(cls, rows: int, low: bytes, bits: bytes, slices: bytes) -> Slices:
        own = cls.__new__(cls)
        own.rows, own.low, own.bits = rows, np.frombuffer(low, np.int64), [int(b) for b in np.frombuffer(bits, np.int32)]
        own.dims, own.words = len(own.low), -(-rows // 64)
        own.valid = own._packed(np.ones((rows, 1), bool))[0]
        flat = np.frombuffer(slices, np.uint64).reshape(-1, own.words)
        own.slices = np.split(flat, np.cumsum(own.bits)[:-1]) if own.bits else []
        return own

    def written(self) -> tuple[bytes, bytes, bytes]:
        """low, bits and slices as bytes."""
        flat = np.concatenate(self.slices) if self.slices else np.empty((0, self.words), np.uint64)
        return self.low.astype(np.int64).tobytes(), np.array(self.bits, np.int32).tobytes(), flat.tobytes()

    def _packed(self, bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits.astype(bool), axis=0, bitorder="little").T
        out = np.zeros((packed.shape[0], 8 * self.words), np.uint8)
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of each row's inner product, least significant first, less the offset."""
        offset, levels = sum(int(q) * int(x) for q, x in zip(query, self.low)), {}
        for d, q in enumerate(int(x) for x in query):
            if not q or not self.bits[d]:
                continue
            s = self.slices[d]
            if q < 0:  # q * s = |q| * (all ones - s) - |q| * all ones
                s = s ^ self.valid
                offset += q * ((1 << self.bits[d]) - 1)
            for shift in range(abs(q).bit_length()):
                if abs(q) >> shift & 1:
                    for b in range(self.bits[d]):
                        levels.setdefault(shift + b, []).append(s[b])
        out, level = [], 0
        while levels:
            stack = levels.pop(level, None)
            if stack is None:
                out.append(np.zeros(self.words, np.uint64))
            else:
                kept, carries = _added(np.stack(stack))
                out.append(kept)
                if len(carries):
                    levels.setdefault(level + 1, []).extend(carries)
            level += 1
        return out, offset

    def top(self, query: np.ndarray, k: int, ids: np.ndarray, skip: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best rows whose id isn't ``skip``."""
        slices, offset = self.sums(query)
        open_rows, sure = self.valid.copy(), np.zeros(self.words, np.uint64)
        for r in range(np.searchsorted(ids, skip, "left"), np.searchsorted(ids, skip, "right")):
            open_rows[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        have = 0
        for s in reversed(slices):
            ones = open_rows & s
            n = int(np.bitwise_count(ones).sum())
            if have + n > k:
                open_rows = ones
            else:
                sure |= ones
                have += n
                open_rows &= ~s
                if have == k:
                    break
        rows = np.concatenate([_set(sure), _set(open_rows)[: k - have]])  # ids ascend within the block
        scores = [offset] * len(rows)
        for weight, s in enumerate(slices):
            bits = (s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
            scores = [x + (int(bit) << weight) for x, bit in zip(scores, bits)]
        return [(int(ids[r]), x) for r, x in zip(rows, scores)]


def _added(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(the sum's slice of this weight, the slices carried to the next): full adders over a stack."""
    carries: list[np.ndarray] = []
    while len(x) > 2:
        n = len(x) // 3
        a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
        half = a ^ b
        carries.extend((a & b) | (half & c))
        x = np.concatenate([half ^ c, x[3 * n :]])
    if len(x) == 2:
        carries.append(x[0] & x[1])
        return x[0] ^ x[1], carries
    return x[0], carries


def _set(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _matrix(lists: list, dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def usable(vectors: DataFrame, is_query: Column, vector: str = "embedding") -> DataFrame:
    """vec_id, q (the quantised vector), asks of the rows that take part, written once."""
    rows = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", quantised(F.col(vector)).alias("q"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    return cut(rows.where("q is not null"))


def build(rows: DataFrame, blocks: int) -> DataFrame:
    """The bit-sliced index of all rows (vec_id, q): a row for each block."""
    # by place in the written table too, so equal rows spread over blocks
    of = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    held = rows.select("vec_id", "q").withColumn("block", of).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("vec_id", "q"))).alias("rows"))  # about BLOCK each

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block in enumerate(b.column("block").to_pylist()):
                rows = b.column("rows")[i].values
                lists = rows.field("q")
                lengths = lists.value_lengths().to_numpy()
                width = int(lengths.max(initial=0))
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lengths), width) if (lengths == width).all() else _matrix(lists.to_pylist(), width)
                made = [[block], [rows.field("vec_id").to_numpy().tobytes()], *([x] for x in Slices(values).written())]
                kinds = [pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds)], ["block", "ids", "low", "bits", "slices"])

    return cut(held.mapInArrow(sliced, INDEX))


def search(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best among all other rows."""
    rows = usable(vectors, is_query, vector)
    asking = rows.where("asks").groupBy("vec_id").agg(F.min("q").alias("q"))
    blocks, n = -(-rows.count() // BLOCK), asking.count()
    if not n:
        return rows.selectExpr("vec_id as query_id", "1 as rank", "vec_id", "vec_id as score").where("false")
    packs = -(-n // QUERIES)
    splits = max(-(-n // TASK_QUERIES), min(packs, -(-vectors.sparkSession.sparkContext.defaultParallelism // blocks)))
    pack = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(packs)).cast("int")
    packed = asking.groupBy(pack.alias("pack")).agg(F.collect_list(F.struct("vec_id", "q")).alias("queries"))  # about QUERIES each
    asked = packed.select((F.col("pack") % splits).alias("split"), "queries", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    index = build(rows, blocks).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    pairs = asked.join(index.hint("merge"), ["block", "split"]).select("block", "queries", "ids", "low", "bits", "slices")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, ids = None, None, None
        for b in batches:
            for i, block in enumerate(b.column("block").to_pylist()):
                if block != last:
                    raw = [b.column(c)[i].as_py() for c in ("ids", "low", "bits", "slices")]
                    ids, last = np.frombuffer(raw[0], np.int64), block
                    own = Slices.read(len(ids), *raw[1:])
                queries, out = b.column("queries")[i].values, []
                for query_id, q in zip(queries.field("vec_id").to_pylist(), queries.field("q").to_pylist()):
                    q = (q + [0] * own.dims)[: own.dims]
                    out += [(query_id, *x) for x in own.top(np.array(q, np.int64), k, ids, query_id)]
                scores = pa.array([Decimal(max(-MOST, min(MOST, x[2]))) for x in out], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)), scores], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = pairs.mapInArrow(found, "query_id long, vec_id long, score decimal(38,0)")
    ends = [F.lit(x).cast("decimal(38,0)") for x in (-(1 << 63), (1 << 63) - 1)]
    held = F.greatest(ends[0], F.least(ends[1], F.col("score"))).cast("long")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", held.alias("score"))
