"""Byte-level BPE encoding and decoding with overlapping chunks.

A text of more than ``CHUNK`` code points is cut into chunks that overlap by ``OVERLAP``. The
chunks are dealt over all tasks and pre-tokenised in parallel, each for itself. Where a pre-token
ends depends only on what follows its start, so as soon as two neighbouring chunks have a
boundary at one place, before the first one's cut can have had an influence, they agree from
there on: that is where they are stitched. Only the boundaries within the overlaps meet for that.
The text between two stitches is then encoded as a segment of its own, again in parallel: each
pre-token by merging bytes in order of rank. Where an overlap has no such place (a pre-token
longer than it), the chunks from there on stay one segment. Decoding concatenates the ids' raw
bytes. Texts of up to ``CHUNK`` code points are one chunk and never leave their task.

Defined results: a null text is the empty text, without ids; repeated rows are encoded one by
one; extra columns are ignored; any text decodes to its own UTF-8 bytes; unknown ids raise.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import cut, each, texts_of

CHUNK = 1 << 16
OVERLAP = 1 << 10
#: Code points before a cut within which a boundary may depend on what was cut off.
UNSURE = 4
#: Above any rank.
NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of base64 bytes and rank, one pair a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def marks(text: str, start: int, length: int, pattern: regex.Pattern, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries of a chunk in its overlaps: with the chunk before, and sure ones with the next.

    text: the chunk, which begins at ``start`` in a text of ``length`` code points. Boundaries
    after white space are no places to cut: what a run of it ends in depends on what follows it.
    """
    heads, tails, p, last = [], [], start, " "
    end = min(length, start + chunk)
    for piece in [*pattern.findall(text), ""]:
        if start and p <= start + overlap:
            heads.append(p)
        if end < length and start + chunk - overlap <= p <= end - UNSURE and not last.isspace():
            tails.append(p)
        p += len(piece)
        last = piece[-1:]
    return heads, tails


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank is merged until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 256:
        return _merged_long(piece, ranks)
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
    while pairs:
        least = min(pairs)
        if least == NEVER:
            break
        i = pairs.index(least)
        part = parts[i] = parts[i] + parts.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + part, NEVER)
        if i < len(pairs):
            pairs[i] = get(part + parts[i + 1], NEVER)
    return [ranks[p] for p in parts]


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs over a linked list: n log n in the piece's length."""
    n = len(piece)
    size, right, left = [1] * n, [*range(1, n), -1], [-1, *range(n - 1)]
    heap = []

    def offer(i: int) -> None:
        j = right[i]
        if j >= 0:
            rank = ranks.get(piece[i : j + size[j]])
            if rank is not None:
                heap.append((rank, i, size[i], size[j])) if not ready else heapq.heappush(heap, (rank, i, size[i], size[j]))

    ready = False
    for i in range(n):
        offer(i)
    heapq.heapify(heap)
    ready = True
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if size[i] != a or j < 0 or size[j] != b:
            continue
        size[i], size[j], right[i] = a + b, 0, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i >= 0:
        out.append(ranks[piece[i : i + size[i]]])
        i = right[i]
    return out


class Encoder(dict):
    """pre-token -> its ids, remembered up to a number of ids.

    When the memory is full it becomes the older one, from which what is met again is taken over,
    so frequent pre-tokens stay. Ids are the numbers of ``ranks`` themselves, so one takes 8 bytes.
    """

    LIMIT = 750_000  # ids and pre-tokens, twice, in every Python worker: about 170,000 of 3 to 4 ids, 180 bytes each

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.said = {i: b"%d" % i for i in ranks.values()}
        self.older: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.older.get(piece)
        if found is None:
            found = tuple(merged(piece.encode(), self.ranks))  # tuples of numbers cost the garbage collector nothing
        if len(piece) <= 64:
            self.held += 1 + len(found)
            if self.held > self.LIMIT:
                self.older, self.held = dict(self), 1 + len(found)
                self.clear()
            self[piece] = found
        return found

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def say(self, ids: list[int]) -> bytes:
        """Decimal ids joined by one space."""
        return b" ".join(map(self.said.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return [*chain.from_iterable(map(self.__getitem__, self.pattern.findall(text)))]


def _encoder(raw: bytes, pattern: str) -> Encoder:
    ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, filter(bytes.strip, raw.splitlines()))}
    return Encoder(ranks, pattern)


class _Job:
    """What the stages of one encoding share: the rank file's bytes (under 1 MB), the pattern, the sizes."""

    def __init__(self, documents: DataFrame, path: str, pattern: str, chunk: int, overlap: int):
        if not UNSURE < overlap <= chunk // 2:
            raise ValueError("chunks must overlap by more than a few code points and at most by half")
        with open(path, "rb") as f:
            self.raw = documents.sparkSession.sparkContext.broadcast(f.read())
        self.pattern, self.chunk, self.overlap = pattern, chunk, overlap
        rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        self.short, self.long = rows.where(F.length("text") <= chunk), rows.where(F.length("text") > chunk)


def _segments(job: _Job) -> DataFrame:
    """row, doc_id, segment, text: the long texts cut where their chunks are stitched."""
    chunk, overlap, pattern = job.chunk, job.overlap, job.pattern
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(chunk - overlap))
    cuts = F.transform(starts, lambda s, i: F.struct(i.alias("no"), s.alias("start"), F.substring("text", s + 1, F.lit(chunk)).alias("text")))
    # numbered as they are written, so the numbers are fixed
    rows = job.long.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", n.alias("n"), F.explode(cuts).alias("c"))
    chunks = cut(rows.select("row", "doc_id", "n", "c.no", "c.start", "c.text").repartition("row", "no"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = regex.compile(pattern)
        for b, texts in texts_of(batches):
            found = [marks(t, s, m, own, chunk, overlap) for t, s, m in zip(texts, *(b.column(c).to_pylist() for c in ("start", "n")))]
            bounds = [pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "no", "start", "n")), *bounds], ["row", "no", "start", "n", "heads", "tails"])

    seen = chunks.select("row", "no", "start", "n", "text").mapInArrow(marked, "row long, no int, start int, n int, heads array<int>, tails array<int>")
    order = Window.partitionBy("row").orderBy("no")
    joint = F.array_min(F.array_intersect(F.lag("tails").over(order), "heads"))
    agreed = seen.select("row", "no", "start", "n", joint.alias("joint"))
    synced = F.min((F.col("no") == 0) | F.col("joint").isNotNull()).over(order.rowsBetween(Window.unboundedPreceding, 0))
    opened = agreed.withColumn("opens", synced).withColumn("lo", F.when((F.col("no") > 0) & synced, F.col("joint")).otherwise(F.col("start")))
    placed = opened.withColumns({"hi": F.coalesce(F.lead("lo").over(order), F.col("n")), "segment": F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    placed = placed.withColumn("alone", F.col("opens") & F.coalesce(F.lead("opens").over(order), F.lit(True)))
    part = F.substring("text", F.col("lo") - F.col("start") + 1, F.col("hi") - F.col("lo"))
    parts = chunks.select("row", "doc_id", "no", "text").join(placed, ["row", "no"]).select("row", "doc_id", "no", "segment", "alone", part.alias("text"))
    together = F.transform(F.sort_array(F.collect_list(F.struct("no", "text"))), lambda x: x["text"])
    joined = parts.where(~F.col("alone")).groupBy("row", "doc_id", "segment").agg(F.array_join(together, "").alias("text"))
    return parts.where("alone").select("row", "doc_id", "segment", "text").unionByName(joined)


def _long_ids(job: _Job) -> DataFrame:
    """row, doc_id, segment, ids (32-bit numbers) of the long texts."""
    raw, pattern = job.raw, job.pattern

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(raw.value, pattern)
        for b, texts in texts_of(batches):
            ids = pa.array([np.array(own.encode(t), np.int32).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "segment")), ids], ["row", "doc_id", "segment", "ids"])

    return _segments(job).mapInArrow(encoded, "row long, doc_id long, segment long, ids binary")


def encode(documents: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids of each whole text."""
    job = _Job(documents, path, pattern, chunk, overlap)
    raw = job.raw

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(raw.value, pattern)
        for b, texts in texts_of(batches):
            ids = pa.array([np.array(own.encode(t), np.int32) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([np.frombuffer(x, np.int32) for x in group.sort_values("segment")["ids"]])
        return pd.DataFrame({"doc_id": [group["doc_id"].iloc[0]], "ids": [ids]})

    schema = "doc_id long, ids array<int>"
    return job.short.mapInArrow(encoded, schema).unionByName(_long_ids(job).groupBy("row").applyInPandas(whole, schema))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded: the bytes that each row's ids stand for; null ids decode to no bytes."""
    with open(path, "rb") as f:
        raw = encoded.sparkSession.sparkContext.broadcast(f.read())  # the rank file, under 1 MB

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(raw.value, pattern)
        for b in batches:
            found = pa.array([own.decode(i) for i in each(b.column("ids"))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), found], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, decoded binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(documents: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each whole text encoded, its ids decoded."""
    job = _Job(documents, path, pattern, chunk, overlap)
    raw, names = job.raw, [c.split()[0] for c in DIGESTS.split(", ")]

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(raw.value, pattern)
        for b, texts in texts_of(batches):
            counts, ids_sha, text_sha = [], [], []
            for t in texts:
                ids = own.encode(t)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(own.say(ids)).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Segments come in order, a text's one after another."""
        own, now, out = _encoder(raw.value, pattern), None, []
        for b in batches:
            for row, doc_id, ids in zip(b["row"], b["doc_id"], b["ids"]):
                if now is None or row != now[0]:
                    if now is not None:
                        out.append((now[1], now[2], now[3].hexdigest(), now[4].hexdigest()))
                    now = [row, doc_id, 0, hashlib.sha256(), hashlib.sha256()]
                found = np.frombuffer(ids, np.int32).tolist()
                now[3].update((b" " if now[2] else b"") + own.say(found))
                now[2] += len(found)
                now[4].update(own.decode(found))
            yield _frame(out, names)
            out = []
        if now is not None:
            yield _frame([(now[1], now[2], now[3].hexdigest(), now[4].hexdigest())], names)

    ordered = _long_ids(job).repartition("row").sortWithinPartitions("row", "segment")
    return job.short.mapInArrow(digested, DIGESTS).unionByName(ordered.mapInPandas(whole, DIGESTS))


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=names)
    return made.astype({"doc_id": "Int64", "n_tokens": "int64"})
