"""SimHash near-duplicates through an inverted index over byte positions.

A fingerprint is eight bytes. Two that differ in at most three bits differ in at most three
bytes, so they share at least five (position, byte) entries; the index finds pairs with that
many matches, and each is then verified bit by bit.

A posting list for one byte holds a 256th of all fingerprints, so whole lists must not be
paired. The index therefore intersects lists three positions at a time: of any five positions
three lie in one half of the fingerprint, so the four triples of either half, eight in all, lose
no pair. Within an intersected list each of the other five positions has postings of its own:
pairs that meet in them are tallied, and those that meet in the two more that are guaranteed go
on to be verified; a pair that meets in none is never made. Equal fingerprints are one entry. A
list longer than ``LONG_LIST`` is intersected with two further positions, so that its entries
reach the guaranteed number by being in it, and cut into blocks; of each pair of blocks only a
spanning forest of its verified links is emitted, so that many near copies don't make all their
pairs.

Defined results: a null or empty text has fingerprint zero and is linked like any other; equal
rows and rows of one id are linked as their fingerprints are; a null doc_id takes part but never
names a component unless all of its ids are null; an empty table gives no row. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import cut, spare, texts_of
from meridian.operators.graph import components

BITS = 3  # fingerprints link at so many differing bits or fewer
LEAST_MATCHES = 8 - BITS
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
LONG_LIST = 512
BLOCK = 2048


def fingerprint(text: bytes, width: int = 3, seed: int = 42, block: int = 1 << 16) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, block):  # bounded memory for any length
        part = words[at : at + block + width - 1] if n > 1 else words
        count = min(block, n - at)
        if width == 3 and n > 1:
            shingles = [b"%b %b %b" % x for x in zip(part, part[1:], part[2:])]
        else:
            shingles = [b" ".join(part[i : i + width]) for i in range(count)]
        h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every document."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in texts_of(batches):
            fps = [fingerprint(t, width) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(found, "doc_id long, fp long")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join distinct fingerprints into their components; prints: column fp."""
    entries = [F.struct(F.lit(n).alias("triple"), _key(t).alias("bytes")) for n, t in enumerate(TRIPLES)]
    postings = prints.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.triple", "e.bytes")
    sizes = postings.groupBy("triple", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    lists = cut(postings.join(sizes, ["triple", "bytes"]))
    short = verified(tallied(lists.where(F.col("n") <= LONG_LIST)))
    return short.unionByName(_long(lists.where(F.col("n") > LONG_LIST)))


def _key(positions: tuple[int, ...]) -> Column:
    key = F.lit(0).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(F.col("fp"), p))
    return key


def _others(count: int, entry: Callable[[tuple[int, ...]], Column]) -> Column:
    """``entry`` of every choice of so many positions outside the row's triple, as an array."""
    parts = [F.when(F.col("triple") == n, entry(more)) for n, t in enumerate(TRIPLES) for more in combinations([p for p in range(8) if p not in t], count)]
    return F.filter(F.array(*parts), lambda p: p.isNotNull())


def tallied(lists: DataFrame) -> DataFrame:
    """a, b, matches: pairs that meet in a list and in enough of its postings by one more position.

    lists: fp, triple, bytes. A pair comes once for each list that it meets in.
    """
    entry = lambda p: F.struct(F.lit(p[0]).alias("position"), _byte(F.col("fp"), p[0]).alias("byte"))
    postings = lists.select("fp", "triple", "bytes", F.explode(_others(1, entry)).alias("p")).select("fp", "triple", "bytes", "p.position", "p.byte")
    key = ["triple", "bytes", "position", "byte"]
    hits = postings.withColumnRenamed("fp", "a").join(postings.withColumnRenamed("fp", "b"), key).where("a < b")
    counts = hits.groupBy("triple", "bytes", "a", "b").agg((F.count("*") + 3).alias("matches"))
    return counts.where(F.col("matches") >= LEAST_MATCHES).select("a", "b", "matches")


def verified(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs whose fingerprints differ in at most ``BITS`` bits."""
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")


def _long(lists: DataFrame) -> DataFrame:
    """Sub-lists by two more positions; each in blocks, each pair of blocks in one task."""
    own = _others(LEAST_MATCHES - 3, lambda more: F.struct(F.lit(sum(1 << p for p in more)).alias("more"), _key(more).alias("more_bytes")))
    sub = lists.select("fp", "triple", "bytes", F.explode(own).alias("s")).select("fp", "triple", "bytes", "s.more", "s.more_bytes")
    key = ["triple", "bytes", "more", "more_bytes"]
    counted = sub.join(sub.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), key)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = counted.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    pairs = dealt.select(*key, "fp", F.explode(other).alias("p")).select(*key, "p.i", "p.j", "fp")

    def forest(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(spanning(group["fp"].to_numpy()), columns=["a", "b"])

    return pairs.groupBy(*key, "i", "j").applyInPandas(forest, "a long, b long")


def spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among some fingerprints of one sub-list, each verified."""
    todo, edges = np.unique(fps), []
    while len(todo):
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            x = front[0] ^ todo
            near = np.bitwise_count(x.view(np.uint64)) <= BITS
            edges += [(int(front[0]), int(b)) for b in todo[near]]
            front, todo = np.concatenate([front[1:], todo[near]]), todo[~near]
    return edges


def _named(prints: DataFrame) -> DataFrame:
    """fp, root, component_id of every distinct fingerprint."""
    smallest = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(smallest.select("fp")))
    rooted = smallest.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def groups(documents: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) of every document."""
    prints = cut(fingerprints(documents, width))
    return prints.join(_named(prints), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def representatives(documents: DataFrame, width: int = 3) -> DataFrame:
    """One document of each group: the one of smallest id; of the group's rows with that id, the least text.

    Of a group without any id, the least text. Texts are shuffled once, by doc_id.
    """
    columns = documents.columns
    mine, place, fp, root, several, roots = (spare(columns, c) for c in ("kept_id", "place", "fp", "root", "several", "roots"))
    prints = cut(fingerprints(documents, width))
    named = cut(_named(prints))
    rooted = prints.where("doc_id is not null").join(named, "fp")
    mark = F.when(F.col("doc_id") == F.col("component_id"), F.struct("fp", "root"))
    kept = rooted.groupBy(F.col("doc_id").alias(mine)).agg((F.min("fp") < F.max("fp")).alias(several), F.collect_set(mark).alias(roots))
    rest = [F.col(f"`{c}`") for c in columns if c not in ("doc_id", "text")]
    chosen = documents.join(kept.where(F.size(roots) > 0), F.col("doc_id") == F.col(mine))
    own = _fingerprint_of(width)(F.when(F.col(several), F.col("text").cast("binary")))  # only where an id has texts of several fingerprints
    chosen = chosen.withColumn(fp, F.when(F.col(several), own).otherwise(F.col(roots)[0]["fp"]))
    chosen = chosen.withColumn(root, F.get(F.filter(roots, lambda r: r["fp"] == F.col(fp)), F.lit(0))["root"]).where(F.col(root).isNotNull())
    chosen = chosen.drop(mine, several, roots)
    chosen = chosen.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", root).orderBy("text", *rest))).drop(fp, root)
    without = documents.where("doc_id is null").withColumn(fp, _fingerprint_of(width)(F.col("text").cast("binary")))
    nameless = named.where("component_id is null").select(F.col("fp").alias(fp), F.col("root").alias(root))
    nameless = without.join(nameless, fp).withColumn(place, F.row_number().over(Window.partitionBy(root).orderBy("text", *rest)))
    return chosen.unionByName(nameless.drop(fp, root)).where(F.col(place) == 1).drop(place)


def _fingerprint_of(width: int):
    @F.pandas_udf("long")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t or b"", width) for t in texts], dtype="int64")

    return found
