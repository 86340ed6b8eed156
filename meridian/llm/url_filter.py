"""URL filter: host and path rules, and a Bloom filter cascade for a list of hosts.

The cascade's first level encodes the listed keys, the second those keys of the corpus that
the first takes for listed though they aren't, the third the listed keys that the second takes,
and so on until a level takes no wrong key. Over the keys it was built for, which are all keys
of the corpus, its answers are exact, and judging a page needs no join.

Keys are dealt by their digest into shards of about ``per_shard`` keys; a shard's cascade is
built in one task. Cascades are broadcast in blocks of at most ``block_bytes``. If there are
several, the rows pass them one after another and are written in between, so driver and workers
hold one block at a time, however long the list is.

Defined results: a null url, or one without ``://``, has an empty host and path; a url of any
length is judged whole; a null key counts as the empty key; of rules of equal length the first
given; repeated pages are judged one by one; with an empty list or an empty table no key is
listed. Extra columns pass through.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import cut, mixed, spare

LEVEL_SCHEMA = "shard int, level int, hashes int, bits binary"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    tail = F.regexp_replace(_rest(url), r"^[^/?#]*", "")
    return F.coalesce(F.regexp_extract(tail, r"^[^?#]*", 0), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, nulls if none does.

    rules: (verdict, host followed by the start of a path). Of equally long ones, the first.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # what comes later is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _digest(key: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(key, F.lit(""))))


def _halves(digests) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(bytes(d) for d in digests), dtype=">u4").reshape(-1, 4).astype(np.uint64)
    return raw[:, 0] << np.uint64(32) | raw[:, 1], raw[:, 2] << np.uint64(32) | raw[:, 3]


def _places(a: np.ndarray, b: np.ndarray, level: int, hashes: int, size: int) -> np.ndarray:
    """Bit places of each key in a level, one row for each hash."""
    x, y = mixed(a ^ (b << np.uint64(1)), 2 * level + 1), mixed(b ^ (a << np.uint64(1)), 2 * level + 2) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(x + np.uint64(i) * y) % np.uint64(size) for i in range(hashes)])


def _passes(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _levels(a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> list[tuple[int, bytes]]:
    """(hashes, bits) of each level for one shard's distinct keys."""
    levels, inside, outside = [], np.where(listed)[0], np.where(~listed)[0]
    while len(inside):
        hashes, per_key = (7, 10) if not levels else (3, 4)
        bits = np.zeros(max(8, math.ceil(len(inside) * per_key / 8)), np.uint8)
        at = _places(a[inside], b[inside], len(levels), hashes, 8 * len(bits)).ravel()
        np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        wrong = outside[_passes(bits, _places(a[outside], b[outside], len(levels), hashes, 8 * len(bits)))]
        levels.append((hashes, bits.tobytes()))
        inside, outside = wrong, inside
    return levels


def build(keys: DataFrame, listed: DataFrame, per_shard: int = 1 << 16) -> tuple[DataFrame, int]:
    """The cascade's levels as rows, and the number of shards.

    keys, listed: one column each; every key that will ever be asked for, and those listed.
    """
    spark = keys.sparkSession
    both = keys.select(_digest(keys[0]).alias("d"), F.lit(False).alias("listed")).unionByName(
        listed.select(_digest(listed[0]).alias("d"), F.lit(True).alias("listed"))
    )
    universe = cut(both.groupBy("d").agg(F.max("listed").alias("listed")))  # summed up before it is shuffled
    shards = max(math.ceil(universe.count() / per_shard), int(spark.conf.get("spark.sql.shuffle.partitions")))
    shard = (F.conv(F.hex(F.substring("d", 1, 4)), 16, 10).cast("long") % shards).cast("int")

    def levels(group: pd.DataFrame) -> pd.DataFrame:
        a, b = _halves(group["d"])
        made = _levels(a, b, group["listed"].to_numpy(bool))
        return pd.DataFrame([(int(group["shard"].iloc[0]), i, h, bits) for i, (h, bits) in enumerate(made)], columns=["shard", "level", "hashes", "bits"])

    return cut(universe.withColumn("shard", shard).groupBy("shard").applyInPandas(levels, LEVEL_SCHEMA)), shards


def with_listed(df: DataFrame, key: Column, cascade: DataFrame, shards: int, block_bytes: int = 64 << 20, column: str = "listed") -> DataFrame:
    """``df`` with whether the cascade holds ``key``. Its keys must be among those it was built for."""
    sizes = cascade.groupBy("shard").agg(F.sum(F.length("bits")).alias("n")).orderBy("shard")
    blocks, room = [], 0
    for shard, n in sizes.toLocalIterator():
        if not blocks or n > room:
            blocks.append([shard, shard])
            room = block_bytes
        blocks[-1][1] = shard
        room -= n
    digest = spare([*df.columns, column], "digest")
    out = df.withColumn(digest, _digest(key)).withColumn(column, F.lit(False))
    for n, (first, last) in enumerate(blocks):
        rows = cascade.where(F.col("shard").between(first, last)).orderBy("shard", "level").collect()  # at most block_bytes
        shared = df.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])
        out = out.withColumn(column, F.col(column) | _asks(shared, shards)(F.col(digest)))
        if n < len(blocks) - 1:  # one block in memory at a time
            out = cut(out)
            shared.destroy()
    return out.drop(digest)


def _asks(shared, shards: int):
    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own: dict[int, list] = {}
        for shard, _, hashes, bits in shared.value:
            own.setdefault(shard, []).append((hashes, np.frombuffer(bits, np.uint8)))
        for digests in batches:
            found = np.zeros(len(digests), bool)
            if len(digests):
                a, b = _halves(digests)
                of = ((a >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
                for shard in np.unique(of):
                    left = np.where(of == shard)[0]
                    levels = own.get(int(shard), [])
                    for i, (hashes, bits) in enumerate(levels):
                        ok = _passes(bits, _places(a[left], b[left], i, hashes, 8 * len(bits)))
                        found[left[~ok]] = i % 2 == 1
                        left = left[ok]
                    found[left] = len(levels) % 2 == 1
            yield pd.Series(found)

    return holds


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict: the longest rule's, else block if the host is listed.

    Columns of these four names are replaced.
    """
    mark = spare(pages.columns, "listed")
    seen = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    cascade, shards = build(pages.select(host_of(F.col(url)).alias("key")), listed)
    marked = with_listed(seen, F.col("host"), cascade, shards, column=mark)
    by_list = F.when(F.col(mark), F.lit("block")).otherwise(F.lit("allow"))
    return marked.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, by_list)).drop(mark)
