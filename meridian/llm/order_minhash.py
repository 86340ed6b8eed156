"""Document fingerprints by order MinHash, with DataFrame functions only.

K-mers are runs of ``CHARS`` code points, whatever a text's length, numbered by occurrence: the
second time a run occurs it counts as another k-mer. In each of ``PLACES`` hash orders the least
of all of a text's k-mers is selected. A place of the signature takes the k-mers selected in its
own order and the next (``PICKED`` in all, the last ones go on with the first), puts them back in
their order in the text, and hashes their tuple.
Equal places of two signatures tell how alike two texts are in content and in order, which
follows edit distance. Every order is applied to every numbered k-mer: k-mers become rows, and
the least ones are plain aggregates of generated code.

A k-mer in work is one number: its hash in the upper bits, its position in the lower
``POSITION_BITS``. An edited text shares its first part with the text that it was made from, so
the least k-mers of that part are found once for both.

Defined results: a null text is the empty text, whose signature is all zeros; a text shorter than
a run has one k-mer; equal texts have equal signatures, however long. Documents follow one another by
descending doc_id (nulls last), rows of one id by a hash of their texts; the last is followed by
the first, a single document by itself. Repeated rows follow one another; of rows repeated very
often one is worked out and its results repeated. An empty table gives no row; extra columns,
whatever their names, are ignored. A text may have up to 2**28 code points, and takes a few times
eight bytes for each in the memory of one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import cut

CHARS = 4
PLACES = 32
PICKED = 2
POSITION_BITS = 28
#: Documents that are put in order in one run, about; runs in all, at most (three numbers of each are broadcast).
RUN = 400
RUNS = 1 << 20
#: Ids are cut into ranges of about equal numbers of documents at so many quantiles, and these evenly into runs.
QUANTILES = 256

_LOW = (1 << POSITION_BITS) - 1
#: What a k-mer is combined with before it is hashed for an order.
SALTS = [int(x) for x in np.random.default_rng(20).integers(1 << 62, size=PLACES)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _packed(hashed: Column, pos: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~_LOW)).bitwiseOR(pos.cast("long"))


def kmers(text: Column, first: Column, alone: Column) -> Column:
    """A text's runs in order, as numbers; positions begin at ``first``. alone: whether a text shorter than a run is one."""
    points = F.encode(text, "UTF-32")  # four bytes for each code point, so any run is found at once
    starts = F.sequence(F.lit(1), 4 * (F.length(text) - CHARS) + 1, F.lit(4))
    first = F.coalesce(first, F.lit(0))  # nothing here is null, so that arrays are sorted as plain numbers
    grams = let(points, lambda b: F.transform(starts, lambda at, i: _packed(F.xxhash64(F.substring(b, at, F.lit(4 * CHARS))), first + i)))
    none = F.slice(F.array(F.lit(0).cast("long")), 1, 0)
    return F.when(F.length(text) >= CHARS, grams).when(alone & (F.length(text) > 0), F.array(_packed(F.xxhash64(points), F.lit(0)))).otherwise(none)


def least(texts: DataFrame, key: list[str], column: str = "kmers", share: str = "shared", skip: str = "skipped") -> DataFrame:
    """key, part, least: the least k-mer in each order, by parts of texts.

    texts: key, the k-mers in any order, the position up to which k-mers are part 0, and whether
    those take no part (the others are part 1). A text without k-mers has nulls.
    """
    rows = texts.select(*key, share, skip, F.sort_array(column).alias("s"))
    # where the equal ones begin, among the sorted k-mers
    new = lambda i: ~(F.shiftright(F.get("s", i - 1).bitwiseXOR(F.get("s", i)), POSITION_BITS).eqNullSafe(F.lit(0)))
    places = F.when(F.size("s") > 0, F.sequence(F.lit(0), F.size("s") - 1))
    rows = rows.select(*key, share, skip, "s", F.filter(places, new).alias("starts"))
    # outer generators, as for others the optimiser would work out the arrays twice
    rows = rows.select(*key, share, skip, "s", "starts", F.posexplode_outer("starts").alias("j", "start"))
    end = F.coalesce(F.get("starts", F.col("j") + 1), F.size("s"))
    rows = rows.select(*key, share, skip, "s", "start", F.explode_outer(F.sequence("start", end - 1)).alias("i"))
    rows = rows.select(*key, share, skip, F.get("s", F.col("i")).alias("x"), (F.col("i") - F.col("start")).alias("nth"))
    numbered = F.xxhash64(F.shiftright("x", POSITION_BITS), "nth")
    rows = rows.select(*key, share, skip, numbered.alias("k"), F.col("x").bitwiseAND(F.lit(_LOW)).alias("pos"))
    rows = rows.where(F.col("pos").isNull() | ~F.col(skip) | (F.col("pos") >= F.col(share)))
    rows = rows.withColumn("part", F.when(F.col("pos") < F.col(share), 0).otherwise(1))
    found = rows.groupBy(*key, "part").agg(*(F.min(_packed(F.xxhash64(F.col("k").bitwiseXOR(F.lit(c))), F.col("pos"))).alias(f"m{n}") for n, c in enumerate(SALTS)))
    return found.select(*key, "part", F.array(*(f"m{n}" for n in range(len(SALTS)))).alias("least"))


def signature(mins: Column) -> Column:
    """PLACES hashes from the least k-mers in each order: the tuples of those of a place, in text order."""

    def place(t: int) -> Column:
        a, b = (F.get(mins, F.lit((t + i) % PLACES)) for i in range(PICKED))
        x, y = F.shiftright(a, POSITION_BITS), F.shiftright(b, POSITION_BITS)
        first = a.bitwiseAND(F.lit(_LOW)) <= b.bitwiseAND(F.lit(_LOW))
        return F.when(a.isNull(), F.lit(0).cast("bigint")).when(first, F.xxhash64(x, y)).otherwise(F.xxhash64(y, x))

    return F.array(*(place(t) for t in range(PLACES)))


def likeness(a: Column, b: Column) -> Column:
    """The share of places at which two signatures agree, 0 to 1."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return F.size(same) / F.lit(float(PLACES))


def fingerprint(sig: Column) -> Column:
    """A signature as a string: eight hexadecimal digits for each place."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(x, 32))), 8, "0")), "")


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, signature of every document's whole text."""
    texts = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.select("doc_id", "row", kmers(F.col("text"), F.lit(0), F.lit(True)).alias("kmers"), F.lit(0).alias("shared"), F.lit(False).alias("skipped"))
    found = least(rows, ["doc_id", "row"])
    return found.select("doc_id", signature(F.col("least")).alias("signature"))


def _runs(keys: DataFrame, n: int) -> Column:
    """The run of a document (of none, rev and h), a number that grows along the order.

    Ids are cut at quantiles, so one far from the others takes no more than a range for itself;
    an id that fills a range by itself, and documents without one, are cut by the texts' hashes.
    """
    size = max(RUN, math.ceil(n / RUNS))
    got = keys.agg(
        F.percentile_approx(F.when(F.col("none") == 0, F.col("rev")), F.array(*(F.lit(i / QUANTILES) for i in range(QUANTILES + 1))), F.lit(10_000)).alias("q"),
        F.coalesce(F.sum("none"), F.lit(0)).alias("nameless"),
    ).first()
    at = got["q"] or []
    met = {v: at.count(v) for v in at}
    edges = sorted({*met, *(v + 1 for v, k in met.items() if k > 1 and v + 1 < 1 << 63)})
    spans, base = [], 1  # (first rev, last rev + 1, runs, first run); run 0 is of what lies before all quantiles
    for i, lo in enumerate(edges):
        hi = edges[i + 1] if i + 1 < len(edges) else lo + 1
        runs = max(1, math.ceil((n - got["nameless"]) / QUANTILES * max(1, met.get(lo, 1) - 1) / size))
        spans.append((lo, hi, runs, base))
        base += runs
    share = F.col("h") / F.lit(2.0**64) + 0.5
    last = F.lit(max(1, math.ceil(got["nameless"] / size)))
    nameless = F.lit(base) + F.least(last - 1, F.floor(share * last))
    if not spans:
        return nameless.cast("long")
    edge = F.array(*(F.lit(s[0]) for s in spans))
    span = F.get(F.array(*(F.struct(F.lit(s[0]).cast("double").alias("lo"), F.lit(float(s[1] - s[0])).alias("width"), F.lit(s[2]).alias("runs"), F.lit(s[3]).alias("base")) for s in spans)), F.size(F.filter(edge, lambda e: e <= F.col("rev"))) - 1)
    part = F.when(span["width"] <= 1, share).otherwise((F.col("rev").cast("double") - span["lo"]) / span["width"])
    inside = span["base"] + F.greatest(F.lit(0), F.least(span["runs"] - 1, F.floor(part * span["runs"])))
    return F.when(F.col("none") == 1, nameless).otherwise(F.coalesce(inside, F.lit(0))).cast("long")


def with_next(documents: DataFrame) -> DataFrame:
    """run, at, ghost, doc_id, text, next_text, times: every document with the next one by descending id.

    The first document of each run is also put, as a ghost, behind the run above it, so texts are
    shuffled once and no task orders all documents. Rows repeated more often than a run is long
    (or, of very many documents, a 2**16th of them) are one row whose ``times`` says how many
    they are; each but the last is followed by an equal one.
    """
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(F.col("doc_id").isNull().cast("int").alias("none"), F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))).alias("rev"), F.xxhash64(text).alias("h"), text.alias("text"))
    own = ["none", "rev", "h"]
    keys = cut(docs.select(*own))
    n = keys.count()
    run = _runs(keys, n)
    rows = docs.withColumn("times", F.lit(1).cast("long"))
    hot = cut(keys.groupBy(*own).agg(F.count("*").alias("times")).where(F.col("times") > max(RUN, n >> 16)))
    if not hot.isEmpty():
        hot = F.broadcast(hot)  # at most 2**16 rows
        one = docs.join(hot, own).groupBy(*own, "times").agg(F.min("text").alias("text"))
        rows = docs.join(hot, own, "left_anti").withColumn("times", F.lit(1).cast("long")).unionByName(one)
    rows = rows.select(run.alias("run"), F.lit(False).alias("ghost"), *own, "text", "times")
    heads = cut(keys.groupBy(run.alias("below")).agg(F.min(F.struct(*own)).alias("head")))  # about RUNS rows at most
    above = F.coalesce(F.lag("below").over(Window.orderBy("below")), F.max("below").over(Window.partitionBy()))
    heads = F.broadcast(heads.select(above.alias("above"), "head.*"))
    first = rows.join(heads, own).groupBy("above", *own).agg(F.min("text").alias("text"))
    ghosts = first.select(F.col("above").alias("run"), F.lit(True).alias("ghost"), *own, "text", F.lit(1).cast("long").alias("times"))
    order = Window.partitionBy("run").orderBy("ghost", *own)
    placed = rows.unionByName(ghosts).withColumn("next_text", F.lead("text").over(order)).withColumn("at", F.row_number().over(order))
    doc_id = F.when(F.col("none") == 0, F.bitwise_not("rev"))  # so that all uses need the same shuffled columns
    return placed.select("run", "at", "ghost", doc_id.alias("doc_id"), "text", "next_text", "times")


def _kept(text: Column) -> Column:
    """How many code points of a text its edited text keeps."""
    return F.length(text) - F.floor(F.length(text) / 3).cast("int")


def edited(text: Column, following: Column) -> Column:
    """The last third of a text's code points replaced by the first as many of the next one."""
    return F.concat(F.substring(text, F.lit(1), _kept(text)), F.substring(following, F.lit(1), F.length(text) - _kept(text)))


def compare(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(documents)
    real, many = ~F.col("ghost"), ~F.col("ghost") & (F.col("times") > 1)
    texts = rows.select("run", "at", "text", F.when(real, edited(F.col("text"), F.col("next_text"))).alias("to_next"), F.when(many, edited(F.col("text"), F.col("text"))).alias("to_self"))
    shared = F.greatest(F.lit(0), _kept(F.col("text")) - (CHARS - 1))  # k-mers that lie in what is kept
    texts = texts.select("run", "at", shared.alias("shared"), kmers(F.col("text"), F.lit(0), F.lit(True)).alias("own"), "to_next", "to_self")

    def changed(kind: int, text: str) -> Column:
        rest = kmers(F.substring(text, F.col("shared") + 1, F.length(text)), F.col("shared"), F.col("shared") == 0)
        return F.when(F.col(text).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.concat(F.slice("own", 1, F.col("shared")), rest).alias("kmers")))

    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("own").alias("kmers")), changed(1, "to_next"), changed(2, "to_self"))
    each = texts.select("run", "at", "shared", F.explode_outer(kinds).alias("k")).where(F.col("k").isNotNull())
    parts = least(each.select("run", "at", "shared", "k.kind", "k.kmers", (F.col("k.kind") > 0).alias("skipped")), ["run", "at", "kind"])
    parts = parts.groupBy("run", "at").agg(F.collect_list(F.struct("kind", "part", "least")).alias("parts"))
    nothing = F.array_repeat(F.lit(None).cast("bigint"), len(SALTS))

    def sig(kind: int) -> Column:
        mine = F.filter("parts", lambda p: (p["kind"] == 0) & (p["part"] == 0) | (p["kind"] == kind))
        return F.aggregate(mine, nothing, lambda a, p: F.zip_with(a, p["least"], lambda x, y: F.least(x, y)))

    sigs = parts.select("run", "at", *(sig(k).alias(f"m{k}") for k in range(3)))
    sigs = sigs.select("run", "at", *(signature(F.col(f"m{k}")).alias(f"s{k}") for k in range(3)))
    sigs = sigs.withColumn("next", F.lead("s0").over(Window.partitionBy("run").orderBy("at")))
    said = sigs.select(
        "run",
        "at",
        *(fingerprint(F.col(f"s{k}")).alias(f"f{k}") for k in range(3)),
        *(likeness(F.col("s0"), F.col(s)).alias(f"near_{s}") for s in ("s1", "s2", "next")),
    )
    sha = lambda following: F.sha2(edited(F.col("text"), F.col(following)), 256)
    facts = rows.where(real).select("run", "at", "doc_id", "times", F.length("text").cast("long").alias("n_chars"), sha("next_text").alias("h1"), F.when(F.col("times") > 1, sha("text")).alias("h2"))
    both = facts.join(said, ["run", "at"])

    def out(kind: int, near_next: Column) -> Column:
        return F.struct(F.col(f"h{kind}").alias("edited_sha256"), F.col("f0").alias("fingerprint"), F.col(f"f{kind}").alias("edited_fingerprint"), F.col(f"near_s{kind}").alias("near_edited"), near_next.alias("near_next"))

    given = F.sequence(F.lit(1).cast("long"), F.col("times"))  # the last of equal rows is followed by another text
    each = both.select("*", F.explode(given).alias("nth"))
    return each.select("doc_id", "n_chars", F.when(F.col("nth") == 1, out(1, F.col("near_next"))).otherwise(out(2, F.lit(1.0))).alias("r")).select("doc_id", "n_chars", "r.*")
