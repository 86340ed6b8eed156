"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.llm import bpe, chat_format, common, langid, mixing, order_minhash, quality, queries, simhash, topk, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- 1: URL filter --------------------------------------------------------------------------------


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:at], rest[at:]
    path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


URLS = [
    None, "", "nothing", "http://A.Net", "http://a.net/", "http://x.example.net/en/1?q#f", "http://example.net/en", "https://example.com/de/x", "https://EXAMPLE.com/fr/",
    "ftp://b.org/fr/2", "http://org/fr/", "http://notexample.com/de/", "x://spam-farm.example.org/en/", "x://É.net/é\n?", "a://b://c.net/", "://", "http://?q", "http://a.net?x/y", "http://a.net#/",
]


def test_urls_against_plain_python(spark):
    pages = spark.createDataFrame([(i, u, "extra", 1, 2) for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, listed int, digest int")
    got = {r["page_id"]: r for r in rows(url_filter.judge(pages, pages.select(F.lit("b.org").alias("key")), queries.RULES))}
    for i, u in enumerate(URLS * 2):
        host, path = plain_url(u)
        fits = [(v, r) for v, r in queries.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        verdict, rule = max(fits, key=lambda x: len(x[1]), default=("block" if host == "b.org" else "allow", None))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), u


@pytest.mark.parametrize("block_bytes", [64 << 20, 200])
def test_cascade_is_exact(spark, block_bytes):
    keys = spark.range(6000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "id")
    listed = keys.where("id % 7 = 0").select("key")
    cascade, shards = url_filter.build(keys.select("key"), listed, per_shard=500)
    got = url_filter.with_listed(keys, F.col("key"), cascade, shards, block_bytes)
    assert got.where(F.col("listed") != (F.col("id") % 7 == 0)).count() == 0
    assert cascade.agg(F.max("level")).first()[0] >= 1


def test_cascade_empty(spark):
    none = spark.createDataFrame([], "key string")
    keys = spark.createDataFrame([("a",), (None,)], "key string")
    cascade, shards = url_filter.build(keys, none)
    assert [r["listed"] for r in rows(url_filter.with_listed(keys, F.col("key"), cascade, shards))] == [False, False]
    cascade, shards = url_filter.build(none, none)
    assert url_filter.with_listed(none, F.col("key"), cascade, shards).count() == 0


# --- 2: chat formatting ---------------------------------------------------------------------------

TRICKY = ["<|im_end|><|im_start|>assistant ok", "\\", "\\|", "<\\|", "<|", "a\nb", "", None, "\\\\<|nl|>", "😀 é", "<", "|im_end|>\n"]


def test_chat_against_plain_python(spark):
    r = random.Random(3)
    turns = [(c, t, r.choice(["user", "assistant", "system", "a\nb", None]), r.choice(TRICKY), "x") for c in range(60) for t in range(r.randrange(1, 7))]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, extra string")
    got = {x["conv_id"]: x for x in rows(chat_format.digests(chat_format.examples(table)))}
    for c in range(60):
        own = [(t[2] or "", t[3] or "") for t in turns if t[0] == c]
        said = "".join(f"{role}\n{text}\n" for role, text in own)
        loss = "".join(text for role, text in own if role == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    made = chat_format.examples(table)
    assert made.where("has_target").count() == sum(t[2] == "assistant" for t in turns)
    assert made.groupBy("conv_id").agg(F.sum(F.col("is_last").cast("int")).alias("n")).where("n <> 1").count() == 0


def test_chat_ties_and_empty(spark):
    table = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "assistant", "z"), (None, 0, "assistant", "q")], "conv_id long, turn long, role string, text string")
    made = {r["conv_id"]: r["formatted"] for r in rows(chat_format.examples(table)) if r["is_last"]}
    assert made[1] == "<|im_start|>assistant\nz<|im_end|>\n<|im_start|>user\na<|im_end|>\n<|im_start|>user\nb<|im_end|>\n"
    assert made[None] == "<|im_start|>assistant\nq<|im_end|>\n"
    assert chat_format.digests(chat_format.examples(table.limit(0))).count() == 0


# --- 3 and 4: classifiers -------------------------------------------------------------------------


@pytest.mark.parametrize(("op", "label", "folds", "fold", "least"), [(queries.op3_quality, "quality", 3, 1, 0.95), (queries.op4_toxicity, "toxic", 5, 0, 0.93)])
def test_held_out_accuracy(spark, medium, op, label, folds, fold, least):
    got = op(spark, medium).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{medium}/labels.parquet").toPandas().set_index("doc_id")[label]
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert all(got["held_out"] == [zlib.crc32(str(i).encode()) % folds == fold for i in got.index])
    assert (got["predicted"] == (got["score"] >= 0.5)).all()
    held = got[got["held_out"]].join(labels, how="inner")
    assert (held["predicted"] == held[label]).mean() >= least


def test_shape_of_whole_word():
    codes = common.WordCodes()
    head = "aB" * 32
    assert len({codes[head + tail] >> 32 for tail in ("", "9", "9-9", "====")}) == 4
    assert codes["a" * 64 + "a"] >> 32 == codes["a"] >> 32


def test_toxicity_of_a_pair_and_of_rare_terms():
    """Terms that say little alone take part: a pair decides, and no rare term is left out."""
    order = np.random.default_rng(3)
    a, b, rare = 1, 2, 3

    def row(*signs):
        return np.sort(np.array([*signs, *(10 + order.choice(400, 12, replace=False))], np.int32))

    toxic = [row(a, b) for _ in range(290)] + [row(rare) for _ in range(8)] + [row(4) for _ in range(702)]
    clean = [row(a) for _ in range(250)] + [row(b) for _ in range(250)] + [row() for _ in range(500)]
    model = toxicity.fit(toxic + clean, np.array([1] * 1000 + [0] * 1000))
    assert {a, b, rare} <= set(model.kept.tolist())
    score = lambda *signs: np.array([model.score(np.searchsorted(model.kept, row(*signs))) for _ in range(100)])
    assert (score(a, b) >= 0.5).mean() > 0.9 and (score(a) < 0.5).mean() > 0.9 and (score(b) < 0.5).mean() > 0.9
    assert score(rare).mean() > score().mean()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_edges(spark, module):
    label = "quality" if module is quality else "toxic"
    texts = ["good words here", "bad!! BAD!!", None, "", "good words here", "x " * 50_000]
    table = docs(spark, texts).withColumn("score", F.lit(1)).withColumn("predicted", F.lit(2))
    empty = spark.createDataFrame([], f"doc_id long, {label} int")
    for labels, expected in ((empty, 0.5), (spark.createDataFrame([(0, 1), (1, None), (2, 7)], f"doc_id long, {label} int"), 1.0)):
        got = rows(module.classify(table, module.train(table, labels, held_out=None)))
        assert len(got) == 6 and all(abs(r["score"] - expected) < 1e-6 for r in got)
    both = spark.createDataFrame([(0, 1), (1, 0), (4, 1)], f"doc_id long, {label} int")
    got = module.classify(table, module.train(table, both, held_out=None)).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert module.accepted(table, module.train(table, both, held_out=None)).columns == table.columns
    assert module.classify(table.limit(0), module.train(table.limit(0), both)).count() == 0


def test_toxicity_rejects_on_evidence_only(spark):
    table = docs(spark, ["fine words here", "slur here", "other words"] * 4)
    schema = "doc_id long, toxic int"
    for labels in ([], [(1, 1)], [(99, 1), (98, 0)]):
        model = toxicity.train(table, spark.createDataFrame(labels, schema), held_out=None)
        assert toxicity.accepted(table, model).count() == 12
    far = [(1000 + i, i % 2) for i in range(500)]  # labels of other documents don't fill the sample
    near = [(i, int(i % 3 == 1)) for i in range(12)]
    model = toxicity.train(table, spark.createDataFrame(far + near, schema), per_class=8, held_out=None)
    assert len(model.kept)


# --- 5: SimHash -----------------------------------------------------------------------------------


def plain_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash_against_plain_python(spark, small):
    found = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    texts = [r["text"] for r in found] + [None, "", "one", "ONE", "a b", " \t\x0b", "É é  x y", "a  b"]
    table = docs(spark, texts).withColumn("fp", F.lit("clash")).withColumn("place", F.lit(1)).withColumn("kept_id", F.lit(2))
    prints = [plain_print(t) for t in texts]
    got = {r["doc_id"]: r for r in rows(simhash.groups(table).withColumn("hex", simhash.hexadecimal(F.col("fp"))))}
    assert [got[i]["hex"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == plain_groups(prints)
    kept = [r["doc_id"] for r in simhash.representatives(table).collect()]
    assert sorted(kept) == sorted(set(plain_groups(prints)))


@pytest.mark.parametrize("long_list", [512, 2])
def test_links_lose_none(spark, monkeypatch, long_list):
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    r = random.Random(9)
    prints = {r.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:60]:  # chains and clusters of near ones
        for _ in range(4):
            p ^= sum(1 << b for b in r.sample(range(64), r.randrange(1, 4)))
            prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    from meridian.operators.graph import components

    root = {x["node"]: x["root"] for x in components(links).collect()}
    mine = [root.get(p, p) for p in signed]
    plain = plain_groups(prints)
    same = lambda x: [[a == b for a in x] for b in x]
    assert same(mine) == same(plain)


def test_simhash_edges(spark):
    assert simhash.groups(docs(spark, [])).count() == 0
    twice = docs(spark, ["a b c d", "a b c d"]).unionByName(docs(spark, ["a b c d"]))
    assert {r["component_id"] for r in simhash.groups(twice).collect()} == {0}
    assert simhash.representatives(twice).count() == 1
    nameless = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "q r s t u"), (3, "q r s t u"), (None, None)], "doc_id long, text string")
    assert sorted(simhash.representatives(nameless).collect(), key=repr) == [(3, "q r s t u"), (None, "a b c d"), (None, None)]
    long = ("lorem ipsum dolor " * 40_000) + "end"
    assert simhash.fingerprint(long.encode(), block=1000) == simhash.fingerprint(long.encode())


def test_representatives_of_repeated_ids(spark):
    """Rows of one id with different texts stand for their own groups."""
    a, b, c = "a b c d", "q r s t u", "one two three four five"
    schema = "doc_id long, text string"
    for given, kept in (
        ([(1, a), (1, b), (2, a), (2, b)], [(1, a), (1, b)]),
        ([(0, a), (1, a), (1, b), (2, b)], [(0, a), (1, b)]),
        ([(0, b), (1, b), (1, b), (1, a), (1, a), (3, c)], [(0, b), (1, a), (3, c)]),
    ):
        assert sorted(map(tuple, simhash.representatives(spark.createDataFrame(given, schema)).collect())) == sorted(kept)


# --- 6: language identification -------------------------------------------------------------------


def test_language_accuracy(spark, medium):
    got = queries.op6_langid(spark, medium).toPandas().set_index("doc_id")
    real = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    held = got[got["held_out"]]
    assert (held["lang_pred"] == real[held.index]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_language_edges(spark):
    table = spark.createDataFrame([(0, "abc abd", "aa"), (1, "xyz xyy", "bb"), (2, None, "aa"), (3, "123 !!", None), (4, "abc", None), (5, "xyz " * 30_000, None), (6, "abd", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in rows(langid.identify(table, langid.learn(table, held_out=None)))}
    assert [got[i]["lang_pred"] for i in range(7)] == ["aa", "bb", "und", "und", "aa", "bb", "aa"]
    assert langid.identify(table.limit(0), langid.learn(table.limit(0))).count() == 0
    nothing = langid.learn(table.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in rows(langid.identify(table, nothing))} == {"und"}


# --- 7: top-k -------------------------------------------------------------------------------------


def test_topk_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 300)
    monkeypatch.setattr(topk, "QUERIES", 4)
    r = np.random.default_rng(5)
    x = r.normal(size=(1200, 8)).astype(np.float32) * 0.3
    x[100:160] = x[0]  # ties
    table = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    table += [(5000, None, 0), (5100, [1.0, None], 0), (5200, [float("nan")] * 8, 0), (5300, [float("inf")] * 8, 0)]
    vectors = spark.createDataFrame(table, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rank", T.IntegerType())]))
    got = {}
    for row in topk.search(vectors, F.col("vec_id") % 100 == 0, 10).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    q = np.floor(1024 * x.astype(float)).astype(np.int64)
    assert sorted(got) == list(range(0, 1200, 100))
    for i in got:
        scores = q @ q[i]
        best = [j for j in np.lexsort((np.arange(1200), -scores)) if j != i][:10]
        assert sorted(got[i]) == [(n + 1, int(j), int(scores[j])) for n, j in enumerate(best)]


def test_topk_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [0.5, 0.5]), (1, [1.0]), (2, [])], schema)
    assert [(r["rank"], r["vec_id"], r["score"]) for r in topk.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1, 524288), (2, 2, 0)]
    alone = spark.createDataFrame([(0, [0.5])], schema)
    assert topk.search(alone, F.col("vec_id") == 0).count() == 0


# --- 8: BPE ---------------------------------------------------------------------------------------

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    ranks = bpe.read_ranks(PATH)
    return bpe.Encoder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = [*"ab  \n\t'sretdvlm019.,!¿é中あ😀\x1c\x85\xa0\u2003\u200b\u0301Ⅷ½", "'re", "'ll", " the"]


def test_bpe_against_library(coder):
    own, library = coder
    r = random.Random(5)
    for n in range(600):
        t = "".join(r.choice(ALPHABET) for _ in range(r.randrange(0, 80)))
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()
    for t in ("a" * 3000, "".join(r.choice("abcdefgh") for _ in range(2000))):
        assert own.encode(t) == library.encode_ordinary(t)


@pytest.mark.parametrize(("chunk", "overlap"), [(24, 8), (40, 20), (100, 5)])
def test_stitching_is_exact(spark, coder, chunk, overlap):
    r = random.Random(chunk)
    texts = []
    for n in range(500):
        some = ALPHABET if n % 2 else [*"a b'"]
        texts.append("".join(r.choice(some) * (r.randrange(1, 30) if r.random() < 0.1 else 1) for _ in range(r.randrange(0, 250))))
    table = docs(spark, texts + texts[:20])  # repeated texts under other ids
    table = table.unionByName(table.where("doc_id < 20"))  # and repeated rows
    want = {i: coder[1].encode_ordinary(t) for i, t in enumerate(texts + texts[:20])}
    got = bpe.encode(table, PATH, P.PATTERN, chunk, overlap).collect()
    assert len(got) == 540 and all(x["ids"] == want[x["doc_id"]] for x in got)
    seen = bpe.digests(table, PATH, P.PATTERN, chunk, overlap).collect()
    assert len(seen) == 540
    for x in seen:
        assert x["n_tokens"] == len(want[x["doc_id"]])
        assert x["ids_sha256"] == hashlib.sha256(" ".join(map(str, want[x["doc_id"]])).encode()).hexdigest()
    long = max(texts, key=len)
    assert bpe.encode(docs(spark, [long]), PATH, P.PATTERN, chunk, overlap).first()["ids"] == coder[1].encode_ordinary(long)


def test_bpe_digests(spark, coder):
    texts = [None, "", "Hello world", "Hello world", "é" * 10, "word " * 20_000, "x" * 70_000]
    table = docs(spark, texts).withColumn("ids", F.lit(0)).withColumn("n_tokens", F.lit("x")).withColumn("row", F.lit(1))
    got = {r["doc_id"]: r for r in rows(bpe.digests(table, PATH, P.PATTERN))}
    for i, t in enumerate(texts):
        ids = coder[1].encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(bpe.encode(table, PATH, P.PATTERN), PATH, P.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.digests(table.limit(0), PATH, P.PATTERN).count() == 0
    nameless = spark.createDataFrame([(None, "a b " * 20_000), (None, "a")], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in bpe.digests(nameless, PATH, P.PATTERN).collect()) == [1, len(coder[1].encode_ordinary("a b " * 20_000))]


# --- 9: order MinHash -----------------------------------------------------------------------------


def spark_hash(*longs):
    h = 42
    for x in longs:
        h = xxhash.xxh64_intdigest((x % (1 << 64)).to_bytes(8, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_signature(text):
    """Every order over every numbered k-mer, by the definition."""
    low, size = (1 << order_minhash.POSITION_BITS) - 1, order_minhash.CHARS
    if not text:
        return [0] * order_minhash.PLACES
    seen, entries = {}, []
    for pos in range(max(1, len(text) - size + 1)):
        gram = signed(xxhash.xxh64_intdigest(text[pos : pos + size].encode("utf-32-be"), 42)) >> order_minhash.POSITION_BITS
        k = xxhash.xxh64_intdigest(seen.get(gram, 0).to_bytes(4, "little"), spark_hash(gram) % (1 << 64))  # a long, then an int
        entries.append((signed(k), pos))
        seen[gram] = seen.get(gram, 0) + 1
    picked = [min((spark_hash(k ^ c) & ~low) | pos for k, pos in entries) for c in order_minhash.SALTS]
    pairs = zip(picked, picked[1:] + picked[:1])
    return [spark_hash(*(x >> order_minhash.POSITION_BITS for x in sorted(pair, key=lambda x: x & low))) for pair in pairs]


def test_order_minhash_against_plain_python(spark, small):
    found = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    texts = [r["text"] for r in found][:60] + [None, "", "one", "a a a a b b a a", "x y", "x y", "word " * 3000, "  ", " " * 300, "é😀" * 90, "w" * 500, " ".join(f"w{i % 7 * i}" for i in range(900))]
    table = docs(spark, texts, first=-3).withColumn("run", F.lit(5)).withColumn("h", F.lit("x"))
    got = {r["doc_id"]: r for r in rows(order_minhash.compare(table))}
    texts = [t or "" for t in texts]
    for i, t in enumerate(texts):
        following = texts[i - 1]  # descending ids; the first follows the last
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        row = got[i - 3]
        sig, edited_sig, next_sig = map(plain_signature, (t, edited, following))
        share = lambda a, b: sum(x == y for x, y in zip(a, b)) / order_minhash.PLACES
        assert row["n_chars"] == len(t)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == "".join(f"{x % (1 << 64) >> 32:08x}" for x in sig)
        assert (row["near_edited"], row["near_next"]) == (share(sig, edited_sig), share(sig, next_sig))


def test_order_minhash_tells_edits(spark, medium):
    got = queries.op9_order_minhash(spark, medium).toPandas()
    assert len(got) == 1000
    assert got["near_edited"].mean() > got["near_next"].mean() + 0.2
    assert (got["near_edited"] > got["near_next"]).mean() > 0.98


def test_order_minhash_sees_all_kmers(spark):
    """A run that makes up much of the other third doesn't hide the two thirds that were kept."""
    words = [f"w{i}" for i in range(3000)]
    table = docs(spark, ["same same " * 700, " ".join(words)])
    got = {r["doc_id"]: r["near_edited"] for r in rows(order_minhash.compare(table))}
    assert got[1] >= 0.15


def test_order_minhash_has_one_kind_of_kmer(spark):
    """Texts on both sides of any length, and long ones without white space, share their k-mers."""
    text = " ".join(f"w{i * i}" for i in range(60))
    glued = "".join(f"w{i * i}" for i in range(400))
    got = {r["doc_id"]: r for r in rows(order_minhash.compare(docs(spark, ["z", glued, text[:199], text[:201], text[:240]])))}
    assert got[3]["near_next"] > 0.5 and got[1]["near_edited"] > 0.1
    assert order_minhash.compare(docs(spark, ["z", text[:250]])).where("doc_id = 1 and near_edited > 0.1").count() == 1


def test_order_minhash_of_small_edits(spark):
    """A text against itself less its last character, on both sides of any length."""
    r = random.Random(2)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(1200))
    table = docs(spark, [x for n in (201, 5000) for x in (text[: n - 1], text[:n])])
    got = {r["doc_id"]: r for r in rows(order_minhash.compare(table))}
    assert got[1]["near_next"] >= 0.8 and got[3]["near_next"] >= 0.8


@pytest.mark.parametrize(("run", "runs"), [(400, 1 << 20), (1, 1 << 20), (2, 1 << 20), (1, 4)])
def test_next_document(spark, monkeypatch, run, runs):
    monkeypatch.setattr(order_minhash, "RUN", run)
    monkeypatch.setattr(order_minhash, "RUNS", runs)
    far = 1 << 62
    given = [(5, "e"), (1, "a"), (1, "b"), (None, "n"), (None, "m"), (1000, "z"), (7, None), (far, "f"), (-far, "g"), ((1 << 63) - 1, "h"), (-(1 << 63), "i")]
    given += [(1, f"c{i}") for i in range(30)] + [(None, f"d{i}") for i in range(30)]
    table = spark.createDataFrame(given, "doc_id long, text string")
    got = [(r["doc_id"], r["text"], r["next_text"]) for r in order_minhash.with_next(table).where("not ghost").collect()]
    h = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(((i, t or "") for i, t in given), key=lambda x: (x[0] is None, -(x[0] or 0), h(x[1])))
    assert sorted(got, key=repr) == sorted([(*x, order[(i + 1) % len(order)][1]) for i, x in enumerate(order)], key=repr)
    assert order_minhash.compare(table.limit(0)).count() == 0
    assert [r["near_next"] for r in order_minhash.compare(table.limit(1)).collect()] == [1.0]


def test_order_minhash_of_repeated_rows(spark, monkeypatch):
    """Rows repeated more often than a run is long give the same as one by one."""
    given = [(3, "some text to compare")] * 9 + [(2, "another text, edited")] * 2 + [(1, "the last of the texts")] + [(None, None)] * 7
    table = spark.createDataFrame(given, "doc_id long, text string")
    found = []
    for run in (400, 5):
        monkeypatch.setattr(order_minhash, "RUN", run)
        found.append(sorted(map(repr, order_minhash.compare(table).collect())))
    assert found[0] == found[1] and len(found[0]) == 19
    got = [r for r in order_minhash.compare(table).collect() if r["doc_id"] == 3]
    assert sorted(r["near_next"] == 1.0 for r in got) == [False] + [True] * 8
    one = order_minhash.signatures(table.where("doc_id = 1")).first()["signature"]
    assert list(one) == plain_signature("the last of the texts")


# --- 10: mixing -----------------------------------------------------------------------------------


def test_mixing_meets_targets(spark, medium):
    documents = spark.read.parquet(f"{medium}/documents.parquet")
    labelled = documents.select("doc_id", F.col("lang").alias("domain"))
    got, report = mixing.rates(documents, labelled, queries.LANGUAGE_WEIGHTS)
    table = got.toPandas()
    assert len(table) == 1000 and (table["rate"] >= 0).all()
    total = {d: (table["rate"] * table["tokens"] * table[f"p_{d}"]).sum() for d in queries.LANGUAGE_WEIGHTS}
    for d, w in queries.LANGUAGE_WEIGHTS.items():
        assert total[d] / sum(total.values()) == pytest.approx(w, abs=1e-6)
    langs = documents.select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    best = table.set_index("doc_id")[[f"p_{d}" for d in sorted(queries.LANGUAGE_WEIGHTS)]].idxmax(axis=1).str[2:]
    assert (best == langs[best.index]).mean() > 0.97
    assert abs((table["copies"] * table["tokens"]).sum() / (table["rate"] * table["tokens"]).sum() - 1) < 0.05


def test_mixing_goes_to_zero(spark):
    texts = ["aaaa aaaa aaaa"] * 20 + ["zzzz zzzz"] * 20
    table = docs(spark, texts)
    labelled = table.select("doc_id", F.when(F.col("doc_id") < 20, "a").otherwise("z").alias("domain"))
    got, report = mixing.rates(table, labelled, {"a": 1.0, "z": 0.0}, budget=90.0)
    assert (got.toPandas()["rate"] >= 0).all()
    assert report["expected"][1] < 0.05 * report["expected"][0]


def test_mixing_edges(spark):
    table = docs(spark, [None, "", "abc abc", "abd", "abd"]).withColumn("_p0", F.lit(9)).withColumn("rate", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, domain string")
    got, _ = mixing.rates(table, none, {"en": 1.0})
    assert {r["rate"] for r in got.collect()} == {1.0}
    same = mixing.mixed(table, none, {"en": 1.0})
    assert same.columns == table.columns and same.count() == 5
    assert mixing.mixed(table.limit(0), none, {"en": 1.0}).count() == 0


def test_mixing_leaves_domains_without_weight(spark, medium):
    """A language that has no weight keeps its documents, and the others' targets are met."""
    documents = spark.read.parquet(f"{medium}/documents.parquet")
    shifted = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "nopqrstuvwxyzabcdefghijklm")
    fifth = F.col("doc_id") % 33 == 0
    documents = documents.withColumn("text", F.when(fifth, shifted).otherwise(F.col("text"))).withColumn("lang", F.when(fifth, "xx").otherwise(F.col("lang")))
    got, report = mixing.rates(documents, documents.select("doc_id", F.col("lang").alias("domain")), queries.LANGUAGE_WEIGHTS)
    assert report["converged"] and report["domains"][-1] == "xx"
    assert report["expected"][:4] == pytest.approx(report["target"][:4], rel=1e-6)
    table = got.toPandas().set_index("doc_id")
    assert (table["copies"] > 0).mean() > 0.99
    assert table.loc[table["p_xx"] > 0.9, "rate"].between(0.8, 1.3).all()


def test_mixing_without_budget_drops_none(spark, medium):
    documents = spark.read.parquet(f"{medium}/documents.parquet")
    got, report = mixing.rates(documents, documents.select("doc_id", F.col("lang").alias("domain")), queries.LANGUAGE_WEIGHTS)
    table = got.toPandas()
    assert report["converged"] and (table["rate"] >= 1).all() and (table["copies"] >= 1).all()


# --- SQL and pipeline -----------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, small, name):
    with duckdb.connect() as con:
        for t in ("pages", "embeddings"):
            con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
        found = con.execute(queries.ORACLES[name])
        columns = [c[0] for c in found.description]
        expected = sorted(map(repr, found.fetchall()))
    got = queries.QUERIES[name](spark, small)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == expected


def test_pipeline(spark, small):
    import corpus_pipeline

    documents = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    kept = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, small).cache()
        assert kept.columns == documents.columns, name
        if "mixing" in name:
            assert kept.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    left = {r["doc_id"] for r in kept.collect()}
    marked = {r["doc_id"]: r for r in labels.collect()}
    bad = [i for i, r in marked.items() if r["quality"] == 0 or r["toxic"] == 1]
    assert len([i for i in bad if i in left]) <= 0.1 * len(bad)
    prints = {r["doc_id"]: plain_print(r["text"]) for r in kept.dropDuplicates(["doc_id"]).collect()}
    ids = sorted(prints)
    assert len(set(plain_groups([prints[i] for i in ids]))) == len(ids)
    out = corpus_pipeline.run(spark, small)
    assert out.count() == kept.count()
    texts = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in documents.collect()}
    assert all(r["decoded_sha256"] == texts[r["doc_id"]] for r in out.collect())


def test_remembered_pre_tokens_stay_small():
    import sys

    ranks = {bytes([i]): i for i in range(256)}
    own = bpe.Encoder(ranks, r"\S+")
    for i in range(400_000):
        own[f"word{i:06}"]
    held = [*own.items(), *own.older.items()]
    size = sys.getsizeof(own) + sys.getsizeof(own.older) + sum(sys.getsizeof(k) + sys.getsizeof(v) + sum(map(sys.getsizeof, v)) for k, v in held)
    assert size < 80e6  # a worker's; an executor has one for each core
    assert own.encode("word000001 word399999") == [*b"word000001", *b"word399999"]


def test_very_many_pre_tokens_are_remembered(monkeypatch):
    """Merging what was met before is most of the work on texts of many words."""
    own, made, merged = bpe.Encoder({bytes([i]): i for i in range(256)}, r"\S+"), [], bpe.merged
    monkeypatch.setattr(bpe, "merged", lambda piece, ranks: made.append(piece) or merged(piece, ranks))
    words = [chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676 % 26) + chr(97 + i // 17576) for i in range(140_000)]
    for text in (" ".join(words), " ".join(words)):
        assert own.encode(text) == [*"".join(words).encode()]
    assert len(made) == len(words)
