"""Models and samples against plain versions of them; cases that once went wrong; the pipeline's edges."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meridian.llm import common, langid, mixing, quality, queries, simhash, topk, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


# --- 1: rules of equal length ---------------------------------------------------------------------


@pytest.mark.parametrize("first", [0, 1])
def test_first_of_equal_rules(spark, first):
    rules = [("block", "a.net/bc/"), ("allow", "bc.a.net/")]
    rules = rules[first:] + rules[:first]
    pages = spark.createDataFrame([("http://bc.a.net/bc/x" + "y" * 100_000,)], "url string")
    got = url_filter.judge(pages, spark.createDataFrame([], "key string"), rules).first()
    assert (got["verdict"], got["rule"]) == rules[0]


def test_listed_by_no_rule_of_its_name(spark):
    """A list that no pattern of the host tells: only the cascade knows it."""
    r = random.Random(8)
    hosts = [f"h{i}.example" for i in range(3000)]
    listed = set(r.sample(hosts, 700))
    pages = spark.createDataFrame([(f"https://{h.upper()}/p",) for h in hosts], "url string")
    got = url_filter.judge(pages, spark.createDataFrame([(h,) for h in listed], "key string"), [])
    assert {x["host"] for x in got.where("verdict = 'block'").collect()} == listed


# --- 3: naive Bayes support vectors ---------------------------------------------------------------


def test_ngrams_against_plain_python():
    codes = common.WordCodes()
    text = "The the cat sat. 12-3 cat sat!! " * 3
    ids = [codes[w] for w in text.split()]
    own = lambda x, salt: int(common.mixed(np.array([x], np.int64), salt)[0]) % quality.SLOTS
    want = {own(i & 0xFFFFFFFF, 1) for i in ids}
    pairs = list(zip(ids, ids[1:]))
    want |= {own((a & 0xFFFFFFFF) * 31 + (b & 0xFFFFFFFF) * 17, 2) for a, b in pairs}
    shapes = Counter(((a >> 32) << 17 | (b >> 32) << 1 | ((a & 0xFFFFFFFF) == (b & 0xFFFFFFFF))) for a, b in pairs)
    want |= {own(s * 128 + int(np.floor(np.log2(n / len(pairs)))) + 64, 3) for s, n in shapes.items()}
    assert set(quality.ngrams(text, codes).tolist()) == want


def test_dual_coordinate_descent_reaches_the_optimum():
    """The primal objective of the fit against that of plain subgradient descent on the same scaled indicators."""
    r = np.random.default_rng(4)
    y = np.where(np.arange(240) < 90, 1.0, -1.0)
    rows = [np.unique(np.concatenate([r.choice(60, 8), 60 + r.choice(25, 4) + 15 * (s > 0)])).astype(np.int32) for s in y]
    model = quality.fit(rows, (y > 0).astype(int), epochs=300)
    n = {s: (y == s).sum() for s in (1.0, -1.0)}
    counts = {s: np.bincount(np.concatenate([x for x, t in zip(rows, y) if t == s]), minlength=100) for s in n}
    ratio = np.log((counts[1.0] + 1) / (n[1.0] + 2)) - np.log((counts[-1.0] + 1) / (n[-1.0] + 2))
    ratio[counts[1.0] + counts[-1.0] <= 1] = 0
    x = np.zeros((len(rows), 101))
    for i, row in enumerate(rows):
        x[i, row] = ratio[row] / np.sqrt(len(row))
    x[:, 100] = 1
    cost = np.array([len(y) / (2 * n[s]) for s in y])
    loss = lambda w: 0.5 * w @ w + cost @ np.maximum(0, 1 - y * (x @ w))
    own = np.append(np.where(ratio != 0, model.weights[:100] / np.where(ratio != 0, ratio, 1), 0), model.intercept)
    w, best = np.zeros(101), np.inf
    for step in range(1, 20_001):
        w = w - (w - (cost * y * (y * (x @ w) < 1)) @ x) / step
        best = min(best, loss(w))
    assert loss(own) <= best * 1.01


# --- 4: factorization machine ---------------------------------------------------------------------


def test_places_are_a_set():
    kept = np.array([10, 20, 30], np.int32)
    assert toxicity.places_of(kept, np.array([15, 17, 20, 40], np.int32)).tolist() == [1]
    r = np.random.default_rng(1)
    for _ in range(50):
        kept, slots = (np.unique(r.integers(0, 60, 25)).astype(np.int32) for _ in range(2))
        assert kept[toxicity.places_of(kept, slots)].tolist() == sorted({*kept.tolist()} & {*slots.tolist()})
    assert not len(toxicity.places_of(np.empty(0, np.int32), slots))


def test_margin_against_all_pairs():
    r = np.random.default_rng(2)
    n = 12
    m = toxicity.FactorizationMachine(np.arange(n, dtype=np.int32), r.uniform(0, 1, n), 0.3, r.normal(size=n), r.normal(size=(n, toxicity.FACTORS)))
    at = np.array([0, 3, 4, 9])
    x = {i: max(m.x[i], toxicity.LEAST_PAIRED) for i in at}
    pairs = sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in at for j in at if i < j)
    assert m.margin(at) == pytest.approx(0.3 + sum(m.w[i] * m.x[i] for i in at) + pairs)


# --- 5: what the count rejects --------------------------------------------------------------------


def test_tally_against_all_pairs(spark):
    r = random.Random(6)
    prints = set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(20):
            p = base
            for byte in r.sample(range(8), r.randrange(0, 6)):
                p ^= r.choice([1, 3, 129, 255]) << 8 * byte
            prints.add(p)
    prints = sorted(prints)
    shared = lambda a, b: sum((a ^ b) >> 8 * i & 255 == 0 for i in range(8))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    entries = [F.struct(F.lit(n).alias("triple"), simhash._key(t).alias("bytes")) for n, t in enumerate(simhash.TRIPLES)]
    lists = table.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.triple", "e.bytes")
    in_half = lambda a, b: any(all((a ^ b) >> 8 * i & 255 == 0 for i in t) for t in simhash.TRIPLES)
    pairs = [(a, b) for a in prints for b in prints if signed(a) < signed(b)]
    meet = {(signed(a), signed(b)) for a, b in pairs if in_half(a, b)}
    enough = {(signed(a), signed(b)) for a, b in pairs if shared(a, b) >= simhash.LEAST_MATCHES}
    near = {(signed(a), signed(b)) for a, b in pairs if bin(a ^ b).count("1") <= simhash.BITS}
    kept = simhash.tallied(lists)
    assert {(x["a"], x["b"]) for x in kept.collect()} == enough
    assert all(x["matches"] == shared(x["a"] % (1 << 64), x["b"] % (1 << 64)) for x in kept.collect())
    assert {(x["a"], x["b"]) for x in simhash.verified(kept).collect()} == near
    assert len(near) < len(enough) < len(meet)  # the count rejects before verification, verification after it


# --- 6: rank-order profiles -----------------------------------------------------------------------


def plain_ranks(texts):
    counts = Counter()
    for t in texts:
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        counts.update(c for w in words for c in w)
        padded = " " + " ".join(words) + " "
        counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
        counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[: langid.PROFILE]]


def test_languages_against_plain_python(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    rows = table.collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    profiles = {}
    for lang in sorted({r["lang"] for r in rows if r["lang"]}):
        profiles[lang] = {g: n for n, g in enumerate(plain_ranks([r["text"] for r in rows if r["lang"] == lang and not held(r["doc_id"])]))}
    got = {r["doc_id"]: r for r in langid.identify(table, langid.learn(table)).collect()}
    for r in rows[:80]:
        top = plain_ranks([r["text"]])
        out = {x: sum(abs(p[g] - n) if g in p else langid.PROFILE for n, g in enumerate(top)) for x, p in profiles.items()}
        best = min(out, key=lambda x: (out[x], x))
        assert got[r["doc_id"]]["lang_pred"] == best
        assert got[r["doc_id"]]["score"] == pytest.approx(1 - out[best] / (langid.PROFILE * len(top)))


def test_letters_of_any_plane(spark):
    far = chr(0x30000) * 5
    table = spark.createDataFrame([(0, far, "zz"), (1, "abc", "aa"), (2, far * 2, None), (3, chr(0xE0001) + "1", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(table, langid.learn(table, held_out=None)).collect()}
    assert (got[2], got[3]) == ("zz", "und")


def test_samples_of_repeated_ids(spark):
    """A group whose rows are all of a few ids keeps them; each id is one row of the sample."""
    rows = [(0, "aa")] * 3000 + [(i, "bb") for i in range(1, 6)] * 600 + [(7, "cc")]
    got = common.hash_sample(spark.createDataFrame(rows, "doc_id long, lang string"), "lang", 600).collect()
    assert sorted((r["doc_id"], r["lang"]) for r in got) == [(0, "aa"), *((i, "bb") for i in range(1, 6)), (7, "cc")]
    table = spark.createDataFrame([(0, "abc abd", "aa")] * 2000 + [(1, "xyz xyy", "bb")], "doc_id long, text string, lang string")
    assert langid.learn(table, held_out=None).langs == ["aa", "bb"]


def test_gathered_bytes_are_bounded(spark):
    made = spark.createDataFrame([(i, i % 2, bytes(100)) for i in range(60)], "doc_id long, label int, x binary")
    got = common.gathered(made, "label", "x", most=1000)
    assert len(got) == 10 and sorted(Counter(got["label"]).values()) == [5, 5]
    assert len(common.gathered(made, "label", "x", most=1)) == 2
    one = common.one_each(spark.createDataFrame([(1, 0, "b"), (1, 0, "a"), (1, 1, "b")], "doc_id long, label int, text string"), "label")
    assert sorted(map(tuple, one.collect())) == [(1, 0, "a"), (1, 1, "b")]


# --- 7: components of any size --------------------------------------------------------------------


def test_topk_of_large_components(spark):
    x = [[3e6, -3e6], [1.0, 2.0], [-3e6, 5e5], [2.0**45, 0.5], [1e300, 1.0], [-1e300, 0.25], [0.5, 0.5]]
    got = topk.search(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>"), F.col("vec_id") < 7, 10).collect()
    end = (1 << 63) - 1
    q = [[max(-end - 1, min(end, int(np.floor(1024 * v)))) if abs(v) < 1e290 else (end if v > 0 else -end - 1) for v in row] for row in x]
    for i in range(7):
        scores = {j: sum(a * b for a, b in zip(q[i], q[j])) for j in range(7) if j != i}
        held = {j: max(-topk.MOST, min(topk.MOST, s)) for j, s in scores.items()}
        want = [(j, max(-end - 1, min(end, scores[j]))) for j in sorted(held, key=lambda j: (-held[j], j))]
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == want


# --- 10: mixing -----------------------------------------------------------------------------------


def test_posteriors_of_held_out_domains(spark, medium):
    """Domains of documents whose labels the classifier has not seen."""
    documents = spark.read.parquet(f"{medium}/documents.parquet")
    seen = documents.where("crc32(cast(doc_id as string)) % 3 <> 1")
    model = mixing.learn(documents, seen.select("doc_id", F.col("lang").alias("domain")))
    held = mixing.with_posteriors(documents.where("crc32(cast(doc_id as string)) % 3 = 1"), model, ["lang"]).toPandas()
    best = [model.domains[i] for i in held[[f"_p{i}" for i in range(len(model.domains))]].to_numpy().argmax(axis=1)]
    assert len(held) > 250 and (np.array(best) == held["_c0"].to_numpy()).mean() > 0.95


def test_rates_against_plain_projected_gradient(spark):
    """Targets that can be met are; of others the fit says whether it ended, and comes nearer than it began."""
    r = np.random.default_rng(3)
    tokens, p = r.integers(1, 50, 60), r.dirichlet([0.7, 0.7, 0.7], 60)
    p[:, 2] = np.where(np.arange(60) < 55, p[:, 2] + 0.3, p[:, 2])
    p /= p.sum(axis=1, keepdims=True)
    table = spark.createDataFrame([(int(t), *map(float, row)) for t, row in zip(tokens, p)], "_tokens long, _p0 double, _p1 double, _p2 double")
    model = mixing.SoftDomains(["a", "b", "c"], np.zeros((mixing.SLOTS, 3)), np.zeros(3))
    for weights in ({"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 0.5, "b": 0.5, "c": 0.0}):
        rate, report = mixing.fit_rates(table, model, weights, budget=2000.0)
        target = 2000.0 * np.array([weights[d] for d in "abc"])
        a = (tokens[:, None] * p).T
        own = np.array([x["r"] for x in table.select(rate.alias("r")).collect()])
        assert (own >= 0).all() and report["expected"] == pytest.approx((a @ own).tolist(), rel=1e-9)
        metric = np.linalg.pinv((a / tokens) @ a.T)
        error = lambda x: (a @ x - target) @ metric @ (a @ x - target)
        x, best = np.ones(60), np.inf
        size = 1.0 / np.linalg.eigvalsh(a.T @ metric @ a).max()
        for _ in range(20_000):
            x = np.maximum(0, x - size * (a.T @ (metric @ (a @ x - target))))
        best = error(x)
        if report["converged"]:
            assert error(own) <= best * 1.05 + 1e-6 * target.sum()
        else:
            assert best > 1 and best <= error(own) < error(np.ones(60))
        assert report["converged"] or weights["c"] == 0.0


def test_rates_without_a_source(spark):
    table = spark.createDataFrame([(1, "abc abc"), (2, "xyz xyz"), (2, "xyz xyz")], "doc_id long, text string")
    labelled = spark.createDataFrame([(1, "en"), (2, "EN")], "doc_id long, domain string")
    got, _ = mixing.rates(table, labelled, {"en": 0.5, "EN": 0.5})
    assert got.columns == ["doc_id", "tokens", "p_EN", "_p_en", "rate", "copies"] and got.count() == 3


# --- the pipeline's stages ------------------------------------------------------------------------


def written(spark, folder, texts):
    """documents and labels, with nulls, repeated rows, extra columns of names that operators use."""
    table = docs(spark, texts).unionByName(docs(spark, texts[:2]))
    for c in ("score", "copies", "fp", "root", "_p0", "h", "run", "predicted"):
        table = table.withColumn(c, F.lit("own"))
    table = table.unionByName(table.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, len(texts), 2)] + [(1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_with_odd_rows(spark, tmp_path):
    r = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta!"]
    texts = [None, "", "  ", "one", "é😀\x00 x"] + [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(30)] + ["word " * 30_000]
    table = written(spark, str(tmp_path), texts)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, str(tmp_path))
        assert out.count() <= 3 * table.count() if "mixing" in name else out.count() <= table.count(), name
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == table.columns, name
            assert set(out.select("text").distinct().collect()) <= set(table.select("text").distinct().collect()), name
        else:
            assert out.count() == table.count()
        none = stage(spark, table.limit(0), str(tmp_path))
        assert none.count() == 0, name


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert set(queries.QUERIES) >= {"op1_url_filter", "op10_mixing"}
