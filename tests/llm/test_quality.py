import hashlib
import math
import random
import re
from collections import Counter

from matchgrid.llm import quality
from pyspark.sql import functions as F


def _features(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count, hit = Counter(windows), set()
    for k, w in enumerate(windows):
        if count[w] > 1:
            hit |= set(range(k, k + 5))
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


def test_features_match_brute_force(spark, sf):
    rng = random.Random(1)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += [None, "", " \n\x0b\t", "a b c d", "a b c d e", "x " * 30, "é 🙂 #$ \x1c y", " lead\n\n lead\nlead \nb\nb\n"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(80))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, k_0 int")
    got = {r["doc_id"]: [r[c] for c in quality.BASE_FEATURES] for r in quality.features(df).collect()}
    assert got == {i: _features(t) for i, t in enumerate(texts)}


def test_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 5, 40, 300, 5000) for k in (0, 1, 2, 7, 30) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality.binomial_tail(F.col("k"), F.col("n"), 0.02))
    for r in df.collect():
        if r["k"] >= r["n"] * 0.02:
            assert r["p"] == 1.0
            continue
        want = sum(math.comb(r["n"], i) * 0.02**i * 0.98 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert abs(r["p"] - want) < 1e-9


def test_cutoffs_stop_at_the_first_that_fails(spark):
    """20,000 good documents a stratum: 0.05 % score 0.9, the rest 0.03; the path stops before the cutoff that rejects all."""
    rows = [(i, "a" if i % 2 else "b", 0.9 if i % 4000 < 2 else 0.03) for i in range(40000)] + [(50000, "few", 0.9)]
    scored = spark.createDataFrame(rows, "doc_id long, stratum string, s_symbols double")
    for r in quality.RULES:
        if r != "symbols":
            scored = scored.withColumn(f"s_{r}", F.lit(0.0))
    labels = scored.select("doc_id", F.lit(1).alias("quality")).union(spark.createDataFrame([(0, 0)], "doc_id long, quality int"))
    got = {r["stratum"]: r["cutoffs"] for r in quality.thresholds(scored, labels).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["symbols"] == 0.03 and got["a"]["lines"] == 0.01


def _tunes(i):
    return int(hashlib.md5(str(i).encode()).hexdigest()[0], 16) < quality.TUNING


def test_the_holdout_ends_the_path(spark):
    """Documents that pick the path score 0; in the holdout 10 % of one stratum score 0.27, and 2 of 300 of another."""
    ids = [i for i in range(4000) if not _tunes(i)][:1000]
    rows = [(i, "many", 0.27 if k % 10 == 0 else 0.0) for k, i in enumerate(ids[:700])]
    rows += [(i, "some", 0.27 if k in (5, 6) else 0.0) for k, i in enumerate(ids[700:])]
    rows += [(i, "many", 0.0) for i in range(4000) if _tunes(i)][:200]
    scored = spark.createDataFrame(rows, "doc_id long, stratum string, s_symbols double")
    for r in quality.RULES:
        if r != "symbols":
            scored = scored.withColumn(f"s_{r}", F.lit(0.0))
    got = {r["stratum"]: (r["steps"], r["cutoffs"]["symbols"]) for r in quality.thresholds(scored, scored.select("doc_id", F.lit(1).alias("quality"))).collect()}
    # 0.25 is the fourth cutoff; the binomial tail of 2 in 300 at 0.03 is 0.006, of 70 in 700 far above
    assert got == {"many": (3, 0.3), "some": (14, 0.01)}


def test_a_second_holdout_loses_no_more_than_the_risk(spark):
    """Cutoffs from every other label; the other good documents lose at most RISK, and bad ones go."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    got = quality.judge(docs, labels.where("doc_id % 2 = 0"), keep=["doc_id", "lang"]).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    met = got.groupBy("quality", "lang").agg(F.avg((~F.col("kept")).cast("int")).alias("lost"), F.count("*").alias("n")).collect()
    assert [r for r in met if r["quality"] == 1 and r["n"] * r["lost"] > r["n"] * quality.RISK] == []
    assert {r["lang"]: r["lost"] for r in met if r["quality"] == 0}["en"] > 0.5


def test_rules_are_certified_and_reject(spark):
    """On sf0.01 too: some rule has a cutoff and rejects documents that are labelled bad."""
    sf = "/root/testdata/sf0.01"
    got = quality.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert got.where("failed_rules <> '' and quality = 0").count() > 0


def test_a_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(200_000)) + " same five words again here" * 2
    docs = spark.createDataFrame([(1, "en", text)], "doc_id long, lang string, text string")
    assert [quality.features(docs).first()[c] for c in quality.BASE_FEATURES] == _features(text)


def test_nulls_ties_and_clashing_names(spark):
    rows = [(1, None, None), (2, "", "en"), (3, "word " * 30, "en"), (3, "word " * 30, "en"), (None, " ".join(f"w{i}" for i in range(40)), "fr")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 1)], "doc_id long, quality int")
    got = quality.judge(docs, labels)
    assert got.columns[:4] == docs.columns and "_kept" in got.columns
    assert sorted((r["doc_id"] or 0, r["n_words"], r["base_failed"], r["_kept"]) for r in got.collect()) == [(0, 40, False, True), (1, 0, True, False), (2, 0, True, False), (3, 30, True, False), (3, 30, True, False)]
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_good_documents_stay(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op8_quality(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    met = got.join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    share = {r["quality"]: r["k"] for r in met.collect()}
    assert share[1] >= 0.99
