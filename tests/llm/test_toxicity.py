import random
import zlib

import duckdb
import numpy as np
from matchgrid.llm import toxicity
from pyspark.sql import functions as F

WORDS = [a + b for a in ("ka", "lo", "mi", "re", "su", "ta") for b in ("na", "pe", "di", "vo", "gu", "sh")]


def _corpus(n=600, seed=2, share=0.2):
    """(doc_id, text, toxic): toxic texts hold inflected forms of two stems among harmless words."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = rng.random() < share
        words = rng.choices(WORDS, k=rng.randint(5, 40))
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["grolo", "brutz"]) + rng.choice(["", "en", "ung", "a"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_the_risk_of_positive_and_unlabelled_texts_separates_the_classes():
    rng = np.random.default_rng(4)
    positive = [np.unique(np.r_[0, rng.integers(1, 6, 2)]) for _ in range(200)]
    unlabelled = [np.unique(np.r_[0 if i % 5 == 0 else 1, rng.integers(1, 6, 2)]) for i in range(1000)]
    weights, bias = toxicity.fit_nnpu(positive, unlabelled, 6, 0.2)
    assert weights[0] + bias > 1 and all(bias + weights[1:].clip(min=0).sum() < weights[0] + bias for _ in [0]) and bias < -1
    # the unlabelled texts that are toxic are found, the others are left alone
    z = [weights[t].sum() + bias for t in unlabelled]
    assert [x > 0 for x in z] == [i % 5 == 0 for i in range(1000)]
    again, b = toxicity.fit_nnpu(positive, unlabelled, 6, 0.2)
    assert np.array_equal(weights, again) and b == bias


def test_telling_features_match_a_plain_count(spark):
    rng = random.Random(1)
    rows = [(1, sorted({7, *rng.sample(range(10, 40), 3)} if rng.random() < 0.6 else rng.sample(range(10, 40), 3))) for _ in range(150)]
    rows += [(0, sorted({7, *rng.sample(range(10, 40), 4)} if rng.random() < 0.05 else rng.sample(range(10, 40), 4))) for _ in range(500)]
    got = toxicity.telling(spark.createDataFrame(rows, "kind int, features array<int>")).tolist()
    n, m = 150, 500
    want = []
    for f in range(50):
        p, u = (sum(f in x for k, x in rows if k == kind) for kind in (1, 0))
        s = (p + u) / (n + m)
        if p + u >= toxicity.MIN_TEXTS and p and p / n - u / m >= toxicity.APART * (s * (1 - s) * (1 / n + 1 / m)) ** 0.5:
            want.append(f)
    assert got == want == [7]


def test_inflected_forms_are_found_and_clean_texts_left_alone(spark):
    rows = _corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    positives = spark.createDataFrame([(i,) for i, _, toxic in rows if toxic and i % 2], "doc_id long")
    model = toxicity.learn(docs, positives, 0.2)
    new = [(0, "kana lope brutzheit mide", 1), (1, "GROLOEN", 1), (2, "kana lope mide", 0), (3, "", 0), (4, None, 0), (5, "bru gro", 0), (6, ("kana lope " * 40_000) + "grolosch", 1)]
    got = toxicity.score_texts(spark.createDataFrame([r[:2] for r in new] * 2, "score int, text string"), model).collect()
    assert len(got) == 14 and got[0].asDict().keys() == {"score", "text", "_score"}
    assert {(r["score"], int(r["_score"] >= toxicity.THRESHOLD)) for r in got} == {(i, y) for i, _, y in new}
    assert len({r["_score"] for r in got if r["score"] in (3, 4)}) == 1
    found = toxicity.score_texts(docs, model).select("doc_id", "score").collect()
    assert {r[0] for r in found if r[1] >= toxicity.THRESHOLD} == {i for i, _, toxic in rows if toxic}


def test_without_positives_or_rows_there_is_no_model(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = docs.select("doc_id").limit(0)
    assert toxicity.learn(docs, none, 0.1) is None and toxicity.learn(docs.limit(0), none, 0.1) is None
    assert [r["score"] for r in toxicity.score_texts(docs, None).collect()] == [0.0, 0.0]
    assert toxicity.score_texts(docs.limit(0), None).count() == 0


def test_confirmed_labels_take_all_labels_of_a_document(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 0), (3, None), (4, 0), (None, 1), (5, 1), (5, None)], "doc_id long, toxic int")
    ids, prior = toxicity.confirmed(labels)
    assert sorted(r[0] for r in ids.collect()) == [1, 5] and prior == 0.5
    assert toxicity.confirmed(labels.limit(0))[1] == 0.001


def test_held_out_accuracy_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in toxicity.op11_toxicity(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in got.items())
    labels = duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall()
    held = [(got[i]["predicted"], y) for i, y in labels if i in got and got[i]["held_out"]]
    caught = sum(p for p, y in held if y) / sum(y for _, y in held)
    spared = sum(not p for p, y in held if not y) / sum(not y for _, y in held)
    assert caught > 0.8 and spared > 0.99


def test_labels_and_other_columns_are_no_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = toxicity.score_texts(docs, {"weights": {}, "bias": -1.0}).columns
    assert a == [*docs.columns, "score"]
    held = docs.select("doc_id", toxicity.held_out().alias("h")).union(docs.limit(1).select(F.lit(None).cast("long"), toxicity.held_out("n_chars") | True)).collect()
    assert any(r["h"] for r in held) and not all(r["h"] for r in held)
