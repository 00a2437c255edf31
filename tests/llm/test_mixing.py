import duckdb
import pytest
from matchgrid.llm import mixing


def test_query_matches_sql(spark, sf):
    got = mixing.op4_mixing(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = db.execute(mixing.OP4_SQL).df().sort_values("doc_id").reset_index(drop=True)
    for c in got.columns:
        assert ((got[c] - want[c]).abs().fillna(0) < 1e-6).all() and (got[c].isna() == want[c].isna()).all(), c
    by = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() <= 1).all() and (got.taken <= 2 * got["size"]).all()


def test_targets_fill_like_water(spark):
    sizes = {"a": 1, "b": 100, "c": 30, "d": 50, None: 10}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1]))
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
        open_ -= over
    want |= {s: level * weights[s] for s in open_}
    assert got == pytest.approx(want)


def test_schedule_inverts_its_integral(spark):
    for knots in mixing.SCHEDULES:
        df = spark.range(11).selectExpr("id / 10.0D as share")
        rows = df.withColumn("t", mixing.invert_demand(df.share, knots)).collect()
        grid = 20000
        def weight(t):
            for (a, x), (b, y) in zip(knots, knots[1:]):
                if t <= b:
                    return x + (y - x) * (t - a) / (b - a)
        total = sum(weight((i + 0.5) / grid) for i in range(grid))
        for r in rows:
            used = sum(weight((i + 0.5) / grid) for i in range(int(r["t"] * grid)))
            assert used / total == pytest.approx(r["share"], abs=1e-3)


def test_nulls_ties_and_clashing_names(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "x y z", "a"), (3, "x y z", "a"), (None, "p q", None), (5, "w " * 50, "b")]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, source string, size int, target int")
    got = mixing.mix(docs)
    assert got.count() == len(rows) and got.where("size = 7 and target = 8").count() == len(rows)
    mixed = mixing.curriculum(docs)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    words = sum(len(r["text"].split()) for r in rows)
    assert abs(words - 1.5 * 58) <= (50 + 3 + 2) / 2 and {r["text"] for r in rows} <= {"x y z", "p q", "w " * 50}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 1_000_000, "a"), (2, "w " * 10, "b"), (3, "w " * 10, "b")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(docs, keep=["doc_id"]).collect()}
    assert {r["doc_id"]: len(r["text"].split()) for r in mixing.curriculum(docs).collect()}[1] == 1_000_000  # whole, in each pass that takes it
    assert got[1][0] == 1_000_000 and got[1][1] == 1_500_030 - 40 and got[2] == got[3] == (10, 20)
