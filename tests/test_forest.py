import itertools
import math
import random

import numpy as np
import pytest
from matchgrid.operators import dataset, forest, models, predictions, simulate
from matchgrid.plans import model_queries
from pyspark.sql import functions as F

SMALL = forest.Growth(trees=12, depth=3, leaf=2)


def _rows(spark, n=40, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.random(), rng.random(), rng.choice([None, rng.random()])
        rows.append((f"r{i:03}", a, b, c, float((a > 0.5) + (b > 0.7)), float(rng.randint(0, 4) + (a > 0.5))))
    return spark.createDataFrame(rows, "id string, a double, b double, c double, y double, goals double")


FEATURES = ["a", "b", "c"]


def test_cuts_are_the_best_of_all(spark):
    rng = np.random.default_rng(2)
    x, y, w = rng.integers(0, 6, (30, 3)).astype(float), rng.integers(0, 3, 30), rng.random(30) + 0.1
    t = np.eye(3)[y]
    gain, column, cut = forest._best_cut(x, t, w, 4)
    best = -1.0
    for j in range(3):
        for v in sorted(set(x[:, j]))[:-1]:
            low = x[:, j] <= v
            if min(low.sum(), (~low).sum()) >= 4:
                best = max(best, sum((w[s, None] * t[s]).sum(axis=0) @ (w[s, None] * t[s]).sum(axis=0) / w[s].sum() for s in (low, ~low)))
    assert gain == pytest.approx(best) and 0 <= column < 3
    low = x[:, column] <= cut
    assert sum((w[s, None] * t[s]).sum(axis=0) @ (w[s, None] * t[s]).sum(axis=0) / w[s].sum() for s in (low, ~low)) == pytest.approx(best)


def test_trees_keep_their_bounds_and_repeat():
    rng = np.random.default_rng(3)
    x, y = rng.random((200, 5)), rng.integers(0, 2, 200)
    rows = forest.Rows(list(range(200)), np.arange(200) % 4, x, np.eye(2)[y], [0.0, 1.0])
    how = forest.Growth(trees=1, depth=4, leaf=5)
    nodes = forest.grow(rows, 2, 7, how)
    assert nodes == forest.grow(rows, 2, 7, how) != forest.grow(rows, 1, 7, how)

    def depth(i):
        return 0 if nodes[i][0] < 0 else 1 + max(depth(nodes[i][2]), depth(nodes[i][3]))

    assert 1 <= depth(0) <= 4
    for f, _, left, right, cover, value in nodes:
        assert sum(value) == pytest.approx(1)
        if f >= 0:
            assert nodes[left][4] + nodes[right][4] == pytest.approx(cover)


def test_joint_leave_one_out_equals_fits_one_by_one(spark):
    df = _rows(spark)
    got = {r["id"]: r for r in forest.leave_one_out(df, "id", FEATURES, "y", SMALL).collect()}
    rows = forest.fit_sample(df, "id", FEATURES, "y", None)
    assert len(got) == 40
    for i, key in enumerate(rows.keys):
        inside = np.arange(40) != i
        alone = forest.Rows([k for k in rows.keys if k != key], np.full(39, 10**6), rows.x[inside], rows.y[inside], rows.classes)
        x = forest.filled(rows.x[i : i + 1], forest.medians(alone.x))
        p = np.zeros(3)
        for tree in range(SMALL.trees):
            nodes = forest.grow(alone, i, tree, SMALL)
            p += np.array(nodes[forest.descend(x, nodes)[0]][5]) / SMALL.trees
        assert got[key]["p"] == pytest.approx(p.tolist()) and got[key]["prediction"] == rows.classes[int(np.argmax(np.round(got[key]["p"], 15)))]


def test_folds_predict_every_row_from_a_bounded_sample(spark):
    df = _rows(spark, 400)
    got = forest.cross_predict(df, "id", FEATURES, "y", 3, SMALL, fit_rows=150)
    met = got.join(df, "id")
    assert met.count() == 400 and met.where("prediction = y").count() > 330
    assert {r["id"] for r in got.collect()} == {r["id"] for r in df.collect()}
    sample = forest.fit_sample(df, "id", FEATURES, "y", 3, 150)
    assert len(sample.keys) <= 150 and sample.keys == sorted(sample.keys)
    with pytest.raises(ValueError, match="leaving one out"):
        forest.leave_one_out(df, "id", FEATURES, "y", SMALL, fit_rows=100)


def test_nulls_ties_one_class_and_empty_tables(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", None, 1.0), ("c", None, None)], "id string, x double, y double")
    assert {(r["id"], r["prediction"]) for r in forest.leave_one_out(df, "id", ["x"], "y", SMALL).collect()} == {("a", 1.0), ("b", 1.0)}
    assert forest.leave_one_out(df.limit(0), "id", ["x"], "y", SMALL).count() == 0
    assert forest.poisson_predict(df.limit(0), "id", ["x"], "y", None).count() == 0
    even = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 1.0), ("c", 0.0, 0.0), ("d", 0.0, 1.0)], "id string, x double, y double")
    assert {r["prediction"] for r in forest.cross_predict(even, "id", ["x"], "y", 1, forest.Growth(trees=1)).collect()} <= {0.0, 1.0}


def _expected(nodes, x, known, me=0):
    f, cut, left, right, cover, value = nodes[me]
    if f < 0:
        return np.array(value)
    if f in known:
        return _expected(nodes, x, known, left if x[f] <= cut else right)
    return sum(nodes[c][4] / cover * _expected(nodes, x, known, c) for c in (left, right))


def test_shapley_values_are_those_of_all_subsets(spark):
    df = _rows(spark, 60)
    rows = forest.fit_sample(df, "id", FEATURES, "y", 1)
    nodes = forest.fit_forests(df, rows, forest.Growth(trees=5, depth=4, leaf=2))
    (trees,) = forest._packed(nodes).values()
    fill = forest.medians(rows.x)
    got = {}
    for r in forest.shapley(df, "id", FEATURES, nodes, fill).collect():
        got.setdefault(r["id"], {})[r["feature"]] = np.array(r["values"])
    for i in (0, 7, 31):
        x = forest.filled(rows.x[i], fill)
        for j, name in enumerate(FEATURES):
            others = [k for k in range(3) if k != j]
            want = 0
            for size in range(3):
                for s in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(2 - size) / math.factorial(3)
                    want = want + weight * sum(_expected(t, x, {*s, j}) - _expected(t, x, set(s)) for t in trees) / len(trees)
            assert got[rows.keys[i]][name] == pytest.approx(want, abs=1e-12)
    # they sum to the prediction less the mean output
    p = {r["id"]: np.array(r["p"]) for r in forest.apply(df, "id", FEATURES, nodes, fill, rows.classes).collect()}
    base = sum(_expected(t, None, set()) for t in trees) / len(trees)
    for key, values in got.items():
        assert sum(values.values()) == pytest.approx(p[key] - base, abs=1e-12)


def test_ranking_search_and_retraining(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(f"r{i}", rng.random(), rng.random(), rng.random()) for i in range(120)], "id string, a double, b double, c double").withColumn("y", (F.col("a") * F.col("b") > 0.25).cast("double"))
    ranked = forest.shapley_ranking(df, "id", FEATURES, "y", SMALL).orderBy("place").collect()
    assert {ranked[0]["feature"], ranked[1]["feature"]} == {"a", "b"} and ranked[2]["importance"] < ranked[1]["importance"] / 2
    found = models.subset_search(df, [r["feature"] for r in ranked], [1, 2, 9], "id", folds=3, how=SMALL).collect()
    assert [r["size"] for r in found] == [1, 2, 3] and found[1]["accuracy"] > found[0]["accuracy"] and sum(r["best"] for r in found) == 1
    steps = {r["step"]: r for r in models.retrain(df, ["a", "b"], "id", "y", [("product", "a", "b"), ("diff", "a", "missing")], 3, SMALL).collect()}
    assert steps["selected"]["features"] == 2 and steps["with_interactions"]["features"] == 3
    assert steps["with_interactions"]["accuracy"] > 0.9


def test_poisson_fits_are_optimal_and_leave_their_row_out(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3)) * [1, 10, 0.1] + 4
    y = rng.poisson(np.exp(0.3 * (x[:, 0] - 4))).astype(float)
    b, mean, scale = forest.fit_poisson(x, y, 0.5)
    z = np.column_stack(((x - mean) / scale, np.ones(80)))
    assert np.abs(z.T @ (np.exp(z @ b) - y) / 80 + np.append(0.5 * b[:-1], 0)).max() < 1e-8
    df = _rows(spark, 30)
    got = {r["id"]: r["prediction"] for r in forest.poisson_predict(df, "id", FEATURES, "goals", None).collect()}
    rows = forest.fit_sample(df, "id", FEATURES, "goals", None, classify=False)
    for i in (0, 11, 29):
        inside = np.arange(30) != i
        fill = forest.medians(rows.x[inside])
        b, mean, scale = forest.fit_poisson(forest.filled(rows.x[inside], fill), rows.y[inside, 0], 0.1)
        assert got[rows.keys[i]] == pytest.approx(math.exp((forest.filled(rows.x[i], fill) - mean) / scale @ b[:-1] + b[-1]))


def test_prediction_frame(spark):
    m = spark.createDataFrame(
        [("A vs B", "World Cup 2018", "Group", False, False, 2, 1, 1, 1700.0, 1500.0), ("C vs D", "World Cup 2018", "Final", True, True, 1, 1, 0, 1500.0, None)],
        "match string, tournament string, stage string, is_knockout boolean, went_to_et boolean, home_score int, away_score int, result int, elo_home double, elo_away double",
    )
    p = spark.createDataFrame([("A vs B", 1, 0.5, 0.3, 0.2), ("C vs D", -1, 0.3, 0.3, 0.4)], "match string, pred int, p_home double, p_draw double, p_away double")
    rows = {r["match"]: r for r in predictions.frame(m, p).collect()}
    assert list(rows["A vs B"].asDict()) == list(predictions.FRAME) and len(predictions.FRAME) == 26
    r = rows["A vs B"]
    assert r["correct"] and r["actual_label"] == "Home Win" and r["short_tournament"] == "2018" and r["elo_favorite"] == 1 and r["agree_elo_favorite"]
    assert r["pnl_unit"] == pytest.approx(0.95 / r["elo_prob_pred"] - 1) and r["edge_vs_elo"] == pytest.approx(0.5 - r["elo_prob_pred"])
    assert rows["C vs D"]["pnl_unit"] == -1 and rows["C vs D"]["pred_label"] == "Away Win" and rows["C vs D"]["elo_pred"] == 1


def test_model_frames_and_upsets_over_a_cohort(spark):
    rng = random.Random(9)
    rows = [(f"m{i}", 1500.0 + 40 * (i % 12), 1500.0 - 40 * (i % 5), rng.choice([1, 1, 0, -1]), rng.random()) for i in range(60)]
    m = spark.createDataFrame(rows, "match string, elo_home double, elo_away double, result int, form double")
    p = predictions.model_probabilities(m, ["elo_home", "elo_away", "form"], how=SMALL).collect()
    assert len(p) == 60 and all(abs(r["p_home"] + r["p_draw"] + r["p_away"] - 1) < 1e-9 and r["pred"] in (-1, 0, 1) for r in p)
    u = predictions.upset_frame(m, ["elo_home", "elo_away", "form"], least_gap=200, how=SMALL).collect()
    assert {r["match"] for r in u} == {r["match"] for r in dataset.cohort(dataset.upsets(m), 200).collect()} and all(0 <= r["p_upset"] <= 1 for r in u)
    none = predictions.upset_frame(m.where("result = 1 and elo_home > elo_away"), ["form"], how=SMALL)
    assert {r["p_upset"] for r in none.collect()} == {0.0}


def test_reports_hold_three_models(spark):
    m = spark.createDataFrame([("x", 1600.0, 1500.0), ("y", 1500.0, 1500.0)], "match_id string, elo_home double, elo_away double")
    p = spark.createDataFrame([("x", 0.2, 0.3, 0.5)], "match_id string, p_home double, p_draw double, p_away double")
    rows = {r["match_id"]: r for r in simulate.reports(m, p).collect()}
    assert rows["x"]["elo_pick"] == 1 and rows["x"]["poisson_pick"] == 1 and rows["x"]["model_pick"] == -1 and len(rows["x"]["top_scores"]) == 3
    assert rows["y"]["model_pick"] is None and rows["y"]["poisson_home"] == pytest.approx(rows["y"]["poisson_away"])
    one = simulate.report(1600, 1500, spark)
    assert one["by_scores"].first()["p_home"] == pytest.approx(rows["x"]["poisson_home"])


def test_reports_can_be_written(spark, sf, tmp_path):
    m = spark.createDataFrame([("x", 1600.0, 1500.0), ("y", 1500.0, 1500.0)], "match_id string, elo_home double, elo_away double")
    p = spark.createDataFrame([("x", 0.2, 0.3, 0.5)], "match_id string, p_home double, p_draw double, p_away double")
    simulate.reports(m, p).write.parquet(str(tmp_path / "made"))
    rows = {r["match_id"]: r for r in spark.read.parquet(str(tmp_path / "made")).collect()}
    assert (rows["x"]["rating_home"], rows["x"]["rating_away"]) == (1600.0, 1500.0)
    assert rows["x"]["elo_home"] + rows["x"]["elo_draw"] + rows["x"]["elo_away"] == pytest.approx(1) and rows["x"]["elo_home"] > rows["x"]["elo_away"]
    report = model_queries.q90_match_report(spark, sf)
    assert len(set(report.columns)) == len(report.columns)
    report.write.parquet(str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report")).count() == model_queries._pairings(spark, sf).count()


def test_poisson_predictions_keep_columns_with_their_rows(spark):
    df = _rows(spark, 60)
    got = {r["id"]: (r["prediction"], r["goals"]) for r in forest.poisson_predict(df, "id", FEATURES, "goals", 3, keep=["goals"]).collect()}
    plain = {r["id"]: r["prediction"] for r in forest.poisson_predict(df, "id", FEATURES, "goals", 3).collect()}
    assert {k: p for k, (p, _) in got.items()} == plain
    assert {k: g for k, (_, g) in got.items()} == {r["id"]: r["goals"] for r in df.collect()}
    both = forest.poisson_predict(df, "id", FEATURES, "goals", 3, keep=[FEATURES[0], "goals"])
    assert both.columns == ["id", "prediction", FEATURES[0], "goals"]
    assert sorted(map(str, both.drop("prediction").collect())) == sorted(map(str, df.select("id", FEATURES[0], "goals").collect()))
    with pytest.raises(ValueError, match="kept with folds"):
        forest.poisson_predict(df, "id", FEATURES, "goals", None, keep=["goals"])


def test_poisson_fits_of_folds_are_of_all_rows(spark):
    df = _rows(spark, forest.FIT_ROWS + 700, seed=8)
    some = df.withColumn("goals", F.when(F.col("id") != "r007", F.col("goals")))  # a row without a label is predicted only
    got = {r["id"]: r["prediction"] for r in forest.poisson_predict(some, "id", FEATURES, "goals", 3).collect()}
    rows = some.withColumn("fold", forest.fold_of(F.col("id"), 3)).collect()
    assert len(got) == len(rows) == forest.FIT_ROWS + 700
    x = np.array([[math.nan if r[c] is None else r[c] for c in FEATURES] for r in rows])
    y, folds = np.array([math.nan if r["goals"] is None else r["goals"] for r in rows]), np.array([r["fold"] for r in rows])
    for f in range(3):
        inside = (folds != f) & ~np.isnan(y)
        fill = forest.medians(x[inside])
        b, mean, scale = forest.fit_poisson(forest.filled(x[inside], fill), y[inside], 0.1)
        want = np.exp((forest.filled(x[folds == f], fill) - mean) / scale @ b[:-1] + b[-1])
        assert [got[r["id"]] for r in rows if r["fold"] == f] == pytest.approx(want.tolist(), rel=1e-9)
    alone = forest.poisson_predict(df.limit(1), "id", FEATURES, "goals", 3).collect()
    assert len(alone) == 1 and alone[0]["prediction"] is None
    assert forest.poisson_predict(df.limit(0), "id", FEATURES, "goals", 3).count() == 0


def test_forests_of_all_rows_equal_plain_trees(spark):
    n = forest.FIT_ROWS + 300
    df = _rows(spark, n, seed=4).withColumn("y", F.when(F.col("id") != "r005", F.col("y")))
    how = forest.Growth(trees=3, depth=4, leaf=3, columns=3)
    nodes, fill, classes = forest.fit_all(df, "id", FEATURES, "y", how)
    (trees,) = forest._packed(nodes).values()
    draws = [forest.drawn(F.col("id"), F.lit(t), how.seed).alias(f"w{t}") for t in range(3)]
    rows = df.where("y is not null").select("*", *draws).collect()
    x = np.array([[math.nan if r[c] is None else r[c] for c in FEATURES] for r in rows])
    y = np.array([r["y"] for r in rows])
    assert len(rows) == n - 1 and classes == sorted(set(y)) and fill.tolist() == forest.medians(x).tolist()
    x, t = forest.filled(x, fill), (y[:, None] == np.array(classes)[None, :]).astype(float)
    w = t @ (len(y) / (len(classes) * t.sum(axis=0)))
    for i, tree in enumerate(trees):
        times = np.array([r[f"w{i}"] for r in rows])
        assert 0.9 < times.mean() < 1.1 and 0.58 < (times > 0).mean() < 0.68
        on = times > 0
        plain = forest.grow_tree(x[on], t[on], (w * times)[on], how, np.random.default_rng(0))
        assert len(plain) == len(tree) > 5 and tree[0][4] == pytest.approx((w * times).sum())
        own, other = (np.array([v[5] for v in found])[forest.descend(x[on], found)] for found in (tree, plain))
        assert own == pytest.approx(other)
    again = forest.fit_all(df.repartition(7), "id", FEATURES, "y", how)[0]
    assert sorted(map(str, again.collect())) == sorted(map(str, nodes.collect()))


def test_forests_of_all_rows_have_leaves_and_one_class(spark):
    df = spark.createDataFrame([(f"r{i}", 1.0, None, 2.0) for i in range(30)], "id string, a double, b double, y double")
    nodes, fill, classes = forest.fit_all(df, "id", ["a", "b"], "y", SMALL)
    assert classes == [2.0] and fill.tolist() == [1.0, 0.0] and nodes.count() == SMALL.trees and nodes.where("feature >= 0").count() == 0
    with pytest.raises(ValueError, match="to fit on"):
        forest.fit_all(df.limit(0), "id", ["a"], "y", SMALL)


def test_match_reports_fit_all_games(spark, sf, monkeypatch):
    asked = ("match_id", "model_home", "model_draw", "model_away")
    got = sorted(map(str, model_queries.q90_match_report(spark, sf).select(*asked).collect()))
    monkeypatch.setattr(model_queries, "FIT_ROWS", 40)  # bounds no fit of the report
    assert sorted(map(str, model_queries.q90_match_report(spark, sf).select(*asked).collect())) == got
