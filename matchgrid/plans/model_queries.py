"""Queries of models: out-of-sample frames of the match matrix, upsets, rankings, retraining, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrid.functions import numbers
from matchgrid.operators import backtest, dataset, forest, models, predictions, simulate
from matchgrid.plans.base import MATCHES_SQL, matchup, r6, ratings
from matchgrid.plans.profile_queries import _MODEL_FEATURES, FIT_ROWS, _model_rows
from matchgrid.plans.team_queries import _profiles
from matchgrid.sources.stored import drop_stored, stored

_SMALL = forest.Growth(trees=20, depth=4)


def _pairings(spark, sf):
    """Every pairing's last game as a tournament match, a third of them of a knock-out."""
    last = F.max(F.struct("d", "k", "pk", "sk", "xp", "hg", "ag")).alias("g")
    m = matchup(spark, sf).groupBy("grp", "home", "away").agg(last).select("grp", F.col("home").alias("home_team"), F.col("away").alias("away_team"), "g.k", "g.hg", "g.ag")
    r = ratings(spark, sf)
    for side in ("home", "away"):
        m = m.join(r.select(F.col("team").alias(f"{side}_team"), F.col("elo").alias(f"elo_{side}")), f"{side}_team")
    ko = F.col("k") % 3 == 0
    return m.select(
        F.concat("home_team", F.lit(" vs "), "away_team").alias("match"), F.concat(F.lit("Region Cup "), F.col("grp").cast("string")).alias("tournament"),
        F.when(ko, "Final").otherwise("Group").alias("stage"), ko.alias("is_knockout"), (ko & (F.col("hg") == F.col("ag"))).alias("went_to_et"),
        F.col("hg").cast("int").alias("home_score"), F.col("ag").cast("int").alias("away_score"), F.signum(F.col("hg") - F.col("ag")).cast("int").alias("result"),
        "elo_home", "elo_away", "home_team", "away_team",
    )


def _matrix(spark, sf):
    return dataset.feature_table(_pairings(spark, sf), _profiles(spark, sf))


def q84_loo_frame(spark, sf):
    """Each pairing by a forest of 300 trees over the 188 columns that has not seen it."""
    m = _matrix(spark, sf).persist()  # the fits and the frame read it
    return predictions.frame(m, predictions.model_probabilities(m, dataset.expected_columns()))


_ELO_PART = ["match", "tournament", "short_tournament", "stage", "is_knockout", "went_to_et", "home_score", "away_score", "total_goals", "actual", "actual_label", "elo_pred", "elo_favorite"]


def q84b_frame_elo(spark, sf):
    """The frame where Elo itself is the model: every column but the forest's votes."""
    m = _pairings(spark, sf)
    from matchgrid.functions import market

    p = market.outcome_probabilities(F.col("elo_home"), F.col("elo_away"))
    own = m.withColumns(p).select("match", F.col("p_draw").alias("p_home"), F.col("p_home").alias("p_draw"), "p_away")
    own = own.withColumn("pred", market.argmax_outcome(F.col("p_home"), F.col("p_draw"), F.col("p_away"), order=(-1, 0, 1)))
    out = predictions.frame(m, own)
    exact = {*_ELO_PART, "pred", "pred_label", "correct", "agree_elo_pred", "agree_elo_favorite"}
    return out.select(*(c if c in exact else r6(c) for c in predictions.FRAME))


Q84B = f"""WITH {MATCHES_SQL}, l AS (SELECT grp, home, away, max(ROW(d, k, pk, sk, xp, hg, ag)) AS g FROM matchup GROUP BY ALL),
m AS (SELECT home || ' vs ' || away AS match, 'Region Cup ' || grp AS tournament, CAST(grp AS VARCHAR) AS short_tournament, CASE WHEN g[2] % 3 = 0 THEN 'Final' ELSE 'Group' END AS stage, g[2] % 3 = 0 AS is_knockout,
  g[2] % 3 = 0 AND g[6] = g[7] AS went_to_et, CAST(g[6] AS INTEGER) AS home_score, CAST(g[7] AS INTEGER) AS away_score, h.elo + 60.0 - a.elo AS gap FROM l JOIN rating h ON h.team = home JOIN rating a ON a.team = away),
e AS (SELECT *, 1.0 / (1.0 + pow(10.0, -gap / 400.0)) AS w, least(greatest(0.26 * (0.55 + 0.45 * exp(-abs(gap) / 150.0)), 0.08), 0.38) AS ed FROM m),
p AS (SELECT *, (1 - ed) * w AS eh, (1 - ed) * (1 - w) AS ea, CAST(sign(home_score - away_score) AS INTEGER) AS actual, CASE WHEN w > 0.45 THEN 1 WHEN w < 0.35 THEN -1 ELSE 0 END AS elo_pred FROM e),
f AS (SELECT *, CASE WHEN ea >= ed AND ea >= eh THEN -1 WHEN eh >= ed THEN 0 ELSE 1 END AS pred, CASE WHEN eh >= ed AND eh >= ea THEN 1 WHEN ed >= ea THEN 0 ELSE -1 END AS elo_favorite FROM p),
s AS (SELECT *, CASE pred WHEN 1 THEN ed WHEN 0 THEN eh ELSE ea END AS own, CASE pred WHEN 1 THEN eh WHEN 0 THEN ed ELSE ea END AS theirs, greatest(eh, ed, ea) AS mp FROM f)
SELECT match, tournament, short_tournament, stage, is_knockout, went_to_et, home_score, away_score, home_score + away_score AS total_goals, actual,
  CASE actual WHEN 1 THEN 'Home Win' WHEN 0 THEN 'Draw' ELSE 'Away Win' END AS actual_label, pred, CASE pred WHEN 1 THEN 'Home Win' WHEN 0 THEN 'Draw' ELSE 'Away Win' END AS pred_label, actual = pred AS correct,
  round(mp, 6) AS max_prob, round(mp - (eh + ed + ea - mp - least(eh, ed, ea)), 6) AS prob_margin, round(-(eh * ln(eh) + ed * ln(ed) + ea * ln(ea)) / ln(3), 6) AS norm_entropy, round(own, 6) AS pred_prob,
  round(theirs, 6) AS elo_prob_pred, round(own - theirs, 6) AS edge_vs_elo, pred = elo_pred AS agree_elo_pred, pred = elo_favorite AS agree_elo_favorite, elo_pred, elo_favorite,
  round(0.95 / greatest(theirs, 0.02), 6) AS odds_decimal, round(CASE WHEN actual = pred THEN 0.95 / greatest(theirs, 0.02) - 1 ELSE -1 END, 6) AS pnl_unit FROM s"""


def q85_upset_loo(spark, sf):
    """Upsets called from each threshold on, by forests that have not seen the match."""
    m = _matrix(spark, sf).persist()
    found = predictions.upset_frame(m, dataset.expected_columns(), least_gap=100.0)
    return backtest.upset_sweep(found)


def q86_shapley(spark, sf):
    """Features of all games by mean absolute Shapley value."""
    return forest.shapley_ranking(_model_rows(spark, sf), "id", _MODEL_FEATURES, "y", _SMALL, FIT_ROWS)


def q87_subset_search(spark, sf):
    rows = _model_rows(spark, sf).persist()
    ranked = [r["feature"] for r in forest.shapley_ranking(rows, "id", _MODEL_FEATURES, "y", _SMALL, FIT_ROWS).orderBy("place").collect()]
    return models.subset_search(rows, ranked, [1, 2, 3, 15], "id", folds=3, how=_SMALL, fit_rows=FIT_ROWS)


def q88_retrain(spark, sf):
    """Chosen columns of the matrix, and with their interactions, one pairing left out at a time."""
    m = _matrix(spark, sf).persist()
    chosen = ["diff_elo_rating", "diff_lg_goals_weighted", "diff_lg_goal_involvement_weighted", "diff_nt_xg_sum", "home_elo_rank", "away_elo_rank", "away_lg_goals_weighted"]
    chosen = [c for c in chosen if c in m.columns]
    return models.retrain(m, chosen, "match", "result", how=forest.Growth(trees=60))


def q89_poisson_loo(spark, sf):
    """Goals of each pairing by Poisson regressions that have not seen it."""
    m = _matrix(spark, sf).persist()
    home = forest.poisson_predict(m, "match", dataset.expected_columns(), "home_score", None, 1.0).withColumnRenamed("prediction", "pred_h")
    away = forest.poisson_predict(m, "match", dataset.expected_columns(), "away_score", None, 1.0).withColumnRenamed("prediction", "pred_a")
    met = m.select("match", F.col("home_score").alias("hg"), F.col("away_score").alias("ag")).join(home, "match").join(away, "match")
    limited = {c: numbers.clamp(F.col(c), 0.05, 6.0) for c in ("pred_h", "pred_a")}
    return met.withColumns(limited).agg(*backtest.goal_accuracy())


def q90_match_report(spark, sf):
    """Every pairing's report: Elo, Poisson and the forest of all games side by side."""
    m = _pairings(spark, sf)
    rows = stored(_model_rows(spark, sf).select("id", "eh", "ea", "y"), "games")
    nodes, fill, classes = forest.fit_all(rows, "id", ["eh", "ea"], "y", _SMALL)
    drop_stored(rows)
    asked = m.select("match", "elo_home", "elo_away", F.col("elo_home").alias("eh"), F.col("elo_away").alias("ea"))
    p = forest.apply(asked, "match", ["eh", "ea"], nodes, fill, classes)
    return simulate.reports(m.select(F.col("match").alias("match_id"), "elo_home", "elo_away"), p.select(F.col("match").alias("match_id"), *predictions.shares([c - 1 for c in classes], F.col("p"))))


QUERIES = {
    "q84_loo_frame": (q84_loo_frame, None), "q84b_frame_elo": (q84b_frame_elo, Q84B), "q85_upset_loo": (q85_upset_loo, None), "q86_shapley": (q86_shapley, None),
    "q87_subset_search": (q87_subset_search, None), "q88_retrain": (q88_retrain, None), "q89_poisson_loo": (q89_poisson_loo, None), "q90_match_report": (q90_match_report, None),
}
