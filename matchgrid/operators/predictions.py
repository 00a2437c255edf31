"""Out-of-sample predictions of a match matrix: the frame that every backtest of a model starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrid.functions import market, numbers
from matchgrid.operators import dataset, forest

# Outcomes as reports name them, and the book's margin (fixed values).
LABELS = {1: "Home Win", 0: "Draw", -1: "Away Win"}
MARGIN = 0.05
#: Columns of a prediction frame, in order.
FRAME = (
    "match", "tournament", "short_tournament", "stage", "is_knockout", "went_to_et", "home_score", "away_score", "total_goals", "actual", "actual_label", "pred", "pred_label",
    "correct", "max_prob", "prob_margin", "norm_entropy", "pred_prob", "elo_prob_pred", "edge_vs_elo", "agree_elo_pred", "agree_elo_favorite", "elo_pred", "elo_favorite",
    "odds_decimal", "pnl_unit",
)
#: Upsets among lopsided matches: shallower trees with smaller leaves.
UPSET_GROWTH = forest.Growth(depth=5, leaf=3)


def label_of(outcome: Column) -> Column:
    return F.when(outcome == 1, LABELS[1]).when(outcome == 0, LABELS[0]).when(outcome == -1, LABELS[-1])


def _of_outcome(outcome: Column, home: Column, draw: Column, away: Column) -> Column:
    return F.when(outcome == 1, home).when(outcome == 0, draw).otherwise(away)


def shares(classes: list[float], p: Column) -> list[Column]:
    """p_home, p_draw and p_away of an array by ascending class; 0 for an outcome that no row had."""
    at = {c: i for i, c in enumerate(classes)}
    return [(F.get(p, at[o]) if o in at else F.lit(0.0)).alias(n) for o, n in ((1.0, "p_home"), (0.0, "p_draw"), (-1.0, "p_away"))]


def model_probabilities(matches: DataFrame, features: list[str], key: str = "match", label: str = "result", folds: int | None = None, how: forest.Growth = forest.Growth(), fit_rows: int = forest.FIT_ROWS) -> DataFrame:
    """(key, pred, p_home, p_draw, p_away) by forests that have not seen the match: one left out at a time, or by folds."""
    classes = sorted(float(r[0]) for r in matches.where(F.col(label).isNotNull()).select(label).distinct().collect())
    found = forest.leave_one_out(matches, key, features, label, how, fit_rows) if folds is None else forest.cross_predict(matches, key, features, label, folds, how, fit_rows)
    return found.select(key, F.col("prediction").cast("int").alias("pred"), *shares(classes, F.col("p")))


def frame(matches: DataFrame, predicted: DataFrame) -> DataFrame:
    """The prediction frame, columns as ``FRAME``.

    ``matches``: match, tournament, stage, is_knockout, went_to_et, home_score, away_score,
    result, elo_home, elo_away (1500 where unknown). ``predicted``: match, pred, p_home,
    p_draw, p_away. Settled against odds that Elo implies. Of equal probabilities the lower
    outcome is the model's favourite, the home side Elo's.
    """
    elo = [F.coalesce(f"elo_{s}", F.lit(1500.0)) for s in ("home", "away")]
    q = market.outcome_probabilities(*elo)
    met = matches.join(predicted, "match")
    met = met.withColumns({"__h": q["p_home"], "__d": q["p_draw"], "__a": q["p_away"]})
    p, e = [F.col(c) for c in ("p_home", "p_draw", "p_away")], [F.col(c) for c in ("__h", "__d", "__a")]
    actual, pred = F.col("result").cast("int"), F.col("pred")
    own, theirs = _of_outcome(pred, *p), _of_outcome(pred, *e)
    odds = market.fair_odds(theirs, MARGIN)
    elo_pred, favorite = market.elo_pick(*elo).cast("int"), market.argmax_outcome(*e)
    made = {
        "short_tournament": F.element_at(F.split("tournament", " "), -1), "total_goals": F.col("home_score") + F.col("away_score"), "actual": actual, "actual_label": label_of(actual),
        "pred_label": label_of(pred), "correct": actual == pred, "max_prob": F.greatest(*p), "prob_margin": numbers.top_margin(*p), "norm_entropy": numbers.entropy(*p), "pred_prob": own,
        "elo_prob_pred": theirs, "edge_vs_elo": own - theirs, "agree_elo_pred": pred == elo_pred, "agree_elo_favorite": market.argmax_outcome(*p, order=(-1, 0, 1)) == favorite,
        "elo_pred": elo_pred, "elo_favorite": favorite.cast("int"), "odds_decimal": odds, "pnl_unit": market.profit(actual == pred, odds),
    }
    return met.select(*((made[c] if c in made else F.col(c)).alias(c) for c in FRAME))


def upset_frame(matches: DataFrame, features: list[str], key: str = "match", least_gap: float = 200.0, folds: int | None = None, how: forest.Growth = UPSET_GROWTH, fit_rows: int = forest.FIT_ROWS) -> DataFrame:
    """The lopsided ``matches`` (elo_home, elo_away, result) as ``dataset.upsets`` marks them, with p_upset of forests that have not seen the match.

    Where all matches of the cohort, or none, are upsets, p_upset is that share.
    """
    marked = dataset.cohort(dataset.upsets(matches), least_gap)
    labels = sorted(r[0] for r in marked.where("upset is not null").select("upset").distinct().collect())
    if len(labels) < 2:
        return marked.withColumn("p_upset", F.lit(float(labels[0]) if labels else None))
    found = forest.leave_one_out(marked, key, features, "upset", how, fit_rows) if folds is None else forest.cross_predict(marked, key, features, "upset", folds, how, fit_rows)
    return marked.join(found.select(key, F.get("p", 1).alias("p_upset")), key)
