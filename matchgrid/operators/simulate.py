"""Schedules: predicted matches, likely scores and group standings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrid.functions import market
from matchgrid.functions.nested import two_sides
from matchgrid.functions.numbers import half_even


def predict(matches: DataFrame, advantage: float = 0.0, total: float = 2.55) -> DataFrame:
    """``matches`` (elo_home, elo_away) with p_*, xg_*, pick and whole goals (half to even)."""
    p = market.outcome_probabilities(F.col("elo_home"), F.col("elo_away"), advantage)
    x = market.expected_goals(F.col("elo_home"), F.col("elo_away"), total, advantage)
    out = matches.withColumns(p | x)
    out = out.withColumn("pick", market.argmax_outcome(F.col("p_home"), F.col("p_draw"), F.col("p_away")))
    return out.withColumns({"pred_h": half_even(F.col("xg_home")).cast("int"), "pred_a": half_even(F.col("xg_away")).cast("int")})


def standings(results: DataFrame, group: str = "grp", home: str = "home", away: str = "away", hg: str = "hg", ag: str = "ag", outcome: str | None = None, slots: DataFrame | None = None) -> DataFrame:
    """Group tables: points, wins, draws, losses, goals, rank by (points, difference, goals, draw slot or name).

    ``outcome`` names a column of 1, 0, -1 for the points; else goals decide. ``slots``
    (group, team, slot) limits the tables to its teams.
    """
    r = F.col(outcome) if outcome else F.signum(F.col(hg) - F.col(ag)).cast("int")
    side = lambda t, f, a, res: {"team": F.col(t), "gf": F.col(f), "ga": F.col(a), "r": res}
    rows = results.select(F.col(group).alias("grp"), F.explode(two_sides(side(home, hg, ag, r), side(away, ag, hg, -r))).alias("s")).select("grp", "s.*")
    if slots is not None:
        rows = rows.join(slots.select("grp", "team", "slot"), ["grp", "team"])
    else:
        rows = rows.withColumn("slot", F.lit(0))
    n = lambda k: F.count_if(F.col("r") == k)
    table = rows.groupBy("grp", "team", "slot").agg(
        F.count("*").alias("played"), n(1).alias("won"), n(0).alias("drawn"), n(-1).alias("lost"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"),
        (3 * n(1) + n(0)).alias("points"),
    ).withColumn("gd", F.col("gf") - F.col("ga"))
    order = W.partitionBy("grp").orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), "slot", "team")
    return table.withColumn("rank", F.row_number().over(order)).drop("slot")


def with_date_heads(matches: DataFrame, date: str, order: list[str]) -> DataFrame:
    """``new_day`` marks the first match of each date in order; dates are numbered apart, so no task sees them all. A match without a date is its own."""
    first = F.row_number().over(W.partitionBy(date).orderBy(*order)) == 1
    return matches.withColumn("new_day", first | F.col(date).isNull())


def report(home_elo: float, away_elo: float, spark, neutral: bool = True, total: float = 2.65, top: int = 5) -> dict[str, DataFrame]:
    """One match: outcome probabilities, the outcome by scores and the likeliest scores."""
    adv = 0.0 if neutral else market.HOME_ADVANTAGE
    one = predict(spark.range(1).select(F.lit("m").alias("match_id"), F.lit(float(home_elo)).alias("elo_home"), F.lit(float(away_elo)).alias("elo_away")), adv, total)
    matrix = market.score_matrix(one, "xg_home", "xg_away")
    return {"match": one, "by_scores": matrix.groupBy("match_id").agg(*market.outcome_sums()), "scores": market.top_scores(matrix, ["match_id"], top).select("i", "j", "p")}


def reports(matches: DataFrame, model: DataFrame, neutral: bool = True, total: float = 2.65, top: int = 3) -> DataFrame:
    """One row a match (match_id, elo_home, elo_away) with three predictions side by side: by Elo, by its Poisson scores, and by ``model`` (match_id, p_home, p_draw, p_away).

    The ratings become rating_home and rating_away, as elo_* are probabilities like
    poisson_* and model_*; each has its pick, and the likeliest scores follow. A match
    without a model's prediction keeps the other two.
    """
    adv = 0.0 if neutral else market.HOME_ADVANTAGE
    base = predict(matches, adv, total)
    matrix = market.score_matrix(base.select("match_id", "xg_home", "xg_away"), "xg_home", "xg_away")
    scores = market.top_scores(matrix, ["match_id"], top)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "i", "j"))), lambda x: F.concat(x["i"].cast("string"), F.lit("-"), x["j"].cast("string")))
    by_scores = matrix.groupBy("match_id").agg(*market.outcome_sums())
    out = base.select("match_id", F.col("elo_home").alias("rating_home"), F.col("elo_away").alias("rating_away"))
    for name, table in (("elo", base), ("poisson", by_scores), ("model", model)):
        p = [F.col(c) for c in ("p_home", "p_draw", "p_away")]
        own = table.select("match_id", *(c.alias(f"{name}_{k}") for c, k in zip(p, ("home", "draw", "away"), strict=True)), market.argmax_outcome(*p).alias(f"{name}_pick"))
        out = out.join(own, "match_id", "left")
    return out.join(scores.groupBy("match_id").agg(listed.alias("top_scores")), "match_id", "left")
