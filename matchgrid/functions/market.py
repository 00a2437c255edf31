"""Outcome, score and market probabilities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrid.functions.numbers import clamp

HOME_ADVANTAGE = 60.0


def win_probability(home: Column, away: Column, advantage: float = HOME_ADVANTAGE) -> Column:
    """Elo expected score of the home side."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -(home + advantage - away) / 400.0))


def outcome_probabilities(home: Column, away: Column, advantage: float = HOME_ADVANTAGE) -> dict[str, Column]:
    """p_home, p_draw, p_away: the draw shrinks with the gap, the rest is shared by the expected score."""
    p = win_probability(home, away, advantage)
    draw = clamp(0.26 * (0.55 + 0.45 * F.exp(-F.abs(home + advantage - away) / 150.0)), 0.08, 0.38)
    h, a = (1 - draw) * p, (1 - draw) * (1 - p)
    total = h + draw + a
    return {"p_home": h / total, "p_draw": draw / total, "p_away": a / total}


def elo_pick(home: Column, away: Column, advantage: float = HOME_ADVANTAGE) -> Column:
    p = win_probability(home, away, advantage)
    return F.when(p > 0.45, 1).when(p < 0.35, -1).otherwise(0)


def fair_odds(p: Column, margin: float = 0.05, floor: float = 0.02) -> Column:
    """Decimal odds less a margin."""
    return (1 - margin) / F.greatest(p, F.lit(floor))


def score_odds(p: Column) -> Column:
    """Odds of an exact score, at most 250."""
    return F.least(0.88 / F.greatest(p, F.lit(1e-4)), F.lit(250.0))


def expected_goals(home: Column, away: Column, total: float = 2.55, advantage: float = HOME_ADVANTAGE) -> dict[str, Column]:
    p = win_probability(home, away, advantage)
    return {"xg_home": F.greatest(total * p, F.lit(0.15)), "xg_away": F.greatest(total * (1 - p), F.lit(0.15))}


def poisson(rate: Column, k: Column) -> Column:
    return F.exp(-rate) * F.pow(rate, k) / F.factorial(k.cast("int"))


def likeliest_goals(rate: Column, most: int = 6) -> Column:
    """The likeliest count of a Poisson rate up to ``most``; of two, the smaller."""
    return F.least(F.greatest(F.ceil(rate) - 1, F.lit(0)), F.lit(most)).cast("int")


def score_matrix(df: DataFrame, home: str, away: str, most: int = 8, normalised: bool = True) -> DataFrame:
    """``df`` with a row for each score (i, j) up to ``most`` goals and its probability p, i the home goals."""
    each = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("j"))
    p = poisson(F.col(home), F.col("i")) * poisson(F.col(away), F.col("j"))
    if normalised:
        # the matrix is a product, so its sum is the product of two short sums
        side = lambda c: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: poisson(F.col(c), k)), F.lit(0.0), lambda a, x: a + x)
        p = p / (side(home) * side(away))
    return each.withColumn("p", p)


def outcome_sums() -> list[Column]:
    """Of a score matrix: p_home, p_draw, p_away (home wins where i > j)."""
    part = lambda c: F.sum(F.when(c, F.col("p")).otherwise(0.0))
    return [part(F.col("i") > F.col("j")).alias("p_home"), part(F.col("i") == F.col("j")).alias("p_draw"), part(F.col("i") < F.col("j")).alias("p_away")]


def over_under(line: float) -> list[Column]:
    """Of a score matrix: p_over, p_under of a goal line without the push; one half each where nothing else is left."""
    goals = F.col("i") + F.col("j")
    over = F.sum(F.when(goals > line, F.col("p")).otherwise(0.0))
    under = F.sum(F.when(goals < line, F.col("p")).otherwise(0.0))
    share = lambda x: F.when(over + under > 0, x / (over + under)).otherwise(0.5)
    return [share(over).alias("p_over"), share(under).alias("p_under")]


def top_scores(matrix: DataFrame, keys: list[str], k: int, larger_first: bool = True) -> DataFrame:
    """The k likeliest scores of each key; ties by the larger (i, j), or by the smaller."""
    tie = [F.desc("i"), F.desc("j")] if larger_first else [F.asc("i"), F.asc("j")]
    w = W.partitionBy(*keys).orderBy(F.desc("p"), *tie)
    return matrix.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def devig(home: Column, draw: Column, away: Column) -> dict[str, Column]:
    """Probabilities from decimal odds, the margin shared out; odds count 1.01 at least."""
    inv = [1 / F.greatest(x, F.lit(1.01)) for x in (home, draw, away)]
    total = inv[0] + inv[1] + inv[2]
    return dict(zip(("p_home", "p_draw", "p_away"), (x / total for x in inv), strict=True))


def blend(model: tuple[Column, ...], market: tuple[Column, ...], alpha: Column) -> list[Column]:
    mixed = [alpha * m + (1 - alpha) * k for m, k in zip(model, market, strict=True)]
    total = mixed[0] + mixed[1] + mixed[2]
    return [x / total for x in mixed]


def profit(won: Column, odds: Column) -> Column:
    """Of a unit stake."""
    return F.when(won, odds - 1).otherwise(F.lit(-1.0))


def argmax_outcome(home: Column, draw: Column, away: Column, order: tuple[int, ...] = (1, 0, -1)) -> Column:
    """The likeliest outcome; ties go to the first in ``order``."""
    p = {1: home, 0: draw, -1: away}
    best = F.greatest(home, draw, away)
    out = F.when(p[order[0]] >= best, order[0])
    for o in order[1:]:
        out = out.when(p[o] >= best, o)
    return out
