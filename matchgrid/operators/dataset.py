"""Match tables: odds, ratings and profiles joined by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrid.functions import market
from matchgrid.operators.profile import MATCHUPS, TEAM_FEATURES, matchups


def attach_odds(matches: DataFrame, odds: DataFrame, advantage: float = market.HOME_ADVANTAGE, margin: float = 0.0) -> DataFrame:
    """Matches with odds_home/draw/away, prob_* and odds_source.

    First the pairing as it is, then swapped (home and away columns change places), then
    odds from elo_home and elo_away. Needs tournament, home_key, away_key; ``odds`` may
    repeat a pairing, its first row by date counts. One table of odds, keyed on the
    unordered pairing, is joined once.
    """
    lo, hi = F.least("home_key", "away_key"), F.greatest("home_key", "away_key")
    swap = F.col("home_key") != lo
    names = ("home", "draw", "away")
    first = lambda c: F.min(F.when(c, F.struct(F.col("match_date").isNull().alias("x"), "match_date", *(F.col(f"odds_{k}").alias(k) for k in names))))
    one = odds.where("home_key is not null and away_key is not null").groupBy(F.col("tournament").alias("__t"), lo.alias("__lo"), hi.alias("__hi")).agg(first(~swap).alias("__n"), first(swap).alias("__s"))
    met = matches.join(one, (F.col("tournament") == F.col("__t")) & (lo == F.col("__lo")) & (hi == F.col("__hi")), "left")
    same, other = F.when(swap, F.col("__s")).otherwise(F.col("__n")), F.when(swap, F.col("__n")).otherwise(F.col("__s"))
    met = met.select(*matches.columns, same.alias("__d"), other.alias("__o"))
    p = market.outcome_probabilities(F.col("elo_home"), F.col("elo_away"), advantage)
    turned = {"home": "away", "draw": "draw", "away": "home"}
    is_d, is_s = F.col("__d").isNotNull(), F.col("__o").isNotNull()
    made = {k: F.when(is_d, F.col(f"__d.{k}")).when(is_s, F.col(f"__o.{turned[k]}")).otherwise((1 - margin) / F.greatest(p[f"p_{k}"], F.lit(0.01))) for k in names}
    out = met.select(*matches.columns, *(made[k].alias(f"odds_{k}") for k in names), F.when(is_d, "oddsportal").when(is_s, "oddsportal_swapped").otherwise("elo_fallback").alias("odds_source"))
    q = market.devig(F.col("odds_home"), F.col("odds_draw"), F.col("odds_away"))
    return out.select("*", *(q[f"p_{k}"].alias(f"prob_{k}") for k in names))


def attach_ratings(matches: DataFrame, ratings: DataFrame, confederation: str = "UEFA", home: str = "home_team", away: str = "away_team") -> DataFrame:
    """Matches with elo, rank and confederation of both sides; unknown teams have 1500, the last rank and ``confederation``."""
    known = ratings.select(F.count("*").alias("__n"))
    out = matches.crossJoin(F.broadcast(known))
    for side, col in (("home", home), ("away", away)):
        r = ratings.select(F.col("team").alias(col), F.col("elo").alias(f"__e_{side}"), F.col("rank").alias(f"__r_{side}"), F.col("confederation").alias(f"__c_{side}"))
        out = out.join(r, col, "left").withColumns({
            f"elo_{side}": F.coalesce(f"__e_{side}", F.lit(1500.0)), f"rank_{side}": F.coalesce(f"__r_{side}", F.col("__n").cast("int")),
            f"conf_{side}": F.coalesce(f"__c_{side}", F.lit(confederation)),
        })
    return out.drop("__n", *(f"__{x}_{s}" for x in "erc" for s in ("home", "away")))


def feature_table(matches: DataFrame, profiles: DataFrame, team: str = "team", home: str = "home_team", away: str = "away_team") -> DataFrame:
    """Matches of known teams with home_<f>, away_<f>, diff_<f> of every profile column, and match-ups: one select, however many columns."""
    feats = [c for c in profiles.columns if c != team]
    side = lambda p, col: profiles.select(F.col(team).alias(col), *(F.col(f).alias(f"{p}_{f}") for f in feats))
    met = matches.join(side("home", home), home).join(side("away", away), away)
    numeric = {c for c, t in profiles.dtypes if t in ("double", "float", "int", "bigint", "smallint")}
    made = [F.col(f"{p}_{f}") for p in ("home", "away") for f in feats] + [(F.col(f"home_{f}") - F.col(f"away_{f}")).alias(f"diff_{f}") for f in feats if f in numeric]
    needed = {"pos_fw_attack_score", "pos_df_defense_per90", "pos_mf_creative_per90", "team_pressures_per90", "team_carries_per90"}
    return met.select(*matches.columns, *made, *(matchups() if needed <= set(feats) else []))


def expected_columns(features: list[str] | None = None) -> list[str]:
    """The columns of a match matrix of ``features``; of all team features, with the match-ups, where none are given (188)."""
    sides = [f"{p}_{f}" for p in ("home", "away", "diff") for f in (features or TEAM_FEATURES)]
    return sides if features else [*sides, *MATCHUPS]


def verify_columns(df: DataFrame, expected: list[str]) -> dict[str, list[str]]:
    """Columns of neither side."""
    have = set(df.columns)
    return {"missing": [c for c in expected if c not in have], "extra": [c for c in df.columns if c not in set(expected)]}


def upsets(matches: DataFrame, lopsided: float = 200.0, tie: str = "home") -> DataFrame:
    """Matches with favourite, gap and three kinds of upset; needs elo_home, elo_away, result (1, 0, -1).

    upset: the favourite did not win. underdog_won: the other side did. pick_wrong: the
    Elo pick missed. ``tie``: the favourite of equal ratings.
    """
    gap = F.col("elo_home") - F.col("elo_away")
    home_fav = gap >= 0 if tie == "home" else gap > 0
    fav = F.when(home_fav, 1).otherwise(-1)
    return matches.select(
        "*", F.abs(gap).alias("elo_gap"), fav.alias("favorite"), (F.col("result") == fav).alias("favorite_win"), (F.col("result") != fav).cast("int").alias("upset"),
        (F.col("result") == -fav).cast("int").alias("underdog_won"),
        (F.col("result") != market.elo_pick(F.col("elo_home"), F.col("elo_away"))).cast("int").alias("pick_wrong"), (F.abs(gap) >= lopsided).alias("is_lopsided"),
    )


def cohort(annotated: DataFrame, least_gap: float = 0.0, upsets_only: bool = False) -> DataFrame:
    out = annotated.where(F.col("elo_gap") >= least_gap)
    return out.where("upset = 1") if upsets_only else out


def null_census(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_null, n, available): one aggregation, then one row a column."""
    cols = columns or df.columns
    row = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"x_{i}") for i, c in enumerate(cols)))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"x_{i}").alias("n_null")) for i, c in enumerate(cols))))
    return row.select("n", each.alias("s")).select("s.column", "s.n_null", "n", F.when(F.col("n") > 0, 1 - F.col("s.n_null") / F.col("n")).alias("available"))


def match_rate(rows: DataFrame, keys: list[str], matched: Column, below: float | None = None) -> DataFrame:
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(matched).alias("matched")).withColumn("rate", F.col("matched") / F.col("n"))
    return out if below is None else out.where(F.col("rate") < below)


def tier_fill(players: DataFrame, stats: list[str], pid: str, position: str, tier: str, factors: dict[int, float]) -> DataFrame:
    """Players without a row get their position's upper median times their tier's factor, cut to whole numbers; ``filled`` says which.

    A player has a row if any of ``stats`` is not null.
    """
    from matchgrid.functions.numbers import upper_median

    has = F.coalesce(*(F.col(s) for s in stats)).isNotNull()
    med = upper_median(players.where(has), [position], stats)
    med = med.select(position, *(F.col(s).alias(f"__{s}") for s in stats))
    factor = None
    for t, f in factors.items():
        factor = F.when(F.col(tier) == t, f) if factor is None else factor.when(F.col(tier) == t, f)
    met = players.join(F.broadcast(med), position, "left").withColumn("filled", ~has)
    return met.select(*(c for c in players.columns if c not in stats), *(F.when(has, F.col(s)).otherwise((F.col(f"__{s}") * factor).cast("bigint")).alias(s) for s in stats), "filled")
