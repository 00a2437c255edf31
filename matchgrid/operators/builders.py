"""Composite tables: league profiles, squads, tournament and club data sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrid.functions import dates
from matchgrid.operators import dataset, profile, ratings, resolve


def merge_stat_tables(standard: DataFrame, others: list[DataFrame], keys: tuple[str, ...] = ("player", "team"), wanted: list[str] | None = None) -> DataFrame:
    """A base table with the columns others add, by player and team, so namesakes and transfers do not multiply rows.

    A key that another table repeats counts once, its first row by value order.
    """
    out = standard
    for o in others:
        new = [c for c in o.columns if c not in out.columns]
        first = W.partitionBy(*keys).orderBy(*new)
        one = o.withColumn("__r", F.row_number().over(first)).where("__r = 1").select(*keys, *new)
        out = out.join(one, list(keys), "left")
    return out if wanted is None else out.select(*keys, *(c for c in wanted if c in out.columns))


def arrival_starters(players: DataFrame, team: str, order: str, first: int = 11, full: int = 90, rest: int = 30) -> DataFrame:
    """The first players of a team in order start and play ``full`` minutes, the others ``rest``.

    ``order`` is total. The last starter's place is found first, from ``first`` rows a team
    and partition, and joined back, so no team is one task.
    """
    best = players.select(team, order).withColumn("__r", F.row_number().over(W.partitionBy(team).orderBy(order))).where(F.col("__r") <= first)
    last = best.groupBy(F.col(team).alias("__t")).agg(F.max(order).alias("__last"))
    met = players.join(last, players[team].eqNullSafe(F.col("__t")), "left")
    out = met.select(*players.columns, F.coalesce(F.col(order) <= F.col("__last"), F.lit(False)).cast("int").alias("is_starter"))
    return out.withColumn("minutes", F.when(F.col("is_starter") == 1, full).otherwise(rest))


def league_profile(stats: DataFrame, weights: DataFrame, team: str = "team", season: str = "season") -> DataFrame:
    """One row a team from its players' league seasons: recency-weighted goals, assists and minutes, trend, spread, latest season, best season.

    Seasons outside ``weights(season, weight)`` count for the number of seasons and the
    best season only. Team numbers without any weighted season are null.
    """
    fields = ["goals", "assists", "minutes_played"]
    totals = profile.season_totals(stats, [team], season, fields)
    weighted = profile.recency_weighted(totals, weights, [team], season, fields)
    inside = totals.join(weights.select(F.col("season").alias(season)), season, "left_semi")
    moves = profile.trend_and_spread(inside, [team], season, "goals").drop("seasons", "latest")
    every = totals.groupBy(team).agg(F.count("*").alias("lg_seasons_available"), F.max("goals").alias("lg_goals_max"))
    last = inside.groupBy(team).agg(F.max_by(F.struct("goals", "minutes_played", "players"), season).alias("l"))
    last = last.select(team, F.col("l.players").alias("lg_latest_players"), F.when(F.col("l.minutes_played") > 0, F.col("l.goals") * 90 / F.col("l.minutes_played")).alias("lg_latest_goals_p90"))
    out = every.join(weighted, team, "left").join(moves, team, "left").join(last, team, "left")
    return out.withColumnsRenamed({"trend": "lg_goals_trend", "variation": "lg_goals_cv"})


def confederation_flags(confederation: Column, classes: tuple[str, ...] = ("UEFA", "CONMEBOL", "CONCACAF", "CAF", "AFC")) -> list[Column]:
    """0/1 columns; others are all 0."""
    from matchgrid.functions.numbers import one_hot

    return one_hot(confederation, list(classes), "conf_")


def tournament_matrix(teams: DataFrame, rating: DataFrame, parts: list[DataFrame], team: str = "team") -> DataFrame:
    """One row a team of a tournament: rating, rank and confederation flags, then each profile part; later parts take over columns of earlier ones where they have a value."""
    r = rating.select(F.col("team").alias(team), "elo", "rank", "confederation")
    out = teams.select(team).distinct().join(r, team, "left")
    out = out.withColumn("elo", F.coalesce("elo", F.lit(ratings.START))).select("*", *confederation_flags(F.coalesce("confederation", F.lit("OTHER"))))
    for p in parts:
        same = [c for c in p.columns if c != team and c in out.columns]
        met = out.join(p.select(F.col(team), *(F.col(c).alias(f"__n_{c}") if c in same else F.col(c) for c in p.columns if c != team)), team, "left")
        out = met.withColumns({c: F.coalesce(f"__n_{c}", c) for c in same}).drop(*(f"__n_{c}" for c in same))
    return out


def tournament_from_line_ups(line_ups: DataFrame, roster: DataFrame, rating: DataFrame, stats: DataFrame, weights: DataFrame) -> DataFrame:
    """The team matrix of a tournament whose teams are known by their line-ups alone.

    ``line_ups(player_name, team, seq)`` are resolved against ``roster(name, entity_id, pos)``;
    ``stats(pid, season, goals, assists, minutes_played)`` count for the team that an id was
    last listed under. Teams that list players none of whom is known have a row too.
    """
    of = resolve.ids_to_teams(line_ups, roster)
    mine = stats.join(of.withColumnRenamed("entity_id", "pid"), "pid")
    return tournament_matrix(resolve.line_up_teams(line_ups).select("team"), rating, [league_profile(mine, weights)])


def tournaments(frames: dict[str, DataFrame]) -> DataFrame:
    """Matches of several tournaments by name of column, ``tournament`` added."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("tournament", F.lit(t)) for t, f in frames.items()])


def squads_by_season(stats: DataFrame, weights_of: int = 3) -> DataFrame:
    """(team, latest, season, weight): the seasons that make a team's profile before its season ``latest``."""
    latest = stats.select("team", F.col("season").alias("latest")).distinct()
    return latest.select("team", "latest", F.inline(dates.season_weights(F.col("latest"), dates.RECENCY[-weights_of:])))


def club_dataset(matches: DataFrame, profiles: DataFrame, league: str = "league", ranked_in: str | None = None) -> DataFrame:
    """Club matches with ratings and ranks before each, and both sides' profile of the season before.

    ``matches`` as ``sources.readers.club_matches`` gives them; ``profiles(team, season, ...)``.
    The order of matches is date, league, home, away. A rank is among all clubs then seen,
    which only all matches in order can tell: they pass through one task, as a stream.
    ``ranked_in`` names a column, such as the league, whose clubs meet and are ranked by
    themselves; its values are folded side by side.
    """
    m = matches.where("date is not null").withColumn("previous", dates.previous_season(F.col("season_code")))
    order = ["date", league, "home_team", "away_team"]
    sides = ("home_team", "away_team", "home_score", "away_score")
    if ranked_in is None:
        folded = ratings.elo_fold(m.withColumn("__all", F.lit(0)), "__all", order, *sides, ranks=True).drop("__all")
    else:
        folded = ratings.elo_fold(m, ranked_in, order, *sides, ranks=True)
    feats = [c for c in profiles.columns if c not in ("team", "season")]
    side = lambda p: profiles.select(F.col("team").alias(f"{p}_team"), F.col("season").alias("previous"), *(F.col(c).alias(f"{p}_{c}") for c in feats))
    met = folded.join(side("home"), ["home_team", "previous"], "left").join(side("away"), ["away_team", "previous"], "left")
    numeric = [c for c, t in profiles.dtypes if c in feats and t in ("double", "int", "bigint")]
    gaps = [(F.col(f"{c}_home") - F.col(f"{c}_away")).alias(f"diff_{c}") for c in ("elo", "rank")]
    return met.select("*", *((F.col(f"home_{c}") - F.col(f"away_{c}")).alias(f"diff_{c}") for c in numeric), *gaps)


def gap_report(matched: DataFrame, keys: list[str], flag: str, below: float = 0.4) -> DataFrame:
    return dataset.match_rate(matched, keys, F.col(flag), below).orderBy("rate", *keys)
