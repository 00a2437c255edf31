"""Players to team profiles: long player rows, one wide row a team.

Team numbers that are undefined are null; counts that are missing are 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_MINUTES = 90
# Fields whose minutes-weighted team means make the squad's profile (fixed values).
WEIGHTED = [
    "xg", "goals", "shots", "shots_on_target", "key_passes", "through_balls", "crosses", "progressive_passes", "dribble_attempts", "dribble_success",
    "carries_count", "progressive_carry_distance", "interceptions", "blocks", "clearances", "pressures", "counter_pressures", "tackle_attempts",
    "tackles_won", "goalkeeper_saves",
]
BUCKETS = ("GK", "DF", "MF", "FW")
# Confederations with a column of their own (fixed values).
CONFEDERATIONS = ("UEFA", "CONMEBOL", "CONCACAF", "CAF", "AFC")
#: Share of dribbles in a forward line's attack score (fixed value).
DRIBBLES = 0.15


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def with_squad(players: DataFrame, team: str = "team", minutes: str = "minutes", least: int = MIN_MINUTES) -> DataFrame:
    """Players with enough minutes; all of a team where none has. One flag a team is added up and joined back, so no team is one task."""
    enough = zero(minutes) >= least
    any_ok = players.groupBy(F.col(team).alias("__t")).agg(F.max(enough).alias("__any"))
    met = players.join(any_ok, F.col(team).eqNullSafe(F.col("__t")))
    return met.where(enough | ~F.col("__any")).select(*players.columns)


def weighted_means(fields: list[str], minutes: str = "minutes", prefix: str = "nt_w_") -> list[Column]:
    """Minutes-weighted means; a weight sum of 0 counts as 1."""
    total = F.sum(zero(minutes))
    return [(F.sum(zero(f) * zero(minutes)) / F.when(total == 0, 1).otherwise(total)).alias(f"{prefix}{f}") for f in fields]


def top_k(df: DataFrame, keys: list[str], value: str, k: int, name: str) -> DataFrame:
    """(keys, sum of the k largest values); the limit is applied before the shuffle too."""
    best = W.partitionBy(*keys).orderBy(F.desc_nulls_last(value))
    return df.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k).groupBy(*keys).agg(F.sum(value).alias(name))


def bottom_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The k first rows of each key by a total ``order``, as ``place`` 1 to k."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def share_of_max(value: Column) -> Column:
    total = F.sum(value)
    return F.when(total > 0, F.max(value) / total).otherwise(F.lit(0.0))


def gini(df: DataFrame, keys: list[str], value: str, name: str = "gini") -> DataFrame:
    """(keys, Gini coefficient); 0 where the sum is not positive. Equal values are counted before they are ranked."""
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    w = W.partitionBy(*keys)
    below = F.coalesce(F.sum("__c").over(w.orderBy("__v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = each.withColumn("__n", F.sum("__c").over(w)).withColumn("__b", below)
    c, total, n = F.col("__c"), F.sum(F.col("__c") * F.col("__v")), F.max("__n")
    # a value at ranks b + 1 to b + c: each counts as often as cumulative sums hold it
    held = F.sum(F.col("__v") * (c * (F.col("__n") + 1 - F.col("__b")) - c * (c + 1) / 2))
    g = F.when(total > 0, (n + 1 - 2 * held / total) / n).otherwise(F.lit(0.0))
    return ranked.groupBy(*keys).agg(g.alias(name))


def bucket_rates(position: str, minutes: str, pairs: list[tuple[str, str]]) -> list[Column]:
    """Per-90 of a field in a position bucket, for (bucket, field); 0 without minutes."""
    made = []
    for bucket, field in pairs:
        here = F.col(position) == bucket
        m = F.sum(F.when(here, zero(minutes)).otherwise(0))
        made.append(F.when(m > 0, F.sum(F.when(here, zero(field)).otherwise(0)) * 90 / m).otherwise(0.0).alias(f"pos_{bucket.lower()}_{field}_p90"))
    return made


def club_chemistry(players: DataFrame, team: str = "team", club: str = "current_club") -> DataFrame:
    """(team, cluster_ratio, pair_density, n_clubs): of the whole squad, blank clubs included in its size; null without clubs or below two players."""
    known = (F.col(club).isNotNull()) & (F.trim(club) != "")
    per_club = players.groupBy(team, F.when(known, F.col(club)).alias("c")).agg(F.count("*").alias("k"))
    inside = F.when(F.col("c").isNotNull(), F.col("k"))
    out = per_club.groupBy(team).agg(F.sum("k").alias("n"), F.max(inside).alias("top"), F.sum(inside * (inside - 1) / 2).alias("pairs"), F.count(inside).alias("clubs"))
    ok = (F.col("n") >= 2) & (F.col("clubs") > 0)
    return out.select(
        team, F.when(ok, F.col("top") / F.col("n")).alias("cluster_ratio"), F.when(ok, F.col("pairs") / (F.col("n") * (F.col("n") - 1) / 2)).alias("pair_density"),
        F.when(ok, F.col("clubs")).alias("n_clubs"),
    )


def roll_up(stats: DataFrame, keys: list[str], sums: list[str], flags: list[str] = ()) -> DataFrame:
    """Players over competitions: sums with nulls as 0, the largest of flags."""
    return stats.groupBy(*keys).agg(*(F.sum(zero(c)).alias(c) for c in sums), *(F.max(zero(c)).alias(c) for c in flags))


def _per90_of(position: str, fields: list[str]) -> Column:
    """Summed fields of a position's players per 90 of its minutes; 0 without minutes."""
    here = F.col("position") == position
    minutes = F.sum(F.when(here, zero("minutes")).otherwise(0))
    total = F.sum(F.when(here, reduce(lambda x, y: x + y, map(zero, fields))).otherwise(0))
    return F.when(minutes > 0, total * 90 / minutes).otherwise(0.0)


def squad_features(players: DataFrame, team: str = "team") -> DataFrame:
    """One row a team: weighted means, star, depth, position, style and club-familiarity numbers of its squad.

    Needs position, minutes, is_starter, current_club and the ``WEIGHTED`` fields; the squad
    is ``with_squad``. Nulls count 0; familiarity is null without clubs or below two players.
    """
    squad = with_squad(players, team)
    fw_xg, fw_dribbles = _per90_of("FW", ["xg"]), _per90_of("FW", ["dribble_success"])
    minutes = F.sum(zero("minutes"))
    whole = lambda f: F.sum(zero(f)) * 90 / F.when(minutes == 0, 1).otherwise(minutes)
    goals = zero("goals").cast("double")
    main = squad.groupBy(team).agg(
        *weighted_means(WEIGHTED),
        share_of_max(goals).alias("star_top_scorer_share"),
        F.max(zero("dribble_success")).cast("double").alias("star_max_dribbles"),
        F.count_if(zero("is_starter") != 0).alias("squad_starters"),
        F.count("*").alias("squad_depth"),
        fw_xg.alias("pos_fw_xg_per90"),
        fw_dribbles.alias("pos_fw_dribbles_per90"),
        (fw_xg + DRIBBLES * fw_dribbles).alias("pos_fw_attack_score"),
        _per90_of("DF", ["tackles_won", "interceptions", "blocks"]).alias("pos_df_defense_per90"),
        _per90_of("MF", ["key_passes", "progressive_passes"]).alias("pos_mf_creative_per90"),
        _per90_of("MF", ["carries_count"]).alias("pos_mf_carries_per90"),
        F.sum(F.when(F.col("position") == "GK", zero("goalkeeper_saves")).otherwise(0)).alias("pos_gk_saves"),
        whole("pressures").alias("team_pressures_per90"),
        whole("carries_count").alias("team_carries_per90"),
    )
    x = squad.select(team, zero("xg").cast("double").alias("v"))
    clubs = club_chemistry(squad, team).withColumnsRenamed({"cluster_ratio": "club_max_cluster_ratio", "pair_density": "club_pair_density", "n_clubs": "club_distinct_clubs"})
    return main.join(top_k(x, [team], "v", 3, "star_top3_xg"), team, "left").join(gini(x, [team], "v", "star_xg_gini"), team, "left").join(clubs, team, "left")


# Names of the team features, by group (fixed values).
FEATURES = {
    "rating": ["elo_rating", "elo_rank", *(f"conf_{c}" for c in CONFEDERATIONS)],
    "league": [
        "lg_goals_weighted", "lg_assists_weighted", "lg_minutes_weighted", "lg_goal_involvement_weighted", "lg_player_count", "lg_seasons_available",
        "lg_goals_per90", "lg_goals_max", "lg_goal_trend", "lg_consistency",
    ],
    "composition": ["pos_fw_ratio", "pos_mf_ratio", "pos_df_ratio", "pos_fw_goals", "pos_mf_goals"],
    "national": ["nt_competitions_count", *(f"nt_w_{f}" for f in WEIGHTED)],
    "stars and depth": ["star_top3_xg", "star_top_scorer_share", "star_xg_gini", "star_max_dribbles", "squad_starters", "squad_depth"],
    "positions": ["pos_fw_xg_per90", "pos_fw_dribbles_per90", "pos_fw_attack_score", "pos_df_defense_per90", "pos_mf_creative_per90", "pos_mf_carries_per90", "pos_gk_saves"],
    "style": ["team_pressures_per90", "team_carries_per90"],
    "clubs": ["club_max_cluster_ratio", "club_pair_density", "club_distinct_clubs"],
}
# Columns of the match-ups (fixed values).
MATCHUPS = ["matchup_home_fw_vs_away_df", "matchup_away_fw_vs_home_df", "matchup_mf_creative_diff", "matchup_press_vs_carry", "matchup_carry_vs_press"]
TEAM_FEATURES = [f for group in FEATURES.values() for f in group]


def rating_features(rating: DataFrame, team: str = "team") -> DataFrame:
    """elo_rating, elo_rank and confederation flags of ``rating(team, elo, rank, confederation)``."""
    flags = [F.coalesce((F.col("confederation") == c).cast("double"), F.lit(0.0)).alias(f"conf_{c}") for c in CONFEDERATIONS]
    return rating.select(F.col("team").alias(team), F.col("elo").cast("double").alias("elo_rating"), F.col("rank").cast("double").alias("elo_rank"), *flags)


def league_features(stats: DataFrame, weights: DataFrame, latest: Column, team: str = "team") -> DataFrame:
    """One row a team of ``stats(team, season, goals, assists, minutes_played)``, a row a player and season.

    Sums over ``weights(season, weight)`` are weighted by recency; trend and consistency are
    those of goals a player from season to season (0, and null, below two seasons); count
    and rate are of the season ``latest``; the number of seasons and the best player season
    are of all rows.
    """
    fields = ["goals", "assists", "minutes_played"]
    totals = season_totals(stats, [team], "season", fields).withColumn("rate", F.col("goals") / F.col("players"))
    weighted = recency_weighted(totals, weights, [team], "season", fields)
    weighted = weighted.select(
        team, F.col("lg_goals").alias("lg_goals_weighted"), F.col("lg_assists").alias("lg_assists_weighted"), F.col("lg_minutes_played").alias("lg_minutes_weighted"),
        (F.col("lg_goals") + F.col("lg_assists")).alias("lg_goal_involvement_weighted"),
    )
    inside = totals.join(weights.select("season"), "season", "left_semi")
    moves = trend_and_spread(inside, [team], "season", "rate").select(team, F.col("trend").alias("lg_goal_trend"), F.col("variation").alias("lg_consistency"))
    now = F.col("season") == latest
    of_now = lambda c: F.sum(F.when(now, F.col(c)))
    every = totals.groupBy(team).agg(
        of_now("players").cast("double").alias("lg_player_count"), F.count("*").cast("double").alias("lg_seasons_available"),
        F.when(of_now("minutes_played") > 0, of_now("goals") / of_now("minutes_played") * 90).alias("lg_goals_per90"),
    )
    best = stats.groupBy(team).agg(F.max(zero("goals")).cast("double").alias("lg_goals_max"))
    out = every.join(best, team).join(weighted, team, "left").join(moves, team, "left")
    return out.select(team, *FEATURES["league"][:8], F.coalesce("lg_goal_trend", F.lit(0.0)).alias("lg_goal_trend"), "lg_consistency")


def composition_features(players: DataFrame, stats: DataFrame, latest: Column, team: str = "team", pid: str = "pid") -> DataFrame:
    """Shares of positions among a squad's outfield, and goals by position in the season ``latest``; null for teams without rows in it."""
    now = stats.where(F.col("season") == latest).groupBy(team, pid).agg(F.sum(zero("goals")).alias("goals"))
    met = players.select(team, pid, "position").join(now, [team, pid], "left")
    out = composition(met, team).join(now.select(team).distinct().withColumn("__has", F.lit(True)), team, "left")
    names = {"comp_fw_ratio": "pos_fw_ratio", "comp_mf_ratio": "pos_mf_ratio", "comp_df_ratio": "pos_df_ratio", "comp_fw_goals": "pos_fw_goals", "comp_mf_goals": "pos_mf_goals"}
    return out.select(team, *(F.when(F.col("__has"), F.col(c).cast("double")).alias(n) for c, n in names.items()))


def team_profile(
    teams: DataFrame, rating: DataFrame, players: DataFrame, stats: DataFrame | None = None, weights: DataFrame | None = None, latest: Column | None = None,
    competitions: int = 0, same_club: bool = False, team: str = "team",
) -> DataFrame:
    """One row for each of ``teams`` with its ``TEAM_FEATURES``.

    ``players``: a row a player of the squad with the fields of ``squad_features``, from
    national matches (``roll_up``) or from league rows (``proxy_events``). ``same_club``:
    all of them play for the team itself. Unrated teams have 1500 and the last rank; numbers
    without rows are null.
    """
    last = rating.agg(F.count("*").cast("double").alias("__n"))
    out = teams.select(team).distinct().join(rating_features(rating, team), team, "left").crossJoin(F.broadcast(last))
    out = out.withColumns({"elo_rating": F.coalesce("elo_rating", F.lit(1500.0)), "elo_rank": F.coalesce("elo_rank", "__n")})
    # an unknown team counts as of the first confederation
    out = out.withColumns({f"conf_{c}": F.coalesce(f"conf_{c}", F.lit(float(c == CONFEDERATIONS[0]))) for c in CONFEDERATIONS})
    if stats is not None:
        out = out.join(league_features(stats, weights, latest, team), team, "left").join(composition_features(players, stats, latest, team), team, "left")
    squad = squad_features(players, team)
    if same_club:
        one = {"club_max_cluster_ratio": F.lit(1.0), "club_pair_density": F.when(F.col("__k") >= 2, 1.0).otherwise(0.0), "club_distinct_clubs": F.lit(1)}
        squad = squad.join(players.groupBy(team).agg(F.count("*").alias("__k")), team).withColumns(one)
    out = out.join(squad, team, "left").withColumn("nt_competitions_count", F.lit(float(competitions)))
    have = set(out.columns)
    return out.select(team, *((F.col(f) if f in have else F.lit(None)).cast("double").alias(f) for f in TEAM_FEATURES))


def season_totals(stats: DataFrame, keys: list[str], season: str, fields: list[str]) -> DataFrame:
    return stats.groupBy(*keys, season).agg(*(F.sum(zero(f)).alias(f) for f in fields), F.count("*").alias("players"))


def recency_weighted(totals: DataFrame, weights: DataFrame, keys: list[str], season: str, fields: list[str]) -> DataFrame:
    """Weighted means of season totals over seasons with players; ``weights(season, weight)`` is a small table."""
    met = totals.join(weights.select(F.col("season").alias("__s"), F.col("weight").alias("__w")), F.col(season) == F.col("__s"))
    return met.groupBy(*keys).agg(*((F.sum(F.col(f) * F.col("__w")) / F.sum("__w")).alias(f"lg_{f}") for f in fields))


def trend_and_spread(totals: DataFrame, keys: list[str], season: str, value: str) -> DataFrame:
    """(trend, variation, seasons, latest): slope over the season's index (0 below two seasons or without variance), population deviation over mean (null below two, 0 where the mean is not positive)."""
    w = W.partitionBy(*keys)
    rows = totals.withColumn("__i", F.row_number().over(w.orderBy(season)) - 1)
    n, mean = F.count(value), F.avg(value)
    slope = F.coalesce(F.regr_slope(F.col(value), F.col("__i")), F.lit(0.0))
    cv = F.when(n < 2, None).when(mean <= 0, 0.0).otherwise(F.stddev_pop(value) / mean)
    return rows.groupBy(*keys).agg(F.when(n < 2, 0.0).otherwise(slope).alias("trend"), cv.alias("variation"), n.alias("seasons"), F.max_by(value, season).alias("latest"))


def composition(players: DataFrame, team: str = "team", position: str = "position") -> DataFrame:
    """Shares of forwards, midfielders and defenders among the outfield, and goals by position."""
    count = lambda p: F.count_if(F.col(position) == p)
    outfield = F.count_if(F.col(position).isin(*BUCKETS[1:]))
    share = lambda p: F.when(outfield > 0, count(p) / outfield)
    made = [share(p).alias(f"comp_{p.lower()}_ratio") for p in ("FW", "MF", "DF")]
    if "goals" in players.columns:
        made += [F.sum(F.when(F.col(position) == p, zero("goals")).otherwise(0)).alias(f"comp_{p.lower()}_goals") for p in ("FW", "MF")]
    return players.groupBy(team).agg(*made)


def latest_season(stats: DataFrame, pid: str, season: str, latest: Column) -> DataFrame:
    """One row a player: the latest season if there, else the most recent."""
    w = W.partitionBy(pid).orderBy((F.col(season) == latest).desc_nulls_last(), F.col(season).desc_nulls_last(), *(F.col(c) for c in stats.columns if c not in (pid, season)))
    return stats.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def squad_season(stats: DataFrame, team: str, season: str, order: list[str]) -> DataFrame:
    """Rows of the first season in ``order`` that a team has rows for."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(season))
    rows = stats.where(place > 0).withColumn("__p", place)
    best = rows.groupBy(F.col(team).alias("__t")).agg(F.min("__p").alias("__b"))  # one row a team is joined; no task holds a team's rows
    return rows.join(best, F.col(team).eqNullSafe(F.col("__t")) & (F.col("__p") == F.col("__b"))).drop("__p", "__b", "__t")


# Per-90 baselines by position, quality references and factors of the proxies (fixed values).
BASELINES = {
    "GK": {
        "shots": 0.00, "shots_on_target": 0.00, "key_passes": 0.04, "through_balls": 0.00, "crosses": 0.00, "progressive_passes": 0.10, "dribble_attempts": 0.02,
        "dribble_success": 0.01, "carries_count": 1.0, "progressive_carry_distance": 5.0, "blocks": 0.05, "clearances": 0.50, "pressures": 0.30,
        "counter_pressures": 0.05, "tackle_attempts": 0.06, "goalkeeper_saves": 2.5,
    },
    "DF": {
        "shots": 0.50, "shots_on_target": 0.18, "key_passes": 0.35, "through_balls": 0.02, "crosses": 0.30, "progressive_passes": 2.0, "dribble_attempts": 0.40,
        "dribble_success": 0.25, "carries_count": 3.0, "progressive_carry_distance": 30.0, "blocks": 0.70, "clearances": 2.5, "pressures": 4.0,
        "counter_pressures": 0.50, "tackle_attempts": 1.80, "goalkeeper_saves": 0.0,
    },
    "MF": {
        "shots": 1.20, "shots_on_target": 0.45, "key_passes": 1.0, "through_balls": 0.10, "crosses": 0.50, "progressive_passes": 3.5, "dribble_attempts": 1.5,
        "dribble_success": 0.90, "carries_count": 5.0, "progressive_carry_distance": 60.0, "blocks": 0.50, "clearances": 0.80, "pressures": 7.0,
        "counter_pressures": 0.80, "tackle_attempts": 1.70, "goalkeeper_saves": 0.0,
    },
    "FW": {
        "shots": 2.50, "shots_on_target": 1.10, "key_passes": 0.80, "through_balls": 0.08, "crosses": 0.35, "progressive_passes": 1.0, "dribble_attempts": 2.5,
        "dribble_success": 1.30, "carries_count": 4.0, "progressive_carry_distance": 40.0, "blocks": 0.20, "clearances": 0.15, "pressures": 5.5,
        "counter_pressures": 0.60, "tackle_attempts": 0.80, "goalkeeper_saves": 0.0,
    },
}
ATTACK_REF = {"DF": 0.08, "MF": 0.21, "FW": 0.38}
DEFENCE_REF = {"GK": 0.30, "DF": 2.21, "MF": 1.08, "FW": 0.55}
QUALITY, NO_QUALITY = (0.25, 2.0), 0.5
XG_PER_GOAL, XG_PER_SHOT, ON_TARGET = 0.65, 0.10, 0.42
KEY_PASSES_PER_ASSIST, BLOCKS_PER_INTERCEPTION, CLEARANCES_PER_INTERCEPTION, PRESSURES_PER_TACKLE, TACKLES_WON = 5.5, 0.6, 2.0, 4.0, 0.60
#: Proxies that are the baseline times the attacking, or defending, quality and nothing else.
_ATTACKING = ("through_balls", "crosses", "progressive_passes", "dribble_attempts", "dribble_success", "carries_count", "progressive_carry_distance")


def _by_position(key: Column, values: dict[str, float], other: float | None = None) -> Column:
    return reduce(lambda c, p: c.when(key == p, F.lit(float(values[p]))), values, F.when(F.lit(False), 0.0)).otherwise(F.lit(other))


def proxy_events(players: DataFrame) -> DataFrame:
    """Event-like numbers from league rows: the ``WEIGHTED`` fields, assists and minutes of each player's expected appearance.

    Needs position, expected_minutes, season_minutes, goals, assists, xg, interceptions and
    tackles_won, nulls as 0; other columns stay. League numbers are scaled to the expected
    minutes (at least 1; a season counts 90 at least); what leagues do not count follows
    from related numbers where those are positive, else from the position's baseline times
    a quality factor: the player's rate against the position's reference, for attack and
    for defence apart. A position without a baseline counts as midfield.
    """
    key = F.when(F.col("position").isin(*BUCKETS), F.col("position")).otherwise("MF")
    minutes = F.greatest(zero("expected_minutes").cast("double"), F.lit(1.0))
    given = ["goals", "assists", "xg", "interceptions", "tackles_won"]
    others = [c for c in players.columns if c not in (*given, "expected_minutes", "season_minutes", "minutes", *WEIGHTED)]
    scale = minutes / F.greatest(zero("season_minutes").cast("double"), F.lit(90.0))
    rows = players.select(*others, key.alias("__p"), minutes.alias("minutes"), *((zero(c) * scale).alias(c) for c in given))
    rows = rows.withColumn("xg", F.when(F.col("xg") == 0, F.col("goals") * XG_PER_GOAL).otherwise(F.col("xg")))
    rate = lambda x: x / F.col("minutes") * 90
    p = F.col("__p")

    def quality(value: Column, refs: dict[str, float]) -> Column:
        ref = _by_position(p, refs)
        return F.when((value > 0) & ref.isNotNull(), F.greatest(F.least(value / ref, F.lit(QUALITY[1])), F.lit(QUALITY[0]))).otherwise(NO_QUALITY)

    rows = rows.withColumns({"__a": quality(rate(F.col("xg")), ATTACK_REF), "__d": quality(rate(F.col("tackles_won") + F.col("interceptions")), DEFENCE_REF)})
    base = lambda f: _by_position(p, {k: v[f] for k, v in BASELINES.items()}) * F.col("minutes") / 90
    attack, defence = (lambda f: base(f) * F.col("__a")), (lambda f: base(f) * F.col("__d"))
    c, some = F.col, lambda f: F.col(f) > 0
    shots = F.when(some("xg"), c("xg") / XG_PER_SHOT).otherwise(attack("shots"))
    made = {f: attack(f) for f in _ATTACKING} | {
        "shots": shots,
        "shots_on_target": shots * ON_TARGET,
        "key_passes": F.when(some("assists"), F.greatest(c("assists") * KEY_PASSES_PER_ASSIST, attack("key_passes"))).otherwise(attack("key_passes")),
        "blocks": F.when(some("interceptions"), c("interceptions") * BLOCKS_PER_INTERCEPTION).otherwise(defence("blocks")),
        "clearances": F.when(some("interceptions") & (p == "DF"), c("interceptions") * CLEARANCES_PER_INTERCEPTION).otherwise(defence("clearances")),
        "pressures": F.when(some("tackles_won"), c("tackles_won") * PRESSURES_PER_TACKLE).otherwise(defence("pressures")),
        "counter_pressures": defence("counter_pressures"),
        "tackle_attempts": F.when(some("tackles_won"), c("tackles_won") / TACKLES_WON).otherwise(defence("tackle_attempts")),
        "goalkeeper_saves": F.when(p == "GK", base("goalkeeper_saves")).otherwise(0.0),
    }
    return rows.select(*others, "minutes", "assists", *((made[f] if f in made else c(f)).alias(f) for f in WEIGHTED))


def matchups(home: str = "home_", away: str = "away_") -> list[Column]:
    """Attack against defence both ways, the difference in creation, and pressing against carrying both ways; nulls as 0."""
    z = lambda side, f: F.coalesce(F.col(side + f), F.lit(0.0))
    attack, defence, creative, press, carry = "pos_fw_attack_score", "pos_df_defense_per90", "pos_mf_creative_per90", "team_pressures_per90", "team_carries_per90"
    made = [
        z(home, attack) - z(away, defence), z(away, attack) - z(home, defence), z(home, creative) - z(away, creative),
        z(home, press) - z(away, carry), z(home, carry) - z(away, press),
    ]
    return [c.alias(n) for c, n in zip(made, MATCHUPS, strict=True)]
