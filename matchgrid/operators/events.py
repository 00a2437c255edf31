"""Event streams to player and team numbers: each step one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrid.functions.nested import coordinate, started, stint_minutes, truthy
from matchgrid.functions.numbers import distance, half_even
from matchgrid.sources.schemas import EVENT_METRICS, EVENTS, REAL_METRICS

#: A pass or carry counts as progressive from these lengths.
LONG_PASS = 25.0
FORWARD = 10.0


def conform(events: DataFrame) -> DataFrame:
    """All event columns, those a feed lacks as nulls; ``has_through`` says whether the through-ball flag was there."""
    want = events.sparkSession.createDataFrame([], EVENTS).schema
    have = set(events.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]
    return events.select(*cols, F.lit("pass_through_ball" in have).alias("has_through"))


def _metrics() -> dict[str, Column]:
    kind = lambda t: F.col("type") == t
    count = lambda c: F.count_if(c)
    shot, pass_, duel = kind("Shot"), kind("Pass"), kind("Duel")
    moved = lambda end, least: distance(coordinate(F.col("location"), 0), coordinate(F.col("location"), 1), coordinate(F.col(end), 0), coordinate(F.col(end), 1), least)
    through = F.when(F.col("has_through"), truthy(F.col("pass_through_ball"))).otherwise(F.lower("pass_type").contains("through"))
    forward = F.when(F.col("pass_length").isNotNull(), F.col("pass_length") >= LONG_PASS).otherwise(moved("pass_end_location", FORWARD) > 0)
    carried = F.coalesce(moved("carry_end_location", FORWARD), F.lit(0.0))
    aerial = duel & F.col("duel_type").contains("Aerial")
    won = F.coalesce(F.col("duel_outcome").isin("Won", "Success"), F.lit(False))
    tackle = duel & (F.col("duel_type") == "Tackle")
    card = lambda c: count(kind("Foul Committed") & F.lower("foul_committed_card").contains(c)) + count(kind("Bad Behaviour") & F.lower("bad_behaviour_card").contains(c))
    return {
        "xg": half_even(F.sum(F.when(shot, F.coalesce("shot_statsbomb_xg", F.lit(0.0))).otherwise(0.0)), 4),
        "goals": count(shot & (F.col("shot_outcome") == "Goal")),
        "shots": count(shot),
        "shots_on_target": count(shot & F.col("shot_outcome").isin("Goal", "Saved", "Saved to Post")),
        "passes_completed": count(pass_ & F.col("pass_outcome").isNull()),
        "passes_attempted": count(pass_),
        "key_passes": count(pass_ & truthy(F.col("pass_shot_assist"))),
        "through_balls": count(pass_ & through),
        "crosses": count(pass_ & truthy(F.col("pass_cross"))),
        "progressive_passes": count(pass_ & forward),
        "dribble_attempts": count(kind("Dribble")),
        "dribble_success": count(kind("Dribble") & F.col("dribble_outcome").isin("Complete", "Success")),
        "carries_count": count(kind("Carry")),
        "progressive_carry_distance": half_even(F.sum(F.when(kind("Carry"), carried).otherwise(0.0)), 2),
        "interceptions": count(kind("Interception")),
        "blocks": count(kind("Block")),
        "clearances": count(kind("Clearance")),
        "aerial_duels_won": count(aerial & won),
        "aerial_duels_lost": count(aerial & ~won),
        "ball_recoveries": count(kind("Ball Recovery")),
        "fouls_committed": count(kind("Foul Committed")),
        "fouls_won": count(kind("Foul Won")),
        "tackle_attempts": count(tackle),
        "tackles_won": count(tackle & F.col("duel_outcome").isin("Won", "Success In Play", "Success Out")),
        "pressures": count(kind("Pressure")),
        "counter_pressures": count(kind("Pressure") & truthy(F.col("counterpress"))),
        "actions_under_pressure": count(truthy(F.col("under_pressure"))),
        "yellow_cards": card("yellow"),
        "red_cards": card("red"),
        "goalkeeper_saves": count(kind("Goal Keeper") & F.col("goalkeeper_outcome").contains("Saved")),
    }


def match_player_metrics(events: DataFrame) -> DataFrame:
    """(match_id, team, player, 30 metrics) in one aggregation; expected goals and carry distance are rounded a match."""
    made = _metrics()
    rows = conform(events).where("player is not null")
    return rows.groupBy("match_id", "team", "player").agg(*(made[m].alias(m) for m in EVENT_METRICS))


def player_metrics(per_match: DataFrame, keys: tuple[str, ...] = ("player",)) -> DataFrame:
    """Sums over matches, and how many there were."""
    sums = [F.sum(m).cast("double" if m in REAL_METRICS else "bigint").alias(m) for m in EVENT_METRICS if m in per_match.columns]
    return per_match.groupBy(*keys).agg(*sums, F.count("*").alias("matches"))


def playing_time(lineups: DataFrame, end: float = 90.0) -> DataFrame:
    """(team, player, minutes, starts, appearances): repeats in a match count once, its longest."""
    player = F.coalesce("player_name", "player_nickname").alias("player")
    rows = lineups.select("match_id", "team", player, stint_minutes(F.col("positions"), end).alias("m"), started(F.col("positions")).cast("int").alias("s"))
    once = rows.where("player is not null").groupBy("match_id", "team", "player").agg(F.max("m").alias("m"), F.max("s").alias("s"))
    return once.groupBy("team", "player").agg(F.sum("m").alias("minutes"), F.sum("s").alias("starts"), F.count_if(F.col("m") > 0).alias("appearances"))


def starter_flag(starts: Column, appearances: Column) -> Column:
    """1 if at least half of the appearances were starts."""
    return (starts / F.greatest(appearances, F.lit(1)) >= 0.5).cast("int")


def tournament_stats(events: DataFrame, lineups: DataFrame) -> DataFrame:
    """Players' event sums with their minutes and starter flag; players without line-up rows have 0."""
    per_match = match_player_metrics(events)
    total = player_metrics(per_match, ("team", "player"))
    time = playing_time(lineups)
    met = total.join(time, ["team", "player"], "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("minutes", "starts", "appearances")]
    met = met.select(*total.columns, *zero)
    return met.withColumn("is_starter", starter_flag(F.col("starts"), F.col("appearances")))


def regulation_scores(matches: DataFrame, events: DataFrame, own_goals: bool = False) -> DataFrame:
    """Matches with the score after 90 minutes, extra time, penalties, result and qualifier.

    Knock-out games count goals of periods 1 and 2; others, and those without events, use
    the final score. ``own_goals`` adds own goals to the side they count for.
    """
    goal = (F.col("type") == "Shot") & (F.col("shot_outcome") == "Goal")
    if own_goals:
        goal = goal | (F.col("type") == "Own Goal For")
    per_team = events.groupBy("match_id", "team").agg(
        F.count_if(goal & F.col("period").isin(1, 2)).alias("g90"),
        F.count_if(goal & F.col("period").isin(1, 2, 3, 4)).alias("g120"),
        F.count_if(goal & (F.col("period") == 5)).alias("pens"),
        F.max("period").alias("last"),
    )
    side = lambda p: per_team.select("match_id", F.col("team").alias(f"{p}_team"), *(F.col(c).alias(f"{p}_{c}") for c in ("g90", "g120", "pens", "last")))
    out = matches.join(side("home"), ["match_id", "home_team"], "left").join(side("away"), ["match_id", "away_team"], "left")
    last = F.greatest("home_last", "away_last")
    knockout = ~F.coalesce(F.lower("competition_stage").contains("group"), F.lit(True))
    use = knockout & last.isNotNull()
    h = F.when(use, F.coalesce("home_g90", F.lit(0))).otherwise(F.col("home_score")).cast("int")
    a = F.when(use, F.coalesce("away_g90", F.lit(0))).otherwise(F.col("away_score")).cast("int")
    out = out.select(
        "match_id", "home_team", "away_team", F.col("home_score").alias("home_score_full"), F.col("away_score").alias("away_score_full"),
        F.col("competition_stage").alias("stage"), knockout.alias("is_knockout"), h.alias("home_score_90"), a.alias("away_score_90"),
        (use & (last > 2)).alias("went_to_et"), (use & (last >= 5)).alias("went_to_penalties"),
        (F.coalesce("home_pens", F.lit(0)) - F.coalesce("away_pens", F.lit(0))).alias("pen_diff"),
    )
    full = F.col("home_score_full") - F.col("away_score_full")
    decided = F.when(full != 0, full).otherwise(F.col("pen_diff"))
    through = F.when(F.col("is_knockout") & (decided > 0), F.col("home_team")).when(F.col("is_knockout") & (decided < 0), F.col("away_team"))
    diff = F.col("home_score_90") - F.col("away_score_90")
    return out.select("*", through.alias("qualifier"), F.signum(diff).cast("int").alias("result"), diff.alias("goal_diff")).drop("pen_diff")
