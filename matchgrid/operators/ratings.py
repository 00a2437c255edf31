"""Elo ratings: a fold over matches in time, which only the order of a component's matches makes serial."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START = 1500.0
K = 22.0
ADVANTAGE = 60.0


def elo_fold(matches: DataFrame, component: str, order: list[str], home: str = "home", away: str = "away", hg: str = "hg", ag: str = "ag", ranks: bool = False) -> DataFrame:
    """``matches`` with elo_home, elo_away (before the match) and elo_home_after, elo_away_after.

    ``component`` splits matches into sets that share no team (leagues); each is folded in
    ``order``, which must be total. One component is serial by nature: a team's rating
    waits for its last match. Its matches pass in order through one task, which holds a
    batch of them and the teams' ratings, however many there are. A match without a score or
    a team changes nothing. ``ranks`` adds rank_home and rank_away before the match: 1 + the
    component's teams then rated higher; unseen teams rank after all known.
    """
    new = ["elo_home", "elo_away", "elo_home_after", "elo_away_after"]
    placed = ["rank_home", "rank_away"] if ranks else []
    schema = matches.limit(0).select("*", *(F.lit(0.0).alias(c) for c in new), *(F.lit(0).alias(c) for c in placed)).schema
    at = [matches.columns.index(c) for c in (component, home, away, hg, ag)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rating, board = object(), {}, []
        place = lambda t: 1 + len(board) - bisect.bisect_right(board, rating[t]) if t in rating else len(board) + 1
        for batch in batches:
            rows = []
            for group, h, a, x, y in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if group != now:
                    now, rating, board = group, {}, []
                where = (place(h), place(a)) if ranks else ()
                rh, ra = rating.get(h, START), rating.get(a, START)
                change = None if None in (h, a, x, y) else change_of(rh, ra, x, y)
                for team, old, rated in () if change is None else ((h, rh, rh + change), (a, ra, ra - change)):
                    if ranks:
                        if team in rating:
                            del board[bisect.bisect_left(board, old)]
                        bisect.insort(board, rated)
                    rating[team] = rated
                rows.append((rh, ra, rating.get(h, START), rating.get(a, START), *where))
            made = zip(*rows, strict=True) if rows else [[]] * len(new + placed)
            kinds = [pa.float64()] * 4 + [pa.int32()] * len(placed)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(made, kinds, strict=True))], names=[*batch.schema.names, *new, *placed])

    turn = [F.col(c).asc_nulls_last() for c in order]
    return matches.repartition(component).sortWithinPartitions(component, *turn).mapInArrow(fold, schema)


def change_of(home: float, away: float, hg: float, ag: float) -> float:
    """What a match adds to the home side's rating, and takes from the away side's."""
    expected = 1 / (1 + 10 ** (-(home + ADVANTAGE - away) / 400))
    actual = 0.5 if hg == ag else float(hg > ag)
    return K * (1 + 0.15 * min(abs(hg - ag), 3)) * (actual - expected)


def team_history(folded: DataFrame, order: list[str], home: str = "home", away: str = "away") -> DataFrame:
    """(team, order columns, elo): a row for each team and match, its rating after it."""
    side = lambda t, e: F.struct(F.col(t).alias("team"), F.col(e).alias("elo"))
    return folded.select(*order, F.explode(F.array(side(home, "elo_home_after"), side(away, "elo_away_after"))).alias("s")).select("s.*", *order)


def rating_as_of(history: DataFrame, asked: DataFrame, order: str, team: str = "team") -> DataFrame:
    """``asked(team, order)`` with the last rating strictly before it, 1500 without one: a union and a window, no range join."""
    a = asked.select("*", F.lit(None).cast("double").alias("__e"), F.lit(0).alias("__k"))
    h = history.select(team, order, F.col("elo").alias("__e"), F.lit(1).alias("__k"))
    w = W.partitionBy(team).orderBy(order, "__k").rowsBetween(W.unboundedPreceding, -1)
    both = a.unionByName(h, allowMissingColumns=True).withColumn("elo", F.last("__e", ignorenulls=True).over(w))
    return both.where("__k = 0").withColumn("elo", F.coalesce("elo", F.lit(START))).drop("__e", "__k")


def current(history: DataFrame, order: list[str], partition: list[str] | None = None) -> DataFrame:
    """A team's last rating and its rank, 1 the highest, ties by name."""
    last = history.groupBy(*(partition or []), "team").agg(F.max_by("elo", F.struct(*order)).alias("elo"))
    return last.withColumn("rank", F.row_number().over(W.partitionBy(*(partition or [])).orderBy(F.desc("elo"), "team")))


def top(ratings: DataFrame, n: int) -> DataFrame:
    return ratings.orderBy(F.desc("elo"), "team").limit(n)


def rank_or_last(rank: Column, known: Column) -> Column:
    """An unseen team ranks after all known ones."""
    return F.coalesce(rank, known + 1)
