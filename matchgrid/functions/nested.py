"""Arrays, maps and JSON: market cells, stints, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET = "array<struct<`1`:string,X:string,`2`:string,bookmaker_name:string,period:string>>"
#: Bookmakers by preference.
BOOKMAKERS = ("bet365", "Betway", "888sport", "1xBet")


def market(cell: Column) -> Column:
    """A single-quoted array of market maps; Python's None counts as null; null where it cannot be read."""
    plain = F.regexp_replace(cell, r"\bNone\b", "null")
    return F.from_json(plain, MARKET, {"allowSingleQuotes": "true"})


def preferred(cell: Column, bookmakers: tuple[str, ...] = BOOKMAKERS) -> Column:
    """The first preferred bookmaker's element, else the first element; null for an empty market."""
    of = lambda name: F.get(F.filter(cell, lambda m: F.lower(m["bookmaker_name"]) == name.lower()), 0)
    return F.coalesce(*map(of, bookmakers), F.get(cell, 0))


def market_odds(cell: Column, bookmakers: tuple[str, ...] = BOOKMAKERS) -> Column:
    """(home, draw, away, bookmaker) of the preferred element; null unless all three odds are numbers. The cell is read once."""
    odds = lambda m: F.struct(*(m[k].try_cast("double").alias(n) for k, n in (("1", "home"), ("X", "draw"), ("2", "away"))), m["bookmaker_name"].alias("bookmaker"))
    best = F.transform(F.array(market(cell)), lambda c: preferred(c, bookmakers))
    read = F.filter(F.transform(F.filter(best, lambda m: m.isNotNull()), odds), lambda o: o["home"].isNotNull() & o["draw"].isNotNull() & o["away"].isNotNull())
    return F.get(read, 0)


def clock(text: Column) -> Column:
    """Minutes of ``MM``, ``MM:SS`` or ``HH:MM:SS``; null where it is none."""
    parts = F.transform(F.split(text, ":"), lambda x: x.try_cast("double"))
    p = lambda i: F.get(parts, i)
    return F.when(F.size(parts) == 3, p(0) * 60 + p(1) + p(2) / 60).when(F.size(parts) == 2, p(0) + p(1) / 60).when(F.size(parts) == 1, p(0))


def stint_minutes(positions: Column, end: float = 90.0) -> Column:
    """Whole minutes of an array of stints (from, to as text): open ends last to ``end``, unreadable starts count nothing, none is below 0."""
    one = lambda s: F.coalesce(F.greatest(F.coalesce(clock(s["to"]), F.lit(end)) - clock(s["from"]), F.lit(0.0)), F.lit(0.0)).cast("int")
    return F.coalesce(F.aggregate(positions, F.lit(0), lambda acc, s: acc + one(s)), F.lit(0))


def started(positions: Column) -> Column:
    return F.coalesce(F.exists(positions, lambda s: F.coalesce(clock(s["from"]) == 0, F.lit(False))), F.lit(False))


def coordinate(point: Column, i: int) -> Column:
    """A coordinate of ``[x, y]``; null unless there are two."""
    return F.when(F.size(point) >= 2, F.get(point, i))


def truthy(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def lookup(table: Column, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def first_present(df, names: list[str]) -> Column:
    """The first non-null among the columns that ``df`` has; null without any."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def two_sides(home: dict[str, Column], away: dict[str, Column]) -> Column:
    """To explode: a struct of each of a match's two roles, same fields."""
    return F.array(F.struct(*(c.alias(n) for n, c in home.items())), F.struct(*(c.alias(n) for n, c in away.items())))
