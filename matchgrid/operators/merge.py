"""Table maintenance as joins: checkpoints, upserts and conditional updates.

Each function gives the new table; writing it, or only looking at it, is up to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def missing_rows(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the table does not have yet."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(missing_rows(new, old, keys), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """One row a key of either side. ``rules``: column -> value from ``old_<c>`` and ``new_<c>``; others take the new value, else the old.

    Where both have the key and ``when`` (of the same names) is not true, the old row stays.
    """
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *(F.col(c).alias(f"old_{c}") for c in values), F.lit(True).alias("old_row"))
    n = new.select(*keys, *((F.col(c) if c in new.columns else F.lit(None).cast(dict(old.dtypes)[c])).alias(f"new_{c}") for c in values), F.lit(True).alias("new_row"))
    both = o.join(n, keys, "full")
    has_new, has_old = F.col("new_row").isNotNull(), F.col("old_row").isNotNull()
    update = has_new & (~has_old | (F.coalesce(when, F.lit(False)) if when is not None else F.lit(True)))
    made = []
    for c in values:
        rule = (rules or {}).get(c, keep_newest(c))
        made.append(F.when(update, rule).otherwise(F.col(f"old_{c}")).alias(c))
    kept = both.where(has_old | update) if when is not None else both
    return kept.select(*keys, *made).select(*old.columns)


def keep_newest(c: str) -> Column:
    """The new value unless it is null."""
    return F.coalesce(f"new_{c}", f"old_{c}")


def overwrite(c: str) -> Column:
    return F.col(f"new_{c}")


def keep_first(c: str) -> Column:
    """The old value unless it is null."""
    return F.coalesce(f"old_{c}", f"new_{c}")


def keep_unless_zero(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(f"new_{c}"), F.lit(0)), F.col(f"old_{c}"))


def raise_only(c: str) -> Column:
    """The larger of both."""
    return F.greatest(f"new_{c}", f"old_{c}")


def at_least_minutes(least: int = 50) -> Column:
    """Guard: enough new minutes, and no fewer than before."""
    return (F.col("new_minutes_played") >= least) & (F.coalesce("old_minutes_played", F.lit(0)) <= F.col("new_minutes_played"))


def estimated_goals(goals: Column, caps: Column, games: int = 30) -> Column:
    """Goals of a career scaled to a season, one at least."""
    return F.greatest(F.lit(1), (goals / F.when(caps > 0, caps) * games).cast("int"))


def target_row(table: DataFrame, pid: str, season: Column, as_of: str = "as_of_date") -> DataFrame:
    """One row a player: the season's, else the latest."""
    rest = [F.col(c) for c in table.columns if c not in (pid, as_of)]
    w = W.partitionBy(pid).orderBy(F.coalesce(season, F.lit(False)).desc(), F.col(as_of).desc_nulls_last(), *rest)
    return table.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert_with_fallback(old: DataFrame, new: DataFrame, pid: str, label: str, fallback_for: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """Upsert on (pid, label), where rows without a label take the new rows of ``fallback_for`` if that player has no row of it."""
    have = old.where(F.col(label) == fallback_for).select(pid).distinct().withColumn("__have", F.lit(True))
    due = new.where(F.col(label) == fallback_for).select(pid).distinct().withColumn("__due", F.lit(True))
    adopted = old.join(have, pid, "left").join(due, pid, "left")
    takes = F.col(label).isNull() & F.col("__have").isNull() & F.col("__due").isNotNull()
    adopted = adopted.withColumn(label, F.when(takes, F.lit(fallback_for)).otherwise(F.col(label))).select(*old.columns)
    return upsert(adopted, new, [pid, label], rules)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows that refer to no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")
