"""Numeric functions: guarded ratios, rounding, entropy, interactions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrid.sources.stored import drop_stored, stored


def per90(value: Column, minutes: Column) -> Column:
    return F.when(minutes > 0, value / minutes * 90).otherwise(F.lit(0.0))


def distance(x0: Column, y0: Column, x1: Column, y1: Column, least: float = 0.0) -> Column:
    """Euclidean; 0 below ``least``."""
    d = F.hypot(x1 - x0, y1 - y0)
    return F.when(d >= least, d).otherwise(F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def finite(x: Column, fill: Column | None = None) -> Column:
    """Null (or ``fill``) for NaN and infinities."""
    ok = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
    return ok if fill is None else F.coalesce(ok, fill)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def truncated(x: Column) -> Column:
    """Toward zero, as a whole number."""
    return x.cast("bigint")


def entropy(*p: Column) -> Column:
    """Of a distribution, as a share of the largest possible; probabilities up to 1e-12 add nothing."""
    total = reduce(lambda a, b: a + b, [F.when(x > 1e-12, -x * F.log(x)).otherwise(F.lit(0.0)) for x in p])
    return total / math.log(len(p))


def top_margin(*p: Column) -> Column:
    """The largest less the second largest."""
    ordered = F.sort_array(F.array(*p), asc=False)
    return ordered[0] - ordered[1]


def xg_proxy(on_target: Column, shots: Column) -> Column:
    """Expected goals from shot counts; null if both are."""
    on, all_ = F.coalesce(on_target, F.lit(0)), F.coalesce(shots, F.lit(0))
    return F.when(on_target.isNotNull() | shots.isNotNull(), 0.32 * on + 0.04 * F.greatest(all_ - on, F.lit(0)))


def interactions(df: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """``df`` with a column for each (kind, a, b): ``diff`` (absolute), ``product``, ``ratio`` (a zero below counts 0.001) or ``square`` (of a).

    A missing base column is an error.
    """
    missing = sorted({c for kind, a, b in pairs for c in ([a] if kind == "square" else [a, b]) if c not in df.columns})
    if missing:
        raise ValueError(f"no such columns: {missing}")
    made = {
        "diff": lambda a, b: F.abs(F.col(a) - F.col(b)),
        "product": lambda a, b: F.col(a) * F.col(b),
        "ratio": lambda a, b: F.col(a) / F.when(F.col(b) == 0, F.lit(0.001)).otherwise(F.col(b)),
        "square": lambda a, b: F.col(a) * F.col(a),
    }
    return df.select("*", *(made[kind](a, b).alias(f"{kind}_{a}" if kind == "square" else f"{kind}_{a}_{b}") for kind, a, b in pairs))


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its mean over its population deviation; 0 where that is 0. One aggregation, joined as one row."""
    stats = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns))
    met = df.crossJoin(F.broadcast(stats))
    scaled = {c: F.when(F.col(f"s_{c}") == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")) for c in columns}
    return met.select(*(scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns))


def one_hot(value: Column, classes: list[str], prefix: str) -> list[Column]:
    """A 0/1 column for each class; others, null too, are all 0."""
    return [F.coalesce((value == c).cast("double"), F.lit(0.0)).alias(f"{prefix}{c.lower()}") for c in classes]


#: Values of a group that one task sorts, at most, and the quantiles by which larger groups are narrowed.
FEW, QUANTILES = 10_000, 256


def values_at(rows: DataFrame, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """(by, name, value): the exact value at each of ``ranks`` (name -> 0-based rank, over n) among the non-null values of ``rows(by, value)``.

    Quantile sketches narrow each group to the values around its rank, again and again until
    few are left; only those are sorted, after what lies below them has been counted. No task
    holds a group. A sketch is off by a ten-thousandth of its values at most, a window reaches
    a 256th beyond the rank. Null keys are a group of their own; groups without values have no row.
    The result reads one small stored table; ``drop_stored(result)`` frees it once the result is taken.
    """
    rows = rows.where("value is not null")
    same = lambda a, b: reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in by], F.lit(True))
    keys = [*by, "name"]
    grid = [i / QUANTILES for i in range(QUANTILES + 1)]

    def sketched(value: Column) -> list[Column]:
        return [F.approx_count_distinct(value).alias("__d"), F.percentile_approx(value, grid, 10_000).alias("__g")]

    def narrowed(inside: Column, low: Column, high: Column) -> dict[str, Column]:
        """Bounds around the rank that has ``inside`` values of the window before it, where many are left."""
        many = (F.col("__m") > FEW) & (F.col("__d") > FEW // 2)
        at = F.floor(inside / F.col("__m") * QUANTILES).cast("int")
        new = F.get("__g", F.greatest(at - 1, F.lit(0))), F.get("__g", F.least(at + 2, F.lit(QUANTILES)))
        # a window that no longer narrows is sorted as it is
        stuck = (new[0] <= F.coalesce(low, F.lit(float("-inf")))) & (new[1] >= F.coalesce(high, F.lit(float("inf"))))
        open_ = many & ~stuck & (F.col("__m") * 3 / QUANTILES > FEW)
        return {"__low": F.when(many, new[0]).otherwise(low), "__high": F.when(many, new[1]).otherwise(high), "__open": open_}

    first = rows.groupBy(*by).agg(F.count("*").alias("n"), *sketched(F.col("value").cast("double")))
    named = F.array(*(F.struct(F.lit(n).alias("name"), r.cast("long").alias("__k")) for n, r in ranks.items()))
    first = first.select(*by, F.col("n").alias("__m"), "__d", "__g", F.inline(named))
    none = F.lit(None).cast("double")
    state = stored(first.select(*keys, "__k", *(c.alias(n) for n, c in narrowed(F.col("__k"), none, none).items())), "ranks")
    inside = F.col("__low").isNull() | F.col("value").between(F.col("__low"), F.col("__high"))
    while state.where("__open").limit(1).count():
        own = [state[c].alias(c) for c in (*keys, "__k", "__low", "__high", "__open")]
        met = rows.join(state.where("__open"), same(rows, state)).select(*own, F.col("value").cast("double").alias("value"))
        below = F.count_if(F.coalesce(F.col("value") < F.col("__low"), F.lit(False)))
        each = met.groupBy(*keys, "__k", "__low", "__high").agg(below.alias("__below"), F.count_if(inside).alias("__m"), *sketched(F.when(inside, F.col("value"))))
        new = narrowed(F.col("__k") - F.col("__below"), F.col("__low"), F.col("__high"))
        more = each.select(*keys, "__k", *(c.alias(n) for n, c in new.items()))
        state, old = stored(more.union(state.where("not __open")), "ranks"), state
        drop_stored(old)
    met = rows.join(state, same(rows, state)).where(F.col("__low").isNull() | (F.col("value").cast("double") <= F.col("__high")))
    beneath = F.coalesce(F.col("value").cast("double") < F.col("__low"), F.lit(False))
    left = met.select(*(state[c].alias(c) for c in (*keys, "__k")), F.when(~beneath, rows["value"]).alias("value")).groupBy(*keys, "__k", "value").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(W.partitionBy(*keys).orderBy(F.col("value").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    out = left.withColumn("__upto", upto).where("__upto > __k and value is not null").groupBy(*keys).agg(F.min("value").alias("value"))
    out.stored_at = state.stored_at
    return out


def upper_median(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Grouped median without interpolation: element n // 2 of the sorted non-null values."""
    each = df.unpivot(keys, columns, "__column", "value")
    found = values_at(each.select(*keys, "__column", "value"), [*keys, "__column"], {"upper": F.floor(F.col("n") / 2)})
    return found.groupBy(*keys).pivot("__column", columns).agg(F.first("value"))
