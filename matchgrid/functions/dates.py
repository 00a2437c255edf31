"""Dates, seasons and recency weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weights of the last three seasons, the oldest first (fixed values).
RECENCY = (0.3, 0.5, 1.0)


def match_date(text: Column) -> Column:
    """``dd/MM/yyyy``, else ``dd/MM/yy``, else null."""
    long = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(text, F.lit("d/M/yyyy")))
    short = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_timestamp(text, F.lit("d/M/yy")))
    return F.coalesce(long, short)


def utc_time(text: Column) -> Column:
    """A time stamp from ISO-like text that may end in ``UTC``; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"\s*UTC$", "Z"))


def previous_season(code: Column) -> Column:
    """``2324`` to ``2022-2023``; what is no such code, or ends in other than the next year, gives ``2021-2022``. Century turns are right."""
    a, b = F.substring(code, 1, 2).try_cast("int"), F.substring(code, 3, 2).try_cast("int")
    good = code.rlike("^[0-9]{4}$") & (b == (a + 1) % 100)
    start = F.lit(2000) + a - 1
    return F.when(good, F.concat_ws("-", start.cast("string"), (start + 1).cast("string"))).otherwise("2021-2022")


def season_of(date: Column, first_month: int = 7) -> Column:
    """``2021-2022`` for a date from July 2021 to June 2022."""
    start = F.year(date) - (F.month(date) < first_month).cast("int")
    return F.concat_ws("-", start.cast("string"), (start + 1).cast("string"))


def season_weights(latest: Column, weights: tuple[float, ...] = RECENCY) -> Column:
    """Array of (season, weight) that ends at ``latest`` (``2022-2023``)."""
    start = F.substring(latest, 1, 4).try_cast("int")
    back = len(weights) - 1
    return F.array(
        *(
            F.struct(F.concat_ws("-", (start - (back - i)).cast("string"), (start - (back - i) + 1).cast("string")).alias("season"), F.lit(w).alias("weight"))
            for i, w in enumerate(weights)
        )
    )


def season_end(season: Column) -> Column:
    """30 June of a season's second year."""
    return F.make_date(F.substring(season, 6, 4).try_cast("int"), F.lit(6), F.lit(30))


def weight_table(spark: SparkSession, config: dict[str, dict[str, float]]) -> DataFrame:
    """(tournament, season, weight) of a configuration."""
    rows = [(t, s, float(w)) for t, seasons in config.items() for s, w in seasons.items()]
    return spark.createDataFrame(rows, "tournament string, season string, weight double")
