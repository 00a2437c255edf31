"""Sinks and table definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.sources.schemas import TABLES


def create_tables(spark: SparkSession, prefix: str = "") -> None:
    """The store's tables, where they are absent."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}) USING parquet")


def evolve(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the columns it lacks, as nulls."""
    have = {c.lower() for c in df.columns}
    return df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in columns.items() if c.lower() not in have))


def add_columns(spark: SparkSession, table: str, columns: dict[str, str]) -> list[str]:
    """Add the columns that a catalogue table lacks; which ones comes back."""
    have = {c.lower() for c in spark.table(table).columns}
    new = [c for c in columns if c.lower() not in have]
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'{c} {columns[c]}' for c in new)})")
    return new


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes in fields are doubled, as ``readers.csv`` reads them."""
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def apply(delta: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Append a delta; with ``dry_run`` only give it back."""
    if not dry_run:
        delta.write.mode("append").parquet(path)
    return delta
