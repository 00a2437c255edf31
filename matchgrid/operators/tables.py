"""Upserts that rewrite only what they touch: tables in buckets by key, with a log of versions.

A table is a folder of Parquet buckets (``bucket`` = hash of the key). An upsert reads and
merges the buckets that its rows fall in, stores the result, takes the next version number,
and only then replaces these buckets. A version names its stored rows, so a writer that finds
one unfinished finishes it first: replacing a bucket by the same rows again changes nothing.
Of two writers that start from one version, one gets the next; the other starts again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.operators.merge import upsert
from matchgrid.sources.stored import stored

BUCKETS = 64
LOG = "_versions"


class Conflict(Exception):
    """Another writer has taken the version."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file that must not be there yet."""
    fs, where = _fs(spark, path)
    try:
        out = fs.create(where, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _read_text(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, path: str) -> list[dict]:
    """The log, oldest first: number, done, batch, rows (where the stored rows are), buckets."""
    fs, where = _fs(spark, f"{path}/{LOG}")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    numbers = sorted(int(n) for n in names if n.isdigit())
    return [json.loads(_read_text(spark, f"{path}/{LOG}/{n:08}")) | {"number": n, "done": f"{n:08}.done" in names} for n in numbers]


def _replace(spark: SparkSession, path: str, rows: str, schema) -> None:
    """Put stored rows in the place of the buckets that they hold."""
    new = spark.read.schema(schema).parquet(rows)
    new.repartition("bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table without its bucket column. An unfinished upsert is finished by the next writer, not by readers."""
    return spark.read.parquet(path).drop("bucket")


def create(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Write a new table; keys must be unique."""
    spark = df.sparkSession
    rows = stored(df.withColumn("bucket", bucket_of(keys, buckets)), "created")
    entry = {"batch": None, "rows": rows.stored_at, "buckets": buckets, "keys": keys, "schema": rows.schema.json(), "touched": list(range(buckets))}
    if not _create(spark, f"{path}/{LOG}/{1:08}", json.dumps(entry)):
        raise Conflict(f"{path} is there already")
    _replace(spark, path, rows.stored_at, rows.schema)
    _create(spark, f"{path}/{LOG}/{1:08}.done", "")


def _finished(spark: SparkSession, path: str) -> list[dict]:
    """The log after what was left unfinished has been finished."""
    from pyspark.sql.types import StructType

    log = versions(spark, path)
    for v in log:
        if not v["done"]:
            _replace(spark, path, v["rows"], StructType.fromJson(json.loads(v["schema"])))
            _create(spark, f"{path}/{LOG}/{v['number']:08}.done", "")
    return log


def upsert_into(new: DataFrame, path: str, rules: dict[str, Column] | None = None, when: Column | None = None, batch: str | None = None, tries: int = 5, before_commit: Callable[[], None] | None = None) -> dict:
    """Upsert ``new`` into a table made by ``create``, as ``merge.upsert`` does; the log entry, or that of the same ``batch`` if it was applied before.

    Only the buckets of the new rows' keys are read and written. Of new rows with one key,
    any one counts; give unique keys. ``before_commit`` runs before each attempt to take the version (for tests).
    """
    spark = new.sparkSession
    for _ in range(tries):
        log = _finished(spark, path)
        if not log:
            raise ValueError(f"{path} is no table with a log")
        applied = [v for v in log if batch is not None and v["batch"] == batch]
        if applied:
            return applied[0]
        first, number = log[0], log[-1]["number"] + 1
        keys, buckets = first["keys"], first["buckets"]
        delta = new.dropDuplicates(keys).withColumn("bucket", bucket_of(keys, buckets))
        touched = sorted(r[0] for r in delta.select("bucket").distinct().collect())  # as many as there are buckets
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
        made = stored(upsert(old, delta.drop("bucket"), keys, rules, when).withColumn("bucket", bucket_of(keys, buckets)), "upserted")
        if before_commit:
            before_commit()
        entry = {"batch": batch, "rows": made.stored_at, "buckets": buckets, "keys": keys, "schema": made.schema.json(), "touched": touched}
        if _create(spark, f"{path}/{LOG}/{number:08}", json.dumps(entry)):
            _replace(spark, path, made.stored_at, made.schema)
            _create(spark, f"{path}/{LOG}/{number:08}.done", "")
            return entry | {"number": number, "done": True}
    raise Conflict(f"{path}: another writer came first {tries} times")
