"""What the training-data operators share: places, written tables, ranks and components.

Lineage is cut with Parquet tables in the folder that the cluster names in
``spark.checkpoint.dir``: every executor sees it, and a lost executor costs
only the tasks it ran.
"""

from __future__ import annotations

import contextlib
import functools
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space, as the contracts use it: U+0020 and U+0009 to U+000D.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster, or whoever made a local session, names."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found.rstrip("/")


#: Folders that this driver has written and not deleted, in order.
_written: dict[str, None] = {}
#: Folder -> all folders of the operator that made it.
_together: dict[str, list[str]] = {}
_recorders = threading.local()


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/matchgrid/{tag}-{uuid.uuid4().hex}"
    _written[path] = None
    for paths in getattr(_recorders, "lists", []):
        paths.append(path)
    return path


@contextlib.contextmanager
def recording() -> Iterator[list[str]]:
    """The paths that this thread makes inside the block."""
    lists = _recorders.__dict__.setdefault("lists", [])
    paths: list[str] = []
    lists.append(paths)
    try:
        yield paths
    finally:
        lists.pop()


def together(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator all of whose folders are freed with its result: also those that it points to without a scan."""

    @functools.wraps(operator)
    def run(*args, **options) -> DataFrame:
        with recording() as paths:
            out = operator(*args, **options)
        _together.update(dict.fromkeys(paths, paths))
        return out

    return run


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)
    _together.pop(path, None)


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "written_to", None)
        if path in _written:
            _delete(t.sparkSession, path)


def _read_by(used: tuple[DataFrame, ...]) -> set[str]:
    return {part for u in used for f in u.inputFiles() for part in f.split("/")}


def forget_paths(spark: SparkSession, paths: list[str], *used: DataFrame) -> None:
    """Delete the written ``paths``, but for those that ``used`` read."""
    kept = _read_by(used)
    for path in paths:
        if path in _written and path.rsplit("/", 1)[-1] not in kept:
            _delete(spark, path)


def release(*results: DataFrame) -> None:
    """Delete the working tables that results of this module's operators read, and what else a ``together`` operator made; call it once the results are stored elsewhere."""
    read = _read_by(results)
    for path in [p for p in _written if p.rsplit("/", 1)[-1] in read]:
        for other in list(_together.get(path, [path])):
            if other in _written:
                _delete(results[0].sparkSession, other)


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node id that links reach, for each node of ``edges(u, v)``.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Each step
    is a partial aggregation and an inner join that adaptive execution can split,
    so a hub with a third of all edges does not land in one task. Every pair of
    steps is written to the shared folder; only its row count and checksum reach
    the driver. Self links and null ends are ignored.
    """
    e = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = write_table(e, "cc")
    before = _checksum(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        # neighbours larger than u go to the smallest of u and its neighbours
        turned = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = turned.join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = write_table(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        forget(e)
        e = new
        after = _checksum(e)
        if after == before:
            break
        before = after
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = members.union(e.select("v", "v")).distinct()
    out.written_to = e.written_to
    return out


def _checksum(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    return row[0], row[1] or 0


def _number(group_at: int):
    """Adds a sorted task's number, each row's place in its run of one group, and whether that run is the task's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at, first = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            group = batch.column(group_at).to_numpy(zero_copy_only=False)
            new = np.concatenate(([last is not None and group[0] != last], group[1:] != group[:-1])).astype(bool)
            starts = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            place = np.where(starts < 0, np.arange(n) + at, np.arange(n) - starts)
            head = first & (np.cumsum(new) == 0)
            last, at, first = group[-1], int(place[-1]) + 1, bool(head[-1])
            more = [pa.array(np.full(n, part, np.int64)), pa.array(place.astype(np.int64)), pa.array(head)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part_", "at_", "head_"])

    return run


def placed(df: DataFrame, group: str, order: list[str], tag: str = "placed") -> DataFrame:
    """``df`` as a stored table with ``place``: each row's number, from 0, among its ``group`` (a string, never null) by ``order``, nulls first.

    Rows are range-sorted by group, order and a seeded random number, so neither a group nor
    repeated rows land in one task; rows equal in all of ``order`` take any turn. Only a task's
    first run can go on with a group, so what is broadcast is at most one row a task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group), *(F.col(c).asc_nulls_first() for c in order), F.col("tie_")]
    ranged = df.withColumn("tie_", F.rand(0)).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("tie_")
    schema = df.limit(0).select("*", F.lit(0).cast("long").alias("part_"), F.lit(0).cast("long").alias("at_"), F.lit(True).alias("head_")).schema
    stored = write_table(ranged.mapInArrow(_number(df.columns.index(group)), schema), tag)
    runs = stored.groupBy(group, "part_").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(group).orderBy("part_").rowsBetween(W.unboundedPreceding, -1))
    heads = runs.select("part_", before.alias("before_")).where("before_ > 0").withColumn("head_", F.lit(True))
    out = stored.join(F.broadcast(heads), ["part_", "head_"], "left")
    out = out.select(*df.columns, (F.col("at_") + F.coalesce("before_", F.lit(0))).alias("place"))
    out.written_to = stored.written_to
    return out
