"""Mixing sources to target weights over a time-varying curriculum.

A source's words are a share of the mix by weight, capped at ``cap`` passes over the
source. Its weight schedule, integrated over training time, says how much of the share
is due by then; inverting that integral turns a document's place in its source's word
count into a training position. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrid.llm.common import WORD_PATTERN, free_name, table, write_table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
#: For each of the repeating weights, its schedule: (time, relative weight) knots from 0 to 1, linear between.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)),
)
#: Rows that a running-sum task gets on average.
BUCKET_ROWS = 20_000


def _segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """(share before, share after, time, weight, slope) of each linear piece, in shares of the whole integral."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total = sum(areas)
    found, before = [], 0.0
    for area, (a, b) in zip(areas, zip(knots, knots[1:], strict=False), strict=True):
        if b[0] > a[0]:
            found.append((before, before + area / total, a[0], a[1] / total, (b[1] - a[1]) / (b[0] - a[0]) / total))
            before += area / total
    return found


def invert_demand(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time by which the schedule has used ``share`` (0 to 1) of its integral."""
    out = None
    for before, after, time, weight, slope in reversed(_segments(knots)):
        due = share - F.lit(before)
        # weight * x + slope * x * x / 2 = due, in the form that also holds for a slope of 0
        root = F.sqrt(F.greatest(F.lit(weight * weight) + F.lit(2 * slope) * due, F.lit(0.0)))
        x = F.when(due <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * due / (F.lit(weight) + root))
        at = F.lit(time) + x
        out = at if out is None else F.when(share < F.lit(after), at).otherwise(out)
    return F.least(out, F.lit(1.0))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes(source, source_size)`` with turn and target, one row a source; its other columns stay.

    Targets fill up like water: level * weight, but no more than ``cap`` times the source.
    The level is the largest over sources, by cap / weight, of what is left after the
    sources before it are full, by the weights from it on. One row a source is all that
    meets here.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = ((F.row_number().over(order) - 1) % len(weights)).cast("int")
    rows = sizes.withColumn("turn", turn)
    rows = rows.withColumn("w", F.element_at(F.array(*(F.lit(int(w)) for w in weights)), F.col("turn") + 1))
    rows = rows.withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("w"))
    filled = W.orderBy("ratio", F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(W.partitionBy())
    before = F.coalesce(F.sum("source_size").over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    later = F.sum("w").over(filled.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", (F.lit(share) * total - F.lit(cap) * before) / later)
    level = F.max("level").over(W.partitionBy())
    return rows.select(*sizes.columns, "turn", F.least(F.lit(cap) * F.col("source_size"), F.col("w") * level).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    schedules=SCHEDULES,
    share: float = SHARE,
    cap: float = CAP,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with size, source_size, target, taken and copies.

    copies: array of (copy, words, position): passes over the source that take the
    document, how many of its first words they take (all, but for one document a source,
    in its last pass) and its training position from 0 to 1. taken: the copies' words.
    Within a source documents follow the md5 of their id, so reruns agree. Null and empty
    texts have size 0 and are not taken; null sources are one source, the last; null ids
    order as the empty id. Repeated rows are taken as often as they occur. An empty table
    gives an empty table. Whole texts of any length are read; added names take a leading
    underscore where ``docs`` has them. Where ``keep`` holds the texts they are read twice,
    so ``docs`` must give the same rows again (as stored tables do).
    """
    kept = [c for c in docs.columns if keep is None or c in keep]
    n = {k: free_name(docs, k) for k in ("size", "source_size", "target", "taken", "copies", "mix_key", "mix_hash", "mix_tie")}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    owner = F.col(source_col).cast("string")
    sized = docs.select(
        *kept,
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias(n["size"]),
        # never null, so that the running sums and the join with the sources' targets share one shuffle
        F.when(owner.isNull(), "n").otherwise(F.concat(F.lit("s"), owner)).alias(n["mix_key"]),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias(n["mix_hash"]),
        F.crc32(text.cast("binary")).alias(n["mix_tie"]),
    )
    if text_col not in kept:  # a copy of whole texts would cost more than counting their words again
        sized = write_table(sized, "sized")
    size, source, key = n["size"], n["mix_key"], n["mix_hash"]
    rows = docs.count()
    digits = min(8, max(0, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16))))
    # a source that holds a third of all rows is cut by hash; bucket sums come before the shuffle
    bucket = F.substring(key, 1, digits)
    sums = sized.groupBy(F.col(source).alias("key"), bucket.alias("bucket")).agg(F.sum(size).alias("s"))
    sums = write_table(sums, "sums")
    earlier = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    firsts = sums.withColumn("first", F.coalesce(F.sum("s").over(earlier), F.lit(0)))
    wholes = sums.groupBy("key").agg(F.sum("s").alias("source_size")).withColumn("source", F.when(F.col("key") != "n", F.expr("substring(key, 2)")))
    targets = source_targets(wholes, weights, share, cap)
    firsts = firsts.join(targets, "key").select("key", "bucket", "first", "source_size", "target", "turn")
    own = {c: free_name(sized, f"mix_{c}") for c in ("bucket", "first", "source_size", "target", "turn", "owner", "cut", "local")}
    local = W.partitionBy(source, own["cut"]).orderBy(key, size, n["mix_tie"]).rowsBetween(W.unboundedPreceding, -1)
    cut = sized.withColumn(own["cut"], bucket)
    cut = cut.withColumn(own["local"], F.coalesce(F.sum(size).over(local), F.lit(0)))
    firsts = firsts.select(F.col("key").alias(own["owner"]), *(F.col(c).alias(own[c]) for c in ("bucket", "first", "source_size", "target", "turn")))
    met = cut.join(firsts, (F.col(source) == F.col(own["owner"])) & (F.col(own["cut"]) == F.col(own["bucket"])))
    whole, goal, turn = F.col(own["source_size"]), F.col(own["target"]), F.col(own["turn"])
    before = F.col(own["local"]) + F.col(own["first"])
    passes = F.when(whole > 0, F.floor(goal / whole)).otherwise(0)
    rest = F.round(goal - passes * whole).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col(size), rest - before))

    def place(copy: int) -> Column:
        words = F.when(passes > copy, F.col(size)).when(passes == copy, part).otherwise(F.lit(0).cast("long"))
        middle = (F.lit(copy) * whole + before + words / 2) / goal
        position = None
        for i, knots in enumerate(schedules):
            at = invert_demand(middle, knots)
            position = F.when(turn % len(schedules) == i, at) if position is None else position.when(turn % len(schedules) == i, at)
        return F.struct(F.lit(copy).alias("copy"), words.alias("words"), position.alias("position"))

    copies = F.filter(F.array(*(place(i) for i in range(math.floor(cap) + 1))), lambda c: c["words"] > 0)
    out = met.withColumn(n["copies"], copies)
    taken = F.aggregate(n["copies"], F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return out.select(
        *kept, size, whole.alias(n["source_size"]), goal.alias(n["target"]), taken.alias(n["taken"]), n["copies"]
    )


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy, range-sorted by training position.

    Texts are never cut: the one document a source that the mix takes in part is taken whole
    where that part is at least half of it, else not at all in that pass; so a source's words
    are within half of that document of its target.
    """
    mixed = mix(docs, id_col, text_col, source_col, **options)
    size, copies = mixed.columns[-5], mixed.columns[-1]
    position = free_name(mixed, "position")
    whole = F.filter(copies, lambda c: 2 * c["words"] >= F.col(size))
    each = mixed.select(*docs.columns, F.explode(F.transform(whole, lambda c: c["position"])).alias(position))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartitionByRange(n, position, id_col).sortWithinPartitions(position, id_col).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the training position of their first copy; those not taken last."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs, keep=["doc_id"])
    position = F.get("copies", 0)["position"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", F.round(position, 6).alias("position"))
    return out.repartitionByRange(n, F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


_LIT = {
    i: " ".join(
        f"WHEN u < {after!r} OR {k + 1} = {len(_segments(knots))} THEN {time!r} + CASE WHEN u - {before!r} <= 0 THEN 0.0 ELSE "
        f"2.0 * (u - {before!r}) / ({weight!r} + sqrt(greatest({weight * weight!r} + {2 * slope!r} * (u - {before!r}), 0.0))) END"
        for k, (before, after, time, weight, slope) in enumerate(_segments(knots))
    )
    for i, knots in enumerate(SCHEDULES)
}

OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) AS turn FROM d GROUP BY source),
w AS (SELECT *, CASE turn WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
      - CAST(2.0 AS DOUBLE) * CAST(coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
      / CAST(sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev
  FROM w WINDOW f AS (ORDER BY CAST(2.0 AS DOUBLE) * source_size / w, source NULLS LAST)),
t AS (SELECT source, source_size, turn, least(CAST(2.0 AS DOUBLE) * source_size, w * max(lev) OVER ()) AS target FROM l),
b AS (
  SELECT d.*, t.source_size, t.target, t.turn,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS passes,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bef
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, greatest(0, least(size, CAST(round(target - passes * source_size) AS BIGINT) - bef)) AS part FROM b),
u AS (
  SELECT *, passes * size + part AS taken,
    (bef + CAST(CASE WHEN passes > 0 THEN size ELSE part END AS DOUBLE) / 2) / target AS u FROM p)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN round(least(CASE turn WHEN 0 THEN CASE {_LIT[0]} END WHEN 1 THEN CASE {_LIT[1]} END ELSE CASE {_LIT[2]} END END, 1.0), 6) END AS position
FROM u
"""
