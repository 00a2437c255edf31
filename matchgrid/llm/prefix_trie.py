"""Conversation prefix trie by prefix-doubling names.

Turns get dense names; two neighbouring blocks of 2^k turns make one of 2^(k+1), whose name
is that of the pair of names, so blocks of all powers of two are named in a logarithmic
number of join rounds. A prefix of d turns is a row of such blocks, one for each bit of d: its
name is that of the pair (prefix without the lowest bit's block, that block). Equal names
are equal prefixes, and prefixes grouped by name are the nodes.

What a node sums over its subtree is gathered in another logarithmic number of rounds: after
round k a node has the sum over what lies less than 2^k below it, and takes in next what
its descendants 2^k below it have. No step needs a conversation, or a node, in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrid.llm.common import WORD_PATTERN, forget, placed, table, write_table
from matchgrid.llm.merkle import CRC_TABLE_SQL, crc_sql

#: Conversations of a family share the first turns of its first one; SHARED remainders say how many.
FAMILY, SHARED = 20, 4
#: Ids that one chunk of a node's list of ends holds.
CHUNK = 512


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from its family's first."""
    return (F.crc32(conv.cast("string").cast("binary")) % SHARED).cast("long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(c, i, digest, words), stored: each conversation's turns by turn (null first), equal ones by digest; null conv_ids left out."""
    said = [F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text")]
    digest = F.unhex(F.sha2(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said).cast("binary"), 256))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("conv_id").cast("string").alias("g"), "turn", digest.alias("digest"),
        F.regexp_count(said[1], F.lit(WORD_PATTERN)).cast("long").alias("words"),
    )
    return write_table(placed(rows, "g", ["turn", "digest"], "turns").select("c", F.col("place").alias("i"), "digest", "words"), "ordered")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(c, i, digest, words) of the rebuilt conversations, and a row with null i for those without turns."""
    sizes = turns.groupBy("c").agg(F.count("*").alias("n"))
    bases = sizes.select(F.col("c").alias("b"), F.col("n").alias("m"))
    h = shared_turns(F.col("c"))
    convs = sizes.select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("b"))
    convs = convs.join(bases, "b", "left").withColumn("start", F.least("h", F.coalesce("m", F.lit(0))))
    convs = write_table(convs, "convs")
    first = turns.where(F.col("i") < SHARED - 1).select(F.col("c").alias("b"), "i", "digest", "words")
    lent = convs.select("c", "b", "start").join(first, "b").where("i < start").select("c", "i", "digest", "words")
    # a conversation may hold many of the turns; its one row is thin, and adaptive execution splits the turns
    kept = turns.join(convs.select("c", "h", "start"), "c").where("i >= h")
    kept = kept.select("c", (F.col("i") - F.col("h") + F.col("start")).alias("i"), "digest", "words")
    none = convs.where("n <= h and start = 0").select("c", *(F.lit(None).cast(t).alias(x) for x, t in (("i", "long"), ("digest", "binary"), ("words", "long"))))
    return lent.unionByName(kept).unionByName(none)


def named(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, the number from 1 of its ``key`` among the different ones; dense, in no order.

    Different keys are stored with their places in the tasks that found them; one row a
    task, its first number, is broadcast.
    """
    keys = write_table(rows.select(*key).distinct().withColumn("k", F.monotonically_increasing_id()), "names")
    part = F.shiftright("k", 33)
    counts = keys.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("part", earlier.alias("earlier"))
    dense = keys.withColumn("part", part).join(F.broadcast(firsts), "part")
    dense = dense.select(*key, (F.col("k").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("earlier") + 1).alias(name))
    return rows.join(dense, key)


def prefix_names(turns: DataFrame) -> DataFrame:
    """(c, d, name), stored, of ``turns(c, i, name)``: two prefixes of one length have one name if and only if they are equal."""
    longest = turns.agg(F.max("i")).first()[0]
    if longest is None:
        return turns.select("c", F.col("i").alias("d"), "name")
    blocks, ends = turns.select("c", F.col("i").alias("j"), "name"), []
    for k in range(int(longest + 1).bit_length()):
        if k:
            half = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.col("name")))
            pairs = blocks.groupBy("c", F.shiftright("j", 1).alias("j")).agg(half(0).alias("a"), half(1).alias("b")).where("b is not null")
            blocks = write_table(named(pairs, ["a", "b"], "name").select("c", "j", "name"), "blocks")
        # a prefix ends with the block of its lowest bit, which has an even number
        ends.append(blocks.where("j % 2 = 0").select("c", F.shiftleft(F.col("j") + 1, k).alias("d"), F.col("name").alias("last")))
    ends = write_table(reduce(DataFrame.union, ends), "ends")
    bits = F.bit_count("d")
    done = [write_table(named(ends.where(bits == 1).withColumn("before", F.lit(0).cast("long")), ["d", "last"], "name").select("c", "d", "name"), "prefixes")]
    for k in range(2, int(longest + 1).bit_length() + 1):
        shorter = done[-1].select("c", F.col("d").alias("e"), F.col("name").alias("before"))
        met = ends.where(bits == k).withColumn("e", F.col("d").bitwiseAND(F.col("d") - 1)).join(shorter, ["c", "e"])
        done.append(write_table(named(met, ["d", "before", "last"], "name").select("c", "d", "name"), "prefixes"))
    return reduce(DataFrame.union, done)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, depth, first, ids) of sorted (conv_id, depth, c): ids joined by commas, up to ``CHUNK`` in a row."""
    for batch in batches:
        v, d, c = (batch.column(i).to_numpy() for i in range(3))
        if not len(c):
            continue
        new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (d[1:] != d[:-1])])
        spans = [(a, min(a + CHUNK, e)) for s, e in zip(new, [*new[1:], len(c)], strict=True) for a in range(s, e, CHUNK)]
        at = np.array([a for a, _ in spans])
        ids = [",".join(map(str, c[a:e].tolist())) for a, e in spans]
        yield pa.RecordBatch.from_arrays([pa.array(v[at]), pa.array(d[at]), pa.array(c[at]), pa.array(ids)], names=["v", "d", "first", "ids"])


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, depth, digest) of sorted chunks; a node's hash takes them in as they come."""
    last, state, found = None, None, []
    names = ["v", "d", "digest"]
    rows = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=names)
    for batch in batches:
        for v, d, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (v, d) != last:
                if last is not None:
                    found.append((*last, state.hexdigest()))
                last, state = (v, d), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield rows()
        found.clear()
    if last is not None:
        found.append((*last, state.hexdigest()))
    yield rows()


def ends_digests(ends: DataFrame) -> DataFrame:
    """(v, d, digest): SHA-256 of each node's ``ends(v, d, c)``, ascending and comma-joined.

    A digest is serial by nature. Ids are range-sorted and joined to chunks first, so that
    one task takes in a node's chunks, not its rows, and holds nothing but the hash's state.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.select("v", "d", "c").repartitionByRange(n, "v", "d", "c").sortWithinPartitions("v", "d", "c")
    chunks = ranged.mapInArrow(_chunks, "v long, d long, first long, ids string")
    return chunks.repartition("v", "d").sortWithinPartitions("v", "d", "first").mapInArrow(_hash_chunks, "v long, d long, digest string")


def subtree_sums(nodes: DataFrame, places: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """``nodes(v, d, values)`` with each value summed over the subtree; ``places(c, d, v)`` names the node of every prefix."""
    for k in range(deepest.bit_length()):
        up = nodes.where(F.col("d") >= 1 << k).select(F.col("v").alias("c"), (F.col("d") - (1 << k)).alias("d"), *values)
        below = up.join(places, ["c", "d"]).groupBy("v", "d").agg(*(F.sum(x).alias(f"{x}_") for x in values))
        added = nodes.join(below, ["v", "d"], "left").select("v", "d", *((F.col(x) + F.coalesce(f"{x}_", F.lit(0))).alias(x) for x in values))
        new = write_table(added, "sums")
        forget(nodes)
        nodes = new
    return nodes


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of ``turns(c, i, digest, words)``, conversation ``c``'s turns numbered from 0 without gaps.

    A null ``i`` stands for a conversation without turns, a member of the root. Columns, all
    long but the last: conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the
    subtree, members but one times the words of the node's last turn), ends_sha256 (of the
    conversations that end there, ascending, comma-joined). Without conversations there is
    no root. Equal conversations are members of the same nodes.
    """
    turns = write_table(turns, "rebuilt")
    symbols = write_table(named(turns.where("i is not null"), ["digest"], "name").select("c", "i", "name", "words"), "symbols")
    root = turns.select("c").distinct().select("c", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("name"))
    prefixes = write_table(root.union(prefix_names(symbols.select("c", "i", "name")).select("c", "d", "name")), "prefixes")
    nodes = write_table(prefixes.groupBy("d", "name").agg(F.min("c").alias("v"), F.count("*").alias("n")), "nodes")
    places = write_table(prefixes.join(nodes.select("d", "name", "v"), ["d", "name"]).select("c", "d", "v"), "places")
    forget(prefixes)

    words = symbols.select(F.col("c").alias("v"), (F.col("i") + 1).alias("d"), "words")
    above = places.select(F.col("c").alias("v"), (F.col("d") + 1).alias("d"), F.col("v").alias("parent"))
    full = nodes.join(above, ["v", "d"], "left").join(words, ["v", "d"], "left")
    full = write_table(full.select("v", "d", "n", "parent", ((F.col("n") - 1) * F.coalesce("words", F.lit(0))).alias("saved")), "full")
    children = full.where("parent is not null").groupBy(F.col("parent").alias("v"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("children"))
    full = write_table(full.join(children, ["v", "d"], "left").withColumn("children", F.coalesce("children", F.lit(0))), "nodes")

    deepest = full.agg(F.max("d")).first()[0] or 0
    own = full.select("v", "d", F.when(F.col("children") == 0, 1).otherwise(0).cast("long").alias("leaves"), "saved")
    sums = subtree_sums(own, places, ["leaves", "saved"], deepest)
    last = places.groupBy("c").agg(F.max("d").alias("d"))
    digests = ends_digests(last.join(places, ["c", "d"]))
    out = full.drop("saved").join(sums, ["v", "d"]).join(digests, ["v", "d"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("v").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.lit(nothing)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(ordered_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


OP12_SQL = f"""
WITH {CRC_TABLE_SQL},
s AS (SELECT conv_id AS c, turn, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, sha256(s) AS x, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(s)) - 1 AS i FROM s),
k AS (SELECT c, c - c % {FAMILY} AS b, {crc_sql("CAST(c AS VARCHAR)")} % {SHARED} AS h FROM (SELECT DISTINCT c FROM s), crc),
r AS (
  SELECT c, x, w, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d FROM (
    SELECT k.c, 0 AS own, i, x, w FROM k JOIN t ON t.c = k.b WHERE i < h UNION ALL SELECT k.c, 1, i, x, w FROM k JOIN t ON t.c = k.c WHERE i >= h)),
p AS (SELECT c, 0 AS d, '' AS key, 0 AS w FROM k UNION ALL SELECT c, d, string_agg(x, '') OVER (PARTITION BY c ORDER BY d), w FROM r),
n AS (SELECT d, key, min(c) AS v, count(*) AS n, any_value(w) AS w FROM p GROUP BY d, key),
ch AS (SELECT left(key, (d - 1) * 64) AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
a AS (
  SELECT left(n.key, u * 64) AS key, sum((n.n - 1) * n.w) AS saved_tokens, count(*) FILTER (ch.key IS NULL) AS n_leaves
  FROM (SELECT *, unnest(range(d + 1)) AS u FROM n) n LEFT JOIN ch ON ch.key = n.key GROUP BY ALL),
e AS (SELECT key, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(key, d) AS key FROM p GROUP BY c) GROUP BY key)
SELECT n.v AS conv_id, CAST(n.d AS BIGINT) AS depth, q.v AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN a USING (key) LEFT JOIN n q ON n.d > 0 AND q.key = left(n.key, (n.d - 1) * 64) LEFT JOIN ch ON ch.key = n.key LEFT JOIN e ON e.key = n.key
"""
