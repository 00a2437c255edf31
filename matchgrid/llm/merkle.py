"""Merkle manifest of a dataset, with an authentication path for every row.

A row's leaf is the SHA-256 of its fields. The leaves of a group (a language) in order form a
binary tree whose last, lone nodes are hashed alone; the groups' roots form another, whose
root names the whole dataset. Digests are hashed as lower-case hex text.

1. Leaves are range-sorted and numbered, so that no group lands in one task.
2. Aligned blocks of ``1 << BLOCK_BITS`` leaves are traversed one by one, by the fractal
   traversal of Jakobsson, Leighton, Micali and Szydlo (2003): stacked subtrees of ``SUBTREE``
   levels exist around the current leaf, and the ones desired next grow by two steps a leaf.
3. The blocks' roots are the leaves of the next round of blocks, up to the groups' roots and
   then the dataset's. Each block's path above it is joined to its rows' paths within it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.llm.common import forget, placed, table, write_table

BLOCK_BITS = 10
#: Levels of a stacked subtree.
SUBTREE = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def parent(left: bytes | None, right: bytes | None) -> bytes | None:
    """A lone node is hashed alone; where there is nothing, there is nothing above."""
    return None if left is None else digest_of(left + right if right is not None else left)


def height_of(n: int) -> int:
    """Levels above ``n`` leaves."""
    return (n - 1).bit_length()


class Growing:
    """A subtree above leaves ``first`` to ``first + (1 << top)``, hashed from its leaves step by step; nodes from height ``low`` to below ``top`` stay."""

    def __init__(self, leaves: Sequence[bytes], first: int, low: int, top: int):
        self.leaves, self.next, self.end, self.low, self.top = leaves, first, first + (1 << top), low, top
        self.stack: list[tuple[int, int, bytes | None]] = []
        self.nodes: dict[tuple[int, int], bytes | None] = {}

    def step(self) -> bool:
        """A leaf, or a parent of two nodes; False when the subtree is whole."""
        if len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
            (_, _, right), (height, at, left) = self.stack.pop(), self.stack.pop()
            node = (height + 1, at >> 1, parent(left, right))
        elif self.next < self.end:
            node = (0, self.next, self.leaves[self.next] if self.next < len(self.leaves) else None)
            self.next += 1
        else:
            return False
        self.stack.append(node)
        if self.low <= node[0] < self.top:
            self.nodes[node[:2]] = node[2]
        return True


def traverse(leaves: Sequence[bytes], height: int, subtree: int = SUBTREE) -> tuple[bytes | None, Iterator[list[bytes]]]:
    """(root, the authentication path of each leaf in turn): siblings from the leaf up, absent ones left out.

    Beside the leaves it holds two subtrees and a stack a level of subtrees, whatever the height.
    """
    whole = Growing(leaves, 0, 0, height)
    cuts = [(low, min(low + subtree, height)) for low in range(0, height, subtree)]
    existing: list[dict] = [{} for _ in cuts]
    kept = set()
    while whole.step():
        h, at, digest = whole.stack[-1]
        if h < height:
            k = h // subtree
            if at >> (cuts[k][1] - h) == 0 and (h, at) not in kept:
                existing[k][h, at] = digest
        whole.nodes.clear()
    root = whole.stack[-1][2]

    def paths() -> Iterator[list[bytes]]:
        desired = [Growing(leaves, 1 << top, low, top) for low, top in cuts[:-1]]
        for leaf in range(len(leaves)):
            found = (existing[h // subtree][h, (leaf >> h) ^ 1] for h in range(height))
            yield [x for x in found if x is not None]
            for k, grows in enumerate(desired):
                _ = grows.step() and grows.step()
                top = cuts[k][1]
                if (leaf + 1) & ((1 << top) - 1) == 0:
                    existing[k] = grows.nodes
                    desired[k] = Growing(leaves, leaf + 1 + (1 << top), *cuts[k])

    return root, paths()


def _blocks(group_at: int, place_at: int, leaf_at: int):
    """A block's rows with their paths within it, and its root at the first."""

    def run(block: pa.Table) -> pa.Table:
        block = block.take(pa.array(np.argsort(block.column(place_at).to_numpy(), kind="stable")))
        first = block.column(place_at)[0].as_py()
        leaves = [x.encode() for x in block.column(leaf_at).to_pylist()]
        # the lone block of a small group ends where one node remains
        height = BLOCK_BITS if first or len(leaves) == 1 << BLOCK_BITS else height_of(len(leaves))
        root, paths = traverse(leaves, height)
        tops = [root.decode(), *[None] * (len(leaves) - 1)]
        found = [bytes.fromhex(b"".join(p).decode()) for p in paths]
        return block.append_column("path", pa.array(found, pa.binary())).append_column("top", pa.array(tops, pa.string()))

    return run


def _level(rows: DataFrame, tag: str) -> DataFrame:
    """``rows(g, place, leaf, ...)`` with path and top, stored."""
    schema = rows.limit(0).select("*", F.lit(b"").cast("binary").alias("path"), F.lit(None).cast("string").alias("top")).schema
    dealt = rows.groupBy("g", F.shiftright("place", BLOCK_BITS).alias("block"))
    at = [rows.columns.index(c) for c in ("g", "place", "leaf")]
    return write_table(dealt.applyInArrow(_blocks(*at), schema), tag)


def _above(level: DataFrame) -> DataFrame:
    """The blocks' roots as leaves of the next level."""
    return level.where("top is not null").select("g", F.shiftright("place", BLOCK_BITS).alias("place"), F.col("top").alias("leaf"))


def _climb(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((g, block, more): the path above each block of ``rows``, up to its group's root; (g, leaf): the groups' roots).

    Each round has a ``1 << BLOCK_BITS``-th of the rows of the one before.
    """
    more, nodes = None, _above(rows)
    levels = []
    while nodes.where("place > 0").limit(1).count():
        levels.append(_level(nodes, "upper"))
        nodes = _above(levels[-1])
    for level in reversed(levels):
        own = level.select("g", F.col("place").alias("block"), "path")
        if more is not None:
            over = more.select("g", F.col("block").alias("b"), "more")
            own = own.withColumn("b", F.shiftright("block", BLOCK_BITS)).join(over, ["g", "b"]).withColumn("path", F.concat("path", "more"))
        more = own.select("g", "block", F.col("path").alias("more"))
    if more is None:
        more = nodes.select("g", F.col("place").alias("block"), F.lit(b"").cast("binary").alias("more"))
    return more, nodes.select("g", "leaf")


def fold(leaf: bytes, place: int, n: int, siblings: Iterator[bytes]) -> bytes:
    """The root that a leaf at ``place`` of ``n`` has with its present siblings, from the leaf up."""
    for h in range(height_of(n)):
        at = place >> h
        if at & 1:
            leaf = digest_of(next(siblings) + leaf)
        elif at + 1 < -(-n >> h):
            leaf = digest_of(leaf + next(siblings))
        else:
            leaf = digest_of(leaf)
    return leaf


def _prover(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "row"}
            proofs, folded, right = [], [], []
            for i in range(batch.num_rows):
                path = col["path"][i] + col["more"][i] + col["last"][i]
                hexed = path.hex().encode()
                siblings = iter([hexed[k : k + 64] for k in range(0, len(hexed), 64)])
                proofs.append(hashlib.sha256(hexed).hexdigest())
                sub = fold(col["claim"][i].encode(), col["place"][i], col["n"][i], siblings)
                folded.append(fold(sub, col["g_place"][i], col["groups"][i], siblings).decode())
                right.append(folded[-1] == col["root"][i])
            same = [batch.column(c) for c in ("row", "leaf", "subroot", "root")]
            siblings = [a + b + c for a, b, c in zip(col["path"], col["more"], col["last"], strict=True)]
            made = [pa.array(siblings, pa.binary()), pa.array(proofs), pa.array(folded), pa.array(right, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*same, *made], names=names)

    return run


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256, as hex, of the columns one after another: ``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def prove(rows: DataFrame, leaf: Column, group: Column, order: str, claim: Column | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """(row, leaf, subroot, root, siblings, proof_sha256, folded_root, verified), one row each of ``rows``.

    row: a struct of the columns ``keep`` (all where none are named), so no name can clash.
    leaf: the row's digest (hex). Leaves of one ``group`` (a string) ascend by ``order``,
    nulls first, those of equal order by leaf; groups ascend by their UTF-8 bytes, a null
    group first. siblings: the digests, 32 bytes each, from the leaf's to the root's, absent
    ones left out. folded_root: the root that ``claim`` (another digest of the row, such as
    that of a copy whose bytes are checked; the leaf itself where null) has with them;
    verified: whether that is the root. Repeated rows are leaves of their own, and where
    their order is the same, any of them takes either place. An empty table gives an empty table.
    """
    kept = list(rows.columns) if keep is None else list(keep)
    g = F.when(group.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), group.cast("string")))
    thin = rows.select(F.struct(*kept).alias("row"), g.alias("g"), F.col(order).alias("o"), leaf.alias("leaf"), (F.lit(None).cast("string") if claim is None else claim).alias("claim"))
    thin = placed(thin, "g", ["o", "leaf"], "leaves")
    paths = _level(thin.select("row", "g", "leaf", F.coalesce("claim", "leaf").alias("claim"), "place"), "paths")
    forget(thin)
    more, subroots = _climb(paths)

    tops = placed(subroots.withColumn("all", F.lit("")), "all", ["g"], "subroots")
    last = _level(tops.select(F.col("all").alias("g"), "place", "leaf", F.col("g").alias("key")), "groups")
    more_last, roots = _climb(last)
    root = roots.select(F.col("leaf").alias("root"))
    groups = last.withColumn("block", F.shiftright("place", BLOCK_BITS)).join(more_last, ["g", "block"])
    sizes = paths.groupBy("g").agg(F.count("*").alias("n"))
    count = last.agg(F.count("*").alias("groups"))
    groups = groups.select(F.col("key").alias("g"), F.col("place").alias("g_place"), F.col("leaf").alias("subroot"), F.concat("path", "more").alias("last"))
    # the one row of each of these two is all that is sent
    groups = groups.join(sizes, "g").crossJoin(F.broadcast(root)).crossJoin(F.broadcast(count))
    blocks = write_table(more.join(groups, "g"), "above")
    met = paths.withColumn("block", F.shiftright("place", BLOCK_BITS)).join(blocks, ["g", "block"])
    names = ["row", "leaf", "subroot", "root", "siblings", "proof_sha256", "folded_root", "verified"]
    schema = met.limit(0).select("row", "leaf", "subroot", "root", F.lit(b"").cast("binary").alias("siblings"), *(F.lit("").alias(c) for c in names[5:7]), F.lit(True).alias("verified")).schema
    used = met.select("row", "leaf", "claim", "place", "path", "more", "last", "subroot", "root", "n", "g_place", "groups")
    return used.mapInArrow(_prover(names), schema)


def tampered(id_col: str = "doc_id") -> Column:
    """Whether 7 divides the CRC-32 of the id as text; null ids are left alone."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 0, F.lit(False))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    fields = {c: F.col(c) for c in FIELDS}
    forged = leaf_digest([(fields | {"n_chars": F.col("n_chars") + 1})[c] for c in FIELDS])
    out = prove(docs, leaf_digest([fields[c] for c in FIELDS]), F.col("lang"), "doc_id", F.when(tampered(), forged), ["doc_id"])
    return out.select("row.doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = " || ".join(_FIELD.format(c) for c in FIELDS)

#: (c, i): the CRC-32 table as a list, and of a short ASCII text.
CRC_TABLE_SQL = "crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"


def crc_sql(text: str) -> str:
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
d AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS leaf,
    CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN sha256({_LEAF.replace("n_chars", "(n_chars + 1)")}) END AS forged FROM documents, crc),
p AS (SELECT *, coalesce('s' || lang, 'n') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
tree AS (
  SELECT g, 0 AS h, place AS pos, leaf AS x, count(*) OVER (PARTITION BY g) AS n FROM p
  UNION ALL SELECT g, h + 1, pos // 2, sha256(string_agg(x, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, h, pos // 2),
subs AS (SELECT g, x, h, row_number() OVER (ORDER BY g) - 1 AS place FROM tree WHERE n = 1),
up AS (
  SELECT 0 AS h, place AS pos, x, count(*) OVER () AS n FROM subs
  UNION ALL SELECT h + 1, pos // 2, sha256(string_agg(x, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY h, pos // 2),
root AS (SELECT x AS root, h AS top FROM up WHERE n = 1),
steps AS (
  SELECT p.doc_id, p.g, p.place, l.h, (p.place >> l.h) & 1 AS odd, t.x AS sibling FROM p JOIN (SELECT DISTINCT g, h FROM tree WHERE n > 1) l USING (g)
    LEFT JOIN tree t ON t.g = p.g AND t.h = l.h AND t.pos = xor(p.place >> l.h, 1)
  UNION ALL SELECT p.doc_id, p.g, p.place, s.h + l.h, (s.place >> l.h) & 1, t.x FROM p JOIN subs s USING (g), (SELECT DISTINCT h FROM up WHERE n > 1) l
    LEFT JOIN up t ON t.h = l.h AND t.pos = xor(s.place >> l.h, 1)),
folded AS (
  SELECT g, place, 0 AS h, coalesce(forged, leaf) AS x FROM p
  UNION ALL SELECT f.g, f.place, f.h + 1, sha256(CASE WHEN sibling IS NULL THEN x WHEN odd = 1 THEN sibling || x ELSE x || sibling END)
  FROM folded f JOIN steps s ON s.g = f.g AND s.place = f.place AND s.h = f.h),
proofs AS (SELECT g, place, sha256(coalesce(string_agg(sibling, '' ORDER BY h), '')) AS proof_sha256 FROM (SELECT p.g, p.place, s.h, s.sibling FROM p LEFT JOIN steps s ON s.g = p.g AND s.place = p.place) GROUP BY g, place)
SELECT p.doc_id, p.leaf, s.x AS subroot, root, proof_sha256, f.x AS folded_root, f.x = root AS verified
FROM p JOIN subs s USING (g) JOIN proofs q ON q.g = p.g AND q.place = p.place JOIN folded f ON f.g = p.g AND f.place = p.place, root
WHERE f.h = s.h + root.top
"""
