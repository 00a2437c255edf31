"""MinHash near-duplicates: one-permutation sketches, star-shaped candidates, exact confirmation.

1. Every row's set of five-word shingles becomes 64-bit hashes. Rows of equal
   sets form one class before anything is compared, so exact copies cost nothing.
2. One permutation fills ``BINS`` bins; empty bins borrow from bins that a
   universal hash picks (optimal densification). ``BANDS`` bands of bins are buckets.
3. A bucket of k classes gives k - 1 edges: each class to the bucket's hub. What a star
   leaves apart is settled by a bound on shingles or compared exactly in blocks.
4. Edges are confirmed on the full sets. Components of confirmed edges are the groups.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.llm.common import connected_components, forget, free_name, table, write_table

WORDS = 5
BINS = 128
BANDS = 32
#: A pair is linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Classes of a block; a task compares two blocks of a family exactly.
BLOCK = 512
#: Entries of a worker's word cache; it is emptied when full.
WORD_CACHE = 200_000

_M = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_WORD_MULT = _stream(11, WORDS) | np.uint64(1)
_BAND_MULT = _stream(12, BINS // BANDS) | np.uint64(1)
_BAND_SALT = _stream(13, BANDS)
_BITS = BINS.bit_length() - 1
_SHIFT = np.uint64(64 - _BITS)
_STARTS = np.arange(BINS, dtype=np.uint64) << _SHIFT
_PROBES = (_stream(14, BINS * 1024) >> _SHIFT).astype(np.int64).reshape(BINS, 1024)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; empty without words.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` cuts at U+0020 and
    U+0009 to U+000D only.
    """
    parts = text.lower().split() if text else []
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), seed=n)], np.uint64)
    if len(words) > WORD_CACHE:
        words.clear()
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, n)
    m = n - WORDS + 1
    total = h[:m] * _WORD_MULT[0]
    for i in range(1, WORDS):
        total += h[i : i + m] * _WORD_MULT[i]
    total = _mix(total)
    total.sort()
    return total[np.r_[True, total[1:] != total[:-1]]]


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """Band keys of a non-empty sorted shingle set."""
    at = np.searchsorted(shingles, _STARTS)
    value = shingles[np.minimum(at, len(shingles) - 1)]
    full = (at < len(shingles)) & ((value >> _SHIFT) == np.arange(BINS, dtype=np.uint64))
    if not full.all():
        empty = np.flatnonzero(~full)
        hit = full[_PROBES[empty]]
        first = hit.argmax(axis=1)
        donor = _PROBES[empty, first]
        lost = ~hit[np.arange(len(empty)), first]
        if lost.any():  # no probe met a full bin: the first full one
            donor[lost] = np.flatnonzero(full)[0]
        value[empty] = value[donor]
    rows = value.reshape(BANDS, -1) * _BAND_MULT
    return _mix(rows.sum(axis=1, dtype=np.uint64) + _BAND_SALT).view(np.int64)


def _sketcher(text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes, digests, bands = [], [], []
            for text in batch.column(text_at).cast(pa.binary()):
                s = shingle_set(text.as_py(), words)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(bands_of(s) if len(s) else None)
            rows = pa.array(np.arange(row, row + batch.num_rows, dtype=np.int64))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, rows, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=names,
            )

    return run


def _confirmer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        kept: OrderedDict[int, np.ndarray] = OrderedDict()
        held = 0
        for batch in batches:
            us, vs = [], []
            cols = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
            tu, tv = (batch.column(i).cast(pa.binary()) for i in (2, 3))
            for i, (u, v) in enumerate(zip(*cols, strict=True)):
                b = kept.get(v)
                if b is None:
                    b = kept[v] = shingle_set(tv[i].as_py(), words)
                    held += len(b)
                    while held > 4_000_000 and len(kept) > 1:
                        held -= len(kept.popitem(last=False)[1])
                a = shingle_set(tu[i].as_py(), words)
                common = len(a) + len(b) - len(np.union1d(a, b))
                if 100 * common >= percent * (len(a) + len(b) - common):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Every row of ``docs`` with its group: all columns, then n_shingles, component_id, kept, keeper.

    component_id: the smallest id that links reach, itself included. kept: the row's
    id is that id. keeper: true for exactly one row of each group, also where rows
    repeat an id. Null and empty texts (or white space alone) have no shingles and
    link with nothing; each such row is a group of its own. A null id never becomes
    component_id unless the whole group has none (then null, kept is false). An empty
    table gives an empty table. Added columns take a leading underscore where ``docs``
    has the name already.
    """
    names = {k: free_name(docs, k) for k in ("n_shingles", "component_id", "kept", "keeper", "row_key", "set_digest", "bands")}
    added = f"{names['row_key']} long, {names['n_shingles']} long, {names['set_digest']} binary, {names['bands']} array<long>"
    schema = docs.limit(0).selectExpr("*", *(f"cast(null as {x.split(' ')[1]}) as `{x.split(' ')[0]}`" for x in added.split(", "))).schema
    base = write_table(docs.mapInArrow(_sketcher(docs.columns.index(text_col), schema.names), schema), "sketch")
    key, digest, n = names["row_key"], names["set_digest"], names["n_shingles"]

    thin = base.where(f"`{n}` > 0").select(F.col(key).alias("r"), F.col(n).alias("n"), F.col(digest).alias("d"), F.col(names["bands"]).alias("b"))
    first = thin.groupBy("d").agg(F.min("r").alias("node"))
    rows = write_table(thin.join(first, "d").select("r", "node", "n", F.when(F.col("r") == F.col("node"), F.col("b")).alias("b")), "classes")

    texts = base.select(F.col(key).alias("r"), F.col(text_col).cast("string").alias("t"))
    comp = _links(rows.where("b is not null"), texts, percent)
    groups = rows.select("r", "node").join(comp, "node", "left").select("r", F.coalesce("component", "node").alias("g"))
    tagged = base.select(F.col(key).alias("r"), F.col(id_col).alias("i")).join(groups, "r", "left").withColumn("g", F.coalesce("g", "r"))
    heads = tagged.groupBy("g").agg(F.min(F.struct(F.col("i").isNull().alias("x"), "i", "r")).alias("h"))
    verdict = tagged.select("r", "g").join(heads, "g").select(
        F.col("r").alias(key), F.col("h.i").alias(names["component_id"]), (F.col("r") == F.col("h.r")).alias(names["keeper"])
    )
    verdict = write_table(verdict, "verdict")
    forget(rows, comp)  # the result reads the texts and this
    out = base.drop(digest, names["bands"]).join(verdict, key)
    same = F.coalesce(F.col(id_col) == F.col(names["component_id"]), F.lit(False))
    return out.select(*docs.columns, n, names["component_id"], same.alias(names["kept"]), names["keeper"])


def _links(classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(node, component) over confirmed links that join all linked classes sharing a bucket.

    First a star a bucket: its members against its hub, the member whose buckets hold most
    (an original before its copies). That joins groups of copies at one edge a member.
    Buckets that still hold two components are open. The shingles of a class that occur in
    another open component at all bound any further intersection, which settles most
    classes; the others are compared exactly within families of buckets that share
    members, in blocks. No step gives the pairs of a bucket, and no pair that could join
    two components goes unjudged.
    """
    members = classes.select("node", "n", F.explode("b").alias("k"))
    shared = members.groupBy("k").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("w")).where("lo <> hi").select("k", "w")
    written = members = write_table(members.join(shared, "k").select("k", "node", "n", "w"), "buckets")
    # the one shuffle of whole texts; a merge join at every size, as the side that picks them grows with the corpus
    nodes = members.select(F.col("node").alias("r")).distinct()
    texts = write_table(texts.join(nodes.hint("merge"), "r", "left_semi"), "texts")
    order = members.groupBy("node").agg((-F.sum("w")).alias("o"))
    members = members.join(order, "node")
    hubs = members.groupBy("k").agg(F.min(F.struct("o", "node", "n")).alias("h")).select("k", F.col("h.node").alias("hub"), F.col("h.n").alias("m"))
    near = (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (F.col("node") != F.col("hub"))
    edges = members.join(hubs, "k").where(near).select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    found = (
        edges.hint("merge")
        .join(texts.select(F.col("r").alias("u"), F.col("t").alias("tu")), "u")
        .hint("merge")
        .join(texts.select(F.col("r").alias("v"), F.col("t").alias("tv")), "v")
        .select("u", "v", "tu", "tv")
        .mapInArrow(_confirmer(percent), "u long, v long")
    )
    found = write_table(found, "links")
    star = connected_components(found)
    forget(found)

    label = members.select("k", "node").join(star, "node", "left").select("k", "node", F.coalesce("component", "node").alias("g"))
    label = write_table(_open(label), "open")
    forget(written)
    if not label.limit(1).count():  # the stars have joined all that meet
        forget(label, texts)
        return star
    nodes = label.select("node", "g").distinct()
    sets = texts.join(nodes, F.col("r") == F.col("node")).select("node", "g", "t").mapInArrow(_shingler, "node long, g long, x array<long>")
    sets = write_table(sets, "sets")
    forget(texts)
    each = sets.select("node", "g", F.explode("x").alias("x"))
    wide = each.groupBy("x").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 <> g1").select("x")
    common = each.join(wide, "x").groupBy("node").agg(F.count("*").alias("c"))
    able = sets.join(common, "node").where(F.col("c") * 100 >= F.size("x") * percent).select("node")
    label, old = write_table(_open(label.join(able, "node").select("k", "node", "g")), "open"), label
    forget(old)
    if not label.limit(1).count():  # what meets is too little to be a link
        forget(label, sets)
        return star
    low = label.groupBy("k").agg(F.min("node").alias("v"))
    families = connected_components(label.join(low, "k").select(F.col("node").alias("u"), "v"))
    family = families.select("node", F.col("component").alias("f"))
    parts = family.groupBy("f").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    dealt = sets.join(family.join(parts, "f"), "node").withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("f", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "b", "node", "g", "x")
    rest = dealt.groupBy("f", "b1", "b2").applyInArrow(_comparer(percent), "u long, v long")
    rest = write_table(rest, "links")
    out = connected_components(rest.union(star.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    forget(label, sets, families, rest, star)
    return out


def _open(label: DataFrame) -> DataFrame:
    """Members of buckets that hold two components at least."""
    still = label.groupBy("k").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 <> g1").select("k")
    return label.join(still, "k").select("k", "node", "g")


def _shingler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        sets = [shingle_set(t.as_py(), words).view(np.int64) for t in batch.column(2).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["node", "g", "x"])


def _comparer(percent: int):
    """Links that join different components among one or two blocks of a family, found by exact intersections."""

    def run(group: pa.Table) -> pa.Table:
        one = group.column("b1")[0].as_py() == group.column("b2")[0].as_py()
        node, g, block = (group.column(c).to_numpy() for c in ("node", "g", "b"))
        lists = group.column("x").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(np.array(lists.value_lengths()))
        sets = np.split(flat, ends[:-1])
        size = np.array([len(x) for x in sets])
        head = {int(c): int(c) for c in g}

        def top(c: int) -> int:
            while head[c] != c:
                head[c] = head[head[c]]
                c = head[c]
            return c

        first = np.flatnonzero(block == block.min())
        second = first if one else np.flatnonzero(block != block.min())
        value = np.concatenate([sets[i] for i in second]) if len(second) else flat[:0]
        owner = np.repeat(np.arange(len(second)), size[second])
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        us, vs = [], []
        for i in first:
            lo, hi = np.searchsorted(value, sets[i], "left"), np.searchsorted(value, sets[i], "right")
            n = hi - lo
            at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(second))
            for j in second[100 * common >= percent * (size[i] + size[second] - common)]:
                p, q = top(int(g[i])), top(int(g[j]))
                if p != q:
                    head[p] = q
                    us.append(int(node[i]))
                    vs.append(int(node[j]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
