"""Embedding near-duplicates: an exact metric range join over pivots.

On unit vectors a cosine of at least c is a distance of at most ``sqrt(2 - 2c)``, and
the triangle inequality says how far from a cell's border a partner can lie.

1. Equal vectors of a label form one class with a multiplicity.
2. Pivots (a bounded hash sample of each large label) cut a label's space into cells; a
   class lives in the cell of its nearest pivot. It is copied into an earlier cell only if
   the half-way plane between the two pivots is within reach and the cell's own radius
   comes that near, so each pair meets in one cell: the earlier of its two.
3. Cells join independently. A cell above ``BLOCK`` classes is dealt over pairs of hash
   blocks, of which one at least holds classes that live there, so no task holds more than
   two blocks. A task returns one row per member: its links and the head of its component
   in the task, never pairs.

Vectors without structure lie near every border when the reach is wide (0.2 at a cosine of
0.98), so cells are as large as two tasks' blocks allow: smaller ones would copy more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.llm.common import connected_components, forget, free_name, table, write_table

COSINE = 0.98
#: Most pivots over all labels (the bound of what is broadcast: MAX_PIVOTS vectors), and classes a cell should get.
MAX_PIVOTS = 1024
CELL = 4096
#: Classes of a block; a task compares two blocks.
BLOCK = 8192
#: Rows whose distances to all pivots are held at once.
ROWS = 1024
#: Room for rounding in what is copied over a border.
SLACK = 1e-6
#: Pivots lie farther apart than this, so that rounding in squared distances (about 1e-15), over the gap, stays far below SLACK.
APART = 1e-3


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Double vectors; None for what links with nothing: null, empty, zero, or with null or non-finite components."""
    found = []
    for x in column:
        v = x.values if x.is_valid else None
        if v is None or len(v) == 0 or v.null_count:
            found.append(None)
            continue
        v = v.to_numpy(zero_copy_only=False).astype(np.float64)
        found.append(v if np.isfinite(v).all() and v.any() else None)
    return found


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def _digester(vec_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            vectors = _vectors(batch.column(vec_at))
            rows = pa.array(np.arange(row, row + batch.num_rows, dtype=np.int64))
            row += batch.num_rows
            digests = [None if v is None else xxhash.xxh3_128_digest((v + 0.0).tobytes()) for v in vectors]
            units = [None if v is None else _unit(v) for v in vectors]
            more = [rows, pa.array(digests, pa.binary()), pa.array(units, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)

    return run


def _spread(p: np.ndarray) -> np.ndarray:
    """The rows of ``p``, in order, but for those within ``APART`` of one already taken."""
    taken = np.empty_like(p)
    n = 0
    for v in p:
        d = taken[:n] - v
        if not n or np.einsum("ij,ij->i", d, d).min() > APART * APART:
            taken[n] = v
            n += 1
    return taken[:n]


Pivots = dict[tuple, np.ndarray]


def _by_label(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """((label, dimension), places, vectors) of a batch (label, node, m, v), at most ``ROWS`` at a time."""
    places: dict[tuple, list[int]] = {}
    values = batch.column(3)
    for i, key in enumerate(zip(batch.column(0).to_pylist(), values.value_lengths().to_pylist(), strict=True)):
        places.setdefault(key, []).append(i)
    for key, every in places.items():
        for at in range(0, len(every), ROWS):
            some = every[at : at + ROWS]
            yield key, np.array(some), values.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(-1, key[1])


def _homes(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to the pivots, and the nearest pivot."""
    d2 = np.maximum(2 - 2 * x @ p.T, 0)
    return d2, d2.argmin(axis=1)


def _measurer(pivots: Pivots):
    """(label, dim, cell, r): how far a batch's classes lie from their pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far: dict[tuple, float] = {}
            for (label, dim), _, x in _by_label(batch):
                p = pivots.get((label, dim))
                if p is not None:
                    d2, home = _homes(x, p)
                    for c in np.unique(home).tolist():
                        far[label, dim, c] = max(far.get((label, dim, c), 0.0), float(np.sqrt(d2[home == c, c].max())))
            cols = [list(c) for c in zip(*(k for k in far))] or [[], [], []]
            types = [batch.schema.field(0).type, pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.array(list(far.values()), pa.float64())], names=["label", "dim", "cell", "r"])

    return run


def _dealer(pivots: Pivots, radii: Pivots, reach: float):
    """(label, dim, cell, node, m, home, v): each class in its own cell, and in earlier cells that a partner can lie in."""
    gaps: dict[tuple, np.ndarray] = {}

    def cells(key: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``x``, cells, and whether it is the home, in the order of the places."""
        p = pivots.get(key)
        if p is None:
            return np.arange(len(x)), np.zeros(len(x), np.int32), np.ones(len(x), bool)
        if key not in gaps:  # of a task's own labels, at most MAX_PIVOTS squared numbers
            gaps[key] = np.array([np.sqrt(((p - q) ** 2).sum(axis=1)) for q in p])
            np.fill_diagonal(gaps[key], 1)
        d2, home = _homes(x, p)
        # distance to the plane half-way between two pivots, and to the ball that holds a cell
        near = (d2 - d2[np.arange(len(x)), home][:, None]) / (2 * gaps[key][home]) <= reach
        near &= np.sqrt(d2) <= radii[key] + reach
        near &= np.arange(len(p)) < home[:, None]
        near[np.arange(len(x)), home] = True
        at, cell = np.nonzero(near)
        return at, cell.astype(np.int32), home[at] == cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, places, x in _by_label(batch):
                at, cell, own = cells(key, x)
                for i in range(0, len(at), 4 * ROWS):
                    part = slice(i, i + 4 * ROWS)
                    take = pa.array(places[at[part]])
                    label, node, m, v = (batch.column(k).take(take) for k in range(4))
                    dim = pa.array(np.full(len(take), key[1], np.int32))
                    yield pa.RecordBatch.from_arrays([label, dim, pa.array(cell[part]), node, m, pa.array(own[part]), v], names=["label", "dim", "cell", "node", "m", "home", "v"])

    return run


def _joiner(cosine: float):
    def run(group: pa.Table) -> pa.Table:
        b1, b2 = group.column("b1")[0].as_py(), group.column("b2")[0].as_py()
        block = group.column("b").to_numpy()
        node = group.column("node").to_numpy()
        order = np.lexsort((node, block))
        node, block = node[order], block[order]
        m = group.column("m").to_numpy()[order]
        home = group.column("home").to_numpy(zero_copy_only=False).astype(bool)[order]
        x = np.array(group.column("v").combine_chunks().flatten()).reshape(len(node), -1)[order]
        links = np.zeros(len(node), np.int64)
        head = np.arange(len(node))

        def top(i: int) -> int:
            while head[i] != i:
                head[i] = head[head[i]]
                i = head[i]
            return i

        # two blocks: the first against the second; one: each row against the later ones
        first = len(node) if b1 == b2 else int(np.searchsorted(block, b2))
        for at in range(0, first, 512):
            to = min(at + 512, first)
            low = at if b1 == b2 else first
            near = x[at:to] @ x[low:].T >= cosine
            near &= home[at:to, None] | home[None, low:]
            if b1 == b2:
                near &= np.arange(at, to)[:, None] < np.arange(low, len(node))[None]
            rows = np.flatnonzero(near.any(axis=1))
            if not len(rows):
                continue
            near = near[rows]
            links[at + rows] += near @ m[low:]
            links[low:] += m[at + rows] @ near
            # a row's links join its smallest partner; a chain of heads, not pairs
            for k, found in zip(rows, near):
                others = low + np.flatnonzero(found)
                heads = np.unique(np.r_[[top(int(i)) for i in np.unique(head[others])], top(at + int(k))])
                head[heads] = heads[0]
                head[others] = heads[0]
        some = np.flatnonzero(links)
        heads = [top(int(i)) for i in some]
        return pa.table({"node": node[some], "links": links[some], "head": node[heads] if len(some) else node[:0]})

    return run


def _pivots(reps: DataFrame) -> Pivots:
    """(label, dimension) -> pivots, for those with more than a cell's classes; at most ``MAX_PIVOTS`` in all, as cells grow where more would be wanted."""
    sizes = reps.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    sizes = write_table(sizes, "sizes")
    large = lambda c: F.sum(F.when(F.col("n") > c, F.ceil(F.col("n") / c)))
    cells = [CELL << i for i in range(50)]
    wanted = sizes.agg(*(F.coalesce(large(c), F.lit(0)) for c in cells)).first()
    cell = next(c for c, n in zip(cells, wanted, strict=True) if n <= MAX_PIVOTS)
    # at most MAX_PIVOTS labels; a hash picks about eight candidates for each pivot
    many = sizes.where(F.col("n") > cell).select("label", "dim", F.ceil(F.col("n") / cell).alias("k"), "n")
    every = F.greatest(F.lit(1), F.floor(F.col("n") / (8 * F.col("k"))))
    met = reps.withColumn("dim", F.size("v")).join(F.broadcast(many), ["label", "dim"]).where(F.pmod(F.xxhash64("node"), every) == 0)
    found: dict[tuple, list] = {}
    for r in met.select("label", "dim", "k", "node", "v").orderBy(F.xxhash64("node", F.lit(7)), "node").collect():
        found.setdefault((r["label"], r["dim"], r["k"]), []).append(r["v"])
    forget(sizes)
    return {(label, dim): _spread(np.array(v))[:k] for (label, dim, k), v in found.items()}


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """Every row of ``vectors`` with its group: all columns, then n_links, component_id, kept.

    n_links: other rows of the same label and length whose cosine, in double precision,
    is at least ``cosine`` (0 < cosine <= 1). component_id: the smallest id that links
    reach. kept: the row's id is that id. Rows whose label is null, or whose vector is
    null, empty, zero or holds null or non-finite components, link with nothing and are
    groups of their own. Repeated rows link with each other. A null id never becomes
    component_id unless its group has no other (then null, and kept is false). An empty
    table gives an empty table; added names take a leading underscore where ``vectors`` has them.
    """
    spark = vectors.sparkSession
    new = {k: free_name(vectors, k) for k in ("row_key", "digest", "unit", "n_links", "component_id", "kept")}
    key = new["row_key"]
    schema = vectors.limit(0).select("*", F.lit(0).cast("long").alias(key), F.lit(b"").alias(new["digest"]), F.array(F.lit(0.0)).cast("array<double>").alias(new["unit"])).schema
    for f in schema.fields:
        f.nullable = True
    base = write_table(vectors.mapInArrow(_digester(vectors.columns.index(vec_col), schema.names), schema), "vectors")
    thin = base.where(F.col(new["digest"]).isNotNull() & F.col(label_col).isNotNull())
    thin = thin.select(F.col(key).alias("r"), F.col(label_col).alias("label"), F.col(new["digest"]).alias("d"), F.col(new["unit"]).alias("v"))
    classes = thin.groupBy("label", "d").agg(F.min("r").alias("node"), F.count("*").alias("m"))
    rows = write_table(thin.join(classes, ["label", "d"]).select("r", "label", "node", "m", F.when(F.col("r") == F.col("node"), F.col("v")).alias("v")), "classes")
    reps = rows.where("v is not null").select("label", "node", "m", "v")

    reach = np.sqrt(2 - 2 * cosine) + SLACK
    pivots = _pivots(reps)
    label = dict(rows.dtypes)["label"]
    radii = {k: np.full(len(p), -np.inf) for k, p in pivots.items()}
    if pivots:
        far = reps.mapInArrow(_measurer(pivots), f"label {label}, dim int, cell int, r double").groupBy("label", "dim", "cell").agg(F.max("r").alias("r"))
        for r in far.collect():  # one row a pivot
            radii[r["label"], r["dim"]][r["cell"]] = r["r"]
    dealt = reps.mapInArrow(_dealer(pivots, radii, reach), f"label {label}, dim int, cell int, node long, m long, home boolean, v array<double>")
    dealt = write_table(dealt, "cells")
    cell = ["label", "dim", "cell"]
    own = F.count_if("home")
    sizes = dealt.groupBy(*cell).agg(own.alias("own"), (F.count("*") - own).alias("guests")).where("own > 0")
    # one block if all fits; else blocks of those that live there come first, and a pair of blocks has one of them
    small = F.col("own") + F.col("guests") <= BLOCK
    sizes = sizes.select(*cell, F.when(small, 1).otherwise(F.ceil(F.col("own") / BLOCK)).cast("int").alias("n1"), F.when(small, 0).otherwise(F.ceil(F.col("guests") / BLOCK)).cast("int").alias("n2"))
    blocked = dealt.join(sizes, cell)
    hashed = F.xxhash64("node")
    lives = F.col("home") | (F.col("n2") == 0)
    blocked = blocked.withColumn("b", F.when(lives, F.pmod(hashed, F.col("n1"))).otherwise(F.col("n1") + F.pmod(hashed, F.greatest(F.col("n2"), F.lit(1)))).cast("int"))
    blocked = blocked.withColumn("o", F.explode(F.sequence(F.lit(0), F.when(lives, F.col("n1") + F.col("n2")).otherwise(F.col("n1")) - 1)))
    blocked = blocked.select(*cell, F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "b", "node", "m", "home", "v")
    joined = write_table(blocked.groupBy(*cell, "b1", "b2").applyInArrow(_joiner(cosine), "node long, links long, head long"), "links")
    forget(dealt)

    comp = connected_components(joined.select(F.col("node").alias("u"), F.col("head").alias("v")))
    links = joined.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = reps.select("node", "m").join(links, "node", "left").join(comp, "node", "left")
    of_node = of_node.select("node", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("l"), F.coalesce("component", "node").alias("g"))
    of_row = rows.select("r", "node").join(of_node, "node").select("r", "l", "g")
    tagged = base.select(F.col(key).alias("r"), F.col(id_col).alias("i")).join(of_row, "r", "left")
    tagged = tagged.select("r", "i", F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("g", "r").alias("g"))
    heads = tagged.groupBy("g").agg(F.min("i").alias("c"))
    verdict = tagged.join(heads, "g").select(F.col("r").alias(key), F.col("l").cast("long").alias(new["n_links"]), F.col("c").alias(new["component_id"]))
    out = base.drop(new["digest"], new["unit"]).join(verdict, key)
    same = F.coalesce(F.col(id_col) == F.col(new["component_id"]), F.lit(False))
    return out.select(*vectors.columns, new["n_links"], new["component_id"], same.alias(new["kept"]))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")
