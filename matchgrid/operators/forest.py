"""Forests and Poisson regressions of many folds as one job.

Leaving one match out at a time means as many fits as matches, each of them small. The rows
to fit on are bounded (``fit_rows``) and sent to every worker; the work is dealt as units, some
trees of a fold each, and every unit is a function of the rows, the fold and the tree numbers
alone, so a lost executor costs its units and joint fits equal fits one by one. Models come
back as a table with a row a node; rows of any number are scored, or explained by Shapley
values, against it. Poisson regressions of folds, and forests by
``fit_all``, are fitted on all rows, which stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrid.functions.numbers import values_at
from matchgrid.sources.stored import drop_stored, stored

#: Rows that one fit takes, at most.
FIT_ROWS = 1500
#: Trees that one unit of work grows.
UNIT_TREES = 50
NODE_SCHEMA = "fold int, tree int, node int, feature int, cut double, left int, right int, cover double, value array<double>"


@dataclass(frozen=True)
class Growth:
    """How a forest grows; ``columns`` tried a node, the square root of all where none are given."""

    trees: int = 300
    depth: int = 6
    leaf: int = 4
    columns: int | None = None
    balanced: bool = True
    seed: int = 42


@dataclass(frozen=True)
class Rows:
    """Rows to fit on: keys, fold numbers, features (NaN where missing) and targets, one-hot for classes."""

    keys: list
    folds: np.ndarray
    x: np.ndarray
    y: np.ndarray
    classes: list | None


def fold_of(key: Column, folds: int, seed: int = 42) -> Column:
    """A fold by hash of the key, whatever the table's size or order."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(folds)).cast("int")


def fit_sample(df: DataFrame, key: str, features: list[str], label: str, folds: int | None, fit_rows: int = FIT_ROWS, classify: bool = True) -> Rows:
    """At most ``fit_rows`` rows, those whose keys hash lowest, in the order of their keys; rows without a label are left out.

    ``folds`` None: every row is a fold of its own, so all rows must fit.
    """
    known = df.where(F.col(label).isNotNull())
    n = known.count()
    if folds is None and n > fit_rows:
        raise ValueError(f"leaving one out fits every row: {n} rows are more than {fit_rows}; give a number of folds or raise fit_rows")
    if n > fit_rows:  # about twice as many first, so that no task sorts all
        known = known.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(11)), F.lit(max(1, n // (2 * fit_rows)))) == 0)
        known = known.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(13)), key).limit(fit_rows)
    fold = F.lit(0) if folds is None else fold_of(F.col(key), folds)
    got = known.select(F.col(key), fold.alias("__fold"), F.col(label).cast("double").alias("__y"), *(F.col(f).cast("double").alias(f) for f in features)).collect()
    got.sort(key=lambda r: r[0])
    y = np.array([r[2] for r in got], float)
    classes = sorted(set(y.tolist())) if classify else None
    target = (y[:, None] == np.array(classes)[None, :]).astype(float) if classify else y[:, None]
    x = np.array([[math.nan if v is None else v for v in r[3:]] for r in got], float).reshape(len(got), len(features))
    numbers = np.arange(len(got)) if folds is None else np.array([r[1] for r in got], int)
    return Rows([r[0] for r in got], numbers, x, target, classes)


def medians(x: np.ndarray) -> np.ndarray:
    """Each column's median of its values; 0 without any."""
    out = np.zeros(x.shape[1])
    for i, column in enumerate(x.T):
        known = column[~np.isnan(column)]
        out[i] = np.median(known) if len(known) else 0.0
    return out


def filled(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), by, x)


def _best_cut(x: np.ndarray, t: np.ndarray, w: np.ndarray, leaf: int) -> tuple[float, int, float] | None:
    """(gain, column, cut) of the cut that parts the weighted targets best; for one-hot targets that is Gini's."""
    n = len(x)
    order = np.argsort(x, axis=0, kind="stable")
    v = np.take_along_axis(x, order, 0)
    at = np.arange(leaf, n - leaf + 1)
    ok = v[at - 1] < v[at] if len(at) else np.zeros((0, x.shape[1]), bool)
    if not ok.any():
        return None
    weight = np.cumsum(w[order], axis=0)[at - 1]
    total = (w[:, None] * t).sum(axis=0)
    gain = np.zeros(ok.shape)
    whole = w.sum()
    for c in range(t.shape[1]):
        below = np.cumsum((w * t[:, c])[order], axis=0)[at - 1]
        gain += below**2 / weight + (total[c] - below) ** 2 / (whole - weight)
    gain = np.where(ok, gain, -np.inf)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[i, j]), int(j), float((v[at[i] - 1, j] + v[at[i], j]) / 2)


def grow_tree(x: np.ndarray, t: np.ndarray, w: np.ndarray, how: Growth, rng: np.random.Generator) -> list[tuple]:
    """(feature, cut, left, right, cover, value) a node, the root first; a leaf's feature is -1."""
    tried = how.columns or max(1, int(math.sqrt(x.shape[1])))
    nodes: list[tuple] = []
    open_ = [(np.arange(len(x)), 0, -1, False)]
    while open_:
        rows, depth, above, is_right = open_.pop()
        me = len(nodes)
        weights = w[rows]
        mean = (weights[:, None] * t[rows]).sum(axis=0) / weights.sum()
        nodes.append((-1, 0.0, -1, -1, float(weights.sum()), mean.tolist()))
        if above >= 0:
            f, cut, left, right, cover, value = nodes[above]
            nodes[above] = (f, cut, left if is_right else me, me if is_right else right, cover, value)
        if depth == how.depth or len(rows) < 2 * how.leaf or not np.ptp(t[rows], axis=0).any():
            continue
        turn = rng.permutation(x.shape[1])
        for a in range(0, len(turn), tried):  # more columns only where none of these can be cut
            best = _best_cut(x[np.ix_(rows, turn[a : a + tried])], t[rows], weights, how.leaf)
            if best:
                f = int(turn[a + best[1]])
                nodes[me] = (f, best[2], -1, -1, *nodes[me][4:])
                low = x[rows, f] <= best[2]
                open_ += [(rows[~low], depth + 1, me, True), (rows[low], depth + 1, me, False)]
                break
    return nodes


def prepared(rows: Rows, fold: int, how: Growth) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, weights, medians) of all folds but ``fold`` (-1: of all), missing values filled with the medians of these rows."""
    inside = rows.folds != fold
    x, y = rows.x[inside], rows.y[inside]
    fill = medians(x)
    w = np.ones(len(x))
    if how.balanced and rows.classes is not None:
        counts = y.sum(axis=0)
        w = (y @ np.divide(len(y), (counts > 0).sum() * counts, out=np.zeros_like(counts), where=counts > 0)).astype(float)
    return filled(x, fill), y, w, fill


def grow(rows: Rows, fold: int, tree: int, how: Growth, ready: tuple | None = None) -> list[tuple]:
    """One tree of the forest that is fitted on all folds but ``fold``; ``ready``: what ``prepared`` gives for the fold."""
    x, y, w, _ = ready or prepared(rows, fold, how)
    rng = np.random.default_rng((how.seed, fold + 1, tree))
    drawn = np.bincount(rng.integers(0, len(x), len(x)), minlength=len(x))
    used = drawn > 0
    return grow_tree(x[used], y[used], (w * drawn)[used], how, rng)


def _units(df: DataFrame, folds: list[int], trees: int) -> DataFrame:
    """(fold, first, last) of each unit of work, dealt evenly."""
    units = [(f, a, min(a + UNIT_TREES, trees)) for f in folds for a in range(0, trees, UNIT_TREES)]
    return df.sparkSession.createDataFrame(units, "fold int, first int, last int").repartition(max(1, min(len(units), 4 * df.sparkSession.sparkContext.defaultParallelism)))


def descend(x: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    """Each row's node of a tree where it ends."""
    feature = np.array([n[0] for n in nodes])
    cut, left, right = (np.array([n[i] for n in nodes]) for i in (1, 2, 3))
    at = np.zeros(len(x), int)
    while True:
        f = feature[at]
        on = f >= 0
        if not on.any():
            return at
        here = at[on]
        at[on] = np.where(x[np.flatnonzero(on), f[on]] <= cut[here], left[here], right[here])


def fit_forests(df: DataFrame, rows: Rows, how: Growth, folds: list[int] | None = None) -> DataFrame:
    """The nodes of a forest for each of ``folds`` (fold -1, fitted on all rows, where none are given): columns as ``NODE_SCHEMA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fold", "tree", "node", "feature", "cut", "left", "right", "cover", "value"]
        kinds = [*[pa.int32()] * 4, pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())]
        for batch in batches:
            for fold, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ready = prepared(rows, fold, how)
                found = [(fold, tree, i, *n) for tree in range(first, last) for i, n in enumerate(grow(rows, fold, tree, how, ready))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=names)

    return _units(df, [-1] if folds is None else folds, how.trees).mapInArrow(run, NODE_SCHEMA)


def leave_one_out(df: DataFrame, key: str, features: list[str], label: str, how: Growth = Growth(), fit_rows: int = FIT_ROWS) -> DataFrame:
    """(key, prediction, p) of every row by a forest that has not seen it; p holds the classes' shares, ascending.

    As many forests as rows, in one job; no tree leaves its worker, only its votes. Rows
    without a label are not predicted; equal shares go to the lower class.
    """
    rows = fit_sample(df, key, features, label, None, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            votes = []
            for fold, first, last in units:
                ready = prepared(rows, fold, how)
                x = filled(rows.x[fold : fold + 1], ready[3])
                total = np.zeros(rows.y.shape[1])
                for tree in range(first, last):
                    nodes = grow(rows, fold, tree, how, ready)
                    total += nodes[descend(x, nodes)[0]][5]
                votes.append(total.tolist())
            yield pa.RecordBatch.from_arrays([pa.array([u[0] for u in units], pa.int32()), pa.array([u[1] for u in units], pa.int32()), pa.array(votes, pa.list_(pa.float64()))], names=["fold", "first", "votes"])

    kind = df.schema[key].dataType
    names = df.sparkSession.createDataFrame(list(enumerate(rows.keys)), f"fold int, `{key}` {kind.simpleString()}")
    if len(rows.keys) < 2:
        return names.select(key, F.lit(None).cast("double").alias("prediction"), F.lit(None).cast("array<double>").alias("p")).limit(0)
    votes = _units(df, list(range(len(rows.keys))), how.trees).mapInArrow(run, "fold int, first int, votes array<double>")
    k = len(rows.classes)
    # parts in the order of their trees, so that sums do not hang on the order of arrival
    parts = votes.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("first", "votes"))).alias("s"))
    share = lambda i: F.aggregate("s", F.lit(0.0), lambda a, v: a + v["votes"][i]) / how.trees
    p = F.array(*map(share, range(k)))
    return _decided(parts.select("fold", p.alias("p")).join(names, "fold").select(key, "p"), key, rows.classes)


def _decided(shares: DataFrame, key: str, classes: list) -> DataFrame:
    best = F.array_position("p", F.array_max("p")).cast("int")
    return shares.select(key, F.element_at(F.array(*map(F.lit, classes)), best).alias("prediction"), "p")


def _packed(nodes: DataFrame) -> dict[int, list[list[tuple]]]:
    """fold -> trees -> nodes; as many as the folds' trees have, whatever the tables' size."""
    trees: dict[tuple[int, int], list] = {}
    for r in nodes.collect():
        trees.setdefault((r["fold"], r["tree"]), []).append((r["node"], r["feature"], r["cut"], r["left"], r["right"], r["cover"], r["value"]))
    out: dict[int, list[list[tuple]]] = {}
    for fold, tree in sorted(trees):
        out.setdefault(fold, []).append([n[1:] for n in sorted(trees[fold, tree], key=lambda n: n[0])])
    return out


def _matrix(batch: pa.RecordBatch, first: int, features: int) -> np.ndarray:
    columns = [batch.column(first + i).to_numpy(zero_copy_only=False).astype(float) for i in range(features)]
    return np.stack(columns, axis=1) if columns else np.zeros((batch.num_rows, 0))


def apply(df: DataFrame, key: str, features: list[str], nodes: DataFrame, fill: np.ndarray, classes: list) -> DataFrame:
    """(key, prediction, p) of any rows by the forest of ``nodes`` (one fold), such as a stored one; ``fill`` replaces missing values."""
    (trees,) = _packed(nodes).values()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = filled(_matrix(batch, 1, len(features)), fill)
            p = sum(np.array([n[5] for n in t])[descend(x, t)] for t in trees) / len(trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.tolist(), pa.list_(pa.float64()))], names=[key, "p"])

    used = df.select(key, *(F.col(f).cast("double").alias(f) for f in features))
    return _decided(used.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, p array<double>"), key, classes)


def cross_predict(df: DataFrame, key: str, features: list[str], label: str, folds: int, how: Growth = Growth(), fit_rows: int = FIT_ROWS) -> DataFrame:
    """(key, prediction, p) of all rows of ``df``, each by the forest of its fold, which is fitted on the other folds' share of the sample."""
    rows = fit_sample(df, key, features, label, folds, fit_rows)
    trees = _packed(fit_forests(df, rows, how, list(range(folds))))
    fill = {f: medians(rows.x[rows.folds != f]) for f in range(folds)}
    k = rows.y.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, x = batch.column(1).to_numpy(), _matrix(batch, 2, len(features))
            p = np.zeros((len(x), k))
            for f in np.unique(fold):
                at = np.flatnonzero(fold == f)
                mine = filled(x[at], fill[int(f)])
                for nodes in trees[int(f)]:
                    p[at] += np.array([n[5] for n in nodes])[descend(mine, nodes)] / how.trees
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.tolist(), pa.list_(pa.float64()))], names=[key, "p"])

    used = df.select(key, fold_of(F.col(key), folds).alias("__fold"), *(F.col(f).cast("double").alias(f) for f in features))
    kind = df.schema[key].dataType.simpleString()
    return _decided(used.mapInArrow(run, f"`{key}` {kind}, p array<double>"), key, rows.classes)


def path_shares(x: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    """Shapley values (rows, features, targets) of one tree, where a missing feature follows both branches by their covers.

    A leaf is a product over the features on its path: 1 if the row takes the path there, or,
    for a missing feature, the covers' share. The value of a feature in such a product needs
    the sums over subsets by size only, which are the coefficients of a polynomial.
    """
    out = np.zeros((len(x), x.shape[1], len(nodes[0][5])))
    open_ = [(0, {})]
    while open_:
        me, path = open_.pop()
        f, cut, left, right, cover, value = nodes[me]
        if f >= 0:
            low = x[:, f] <= cut
            for child, takes in ((left, low), (right, ~low)):
                share, follows = path.get(f, (1.0, np.ones(len(x), bool)))
                open_.append((child, {**path, f: (share * nodes[child][4] / cover, follows & takes)}))
            continue
        m = len(path)
        for j in path:
            sums = [np.ones(len(x))]  # by subset size: the products over the other features
            for i in path:
                if i != j:
                    share, follows = path[i]
                    sums = [(sums[s] * share if s < len(sums) else 0) + (sums[s - 1] * follows if s else 0) for s in range(len(sums) + 1)]
            whole = sum(math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) * c for s, c in enumerate(sums))
            share, follows = path[j]
            out[:, j] += ((follows - share) * whole)[:, None] * np.array(value)[None, :]
    return out


def shapley(df: DataFrame, key: str, features: list[str], nodes: DataFrame, fill: np.ndarray) -> DataFrame:
    """(key, feature, values) by the forest of ``nodes`` (one fold): a row for each row and feature, a value for each target.

    For every row the values sum to the forest's output less its mean output. ``fill`` replaces missing values.
    """
    (trees,) = _packed(nodes).values()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = filled(_matrix(batch, 1, len(features)), fill)
            total = sum(path_shares(x, t) for t in trees) / len(trees) if len(x) else np.zeros((0, len(features), 1))
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), len(features))))
            yield pa.RecordBatch.from_arrays([keys, pa.array(features * len(x)), pa.array(total.reshape(len(x) * len(features), -1).tolist(), pa.list_(pa.float64()))], names=[key, "feature", "values"])

    kind = df.schema[key].dataType.simpleString()
    used = df.select(key, *(F.col(f).cast("double").alias(f) for f in features))
    return used.mapInArrow(run, f"`{key}` {kind}, feature string, values array<double>")


def shapley_ranking(df: DataFrame, key: str, features: list[str], label: str, how: Growth = Growth(), fit_rows: int = FIT_ROWS) -> DataFrame:
    """(feature, importance, place): the mean absolute Shapley value over all rows and classes of a forest fitted on the sample, largest first."""
    rows = fit_sample(df, key, features, label, 1, fit_rows)
    values = shapley(df, key, features, fit_forests(df, rows, how), medians(rows.x))
    mean = F.aggregate("values", F.lit(0.0), lambda a, v: a + F.abs(v)) / F.size("values")
    found = values.groupBy("feature").agg(F.avg(mean).alias("importance"))
    return found.select("feature", "importance", F.row_number().over(W.orderBy(F.desc("importance"), "feature")).alias("place"))  # a row a feature


def drawn(key: Column, tree: Column, seed: int) -> Column:
    """How often a tree's bootstrap draws a row: Poisson with mean 1 by hash of the key, whatever the table's size or order."""
    u = F.shiftrightunsigned(F.xxhash64(key.cast("string"), tree.cast("int"), F.lit(seed)), 11) * F.lit(2.0**-53)
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(17)]).tolist()
    return reduce(Column.__add__, [(u >= c).cast("long") for c in upto])


def _best_cuts(level: DataFrame, features: int, weights: list[float], how: Growth) -> DataFrame:
    """(tree, node, s): the best cut of each node of ``level(tree, node, c, w, m, __x, __b)``, if any, as ``_best_cut`` finds it, over rows of any number.

    Values are added up first; running sums are taken in a bucket (``__b``) and over the buckets, so no task sorts a node. Columns
    are tried in an order by hash, more only where none of the first can be cut.
    """
    k = range(len(weights))
    keys = ["tree", "node", "feature"]
    each = level.select("tree", "node", "c", "w", "m", F.inline(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(f"__x{i}").alias("value"), F.col(f"__b{i}").alias("bucket")) for i in range(features)))))
    values = each.groupBy(*keys, "bucket", "value").agg(F.sum("m").alias("m"), *(F.sum(F.when(F.col("c") == i, F.col("w")).otherwise(0)).alias(f"w{i}") for i in k))
    counts = ["m", *(f"w{i}" for i in k)]
    inside = W.partitionBy(*keys, "bucket").orderBy("value")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    running = values.select(*keys, "bucket", "value", F.lead("value").over(inside).alias("next"), *(F.sum(c).over(upto).alias(c) for c in counts))
    buckets = values.groupBy(*keys, "bucket").agg(F.min("value").alias("first"), *(F.sum(c).alias(c) for c in counts))
    across = W.partitionBy(*keys).orderBy("bucket")
    before, whole = across.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys)
    sums = [x for c in counts for x in (F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}"), F.sum(c).over(whole).alias(f"all_{c}"))]
    met = running.join(buckets.select(*keys, "bucket", F.lead("first").over(across).alias("after"), *sums), [*keys, "bucket"])
    met = met.select(*keys, "value", F.coalesce("next", "after").alias("next"), *(F.col(f"all_{c}").alias(f"all_{c}") for c in counts), *((F.col(f"before_{c}") + F.col(c)).alias(c) for c in counts))
    low = [F.col(f"w{i}") * weights[i] for i in k]
    high = [(F.col(f"all_w{i}") - F.col(f"w{i}")) * weights[i] for i in k]
    total = lambda parts: reduce(Column.__add__, parts)
    gain = total([a * a for a in low]) / total(low) + total([a * a for a in high]) / total(high)
    middle = (F.col("value") + F.col("next")) / 2
    cut = F.when(middle < F.col("next"), middle).otherwise(F.col("value"))
    ok = F.col("next").isNotNull() & (F.col("m") >= how.leaf) & (F.col("all_m") - F.col("m") >= how.leaf)
    found = met.groupBy(*keys).agg(F.max(F.when(ok, F.struct(gain.alias("gain"), (-cut).alias("low"), F.col("m").alias("m"), F.array(*(f"w{i}" for i in k)).alias("w")))).alias("best"))
    place = F.row_number().over(W.partitionBy("tree", "node").orderBy(F.xxhash64("tree", "node", "feature", F.lit(how.seed)), "feature"))
    tried = how.columns or max(1, int(math.sqrt(features)))
    turn = found.select(*keys, "best", F.floor((place - 1) / tried).alias("turn")).where("best is not null")
    return turn.groupBy("tree", "node").agg(F.max(F.struct((-F.col("turn")).alias("turn"), "best.gain", "best.low", (-F.col("feature")).alias("feature"), "best.m", "best.w")).alias("s"))


def fit_all(df: DataFrame, key: str, features: list[str], label: str, how: Growth = Growth()) -> tuple[DataFrame, np.ndarray, list]:
    """(nodes, medians, classes) of a forest fitted on all labelled rows, whatever their number; nodes as ``NODE_SCHEMA``, fold -1.

    Trees grow a level at a time, all at once, by exact cuts; rows of a tree with equal features and class are one row. Only the
    nodes reach the driver. Bootstraps are Poisson draws by key. ``df`` is read some five times: give a stored table.
    """
    known = df.where(F.col(label).isNotNull())
    y = F.col(label).cast("double")
    n = {r["y"]: r["n"] for r in known.groupBy(y.alias("y")).agg(F.count("*").alias("n")).collect()}
    if not n:
        raise ValueError(f"no row has a {label} to fit on")
    classes = sorted(n)
    weights = [sum(n.values()) / (len(n) * n[c]) if how.balanced else 1.0 for c in classes]
    xs = [f"__x{i}" for i in range(len(features))]
    raw = known.select(F.lit(-1).alias("__fold"), *(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(x) for f, x in zip(features, xs, strict=True)))
    found = fold_medians(raw, {x: i for i, x in enumerate(xs)}, 1)[0]
    fill = np.array([found.get(i, 0.0) for i in range(len(xs))], float)
    whole = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(float(v))).alias(x) for f, x, v in zip(features, xs, fill, strict=True)]
    c = (F.array_position(F.array(*map(F.lit, classes)), y) - 1).cast("int").alias("c")
    used = known.select(F.col(key).alias("__key"), c, *whole)
    grids = used.agg(*(F.percentile_approx(x, [i / 256 for i in range(1, 256)], 1000).alias(x) for x in xs)).first() if xs else {}  # they only part the work
    each = used.select("*", F.explode(F.sequence(F.lit(0), F.lit(how.trees - 1))).alias("tree")).withColumn("__w", drawn(F.col("__key"), F.col("tree"), how.seed)).where("__w > 0")
    bag = stored(each.groupBy("tree", "c", *xs).agg(F.sum("__w").alias("w"), F.count("*").alias("m")), "bag")

    tops: dict[int, tuple] = {}
    for r in bag.groupBy("tree", "c").agg(F.sum("w").alias("w"), F.sum("m").alias("m")).collect():
        w, m = tops.get(r["tree"], ([0] * len(classes), 0))
        tops[r["tree"]] = [a + (r["w"] if i == r["c"] else 0) for i, a in enumerate(w)], m + r["m"]
    # a tree that drew nothing is a leaf of all rows
    trees = {t: [[-1, 0.0, -1, -1, *tops.get(t, ([n[c] for c in classes], 0))]] for t in range(how.trees)}

    def cuttable(node: list, depth: int) -> bool:
        return bool(xs) and depth < how.depth and node[5] >= 2 * how.leaf and sum(v > 0 for v in node[4]) > 1

    level = bag
    if xs:
        splits = [[-math.inf, *(sorted({v + 0.0 for v in grids[x] if math.isfinite(v)}) or [0.0]), math.inf] for x in xs]
        level = Bucketizer(splitsArray=splits, inputCols=xs, outputCols=[f"__b{i}" for i in range(len(xs))]).transform(bag)
    open_ = [(t, None, None, None, 0, None) for t in trees if cuttable(trees[t][0], 0)]
    for depth in range(how.depth):
        if not open_:
            break
        to = df.sparkSession.createDataFrame(open_, "tree int, above int, feature int, cut double, left int, right int")
        if depth == 0:
            level = level.join(F.broadcast(to.select("tree", F.col("left").alias("node"))), "tree")
        else:
            met = level.withColumnRenamed("node", "above").join(F.broadcast(to), ["tree", "above"])
            side = F.when(F.get(F.array(*xs), F.col("feature")) <= F.col("cut"), F.col("left")).otherwise(F.col("right"))
            level = met.select(*bag.columns, *(f"__b{i}" for i in range(len(xs))), side.alias("node")).where("node is not null")
        open_ = []
        for r in sorted(_best_cuts(level, len(xs), weights, how).collect(), key=lambda r: (r["tree"], r["node"])):
            tree, s = trees[r["tree"]], r["s"]
            me, left = tree[r["node"]], len(tree)
            me[:4] = -s["feature"], -s["low"], left, left + 1
            tree += [[-1, 0.0, -1, -1, list(s["w"]), s["m"]], [-1, 0.0, -1, -1, [a - b for a, b in zip(me[4], s["w"], strict=True)], me[5] - s["m"]]]
            on = [i if cuttable(tree[i], depth + 1) else None for i in (left, left + 1)]
            if on != [None, None]:
                open_.append((r["tree"], r["node"], me[0], me[1], *on))
    drop_stored(bag)
    made = []
    for t, tree in trees.items():
        for i, (feature, cut, left, right, counts, _) in enumerate(tree):
            held = [float(a * b) for a, b in zip(counts, weights, strict=True)]
            made.append((-1, t, i, feature, cut, left, right, sum(held), [v / sum(held) for v in held]))
    return df.sparkSession.createDataFrame(made, NODE_SCHEMA), fill, classes


def fit_poisson(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients with the intercept last, means, scales): the mean Poisson loss with a log link and half ``penalty`` times the squares, on z-scores; Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    ridge = np.append(np.full(x.shape[1], penalty), 0.0)
    b = np.zeros(z.shape[1])
    b[-1] = math.log(max(y.mean(), 1e-9))

    def loss(c: np.ndarray) -> float:
        eta = z @ c
        return float((np.exp(np.minimum(eta, 700)) - y * eta).mean() + (ridge * c * c).sum() / 2)

    now = loss(b)
    for _ in range(steps):
        mu = np.exp(z @ b)
        slope = z.T @ (mu - y) / len(y) + ridge * b
        bend = (z * mu[:, None]).T @ z / len(y) + np.diag(ridge + 1e-12)
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while size > 1e-8 and not (new := loss(b - size * step)) <= now:
            size /= 2
        if size <= 1e-8 or now - new < 1e-14 and np.abs(slope).max() < 1e-10:
            break
        b, now = b - size * step, new
    return b, mean, scale


def fold_medians(rows: DataFrame, columns: dict[str, int], folds: int) -> dict[int, dict[int, float]]:
    """fold -> place -> the median over the rows of all other folds of ``columns`` (name -> place) of ``rows(__fold, ...)``, exact; nothing where a fold's others have no value."""
    out: dict[int, dict[int, float]] = {f: {} for f in range(folds)}
    if not columns:
        return out
    value = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    each = rows.select("__fold", F.inline(F.array(*(F.struct(F.lit(i).alias("place"), value(c).alias("value")) for c, i in columns.items()))))
    others = F.filter(F.array(*map(F.lit, range(folds))), lambda f: f != F.col("__fold"))
    middle = values_at(each.select(F.explode(others).alias("fold"), "place", "value"), ["fold", "place"], {"lower": F.floor((F.col("n") - 1) / 2), "upper": F.floor(F.col("n") / 2)})
    for r in middle.groupBy("fold", "place").agg(F.avg("value").alias("median")).collect():
        out[r["fold"]][r["place"]] = r["median"]
    drop_stored(middle)
    return out


def _fold_sums(rows: DataFrame, folds: list[int], fill: dict[int, np.ndarray], each: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> dict[int, np.ndarray]:
    """fold -> what ``each`` (features, labels, fold) gives, added up over all labelled rows of the other folds of ``rows(__fold, label, features)``.

    A task gives a row a fold; those are added up in the order of the partitions, so that a repeated run gives the same sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            at, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(float), _matrix(batch, 2, batch.num_columns - 2)
            for f in folds:
                inside = at != f
                if inside.any():
                    found = each(filled(x[inside], fill[f]), y[inside], f)
                    total[f] = total[f] + found if f in total else found
        part = TaskContext.get().partitionId()
        made = [pa.array(list(total), pa.int32()), pa.array([part] * len(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(made, names=["fold", "part", "sums"])

    parts = rows.mapInArrow(run, "fold int, part int, sums array<double>").select("fold", "part", F.posexplode("sums").alias("i", "v"))
    ordered = F.sort_array(F.collect_list(F.struct("part", "v")))
    sums = parts.groupBy("fold", "i").agg(F.aggregate(ordered, F.lit(0.0), lambda a, s: a + s["v"]).alias("v"))
    out: dict[int, list] = {}
    for r in sums.collect():
        out.setdefault(r["fold"], []).append((r["i"], r["v"]))
    return {f: np.array([v for _, v in sorted(found)]) for f, found in out.items()}


def fit_poisson_folds(rows: DataFrame, features: int, folds: int, penalty: float, steps: int = 50) -> dict[int, tuple]:
    """fold -> (medians, (coefficients, means, scales)): what ``fit_poisson`` gives for all labelled rows of the other folds, whatever their number.

    ``rows(__fold, label, features)`` are read once for counts and twice for moments, more often where values are missing, and
    once a Newton step for all folds together; give a stored table. A fold whose others have no labelled row has no model.
    """
    known = rows.where(F.col(rows.columns[1]).isNotNull())
    names = rows.columns[2:]
    # a row to predict may lack what no row to fit on lacks
    lacking = rows.agg(*(F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in names)).first() if names else {}
    middle = fold_medians(known, {c: i for i, c in enumerate(names) if lacking[c]}, folds)
    fill = {f: np.array([middle[f].get(i, 0.0) for i in range(features)], float) for f in range(folds)}

    first = _fold_sums(known, list(range(folds)), fill, lambda x, y, f: np.concatenate(([len(x), y.sum()], x.sum(axis=0))))
    n = {f: s[0] for f, s in first.items()}
    mean = {f: s[2:] / s[0] for f, s in first.items()}
    squares = _fold_sums(known, list(n), fill, lambda x, y, f: ((x - mean[f]) ** 2).sum(axis=0)) if features else {}
    scale = {f: np.sqrt(squares[f] / n[f]) if features else np.zeros(0) for f in n}
    scale = {f: np.where(s > 1e-12 * np.abs(mean[f]), s, 1.0) for f, s in scale.items()}
    ridge = np.append(np.full(features, penalty), 0.0)

    def step_sums(at: dict[int, np.ndarray]) -> dict[int, tuple]:
        """fold -> (loss, slope, bend) of the coefficients ``at``."""

        def each(x: np.ndarray, y: np.ndarray, f: int) -> np.ndarray:
            z = np.column_stack(((x - mean[f]) / scale[f], np.ones(len(x))))
            eta = z @ at[f]
            mu = np.exp(np.minimum(eta, 700))
            return np.concatenate(([(mu - y * eta).sum()], z.T @ (mu - y), ((z * mu[:, None]).T @ z).ravel()))

        k = features + 1
        sums = {f: s / n[f] for f, s in _fold_sums(known, list(at), fill, each).items()}
        return {f: (s[0] + (ridge * at[f] * at[f]).sum() / 2, s[1 : k + 1] + ridge * at[f], s[k + 1 :].reshape(k, k) + np.diag(ridge + 1e-12)) for f, s in sums.items()}

    b = {f: np.append(np.zeros(features), math.log(max(first[f][1] / n[f], 1e-9))) for f in n}
    now = step_sums(b) if n else {}
    size = dict.fromkeys(n, 1.0)
    for _ in range(steps):
        open_ = [f for f in n if np.abs(now[f][1]).max() > 1e-10 and size[f] > 1e-8]
        if not open_:
            break
        tried = {f: b[f] - size[f] * np.linalg.solve(now[f][2], now[f][1]) for f in open_}
        for f, new in step_sums(tried).items():
            if new[0] <= now[f][0] + 1e-12 * max(1.0, abs(now[f][0])):  # sums round
                b[f], now[f], size[f] = tried[f], new, 1.0
            else:
                size[f] /= 2
    return {f: (fill[f], (b[f], mean[f], scale[f])) for f in n}


def poisson_predict(df: DataFrame, key: str, features: list[str], label: str, folds: int | None, penalty: float = 0.1, fit_rows: int = FIT_ROWS, keep: list[str] | None = None) -> DataFrame:
    """(key, prediction) by Poisson regressions that have not seen the row: one a fold, or one a row where ``folds`` is None.

    With folds, each regression is fitted on all rows of the other folds, ``df`` is read some ten times (give a stored table), and the
    columns ``keep`` go with their rows, so that nothing need be joined to them. ``fit_rows`` bounds the rows where each is left out.
    """
    keep = keep or []
    if keep and folds is None:
        raise ValueError("columns are kept with folds only; join by key where each row is left out")
    kind = df.schema[key].dataType.simpleString()

    if folds is None:
        rows = fit_sample(df, key, features, label, None, fit_rows, classify=False)
        if len(rows.keys) < 2:
            return df.select(key, F.lit(0.0).alias("prediction")).limit(0)

        def predicted(x: np.ndarray, fold: int) -> np.ndarray:
            inside = rows.folds != fold
            fill = medians(rows.x[inside])
            b, mean, scale = fit_poisson(filled(rows.x[inside], fill), rows.y[inside, 0], penalty)
            return np.exp((filled(x, fill) - mean) / scale @ b[:-1] + b[-1])

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([float(predicted(rows.x[f : f + 1], f)[0]) for f in at])], names=["fold", "prediction"])

        names = df.sparkSession.createDataFrame(list(enumerate(rows.keys)), f"fold int, `{key}` {kind}")
        return _units(df, list(range(len(rows.keys))), 1).mapInArrow(one, "fold int, prediction double").join(names, "fold").select(key, "prediction")

    fold = fold_of(F.col(key), folds).alias("__fold")
    numbered = [F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)]
    models = fit_poisson_folds(df.select(fold, F.col(label).cast("double").alias("__y"), *numbered), len(features), folds, penalty)

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, x = batch.column(1).to_numpy(), _matrix(batch, 2, len(features))
            out = np.full(len(x), math.nan)
            for f in np.unique(fold).tolist():
                if f in models:
                    fill, (b, mean, scale) = models[f]
                    at = fold == f
                    out[at] = np.exp((filled(x[at], fill) - mean) / scale @ b[:-1] + b[-1])
            kept = [batch.column(2 + len(features) + i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, from_pandas=True), *kept], names=[key, "prediction", *keep])

    used = df.select(key, fold, *numbered, *keep)
    kinds = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return used.mapInArrow(many, f"`{key}` {kind}, prediction double{kinds}")
