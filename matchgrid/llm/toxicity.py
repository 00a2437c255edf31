"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic texts are the positives; all other text is unlabelled, toxic text among it.
With the class prior p the risk is p R+(positives) + max(0, R-(unlabelled) - p R-(positives)):
what the unlabelled text loses as negative, less the part that its toxic share must lose. Where
that difference falls below 0 the model is fitting noise, and the step goes the other way.

A text's words (runs of letters, lower-cased) and their beginnings, which inflected forms share,
are its hashed features, each once. Spark counts them over a bounded sample and keeps the
telling ones; several linear classifiers, each in a task of its own on its part of the
sample, learn in numpy; their mean scores every text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.llm.common import forget, free_name, table, write_table

#: Bits of a hashed feature, and the lengths of the beginnings that are features beside the words.
BITS, BEGINNINGS = 30, (4, 5, 6)
#: Texts that the classifiers are fitted on, at most: confirmed toxic ones, and unlabelled ones.
POSITIVES, UNLABELLED = 5_000, 15_000
#: Classifiers; each leaves out another part of the sample.
BAGS = 4
#: A feature is used where so many texts of the sample have it, and the share of positive texts with it is so many standard errors above that of unlabelled ones.
MIN_TEXTS, APART = 3, 4.5
EPOCHS, BATCHES, RATE, DECAY = 40, 8, 0.25, 1e-5
#: How far below 0 the unlabelled part of a batch's risk may be before the step is turned round.
SLACK = 0.0
THRESHOLD = 0.3
#: Words that a worker remembers the weights of; they are forgotten when there are more.
WORD_CACHE = 500_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[int]:
    """A word and its beginnings, hashed."""
    parts = [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) >= n)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) >> (32 - BITS) for x in parts]


def _featured(text_at: int, keep: list[int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({c for w in words_of(t.as_py()) for c in features_of(w)}) for t in batch.column(text_at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(found, pa.list_(pa.int32()))], names=names)

    return run


def telling(sample: DataFrame) -> np.ndarray:
    """The features of ``sample(kind, features)`` that positive texts (kind 1) have oftener than unlabelled ones by more than chance, ascending.

    What a text lacks does not make it toxic, nor do harmless words make up for toxic ones.
    """
    sizes = dict(sample.groupBy("kind").count().collect())
    n, m = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    counts = sample.select("kind", F.explode("features").alias("f")).groupBy("f").agg(F.sum("kind").alias("p"), F.sum(1 - F.col("kind")).alias("u"))
    share = (F.col("p") + F.col("u")) / (n + m)
    error = F.sqrt(share * (1 - share) * (1 / n + 1 / m))
    apart = F.col("p") / n - F.col("u") / m >= APART * error
    found = counts.where((F.col("p") + F.col("u") >= MIN_TEXTS) & (F.col("p") > 0) & apart).select("f").toArrow()
    return np.sort(found.column("f").to_numpy())


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float, seed: int = 0) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear classifier; each text is an array of its columns out of ``width``, without repeats."""
    rng = np.random.default_rng(seed)
    packed = [*positive, *unlabelled]
    is_positive = np.arange(len(packed)) < len(positive)
    # the last entry is the bias; the two moments are Adam's
    w, m, v = (np.zeros(width + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    shuffled = [np.flatnonzero(is_positive), np.flatnonzero(~is_positive)]
    step = 0
    for epoch in range(EPOCHS):
        parts = [np.array_split(rng.permutation(x), BATCHES) for x in shuffled]
        for p, u in zip(*parts, strict=True):
            if not len(p) or not len(u):
                continue
            rows = np.concatenate((p, u))
            sizes = np.array([len(packed[r]) for r in rows])
            flat = np.concatenate([packed[r] for r in rows])
            owner = np.repeat(np.arange(len(rows)), sizes)
            z = np.bincount(owner, w[flat], len(rows)) + w[-1]
            toxic = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            k = len(p)
            # the loss of a text as toxic is 1 - p, as clean p; being bounded, it lets no single text outweigh the prior
            risk = toxic[k:].mean() - prior * toxic[:k].mean()
            bend = toxic * (1 - toxic)
            slope = np.concatenate((-prior * bend[:k] / k, bend[k:] / len(u)))
            if risk < -SLACK:
                slope = -slope
            else:
                slope[:k] -= prior * bend[:k] / k
            grad = np.append(np.bincount(flat, slope[owner], width), slope.sum())
            grad[:-1] += DECAY * w[:-1]
            step += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            rate = RATE * (1 - epoch / EPOCHS)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _narrowed(known: np.ndarray):
    """Rows (kind, key, features) with the places of their features in ``known`` for the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, starts = lists.flatten().to_numpy(), np.asarray(lists.offsets)
            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            hit = known[at] == flat
            offsets = np.concatenate(([0], np.cumsum(hit)))[starts - starts[0]].astype(np.int32)
            columns = pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[hit].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), columns], names=["kind", "key", "columns"])

    return run


def _trainer(width: int, prior: float):
    def run(sample: pa.Table) -> pa.Table:
        bag = sample.column("bag")[0].as_py()
        sample = sample.sort_by([("kind", "ascending"), ("key", "ascending")])  # shuffled rows come in any order
        kinds, texts = sample.column("kind").to_pylist(), [np.array(x, np.int64) for x in sample.column("columns").to_pylist()]
        by = [[t for t, kind in zip(texts, kinds, strict=True) if kind == k] for k in (1, 0)]
        if not all(by):
            return pa.table({"at": pa.array([], pa.int32()), "weight": pa.array([], pa.float64())})
        weights, bias = fit_nnpu(*by, width, prior, bag)
        return pa.table({"at": pa.array(np.arange(width + 1), pa.int32()), "weight": pa.array(np.append(weights, bias), pa.float64())})

    return run


def learn(docs: DataFrame, positives: DataFrame, prior: float, id_col: str = "doc_id", text_col: str = "text", positive_rows: int = POSITIVES, unlabelled_rows: int = UNLABELLED) -> dict | None:
    """The mean of ``BAGS`` classifiers: feature -> weight, and the bias; None where no feature tells the positives from the rest.

    ``positives(doc_id)``: confirmed toxic rows of ``docs``; the others count as unlabelled,
    and ``prior`` is the share of all that is toxic. At most ``positive_rows`` and
    ``unlabelled_rows`` are fitted on, those whose ids hash lowest; their ids, so bounded, are
    broadcast, and what reaches the driver is a weight a telling feature. Texts of equal
    features count once, so that a large group of copies does not decide.
    """
    hashed = lambda c: F.xxhash64(c.cast("string"), F.lit(5))

    def some(rows: DataFrame, limit: int, kind: int) -> DataFrame:
        ids = rows.select(F.col(id_col).alias("i")).where("i is not null").withColumn("key", hashed(F.col("i")))
        # about twice as many first, so that no task sorts all
        every = max(1, ids.count() // (2 * limit))
        return ids.where(F.pmod("key", F.lit(every)) == 0).distinct().orderBy("key", "i").limit(limit).select("i", F.lit(kind).alias("kind"))

    chosen = some(positives, positive_rows, 1).union(some(docs, unlabelled_rows, 0))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), hashed(F.col(id_col)).alias("key"))
    rows = rows.join(F.broadcast(chosen), "i").select("kind", "key", "t")
    found = rows.mapInArrow(_featured(2, [0, 1], ["kind", "key", "features"]), "kind int, key long, features array<int>")
    found = write_table(found.withColumn("same", F.xxhash64("features")), "features")
    least = found.groupBy("kind", "same").agg(F.min("key").alias("key"))  # the ids' hashes: one text of each
    sample = write_table(found.join(least, ["kind", "same", "key"]).dropDuplicates(["kind", "key"]).select("kind", "key", "features"), "sample")
    forget(found)
    known = telling(sample)
    if not len(known):
        return None
    left_out = F.pmod(F.xxhash64("key", F.lit(9)), F.lit(BAGS))
    narrow = sample.mapInArrow(_narrowed(known), "kind int, key long, columns array<int>")
    bags = narrow.withColumn("bag", F.explode(F.array(*map(F.lit, range(BAGS))))).where(F.col("bag") != left_out)
    fitted = bags.groupBy("bag").applyInArrow(_trainer(len(known), prior), "at int, weight double")
    mean = dict(fitted.groupBy("at").agg(F.sort_array(F.collect_list("weight")).alias("w")).select("at", F.aggregate("w", F.lit(0.0), lambda a, x: a + x) / F.size("w")).collect())
    forget(sample)
    if len(known) not in mean:
        return None
    return {"weights": {int(f): mean[i] for i, f in enumerate(known)}, "bias": mean[len(known)]}


def _scorer(model: dict | None, text_at: int, keep: list[int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model["weights"] if model else {}
        known: dict[str, list[int]] = {}
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(text_at) if model else ()):
                words = words_of(text.as_py())
                if len(known) > WORD_CACHE:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = [f for f in features_of(w) if f in weights]
                z = model["bias"] + math.fsum(weights[f] for f in {f for w in words for f in known[w]})
                scores[i] = 1 / (1 + math.exp(-min(max(z, -35.0), 35.0)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(scores)], names=names)

    return run


def score_texts(docs: DataFrame, model: dict | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with score, 0 to 1: the probability that a text is toxic.

    Whole texts of any length are read; null and empty ones have the score of a text without
    known words; without a model all scores are 0. Repeated rows stay, an empty table gives
    an empty table, and an added name takes a leading underscore where ``docs`` has it.
    """
    at = [i for i, c in enumerate(docs.columns) if keep is None or c in keep]
    schema = docs.limit(0).select(*(docs.columns[i] for i in at), F.lit(0.0).alias(free_name(docs, "score"))).schema
    return docs.mapInArrow(_scorer(model, docs.columns.index(text_col), at, schema.names), schema)


def confirmed(labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id") -> tuple[DataFrame, float]:
    """((id): documents all of whose labels, nulls aside, are 1; their share of the labelled ones, from 0.001 to 0.5)."""
    by = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("least"))
    share = by.agg(F.avg((F.col("least") == 1).cast("double"))).first()[0] or 0.0
    return by.where("least = 1").select(id_col), min(max(share, 0.001), 0.5)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    positives, prior = confirmed(table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out()))
    model = learn(docs.where(~held_out()), positives, prior)
    found = score_texts(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
