"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

Words are runs of letters, lower-cased and padded; a document's most frequent n-grams,
ranked, are compared with each language's by the out-of-place distance. Equal counts
share a rank (the number of n-grams that are more frequent), so no result hangs on the
order in which n-grams were met.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrid.llm.common import free_name, table

#: N-grams have one to three characters; PROFILE of them make a profile.
PROFILE = 400
UNKNOWN = "und"
FOLDS = 5
#: N-grams that a training task adds up before it gives them out.
HELD = 500_000
#: Parts in which a language's n-grams are ranked before the whole.
SHARDS = 64
#: Characters of a long text that are judged or counted at once; a text's n-grams are added up over such parts.
CHUNK = 1 << 18

_BITS = 21
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point -> itself for letters, 0 for all else; built once a worker."""
    if not _letters:
        _letters.append(np.fromiter((i if chr(i).isalpha() else 0 for i in range(0x110000)), np.int64, 0x110000))
    return _letters[0]


def key_of(gram: str) -> int:
    """An n-gram's number: its code points, 21 bits each, ``_`` as 0 after a leading 1; of a three-gram, which fills all bits, the complement without it."""
    n = 1
    for c in gram:
        n = n << _BITS | (0 if c == "_" else ord(c))
    return ~(n - (1 << 63)) if n >> 63 else n


_LEAD = {n: np.int64(key_of("_" * n)) for n in (1, 2)}


def keys_of(text: str | None) -> np.ndarray:
    """The numbers of a text's n-grams, repeats and all: of each run of letters, lower-cased and padded with ``_``, but ``_`` alone."""
    if not text:
        return np.empty(0, np.int64)
    c = _letter_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate(([0], c, [0]))
    c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]  # one gap between words
    one = c[c != 0]
    if not len(one):
        return one
    two = c[:-1] << _BITS | c[1:]
    inner = c[1:-1] != 0
    # a three-gram fills all 63 bits, so the leading 1 of the shorter ones is left out of it
    three = (two[:-1] << _BITS | c[2:])[inner]
    return np.concatenate((one | _LEAD[1], two | _LEAD[2], ~three))


_SPACE = re.compile(r"\s")


def parts_of(text: str | None) -> Iterator[str]:
    """A text in parts of about ``CHUNK`` characters, cut at white space, so that their n-grams are those of the whole."""
    text, at = text or "", 0
    while len(text) - at > CHUNK:
        gap = _SPACE.search(text, at + CHUNK)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Different n-gram numbers of a text, ascending, and their counts."""
    keys, n = _added(np.empty(0, np.int64))
    for part in parts_of(text):
        k, m = _added(keys_of(part))
        keys, n = _added(np.concatenate((keys, k)), np.concatenate((n, m))) if len(keys) else (k, m)
    return keys, n


def _added(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, ascending, and their counts."""
    order = np.argsort(keys, kind="stable") if counts is not None else None
    if not len(keys):
        return keys, np.empty(0, np.int64)
    k = np.sort(keys) if order is None else keys[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    n = np.diff(np.r_[at, len(k)]) if order is None else np.add.reduceat(counts[order], at)
    return k[at], n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task's documents, added up in the task."""

    def rows():
        for lang, (k, n) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        found: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in parts_of(text.as_py()):
                found.setdefault(lang, []).append(keys_of(part))
                if len(found[lang]) >= 64 or len(part) >= CHUNK:
                    _merge(totals, lang, found.pop(lang))
        for lang, keys in found.items():
            _merge(totals, lang, keys)
        if sum(len(k) for k, _ in totals.values()) > HELD:
            yield from rows()
            totals = {}
    yield from rows()


def _merge(totals: dict, lang: str, arrays: list[np.ndarray]) -> None:
    keys = np.concatenate(arrays)
    if not len(keys):
        return
    k, n = _added(keys)
    if lang in totals:
        k, n = _added(np.concatenate((totals[lang][0], k)), np.concatenate((totals[lang][1], n)))
    totals[lang] = k, n


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, dict[int, int]]:
    """language -> n-gram number -> rank, over all rows with a language and a text.

    Each task adds up its own documents. A profile holds the ``size`` most frequent n-grams,
    those of smaller number first where counts tie at the end of it; equal counts in it share
    a rank. What reaches the driver is at most ``size`` n-grams a language.
    """
    used = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    total = used.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the best of each of SHARDS parts of a language first, so that no task ranks all its n-grams
    shard = F.pmod(F.xxhash64("gram"), F.lit(SHARDS))
    order = (F.desc("n"), F.asc("gram"))
    best = total.withColumn("s", shard).withColumn("p", F.row_number().over(W.partitionBy("lang", "s").orderBy(*order))).where(F.col("p") <= size)
    lang = W.partitionBy("lang")
    best = best.withColumn("p", F.row_number().over(lang.orderBy(*order))).where(F.col("p") <= size).withColumn("r", F.rank().over(lang.orderBy(F.desc("n"))) - 1)
    found: dict[str, dict[int, int]] = {}
    for lang, gram, r in best.select("lang", "gram", "r").collect():
        found.setdefault(lang, {})[gram] = r
    return found


def _judge(model: dict[str, dict[int, int]], size: int, text_at: int, names: list[str]):
    langs = sorted(model)
    known = np.array(sorted({g for p in model.values() for g in p}), np.int64)
    # in a language's profile: its rank; else the place is always out by the whole size
    ranks = np.full((len(langs), len(known)), 2 * size, np.int64)
    for i, lang in enumerate(langs):
        at = np.searchsorted(known, np.array(list(model[lang]), np.int64))
        ranks[i, at] = list(model[lang].values())

    def judge(text: str | None) -> tuple[str, float]:
        keys, n = counts_of(text)
        if not len(keys) or not langs:
            return UNKNOWN, 0.0
        up = np.sort(n)
        rank = len(n) - np.searchsorted(up, n, side="right")
        top = rank < size
        keys, rank = keys[top], rank[top]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        mine = known[at] == keys
        out = np.minimum(np.abs(ranks[:, at[mine]] - rank[mine]), size).sum(axis=1)
        far = (out + size * (len(keys) - int(mine.sum()))) / (size * len(keys))
        best = int(far.argmin())
        return langs[best], float(1 - far[best])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(text_at)]
            kept = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] in names]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*kept, *more], names=names)

    return run


def identify(docs: DataFrame, model: dict[str, dict[int, int]], text_col: str = "text", size: int = PROFILE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred and score.

    lang_pred: the language whose profile is nearest, the first by name where several
    are; ``und`` with score 0 where the text is null, empty or without letters, or the
    model is empty. score: 1 less the distance, from 0 (no n-gram in place) to 1. Whole
    texts of any length are read, in parts. Rows stay as they are, repeated ones too; an
    empty table gives an empty table; added names take a leading underscore where ``docs``
    has them.
    """
    kept = [c for c in docs.columns if keep is None or c in keep]
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    schema = docs.limit(0).select(*kept, F.lit("").alias(pred), F.lit(0.0).alias(score)).schema
    return docs.mapInArrow(_judge(model, size, docs.columns.index(text_col), schema.names), schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo ``FOLDS``, is 0; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = profiles(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
