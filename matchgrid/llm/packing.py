"""Packing into training sequences: cutting-stock column generation over a length histogram.

1. Documents are tokenised once, in Arrow batches. Full-length pieces are cut off
   from the front; what is left is shorter than a sequence. The pieces (with their ids
   where those are asked for) are written to the shared folder; later steps read thin columns.
2. Rest lengths, rounded up to classes of ``GRANULARITY`` tokens, give a histogram of
   bounded size. The driver solves the cutting-stock program over it (``cutting``).
3. Pieces of a class are ranked, in parallel and reproducibly; each rank has one slot
   of one pattern instance. A sequence's offsets are sums of its pieces' lengths.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrid.llm import cutting
from matchgrid.llm.common import table, write_table

SEQUENCE = 2048
GRANULARITY = 8
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Entries of each of a worker's two caches; half goes when one is full.
CACHE = 200_000
#: Pieces that one ranking task gets on average.
RANK_ROWS = 20_000

#: The vocabulary's pre-tokens in lower-cased text (fixed value).
_PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_worker: dict = {}


#: Bytes that byte-level vocabularies write as other characters, and those.
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


class _Pieces(dict):
    """pre-token -> ids; what is missing goes to the tokenizer's model."""

    def __init__(self, tokenizer):
        self.cut = tokenizer.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        written = piece.encode().decode("latin-1").translate(_BYTES)
        ids = self[piece] = array("I", [t.id for t in self.cut(written)]).tobytes()
        return ids


class _Chunks(dict):
    """White-space chunk -> ids; what is missing is put together from its pre-tokens."""

    def __init__(self, pieces: _Pieces):
        self.piece = pieces.__getitem__

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = b"".join(map(self.piece, _PRE_TOKENS.findall(chunk)))
        return ids


#: Latin-1 text that shows whether a vocabulary lower-cases, drops white space and cuts pre-tokens as ``_PRE_TOKENS`` does.
_PROBE = "It's Don't we'LL 12 a1b2 ÀÉß x--y (z)! caf\xe9\n\tEND " + " ".join(chr(c) for c in range(1, 256) if c not in range(0x1C, 0x20)) + " " + "".join(chr(c) for c in range(33, 256))


class Encoder:
    """text -> bytes, the ids as little-endian unsigned 32-bit numbers.

    No token spans white space or two pre-tokens, so ids are kept by white-space chunk and
    by pre-token: the model sees a pre-token once per worker, however often the corpus
    repeats it. Pre-tokens are cut here only in Latin-1 texts, where lower-casing and the
    vocabulary's pattern are beyond doubt; other texts, and those with special tokens, go
    to the tokenizer as they are.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.pieces = _Pieces(self.tokenizer)
        self.chunks = _Chunks(self.pieces)
        # another vocabulary may cut texts otherwise; then all of them go to the tokenizer
        self.known = self._fast(_PROBE) == self._slow(_PROBE)

    def __call__(self, text: str) -> bytes:
        return self._fast(text) if self.known and _plain(text) else self._slow(text)

    def _slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _fast(self, text: str) -> bytes:
        for cache in (self.chunks, self.pieces):
            if len(cache) > CACHE:  # the oldest entries are the commonest
                for k in list(islice(cache, CACHE // 2, None)):
                    del cache[k]
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))


def _plain(text: str) -> bool:
    """Latin-1 without special tokens and without the separators that only ``str.split`` takes for white space."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f")


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder."""
    if _worker.get("vocabulary") != vocabulary:
        _worker.update(vocabulary=vocabulary, encoder=Encoder(vocabulary))
    return _worker["encoder"]


def _cutter(vocabulary: str, length: int, granularity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "units", "ids"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        doc = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                rows = []
                for key, text in zip(keys[at : at + 256], texts.slice(at, 256), strict=True):
                    ids = encode(text.as_py() or "") + end
                    n = len(ids) // 4
                    for start in range(0, n, length):
                        piece = ids[4 * start : 4 * (start + length)]
                        k = len(piece) // 4
                        rows.append((doc, key, start, k, zlib.crc32(piece), n, -(-k // granularity), piece if with_ids else None))
                    doc += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = SEQUENCE,
    granularity: int = GRANULARITY,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ids (neither written nor joined where ``with_ids`` is false): the piece's token ids, little-endian unsigned 32-bit. doc numbers the input
    rows, so repeated rows and repeated ids stay apart. Null text counts as empty: a
    document of the end id alone. A null id is kept. An empty table gives no pieces.
    Other columns of ``docs`` are not read. Sequence ids start at 0 without gaps.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, units int, ids binary"
    pieces = write_table(thin.mapInArrow(_cutter(path, length, granularity, end_id, with_ids), schema), "pieces")
    placed = _place(pieces.drop("ids"), -(-length // granularity), pieces.count())
    if not with_ids:
        return placed
    return placed.join(pieces.select("doc", "start", "ids"), ["doc", "start"])


def _place(pieces: DataFrame, capacity: int, total: int) -> DataFrame:
    spark = pieces.sparkSession
    # ranks: hash buckets split a length that a third of all pieces share; counts of
    # (class, bucket) give each bucket's first rank
    buckets = max(1, -(-total // RANK_ROWS))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc", "start"), F.lit(buckets)).cast("int"))
    counts = write_table(keyed.groupBy("units", "bucket").agg(F.count("*").alias("n")), "counts")
    # at most `capacity` rows reach the driver
    histogram = sorted((r[0], r[1]) for r in counts.groupBy("units").agg(F.sum("n")).collect())
    slots = _slots(histogram, capacity)
    before = F.sum("n").over(W.partitionBy("units").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    firsts = counts.select("units", "bucket", F.coalesce(before, F.lit(0)).alias("first"))
    rank = F.row_number().over(W.partitionBy("units", "bucket").orderBy("doc", "start")) - 1
    ranked = keyed.join(firsts, ["units", "bucket"]).withColumn("rank", rank + F.col("first"))
    # slots: bounded by the patterns, at most a few per class and pattern
    table_ = F.broadcast(spark.createDataFrame(slots, "s_units int, lo long, hi long, each long, base long, slot long"))
    met = ranked.join(table_, (F.col("units") == F.col("s_units")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    at = F.col("rank") - F.col("lo")
    met = met.withColumn("sequence_id", F.col("base") + F.floor(at / F.col("each"))).withColumn("place", F.col("slot") + at % F.col("each"))
    earlier = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    return met.select(
        "doc", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset")
    )


def _slots(histogram: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, slots in a sequence, first sequence, first slot) of each class of each pattern."""
    sizes = np.array([u for u, _ in histogram], np.int64)
    demand = np.array([n for _, n in histogram], np.int64)
    given = np.zeros(len(sizes), np.int64)
    rows, base = [], 0
    for pattern, times in cutting.solve(sizes, demand, capacity):
        slot = 0
        for i in np.flatnonzero(pattern)[::-1]:
            k = int(pattern[i])
            rows.append((int(sizes[i]), int(given[i]), int(given[i]) + k * times, k, base, slot))
            given[i] += k * times
            slot += k
        base += times
    assert (given == demand).all(), "every piece has one slot"
    return rows


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("doc")
