"""Token counts by trie-shared dynamic programming.

Distinct pre-tokens (white-space words with the word-start mark) are inserted in a trie. A
node is a prefix; its best unigram score and token count are computed when it is made, once
for all words below it, from the nodes above it. The node where a word ends gives the word's
token count; a document's count is the sum over its words. A worker keeps its trie, and the
terminal counts of its words, from batch to batch within bounds; nothing is shuffled.

No public vocabulary here has unigram probabilities, and tokenizers are not trained: a
piece's weight follows its rank in the file (``unigram_scores``), so the counts are those of
that model and of no published tokenizer.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.llm.common import free_name, table

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Added to the score of a character that no piece covers; it costs one token a UTF-8 byte.
UNKNOWN_PENALTY = -10.0
#: Entries of a worker's cache of word counts; it is emptied when full.
WORD_CACHE = 500_000
#: Nodes of a worker's trie (about 200 bytes each); a larger one is dropped before the next slice of words.
TRIE_NODES = 500_000
SLICE = 2_000
#: Longer words are scored along their path alone and leave no nodes.
LONG_WORD = 64

_worker: dict = {}


def unigram_scores(vocabulary: str) -> dict[str, float]:
    """piece -> log probability. The file ranks its pieces without probabilities; the rank's Zipf weight, normalised, stands for one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - total for r, p in enumerate(pieces, 1)}


class PrefixCounter:
    """A trie of words with the forward state of each prefix: its best score, and the fewest tokens that reach it."""

    def __init__(self, scores: dict[str, float]):
        #: Each end of a piece -> the score of the piece that it is, or None: what is no end of a piece has no longer one before it.
        self.ends: dict[str, float | None] = dict.fromkeys(p[i:] for p in scores for i in range(1, len(p))) | scores
        self.floor = min(scores.values(), default=0.0) + UNKNOWN_PENALTY
        self.nodes = 0
        self._plant()

    def _plant(self) -> None:
        self.children: dict[int, int] = {}  # node << 21 | code point -> node
        self.score, self.tokens = [0.0], [0]

    def count(self, words: list[str]) -> dict[str, int]:
        found = {}
        for a in range(0, len(words), SLICE):
            if len(self.score) > TRIE_NODES:
                self._plant()
            for word in words[a : a + SLICE]:
                found[word] = self._insert(MARK + word) if len(word) <= LONG_WORD else self._along(MARK + word)
        return found

    def _insert(self, full: str) -> int:
        children, scores, tokens, node, path = self.children, self.score, self.tokens, 0, [0]
        for end, c in enumerate(full, 1):
            key = node << 21 | ord(c)
            node = children.get(key, 0)
            if not node:
                score, n = self._state(full, end, scores, tokens, path)
                node = children[key] = len(scores)
                scores.append(score)
                tokens.append(n)
            path.append(node)
        return tokens[node]

    def _along(self, full: str) -> int:
        scores, tokens, path = [0.0], [0], range(len(full) + 1)
        for end in path[1:]:
            score, n = self._state(full, end, scores, tokens, path)
            scores.append(score)
            tokens.append(n)
        return tokens[-1]

    def _state(self, full: str, end: int, scores: list[float], tokens: list[int], path: Sequence[int]) -> tuple[float, int]:
        """The best (score, tokens) of the prefix that ends here, of the states along ``path`` before it; the fewer tokens where scores tie."""
        self.nodes += 1
        start = end - 1
        at = path[start]
        best, fewest = scores[at] + self.floor, tokens[at] + len(full[start].encode("utf-8", "surrogatepass"))
        ends = self.ends
        while start >= 0:
            piece = full[start:end]
            if piece not in ends:
                break
            s = ends[piece]
            if s is not None:
                at = path[start]
                score, n = scores[at] + s, tokens[at] + 1
                if score > best or score == best and n < fewest:
                    best, fewest = score, n
            start -= 1
        return best, fewest


def _counter(vocabulary: str, text_at: int, keep: list[int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _worker.get("vocabulary") != vocabulary:
            _worker.update(vocabulary=vocabulary, counter=PrefixCounter(unigram_scores(vocabulary)), known={})
        known = _worker["known"]
        for batch in batches:
            docs = [Counter((t.as_py() or "").split()) for t in batch.column(text_at)]
            if len(known) > WORD_CACHE:
                known.clear()
            new = set().union(*docs).difference(known)
            known.update(_worker["counter"].count(list(new)))
            more = [
                pa.array([sum(d.values()) for d in docs], pa.int64()),
                pa.array([len(d) for d in docs], pa.int64()),
                pa.array([sum(n * known[w] for w, n in d.items()) for d in docs], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *more], names=names)

    return run


def count_tokens(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_pretokens, n_distinct and n_tokens.

    Null, empty and white-space texts have 0 of each. Repeated rows stay; an empty table
    gives an empty table. Whole texts are read, of any length; added names take a leading
    underscore where ``docs`` has them.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    at = [i for i, c in enumerate(docs.columns) if keep is None or c in keep]
    new = [free_name(docs, c) for c in ("n_pretokens", "n_distinct", "n_tokens")]
    schema = docs.limit(0).select(*(docs.columns[i] for i in at), *(F.lit(0).cast("long").alias(c) for c in new)).schema
    return docs.mapInArrow(_counter(path, docs.columns.index(text_col), at, schema.names), schema)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
