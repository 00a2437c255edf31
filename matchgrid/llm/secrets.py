"""Secret scans with corpus-wide ownership frequency.

Candidates are found in whole texts in Arrow batches. The hash of each candidate's
value is counted over the corpus by distinct repositories and owners, and both decide: a
value that many owners hold in many repositories, or a few owners in very many, is a
copied example; a random-looking one with few copies looks live, whoever holds them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.llm.common import free_name, table, write_table

#: kind -> (pattern, group that is the value, least length of the value), in the order of the spans.
BASE = {
    "assign": (
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: Published token formats that the method adds when their values look live.
ADDED = {
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    # from the start of a run, and without going back, so that long runs cost no more than their length
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", 0, 35),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+", 0, 64),
}
KINDS = [*BASE, *ADDED]
#: Owners that may hold a value which still counts as one owner's own, however little random it looks.
MAX_OWNERS = 1
#: Widely copied is a value that more owners than this hold, in more repositories than this.
WIDE_OWNERS, WIDE_REPOS = 4, 8
#: And one in more repositories than this, even of one owner or of none named.
HOT_REPOS = 100
#: Bits a character (of the value's own distribution) from which a value looks random: 32 random hex digits have about 3.7.
MIN_BITS = 3.1
#: A value with fewer different characters looks like a placeholder.
MIN_DISTINCT = 6
MASK = "<SECRET>"

#: ``[0-9a-f]{32,}`` finds the runs of ``[0-9a-f]+`` that are long enough, and no others.
_FAST = {k: re.compile(p if k != "hex" else r"[0-9a-f]{32,}") for k, (p, _, _) in (BASE | ADDED).items()}


def spans_of(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, value start, value end) of all candidates by start, then kind."""
    found = []
    for rank, (kind, (_, group, least)) in enumerate((BASE | ADDED).items()):
        for m in _FAST[kind].finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, kind, m.end(), m.start(group), m.end(group)))
    found.sort()
    return [(kind, start, end, a, b) for start, _, kind, end, a, b in found]


def looks_random(value: str) -> bool:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= MIN_BITS


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("from", pa.int64()), ("to", pa.int64()), ("hash", pa.int64()), ("plain", pa.bool_()), ("random", pa.bool_())])
_SPAN_SQL = "struct<kind:string,start:long,end:long,from:long,to:long,hash:long,plain:boolean,random:boolean>"


def _finder(text_at: int, keep: list[int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            counts, sums, spans = [], [], []
            for text in batch.column(text_at):
                text = text.as_py() or ""
                got = spans_of(text)
                base = [x for x in got if x[0] in BASE]
                counts.append([sum(x[0] == k for x in base) for k in BASE])
                sums.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, _, _ in base).encode()).hexdigest())
                spans.append(
                    [
                        (k, s, e, a, b, xxhash.xxh3_64_intdigest(text[a:b].encode("utf-8", "replace")) - (1 << 63), len(set(text[a:b])) < MIN_DISTINCT, looks_random(text[a:b]))
                        for k, s, e, a, b in got
                    ]
                )
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            spans_ = pa.array([[dict(zip(_SPAN.names, x, strict=True)) for x in s] for s in spans], pa.list_(_SPAN))
            more = [rows, *(pa.array(c, pa.int64()) for c in (zip(*counts) if counts else [[]] * len(BASE))), pa.array(sums, pa.string()), spans_]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *more], names=names)

    return run


def find_secrets(
    docs: DataFrame,
    text_col: str = "text",
    repo_col: str = "doc_id",
    owner_col: str = "source",
    max_owners: int = MAX_OWNERS,
    carry_text: bool = True,
) -> DataFrame:
    """Every row of ``docs`` with its candidates: all columns, then n_assign, n_access, n_hex, base_sha256, found.

    found: array of (kind, start, end, from, to, live, n_repos, n_owners) by start, then
    kind in the order of ``KINDS``; start and end in code points, end exclusive, from and
    to around the value alone. live: the value has at least ``MIN_DISTINCT`` different
    characters; it looks random or at most ``max_owners`` owners hold it; at most
    ``WIDE_OWNERS`` owners or at most ``WIDE_REPOS`` repositories hold it, and at most
    ``HOT_REPOS`` repositories do. Null and empty texts have no
    candidates; null owners count together as one owner, so do null repositories.
    Repeated rows stay, and count once in their repository. An empty table gives an empty
    table. ``carry_text`` false leaves the text column out.
    """
    keep = [i for i, c in enumerate(docs.columns) if carry_text or c != text_col]
    new = {k: free_name(docs, k) for k in ("row_key", "n_assign", "n_access", "n_hex", "base_sha256", "candidates")}
    kinds = ["long", "long", "long", "long", "string", f"array<{_SPAN_SQL}>"]
    kept = [docs.columns[i] for i in keep]
    schema = docs.limit(0).select(*kept, *(F.lit(None).cast(t).alias(n) for n, t in zip(new.values(), kinds, strict=True))).schema
    scanned = write_table(docs.mapInArrow(_finder(docs.columns.index(text_col), keep, schema.names), schema), "secrets")
    key, cands = new["row_key"], new["candidates"]
    some = scanned.where(F.size(cands) > 0)
    each = some.select(F.col(key).alias("r"), F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), F.explode(cands).alias("s"))
    known = frequencies(each.select(F.col("s.hash").alias("h"), "repo", "owner"))
    wide = (F.col("n_owners") > WIDE_OWNERS) & (F.col("n_repos") > WIDE_REPOS) | (F.col("n_repos") > HOT_REPOS)
    live = ~F.col("s.plain") & ~wide & (F.col("s.random") | (F.col("n_owners") <= max_owners))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("s.kind"))
    one = F.struct(F.col("s.start").alias("start"), order.alias("k"), *(F.col(f"s.{c}").alias(c) for c in ("kind", "end", "from", "to")), live.alias("live"), "n_repos", "n_owners")
    lists = each.join(known, F.col("s.hash") == F.col("h")).groupBy("r").agg(F.sort_array(F.collect_list(one)).alias("l"))
    tidy = F.transform("l", lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "start", "end", "from", "to", "live", "n_repos", "n_owners"))))
    found = free_name(docs, "found")
    lists = lists.select(F.col("r").alias(key), tidy.alias(found))
    none = scanned.where(F.size(cands) == 0).withColumn(found, F.array().cast(dict(lists.dtypes)[found]))
    # rows without candidates, nearly all, are not shuffled
    return some.join(lists, key).select(*none.columns).union(none).drop(key, cands)


def frequencies(values: DataFrame) -> DataFrame:
    """(h, n_repos, n_owners) of ``values(h, repo, owner)``; each step adds up before its shuffle, so a value in a third of all rows stays small."""
    owned = values.distinct().groupBy("h", "owner").agg(F.count("*").alias("n"))
    return owned.groupBy("h").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def _masker(text_at: int, found_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(text_at), batch.column(found_at), strict=True):
                text, at, out = text.as_py(), 0, []
                for s in found.as_py() or []:
                    if s["live"] and s["to"] > at:
                        out += [text[at : max(at, s["from"])], MASK]
                        at = s["to"]
                texts.append(text if not out else "".join([*out, text[at:]]))
            cols = [c for i, c in enumerate(batch.columns) if i != found_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != found_at]
            cols[names.index(batch.schema.names[text_at])] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def mask_secrets(docs: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """``docs`` with the values of live-looking secrets replaced by ``MASK``; copied examples and all other text stay. No row goes."""
    found = find_secrets(docs, text_col, repo_col, owner_col)
    last = free_name(docs, "found")
    found = found.select(*docs.columns, last)
    hit = F.exists(last, lambda s: s["live"])
    masked = found.where(hit).mapInArrow(_masker(docs.columns.index(text_col), len(docs.columns)), docs.schema)
    return masked.union(found.where(~hit).drop(last))


def span_list(found: str) -> Column:
    """kind:start:end of base spans and of live added ones, comma-joined."""
    stays = F.filter(found, lambda s: s["kind"].isin(*BASE) | s["live"])
    return F.array_join(F.transform(stays, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = find_secrets(docs, carry_text=False)
    live = F.size(F.filter("found", lambda s: s["live"])).cast("long")
    return found.select(
        "doc_id",
        *("n_assign", "n_access", "n_hex", "base_sha256"),
        span_list("found").alias("spans"),
        live.alias("n_live"),
        (F.size("found") - live).cast("long").alias("n_example"),
    )
