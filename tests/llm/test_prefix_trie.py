import hashlib
import random
import re
import zlib

from matchgrid.llm import prefix_trie as trie
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def _brute(rows):
    """The nodes of rows (conv_id, turn, role, text) without equal turns of one conversation but for equal texts."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + t[h:]
    nodes = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), set()).add(c)
    leaves = {k for k in nodes if not any(len(x) == len(k) + 1 and x[:-1] == k for x in nodes)}
    out = set()
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        saved = sum((len(nodes[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in members if tuple(whole[c]) == k)))
        children = sum(len(x) == len(k) + 1 for x in below)
        out.add((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children, sum(x in leaves for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _nodes(spark, rows):
    return trie.prefix_trie(trie.rebuilt(trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))))


def test_matches_brute_force_with_nulls_gaps_and_shared_beginnings(spark):
    rng = random.Random(1)
    rows = []
    for c in list(range(45)) + [100, 107, 133]:
        for turn in rng.sample([None, 0, 1, 2, 5, 9, 12, 13], rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, turn, rng.choice(["user", "user", None]), rng.choice(["hi", "hi there", "", None, "a  b\tc"])))
    rows += [(None, 0, "user", "left out")]
    rng.shuffle(rows)
    got = [tuple(r) for r in _nodes(spark, rows).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)


def test_long_and_equal_conversations(spark):
    long = [(20, i, "user", "w" * (i % 3)) for i in range(45)]
    rows = [(c, i, r, t + "!" * (c == 33 and i == 30)) for c in (20, 31, 32, 33, 200) for _, i, r, t in long]
    assert {tuple(r) for r in _nodes(spark, rows).collect()} == _brute(rows)


def test_conversations_left_without_turns_are_members_of_the_root(spark):
    c = next(c for c in range(1000, 2000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    none = hashlib.sha256(str(c).encode()).hexdigest()
    assert [tuple(r) for r in _nodes(spark, rows).collect()] == [(c, 0, None, 1, 0, 1, 0, none)]


def test_an_empty_table_has_no_nodes(spark):
    assert _nodes(spark, []).count() == 0 and _nodes(spark, [(None, 1, "user", "x")]).count() == 0


def test_texts_and_roles_do_not_run_into_each_other_and_extra_columns_are_ignored(spark):
    rows = [(1, 0, "ab", "c", 1), (2, 0, "a", "bc", 2), (3, 0, "ab", "c" * 200_000, 3)]
    turns = trie.ordered_turns(spark.createDataFrame(rows, SCHEMA + ", digest int"))
    assert turns.select("digest").distinct().count() == 3 and turns.columns == ["c", "i", "digest", "words"]


def test_names_are_dense(spark):
    rows = spark.createDataFrame([(i, i % 37) for i in range(500)], "c long, key long").repartition(9)
    got = {(r["key"], r["name"]) for r in trie.named(rows, ["key"], "name").collect()}
    assert len(got) == 37 and {n for _, n in got} == set(range(1, 38))


def test_digests_of_long_lists_take_chunks_in_order(spark):
    ends = spark.range(0, 3000).select((F.col("id") % 2).alias("v"), F.lit(1).cast("long").alias("d"), F.col("id").alias("c")).repartition(6)
    want = {v: hashlib.sha256(",".join(str(c) for c in range(v, 3000, 2)).encode()).hexdigest() for v in (0, 1)}
    assert {r["v"]: r["digest"] for r in trie.ends_digests(ends).collect()} == want
