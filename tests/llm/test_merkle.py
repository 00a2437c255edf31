import hashlib
import random
import zlib

import pytest
from matchgrid.llm import merkle
from pyspark.sql import functions as F


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def _siblings(levels, at):
    found = []
    for row in levels[:-1]:
        pair = row[at // 2 * 2 : at // 2 * 2 + 2]
        found += pair[: at % 2] + pair[at % 2 + 1 :]
        at //= 2
    return found


def _leaf(*values):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _brute(rows):
    """{(id, leaf): (subroot, root, proof, folded, verified)} of rows (doc_id, source, lang, n_chars, text) whose (lang, id, leaf) differ."""
    key = lambda x: (x is not None, str(x or "").encode())
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(*r), r))
    trees = {lang: _levels([x[2] for x in sorted(groups[lang], key=lambda x: x[:3])]) for lang in sorted(groups, key=key)}
    top = _levels([t[-1][0] for t in trees.values()])
    out = {}
    for i, (lang, tree) in enumerate(trees.items()):
        for at, (_, _, leaf, r) in enumerate(sorted(groups[lang], key=lambda x: x[:3])):
            proof = _siblings(tree, at) + _siblings(top, i)
            bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now, rest = _leaf(*r[:3], r[3] + 1, r[4]) if bad else leaf, list(proof)
            for levels, p in ((tree, at), (top, i)):
                for row in levels[:-1]:
                    now = _h(rest.pop(0), now) if p % 2 else _h(now, rest.pop(0)) if p + 1 < len(row) else _h(now)
                    p //= 2
            out[r[0], leaf] = (tree[-1][0], top[-1][0], _h(*proof), now, now == top[-1][0])
    return out


def _proved(docs):
    fields = [F.col(c) for c in merkle.FIELDS]
    forged = merkle.leaf_digest([*fields[:3], F.col("n_chars") + 1, fields[4]])
    return merkle.prove(docs, merkle.leaf_digest(fields), F.col("lang"), "doc_id", F.when(merkle.tampered(), forged))


@pytest.mark.parametrize("subtree", [1, 2, 3, 5])
def test_paths_are_those_of_the_whole_tree_in_bounded_memory(subtree):
    rng = random.Random(subtree)
    for n in [1, 2, 3, 7, 8, 9, 31, 64, 100]:
        leaves = [_h(str(rng.random())) for _ in range(n)]
        levels = _levels(leaves)
        root, paths = merkle.traverse([x.encode() for x in leaves], merkle.height_of(n), subtree)
        assert root.decode() == levels[-1][0]
        assert [[x.decode() for x in p] for p in paths] == [_siblings(levels, i) for i in range(n)]


def test_desired_subtrees_are_whole_in_time_and_hold_few_nodes():
    grows = merkle.Growing([b"x"] * 64, 0, 2, 5)
    most = 0
    for _ in range(32):
        _ = grows.step() and grows.step()
        most = max(most, len(grows.stack))
    assert not grows.step() and grows.stack[0][0] == 5 and most <= 6
    assert sorted(grows.nodes) == [(h, i) for h in (2, 3, 4) for i in range(32 >> h)]


def test_a_lone_block_goes_up_to_the_height_of_the_others(spark, monkeypatch):
    leaf = _h("a")
    root, _ = merkle.traverse([leaf.encode()], 3)
    assert root.decode() == _h(_h(_h(leaf)))


def test_matches_brute_force_over_many_blocks_and_levels(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", None]), rng.choice(["en", "en", "en", "de", "é", None]), rng.choice([5, None]), rng.choice(["", None, "tëxt\n", "x" * 50])) for i in range(3000)]
    rows += [(5000, "s", "lone", 1, "t"), (None, "s", "de", 2, "u"), (7, None, "en", 5, "another of this id")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    want = _brute(rows)
    got = {(r["row"]["doc_id"], r["leaf"]): tuple(r)[2:4] + tuple(r)[5:] for r in _proved(docs).collect()}
    assert got == want and not all(x[-1] for x in want.values())


def test_small_blocks_make_many_levels(spark, monkeypatch):
    rows = [(i, "s", "en" if i % 9 else "de", i, "t" * (i % 5)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    want = _brute(rows)
    monkeypatch.setattr(merkle, "BLOCK_BITS", 2)
    bits = merkle._blocks

    def small(*at):  # workers have the module's own constant
        run = bits(*at)

        def f(block):
            merkle.BLOCK_BITS = 2
            return run(block)

        return f

    monkeypatch.setattr(merkle, "_blocks", small)
    got = {(r["row"]["doc_id"], r["leaf"]): tuple(r)[2:4] + tuple(r)[5:] for r in _proved(docs).collect()}
    assert got == want


def test_repeated_rows_long_texts_clashing_names_and_empty_tables(spark):
    rows = [(1, None, None, 3, "x" * 300_000, 9, "r")] * 5 + [(2, "s", "en", None, None, 9, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, leaf int, root string")
    got = _proved(docs).collect()
    assert len(got) == 6 and len({r["root"] for r in got}) == 1 and len({r["leaf"] for r in got}) == 2
    # equal leaves stand at different places
    assert len({r["proof_sha256"] for r in got if r["row"]["doc_id"] == 1}) > 1
    assert all(r["row"]["leaf"] == 9 for r in got) and all(len(r["siblings"]) % 32 == 0 for r in got)
    assert _proved(docs.limit(0)).count() == 0


def test_places_cross_tasks_and_groups(spark):
    from matchgrid.llm.common import placed

    rows = [("a" if i % 3 else "b", i // 4) for i in range(500)] + [(f"g{i}", 1) for i in range(40)]
    got = placed(spark.createDataFrame(rows, "g string, v int").repartition(7), "g", ["v"]).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r["place"], r["v"]) for r in got if r["g"] == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for x, v in rows if x == g)
