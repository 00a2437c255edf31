import random

import pytest
from matchgrid.functions.text import fold_ascii
from matchgrid.operators import resolve
from pyspark.sql import functions as F

LETTERS, WEIGHTS = "etaoinshrdlucmfwypvbgkjqxz", (12, 9, 8, 7.5, 7, 6.7, 6.3, 6.1, 6, 4.3, 4, 2.8, 2.8, 2.4, 2.4, 2.2, 2, 1.9, 1, 1.5, 2, 0.8, 0.15, 0.1, 0.15, 0.07)


def _word(rng):
    return "".join(rng.choices(LETTERS, WEIGHTS, k=rng.randint(3, 9)))


def _spoiled(rng, name):
    name = list(name)
    for _ in range(rng.randrange(0, 4)):
        i = rng.randrange(len(name))
        name[i : i + 1] = rng.choice([[], [rng.choice(LETTERS)], [name[i], rng.choice(LETTERS)]])
        name = name or ["x"]
    parts = "".join(name).split()
    rng.shuffle(parts)
    return " ".join(parts) or "x"


def _names(rng, n, firsts):
    first = [_word(rng) for _ in range(firsts)]
    names = sorted({" ".join([rng.choice(first), *(_word(rng) for _ in range(rng.choice([0, 1, 1, 1, 2])))]) for _ in range(n)})
    return names, sorted({_spoiled(rng, rng.choice(names)) for _ in range(n)})


def _keys(spark, names):
    return spark.createDataFrame([(x,) for x in names], "key string")


@pytest.mark.parametrize("threshold", [78, 80, 82, 90])
def test_candidates_lose_no_pair_and_are_few(spark, threshold):
    names, targets = _names(random.Random(threshold), 700, 120)
    names += ["éa", "", "!!", "x", "ab", "van der berg de la cruz maria jose", "van der berg de la cruz mario jose antonio"]
    targets += ["maria jose van der burg de la krus", "", "?", "a b", "xx"]
    names, targets = sorted(set(names)), sorted(set(targets))
    left, right = _keys(spark, targets), _keys(spark, names)
    got = {(r["l"], r["r"]): r["score"] for r in resolve.similar(left, right, threshold).collect()}
    want = {(a, b): s for a in targets for b in names if (s := resolve.token_set_ratio(a, b)) >= threshold}
    assert got == want and len(want) > 500
    assert resolve.candidates(left, right, threshold).count() < 0.05 * len(names) * len(targets)


def test_a_common_name_is_no_key_where_rarer_ones_tell(spark):
    names = [f"maria {w}" for w in {_word(random.Random(i)) for i in range(300)}]
    left = _keys(spark, names)
    assert resolve._rarest(left, left, 80).where("token = 'maria'").count() < 0.35 * len(names)  # those whose other name is short
    pairs = resolve.candidates(left, left, 80).count()
    assert pairs < 0.35 * len(names) ** 2


def test_letters_bound_the_edits():
    rng = random.Random(5)
    for _ in range(300):
        a = _word(rng) + " " + _word(rng)
        b = _spoiled(rng, a)
        x, y = (" ".join(resolve.name_tokens(n)) for n in (a, b))
        edits = len(x) + len(y) - 2 * resolve._common(x, y)
        assert ((resolve.letter_bits(a) ^ resolve.letter_bits(b)) & (1 << 64) - 1).bit_count() <= edits


def _sequential(targets, roster, threshold):
    """The matcher, name by name: [(seq, name of the one it joins or None, score)]."""
    known, out = {}, []
    for name, _, _ in sorted(roster, key=lambda r: r[2]):
        known[fold_ascii(name)] = name
    for name, seq in sorted(targets, key=lambda t: t[1]):
        key, best, score = fold_ascii(name), None, 0
        for other in known:
            s = resolve.token_set_ratio(key, other)
            if s > score:
                best, score = other, s
        if score >= threshold:
            out.append((seq, known[best], score))
        else:
            known[key] = name
            out.append((seq, None, None))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_registration_equals_the_sequential_matcher_in_any_order(spark, seed):
    rng = random.Random(seed)
    base = [_word(rng) + " " + _word(rng) for _ in range(12)]
    roster = [(n, f"id{i}", i) for i, n in enumerate([*base[:4], "José Pérez", "Jose Perez"])]
    names = [_spoiled(rng, rng.choice(base)) for _ in range(50)] + ["jose perez lopez", "!!", "!!", base[0], base[5], base[5], "José Perez"]
    rng.shuffle(names)
    targets = [(n, i * 3) for i, n in enumerate(names)]
    got = resolve.register(spark.createDataFrame(targets, "target string, seq int"), spark.createDataFrame(roster, "name string, entity_id string, pos int")).collect()
    want = _sequential(targets, roster, 80)
    assert sorted((r["seq"], r["name"], r["score"]) for r in got) == want
    ids = {r["seq"]: r["entity_id"] for r in got}
    assert len({ids[s] for s, n, _ in want if n is None}) == sum(n is None for _, n, _ in want)
    first = {n: s for n, s in reversed(targets)}
    for s, n, _ in want:
        known = {r[0]: r[1] for r in roster}
        if n is not None:
            assert ids[s] == known[n] if n in known else ids[s] in {ids[x] for t, x in targets if t == n}
    assert first


def test_a_chain_of_similar_names_is_settled_in_order(spark):
    names = ["abcdefghij", "abcdefghix", "abcdefghyx", "abcdefgzyx", "abcdefqzyx"]
    roster = spark.createDataFrame([], "name string, entity_id string, pos int")
    for order in (names, names[::-1], names[2:] + names[:2]):
        targets = [(n, i) for i, n in enumerate(order)]
        got = resolve.register(spark.createDataFrame(targets, "target string, seq int"), roster).collect()
        assert sorted((r["seq"], r["name"], r["score"]) for r in got) == _sequential(targets, [], 80)


def test_nulls_and_empty_tables(spark):
    roster = spark.createDataFrame([("Ann Lee", "a", 1), (None, "n", 2)], "name string, entity_id string, pos int")
    targets = spark.createDataFrame([("Ann Lee", 1), (None, 2), ("", 3)], "target string, seq int")
    rows = {r["seq"]: r for r in resolve.register(targets, roster).collect()}
    assert rows[1]["entity_id"] == "a" and rows[2]["is_new"] and rows[3]["is_new"] and len(rows) == 3
    assert resolve.register(targets.limit(0), roster).count() == 0
    assert resolve.register(targets, roster.limit(0)).where("is_new").count() == 3


def test_line_ups_to_ids_to_teams(spark):
    line_ups = spark.createDataFrame(
        [("Ann Lee", "A", 1), ("Bob Stone", "B", 2), ("Ann Lee", "C", 3), ("Lee Ann", "D", 4), ("", "A", 5), (None, "A", 6), ("New Person", "B", 7)],
        "player_name string, team string, seq int",
    )
    roster = spark.createDataFrame([("Ann Lee", "1", 1), ("Bob Stone", "2", 2), ("Cy Young", "3", 3)], "name string, entity_id string, pos int")
    assert {r["target"]: r["team"] for r in resolve.line_up_teams(line_ups).collect()} == {"Ann Lee": "A", "Bob Stone": "B", "Lee Ann": "D", "New Person": "B"}
    # two names join one player: the later one decides
    assert {r["entity_id"]: r["team"] for r in resolve.ids_to_teams(line_ups, roster).collect()} == {"1": "D", "2": "B"}
    assert resolve.ids_to_teams(line_ups.limit(0), roster).select(F.count("*")).first()[0] == 0


def test_exploded_names_are_never_broadcast(spark):
    names = _keys(spark, [f"{a} {b}" for a, b in zip(_names(random.Random(3), 200, 20)[0], "abcdefghijklmnop" * 20)])
    broad = lambda df: "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    assert not broad(resolve.candidates(names, names, 80))
    assert not broad(resolve.register(names.select(F.col("key").alias("target"), F.monotonically_increasing_id().alias("seq")), spark.createDataFrame([("Ann Lee", "a", 1)], "name string, entity_id string, pos int")))


def test_names_of_the_roster_are_not_compared_further(spark, monkeypatch):
    seen, whole = [], resolve.similar
    monkeypatch.setattr(resolve, "similar", lambda a, b, threshold: seen.append((threshold, a.count())) or whole(a, b, threshold))
    roster = [("Ann Lee", "a", 1), ("Bob Stone", "b", 2), ("Ann Maria Lee", "c", 3), ("x" * 150 + " " + "y" * 60, "d", 4)]
    targets = [("lee ann", 1), ("Bob Stone", 2), ("Bob Stones", 3), ("maria lee", 4), ("Cy Young", 5), ("Cy Youn", 6), ("x" * 150 + " " + "y" * 59, 7), ("Bob Stonez", 8)]
    got = resolve.register(spark.createDataFrame(targets, "target string, seq int"), spark.createDataFrame(roster, "name string, entity_id string, pos int")).collect()
    assert sorted((r["seq"], r["name"], r["score"]) for r in got) == _sequential(targets, roster, 80)
    assert seen[:2] == [(100, 8), (80, 4)]
