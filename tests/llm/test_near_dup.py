import random
import re

from matchgrid.llm import near_dup


def _set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    return set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())


def _brute(rows):
    sets = [_set(t) for _, t in rows]
    head = list(range(len(rows)))

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = top(i), top(j)
                head[max(p, q)] = min(p, q)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), k), k)
    return sorted((k, len(sets[i]), low[top(i)], k == low[top(i)]) for i, (k, _) in enumerate(rows))


def test_query_matches_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, near_dup.op9_minhash(spark, sf).collect())) == _brute(rows)


def test_families_of_graded_copies(spark):
    rng = random.Random(3)
    rows = []
    for f in range(4):
        base = [f"w{rng.randrange(400)}" for _ in range(60 + 40 * f)]
        for i in range(40):
            words = base[:]
            for _ in range(i // 4):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((f * 1000 + (i * 17) % 40, " ".join(words)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = got.select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == _brute(rows)


def test_nulls_short_texts_ties_and_clashing_names(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  TWO"), (6, "two one"), (7, "É a b c d e"), (8, "é a b c d e"), (9, "a b c"), (9, "a b c"), (10, "a\x1cb c")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, component_id int, kept string")
    got = near_dup.near_duplicates(docs)
    assert got.columns == [*docs.columns, "n_shingles", "_component_id", "_kept", "keeper"]
    assert sorted((r["doc_id"], r["n_shingles"], r["_component_id"], r["_kept"]) for r in got.collect()) == _brute(rows)
    assert got.where("keeper").count() == 9
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    other = words[:]
    for i in range(0, len(other), 50):
        other[i] = f"x{i}"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:100_000])), (4, " ".join(reversed(words)))]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == _brute(rows)
