import numpy as np
from matchgrid.llm import embed_dup


def _brute(rows, cosine=0.98):
    ids = [r[0] for r in rows]
    n = len(rows)
    head = list(range(n))
    links = [0] * n

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if a[2] is None or a[2] != b[2] or not (good(a[1]) and good(b[1])) or len(a[1]) != len(b[1]):
                continue
            x, y = np.array(a[1], float), np.array(b[1], float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                p, q = top(i), top(j)
                head[max(p, q)] = min(p, q)
    low = {}
    for i in range(n):
        low[top(i)] = min(low.get(top(i), ids[i]), ids[i])
    return sorted((ids[i], links[i], low[top(i)], ids[i] == low[top(i)]) for i in range(n))


def test_query_matches_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, embed_dup.op5_embeddings(spark, sf).collect())) == _brute(rows)


def test_cells_and_blocks_lose_and_invent_nothing(spark, monkeypatch):
    monkeypatch.setattr(embed_dup, "CELL", 20)
    monkeypatch.setattr(embed_dup, "BLOCK", 8)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(260):
        base = rng.normal(size=6) if i % 3 or not rows else np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=6) * 0.12
        rows.append((i * 7 % 263, [float(np.float32(x)) for x in base], int(i % 2)))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)]
    got = embed_dup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).drop("embedding", "label")
    assert sorted(map(tuple, got.collect())) == _brute(rows)


def test_copies_over_borders_stay_few(spark, monkeypatch, tmp_path):
    """Vectors without structure, where pruning is hardest: below two rows a vector at two cells a label, and no label's cells cut another's."""
    monkeypatch.setattr(embed_dup, "CELL", 500)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=64)], i % 3 if i % 10 else None) for i in range(3300)]
    written = {}
    kept = embed_dup.write_table
    monkeypatch.setattr(embed_dup, "write_table", lambda df, tag: written.setdefault(tag, kept(df, tag)))
    monkeypatch.setattr(embed_dup, "forget", lambda *t: None)
    got = embed_dup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).drop("embedding", "label")
    assert sorted(map(tuple, got.collect())) == sorted((i, 0, i, True) for i, _, _ in rows)
    cells = written["cells"].groupBy("label").agg({"*": "count", "cell": "max"}).collect()
    assert len(cells) == 3 and all(r["max(cell)"] == 1 and r["count(1)"] < 2 * 990 for r in cells)


def test_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(embed_dup, "CELL", 4)
    rng = np.random.default_rng(6)
    base = rng.normal(size=20_000)
    rows = [(i, [float(x) for x in (base + rng.normal(size=20_000) * (0.1 if i % 2 else 2))], 1) for i in range(12)]
    rows.append((50, rows[0][1][:-1], 1))
    got = embed_dup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).drop("embedding", "label")
    assert sorted(map(tuple, got.collect())) == _brute(rows)


def test_pivots_that_nearly_coincide_lose_nothing(spark, monkeypatch):
    """Copies that differ in scale or in a last bit are classes of their own, and most pivots are among them."""
    monkeypatch.setattr(embed_dup, "CELL", 10)
    monkeypatch.setattr(embed_dup, "BLOCK", 32)
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8).astype(np.float32)
    rows = []
    for i in range(160):
        v = hot.copy()
        if i < 60:
            v[i % 8] = np.nextafter(v[i % 8], np.float32(9 if i % 2 else -9))
        v = v * np.float32(1 + i // 8)
        if i >= 100:
            v = v + (rng.normal(size=8) * 0.1).astype(np.float32) * np.abs(v).max()
        rows.append((i, [float(x) for x in v], 1))
    rows += [(200 + i, [float(np.float32(x)) for x in rng.normal(size=8)], 1) for i in range(40)]
    got = embed_dup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).drop("embedding", "label")
    assert sorted(map(tuple, got.collect())) == _brute(rows)
    p = np.array([v for _, v, _ in rows])
    p = embed_dup._spread(p / np.linalg.norm(p, axis=1)[:, None])
    assert 40 < len(p) < 160
    assert min(np.linalg.norm(p[i] - p[j]) for i in range(len(p)) for j in range(i)) > embed_dup.APART


def test_bad_vectors_link_with_nothing(spark):
    v = [1.0, 0.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [1.0, float("nan")], 1), (9, [1.0, float("inf")], 1), (10, [2.0, 0.0], 1), (2, v, 1), (11, [1e-200, 0.0], 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = sorted((r["vec_id"], r["_n_links"], r["component_id"]) for r in embed_dup.near_vectors(df).collect())
    assert got == [(1, 4, 1), (2, 4, 1), (2, 4, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 4, 1), (11, 4, 1)]
    assert embed_dup.near_vectors(df.limit(0)).count() == 0
