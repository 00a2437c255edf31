import zlib

import numpy as np
import public_tokenizers
from matchgrid.llm import cutting, packing
from tokenizers import Tokenizer


def _ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def _check(rows, docs, length=packing.SEQUENCE):
    """rows: pieces; docs: (doc_id, ids) by doc. Returns the padding's share."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    got = sorted((p[0]["doc_id"], tuple(np.concatenate([np.frombuffer(x["ids"], "<u4") for x in sorted(p, key=lambda x: x["start"])]))) for p in by_doc.values())
    assert got == sorted((k, tuple(v)) for k, v in docs)
    for p in by_doc.values():
        at = 0
        for x in sorted(p, key=lambda x: x["start"]):
            assert x["start"] == at and x["length"] == len(x["ids"]) // 4 and x["ids_crc32"] == zlib.crc32(x["ids"])
            at += x["length"]
        assert at == p[0]["doc_tokens"]
    total = 0
    for p in by_seq.values():
        at = 0
        for x in sorted(p, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= length
        total += at
    assert sorted(by_seq) == list(range(len(by_seq)))
    return 1 - total / (length * len(by_seq))


def test_documents_round_trip_with_little_padding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pdf = docs.toPandas()
    rows = packing.pack(docs).collect()
    assert _check(rows, list(zip(pdf.doc_id, _ids(pdf.text)))) < 0.05


def test_null_empty_odd_and_repeated_rows(spark):
    texts = [None, "", " \n", "don't 12 ab\x1ccd   　é é <|endoftext|> x<|endoftext|>y", "A" * 9000, "same text", "same text", "Ωσς ΑΣ"]
    data = [(i if i < 7 else None, t) for i, t in enumerate(texts)] + [(5, "same text")]
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "doc_id long, text string, ids int, sequence_id int")
    rows = packing.pack(df).collect()
    docs = [(k if k is not None else -1, tuple(v)) for (k, _), v in zip(data, _ids([t for _, t in data]))]
    rows = [r.asDict() | {"doc_id": r["doc_id"] if r["doc_id"] is not None else -1} for r in rows]
    _check(rows, docs)


def test_every_code_point_below_256_has_the_tokenizers_ids():
    encode = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"{a}{chr(i)}{b}" for i in range(256) for a, b in (("", ""), ("bell ", " here"), ("ab", "cd"), ("!", "?"), ("", "'s 1"))]
    texts += ["".join(map(chr, range(256))), "".join(chr(i) for i in range(256) if not 28 <= i <= 31)]
    for text, ids in zip(texts, _ids(texts), strict=True):
        assert np.frombuffer(encode(text), "<u4").tolist() == ids[:-1], ascii(text)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cutting_stock_meets_demand_near_the_bound():
    rng = np.random.default_rng(5)
    demand = np.bincount(rng.integers(1, 65, 5000), minlength=65)[1:]
    sizes = np.arange(1, 65)
    found = cutting.solve(sizes, demand, 64)
    assert (sum(p * n for p, n in found) == demand).all()
    assert all((p * sizes).sum() <= 64 for p, _ in found)
    assert sum(n for _, n in found) <= np.ceil((sizes * demand).sum() / 64) * 1.01


def test_pricing_is_the_best_knapsack():
    rng = np.random.default_rng(6)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 15), 4, replace=False))
        values = rng.random(4)
        best, counts = cutting.price(values, sizes, 20)
        brute = [0.0] * 21
        for c in range(1, 21):
            brute[c] = max([brute[c - 1], *(brute[c - s] + v for s, v in zip(sizes, values) if s <= c)])
        assert abs(best - brute[20]) < 1e-9 and counts @ sizes <= 20 and abs(counts @ values - best) < 1e-9


def test_other_vocabularies_go_to_their_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    for name, known in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        encode, tokenizer = packing.Encoder(path), Tokenizer.from_file(path)
        assert encode.known == known
        for text in ("Hello  World's\n\nfoo_bar 12.5 é", "a\tb", ""):
            assert list(np.frombuffer(encode(text), "<u4")) == tokenizer.encode(text, add_special_tokens=False).ids


def test_very_long_texts(spark):
    text = "word of the day " * 200_000
    got = packing.pack(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), with_ids=False).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 800_001 and all(r["doc_tokens"] == 800_001 for r in got if r["doc_id"] == 1)
