import os
import re
import zlib
from collections import Counter

import corpus_pipeline as cp
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
from matchgrid.llm import common, language, mixing, packing, secrets
from matchgrid.llm.queries import QUERIES
from tokenizers import Tokenizer


def test_stages_end_to_end(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "packing"]
    kept = []
    for _, stage in cp.STAGES[:-1]:
        docs = cp.write_table(stage(spark, docs, sf), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(docs.collect())
    langs, deduped, masked, mixed = kept
    assert len(langs) == len(before)  # every document has a language here
    assert len(deduped) == len({r["doc_id"] for r in deduped}) < len(langs)
    assert {r["doc_id"] for r in masked} == {r["doc_id"] for r in deduped}
    for r in masked:
        assert r["n_chars"] == len(r["text"]) and (r["text"] == before[r["doc_id"]]["text"] or secrets.MASK in r["text"])
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    # a source's target is met to within half of one of its documents, which are taken whole or not at all
    longest = {}
    for r in masked:
        longest[r["source"]] = max(longest.get(r["source"], 0), len(r["text"].split()))
    assert abs(words(mixed) - 1.5 * words(masked)) <= sum(longest.values()) / 2 + 1
    assert {r["text"] for r in mixed} <= {r["text"] for r in masked}
    pieces = cp.run(spark, sf).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in mixed}
    fill = {}
    for r in pieces:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048 and np.mean(list(fill.values())) > 0.95 * 2048


def test_language_stage_rejects_letterless_documents(spark, sf):
    docs = spark.createDataFrame([(1, "the of and " * 9, "en", "s", 1), (2, "12 34", "en", "s", 1), (3, None, None, None, None), (4, "the and of", None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"], r["lang"]) for r in cp.language_stage(spark, docs, sf).collect()) == [(1, "en"), (4, "en")]


def test_language_stage_rejects_unlearned_languages_and_letter_noise(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    fi = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
    pl = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
    rng = np.random.default_rng(3)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   "), n)) for n in (64, 200, 1000, 9000)]
    bad = [fi[:64], fi, fi * 30, pl[:64], pl, pl * 30, *noise]
    clean = ["The people of the town", "and they were there that day with all of the others"]
    rows = [(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(bad)] + [(2 * 10**9 + i, t, None, "s", len(t)) for i, t in enumerate(clean)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["lang"] for r in cp.language_stage(spark, docs.unionByName(more), sf).collect()}
    assert set(kept) == ids | {2 * 10**9, 2 * 10**9 + 1}
    assert kept[2 * 10**9] == kept[2 * 10**9 + 1] == "en"


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0


def test_other_results_survive_a_run_and_its_own_tables_go(spark, sf):
    """An operator's result, and an earlier run's, can be read after a run; a run keeps only what its result reads."""
    with common.recording() as all_paths:
        found = QUERIES["op3_secrets"](spark, sf)
        first = cp.run(spark, sf)
    n = found.count(), first.count()
    with common.recording() as paths:
        again = cp.run(spark, sf)
    assert (found.count(), first.count()) == n and again.count() == n[1]
    left = [p for p in paths if os.path.exists(p.removeprefix("file://"))]
    assert left and all(p.rsplit("/", 1)[-1].split("-")[0] in ("pieces", "counts") for p in left)
    common.release(found, first, again)
    assert not [p for p in [*all_paths, *paths] if os.path.exists(p.removeprefix("file://"))]


def test_results_survive_later_stage_calls(spark, sf):
    """A run's result, a stage's and an operator's can all be read after other stages were called in the same thread."""
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = QUERIES["op3_secrets"](spark, sf), cp.run(spark, sf)
    n = [x.count() for x in pieces]
    deduped = cp.near_duplicate_stage(spark, cp.language_stage(spark, documents, sf), sf)
    kept = deduped.count()
    masked = cp.secrets_stage(spark, documents, sf)
    mixed = cp.mixing_stage(spark, documents, sf)
    assert [x.count() for x in pieces] == n and deduped.count() == kept and masked.count() == documents.count() and mixed.count() > 0
    common.release(*pieces, deduped, masked, mixed)


def _groups(rows):
    """doc_id -> smallest id that links reach, by all pairs."""
    sets = {r["doc_id"]: _shingles(r["text"]) for r in rows}
    head = {i: i for i in sets}

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = top(i), top(j)
                head[max(p, q)] = min(p, q)
    return {i: top(i) for i in sets}


def _shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())


def test_each_stage_matches_brute_force_on_its_input(spark, sf, tmp_path):
    """Whole inputs: groups by all pairs, secrets by one dictionary, the mix by SQL, pieces by the tokenizer itself."""
    docs, inputs, outputs = spark.read.parquet(f"{sf}/documents.parquet"), {}, {}
    for name, stage in cp.STAGES:
        inputs[name] = docs
        docs = cp.write_table(stage(spark, docs, sf), "test")
        outputs[name] = docs
        if name != "packing":
            docs.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
    rows = {n: d.collect() for n, d in outputs.items() if n == "packing"} | {n: spark.read.parquet(str(tmp_path / n)).collect() for n, _ in cp.STAGES[:-1]}

    groups = _groups(rows["language"])
    assert sorted(r["doc_id"] for r in rows["near_duplicates"]) == sorted(set(groups.values()))

    holders = {}
    for r in rows["near_duplicates"]:
        for _, _, _, a, b in secrets.spans_of(r["text"]):
            holders.setdefault(r["text"][a:b], set()).add((r["doc_id"], r["source"]))

    def masked(text):
        at, out = 0, ""
        for _, _, _, a, b in secrets.spans_of(text):
            n, owners = len(holders[text[a:b]]), len({o for _, o in holders[text[a:b]]})
            wide = owners > secrets.WIDE_OWNERS and n > secrets.WIDE_REPOS or n > secrets.HOT_REPOS
            if b > at and len(set(text[a:b])) >= secrets.MIN_DISTINCT and not wide and (secrets.looks_random(text[a:b]) or owners <= secrets.MAX_OWNERS):
                out, at = out + text[at : max(at, a)] + secrets.MASK, b
        return out + text[at:]

    assert {r["doc_id"]: r["text"] for r in rows["secrets"]} == {r["doc_id"]: masked(r["text"]) for r in rows["near_duplicates"]}

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/secrets/*.parquet'")
    wanted = db.execute(f"select doc_id, size * (taken // size + CAST(2 * (taken % size) >= size AS INTEGER)) from ({mixing.OP4_SQL}) where size > 0").fetchall()
    taken = {i: n for i, n in wanted if n}
    got = Counter()
    for r in rows["mixing"]:
        got[r["doc_id"]] += len(re.findall("[^\x20\x09-\x0d]+", r["text"]))
    assert got == taken

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = Counter()
    for r in rows["mixing"]:
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, packing.END_ID]
        for at in range(0, len(ids), packing.SEQUENCE):
            piece = ids[at : at + packing.SEQUENCE]
            want[r["doc_id"], at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows["packing"]) == want


def test_stages_take_nulls_ties_repeats_long_texts_and_clashing_names(spark, sf):
    prose = "the people of the town were there that day with all of the others and they sat by the river "
    rows = [(1, prose * 3, "en", "a"), (1, prose * 3, "en", "a"), (2, prose * 3, None, None), (None, prose + "but one of them", "en", "b"), (4, None, "en", "a"), (5, "", None, "a")]
    rows += [(6, prose + "password = hunter2hunter2x", "en", "c"), (7, prose * 8000, "en", "c"), (8, " \n\t", "en", None)]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, copies int")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.write_table(stage(spark, docs, sf), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "copies"]
        kept[name] = docs.collect()
    assert sorted(r["doc_id"] or 0 for r in kept["language"]) == [0, 1, 1, 2, 6, 7]
    assert sorted(r["doc_id"] or 0 for r in kept["near_duplicates"]) in ([0, 1, 6], [0, 1, 6, 7])
    assert [secrets.MASK in r["text"] for r in kept["secrets"] if r["doc_id"] == 6] == [True]
    pieces = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in kept["mixing"]}


def test_cutoffs_come_from_every_labelled_document(spark):
    """Exact quantiles over all beginnings, by one plain pass; a few documents that a sample would rarely hold move them."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    some = spark.createDataFrame([(10**9 + i, "en", "the of and to xqzjv kwpyq " * 3 + "zqxj vkwq jzxq " * 40) for i in range(40)], docs.schema)
    both = docs
    for _ in range(4):
        both = both.union(docs)  # 5,000 documents and more
    both = both.union(some)
    model = language.profiles(both)
    judge = language._judge(model, language.PROFILE, 0, ["lang_pred", "score"])
    scores, seen = {}, {}
    for r in both.where("lang is not null and text is not null").collect():
        for k in cp.LENGTHS:
            if len(r["text"]) >= 1 << k:
                front = r["text"][: 1 << k]
                if front not in seen:
                    batch = next(judge(iter([pa.RecordBatch.from_arrays([pa.array([front])], names=["text"])])))
                    seen[front] = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
                pred, score = seen[front]
                if pred == r["lang"]:
                    scores.setdefault((pred, k), []).append(score)
    low = {g: float(np.quantile(v, cp.QUANTILE)) for g, v in scores.items()}
    got = cp.score_cutoffs(both, model)
    assert set(got) == {(lang, k) for lang in model for k in cp.LENGTHS}
    for (lang, k), cut in got.items():
        own = [q for (l, j), q in low.items() if j <= k and l == lang] or [q for (_, j), q in low.items() if j <= k]
        assert abs(cut - max(cp.MIN_SCORE, cp.FACTOR * min(own, default=0.0))) < 1e-12
