import zlib
from collections import Counter

import numpy as np
from matchgrid.llm import language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = language.op10_language(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_distance_by_hand(spark):
    docs = spark.createDataFrame([("x", "aaa bb"), ("y", "cc dd cc"), (None, "zz")], "lang string, text string")
    model = language.profiles(docs)
    assert set(model) == {"x", "y"} and model["y"][language.key_of("c")] == 0 and model["x"][language.key_of("a")] == 0
    got = [tuple(r) for r in language.identify(spark.createDataFrame([("cc dd cc",), ("AAA bb",), (None,), ("12 !",), ("zz",)], "text string"), model, keep=[]).collect()]
    assert got[0] == ("y", 1.0) and got[1] == ("x", 1.0) and got[2] == got[3] == ("und", 0.0) and got[4] == ("x", 0.0)


def _grams(text):
    found, word = Counter(), ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            w = f"_{word}_"
            found.update(g for n in (1, 2, 3) for i in range(len(w) - n + 1) if (g := w[i : i + n]) != "_")
            word = ""
    return found


def test_whole_table_matches_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows}
    totals = {}
    for r in rows:
        if not held[r["doc_id"]] and r["lang"] is not None and r["text"] is not None:
            totals.setdefault(r["lang"], Counter()).update(_grams(r["text"]))
    size = language.PROFILE
    best = {lang: dict(sorted(n.items(), key=lambda x: (-x[1], language.key_of(x[0])))[:size]) for lang, n in totals.items()}
    model = {lang: {g: sum(m > n for m in counts.values()) for g, n in counts.items()} for lang, counts in best.items()}
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in language.op10_language(spark, sf).collect()}
    assert set(got) == set(held)
    for r in rows:
        counts = _grams(r["text"] or "")
        sizes = sorted(counts.values())
        mine = {g: len(sizes) - int(np.searchsorted(sizes, n, "right")) for g, n in counts.items()}
        mine = {g: k for g, k in mine.items() if k < size}
        want = (language.UNKNOWN, 0.0)
        if mine:
            far = {lang: sum(min(size, abs(k - p[g])) if g in p else size for g, k in mine.items()) / (size * len(mine)) for lang, p in model.items()}
            lang = min(sorted(far), key=far.get)
            want = (lang, 1 - far[lang])
        assert got[r["doc_id"]][:2] == (held[r["doc_id"]], want[0]) and abs(got[r["doc_id"]][2] - want[1]) < 1e-12


def test_a_profile_is_bounded_where_all_counts_tie(spark):
    text = " ".join(chr(0x4E00 + i) for i in range(3000))
    model = language.profiles(spark.createDataFrame([("zh", text)], "lang string, text string"))
    assert len(model["zh"]) == language.PROFILE


def test_long_texts_are_read_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abcé"), rng.integers(1, 9))) for _ in range(3000)) + "x" * 500
    whole = language._added(language.keys_of(text))
    monkeypatch.setattr(language, "CHUNK", 100)
    assert len(list(language.parts_of(text))) > 50 and "".join(language.parts_of(text)) == text
    assert all(np.array_equal(a, b) for a, b in zip(language.counts_of(text), whole))


def test_no_model_no_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "text", "a"), (1, "text", "a")], "doc_id long, text string, score string")
    got = language.identify(docs, {})
    assert got.columns == ["doc_id", "text", "score", "lang_pred", "_score"] and [r["lang_pred"] for r in got.collect()] == ["und", "und"]
    assert language.profiles(docs.limit(0), "score") == {}
    assert language.identify(docs.limit(0), {}).count() == 0


def test_numbers_of_n_grams_differ():
    text = "Aé 日本!ab"
    want = set()
    for word in ("aé", "日本", "ab"):
        word = f"_{word}_"
        want |= {word[i : i + n] for n in (1, 2, 3) for i in range(len(word) - n + 1)} - {"_"}
    assert len(set(language.keys_of(text).tolist())) == len(want)
    assert len(language.keys_of(text)) == len(set(language.keys_of(text).tolist())) + 2  # a and _a, twice


def test_null_ids_are_held_out_and_judged(spark):
    docs = spark.createDataFrame([(None, "the of and"), (1, "the of and")], "doc_id long, text string")
    assert {r["doc_id"]: r["h"] for r in docs.select("doc_id", language.held_out().alias("h")).collect()}[None]
    found = language.identify(docs, {"en": {language.key_of("the"): 0}}).collect()
    assert [r["lang_pred"] for r in found] == ["en", "en"]
