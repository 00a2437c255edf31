import functools
import math
import random
import re

import pytest
from matchgrid.llm import licences
from pyspark.ml.feature import HashingTF


@pytest.fixture(scope="module")
def model(spark, sf):
    return licences.train(spark.read.parquet(f"{sf}/documents.parquet"))


def _words(text):
    return [m.lower() for m in re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text)]


def _paragraphs(text):
    return [p for p in re.split("\n[ \t\x0b\x0c\r]*\n", text or "") if p.strip(" \t\n\x0b\x0c\r")]


def _pairs(w):
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


_OF = {f: set().union(*(_pairs(_words(n)) for n in ns)) for f, ns in licences.NOTICES.items()}
_ALONE = {f: {p for p in _OF[f] if not any(p in _OF[g] for g in _OF if g != f)} for f in _OF}


def _probability(model, words, family):
    """The family's probability against unknown alone, by the model's coefficients and plain sums."""
    tf = HashingTF(numFeatures=licences.FEATURES)
    at = {tf.indexOf(x) for x in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]}
    weights, first = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    z = [first[k] + sum(weights[k][i] for i in at) for k in (licences.FAMILIES.index(family), len(licences.FAMILIES))]
    return 1 / (1 + math.exp(z[1] - z[0]))


def _brute(text, model, cutoffs, trust=None):
    """(paragraphs, those with a family, their families): all templates against all windows, plainly. ``trust``: what the classifier says of every window."""
    parts, hit, families = _paragraphs(text), 0, set()
    for part in parts:
        w, names = _words(part), set()
        for at in range(0, max(1, len(w) - 34), 30):
            window = w[at : at + 64]
            here = _pairs(window)
            for f, ns in licences.NOTICES.items():
                bars = set()
                for n in ns:
                    whole = _pairs(_words(n))
                    own = whole & _ALONE[f]
                    for bar in (licences.LOW, licences.HIGH):
                        if len(here & own) >= math.ceil(bar * len(own)) and len(here & whole) >= math.ceil(bar * len(whole)):
                            bars.add(bar)
                if licences.HIGH in bars:
                    names.add(f)
                elif bars:
                    places = [i for i, p in enumerate(zip(window, window[1:])) if " ".join(p) in _ALONE[f]]
                    passage = window[max(0, places[0] - licences.MARGIN) : places[-1] + 2 + licences.MARGIN]
                    sure = _probability(model, passage, f) > cutoffs[licences.FAMILIES.index(f)] if trust is None else trust
                    names |= {f} if sure else set()
        hit += bool(names)
        families |= names
    return len(parts), hit, ",".join(sorted(families))


def test_scan_matches_brute_force(spark, model):
    """The whole table, and notices cut and reworded: templates and regression by plain sums."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(4)
    cut = []
    for ns in licences.NOTICES.values():
        for n in ns:
            w = n.split()
            cut += [" ".join(w[: max(2, len(w) * k // 4)]) for k in (2, 3)] + [" ".join(x for x in w if rng.random() > 0.25)]
    more = spark.createDataFrame([(10**9 + i, f"the people by the river {t} were there") for i, t in enumerate(cut)] + [(2 * 10**9 + i, t) for i, t in enumerate(licences.NEAR_MISSES)], docs.schema)
    both = docs.union(more)
    got = {r["doc_id"]: (r["n_paragraphs"], r["n_licensed"], r["families"]) for r in licences.scan(both, *model, keep=["doc_id"]).collect()}
    want = {r["doc_id"]: _brute(r["text"], *model) for r in both.collect()}
    assert got == want and any(f for _, _, f in want.values())


def test_the_classifier_decides_both_ways(spark, model):
    """Cut and reworded notices that templates alone would pass over or take, and texts that only share their words."""
    prose = "the people of the town were there that day"
    found = {
        f"{prose}. Redistribution and use of this in source or binary forms, with or without changes, are permitted provided that conditions are met. {prose}": "bsd",
        f"{prose}. You can redistribute it under the terms of the GNU Lesser General Public License published by the foundation. {prose}": "lgpl",
        f"{prose}. Licensed under the Apache License 2.0; you may not use this file except in compliance. {prose}": "apache",
    }
    rejected = [f"{prose}. {t} {prose}" for t in licences.NEAR_MISSES[1::2]]
    texts = [*found, *rejected]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["text"]: r["families"] for r in licences.scan(docs, *model).collect()}
    assert {t: got[t] for t in found} == found and {got[t] for t in rejected} == {""}
    never, always = ([_brute(t, *model, trust=x)[2] for t in texts] for x in (False, True))
    assert all(a == "" for a in never[: len(found)]) and any(a for a in always[len(found) :])


def test_families_that_share_words_are_told_apart(spark, model):
    boost = "Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the \"Software\") to use, reproduce, display, distribute,\nexecute, and transmit the Software"
    zlib = "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:"
    unlicense = "Anyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans."
    texts = {boost: "boost", zlib: "zlib", unlicense: "public", "MIT License\n\nCopyright (c) 2020 A. Person": "mit", "MIT License Copyright (c) 2020": "mit", "The MIT License (MIT)": "mit"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["text"]: r["families"] for r in licences.scan(docs, *model).collect()}
    assert {t: f for t, f in got.items() if "\n\nCopyright" not in t} == {t: f for t, f in texts.items() if "\n\nCopyright" not in t}


def test_notices_are_found_and_prose_is_not(spark, model):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = {"Apache License": "apache", "CC BY-NC": "cc", "GNU General Public License": "gpl", "MIT License": "mit"}
    got = {r["doc_id"]: r["families"] for r in licences.scan(docs, *model, keep=["doc_id"]).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == ",".join(sorted(f for k, f in want.items() if k in r["text"]))


def test_held_out_variants(spark, model):
    lines = {
        "Files are licensed under the Apache License, Version 2.0, see NOTICE.": "apache",
        "RELEASED UNDER THE MIT LICENSE": "mit",
        "The licence of the bar was released under pressure.": "",
        "Apache helicopters, version 2.0": "",
        "general public, version 3 of this work": "",
    }
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r["text"]: r["families"] for r in licences.scan(docs, *model).collect()} == lines


def test_every_notice_is_its_own_family(spark, model):
    rows = [(f, n) for f, ns in licences.NOTICES.items() for n in ns]
    prose = "the river was low that year and the boats lay along the bank while people waited for rain"
    rows += [(f, f"{prose} {n} {prose}") for f, n in rows]
    got = licences.scan(spark.createDataFrame(rows, "want string, text string"), *model).collect()
    assert [(r["want"], r["text"]) for r in got if r["families"] != r["want"]] == []


def test_wrapped_notices_tags_and_several_families(spark, model):
    prose = "the river was low that year and the boats lay along the bank while people waited for rain to come " * 4
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    gpl = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version."
    texts = {
        bsd: (1, 1, "bsd"),
        gpl: (1, 1, "gpl"),
        gpl.replace("General", "Lesser General").replace("program", "library"): (1, 1, "lgpl"),
        gpl.replace("General", "Affero General"): (1, 1, "agpl"),
        f"{prose}\n{bsd}\n{prose}": (1, 1, "bsd"),
        f"{prose}\n\n{gpl}\n\n{prose}": (3, 1, "gpl"),
        "Released under the MIT License. Parts are licensed under the Apache License, Version 2.0.": (1, 1, "apache,mit"),
        f"{gpl}\n \t\n{prose}\n\n\n{bsd}": (3, 2, "bsd,gpl"),
        "# SPDX-License-Identifier: MIT": (1, 1, "mit"),
        "Licensed under the GNU General Public License, version 2.0": (1, 1, "gpl"),
        f"{prose}\n{prose}": (1, 0, ""),
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["text"]: (r["n_paragraphs"], r["n_licensed"], r["families"]) for r in licences.scan(docs, *model).collect()}
    assert got == texts


def test_nulls_repeats_and_clashing_names(spark, model):
    n = "Released under the MIT License."
    rows = [(1, None, "x"), (2, "", "x"), (3, f"{n}\n \n{n}", "x"), (3, f"{n}\n \n{n}", "x"), (3, "plain", "x"), (None, n, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, families string")
    got = licences.scan(docs, *model)
    assert got.columns == ["doc_id", "text", "families", "n_paragraphs", "n_licensed", "_families"]
    want = [(0, 1, 1, "mit"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 0, ""), (3, 2, 2, "mit"), (3, 2, 2, "mit")]
    assert sorted((r["doc_id"] or 0, r["n_paragraphs"], r["n_licensed"], r["_families"]) for r in got.collect()) == want
    assert licences.scan(docs.limit(0), *model).count() == 0


def test_an_empty_table_trains_on_the_notices_alone(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licences.scan(docs, *licences.train(docs)).count() == 0


def test_a_very_long_text(spark, model):
    text = "word of the day " * 150_000 + "Released under the MIT License. " + "word of the day " * 1000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r["n_paragraphs"], r["n_licensed"], r["families"]) for r in licences.scan(docs, *model, keep=["doc_id"]).collect()] == [(1, 1, "mit")]


def test_bigrams(spark):
    df = spark.createDataFrame([("GNU GPL-3.0, v3",)], "line string")
    words = licences.words_of(df.line)
    assert df.select(words, licences.bigrams(words)).first()[:] == (["gnu", "gpl-3.0", "v3"], ["gnu gpl-3.0", "gpl-3.0 v3"])
    assert re.fullmatch("[a-z]+", "".join(licences.FAMILIES))


def _held_out(docs, half):
    """All windows with words of a half of the documents that templates do not confirm, plainly."""
    from pyspark.sql import functions as F

    mine = docs.where(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)) == half).select("text").collect()
    words = [_words(p) for r in mine for p in _paragraphs(r["text"])]
    windows = [w[at : at + 64] for w in words if w for at in range(0, max(1, len(w) - 34), 30)]
    return [w for w in windows if not _brute(" ".join(w), None, None, trust=True)[1]]


def test_every_window_of_every_document_counts(spark):
    """The unknown windows' exact counts of features, and cutoffs that thousands of documents' held-out windows exceed by their share."""
    rng = random.Random(3)
    telling = [w for n in licences.NOTICES["gpl"] for w in _words(n)] + "river boat bank people rain year town day".split() * 3
    rows = [(i, " ".join(rng.sample(telling, 12))) for i in range(4200)] + [(5000, None), (5001, " \n\n ... \n\n" + "long " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at = functools.cache(HashingTF(numFeatures=licences.FEATURES).indexOf)
    features = lambda w: {at(x) for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]}
    made, lines, n = licences._unknown(docs, "text", 0, licences._counter, "test")
    windows = _held_out(docs, 0)
    known = {tuple(r["line"].split(" ")): r["n"] for r in lines.collect()}
    want = {}
    for w in windows:
        for f in features(w) if tuple(w) not in known else ():
            want[f] = want.get(f, 0) + 1
    got = {}
    for r in made.where("i >= 0").collect():
        got[r["i"] % licences.FEATURES] = got.get(r["i"] % licences.FEATURES, 0) + r["n"]
    assert got == want and n == len(windows) > 2000

    model, cutoffs = licences.train(docs)
    windows = _held_out(docs, 1)
    spare = len(windows) - min(len(windows), math.ceil((len(windows) + 1) * (1 - licences.MISS)))
    weights, first, above = model.coefficientMatrix.toArray(), model.interceptVector.toArray(), 0
    z = [first + weights[:, sorted(features(w))].sum(axis=1) for w in windows]
    for i in range(len(licences.FAMILIES)):
        p = sorted((1 / (1 + math.exp(x[-1] - x[i])) for x in z), reverse=True)[spare]
        assert cutoffs[i] == pytest.approx(p, abs=1e-9) if p > cutoffs[i] - 1e-9 else cutoffs[i] >= licences.FLOOR
        above += p > cutoffs[i] - 1e-9
    assert above and spare


def test_windows_that_a_model_doubts_are_kept_as_their_features(spark):
    """Each once, of windows with and without repeated words, as vectors and not as text; the other windows as exact counts by their smallest feature."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("river boat bank people rain year town day zoë 日本 a-b 3.0 license public".split(), k=rng.choice([1, 2, 9, 64, 130])))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at = functools.cache(HashingTF(numFeatures=licences.FEATURES).indexOf)
    windows = [sorted({at(x) for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]}) for w in _held_out(docs, 0)]
    draws = licences.np.random.default_rng(1)
    weights, intercepts = draws.normal(size=(licences.FEATURES, 2)), draws.normal(size=2) - 5
    hard = [w for w in windows if (weights[w].sum(axis=0) + intercepts > 0).any()]
    want = {}
    for w in (w for w in windows if w not in hard):
        group = min(w[0], licences.GROUPS - 1)
        for i in (-1 - group, *(group * licences.FEATURES + f for f in w)):
            want[i] = want.get(i, 0) + 1
    _, lines, n = licences._unknown(docs, "text", 0, licences._counter, "test")
    made, same, again = licences._unknown(docs, "text", 0, lambda signs: licences._counter(signs, weights, intercepts), "test", lines)
    assert same is lines and lines.count() == 0 and again == n == len(windows) and 0 < len(hard) < n
    assert sorted(list(r["x"]["indices"]) for r in made.where("x is not null").collect()) == sorted(hard)
    got = {}
    for r in made.where("i is not null and n > 0").collect():
        got[r["i"]] = got.get(r["i"], 0) + r["n"]
    assert got == want and made.where("line is not null").count() == 0
