"""Licence scans by a trained paragraph classifier.

Paragraphs are runs of non-blank lines, so a notice may be wrapped; they are read in
overlapping windows of words, each longer than any notice by the overlap. Hashed word uni-
and bigrams feed a sparse multinomial logistic regression whose classes are licence
families and "unknown". It is trained on the notices below, cut and joined in the ways
texts quote them, and on all windows of half of the corpus's documents as unknown: those
that hold a sign of a notice one by one, all others as the means of groups of like windows.

Where the classifier is sure, that is, where its probability of a family against unknown
alone exceeds a conformal quantile of what all unknown windows of the other half, and near
misses held out from training, reach, a part of a template confirms the family (``LOW``): so cut and reworded notices
are found. Where it is not, only nearly the whole of one does (``HIGH``). The two tests
commute: the templates are compared first, as they cost less and leave few windows to the
classifier; one window can name several families.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from matchgrid.functions import numbers
from matchgrid.llm.common import forget, free_name, table, write_table
from matchgrid.llm.quality import SPACE, let
from matchgrid.sources.stored import drop_stored

#: Notices of each family.
NOTICES = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "boost": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.",
        "Distributed under the Boost Software License, Version 1.0.",
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "MIT License Copyright (c)",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "ofl": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1"),
    "public": (
        "This work is dedicated to the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose.",
        "SPDX-License-Identifier: CC0-1.0",
        "SPDX-License-Identifier: Unlicense",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
        "Licensed under the zlib License.",
        "SPDX-License-Identifier: Zlib",
    ),
}
#: Text that shares words with notices and is none: half of it is trained on as unknown, half calibrates.
NEAR_MISSES = (
    "",
    "the work is under the version of this",
    "public version general free source software use terms",
    "permission is hereby granted to the committee to use the hall free of charge on any day",
    "any person or organization obtaining a copy of the catalogue may order by telephone",
    "redistribution of wealth in source and in binary forms of government is not permitted by the council",
    "the above notice shall be included in all copies of the morning paper",
    "in no event will the authors of the report be held liable for the weather",
    "the apache helicopters version 2.0 were licensed to the army under a contract",
    "the general public may not use this road and no license is needed to walk on it",
    "anyone is free to copy the recipe and to sell the cake for any purpose",
    "the names of its contributors may be used in the program of the evening",
    "the software is provided by the vendor under the terms of a commercial license agreement",
    "released under pressure from the public the mit report was free software news",
    "this program is free for children and you can modify it under the terms of the school",
    "neither the name of the holder nor the copyright of the song was known to the public library",
)
FAMILIES = sorted(NOTICES)
#: Hashed features, a power of two; training rows' weight that all unknown windows share.
FEATURES = 1 << 12
UNKNOWN_WEIGHT = 2000.0
#: Groups of windows without a sign, by the smallest feature they hold.
GROUPS = 64
#: Notices inside other text: the share of a mean window's features that stands with one, and the weight of such a row.
INSIDE = ((0.25, 4.0), (0.5, 2.0))
#: Windows whose features a task holds at once.
BLOCK = 1024
#: Training rows of a task, about.
TASK_ROWS = 20_000
#: The share of a notice's bigrams that a window must hold where the classifier is sure, and where it is not.
LOW, HIGH = 0.4, 0.8
#: The share of held-out unknown windows that may exceed a family's cutoff, and the least cutoff.
MISS = 0.001
FLOOR = 0.5
#: Words of a window, and from one window's start to the next: a notice of up to WINDOW - STRIDE words lies whole in one.
WINDOW = 64
STRIDE = 30
#: Words on both sides that are judged with a notice.
MARGIN = 4


def _pairs_of(notice: str) -> set[str]:
    """``bigrams`` of ``words_of``, for the notices, which are ASCII."""
    words = re.findall("[a-z0-9]+(?:[.-][a-z0-9]+)*", notice.lower())
    assert len(words) <= WINDOW - STRIDE, notice
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


_OF_FAMILY = {f: set().union(*map(_pairs_of, NOTICES[f])) for f in FAMILIES}
_HOLDERS = Counter(p for pairs in _OF_FAMILY.values() for p in pairs)


def _own(pairs: set[str]) -> list[str]:
    """Those that no other family's notices have."""
    return sorted(p for p in pairs if _HOLDERS[p] == 1)


def _template(i: int, notice: str) -> dict:
    whole, own = _pairs_of(notice), _own(_pairs_of(notice))
    bars = {f"{bar}_{kind}": math.ceil(share * len(pairs)) for bar, share in (("low", LOW), ("high", HIGH)) for kind, pairs in (("whole", whole), ("own", own))}
    return {"i": i, "whole": sorted(whole), "own": own, **bars}


#: Of each notice: its family's place, its bigrams, its family's own among them, and how many of each a window must hold for either bar.
TEMPLATES = [_template(i, n) for i, f in enumerate(FAMILIES) for n in NOTICES[f]]
assert all(t["own"] for t in TEMPLATES)
#: A window that holds LOW of a notice's own bigrams misses too few to miss all of these.
_SIGNS = sorted({p for t in TEMPLATES for p in sorted(t["own"], key=lambda p: (-len(p), p))[: len(t["own"]) - t["low_own"] + 1]})


def _constant(value, schema: str) -> Column:
    """A literal of any type; one node of the plan, whatever its size."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def words_of(line: Column) -> Column:
    """Lower-cased runs of letters, digits, dots inside and hyphens."""
    return F.regexp_extract_all(F.lower(line), F.lit("[\\p{L}\\p{N}]+(?:[.-][\\p{L}\\p{N}]+)*"), F.lit(0))


def bigrams(words: Column) -> Column:
    """Neighbouring words; the array is computed once, not once an element."""

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda x, y: F.concat(x, F.lit(" "), y))

    return let(words, pairs)


def _featured(lines: DataFrame) -> DataFrame:
    """``lines`` with the feature vector x."""
    words = F.split("line", " ")
    out = lines.withColumn("grams", let(words, lambda w: F.concat(w, bigrams(w))))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="x").transform(out).drop("grams")


def paragraphs(text: Column) -> Column:
    """Runs of lines without a blank one between them."""
    return F.filter(F.split(text, "\\n[\\x20\\t\\x0B\\x0C\\r]*+\\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def _windows(words: Column) -> Column:
    """The windows of a word array."""
    last = lambda w: F.greatest(F.size(w) - (WINDOW - STRIDE) - 1, F.lit(0))
    return let(words, lambda w: F.transform(F.sequence(F.lit(0), last(w), F.lit(STRIDE)), lambda i: F.slice(w, i + 1, WINDOW)))


def _has_sign(words: Column) -> Column:
    return F.arrays_overlap(bigrams(words), _constant(_SIGNS, "array<string>"))


def _confirmed(pairs: Column) -> Column:
    """(i, strong) of the families of which ``pairs`` hold LOW of a notice's bigrams, and LOW of those that are the family's own; strong: HIGH of both."""
    templates = _constant(TEMPLATES, "array<struct<i:int,whole:array<string>,own:array<string>,low_whole:int,low_own:int,high_whole:int,high_own:int>>")

    def judged(t: Column) -> Column:
        own = F.size(F.array_intersect(pairs, t["own"]))

        def by(n: Column) -> Column:
            # most templates share nothing with a window
            return F.when(n >= t["low_own"], let(F.size(F.array_intersect(pairs, t["whole"])), lambda m: F.when(m >= t["low_whole"], (n >= t["high_own"]) & (m >= t["high_whole"]))))

        return F.struct(t["i"].alias("i"), let(own, by).alias("strong"))

    held = F.filter(F.transform(templates, judged), lambda x: x["strong"].isNotNull())
    # a family once, strong if one of its notices is
    return F.filter(held, lambda x: ~F.exists(held, lambda y: (y["i"] == x["i"]) & y["strong"] & ~x["strong"]))


def _suspects(parts: Column) -> Column:
    """Array of (part, w, named) of the windows that templates confirm, of an array of paragraphs."""

    def of(part: Column) -> Column:
        seen = F.filter(_windows(part["w"]), _has_sign)
        named = F.transform(seen, lambda w: F.struct(part["part"].alias("part"), w.alias("w"), F.array_distinct(let(bigrams(w), _confirmed)).alias("named")))
        return F.filter(named, lambda x: F.size(x["named"]) > 0)

    each = F.transform(F.transform(parts, words_of), lambda w, i: F.struct(i.alias("part"), w.alias("w")))
    # nearly all paragraphs hold no sign of a notice; a window that is confirmed holds one
    return F.flatten(F.transform(F.filter(each, lambda p: _has_sign(p["w"])), of))


def _passage(words: Column, family: Column) -> Column:
    """The words from the first to the last bigram that is the family's own, with MARGIN words around."""
    own = F.get(_constant([_own(_OF_FAMILY[f]) for f in FAMILIES], "array<array<string>>"), family)
    at = F.array_compact(F.transform(bigrams(words), lambda x, i: F.when(F.array_contains(own, x), i)))

    def cut(at: Column) -> Column:
        start = F.greatest(F.array_min(at) - MARGIN, F.lit(0))
        return F.array_join(F.slice(words, start + 1, F.array_max(at) + 2 + MARGIN - start), " ")

    return let(at, cut)


def _notices(spark: SparkSession) -> DataFrame:
    rows = [(float(i), n) for i, f in enumerate(FAMILIES) for n in NOTICES[f]]
    one = spark.range(1, numPartitions=1).select(F.explode(_constant([{"y": y, "line": n} for y, n in rows], "array<struct<y:double,line:string>>")).alias("r"))
    return one.select("r.y", F.array_join(words_of(F.col("r.line")), " ").alias("line"))


def _murmur(strings: pa.Array) -> np.ndarray:
    """The hash of each string that ``HashingTF`` takes (32-bit MurmurHash3, seed 42)."""
    strings = strings.cast(pa.large_binary())
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int64, len(strings) + 1, 8 * strings.offset) if len(strings) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    at, size = ends[:-1] - ends[0], np.diff(ends)
    # the four bytes from each place on, and zeros after the end
    four = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint32)
    four = four[:-3] | four[1:-2] << np.uint32(8) | four[2:-1] << np.uint32(16) | four[3:] << np.uint32(24)

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    def mixed(k: np.ndarray) -> np.ndarray:
        return turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    h = np.full(len(size), 42, np.uint32)
    left, n = np.arange(len(size)), 0
    while len(left := left[size[left] >= 4 * n + 4]):
        h[left] = turned(h[left] ^ mixed(four[at[left] + 4 * n]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        n += 1
    h ^= mixed(four[at + size // 4 * 4] & np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], np.uint32)[size % 4])
    h ^= size.astype(np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def _joined(words: pa.Array, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The lines of the windows of so many words from each place on."""
    ends = np.concatenate(([0], np.cumsum(size)))
    places = np.arange(ends[-1]) + np.repeat(at - ends[:-1], size)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(places))), " ")


def _blocks(paragraphs: pa.Array, signs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """(how many windows have no sign; their features, each once a window, as rows and features; the other windows' lines) of word arrays, ``BLOCK`` windows at a time.

    A window with a sign is told by its bigrams' hashes: some may have none. Windows of no words are left out.
    """
    length = np.asarray(paragraphs.value_lengths(), np.int64)
    words, first = paragraphs.flatten(), np.cumsum(length) - length
    many = np.where(length > 0, np.maximum(length - (WINDOW - STRIDE) - 1, 0) // STRIDE + 1, 0)
    of = np.repeat(np.arange(len(length)), many)
    past = STRIDE * (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))
    starts, sizes = first[of] + past, np.minimum(length[of] - past, WINDOW)
    last, maybe = np.zeros(BLOCK * FEATURES, np.int32), np.zeros(1 << 16, bool)
    maybe[signs & 0xFFFF] = True
    for i in range(0, len(of), BLOCK):
        low, size = starts[i], sizes[i : i + BLOCK]
        at = starts[i : i + BLOCK] - low
        part = words.slice(low, int((at + size).max()))
        one, two = _murmur(part), _murmur(pc.binary_join_element_wise(part[:-1], part[1:], " "))
        is_sign = maybe[two & 0xFFFF]
        is_sign[is_sign] = np.isin(two[is_sign], signs)
        before = np.concatenate(([0], np.cumsum(is_sign)))
        signed = before[at + size - 1] > before[at]
        lines = _joined(part, at[signed], size[signed])
        at, size = at[~signed], size[~signed]
        codes = []
        for hashed, less in ((one, 0), (two, 1)):
            rows, k = np.nonzero(np.arange(WINDOW) < (size - less)[:, None])
            codes.append(rows * FEATURES + hashed[at[rows] + k] % FEATURES)
        code = np.concatenate(codes)
        # of equal ones the last is taken; nothing is read that was not written just now
        last[code] = np.arange(len(code), dtype=np.int32)
        code = code[last[code] == np.arange(len(code))]
        yield len(at), code // FEATURES, code % FEATURES, lines


def _scores(n: int, row: np.ndarray, feature: np.ndarray, weights: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
    """Of ``n`` windows with these features each family's score against unknown."""
    return np.stack([np.bincount(row, w[feature], n) for w in weights.T], axis=1) + intercepts


_Batches = Iterator[pa.RecordBatch]
#: A sparse vector as Parquet stores it.
_SPARSE_ARROW = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


def _vectors(row: np.ndarray, feature: np.ndarray) -> pa.Array:
    """The sparse vectors of windows with these features."""
    order = np.lexsort((feature, row))
    ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row)))), pa.int32())
    indices = pa.ListArray.from_arrays(ends, pa.array(feature[order], pa.int32()))
    values = pa.ListArray.from_arrays(ends, pa.array(np.ones(len(row))))
    n = len(indices)
    return pa.StructArray.from_arrays([pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, FEATURES), pa.int32()), indices, values], fields=list(_SPARSE_ARROW))



def _batch(**columns) -> pa.RecordBatch:
    types = {"line": pa.string(), "i": pa.int32(), "n": pa.int64(), "p": pa.float64(), "x": _SPARSE_ARROW}
    size = max(map(len, columns.values()))
    arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(types))


def _counter(signs: np.ndarray, weights: np.ndarray | None = None, intercepts: np.ndarray | None = None) -> Callable[[_Batches], _Batches]:
    """(line): the windows with a sign, or where a model is given (x): the features of those without one that it rather takes for some family than for unknown.

    (i, n): of the others how many in group ``i // FEATURES`` hold feature ``i % FEATURES``, or how many are in group ``-1 - i``.
    """

    def run(batches: _Batches) -> _Batches:
        held, n = np.zeros(GROUPS * FEATURES, np.int64), np.zeros(GROUPS, np.int64)
        for batch in batches:
            for size, row, feature, lines in _blocks(batch.column(0).flatten(), signs):
                easy = np.ones(size, bool)
                if weights is not None:
                    easy = ~(_scores(size, row, feature, weights, intercepts) > 0).any(axis=1)
                    if not easy.all():
                        mine = ~easy[row]
                        yield _batch(x=_vectors((np.cumsum(~easy) - 1)[row[mine]], feature[mine]))
                        row, feature = row[easy[row]], feature[easy[row]]
                # the smallest feature: the last that is written
                group, small = np.full(size, GROUPS - 1), np.flatnonzero(feature < GROUPS - 1)
                small = small[np.argsort(-feature[small], kind="stable")]
                group[row[small]] = feature[small]
                held += np.bincount(group[row] * FEATURES + feature, minlength=len(held))
                n += np.bincount(group[easy], minlength=GROUPS)
                if weights is None and len(lines):
                    yield _batch(line=lines)
        some = np.flatnonzero(held)
        yield _batch(i=np.concatenate((-1 - np.arange(GROUPS), some)), n=np.concatenate((n, held[some])))

    return run


def _judge(signs: np.ndarray, weights: np.ndarray, intercepts: np.ndarray, bars: list[float]) -> Callable[[_Batches], _Batches]:
    """(i, p): the probabilities of family ``i`` against unknown that exceed its bar, of windows without a sign; (-1, n): how many those are; (line): the windows with one."""

    def run(batches: _Batches) -> _Batches:
        n = 0
        for batch in batches:
            for size, row, feature, lines in _blocks(batch.column(0).flatten(), signs):
                p = 1 / (1 + np.exp(-_scores(size, row, feature, weights, intercepts)))
                n += size
                row, i = np.nonzero(p > bars)
                if len(i):
                    yield _batch(i=i, p=p[row, i])
                if len(lines):
                    yield _batch(line=lines)
        yield _batch(i=[-1], n=[n])

    return run


def _unknown(docs: DataFrame, text_col: str, half: int, work: Callable[[np.ndarray], Callable[[_Batches], _Batches]], tag: str, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """What ``work`` makes of all windows of a half of the documents; its ``lines``, if not given, without those that templates confirm, and how often each occurs; how many windows both are."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.where(F.pmod(F.xxhash64(text), F.lit(2)) == half).select(F.transform(paragraphs(text), words_of).alias("words"))
    made = write_table(words.mapInArrow(work(_murmur(pa.array(_SIGNS))), f"line string, i int, n long, p double, x {VectorUDT().sqlType().simpleString()}"), tag)
    if lines is None:
        lines = made.where("line is not null").groupBy("line").agg(F.count("*").alias("n"))
        # without a sign none is confirmed
        lines = write_table(lines.where(F.size(let(bigrams(F.split("line", " ")), _confirmed)) == 0), f"{tag}-lines")
    n = made.agg(F.coalesce(F.sum(F.when(F.col("i") < 0, F.col("n"))), F.lit(0)) + F.count("x")).first()[0]
    return made, lines, n + lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _rows(spark: SparkSession, rows: list[tuple[float, float, np.ndarray]]) -> DataFrame:
    """(y, weight, x) of a few rows of the driver."""
    sparse = [(float(y), float(w), Vectors.sparse(FEATURES, np.flatnonzero(x), x[np.flatnonzero(x)])) for y, w, x in rows]
    schema = StructType([StructField("y", DoubleType()), StructField("weight", DoubleType()), StructField("x", VectorUDT())])
    return spark.createDataFrame(sparse, schema).coalesce(1)


def train(docs: DataFrame, text_col: str = "text") -> tuple[LogisticRegressionModel, list[float]]:
    """The model, and for each family the probability that its predictions must exceed.

    Fitted on the notices (whole, without their first or last words, and among other text)
    and on all windows of the documents of one half, dealt by a hash of the text; equal
    texts are in one half. Windows that hold a notice's bigrams are not used as unknown.
    The others weigh ``UNKNOWN_WEIGHT`` together, each alike. Those with a sign of a notice
    are rows of their own. Of those without one, which ``scan`` never asks about, the ones
    whose smallest feature is the same (a min-hash, so like windows meet) are one row, the
    exact mean of all of them: ``GROUPS`` rows, whatever the size. A second fit takes the
    windows that the first one has wrong out of the means, as rows of their own.

    A cutoff is the conformal quantile that at most ``MISS`` of all unknown windows of the
    other half exceed, at least ``FLOOR``, and what held-out near misses reach. An empty
    table gives a model of the notices alone.
    """
    spark = docs.sparkSession
    made, lines, n = _unknown(docs, text_col, 0, _counter, "unknown")
    first = _fitted(spark, made, lines, n)[0]
    # what this model doubts is trained on one by one
    model, mean = _fitted(spark, *_unknown(docs, text_col, 0, lambda signs: _counter(signs, *_against(first)), "doubted", lines))
    forget(lines)
    judged = lambda x: model.transform(x).withColumn("p", vector_to_array(F.col("probability")))
    # no near miss may pass, alone or with what a passage keeps around it
    misses = [(0, 1, _among(r["x"], share * mean)) for r in _featured(_missed(spark, 1)).select("x").collect() for share in (0, 2 * MARGIN / WINDOW)]
    near = judged(_rows(spark, misses)).agg(*(F.max(_against_unknown(F.lit(i))) for i in range(len(FAMILIES)))).first()
    return model, _cutoffs(docs, text_col, model, judged, [max(FLOOR, m) for m in near])


def _missed(spark: SparkSession, half: int) -> DataFrame:
    return spark.range(1, numPartitions=1).select(F.explode(_constant(list(NEAR_MISSES[half::2]), "array<string>")).alias("line"))


def _among(x: SparseVector, other: np.ndarray) -> np.ndarray:
    """Features that stand among others, which may be shares."""
    return np.maximum(x.toArray(), other)


def _against(model: LogisticRegressionModel) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of the families against unknown."""
    weights, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    return (weights[:-1] - weights[-1]).T.copy(), intercepts[:-1] - intercepts[-1]


def _fitted(spark: SparkSession, made: DataFrame, lines: DataFrame, n: int) -> tuple[LogisticRegressionModel, np.ndarray]:
    """The model of the notices, ``n`` unknown windows and a half of the near misses; the mean of the windows in groups."""
    group = F.when(F.col("i") < 0, -1 - F.col("i")).otherwise(F.floor(F.col("i") / FEATURES)).alias("g")
    feature = F.when(F.col("i") < 0, -1).otherwise(F.col("i") % FEATURES).alias("f")
    sums = made.where("i is not null").groupBy(group, feature).agg(F.sum("n").alias("n")).where("n > 0")
    held, size = np.zeros((GROUPS, FEATURES)), np.zeros(GROUPS)
    # GROUPS times FEATURES counts at most
    for r in sums.groupBy("g").agg(F.collect_list(F.struct("f", "n")).alias("held")).collect():
        for f, k in r["held"]:
            if f < 0:
                size[r["g"]] = k
            else:
                held[r["g"], f] = k
    notices = _notices(spark)
    w = F.split("line", " ")
    cuts = [F.array_join(F.slice(w, F.lit(1 + a), F.greatest(F.size(w) - a - b, F.lit(3))), " ") for a in range(3) for b in range(3)]
    y, full = F.lit(float(len(FAMILIES))).alias("y"), F.lit(1.0).alias("weight")
    good = notices.select("y", F.explode(F.array_distinct(F.array(*cuts))).alias("line"), full)
    unknown = lines.select(y, "line", (F.col("n") * (UNKNOWN_WEIGHT / max(n, 1))).alias("weight"))
    plain = good.union(_missed(spark, 0).select(y, "line", full)).coalesce(1)
    rows = write_table(plain.union(unknown), "training")
    few = [(len(FAMILIES), UNKNOWN_WEIGHT * size[g] / n, held[g] / size[g]) for g in np.flatnonzero(size)]
    mean = held.sum(axis=0) / max(size.sum(), 1)
    # a notice stands among other text
    few += [(r["y"], weight, _among(r["x"], share * mean)) for r in _featured(notices).select("y", "x").collect() for share, weight in INSIDE]
    # windows without a sign that an earlier model had wrong, as vectors
    schema = StructType([f if f.name != "x" else StructField("x", VectorUDT()) for f in made.schema])
    hard = spark.read.schema(schema).parquet(made.written_to).where("x is not null").select(y, F.lit(UNKNOWN_WEIGHT / max(n, 1)).alias("weight"), "x")
    featured = _featured(rows).select("y", "weight", "x").union(_rows(spark, few)).union(hard)
    # each task sends a gradient of all weights an iteration
    featured = featured.coalesce(math.ceil((lines.count() + hard.count() + 1) / TASK_ROWS))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=30, aggregationDepth=2).fit(featured)
    forget(made, rows)
    return model, mean


def _cutoffs(docs: DataFrame, text_col: str, model: LogisticRegressionModel, judged: Callable[[DataFrame], DataFrame], bars: list[float]) -> list[float]:
    """For each family its bar, or what at most ``MISS`` of all unknown windows of the held-out half exceed if that is more."""
    made, lines, n = _unknown(docs, text_col, 1, lambda signs: _judge(signs, *_against(model), bars), "judged")
    each = judged(_featured(lines)).select(F.explode(F.sequence(F.lit(1), F.col("n"))), "p")
    each = each.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), _against_unknown(F.lit(i)).alias("value"), F.lit(bar).alias("bar")) for i, bar in enumerate(bars)))))
    over = made.where("p is not null").select("i", F.col("p").alias("value")).union(each.where("value > bar").select("i", "value"))
    over = write_table(over, "over")
    # so many of the n windows may exceed a cutoff; none of a few
    spare = n - min(n, math.ceil((n + 1) * (1 - MISS)))
    most = [r["i"] for r in over.groupBy("i").count().where(F.col("count") > spare).collect()]
    out = list(bars)
    if most:
        found = numbers.values_at(over.where(F.col("i").isin(most)), ["i"], {"cutoff": F.col("n") - 1 - spare})
        for r in found.collect():
            out[r["i"]] = r["value"]
        drop_stored(found)
    forget(made, lines, over)
    return out


def _against_unknown(i: Column) -> Column:
    """The probability of family ``i`` where it and unknown are the only classes."""
    return F.get("p", i) / (F.get("p", i) + F.get("p", F.lit(len(FAMILIES))))


def scan(docs: DataFrame, model: LogisticRegressionModel, cutoffs: list[float], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_paragraphs, n_licensed and families.

    families: the families of confirmed paragraphs, sorted and comma-joined, empty for
    none. n_licensed: paragraphs with a family. Null and empty texts have no paragraphs,
    nor do lines of white space count. Every row is judged by itself: repeated rows, and
    rows that share an id, stay and have equal results only where their texts are equal.
    Whole texts of any length are read. Added names take a leading underscore where
    ``docs`` has them; an empty table gives an empty table.
    """
    kept = [c for c in docs.columns if keep is None or c in keep]
    new = {c: free_name(docs.select(*kept), c) for c in ("n_paragraphs", "n_licensed", "families")}
    names = [f"k_{i}" for i in range(len(kept))]
    found = let(paragraphs(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), lambda p: F.struct(F.size(p).cast("long").alias("n"), _suspects(p).alias("s")))
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(kept, names, strict=True)), F.monotonically_increasing_id().alias("row"), found.alias("f"))
    rows = write_table(rows.select(*names, "row", "f.n", "f.s"), "licences")
    some, none = rows.where(F.size("s") > 0), rows.where(F.size("s") == 0)
    each = some.select("row", F.explode("s").alias("x")).select("row", "x.part", "x.w", F.inline("x.named"))
    each = each.select("row", "part", "i", "strong", _passage(F.col("w"), F.col("i")).alias("line"))
    judged = model.transform(_featured(each)).withColumn("p", vector_to_array(F.col("probability")))
    sure = judged.where(F.col("strong") | (_against_unknown(F.col("i")) > F.get(_constant(cutoffs, "array<double>"), F.col("i"))))
    family = F.get(_constant(FAMILIES, "array<string>"), F.col("i"))
    named = sure.groupBy("row").agg(F.count_distinct("part").alias("l"), F.array_join(F.sort_array(F.collect_set(family)), ",").alias("fs"))
    # rows without a suspect, nearly all, are not shuffled
    met = some.select(*names, "row", "n").join(named, "row", "left").select(*names, "n", F.coalesce("l", F.lit(0)).cast("long").alias("l"), F.coalesce("fs", F.lit("")).alias("fs"))
    out = met.union(none.select(*names, "n", F.lit(0).cast("long"), F.lit("")))
    return out.toDF(*kept, *new.values())


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, cutoffs = train(docs)
    return scan(docs, model, cutoffs, keep=["doc_id"])
