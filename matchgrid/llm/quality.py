"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule has a score per document and cutoffs from lenient to strict. Labelled good
documents of each stratum that pass the base rules are parted by a hash. The smaller part picks a path: step s sets
every rule to its cutoff s, but no rule goes past the last one that rejects at most
TUNED of that part. The larger part, the holdout, certifies steps in order: the hypothesis
"a good document is rejected, by any of the rules, with probability above RISK" goes if
the exact binomial tail is at most LEVEL / strata; the first step that fails ends the
sequence (fixed-sequence testing over steps, Bonferroni over strata). As the path does not
hang on the holdout, with confidence 1 - LEVEL no stratum at all loses more than RISK of
those good documents to the rules together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrid.llm.common import free_name, table, write_table

SPACE = " \t\n\x0b\x0c\r"
WINDOW = 5
RISK = 0.03
LEVEL = 0.05
#: Good documents that one rule alone may reject of the part that picks the path: its share of the risk.
TUNED = RISK / 6
#: Sixteenths of the good documents that pick the path, by the first digit of the id's md5.
TUNING = 4
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
_SHARES = (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)
#: rule -> (score of the feature columns, cutoffs from lenient to strict); above the cutoff is rejected.
RULES: dict[str, tuple[Callable[[], Column], tuple[float, ...]]] = {
    "symbols": (lambda: F.try_divide("n_symbols", "word_chars"), _SHARES),
    "capitals": (lambda: F.try_divide("n_capitals", "word_chars"), _SHARES),
    "marks": (lambda: F.try_divide("n_marks", "word_chars"), _SHARES),
    "lines": (lambda: F.try_divide("n_dup_lines", "n_lines"), _SHARES),
    "repeats": (lambda: F.try_divide("n_repeat_words", "n_words"), _SHARES),
    "long_words": (lambda: F.try_divide("word_chars", "n_words"), (30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
}
BASE_FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words that lie in ``WINDOW``-word windows found twice or more in the array."""
    shown = F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    hashes = F.transform(shown, lambda x, i: F.xxhash64(x, *(F.get(words, i + k) for k in range(1, WINDOW))))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(s, lambda e, j: (e["x"] == F.get(s, j - 1)["x"]) | (e["x"] == F.get(s, j + 1)["x"])))
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        steps = let(starts, lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_marks, n_lines.

    Whole texts; null counts as empty. Words are runs of anything but U+0020 and U+0009 to
    U+000D. The names must be free in ``keep``.
    """
    kept = [c for c in docs.columns if keep is None or c in keep]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+", -1))
    solid = text
    for c in SPACE:
        solid = F.replace(solid, F.lit(c), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    out = docs.select(
        *kept,
        let(words, lambda w: F.struct(F.size(w).alias("w"), repeat_words(w).alias("r"))).alias("__w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("__l"),
        F.char_length(solid).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit("[!?]")).cast("long").alias("n_marks"),
    )
    long = lambda c: F.col(c).cast("long")
    return out.select(
        *kept, long("__w.w").alias("n_words"), "word_chars", "n_symbols", long("__l.d").alias("n_dup_lines"), long("__w.r").alias("n_repeat_words"),
        "n_capitals", "n_marks", long("__l.n").alias("n_lines"),
    )


def binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """P(X <= k) for X binomial of ``n`` and ``risk``, exactly, in logarithms; 1 where k is above the mean (the tail is then above one half)."""
    start = F.struct((n * F.log1p(F.lit(-risk))).alias("term"), (n * F.log1p(F.lit(-risk))).alias("sum"))
    odds = F.log(F.lit(risk / (1 - risk)))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        high = F.greatest(term, acc["sum"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(F.least(term, acc["sum"]) - high))).alias("sum"))

    ks = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.when(k >= n * risk, F.lit(1.0)).otherwise(F.exp(F.aggregate(ks, start, step)["sum"]))


def first_levels() -> Column:
    """For each rule in order the first cutoff, from 1 on, that rejects the document; null if none does."""

    def first(r: str) -> Column:
        cuts = RULES[r][1]
        passed = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.coalesce(F.col(f"s_{r}") > c, F.lit(False))))
        return F.when(passed > 0, len(cuts) - passed + 1)

    return F.array(*map(first, RULES))


def thresholds(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, steps, cutoffs): the certified steps of each stratum, and a map of rule to its cutoff at the last of them; rules without one are absent.

    ``scored``: id, stratum and one score a rule; ``labels``: doc_id, quality. Good is a
    document with quality 1 and no other label. Each counts once. Counts are added up by
    stratum, rule and cutoff before they are shuffled; a stratum takes part where it has
    good documents.
    """
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    good = good.where("lo = 1 and hi = 1").select(F.col("doc_id").alias("g"))
    seen = scored.join(good, F.col(id_col) == F.col("g"), "left_semi").dropDuplicates([id_col])
    digit = F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 1), 16, 10).cast("int")
    seen = seen.select("stratum", (digit < TUNING).alias("tunes"), first_levels().alias("l"))
    # at most (cutoffs + 1) ^ rules rows a stratum, in truth far fewer; later steps read no documents
    seen = write_table(seen.groupBy("stratum", "tunes", "l").agg(F.count("*").alias("n")), "levels")

    tuning = seen.groupBy("stratum").agg(F.coalesce(F.sum(F.when(F.col("tunes"), F.col("n"))), F.lit(0)).alias("all"))
    rule = F.array(*(F.struct(F.lit(i).alias("r"), F.lit(len(cs)).alias("most")) for i, (_, cs) in enumerate(RULES.values())))
    hits = seen.where("tunes").select("stratum", "n", F.posexplode("l").alias("r", "at")).where("at is not null").groupBy("stratum", "r", "at").agg(F.sum("n").alias("n"))
    grid = tuning.select("stratum", "all", F.explode(rule).alias("g")).select("stratum", "all", "g.r", F.explode(F.sequence(F.lit(1), F.col("g.most"))).alias("at"))
    so_far = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("stratum", "r").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    path = grid.join(hits, ["stratum", "r", "at"], "left").withColumn("k", so_far)
    path = path.groupBy("stratum", "r").agg(F.coalesce(F.max(F.when(F.col("k") <= F.col("all") * (TUNED * risk / RISK), F.col("at"))), F.lit(0)).alias("last"))
    path = path.groupBy("stratum").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "last"))), lambda x: x["last"]).alias("last"))

    strata = F.greatest(F.lit(1), F.lit(tuning.count()))
    steps = max(len(cs) for _, cs in RULES.values())
    rejects = F.array_min(F.zip_with("l", "last", lambda at, last: F.when(at <= last, at)))
    held = seen.where("not tunes").join(path, "stratum").select("stratum", "n", F.coalesce(rejects, F.lit(steps + 1)).alias("at"))
    held = held.groupBy("stratum").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col("at") <= i, F.col("n")).otherwise(0)).alias(f"k_{i}") for i in range(1, steps + 1)))
    sure = F.array(*(binomial_tail(F.col(f"k_{i}"), F.col("n"), risk) <= F.lit(level) / strata for i in range(1, steps + 1)))
    fails = F.array_position(sure, F.lit(False))
    held = held.select("stratum", F.when(fails == 0, steps).otherwise(fails - 1).cast("int").alias("steps"))
    ruled = F.array(*(F.struct(F.lit(r).alias("rule"), F.get(F.array(*map(F.lit, cs)), F.least("steps", F.get("last", i)) - 1).alias("cut"), F.get("last", i).alias("last")) for i, (r, (_, cs)) in enumerate(RULES.items())))
    given = F.transform(F.filter(ruled, lambda x: x["last"] > 0), lambda x: F.struct(x["rule"], x["cut"]))
    return held.where("steps > 0").join(path, "stratum").select("stratum", "steps", F.map_from_entries(given).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the base features, base_failed, kept and failed_rules.

    base_failed: under ``MIN_WORDS`` words, or over ``MAX_REPEAT_PERCENT`` percent of them in
    repeated windows. kept: not base_failed and no score above its stratum's certified cutoff.
    failed_rules: those that the document fails, comma-joined.
    Strata are the values of ``stratum_col`` as text, null one of its own; a stratum with too
    few labels (under 144 good ones in the holdout, of 4 strata) has no cutoffs and loses
    nothing more. Null and empty texts have 0 words and fail; whole texts of any length are
    read. Added names take a leading underscore where ``docs`` has them. Rows stay, repeated ones too; an empty table gives an empty table.
    """
    kept = [c for c in docs.columns if keep is None or c in keep]
    plain = docs.select(*(F.col(c).alias(f"k_{i}") for i, c in enumerate(kept)), F.col(id_col).alias("k_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("\0")).alias("stratum"), F.col(text_col).alias("k_text"))
    found = features(plain, "k_text", keep=[f"k_{i}" for i in range(len(kept))] + ["k_id", "stratum"])
    found = write_table(found, "features")
    scored = found.select("*", *(F.coalesce(score(), F.lit(0.0)).alias(f"s_{r}") for r, (score, _) in RULES.items()))
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    cuts = thresholds(scored.where(~base).select("k_id", "stratum", *(f"s_{r}" for r in RULES)), labels, "k_id")
    # a stored table of known size: the planner broadcasts it if it is small, and never shuffles documents by stratum to find that out
    cuts = write_table(cuts, "cutoffs")
    met = scored.join(cuts, "stratum", "left")
    fails = F.array_compact(F.array(*(F.when(F.col(f"s_{r}") > F.try_element_at("cutoffs", F.lit(r)), F.lit(r)) for r in RULES)))
    names = {c: free_name(docs.select(*kept), c) for c in (*BASE_FEATURES, "base_failed", "kept", "failed_rules")}
    rules = F.array_join(fails, ",")
    return met.select(
        *(F.col(f"k_{i}").alias(c) for i, c in enumerate(kept)),
        *(F.col(c).alias(names[c]) for c in BASE_FEATURES),
        base.alias(names["base_failed"]),
        (~base & (rules == "")).alias(names["kept"]),
        rules.alias(names["failed_rules"]),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judge(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
