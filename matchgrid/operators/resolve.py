"""Entity resolution: best match by token-set similarity, and registration of new names.

Candidates come from two indexes that together lose no pair above the threshold.

- A pair whose shared tokens are most of one of its names meets under one of that name's
  rarest tokens: those that are left when its commonest tokens can no longer make up the
  share (prefix filter by the other side's token counts).
- Any other pair scores by the common subsequence of whole names, shared tokens first. So
  for each set of tokens that may be the shared one, the rests differ by few insertions and
  deletions; cut into one more segments than that, one segment is in both names, within a few
  places of its own (pigeonhole). Keys hold both lengths, the shared tokens, and the segment.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from matchgrid.functions.text import ascii_name
from matchgrid.sources.stored import drop_stored, stored

#: Least scores by use.
THRESHOLDS = {"default": 80, "squad": 78, "league": 80, "missing": 82}
#: Rests that may differ by more than this meet by shared tokens and lengths alone (names of some 30 characters and more).
MOST_SEGMENTS = 14
#: Largest roster that ``exhaustive`` broadcasts.
SMALL_ROSTER = 5_000


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        m = row & masks.get(c, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> int:
    """200 * common subsequence / total length, to the nearest whole number."""
    return round(200 * _common(a, b) / (len(a) + len(b))) if a or b else 0


def token_set_ratio(a: str | None, b: str | None) -> int:
    """0 to 100: the best ratio among shared tokens and shared tokens with either rest; 100 if one side's tokens are all in the other's."""
    sets = [set("".join(c if c.isalnum() else " " for c in (x or "").lower()).split()) for x in (a, b)]
    if not sets[0] or not sets[1]:
        return 0
    both = " ".join(sorted(sets[0] & sets[1]))
    rest = [" ".join(sorted(s - sets[1 - i])) for i, s in enumerate(sets)]
    if both and not (rest[0] and rest[1]):
        return 100
    full = [f"{both} {r}".strip() for r in rest]
    scores = [ratio(*full)]
    if both:
        scores += [ratio(both, full[0]), ratio(both, full[1])]
    return max(scores)


@pandas_udf(IntegerType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b)], index=a.index, dtype="int32")


def _least_share(threshold: int) -> float:
    """The share of the longer of two bags that must be common, and so the least length of the shorter against the longer."""
    return (threshold - 0.5) / (200 - (threshold - 0.5))


def allowed_edits(total: int, threshold: int) -> int:
    """The most insertions and deletions between two names of ``total`` characters in sum that reach the threshold."""
    return int(total * (100.5 - threshold) / 100 + 1e-9)


def name_tokens(name: str | None) -> list[str]:
    return sorted(set("".join(c if c.isalnum() else " " for c in (name or "").lower()).split()))


def _segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of ``parts`` segments, the longer ones last."""
    short, longer = divmod(length, parts)
    cuts, at = [], 0
    for i in range(parts):
        n = short + (i >= parts - longer)
        cuts.append((at, n))
        at += n
    return cuts


def segment_keys(name: str | None, threshold: int, lengths: list[int], probe: bool) -> list[str]:
    """The keys under which a name meets those of the other side (of the given lengths) whose whole names are similar enough.

    One side cuts its rests into segments, the other (``probe``) offers its pieces at the
    places where such a segment can lie if it is the first whole one from either end.
    """
    tokens = name_tokens(name)
    own = len(" ".join(tokens))
    least = _least_share(threshold)
    keys = set()
    for n in range(len(tokens)):
        for shared in itertools.combinations(tokens, n):
            head = len(" ".join(shared))
            if head and head >= own * least - 1e-9:
                continue  # found by its rarest tokens
            rest = " ".join(t for t in tokens if t not in shared)
            for other in lengths:
                edits = allowed_edits(own + other, threshold)
                cut = len(rest) if not probe else len(rest) + other - own  # the length of the side that is cut
                if abs(own - other) > edits or cut < 1:
                    continue
                where = f"{' '.join(shared)}|{other if probe else own}|{own if probe else other}"
                if cut <= edits or edits > MOST_SEGMENTS:
                    keys.add(where)
                    continue
                shift = len(rest) - cut if probe else 0
                for i, (at, size) in enumerate(_segments(cut, edits + 1)):
                    if probe:
                        first = max(0, at - i, at + shift - (edits - i))
                        last = min(len(rest) - size, at + i, at + shift + (edits - i))
                        keys.update(f"{where}|{i}|{rest[p : p + size]}" for p in range(first, last + 1))
                    else:
                        keys.add(f"{where}|{i}|{rest[at : at + size]}")
    return sorted(keys)


def letter_bits(name: str | None) -> int:
    """64 bits, two for each of 32 classes of characters: whether one, and whether two or more occur. Names that differ by n insertions and deletions differ in n bits at most."""
    bits = 0
    for c in " ".join(name_tokens(name)):
        bit = ord(c) % 32 * 2
        bits |= 2 << bit if bits >> bit & 1 else 1 << bit
    return bits - (1 << 64) if bits >> 63 else bits


def _keyed(names: DataFrame, threshold: int, lengths: list[int], probe: bool) -> DataFrame:
    """(key, n, bits, k): ``names(key)`` with length, letters and each of its segment keys, hashed; a chance collision only adds a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):  # a name has some hundred keys
                names = batch.column(0).slice(a, 256)
                plain = names.to_pylist()
                made = [pa.array([len(" ".join(name_tokens(x))) for x in plain], pa.int32()), pa.array([letter_bits(x) for x in plain], pa.int64())]
                keys = pa.array([segment_keys(x, threshold, lengths, probe) for x in plain], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([names, *made, keys], names=["key", "n", "bits", "ks"])

    made = names.select("key").mapInArrow(run, "key string, n int, bits long, ks array<string>")
    return made.select("key", "n", "bits", F.explode("ks").alias("k")).select("key", "n", "bits", F.xxhash64("k").alias("k"))


def _meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of tables that grow with the names. Exploded and packed ones look small to the planner, which would gather them in the driver to broadcast them."""
    return left.join(right.hint("merge"), on, how)


def _tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^\\p{L}\\p{N}]+"), lambda t: t != ""))


def _rarest(names: DataFrame, others: DataFrame, threshold: int) -> DataFrame:
    """(key, token): of each name the tokens, rarest among ``others`` first, until the rest is too short to be the shared part."""
    counts = others.select(F.explode(_tokens(F.col("key"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    each = _meet(names.select("key", F.explode(_tokens(F.col("key"))).alias("token")), counts, "token", "left")
    listed = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("ts"))  # as many as a name has
    size = lambda ts: F.aggregate(ts, F.lit(-1), lambda a, t: a + F.length(t["token"]) + 1)
    whole, count = size("ts"), F.size("ts")
    kept = F.filter("ts", lambda t, i: size(F.slice("ts", i + 1, count - i)) >= whole * _least_share(threshold) - 1e-9)
    return listed.select("key", F.explode(kept).alias("t")).where("t.n > 0").select("key", "t.token")


def candidates(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """(l, r): pairs of ``left(key)`` and ``right(key)``, different ASCII names, among them all that reach the threshold."""
    a, b = (stored(x.select("key").where("key is not null").distinct(), "names") for x in (left, right))  # each is read five times
    size = F.length(F.array_join(_tokens(F.col("key")), " "))
    lengths = [sorted(r[0] for r in x.select(size.alias("n")).distinct().collect() if r[0]) for x in (a, b)]  # as many as lengths occur
    words = lambda x: x.select("key", F.explode(_tokens(F.col("key"))).alias("token"))
    one = _meet(_rarest(a, b, threshold).select("token", F.col("key").alias("l")), words(b).select("token", F.col("key").alias("r")), "token").select("l", "r")
    two = _meet(_rarest(b, a, threshold).select("token", F.col("key").alias("r")), words(a).select("token", F.col("key").alias("l")), "token").select("l", "r")
    probes, cuts = _keyed(a, threshold, lengths[1], True), _keyed(b, threshold, lengths[0], False)
    met = _meet(probes.select("k", F.col("key").alias("l"), "n", "bits"), cuts.select("k", F.col("key").alias("r"), F.col("n").alias("m"), F.col("bits").alias("more")), "k")
    edits = F.floor((F.col("n") + F.col("m")) * ((100.5 - threshold) / 100) + 1e-9)
    three = met.where(F.bit_count(F.col("bits").bitwiseXOR(F.col("more"))) <= edits).select("l", "r")
    return one.union(two).union(three).distinct()


def similar(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """(l, r, score) of the pairs of ``left(key)`` and ``right(key)`` that reach the threshold."""
    return candidates(left, right, threshold).withColumn("score", similarity("l", "r")).where(F.col("score") >= threshold)


def best_matches(
    targets: DataFrame, roster: DataFrame, threshold: int = THRESHOLDS["default"], per: str = "target", exhaustive: bool = False
) -> DataFrame:
    """(target, name, entity_id, pos, score, is_new) of ``targets(target)`` against ``roster(name, entity_id, pos)``.

    The highest score wins, then the earlier roster row. ``per`` "target": every target
    appears; without a score of ``threshold`` it is new, its id a hash of its ASCII name.
    ``per`` "roster": each roster row finds its best target, and a target may serve many.
    The roster is fixed: new names do not match one another.
    """
    t = targets.select("target").distinct().withColumn("t_key", ascii_name(F.col("target")))
    r = roster.select("name", "entity_id", "pos").withColumn("r_key", ascii_name(F.col("name")))
    if exhaustive:
        if roster.limit(SMALL_ROSTER + 1).count() > SMALL_ROSTER:
            raise ValueError(f"exhaustive is for rosters of up to {SMALL_ROSTER} names")
        pairs = t.join(F.broadcast(r))
    else:
        found = candidates(t.select(F.col("t_key").alias("key")), r.select(F.col("r_key").alias("key")), threshold)
        pairs = _meet(_meet(t, found, F.col("t_key") == F.col("l")), r, F.col("r_key") == F.col("r")).drop("l", "r")
    scored = pairs.withColumn("score", similarity("t_key", "r_key")).where(F.col("score") >= threshold)
    key = "target" if per == "target" else "pos"
    order = W.partitionBy(key).orderBy(F.desc("score"), "pos", "target")
    best = scored.withColumn("__r", F.row_number().over(order)).where("__r = 1").select("target", "name", "entity_id", "pos", "score")
    if per != "target":
        return best.withColumn("is_new", F.lit(False))
    out = t.join(best, "target", "left")
    fresh = F.concat(F.lit("new-"), F.substring(F.sha2(F.lower("t_key"), 256), 1, 16))
    return out.select("target", "name", F.coalesce("entity_id", fresh).alias("entity_id"), "pos", "score", F.col("entity_id").isNull().alias("is_new"))


def name_index(roster: DataFrame) -> DataFrame:
    """(key, entity_id): names and their ASCII forms; a later row takes over an earlier one's key."""
    keys = roster.select("entity_id", "pos", F.explode(F.array_distinct(F.array("name", ascii_name(F.col("name"))))).alias("key"))
    return keys.groupBy("key").agg(F.max_by("entity_id", "pos").alias("entity_id"))


def register(targets: DataFrame, roster: DataFrame, threshold: int = THRESHOLDS["default"]) -> DataFrame:
    """(target, seq, name, entity_id, score, is_new) of ``targets(target, seq)`` in the order of seq against ``roster(name, entity_id, pos)``.

    A name joins the best of the names registered before it, the roster's first; of equal
    scores the one registered earliest. Without a score of ``threshold`` it registers itself
    and may be joined by later names. Of roster rows with one ASCII name the first gives
    the place, the last the name and id. Null targets and names without letters or digits
    match nothing. seq must be unique.

    Nothing beats a roster name of score 100, so names that have one are not compared further.
    Who registers is settled in rounds: a name whose earlier similar names are all settled
    registers if none of them did; names that it reaches do not. Each round is a few joins
    over the pairs that are still open.
    """
    t = targets.select("target", "seq").withColumn("key", ascii_name(F.col("target")))
    t = stored(t, "targets")
    r = roster.select("name", "entity_id", "pos").withColumn("key", ascii_name(F.col("name"))).groupBy("key")
    r = r.agg(F.min("pos").alias("pos"), F.max_by("name", "pos").alias("name"), F.max_by("entity_id", "pos").alias("entity_id")).where("key is not null")
    r = stored(r, "roster")
    firsts = t.where("key is not null").groupBy("key").agg(F.min("seq").alias("seq"))
    names = lambda x, c: x.select(F.col(c).alias("key")).distinct()
    same = stored(similar(firsts, r, 100), "same")
    rest = stored(_meet(firsts, names(same, "l"), "key", "left_anti"), "rest")
    near = stored(similar(rest, r, threshold), "known")
    known = same.union(near)
    open_ = stored(_meet(rest, names(near, "l"), "key", "left_anti"), "open")
    pairs = similar(open_, open_, threshold).where("l <> r")
    side = lambda c: open_.select(F.col("key").alias(c), F.col("seq").alias(f"{c}_seq"))
    pairs = stored(_meet(_meet(pairs, side("l"), "l"), side("r"), "r").where("l_seq < r_seq").select("l", "r", "score"), "pairs")
    edges, joined = pairs.select("l", "r"), []
    while edges.limit(1).count():
        heads = _meet(edges.select("l").distinct(), names(edges, "r").toDF("l"), "l", "left_anti")
        hit = stored(_meet(edges, heads, "l").select("r").distinct(), "hit")
        joined.append(hit)
        left = _meet(_meet(_meet(edges, heads, "l", "left_anti"), hit, "r", "left_anti"), hit.toDF("l"), "l", "left_anti")
        new = stored(left.select("l", "r"), "edges")
        drop_stored(edges)
        edges = new
    hits = reduce(DataFrame.union, joined).toDF("key") if joined else open_.select("key").limit(0)
    leaders = stored(_meet(open_, hits, "key", "left_anti"), "leaders")
    heads = leaders.select(F.col("key").alias("r"), F.col("seq").alias("pos"), F.lit(1).alias("late"))
    # what a name may join: the roster's names, and leaders before it, itself where it comes again
    again = leaders.where(F.size(_tokens(F.col("key"))) > 0).select(F.col("key").alias("l"), F.col("key").alias("r"), F.lit(100).alias("score"))
    options = _meet(pairs.select("l", "r", "score").union(pairs.select(F.col("r").alias("l"), F.col("l").alias("r"), "score")).union(again), heads, "r")
    # names that match the roster may score higher with a leader
    also = _meet(similar(names(near, "l"), leaders, threshold), heads, "r").select("r", "l", "score", "pos", "late")
    options = options.select("r", "l", "score", "pos", "late").union(also).union(_meet(known, r.select(F.col("key").alias("r"), "pos"), "r").select("r", "l", "score", "pos", F.lit(0)))
    met = _meet(t, options, F.col("key") == F.col("l")).where("late = 0 or pos < seq")
    best = met.groupBy("seq").agg(F.min_by("r", F.struct(-F.col("score"), "late", "pos")).alias("r"), F.max("score").alias("score"))
    ids = r.select(F.col("key").alias("r"), "name", "entity_id", F.lit(0).alias("late"))
    fresh = lambda key, seq: F.concat(F.lit("new-"), F.substring(F.sha2(F.concat_ws("|", F.lower(key), seq.cast("string")).cast("binary"), 256), 1, 16))
    own = _meet(leaders, t.select("seq", "target"), "seq").select(F.col("key").alias("r"), F.col("target").alias("name"), fresh(F.col("key"), F.col("seq")).alias("entity_id"), F.lit(1).alias("late"))
    named = ids.union(_meet(own, ids.select("r"), "r", "left_anti")).drop("late")
    out = _meet(_meet(t, best, "seq", "left"), named, "r", "left")
    new = F.col("entity_id").isNull()
    return out.select("target", "seq", "name", F.coalesce("entity_id", fresh(F.coalesce("key", F.lit("")), F.col("seq"))).alias("entity_id"), "score", new.alias("is_new"))


def line_up_teams(line_ups: DataFrame) -> DataFrame:
    """(target, team, seq) of ``line_ups(player_name, team, seq)``: the first team that lists a name; empty names are left out."""
    rows = line_ups.where("player_name is not null and player_name <> ''")
    return rows.groupBy(F.col("player_name").alias("target")).agg(F.min_by("team", "seq").alias("team"), F.min("seq").alias("seq"))


def ids_to_teams(line_ups: DataFrame, roster: DataFrame, threshold: int = THRESHOLDS["default"]) -> DataFrame:
    """(entity_id, team) of the registered names that the line-ups' names join, in the order in which they first occur; the last name of an id decides."""
    named = line_up_teams(line_ups)
    found = register(named.select("target", "seq"), roster, threshold).where("not is_new")
    return _meet(found, named.select("seq", "team"), "seq").groupBy("entity_id").agg(F.max_by("team", "seq").alias("team"))
