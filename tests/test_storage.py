"""Bucketed upserts, the landing zone, ratings as keyed state, SQL names."""

import json
import os
import random

import pandas as pd
import pytest
from matchgrid.functions import sql
from matchgrid.operators import merge, ratings, tables
from matchgrid.sources import landing
from matchgrid.streaming import live
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In


def _files(path):
    out = {}
    for d, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                out[os.path.relpath(os.path.join(d, n), path)] = os.path.getsize(os.path.join(d, n))
    return out


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(i, f"p{i}", i % 5) for i in range(400)], "pid int, name string, goals int")
    tables.create(old, path, ["pid"], 16)
    before = _files(path)
    new = spark.createDataFrame([(7, None, 9), (1000, "new", 1)], "pid int, name string, goals int")
    entry = tables.upsert_into(new, path, {"goals": merge.raise_only("goals")})
    after = _files(path)
    changed = {os.path.dirname(f) for f in set(before) ^ set(after)}
    assert len(entry["touched"]) <= 2 and changed == {f"bucket={b}" for b in entry["touched"]}
    want = merge.upsert(old, new, ["pid"], {"goals": merge.raise_only("goals")})
    assert _rows(tables.read_table(spark, path).select("pid", "name", "goals")) == _rows(want)
    assert sum(after[f] for f in set(after) - set(before)) < sum(before.values()) / 4
    with pytest.raises(tables.Conflict):
        tables.create(old, path, ["pid"], 16)


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.create(spark.createDataFrame([(1, 1)], "pid int, goals int"), path, ["pid"], 4)
    add = {"goals": F.coalesce("old_goals", F.lit(0)) + F.col("new_goals")}
    batch = spark.createDataFrame([(1, 5), (2, 3)], "pid int, goals int")
    first = tables.upsert_into(batch, path, add, batch="b1")
    assert tables.upsert_into(batch, path, add, batch="b1")["number"] == first["number"] == 2
    assert _rows(tables.read_table(spark, path)) == [(1, 6), (2, 3)]
    assert _rows(tables.read_table(spark, path)) == _rows(tables.read_table(spark, path).distinct())


def test_of_two_writers_none_loses_its_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.create(spark.createDataFrame([(1, 1)], "pid int, goals int"), path, ["pid"], 1)
    add = {"goals": F.coalesce("old_goals", F.lit(0)) + F.col("new_goals")}
    other = spark.createDataFrame([(1, 10), (3, 3)], "pid int, goals int")
    came = []

    def meanwhile():
        if not came:
            came.append(tables.upsert_into(other, path, add))

    tables.upsert_into(spark.createDataFrame([(1, 100), (2, 2)], "pid int, goals int"), path, add, before_commit=meanwhile)
    assert _rows(tables.read_table(spark, path)) == [(1, 111), (2, 2), (3, 3)]
    assert [v["number"] for v in tables.versions(spark, path)] == [1, 2, 3]


def test_an_unfinished_upsert_is_finished_by_the_next_writer(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.create(spark.createDataFrame([(i, i) for i in range(20)], "pid int, goals int"), path, ["pid"], 4)
    replace = tables._replace
    monkeypatch.setattr(tables, "_replace", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        tables.upsert_into(spark.createDataFrame([(3, 33)], "pid int, goals int"), path)
    monkeypatch.setattr(tables, "_replace", replace)
    tables.upsert_into(spark.createDataFrame([(4, 44)], "pid int, goals int"), path)
    got = dict(_rows(tables.read_table(spark, path)))
    assert got[3] == 33 and got[4] == 44 and len(got) == 20 and all(v["done"] for v in tables.versions(spark, path))


def test_a_stream_upserts_each_batch_once(spark, tmp_path):
    path, source, state = (str(tmp_path / x) for x in ("t", "in", "state"))
    schema = "pid int, goals int"
    tables.create(spark.createDataFrame([(i, 0) for i in range(50)], schema), path, ["pid"], 8)
    add = {"goals": F.coalesce("old_goals", F.lit(0)) + F.col("new_goals")}
    write = live.ingest_into(path, "feed", add)

    def feed(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{n}")
        q = live.read(spark, f"{source}/*", schema).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()

    feed(0, [(1, 3), (1, 2), (99, 1)])
    feed(1, [(1, 4), (2, 5)])
    got = dict(_rows(tables.read_table(spark, path)))
    assert (got[1], got[2], got[99], len(got)) == (7, 5, 1, 51)
    write(spark.createDataFrame([(1, 4), (2, 5)], schema), 1)  # a replay after a failure
    assert dict(_rows(tables.read_table(spark, path))) == got


def _land(root, competition, season, match, events, at=None):
    folder = os.path.join(root, competition, season, match)
    os.makedirs(folder, exist_ok=True)
    for name, value in (("events", events), ("match", {"home_team": "A", "home_score": len(events)})):
        file = os.path.join(folder, f"{name}.json")
        with open(file + ".tmp", "w") as f:
            json.dump(value, f)
        os.rename(file + ".tmp", file)
        if at:
            os.utime(file, (at, at))


def test_landing_zone_batch_and_pruning(spark, tmp_path):
    root = str(tmp_path / "zone")
    _land(root, "wc", "2018", "m1", [{"type": "Shot", "location": [1.5, 2]}, {"type": "Pass", "tags": {"a": 1}}])
    _land(root, "wc", "2022", "m2", [{"type": "Pass"}])
    _land(root, "euro", "2020", "m3", [])
    raw = landing.landed(spark, root)
    got = landing.records(raw, "type string, location array<double>").collect()
    assert sorted((r["match_id"], r["position"], r["type"], r["location"]) for r in got) == [("m1", 0, "Shot", [1.5, 2.0]), ("m1", 1, "Pass", None), ("m2", 0, "Pass", None)]
    one = raw.where("competition = 'wc' and season in ('2022', '2026')")
    assert [r["match_id"] for r in one.collect()] == ["m2"]
    reader = landing.LandingReader(root, "events")
    rest = list(reader.pushFilters([EqualTo(("competition",), "wc"), In(("season",), ("2022",)), EqualTo(("position",), 0)]))
    assert len(rest) == 1 and [p.match_id for p in reader.partitions()] == ["m2"]
    plan = one._jdf.queryExecution().toString()
    assert "matchgrid_landing" in plan and one.rdd.getNumPartitions() == 1
    assert landing.records(landing.landed(spark, root, "match"), "home_team string, home_score int").where("home_score = 2").first()["match_id"] == "m1"
    assert landing.landed(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="kind"):
        landing.landed(spark, root, "other").count()


def test_landing_zone_stream_reads_each_file_once_also_after_a_restart(spark, tmp_path):
    root, out, state = (str(tmp_path / x) for x in ("zone", "out", "state"))
    _land(root, "wc", "2018", "m1", [{"type": "Shot"}] * 3, 1000)

    def run():
        raw = landing.landed(spark, root, stream=True)
        q = raw.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="1 second").start()
        q.processAllAvailable()
        q.stop()
        return _rows(spark.read.parquet(out).groupBy("match_id").count())

    assert run() == [("m1", 3)]
    _land(root, "wc", "2018", "m2", [{"type": "Pass"}], 2000)
    _land(root, "euro", "2020", "m0", [{"type": "Pass"}] * 2, 2000)
    assert run() == [("m0", 2), ("m1", 3), ("m2", 1)]
    assert run() == [("m0", 2), ("m1", 3), ("m2", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_ratings_in_order_whatever_the_order_of_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    start = pd.Timestamp("2024-01-01")
    rows = [(rng.choice("gh"), start + pd.Timedelta(hours=i), *rng.sample("ABCD", 2), rng.randint(0, 4), rng.randint(0, 4)) for i in range(40)]
    schema = "grp string, at timestamp, home string, away string, hg int, ag int"
    source, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    shuffled = sorted(rows, key=lambda r: r[1] + pd.Timedelta(hours=rng.randint(0, 9)))
    end = [(g, start + pd.Timedelta(days=30), "X", "Y", 0, 0) for g in "gh"]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def feed(n, part):
        spark.createDataFrame([(r[0], r[1].to_pydatetime(), *r[2:]) for r in part], schema).coalesce(1).write.mode("append").parquet(f"{source}/{n}")

    def run():
        stream = live.read(spark, f"{source}/*", schema, 1)
        q = live.ordered_elo(stream, "grp", "at", "12 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").start()
        q.processAllAvailable()
        q.stop()

    try:
        for n in range(2):
            feed(n, shuffled[n * 12 : n * 12 + 12])
        run()  # and again from the checkpoint
        feed(2, shuffled[24:])
        feed(3, end)
        run()
        feed(4, [(g, start + pd.Timedelta(days=60), "X", "Y", 0, 0) for g in "gh"])
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r["grp"], r["at"]): (r["home"], round(r["elo_home"], 6), round(r["elo_away"], 6)) for r in spark.read.parquet(out).where("home <> 'X'").collect()}
    batch = ratings.elo_fold(spark.createDataFrame([(r[0], r[1].to_pydatetime(), *r[2:]) for r in rows], schema), "grp", ["at"]).collect()
    assert got == {(r["grp"], r["at"]): (r["home"], round(r["elo_home"], 6), round(r["elo_away"], 6)) for r in batch}


def test_names_for_sql_text(spark):
    sql.register(spark)
    assert spark.sql("SELECT ascii_name('Łódź'), token_set_ratio('a b', 'b a'), ascii_name(NULL)").first()[:] == ("Lodz", 100, None)
    rows = spark.sql("SELECT * FROM roster_entries('A:90, x:y:45,,B, C:no') ").collect()
    assert [tuple(r) for r in rows] == [(0, "A", 90, True), (1, "x:y", 45, False), (2, "B", None, False), (3, "C", None, False)]
    assert spark.sql("SELECT * FROM roster_entries(NULL)").count() == 0 and spark.sql("SELECT * FROM html_tables(NULL)").count() == 0
    page = "<table><tr><th>a</th></tr><tr><td>1</td></tr></table>"
    assert [tuple(r) for r in spark.sql(f"SELECT * FROM html_tables('{page}')").collect()] == [(0, 0, ["a"], ["a"]), (0, 1, ["1"], ["a"])]


def test_ranks_and_ratings_by_a_plain_fold(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["g", "h", None]), i, *rng.sample("ABCDE", 2), rng.choice([0, 1, 2, None]), rng.randint(0, 3)) for i in range(120)]
    got = ratings.elo_fold(spark.createDataFrame(rows, "grp string, t int, home string, away string, hg int, ag int"), "grp", ["t"], ranks=True).collect()
    boards = {}
    want = {}
    for g, t, h, a, x, y in rows:
        r = boards.setdefault(g, {})
        place = lambda team: 1 + (sum(v > r[team] for v in r.values()) if team in r else len(r))  # noqa: E731, B023
        before = r.get(h, 1500.0), r.get(a, 1500.0)
        want[t] = (*before, place(h), place(a))
        if x is not None:
            change = ratings.change_of(*before, x, y)
            r[h], r[a] = before[0] + change, before[1] - change
    assert {r["t"]: (r["elo_home"], r["elo_away"], r["rank_home"], r["rank_away"]) for r in got} == want
