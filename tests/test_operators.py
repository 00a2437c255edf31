import json
import random

from matchgrid.operators import dataset, events, forest, merge, models, profile, ratings, resolve, simulate
from matchgrid.sources import html, readers, schemas, writers
from matchgrid.streaming import live
from pyspark.sql import functions as F


def test_token_set_scores():
    assert resolve.token_set_ratio("Jo Smith", "smith jo ann") == 100
    assert resolve.token_set_ratio("abc", "abd") == 67
    assert resolve.token_set_ratio("", "x") == 0
    assert resolve.token_set_ratio("john smith", "jon smyth") == round(200 * 8 / 19)


def test_best_matches(spark):
    roster = spark.createDataFrame([("José Pérez", "a", 1), ("Jose Perez Lopez", "b", 2), ("Li Wei", "c", 3)], "name string, entity_id string, pos int")
    targets = spark.createDataFrame([("Perez Jose",), ("Nobody Known",), ("Wei Li",)], "target string")
    for exhaustive in (False, True):
        got = {r["target"]: r for r in resolve.best_matches(targets, roster, exhaustive=exhaustive).collect()}
        assert got["Perez Jose"]["entity_id"] == "a" and got["Wei Li"]["entity_id"] == "c" and got["Nobody Known"]["is_new"]
    assert {r["key"]: r["entity_id"] for r in resolve.name_index(roster).collect()}["Jose Perez"] == "a"
    per_roster = resolve.best_matches(targets, roster, per="roster").collect()
    assert {(r["name"], r["target"]) for r in per_roster} == {("José Pérez", "Perez Jose"), ("Jose Perez Lopez", "Perez Jose"), ("Li Wei", "Wei Li")}


def test_candidates_lose_no_match(spark):
    """Names with errors anywhere, tokens lost and turned round, against all pairs."""
    rng = random.Random(8)
    letters = "abcdeilmnorstuvz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))
    names = [" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(120)]

    def spoil(name):
        name = list(name)
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(name))
            name[i : i + 1] = rng.choice([[], [rng.choice(letters)], [name[i], rng.choice(letters)]])
            if not name:
                name = ["x"]
        parts = "".join(name).split()
        rng.shuffle(parts)
        return " ".join(parts) or "x"

    targets = sorted({spoil(rng.choice(names)) for _ in range(150)})
    roster = spark.createDataFrame([(n, f"id{i}", i) for i, n in enumerate(names)], "name string, entity_id string, pos int")
    asked = spark.createDataFrame([(t,) for t in targets], "target string")
    for threshold in (70, 80):
        fast = {r["target"]: (r["entity_id"], r["score"]) for r in resolve.best_matches(asked, roster, threshold).collect()}
        every = {r["target"]: (r["entity_id"], r["score"]) for r in resolve.best_matches(asked, roster, threshold, exhaustive=True).collect()}
        assert fast == every and sum(s is not None for _, s in every.values()) > 60


def test_elo_fold_and_as_of(spark):
    m = spark.createDataFrame([("g", 1, "A", "B", 2, 0), ("g", 2, "B", "A", 1, 1), ("h", 1, "C", "D", 0, 5)], "grp string, t int, home string, away string, hg int, ag int")
    rows = {(r["grp"], r["t"]): r for r in ratings.elo_fold(m, "grp", ["t"]).collect()}
    e = 1 / (1 + 10 ** (-60 / 400))
    change = 22 * 1.3 * (1 - e)
    assert abs(rows["g", 1]["elo_home_after"] - 1500 - change) < 1e-9 and rows["g", 2]["elo_away"] == rows["g", 1]["elo_home_after"]
    hist = ratings.team_history(ratings.elo_fold(m, "grp", ["t"]), ["t"])
    asked = spark.createDataFrame([("A", 1), ("A", 2), ("Z", 9)], "team string, t int")
    got = {(r["team"], r["t"]): r["elo"] for r in ratings.rating_as_of(hist, asked, "t").collect()}
    assert got["A", 1] == 1500 and abs(got["A", 2] - 1500 - change) < 1e-9 and got["Z", 9] == 1500
    assert ratings.top(ratings.current(hist, ["t"]), 1).first()["team"] == "D"


def test_streaming_elo_matches_batch(spark, tmp_path):
    m = spark.createDataFrame([("g", i, "AB"[i % 2], "BA"[i % 2], i % 3, i % 2) for i in range(9)], "grp string, t int, home string, away string, hg int, ag int")
    m.where("t < 5").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    m.where("t >= 5").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = live.read(spark, str(tmp_path / "in/*"), m.schema, 1)
    q = live.rolling_elo(stream, "grp", "t").writeStream.format("memory").queryName("elo").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {r["t"]: round(r["elo_home"], 6) for r in ratings.elo_fold(m, "grp", ["t"]).collect()}
    assert {r["t"]: round(r["elo_home"], 6) for r in spark.table("elo").collect()} == want


def test_streaming_ingest_adds_once(spark, tmp_path):
    run = live.ingest_absent(str(tmp_path / "t"), ["k"])
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    run(batch, 0)
    run(batch, 0)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2]


def test_streaming_windows(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    src = live.read(spark, str(tmp_path / "in"), rows.schema)
    q = live.event_windows(src, "ts", ["event_type"], [F.count("*").alias("n")], "1 hour").writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("win").agg(F.sum("n")).first()[0] == 1000


def test_event_metrics_on_a_feed_that_lacks_columns(spark):
    rows = [("m", "p", "A", "Pass", None, "Through Ball"), ("m", "p", "A", "Pass", "Incomplete", None), ("m", "p", "A", "Foul Committed", None, None), ("m", None, "A", "Pass", None, None)]
    df = spark.createDataFrame(rows, "match_id string, player string, team string, type string, pass_outcome string, pass_type string")
    got = events.match_player_metrics(df).collect()
    assert len(got) == 1 and (got[0]["passes_attempted"], got[0]["passes_completed"], got[0]["through_balls"], got[0]["fouls_committed"], got[0]["xg"]) == (2, 1, 1, 1, 0.0)


def test_tournament_stats(spark):
    ev = spark.createDataFrame([("m", "p", "A", "Shot")], "match_id string, player string, team string, type string")
    lu = spark.createDataFrame([("m", "A", "p", None, [("00:00", None, "x")])], schemas.LINEUPS)
    r = events.tournament_stats(ev, lu).first()
    assert (r["shots"], r["minutes"], r["is_starter"]) == (1, 90, 1)


def _players(spark, teams=("A", "B")):
    rows = [(t, p, 100 + i, f"c{i % 2}", 1) for t in teams for i, p in enumerate(("FW", "MF", "DF", "GK"))]
    players = spark.createDataFrame(rows, "team string, position string, minutes int, current_club string, is_starter int")
    return players.withColumns({f: F.lit(2.0) for f in profile.WEIGHTED})


def test_squad_features(spark):
    got = {r["team"]: r for r in profile.squad_features(_players(spark)).collect()}
    a = got["A"]
    assert (a["nt_w_xg"], a["star_top3_xg"], a["star_top_scorer_share"], a["squad_depth"], a["squad_starters"], a["pos_gk_saves"]) == (2.0, 6.0, 0.25, 4, 4, 2.0)
    assert abs(a["pos_fw_attack_score"] - 1.15 * 2 / 100 * 90) < 1e-9 and abs(a["pos_df_defense_per90"] - 6 / 102 * 90) < 1e-9
    assert (a["club_max_cluster_ratio"], a["club_distinct_clubs"], a["star_xg_gini"]) == (0.5, 2, 0.0)


def test_match_matrix_has_the_catalogue_and_nothing_else(spark):
    rating = spark.createDataFrame([("A", 1700.0, 1, "CAF")], "team string, elo double, rank int, confederation string")
    prof = profile.team_profile(spark.createDataFrame([("A",), ("B",)], "team string"), rating, _players(spark))
    rows = {r["team"]: r for r in prof.collect()}
    assert (rows["A"]["elo_rating"], rows["A"]["conf_CAF"], rows["A"]["conf_UEFA"], rows["B"]["elo_rating"], rows["B"]["elo_rank"], rows["B"]["conf_UEFA"]) == (1700.0, 1.0, 0.0, 1500.0, 1.0, 1.0)
    assert rows["A"]["lg_goals_max"] is None
    m = spark.createDataFrame([("m", "A", "B"), ("n", "A", "X")], "match_id string, home_team string, away_team string")
    t = dataset.feature_table(m, prof)
    assert t.count() == 1 and len(dataset.expected_columns()) == 188
    assert dataset.verify_columns(t.drop("match_id", "home_team", "away_team"), dataset.expected_columns()) == {"missing": [], "extra": []}


def test_proxies_by_hand(spark):
    rows = [(1, "FW", 90.0, 900, 9, 4, 3.0, 0, 10), (2, "GK", 90.0, 0, 0, None, None, None, None), (3, "XX", 0.5, 90, 0, 0, 0.0, 2, 0)]
    got = {r["pid"]: r for r in profile.proxy_events(spark.createDataFrame(rows, "pid int, position string, expected_minutes double, season_minutes int, goals int, assists int, xg double, interceptions int, tackles_won int")).collect()}
    fw = got[1]
    assert (round(fw["goals"], 9), round(fw["xg"], 9), round(fw["shots"], 9), round(fw["shots_on_target"], 9)) == (0.9, 0.3, 3.0, 1.26)
    q = 0.3 / 0.38
    assert abs(fw["key_passes"] - max(0.4 * 5.5, 0.8 * q)) < 1e-9 and abs(fw["crosses"] - 0.35 * q) < 1e-9 and abs(fw["pressures"] - 4.0) < 1e-9 and abs(fw["blocks"] - 0.2 * 1.0 / 0.55) < 1e-9
    assert (got[2]["goalkeeper_saves"], got[2]["clearances"], got[2]["shots"]) == (2.5, 0.25, 0.0)
    assert got[3]["minutes"] == 1.0 and abs(got[3]["blocks"] - 2 / 90 * 0.6) < 1e-12 and abs(got[3]["progressive_passes"] - 3.5 * 0.5 / 90) < 1e-12


def test_attach_ratings_defaults(spark):
    m = spark.createDataFrame([("A", "Q")], "home_team string, away_team string")
    r = spark.createDataFrame([("A", 1700.0, 1, None), ("B", 1600.0, 2, "CAF")], "team string, elo double, rank int, confederation string")
    got = dataset.attach_ratings(m, r).first()
    assert (got["elo_home"], got["elo_away"], got["rank_away"], got["conf_home"]) == (1700.0, 1500.0, 2, "UEFA")


def test_upsert_with_fallback(spark):
    old = spark.createDataFrame([("p", None, 1), ("q", None, 2), ("q", "WC", 3)], "pid string, competition string, caps int")
    new = spark.createDataFrame([("p", "WC", 9), ("q", "WC", 8), ("r", "EC", 7)], "pid string, competition string, caps int")
    got = {(r["pid"], r["competition"]): r["caps"] for r in merge.upsert_with_fallback(old, new, "pid", "competition", "WC").collect()}
    assert got == {("p", "WC"): 9, ("q", None): 2, ("q", "WC"): 8, ("r", "EC"): 7}
    assert merge.orphans(new, old.where("pid = 'p'"), "pid").count() == 2


def test_shipped_shape_sources(spark, tmp_path):
    (tmp_path / "elo.json").write_text(json.dumps({"_meta": {}, "teams": {"Korea Republic": {"elo": 1700, "rank": 20, "confederation": "AFC"}, "X": {"elo": 1500, "rank": 30}}}))
    got = {r["team"]: r["confederation"] for r in readers.elo_snapshot(spark, str(tmp_path / "elo.json"), {"Korea Republic": "South Korea"}).collect()}
    assert got == {"South Korea": "AFC", "X": "UEFA"}
    (tmp_path / "s.json").write_text(json.dumps({"groups": {"A": ["T1", "T2"]}, "group_stage_matches": [{"matchday": 1, "date": "2026-06-11", "group": "A", "home": "T1", "away": "T2", "venue": "V", "kickoff_et": "15:00"}]}))
    groups, matches = readers.schedule(spark, str(tmp_path / "s.json"))
    assert groups.count() == 2 and matches.first()["home"] == "T1"
    (tmp_path / "E0_2223.csv").write_bytes("Date,HomeTeam,AwayTeam,FTHG,FTAG,Extra\n05/08/22,Málaga,B,2,1,x\n06/08/2022,C,D,,1,x\n,,,,,\n".encode("latin-1"))
    rows = readers.club_matches(spark, [str(tmp_path / "E0_2223.csv")]).collect()
    assert [(r["home_team"], r["season_code"], r["league"], r["result"]) for r in rows] == [("Málaga", "2223", "E0", 1)]
    (tmp_path / "r.json").write_text(json.dumps({"T": [{"player_id": "1", "name": "N"}]}))
    assert readers.rosters(spark, str(tmp_path / "r.json")).first()["name"] == "N"
    (tmp_path / "squads.txt").write_bytes("### Team A\nManager: M\nGoalkeepers: Ann Lee (Club A), Bo Li (Club B, on loan)\n### Team B\nForwards: Cy Do (C)\n".encode("utf-16-le"))
    got = readers.squad_sections(readers.text_lines(spark, str(tmp_path / "squads.txt")), scope=["file"]).collect()
    assert [(r["team"], r["section"], r["name"], r["club"]) for r in got] == [("Team A", "Goalkeepers", "Ann Lee", "Club A"), ("Team A", "Goalkeepers", "Bo Li", "Club B"), ("Team B", "Forwards", "Cy Do", "C")]
    raw = spark.createDataFrame([("A", " b ", "2018-06-22 08:00:00 UTC", "[{'1': '2.0', 'X': '3.0', '2': '4.0', 'bookmaker_name': 'bet365', 'period': 'FT'}]"), ("C", "D", "x", "[]")], "home_team string, away_team string, match_date string, `1x2_market` string")
    got = readers.odds(raw, "t").collect()
    assert len(got) == 1 and got[0]["away_key"] == "b" and abs(got[0]["prob_home"] + got[0]["prob_draw"] + got[0]["prob_away"] - 1) < 1e-12
    made = []
    build = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert readers.cached(spark, str(tmp_path / "c"), build).count() == 3
    assert made == [1]


def test_result_files_in_one_scan(spark, tmp_path):
    """Columns in any order, quoted commas, a file that is missing, one without teams, one that is empty."""
    (tmp_path / "E0_2223.csv").write_bytes("Div,Date,HomeTeam,AwayTeam,FTHG,FTAG\nE0,05/08/22,Málaga,B,2,1\n".encode("latin-1"))
    (tmp_path / "E1_2122.csv").write_bytes(b'FTAG,FTHG,AwayTeam,HomeTeam,Date\r\n0,3,"D, United",C,06/08/2021\r\n1,x,D,C,06/08/2021\r\n')
    (tmp_path / "E2_2122.csv").write_bytes(b"Date,Home\n06/08/2021,C\n")
    (tmp_path / "E3_2122.csv").write_bytes(b"")
    paths = [str(tmp_path / f"E{i}_{s}.csv") for i, s in ((0, "2223"), (1, "2122"), (2, "2122"), (3, "2122"), (4, "2122"))]
    got = readers.club_matches(spark, paths).collect()
    assert [(r["home_team"], r["away_team"], r["home_score"], r["away_score"], r["league"], r["season_code"]) for r in got] == [("C", "D, United", 3, 0, "E1", "2122"), ("Málaga", "B", 2, 1, "E0", "2223")]
    assert readers.club_matches(spark, paths[4:]).count() == 0


def test_ratings_before_a_tournament(spark):
    hist = spark.createDataFrame([(2017, "A", 1600.0, 2), (2017, "B", 1700.0, 1), (2020, "A", 1800.0, 1)], schemas.ELO_HISTORY)
    assert [r["team"] for r in readers.elo_at(hist, "wc2018").collect()] == ["B", "A"]
    snap = spark.createDataFrame([("C", 1900.0, 1, "CAF")], "team string, elo double, rank int, confederation string")
    assert readers.elo_at(hist, "wc2026", snapshot=snap).first()["team"] == "C"


def test_slices_and_team_sets(spark):
    m = spark.createDataFrame([(1, "A", "x", "y"), (2, "A", "y", "z"), (1, "B", "u", None)], "matchday int, grp string, home_team string, away_team string")
    assert readers.matches_of(m, "y").count() == 2 and readers.slice_schedule(m, 1, "a").count() == 1 and readers.slice_schedule(m, group="b").count() == 1
    assert sorted(r["team"] for r in readers.teams_of(m).collect()) == ["u", "x", "y", "z"]
    assert [r["team"] for r in readers.known_teams(m, spark.createDataFrame([("z",), ("q",)], "team string")).collect()] == ["z"]


def test_medians_are_exact_and_filled_per_fold(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, float("nan")), (10.0, 4.0), (None, 8.0)], "a double, b double")
    m = models.MedianImputer(["a", "b"], ["x", "y"]).fit(df)
    assert sorted((r["x"], r["y"]) for r in m.transform(df).collect()) == [(1.0, 6.0), (2.0, 6.0), (2.0, 8.0), (10.0, 4.0)]
    assert models.exact_medians(spark.createDataFrame([(1.0,), (4.0,)], "a double"), ["a"]).first()["a"] == 2.5


def test_permutation_importance(spark):
    rows = spark.createDataFrame([(float(i % 2), float(i % 7), float(i % 2)) for i in range(200)], "a double, b double, y double")
    model = models.prepared(["a", "b"], models.forest(trees=5, depth=3)).fit(rows.withColumn("w", F.lit(1.0)))
    got = {r["feature"]: r["drop"] for r in models.permutation_importance(rows, model, ["a", "b"], rows=50).collect()}
    assert got["a"] > 0.2 and abs(got["b"]) < 0.05


def test_html_tables(spark):
    page = "<table><tr><th>a</th></tr></table><table><tr><th>Player</th><th>Gls</th></tr><tr><td>Ann <b>Lee</b></td><td>1,200</td></tr></table>"
    t = html.tables(spark.createDataFrame([(1, page), (2, None), (3, "<table><tr><td>x</td></tr>")], "page_id long, html string"))
    got = html.columns_like(html.stat_table(t, "page_id"), {"player": ["player"], "goals": ["goals", "gls"]}).collect()
    assert [(r["page_id"], r["player"], r["goals"]) for r in got] == [(1, "Ann Lee", "1,200")]


def test_tables_and_evolution(spark, tmp_path):
    df = writers.evolve(spark.range(1), {"id": "long", "xg": "double"})
    assert df.dtypes == [("id", "bigint"), ("xg", "double")]
    writers.write_csv(df, str(tmp_path / "c"))
    writers.write_json(df, str(tmp_path / "j"))
    writers.write_text(df, F.lit("line"), str(tmp_path / "t"))
    assert writers.apply(df, str(tmp_path / "p"), dry_run=True).count() == 1 and not (tmp_path / "p").exists()
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    for columns in schemas.TABLES.values():
        spark.createDataFrame([], columns)


def test_report_and_qualifier(spark):
    out = simulate.report(1600, 1500, spark)
    assert out["scores"].count() == 5 and out["match"].first()["pick"] == 1
    q = models.qualifier(F.lit(0), F.lit(1.0), F.lit(2.0), F.lit("h"), F.lit("a"))
    assert spark.range(1).select(q).first()[0] == "a"


def test_models_keep_folds_apart(spark):
    rows = spark.createDataFrame([(f"r{i}", float(i % 7), float((i * 3) % 5) if i % 4 else None, float(i % 7 > 3)) for i in range(60)], "id string, a double, b double, y double")
    out = models.cross_predict(rows, models.prepared(["a", "b"], models.forest(trees=5, depth=3)), "id", folds=2)
    met = out.join(rows, "id")
    assert met.count() == 60 and met.where("prediction = y").count() > 50
    folds = {r["fold"]: r["count"] for r in rows.withColumn("fold", forest.fold_of(F.col("id"), 5)).groupBy("fold").count().collect()}
    assert set(folds) == set(range(5)) and sum(folds.values()) == 60 and max(folds.values()) < 30


def test_ranks_before_each_match(spark):
    m = spark.createDataFrame([("g", 1, "A", "B", 2, 0), ("g", 2, "B", "C", 1, 1), ("g", 3, "A", "C", 0, 1)], "grp string, r int, home string, away string, hg int, ag int")
    got = {r["r"]: (r["rank_home"], r["rank_away"]) for r in ratings.elo_fold(m, "grp", ["r"], ranks=True).collect()}
    assert got == {1: (1, 1), 2: (2, 3), 3: (1, 2)}


def test_stat_tables_do_not_fan_out(spark):
    from matchgrid.operators import builders

    a = spark.createDataFrame([("p", "A", 1), ("p", "B", 2)], "player string, team string, goals int")
    b = spark.createDataFrame([("p", "A", 5), ("p", "A", 4), ("q", "A", 1)], "player string, team string, shots int")
    assert sorted(map(tuple, builders.merge_stat_tables(a, [b]).collect())) == [("p", "A", 1, 4), ("p", "B", 2, None)]


def test_club_dataset(spark):
    import datetime

    from matchgrid.operators import builders

    day = datetime.datetime(2023, 8, 5)
    m = spark.createDataFrame([(day, "2324", "E0", "A", "B", 2, 1), (None, "2324", "E0", "A", "B", 0, 0)], "date timestamp, season_code string, league string, home_team string, away_team string, home_score int, away_score int")
    p = spark.createDataFrame([("A", "2022-2023", 3.0), ("B", "2022-2023", 1.0)], "team string, season string, lg_goals double")
    got = builders.club_dataset(m, p).collect()
    assert len(got) == 1 and got[0]["diff_lg_goals"] == 2.0 and got[0]["diff_elo"] == 0.0 and got[0]["rank_home"] == got[0]["rank_away"] == 1
    later = [(day + datetime.timedelta(days=i), "2324", lg, h, a, x, y) for i, (lg, h, a, x, y) in enumerate([("E0", "A", "B", 2, 1), ("D1", "X", "Y", 0, 3), ("E0", "B", "A", 0, 0), ("D1", "Y", "X", 1, 1)])]
    more = spark.createDataFrame(later, m.schema)
    ranks = {(r["league"], r["home_team"]): (r["rank_home"], r["rank_away"], round(r["elo_home"], 6)) for r in builders.club_dataset(more, p).collect()}
    assert ranks["D1", "X"][:2] == (3, 3) and ranks["D1", "Y"][:2] == (1, 4)  # among the clubs of both leagues
    alone = {(r["league"], r["home_team"]): (r["rank_home"], r["rank_away"], round(r["elo_home"], 6)) for r in builders.club_dataset(more, p, ranked_in="league").collect()}
    assert alone["D1", "Y"][:2] == (1, 2) and {k: v[2] for k, v in alone.items()} == {k: v[2] for k, v in ranks.items()}
    t = builders.tournaments({"x": m.select("home_team"), "y": m.select("away_team")})
    assert t.count() == 4 and set(t.columns) == {"home_team", "away_team", "tournament"}
    teams = spark.createDataFrame([("A",), ("Z",)], "team string")
    r = spark.createDataFrame([("A", 1600.0, 1, "CAF")], "team string, elo double, rank int, confederation string")
    rows = {x["team"]: x for x in builders.tournament_matrix(teams, r, [p.drop("season"), p.drop("season").where("team = 'A'").withColumn("lg_goals", F.lit(9.0))]).collect()}
    assert rows["A"]["lg_goals"] == 9.0 and rows["A"]["conf_caf"] == 1.0 and rows["Z"]["elo"] == 1500.0


def test_boosted_and_regression_trees_saved_and_ranked(spark, tmp_path):
    """Spark ML estimators inside the same pipeline: upset forest, boosted trees of two and three classes, goal regressors; a saved model predicts the same."""
    rng = random.Random(2)
    rows = [(f"r{i}", rng.random(), rng.random()) for i in range(150)]
    df = spark.createDataFrame(rows, "id string, a double, b double").withColumns({"upset": (F.col("a") > 0.5).cast("double"), "y": F.floor(F.col("a") * 3).cast("double"), "goals": F.round(F.col("a") * 4)}).withColumn("w", F.lit(1.0))
    right = lambda out, label: out.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
    upset = models.prepared(["a", "b"], models.upset_forest().setNumTrees(5)).fit(df)
    assert right(upset.transform(df), "upset") > 0.95
    names = models.importances(upset, ["a", "b"])
    assert names[0][0] == "a" and abs(sum(v for _, v in names) - 1) < 1e-9
    assert right(models.prepared(["a", "b"], models.boosted(2, "upset", 3)).fit(df).transform(df), "upset") > 0.95
    assert right(models.prepared(["a", "b"], models.boosted(3, "y", 3)).fit(df).transform(df), "y") > 0.9
    for kind in ("poisson", "forest", "boosted"):
        out = models.prepared(["a", "b"], models.goal_model(kind)).fit(df).transform(df)
        assert out.agg(F.avg(F.abs(F.col("prediction") - F.col("goals")))).first()[0] < 0.8
    models.save(upset, str(tmp_path / "m"))
    again = models.load(str(tmp_path / "m"))
    assert [r["prediction"] for r in again.transform(df).orderBy("id").collect()] == [r["prediction"] for r in upset.transform(df).orderBy("id").collect()]


def test_samples_and_squad_seasons(spark):
    from matchgrid.operators import backtest, builders

    f = spark.createDataFrame([(f"m{i}",) for i in range(200)], "match string")
    one = sorted(r[0] for r in backtest.stable_sample(f, "match", 25).collect())
    assert len(one) == 25 and one == sorted(r[0] for r in backtest.stable_sample(f.repartition(7), "match", 25).collect())
    assert one != sorted(r[0] for r in backtest.stable_sample(f, "match", 25, seed=1).collect())
    stats = spark.createDataFrame([("A", "2021-2022"), ("A", "2022-2023"), ("A", "2022-2023")], "team string, season string")
    got = builders.squads_by_season(stats).where("latest = '2022-2023'").orderBy("season").collect()
    assert len(got) == 3 and got[-1]["season"] == "2022-2023" and [r["weight"] for r in got] == sorted(r["weight"] for r in got)


def test_large_result_files_are_read_in_parts(spark, tmp_path):
    rows = [(f"{1 + i % 28:02}/03/2021", f"Á{i % 17}", f"B{i % 13}", i % 5, i % 3) for i in range(3000)]
    (tmp_path / "E0_2021.csv").write_bytes(("Date,HomeTeam,AwayTeam,FTHG,FTAG\r\n" + "".join(f"{d},{h},{a},{x},{y}\r\n" for d, h, a, x, y in rows)).encode("latin-1"))
    (tmp_path / "E1_2021.csv").write_bytes(("﻿FTHG,FTAG,AwayTeam,HomeTeam,Date\n" + "\n".join(f'{x},{y},"{a}",{h},{d}' for d, h, a, x, y in rows)).encode("utf-8").replace("Á".encode(), b"\xc1"))
    paths = [str(tmp_path / f"{n}_2021.csv") for n in ("E0", "E1")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        found = readers.club_matches(spark, paths)
        got = found.collect()
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert readers._lines(spark, paths, "ISO-8859-1").rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = sorted((league, d, h, a, x, y) for league in ("E0", "E1") for d, h, a, x, y in rows)
    assert sorted((r["league"], r["date"].strftime("%d/%m/%Y"), r["home_team"], r["away_team"], r["home_score"], r["away_score"]) for r in got) == want
    assert "Generate" not in plan  # no row carries the whole file's lines
    wide = tmp_path / "E2_2021.csv"
    wide.write_bytes("Date,HomeTeam,AwayTeam,FTHG,FTAG\n01/03/2021,Ł,B,1,0".encode("utf-16"))
    assert [(r["home_team"], r["result"]) for r in readers.club_matches(spark, [str(wide)], "UTF-16").collect()] == [("Ł", 1)]
