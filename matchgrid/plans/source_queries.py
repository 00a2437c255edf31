"""Queries that write the given tables as files of every kind the engine reads, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.functions import nested, text
from matchgrid.plans.base import MATCHES_SQL, POSITION, matchup, r6, ratings, read
from matchgrid.sources import readers, writers
from matchgrid.sources.stored import new_folder


def _files(rows: DataFrame, order: list, tag: str, encoding: str = "UTF-8", suffix: str = "") -> list[str]:
    """Text files of ``rows(file, line, ...)``, one a value of file, lines in order; their paths."""
    spark = rows.sparkSession
    folder = new_folder(spark, tag)
    sorted_ = rows.repartition("file").sortWithinPartitions("file", *order).select("file", F.col("line").alias("value"))
    plain = {"sep": "\u0001", "quote": "", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    sorted_.write.partitionBy("file").options(encoding=encoding, **plain).csv(folder)  # the text writer knows UTF-8 only
    jvm, found = spark._jvm, []
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for part in fs.listStatus(top):
        if part.isDirectory():
            name = part.getPath().getName().removeprefix("file=")
            (written,) = [s.getPath() for s in fs.listStatus(part.getPath()) if s.getPath().getName().startswith("part-")]
            path = f"{folder}/{name}{suffix}"
            fs.rename(written, jvm.org.apache.hadoop.fs.Path(path))
            found.append(path)
    return sorted(found)


def q96_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as CSV with quotes, commas and line breaks in a field, read by a schema of other columns in another order."""
    o = read(spark, sf, "orders")
    path = new_folder(spark, "csv")
    writers.write_csv(o.select("o_totalprice", "o_orderkey", F.concat(F.lit('a "quote", and\nmore '), F.col("o_custkey").cast("string")).alias("note"), F.lit("x").alias("extra"), F.when(F.col("o_orderkey") % 3 == 0, "bad").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey")), path)
    back = readers.csv(spark, path, "o_orderkey bigint, o_custkey bigint, o_totalprice double, note string, missing int")
    return back.select("o_orderkey", "o_custkey", r6("o_totalprice"), "note", "missing")


Q96 = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS o_custkey, round(CAST(o_totalprice AS DOUBLE), 6) AS o_totalprice, 'a "quote", and' || chr(10) || 'more ' || o_custkey AS note, CAST(NULL AS INTEGER) AS missing FROM orders"""


def q97_result_files(spark, sf):
    """Every match in result files by league and season, some rows without goals, columns in two orders, one file without a HomeTeam column, one absent."""
    m = matchup(spark, sf).withColumn("y", F.year("d")).withColumn("turned", F.col("y") % 2 == 0)
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    m = m.withColumn("file", F.concat(F.lit("Liga "), F.col("grp").cast("string"), F.lit("_"), two(F.col("y")), two(F.col("y") + 1)))
    goals = F.when(F.col("k") % 11 == 0, "").otherwise(F.col("hg").cast("string"))
    day = F.date_format("d", "dd/MM/yyyy")
    line = F.when(F.col("turned"), F.concat_ws(",", F.concat(F.lit('"'), "home", F.lit('"')), goals, F.col("ag").cast("string"), F.lit("Ref, x").substr(1, 3), "away", day)).otherwise(F.concat_ws(",", day, "home", "away", goals, F.col("ag").cast("string"), F.lit("H")))
    rows = m.select("file", F.lit(1).alias("after"), line.alias("line"))
    head = F.when(F.col("turned"), "HomeTeam,FTHG,FTAG,Referee,AwayTeam,Date").otherwise("Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR")
    heads = m.select("file", "turned").distinct().select("file", F.lit(0).alias("after"), head.alias("line"))
    other = read(spark, sf, "nation").select(F.lit("Other_0001").alias("file"), F.lit(1).alias("after"), F.concat_ws(",", F.lit("01/01/2000"), "n_name").alias("line"))
    paths = _files(rows.union(heads).union(other), ["after"], "results", "ISO-8859-1", ".csv")
    out = readers.club_matches(spark, [*paths, paths[0].replace(".csv", "-absent.csv")])
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("day"), "season_code", "league", "home_team", "away_team", "home_score", "away_score", "result", "source_file")


_CODE = "lpad(CAST(year(d) % 100 AS VARCHAR), 2, '0') || lpad(CAST((year(d) + 1) % 100 AS VARCHAR), 2, '0')"
Q97 = f"""WITH {MATCHES_SQL} SELECT strftime(d, '%Y-%m-%d') AS day, {_CODE} AS season_code, 'Liga ' || grp AS league, home AS home_team, away AS away_team, CAST(hg AS INTEGER) AS home_score, CAST(ag AS INTEGER) AS away_score,
CAST(sign(hg - ag) AS INTEGER) AS result, 'Liga ' || grp || '_' || {_CODE} || '.csv' AS source_file FROM matchup WHERE k % 11 <> 0"""


def q98_rating_snapshot(spark, sf):
    """Ratings as a JSON map of teams, made once and kept, read as a tournament's snapshot; every third team without a confederation."""
    from pyspark.sql import Window as W

    r = ratings(spark, sf).withColumn("rank", F.row_number().over(W.orderBy(F.desc("elo"), "team")).cast("int"))  # teams are a table of fixed size
    kept = readers.cached(spark, new_folder(spark, "ratings"), lambda: r)
    conf = F.when(F.col("rank") % 3 != 0, "CAF")
    one = kept.agg(F.map_from_entries(F.collect_list(F.struct("team", F.struct("elo", "rank", conf.alias("confederation"))))).alias("teams"))
    path = new_folder(spark, "snapshot")
    writers.write_text(one, F.to_json(F.struct("teams")), path)
    snapshot = readers.elo_snapshot(spark, path, {"NATION_3": "Third"})
    return readers.elo_at(ratings(spark, sf), "wc2026", snapshot=snapshot).join(snapshot.select("team", "confederation"), "team").select("team", r6("elo"), "rank", "confederation")


Q98 = f"""WITH {MATCHES_SQL}, k AS (SELECT *, CAST(row_number() OVER (ORDER BY elo DESC, team) AS INTEGER) AS rank FROM rating)
SELECT CASE team WHEN 'NATION_3' THEN 'Third' ELSE team END AS team, round(elo, 6) AS elo, rank, CASE WHEN rank % 3 = 0 THEN 'UEFA' ELSE 'CAF' END AS confederation FROM k"""


def q99_squad_text(spark, sf):
    """Customers as squads in a text of sections, a file a region, in UTF-16, with managers and lines outside teams."""
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    part = F.trim(F.split(F.expr(POSITION), ",")[0])
    entry = F.concat("c_name", F.lit(" (Club "), (F.col("c_custkey") % 40).cast("string"), F.when(F.col("c_custkey") % 5 == 0, ")").otherwise(", on loan)"))
    # a line has at most 20 entries
    lines = c.groupBy(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("file"), F.col("n_name").alias("team"), part.alias("p"), F.floor(F.col("c_custkey") / 20).alias("line_no")).agg(F.sort_array(F.collect_list(entry)).alias("es"))
    lines = lines.select("file", "team", F.lit(1).alias("after"), F.concat("p", F.lit(": "), F.array_join("es", ", ")).alias("line"))
    teams = c.select(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("file"), F.col("n_name").alias("team")).distinct()
    heads = teams.select("file", "team", F.lit(0).alias("after"), F.concat(F.lit(" ### "), "team").alias("line"))
    bosses = teams.select("file", "team", F.lit(2).alias("after"), F.lit("Manager: Some One (Club 1)").alias("line"))
    loose = teams.select("file").distinct().select("file", F.lit("").alias("team"), F.lit(0).alias("after"), F.lit("GK: Before Any (Team)").alias("line"))
    paths = _files(lines.union(heads).union(bosses).union(loose), ["team", "after"], "squads", "UTF-16LE", ".txt")
    found = readers.text_lines(spark, paths[0].rsplit("/", 1)[0] + "/*.txt")
    return readers.squad_sections(found, scope=["file"]).select("team", "section", "name", "club")


Q99 = f"""SELECT n_name AS team, trim(split_part({POSITION}, ',', 1)) AS section, c_name AS name, 'Club ' || (c_custkey % 40) AS club FROM customer JOIN nation ON c_nationkey = n_nationkey"""

def q103_line_up_players(spark, sf):
    """Players of nested line-ups: those that start by the events, and all by name or nickname."""
    e = read(spark, sf, "events")
    match = F.concat(F.lit("m"), (F.col("event_id") % 50).cast("string"))
    name = lambda k: F.concat(F.lit("p"), ((F.col("user_id") * k) % 97).cast("string"))
    players = F.array(*(F.struct(F.struct(F.lit(k).cast("long").alias("id"), F.when(F.col("event_id") % k != 0, name(k)).alias("name")).alias("player")) for k in (1, 3, 7)))
    feed = e.select(match.alias("match_id"), F.lit("A").alias("team"), F.when(F.col("event_id") % 4 == 0, "Starting XI").otherwise("Pass").alias("type"), F.struct(players.alias("lineup")).alias("tactics"))
    listed = e.select(match.alias("match_id"), F.lit("A").alias("team"), F.when(F.col("event_id") % 3 != 0, name(1)).alias("player_name"), F.when(F.col("event_id") % 5 != 0, name(5)).alias("player_nickname"))
    return readers.starting_players(feed).withColumn("starts", F.lit(True)).union(readers.lineup_players(listed).withColumn("starts", F.lit(False)))


_NAME = "'p' || ((user_id * {0}) % 97)"
Q103 = f"""WITH e AS (SELECT *, 'm' || (event_id % 50) AS match_id FROM events)
SELECT DISTINCT match_id, 'A' AS team, player, true AS starts FROM ({' UNION ALL '.join(f"SELECT match_id, {_NAME.format(k)} AS player FROM e WHERE event_id % 4 = 0 AND event_id % {k} <> 0" for k in (1, 3, 7))})
UNION ALL SELECT DISTINCT match_id, 'A', player, false FROM (SELECT match_id, CASE WHEN event_id % 3 <> 0 THEN {_NAME.format(1)} WHEN event_id % 5 <> 0 THEN {_NAME.format(5)} END AS player FROM e) WHERE player IS NOT NULL"""


def q104_schedule(spark, sf):
    """A schedule of every region as a group, written as one nested JSON document and read as slots and matches."""
    n = read(spark, sf, "nation")
    groups = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("ts"))  # nations are a table of fixed size
    pair = n.alias("h").join(n.alias("a"), (F.col("h.n_regionkey") == F.col("a.n_regionkey")) & (F.col("h.n_name") < F.col("a.n_name")))
    match = F.struct(F.col("h.n_nationkey").cast("int").alias("matchday"), F.lit("2026-06-11").alias("date"), F.col("h.n_regionkey").cast("string").alias("group"), F.col("h.n_name").alias("home"), F.col("a.n_name").alias("away"))
    one = groups.agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_regionkey").cast("string"), "ts"))).alias("groups")).crossJoin(pair.agg(F.sort_array(F.collect_list(match)).alias("group_stage_matches")))
    path = new_folder(spark, "schedule")
    writers.write_json(one, path)
    slots, matches = readers.schedule(spark, path)
    met = matches.join(slots.select("grp", F.col("team").alias("home"), F.col("slot").alias("home_slot")), ["grp", "home"])
    return readers.slice_schedule(met, group="1").union(readers.slice_schedule(met, matchday=0)).select("grp", "home", "away", "matchday", "date", "home_slot")


Q104 = """WITH s AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS slot FROM nation),
m AS (SELECT CAST(h.n_regionkey AS VARCHAR) AS grp, h.n_name AS home, a.n_name AS away, CAST(h.n_nationkey AS INTEGER) AS matchday, '2026-06-11' AS date, CAST(h.slot AS INTEGER) AS home_slot FROM s h JOIN s a ON h.n_regionkey = a.n_regionkey AND h.n_name < a.n_name)
SELECT * FROM m WHERE grp = '1' UNION ALL SELECT * FROM m WHERE matchday = 0"""


def q105_exports(spark, sf):
    """Customers with a column they lack, exported as JSON and as lines of text, a delta looked at and then appended, and all read back."""
    c = read(spark, sf, "customer").select("c_custkey", "c_name")
    full = writers.evolve(c, {"c_name": "string", "tier": "int"})
    json_, text_, table = (new_folder(spark, x) for x in ("json", "text", "table"))
    writers.write_json(full, json_)
    writers.write_text(full, F.concat_ws(";", "c_custkey", F.coalesce(F.col("tier").cast("string"), F.lit("-"))), text_)
    writers.apply(writers.apply(full.where("c_custkey % 2 = 0"), table, dry_run=True), table)
    cells = F.split("value", ";")
    lines = spark.read.text(text_).select(cells[0].cast("bigint").alias("c_custkey"), cells[1].alias("mark"))
    back = spark.read.schema("c_custkey bigint, c_name string, tier int").json(json_)
    kept = spark.read.parquet(table).select("c_custkey", F.lit(True).alias("kept"))
    return back.join(lines, "c_custkey").join(kept, "c_custkey", "left").select("c_custkey", "c_name", "tier", "mark", F.coalesce("kept", F.lit(False)).alias("kept"))


Q105 = "SELECT c_custkey, c_name, CAST(NULL AS INTEGER) AS tier, '-' AS mark, c_custkey % 2 = 0 AS kept FROM customer"

def q106_lookups(spark, sf):
    """Classes by a small map with a default, ratings by a map with a default, and the first of the columns there are."""
    c = read(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("a"), F.when(F.col("c_custkey") % 2 == 0, "second").alias("b"))
    known = F.create_map(*(x for i in range(0, 50, 5) for x in (F.lit(i).cast("long"), F.lit(1600.0 + i))))
    return c.select(
        "c_custkey", text.mapped(F.col("c_mktsegment"), {"BUILDING": "CAF", "MACHINERY": "AFC"}, F.lit("UEFA")).alias("confederation"),
        nested.lookup(known, F.col("c_custkey") % 60, 1500.0).alias("elo"), nested.first_present(c, ["missing", "a", "b"]).alias("first"), nested.first_present(c, ["missing"]).cast("string").alias("none"),
    )


Q106 = """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'CAF' WHEN 'MACHINERY' THEN 'AFC' ELSE 'UEFA' END AS confederation,
CASE WHEN c_custkey % 60 < 50 AND c_custkey % 5 = 0 THEN 1600.0 + c_custkey % 60 ELSE 1500.0 END::DOUBLE AS elo, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 2 = 0 THEN 'second' END AS first, CAST(NULL AS VARCHAR) AS none FROM customer"""

QUERIES = {
    "q106_lookups": (q106_lookups, Q106),
    "q103_line_up_players": (q103_line_up_players, Q103), "q104_schedule": (q104_schedule, Q104), "q105_exports": (q105_exports, Q105),
    "q96_csv_scan": (q96_csv_scan, Q96), "q97_result_files": (q97_result_files, Q97), "q98_rating_snapshot": (q98_rating_snapshot, Q98), "q99_squad_text": (q99_squad_text, Q99),
}
