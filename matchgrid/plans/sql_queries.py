"""Queries written as SQL text over registered functions, and queries of names in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrid.functions import sql
from matchgrid.operators import builders, resolve
from matchgrid.plans.base import MATCHES_SQL, ratings, read
from matchgrid.plans.more_queries import Q53
from matchgrid.plans.profile_queries import Q36, SEASON_SQL, _seasons


def q91_register(spark, sf):
    """The first two words of every document as names, registered in the order of their documents against an empty roster; how many joined each."""
    words = F.slice(F.regexp_extract_all("text", F.lit("\\p{L}+"), F.lit(0)), 1, 2)
    names = read(spark, sf, "documents").select(F.array_join(words, " ").alias("target"), F.col("doc_id").alias("seq"))
    roster = spark.createDataFrame([], "name string, entity_id string, pos int")
    found = resolve.register(names, roster)
    return found.groupBy("entity_id").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.min_by("target", "seq").alias("name"))


def q92_sql_roster(spark, sf):
    sql.register(spark)
    text = "concat(p_name, ':', CAST(p_size * 2 AS STRING), ', x:', p_name, ':45,, no minutes')"
    return spark.sql(f"SELECT p_partkey, r.slot, r.name, r.minutes, r.starter FROM {{part}}, LATERAL roster_entries({text}) r", part=read(spark, sf, "part"))


def q93_sql_names(spark, sf):
    """Names in ASCII and their likeness to a spelling with the words turned round, from SQL text."""
    sql.register(spark)
    return spark.sql(
        "SELECT p_partkey, ascii_name(concat('É', p_name, ' Łø')) AS ascii, token_set_ratio(p_name, array_join(reverse(split(p_name, ' ')), ' ')) AS turned, token_set_ratio(p_name, '') AS none FROM {part}",
        part=read(spark, sf, "part"),
    )


Q93 = "SELECT p_partkey, 'E' || p_name || ' Lo' AS ascii, CAST(100 AS INTEGER) AS turned, CAST(0 AS INTEGER) AS none FROM part"


def q94_sql_tables(spark, sf):
    """Rows of HTML tables made of each part, through the table function."""
    sql.register(spark)
    page = "concat('<p>x<table><tr><th>Player</th><th>Goals</th></tr><tr><td>', p_name, '</td><td> ', CAST(p_size AS STRING), '</td></tr></table>')"
    return spark.sql(f"SELECT p_partkey, t.table_no, t.row_no, t.cells[0] AS first, t.cells[1] AS second, t.header[1] AS header FROM {{part}}, LATERAL html_tables({page}) t", part=read(spark, sf, "part"))


Q94 = """SELECT p_partkey, CAST(0 AS INTEGER) AS table_no, CAST(0 AS INTEGER) AS row_no, 'Player' AS first, 'Goals' AS second, 'Goals' AS header FROM part
UNION ALL SELECT p_partkey, 0, 1, p_name, CAST(p_size AS VARCHAR), 'Goals' FROM part"""


def q95_first_links(spark, sf):
    """Each page's links in the order of their first occurrence, repeats dropped."""
    from matchgrid.functions import text

    p = read(spark, sf, "pages")
    return p.select("page_id", F.posexplode(text.distinct_in_order(text.links(F.col("html")))).alias("place", "link"))


Q95 = """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href=["'']([^"'']*)["'']', 1) AS a FROM pages), e AS (SELECT page_id, unnest(a) AS link, unnest(range(len(a))) AS pos FROM l),
f AS (SELECT page_id, link, min(pos) AS pos FROM e GROUP BY 1, 2)
SELECT page_id, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS place FROM f"""

def _line_ups(spark, sf):
    """(line-ups, roster): customers under names of hexadecimal words; every seventh is listed again, its words turned round, as a guest, whom nobody knows beside."""
    h = F.md5(F.col("c_custkey").cast("string").cast("binary"))
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("c_custkey").alias("pid"), F.col("n_name").alias("team"), F.substring(h, 1, 8).alias("a"), F.substring(h, 9, 8).alias("b"))
    roster = c.select(F.concat_ws(" ", "a", "b").alias("name"), F.col("pid").cast("string").alias("entity_id"), F.col("pid").alias("pos"))
    own = c.select(F.concat_ws(" ", "a", "b").alias("player_name"), "team", F.col("pid").alias("seq"))
    again = c.where("pid % 7 = 0").select(F.concat_ws(" ", "b", "a").alias("player_name"), F.lit("Guest").alias("team"), (F.col("pid") + 10**9).alias("seq"))
    lone = c.agg(F.lit("Zzyzx Qwop").alias("player_name"), F.lit("Nobody").alias("team"), (F.max("pid") + 2 * 10**9).alias("seq"))
    return own.union(again).union(lone), roster


def q101_ids_to_teams(spark, sf):
    found = resolve.ids_to_teams(*_line_ups(spark, sf))
    return found.select(F.col("entity_id").cast("bigint").alias("pid"), "team")


Q101 = "SELECT c_custkey AS pid, CASE WHEN c_custkey % 7 = 0 THEN 'Guest' ELSE n_name END AS team FROM customer JOIN nation ON c_nationkey = n_nationkey"


def q102_line_up_matrix(spark, sf):
    """The team matrix on line-ups resolved to ids."""
    from pyspark.sql import Window as W

    stats = _seasons(spark, sf).select(F.col("pid").cast("string").alias("pid"), "season", "goals", (F.col("goals") % 11).alias("assists"), (F.col("goals") % 1000).alias("minutes_played"))
    weights = spark.createDataFrame([(1999, 0.3), (2000, 0.5), (2001, 1.0)], "season int, weight double")
    rank = F.row_number().over(W.orderBy(F.desc("elo"), "team")).cast("int")  # teams are a table of fixed size
    rating = ratings(spark, sf).withColumn("rank", rank).withColumn("confederation", F.when(F.col("rank") % 2 == 0, "CAF"))
    out = builders.tournament_from_line_ups(*_line_ups(spark, sf), rating, stats, weights)
    shown = ("lg_goals", "lg_assists", "lg_minutes_played", "lg_goals_trend", "lg_goals_cv", "lg_latest_goals_p90")
    return out.select("team", F.round("elo", 4).alias("elo"), "rank", "conf_caf", "conf_uefa", "lg_seasons_available", "lg_goals_max", *(F.round(c, 4).alias(c) for c in shown), "lg_latest_players")


_SE = SEASON_SQL.replace(", st AS (", ", so AS (SELECT CASE WHEN pid % 7 = 0 THEN 'Guest' ELSE team END AS team, season, goals FROM se), st AS (")
Q102 = f"""{Q53.replace(SEASON_SQL, MATCHES_SQL + ', ' + _SE).replace('FROM se GROUP BY', 'FROM so GROUP BY').rsplit('SELECT * FROM a', 1)[0]},
rk AS (SELECT *, CAST(row_number() OVER (ORDER BY elo DESC, team) AS INTEGER) AS rank FROM rating), tm AS (SELECT n_name AS team FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) UNION SELECT 'Guest' WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey % 7 = 0) UNION SELECT 'Nobody')
SELECT team, round(coalesce(elo, 1500), 4) AS elo, rank, CAST(coalesce(rank % 2 = 0, false) AS DOUBLE) AS conf_caf, CAST(0 AS DOUBLE) AS conf_uefa, a.* EXCLUDE (team), b.* EXCLUDE (team) FROM tm LEFT JOIN rk USING (team) LEFT JOIN a USING (team) LEFT JOIN b USING (team)"""

QUERIES = {
    "q101_ids_to_teams": (q101_ids_to_teams, Q101), "q102_line_up_matrix": (q102_line_up_matrix, Q102),
    "q91_register": (q91_register, None), "q92_sql_roster": (q92_sql_roster, Q36), "q93_sql_names": (q93_sql_names, Q93), "q94_sql_tables": (q94_sql_tables, Q94), "q95_first_links": (q95_first_links, Q95),
}
