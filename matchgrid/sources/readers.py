"""Scans: delimited files, JSON maps and lists, text sections, event payloads, HTML tables.

All paths go to Spark's readers, so any store that Spark can read works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrid.functions import dates, market, nested, text
from matchgrid.sources import fixed, schemas


def csv(spark: SparkSession, paths: str | list[str], schema: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Header CSV; columns by name where a schema is given, extra ones dropped, missing ones null."""
    options = {"header": True, "encoding": encoding, "multiLine": True, "escape": '"'}
    raw = spark.read.options(**options).csv(paths)
    if schema is None:
        return raw
    wanted = spark.createDataFrame([], schema).schema
    have = {c.lower(): c for c in raw.columns}
    return raw.select(*((F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted))


def club_matches(spark: SparkSession, paths: list[str], encoding: str = "ISO-8859-1", missing_ok: bool = True) -> DataFrame:
    """Domestic results of files named ``<league>_<season>.csv``, unreadable rows skipped, in date order.

    Seasons order their columns differently, so the files are read as lines, in one scan
    however many there are, and large ones in parts: a file's first line names its columns,
    and every line is cut by them. A missing file is skipped where ``missing_ok``, one without
    a HomeTeam column always. Fields hold no line breaks. Rows without teams or whole goals
    go, the first lines among them.
    """
    names = [c.split(" ")[0] for c in schemas.DOMESTIC.split(", ")]
    found = _existing(spark, paths) if missing_ok else list(paths)
    if not found:
        return tidy_results(spark.createDataFrame([], schemas.DOMESTIC + ", source_file string"))
    lines = _lines(spark, found, encoding)
    cut = lambda line: F.transform(F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))
    # lines of a file's first part come in order; a row a file is left
    heads = lines.where("start = 0").groupBy("path").agg(F.min_by("line", "place").alias("head"))
    heads = heads.select("path", cut(F.regexp_replace("head", "^(\ufeff|ï»¿)", "")).alias("head")).where(F.array_contains("head", "HomeTeam"))
    rows = lines.join(F.broadcast(heads), "path").select("source_file", "head", cut(F.col("line")).alias("cells"))
    field = lambda n: F.when(F.array_position("head", F.lit(n)) > 0, F.get("cells", F.array_position("head", F.lit(n)).cast("int") - 1))
    return tidy_results(rows.select(*(field(n).alias(n) for n in names), F.regexp_replace(F.col("source_file"), "%20", " ").alias("source_file")))


def _lines(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """(path, source_file, start, place, line) of text files: where a line's part of its file begins, and numbers that grow within a part."""
    place = F.monotonically_increasing_id().alias("place")
    if encoding.upper().startswith(("UTF-16", "UTF-32")):  # a line break is no single byte: files are read whole
        raw = spark.read.format("binaryFile").load(paths).select("path", F.split(F.decode("content", encoding), "\r?\n").alias("lines"))
        each = raw.select("path", F.explode("lines").alias("line"))
        return each.select("path", F.element_at(F.split("path", "/"), -1).alias("source_file"), F.lit(0).alias("start"), place, "line")
    raw = spark.read.option("lineSep", "\n").text(paths)  # the reader keeps a line's bytes as they are
    line = F.regexp_replace(F.decode(F.col("value").cast("binary"), encoding), "\r$", "").alias("line")
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("start"), place, line)


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those that exist, by one listing of each folder they are in."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), []
    folders: dict[str, set[str]] = {}
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        folder = where.getParent()
        if folder.toString() not in folders:
            fs = folder.getFileSystem(conf)
            folders[folder.toString()] = {s.getPath().getName() for s in fs.listStatus(folder)} if fs.exists(folder) else set()
        if where.getName() in folders[folder.toString()]:
            found.append(path)
    return found


def tidy_results(raw: DataFrame) -> DataFrame:
    """Typed results of raw domestic rows with ``source_file``; the total order is date (unknown last), league, home, away."""
    stem = F.regexp_replace("source_file", r"\.csv$", "")
    hg, ag = F.col("FTHG").try_cast("int"), F.col("FTAG").try_cast("int")
    rows = raw.where(hg.isNotNull() & ag.isNotNull() & (F.trim("HomeTeam") != "") & (F.trim("AwayTeam") != ""))
    return rows.select(
        dates.match_date(F.col("Date")).alias("date"),
        F.element_at(F.split(stem, "_"), -1).alias("season_code"),
        F.regexp_replace(stem, "_[^_]*$", "").alias("league"),
        F.trim("HomeTeam").alias("home_team"),
        F.trim("AwayTeam").alias("away_team"),
        hg.alias("home_score"),
        ag.alias("away_score"),
        F.signum(hg - ag).cast("int").alias("result"),
        "source_file",
    ).orderBy(F.col("date").asc_nulls_last(), "league", "home_team", "away_team")


def cached(spark: SparkSession, path: str, build, rebuild: bool = False) -> DataFrame:
    """The Parquet table at ``path``, built and written first where it is absent or ``rebuild``."""
    if rebuild or not _exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def elo_snapshot(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """(team, elo, rank, confederation) of a JSON map, names made canonical, UEFA where none is given."""
    raw = spark.read.schema(schemas.ELO_SNAPSHOT).option("multiLine", True).json(path).select(F.explode("teams").alias("team", "v"))
    return raw.select(text.mapped(F.col("team"), aliases or {}).alias("team"), "v.elo", "v.rank", F.coalesce("v.confederation", F.lit("UEFA")).alias("confederation"))


def elo_at(history: DataFrame, tournament: str, routes: dict[str, int | str] | None = None, snapshot: DataFrame | None = None) -> DataFrame:
    """Ratings before a tournament, best first: of a year of the history, or of a ``snapshot`` (``elo_snapshot``) where its route names no year."""
    route = (routes or fixed.SNAPSHOTS)[tournament]
    if isinstance(route, int):
        rows = history.where(F.col("year") == route).select("team", F.col("rating").alias("elo"), "rank")
    elif snapshot is None:
        raise ValueError(f"{tournament} takes its ratings from a snapshot")
    else:
        rows = snapshot.select("team", "elo", "rank")
    return rows.orderBy(F.desc("elo"), "team")


def schedule(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(group, slot, team) and (match_no, matchday, date, group, home, away, ...) of a nested schedule."""
    raw = spark.read.schema(schemas.SCHEDULE).option("multiLine", True).json(path)
    groups = raw.select(F.explode("groups").alias("grp", "teams")).select("grp", F.posexplode("teams").alias("slot", "team"))
    matches = raw.select(F.posexplode("group_stage_matches").alias("match_no", "m")).select("match_no", "m.matchday", "m.date", F.col("m.group").alias("grp"), "m.home", "m.away", "m.venue", "m.kickoff_et")
    return groups, matches


def stem_lists(spark: SparkSession, glob: str, suffix: str) -> DataFrame:
    """JSON lists of files ``<key><suffix>.json``: the fields with ``key``."""
    rows = spark.read.schema("name string, caps int, goals int, apps int").option("multiLine", True).json(glob).select("*", F.col("_metadata.file_name").alias("f"))
    return rows.select(F.regexp_extract("f", f"^(.*){suffix}\\.json$", 1).alias("key"), "name", "caps", "goals", "apps")


def rosters(spark: SparkSession, path: str) -> DataFrame:
    """(team, slot, player fields) of a JSON map of teams to players."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.ROSTERS).alias("m"))
    return raw.select(F.explode("m").alias("team", "players")).select("team", F.posexplode("players").alias("slot", "p")).select("team", "slot", "p.*")


def odds(raw: DataFrame, tournament: str, aliases: dict[str, str] = fixed.TEAM_ALIASES) -> DataFrame:
    """Unified odds rows of raw rows; those without three readable odds go; one row a pairing, the first by date."""
    o = nested.market_odds(F.col("1x2_market"))
    rows = raw.select(F.trim("home_team").alias("home_team"), F.trim("away_team").alias("away_team"), dates.utc_time(F.col("match_date")).alias("match_date"), o.alias("o"))
    rows = rows.where("o is not null")
    key = lambda c: text.mapped(text.name_key(F.col(c)), aliases)
    p = market.devig(F.col("o.home"), F.col("o.draw"), F.col("o.away"))
    out = rows.select(
        F.lit(tournament).alias("tournament"), "home_team", "away_team", key("home_team").alias("home_key"), key("away_team").alias("away_key"), "match_date",
        F.col("o.home").alias("odds_home"), F.col("o.draw").alias("odds_draw"), F.col("o.away").alias("odds_away"),
        p["p_home"].alias("prob_home"), p["p_draw"].alias("prob_draw"), p["p_away"].alias("prob_away"),
        F.lit("oddsportal").alias("odds_source"), F.col("o.bookmaker").alias("bookmaker"),
    )
    first = W.partitionBy("tournament", "home_key", "away_key").orderBy(F.col("match_date").asc_nulls_last(), "odds_home", "odds_draw", "odds_away")
    return out.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def squad_sections(lines: DataFrame, order: str = "pos", line: str = "line", scope: list[str] | None = None) -> DataFrame:
    """(team, section, entry, club, pos) of a text of ``### team`` heads and ``Position:`` lines.

    Heads are carried forward in order within ``scope`` (a file); manager lines and lines
    outside a team are dropped.
    """
    w = W.partitionBy(*(scope or [])).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    raw = F.trim(line)
    head = F.when(raw.startswith("###"), F.trim(F.regexp_replace(raw, "^#+", "")))
    part = F.when(raw.rlike(r"^\p{L}[\p{L} ]*:"), F.trim(F.regexp_extract(raw, r"^([^:]+):", 1)))
    rows = lines.withColumn("team", F.last(head, ignorenulls=True).over(w)).withColumn("section", part)
    rows = rows.where(F.col("team").isNotNull() & F.col("section").isNotNull() & (F.col("section") != "Manager"))
    each = rows.select(*(scope or []), "team", "section", order, F.posexplode(text.squad_entries(F.regexp_replace(raw, r"^[^:]+:\s*", ""))).alias("slot", "e"))
    return each.where("e <> ''").select(*(scope or []), "team", "section", order, "slot", text.entry_name(F.col("e")).alias("name"), text.entry_club(F.col("e")).alias("club"))


def text_lines(spark: SparkSession, path: str, encoding: str = "UTF-16LE") -> DataFrame:
    """(file, pos, line) of whole text files in any charset."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.regexp_replace(F.decode("content", encoding), "^﻿", "").alias("t"))
    return raw.select("file", F.posexplode(F.split("t", r"\r?\n")).alias("pos", "line"))


def starting_players(events: DataFrame) -> DataFrame:
    """(match_id, team, player) of "Starting XI" events' nested line-ups."""
    each = events.where("type = 'Starting XI'").select("match_id", "team", F.explode("tactics.lineup.player.name").alias("player"))
    return each.where("player is not null").distinct()


def lineup_players(lineups: DataFrame) -> DataFrame:
    """Different players of each match: name, else nickname."""
    return lineups.select("match_id", "team", F.coalesce("player_name", "player_nickname").alias("player")).where("player is not null").distinct()


def concat_unique(frames: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Union by name, then one row a key, the first in ``order``."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


__all__ = ["cached", "club_matches", "concat_unique", "csv", "elo_at", "elo_snapshot", "lineup_players", "odds", "rosters", "schedule", "squad_sections", "starting_players", "stem_lists", "text_lines", "tidy_results"]


def matches_of(matches: DataFrame, team: str, home: str = "home_team", away: str = "away_team") -> DataFrame:
    """Matches in which a team plays at home or away."""
    return matches.where((F.col(home) == team) | (F.col(away) == team))


def slice_schedule(matches: DataFrame, matchday: int | None = None, group: str | None = None) -> DataFrame:
    """A schedule's matches of a matchday, of a group (in either case), or of both."""
    if matchday is not None:
        matches = matches.where(F.col("matchday") == matchday)
    return matches if group is None else matches.where(F.col("grp") == group.upper())


def teams_of(matches: DataFrame, home: str = "home_team", away: str = "away_team") -> DataFrame:
    """(team): every side of the matches once."""
    return matches.select(F.col(home).alias("team")).union(matches.select(F.col(away).alias("team"))).where("team is not null").distinct()


def known_teams(matches: DataFrame, profiles: DataFrame, team: str = "team") -> DataFrame:
    """(team): sides of the matches that have a profile."""
    return teams_of(matches).intersect(profiles.select(F.col(team).alias("team")))
