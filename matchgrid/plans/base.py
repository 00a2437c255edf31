"""The derived match tables that the queries run on, in both dialects.

Nations are teams, regions groups, customers players, market segments positions,
suppliers clubs, order years seasons and line items of two nations of a region matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSITION = "CASE c_mktsegment WHEN 'MACHINERY' THEN 'GK' WHEN 'BUILDING' THEN 'DF' WHEN 'AUTOMOBILE' THEN 'MF' WHEN 'FURNITURE' THEN 'FW' ELSE 'FW, MF' END"

MATCHES_SQL = """matchup AS (
  SELECT o_orderdate AS d, l_orderkey * 10 + l_linenumber AS k, l_partkey AS pk, l_suppkey AS sk, l_extendedprice AS xp,
    l_discount AS disc, l_tax AS tax, hn.n_regionkey AS grp, hn.n_name AS home, an.n_name AS away,
    CAST(floor(l_quantity) AS BIGINT) % 5 AS hg, CAST(floor(l_extendedprice) AS BIGINT) % 4 AS ag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation hn ON c_nationkey = hn.n_nationkey JOIN nation an ON s_nationkey = an.n_nationkey
  WHERE c_nationkey <> s_nationkey AND hn.n_regionkey = an.n_regionkey),
rating AS (
  SELECT n_name AS team, CAST(1400 + sum(CAST(floor(c_acctbal) AS BIGINT)) % 400 AS DOUBLE) AS elo
  FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name),
game AS (
  SELECT m.*, h.elo AS eh, a.elo AS ea, CASE WHEN hg > ag THEN 1 WHEN hg = ag THEN 0 ELSE -1 END AS result
  FROM matchup m JOIN rating h ON m.home = h.team JOIN rating a ON m.away = a.team)"""

#: Predictions of each game: Elo outcome probabilities with the home advantage.
PRED_SQL = (
    MATCHES_SQL
    + """,
e AS (SELECT *, 1.0 / (1.0 + pow(10.0, -(eh + 60.0 - ea) / 400.0)) AS pe, least(greatest(0.26 * (0.55 + 0.45 * exp(-abs(eh + 60.0 - ea) / 150.0)), 0.08), 0.38) AS pd0 FROM game),
pred AS (SELECT *, (1 - pd0) * pe AS p_home, pd0 AS p_draw, (1 - pd0) * (1 - pe) AS p_away FROM e),
f AS (
  SELECT *, CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 1 WHEN p_draw >= p_away THEN 0 ELSE -1 END AS pick,
    greatest(p_home, p_draw, p_away) AS max_prob,
    p_home + p_draw + p_away - greatest(p_home, p_draw, p_away) - least(p_home, p_draw, p_away) AS mid
  FROM pred),
pf AS (
  SELECT *, pick = result AS correct, max_prob - mid AS prob_margin,
    -(p_home * ln(p_home) + p_draw * ln(p_draw) + p_away * ln(p_away)) / ln(3) AS norm_entropy,
    CASE WHEN pick = result THEN 0.95 / greatest(max_prob, 0.02) - 1 ELSE -1 END AS pnl,
    CASE WHEN pe > 0.45 THEN 1 WHEN pe < 0.35 THEN -1 ELSE 0 END AS elo_pick,
    abs(eh - ea) AS elo_gap, CASE WHEN eh >= ea THEN 1 ELSE -1 END AS favorite
  FROM f)"""
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matchup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose customer and supplier are of two nations of one region: small sides are left to the optimiser.

    Orders meet customers before line items meet either, so line items are shuffled by order alone (and by
    supplier, where suppliers are many); nations come last, as only their keys need to travel.
    """
    t = lambda n: read(spark, sf_dir, n)
    nation = lambda key, name, region: t("nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name), F.col("n_regionkey").alias(region))
    home = t("customer").select("c_custkey", "c_nationkey")
    away = t("supplier").select("s_suppkey", "s_nationkey")
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(home, F.col("o_custkey") == F.col("c_custkey"))
    lines = t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(away, F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    lines = lines.join(nation("c_nationkey", "home", "grp"), "c_nationkey").join(nation("s_nationkey", "away", "a_grp"), "s_nationkey")
    goals = lambda c, m: (F.floor(c) % m).cast("bigint")
    return lines.where("grp = a_grp").select(
        F.col("o_orderdate").alias("d"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        F.col("l_extendedprice").alias("xp"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), "grp", "home", "away",
        goals("l_quantity", 5).alias("hg"), goals("l_extendedprice", 4).alias("ag"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal")
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("team"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("team").agg((1400 + F.sum(F.floor("c_acctbal").cast("bigint")) % 400).cast("double").alias("elo"))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with eh, ea (ratings) and result. Teams are nations, a table of fixed size; the optimiser knows only that of the customers behind it."""
    r = ratings(spark, sf_dir)
    side = lambda t, e: F.broadcast(r.select(F.col("team").alias(t), F.col("elo").alias(e)))
    m = matchup(spark, sf_dir).join(side("home", "eh"), "home").join(side("away", "ea"), "away")
    return m.withColumn("result", F.signum(F.col("hg") - F.col("ag")).cast("int"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games with Elo outcome probabilities, and all that the backtests ask."""
    from matchgrid.functions import market
    from matchgrid.operators import backtest

    g = games(spark, sf_dir)
    p = market.outcome_probabilities(F.col("eh"), F.col("ea"))
    out = backtest.frame(g.withColumns(p))
    gap = F.col("eh") - F.col("ea")
    return out.withColumns({"elo_pick": market.elo_pick(F.col("eh"), F.col("ea")), "elo_gap": F.abs(gap), "favorite": F.when(gap >= 0, 1).otherwise(-1)})


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)
