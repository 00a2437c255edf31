"""Queries of probabilities, odds, upsets and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrid.functions import market, nested
from matchgrid.operators import backtest, dataset, ratings, simulate
from matchgrid.plans.base import MATCHES_SQL, PRED_SQL, games, matchup, predictions, r6, read
from matchgrid.plans.base import ratings as team_ratings


def _with(rest: str) -> str:
    """``rest`` after the predictions' common tables."""
    return f"WITH {PRED_SQL}{rest if rest.lstrip().startswith(',') else chr(10) + rest}"


def q01_standings(spark, sf):
    t = simulate.standings(matchup(spark, sf))
    return t.select("grp", "team", "played", "won", "drawn", "lost", "gf", "ga", "gd", "points", "rank")


Q01 = f"""WITH {MATCHES_SQL},
s AS (SELECT grp, home AS team, hg AS gf, ag AS ga FROM matchup UNION ALL SELECT grp, away, ag, hg FROM matchup),
t AS (SELECT grp, team, count(*) AS played, count(*) FILTER (gf > ga) AS won, count(*) FILTER (gf = ga) AS drawn, count(*) FILTER (gf < ga) AS lost,
  CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, CAST(sum(gf) - sum(ga) AS BIGINT) AS gd, CAST(3 * count(*) FILTER (gf > ga) + count(*) FILTER (gf = ga) AS BIGINT) AS points FROM s GROUP BY grp, team)
SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY points DESC, gd DESC, gf DESC, team) AS INTEGER) AS rank FROM t"""

PAIRS_SQL = "pairs AS (SELECT a.team AS home, b.team AS away, a.elo AS eh, b.elo AS ea FROM rating a JOIN rating b ON a.team <> b.team)"


def _pairs(spark, sf):
    """All pairings of the nations, from one pass over the ratings: teams are a table of fixed size, one row here."""
    one = team_ratings(spark, sf).agg(F.collect_list(F.struct("team", "elo")).alias("t"))
    each = one.select("t", F.explode("t").alias("h")).select("h", F.explode("t").alias("a")).where("h.team <> a.team")
    return each.select(F.col("h.team").alias("home"), F.col("h.elo").alias("eh"), F.col("a.team").alias("away"), F.col("a.elo").alias("ea"))


def q02_elo_1x2(spark, sf):
    p = market.outcome_probabilities(F.col("eh"), F.col("ea"))
    out = _pairs(spark, sf).withColumns(p).withColumn("p_win", market.win_probability(F.col("eh"), F.col("ea"))).withColumn("pick", market.elo_pick(F.col("eh"), F.col("ea")))
    return out.select("home", "away", r6("p_home"), r6("p_draw"), r6("p_away"), r6("p_win"), "pick")


Q02 = f"""WITH {MATCHES_SQL}, {PAIRS_SQL},
e AS (SELECT *, 1.0 / (1.0 + pow(10.0, -(eh + 60.0 - ea) / 400.0)) AS p, least(greatest(0.26 * (0.55 + 0.45 * exp(-abs(eh + 60.0 - ea) / 150.0)), 0.08), 0.38) AS d FROM pairs)
SELECT home, away, round((1 - d) * p, 6) AS p_home, round(d, 6) AS p_draw, round((1 - d) * (1 - p), 6) AS p_away, round(p, 6) AS p_win,
  CASE WHEN p > 0.45 THEN 1 WHEN p < 0.35 THEN -1 ELSE 0 END AS pick FROM e"""


def q03_expected_goals(spark, sf):
    x = market.expected_goals(F.col("eh"), F.col("ea"))
    out = _pairs(spark, sf).withColumns(x)
    return out.select("home", "away", r6("xg_home"), r6("xg_away"), F.bround("xg_home").cast("int").alias("goals_home"), F.bround("xg_away").cast("int").alias("goals_away"))


XG_SQL = "x AS (SELECT *, greatest(2.55 / (1.0 + pow(10.0, -(eh + 60.0 - ea) / 400.0)), 0.15) AS xh, greatest(2.55 * (1 - 1.0 / (1.0 + pow(10.0, -(eh + 60.0 - ea) / 400.0))), 0.15) AS xa FROM pairs)"
Q03 = f"""WITH {MATCHES_SQL}, {PAIRS_SQL}, {XG_SQL}
SELECT home, away, round(xh, 6) AS xg_home, round(xa, 6) AS xg_away, CAST(round_even(xh, 0) AS INTEGER) AS goals_home, CAST(round_even(xa, 0) AS INTEGER) AS goals_away FROM x"""


def _matrix(spark, sf):
    out = _pairs(spark, sf).withColumns(market.expected_goals(F.col("eh"), F.col("ea")))
    return market.score_matrix(out.select("home", "away", "xg_home", "xg_away"), "xg_home", "xg_away")


def q04_poisson_matrix(spark, sf):
    out = _matrix(spark, sf).groupBy("home", "away").agg(*market.outcome_sums(), *market.over_under(2.5))
    return out.select("home", "away", *(r6(c) for c in ("p_home", "p_draw", "p_away", "p_over", "p_under")))


MATRIX_SQL = XG_SQL + """,
g AS (SELECT CAST(range AS INTEGER) AS n FROM range(9)),
raw AS (SELECT home, away, i.n AS i, j.n AS j, exp(-xh) * pow(xh, i.n) / factorial(i.n) * (exp(-xa) * pow(xa, j.n) / factorial(j.n)) AS q FROM x, g i, g j),
matrix AS (SELECT home, away, i, j, q / sum(q) OVER (PARTITION BY home, away) AS p FROM raw)"""
Q04 = f"""WITH {MATCHES_SQL}, {PAIRS_SQL}, {MATRIX_SQL}
SELECT home, away, round(sum(p) FILTER (i > j), 6) AS p_home, round(sum(p) FILTER (i = j), 6) AS p_draw, round(sum(p) FILTER (i < j), 6) AS p_away,
  round(sum(p) FILTER (i + j > 2.5) / sum(p), 6) AS p_over, round(sum(p) FILTER (i + j < 2.5) / sum(p), 6) AS p_under FROM matrix GROUP BY home, away"""


def q05_top_scorelines(spark, sf):
    return market.top_scores(_matrix(spark, sf), ["home", "away"], 3).select("home", "away", "i", "j", r6("p"), F.col("rank").cast("int").alias("rank"))


Q05 = f"""WITH {MATCHES_SQL}, {PAIRS_SQL}, {MATRIX_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY home, away ORDER BY p DESC, i DESC, j DESC) AS rank FROM matrix)
SELECT home, away, i, j, round(p, 6) AS p, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""


def q06_devig_blend(spark, sf):
    g = games(spark, sf)
    odds = {"oh": 1.2 + F.col("disc") * 20, "od": F.lit(3.2), "oa": 1.5 + F.col("tax") * 30}
    g = g.withColumns(odds)
    q = market.devig(F.col("oh"), F.col("od"), F.col("oa"))
    p = market.outcome_probabilities(F.col("eh"), F.col("ea"))
    b = market.blend(tuple(p.values()), tuple(q.values()), F.lit(0.7))
    return g.select("k", "pk", "sk", "xp", F.round(q["p_home"], 6).alias("q_home"), F.round(q["p_away"], 6).alias("q_away"), F.round(b[0], 6).alias("b_home"), F.round(b[1], 6).alias("b_draw"),
                    F.round(market.fair_odds(b[0]), 6).alias("fair_home"))


Q06 = _with(""",
o AS (SELECT *, 1 / (1.2 + disc * 20) AS a, 1 / 3.2 AS b, 1 / (1.5 + tax * 30) AS c FROM pred),
q AS (SELECT *, a / (a + b + c) AS qh, b / (a + b + c) AS qd, c / (a + b + c) AS qa FROM o)
SELECT k, pk, sk, xp, round(qh, 6) AS q_home, round(qa, 6) AS q_away, round(0.7 * p_home + 0.3 * qh, 6) AS b_home, round(0.7 * p_draw + 0.3 * qd, 6) AS b_draw,
  round(0.95 / greatest(0.7 * p_home + 0.3 * qh, 0.02), 6) AS fair_home FROM q""")


def q19_home_away_diff(spark, sf):
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    prof = c.groupBy(F.col("n_name").alias("team")).agg(F.avg("c_acctbal").alias("bal"), F.count("*").cast("double").alias("depth"), F.max("c_acctbal").alias("star"))
    m = matchup(spark, sf).select("k", "pk", "sk", "xp", F.col("home").alias("home_team"), F.col("away").alias("away_team"))
    t = dataset.feature_table(m, prof)
    return t.select("k", "pk", "sk", "xp", *(r6(f"{p}_{f}") for p in ("home", "away", "diff") for f in ("bal", "depth", "star")))


Q19 = f"""WITH {MATCHES_SQL},
p AS (SELECT n_name AS team, avg(c_acctbal) AS bal, CAST(count(*) AS DOUBLE) AS depth, max(c_acctbal) AS star FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT k, pk, sk, xp, round(h.bal, 6) AS home_bal, round(h.depth, 6) AS home_depth, round(h.star, 6) AS home_star, round(a.bal, 6) AS away_bal, round(a.depth, 6) AS away_depth, round(a.star, 6) AS away_star,
  round(h.bal - a.bal, 6) AS diff_bal, round(h.depth - a.depth, 6) AS diff_depth, round(h.star - a.star, 6) AS diff_star
FROM matchup m JOIN p h ON m.home = h.team JOIN p a ON m.away = a.team"""


def q20_odds_join(spark, sf):
    g = games(spark, sf).select("k", "pk", "sk", "xp", F.lit("t").alias("tournament"), F.col("home").alias("home_key"), F.col("away").alias("away_key"), F.col("eh").alias("elo_home"), F.col("ea").alias("elo_away"))
    o = _pairs(spark, sf).where("home < away and substr(home, -1) <> '7'").select(
        F.lit("t").alias("tournament"), F.col("home").alias("home_key"), F.col("away").alias("away_key"), F.lit(None).cast("timestamp").alias("match_date"),
        (1.5 + F.col("eh") / 1000).alias("odds_home"), F.lit(3.3).alias("odds_draw"), (1.5 + F.col("ea") / 1000).alias("odds_away"))
    o = o.union(o.withColumn("odds_home", F.col("odds_home") + 1))  # repeats: the first counts
    out = dataset.attach_odds(g, o)
    return out.select("k", "pk", "sk", "xp", r6("odds_home"), r6("odds_draw"), r6("odds_away"), "odds_source", r6("prob_home"))


Q20 = _with(f""",
{PAIRS_SQL},
o AS (SELECT home, away, 1.5 + eh / 1000 AS oh, 3.3 AS od, 1.5 + ea / 1000 AS oa FROM pairs WHERE home < away AND right(home, 1) <> '7'),
j AS (SELECT p.*, coalesce(d.oh, s.oa, 1 / greatest(p_home, 0.01)) AS a, coalesce(d.od, s.od, 1 / greatest(p_draw, 0.01)) AS b, coalesce(d.oa, s.oh, 1 / greatest(p_away, 0.01)) AS c,
  CASE WHEN d.oh IS NOT NULL THEN 'oddsportal' WHEN s.oh IS NOT NULL THEN 'oddsportal_swapped' ELSE 'elo_fallback' END AS odds_source
  FROM pred p LEFT JOIN o d ON p.home = d.home AND p.away = d.away LEFT JOIN o s ON p.home = s.away AND p.away = s.home)
SELECT k, pk, sk, xp, round(a, 6) AS odds_home, round(CAST(b AS DOUBLE), 6) AS odds_draw, round(c, 6) AS odds_away, odds_source,
  round((1 / greatest(a, 1.01)) / (1 / greatest(a, 1.01) + 1 / greatest(b, 1.01) + 1 / greatest(c, 1.01)), 6) AS prob_home FROM j""")


def q21_upset_labels(spark, sf):
    g = games(spark, sf).withColumnsRenamed({"eh": "elo_home", "ea": "elo_away"})
    u = dataset.upsets(g)
    return dataset.cohort(u, 100.0).select("k", "pk", "sk", "xp", "elo_gap", "favorite", "favorite_win", "upset", "is_lopsided")


Q21 = _with("""
SELECT k, pk, sk, xp, elo_gap, favorite, result = favorite AS favorite_win, CAST(result <> favorite AS INTEGER) AS upset, elo_gap >= 200 AS is_lopsided FROM pf WHERE elo_gap >= 100""")


def q22_three_upsets(spark, sf):
    g = games(spark, sf).withColumnsRenamed({"eh": "elo_home", "ea": "elo_away"})
    u = dataset.upsets(g)
    return u.groupBy("grp").agg(F.count("*").alias("n"), F.sum("upset").alias("upsets"), F.sum("underdog_won").alias("underdog_wins"), F.sum("pick_wrong").alias("picks_wrong"))


Q22 = _with("""
SELECT grp, count(*) AS n, CAST(sum(CAST(result <> favorite AS INTEGER)) AS BIGINT) AS upsets, CAST(sum(CAST(result = -favorite AS INTEGER)) AS BIGINT) AS underdog_wins,
  CAST(sum(CAST(result <> elo_pick AS INTEGER)) AS BIGINT) AS picks_wrong FROM pf GROUP BY grp""")


def q23_confidence(spark, sf):
    return predictions(spark, sf).select("k", "pk", "sk", "xp", r6("max_prob"), r6("prob_margin"), r6("norm_entropy"), "pick", "correct", r6("pnl"))


Q23 = _with("SELECT k, pk, sk, xp, round(max_prob, 6) AS max_prob, round(prob_margin, 6) AS prob_margin, round(norm_entropy, 6) AS norm_entropy, pick, correct, round(pnl, 6) AS pnl FROM pf")

_REPORT = ("n", "accuracy", "pnl", "roi")


def _rounded(df, *keys):
    return df.select(*keys, "n", *(F.round(c, 4).alias(c) for c in df.columns if c in ("accuracy", "pnl", "roi", "log_loss")))


def q24_threshold_sweep(spark, sf):
    return _rounded(backtest.threshold_sweep(predictions(spark, sf)), "threshold")


_SUM = "count(*) AS n, round(avg(CAST(correct AS INTEGER)), 4) AS accuracy, round(sum(pnl), 4) AS pnl, round(sum(pnl) / count(*) * 100, 4) AS roi"
Q24 = _with(f""",
t AS (SELECT CAST(unnest({list(backtest.THRESHOLDS)}) AS DOUBLE) AS threshold)
SELECT threshold, {_SUM} FROM pf, t WHERE max_prob >= threshold GROUP BY threshold""")


def _against_elo(spark, sf):
    """Predictions beside Elo probabilities without home advantage, which stand for Elo's own."""
    f = predictions(spark, sf)
    q = market.outcome_probabilities(F.col("eh"), F.col("ea"), 0.0)
    f = f.withColumns({f"e_{k}": v for k, v in q.items()})
    own = lambda h, d, a: F.when(F.col("pick") == 1, F.col(h)).when(F.col("pick") == 0, F.col(d)).otherwise(F.col(a))
    return f.withColumns({
        "edge_vs_elo": own("p_home", "p_draw", "p_away") - own("e_p_home", "e_p_draw", "e_p_away"), "agree_elo": F.col("pick") == F.col("elo_pick"),
        "agree_elo_fav": F.col("pick") == market.argmax_outcome(F.col("e_p_home"), F.col("e_p_draw"), F.col("e_p_away")),
    })


def q24b_rules(spark, sf):
    return _rounded(backtest.rule_report(_against_elo(spark, sf)), "rule")


_RULES = _with("""
z AS (SELECT *, 1.0 / (1.0 + pow(10.0, -(eh - ea) / 400.0)) AS q0, least(greatest(0.26 * (0.55 + 0.45 * exp(-abs(eh - ea) / 150.0)), 0.08), 0.38) AS qd FROM pf),
y AS (SELECT *, (1 - qd) * q0 AS qh, (1 - qd) * (1 - q0) AS qa FROM z),
x AS (SELECT *, CASE pick WHEN 1 THEN p_home - qh WHEN 0 THEN p_draw - qd ELSE p_away - qa END AS edge, pick = elo_pick AS agree,
  pick = CASE WHEN qh >= qd AND qh >= qa THEN 1 WHEN qd >= qa THEN 0 ELSE -1 END AS fav FROM y),
r AS (SELECT x.*, unnest([CASE WHEN true THEN 'baseline_all' END, CASE WHEN max_prob >= 0.42 THEN 'max_prob>=0.42' END, CASE WHEN max_prob >= 0.45 THEN 'max_prob>=0.45' END,
  CASE WHEN max_prob >= 0.45 AND prob_margin >= 0.12 THEN 'max_prob>=0.45 & margin>=0.12' END, CASE WHEN max_prob >= 0.45 AND norm_entropy <= 0.85 THEN 'max_prob>=0.45 & entropy<=0.85' END,
  CASE WHEN max_prob >= 0.42 AND agree THEN 'max_prob>=0.42 & agree_elo' END, CASE WHEN max_prob >= 0.42 AND fav THEN 'max_prob>=0.42 & agree_elo_fav' END,
  CASE WHEN edge >= 0.05 AND max_prob >= 0.40 THEN 'edge>=0.05 & max_prob>=0.40' END, CASE WHEN edge >= 0.08 AND max_prob >= 0.38 THEN 'edge>=0.08 & max_prob>=0.38' END,
  CASE WHEN NOT agree AND max_prob >= 0.45 THEN 'disagree_elo & max_prob>=0.45' END]) AS rule FROM x)""").replace("\nz AS", ",\nz AS", 1)
Q24B = _RULES + f"\nSELECT rule, {_SUM} FROM r WHERE rule IS NOT NULL GROUP BY rule"


def q24c_best_rule(spark, sf):
    return _rounded(backtest.best_rule(backtest.rule_report(_against_elo(spark, sf))), "rule")


Q24C = _RULES + f", s AS (SELECT rule, {_SUM}, sum(pnl) / count(*) AS e FROM r WHERE rule IS NOT NULL GROUP BY rule) SELECT rule, n, accuracy, pnl, roi FROM s WHERE n >= 15 ORDER BY e DESC, n DESC, rule LIMIT 1"


def _upset_rows(spark, sf):
    """Predictions with the probability that the favourite does not win as that of an upset, and a gap of 100 as lopsided."""
    return predictions(spark, sf).withColumns({
        "p_upset": 1 - F.when(F.col("favorite") == 1, F.col("p_home")).otherwise(F.col("p_away")), "is_lopsided": F.col("elo_gap") >= 100,
        "upset": (F.col("result") != F.col("favorite")).cast("int"),
    })


_GATED = ("accuracy", "lopsided_accuracy", "normal_accuracy", "recall", "precision")


def q25_gated_sweep(spark, sf):
    out = backtest.gate_sweep(_upset_rows(spark, sf))
    return out.select("tau", "n", *(r6(c) for c in _GATED), "best")


def q25b_combined_sweep(spark, sf):
    """The combined predictor's grid, the last of equally good values."""
    out = backtest.gate_sweep(_upset_rows(spark, sf), backtest.COMBINED_TAUS, last_best=True)
    return out.select("tau", "n", *(r6(c) for c in _GATED), "best")


def _gate_sql(taus, last):
    return _with(f""",
t AS (SELECT CAST(unnest({list(taus)}) AS DOUBLE) AS tau),
u AS (SELECT *, 1 - CASE favorite WHEN 1 THEN p_home ELSE p_away END AS pu, CASE favorite WHEN 1 THEN p_away ELSE p_home END AS dp FROM pf),
g AS (SELECT tau, result, favorite, elo_gap >= 100 AS lop, pu >= tau AS open, CASE WHEN elo_gap < 100 THEN pick WHEN pu >= tau THEN CASE WHEN p_draw > dp THEN 0 ELSE -favorite END ELSE favorite END AS g FROM u, t),
a AS (SELECT tau, count(*) AS n, avg(CAST(g = result AS INTEGER)) AS accuracy, avg(CAST(g = result AS INTEGER)) FILTER (lop) AS la, avg(CAST(g = result AS INTEGER)) FILTER (NOT lop) AS na,
  count(*) FILTER (lop AND result <> favorite) AS ups, count(*) FILTER (lop AND open) AS called, count(*) FILTER (lop AND open AND result <> favorite) AS hits FROM g GROUP BY tau)
SELECT tau, n, round(accuracy, 6) AS accuracy, round(la, 6) AS lopsided_accuracy, round(na, 6) AS normal_accuracy, round(CASE WHEN ups > 0 THEN hits / ups ELSE 0 END, 6) AS recall,
  round(CASE WHEN called > 0 THEN hits / called ELSE 0 END, 6) AS precision, row_number() OVER (ORDER BY accuracy DESC, tau{' DESC' if last else ''}) = 1 AS best FROM a""")


Q25, Q25B = _gate_sql(backtest.GATE_TAUS, False), _gate_sql(backtest.COMBINED_TAUS, True)


def q25c_upset_sweep(spark, sf):
    out = backtest.upset_sweep(_upset_rows(spark, sf).where("is_lopsided"))
    return out.select("tau", "called", r6("precision"), r6("recall"), r6("f1"), "best")


Q25C = _with(f""",
t AS (SELECT CAST(unnest({list(backtest.UPSET_TAUS)}) AS DOUBLE) AS tau),
u AS (SELECT tau, count(*) FILTER (1 - CASE favorite WHEN 1 THEN p_home ELSE p_away END >= tau) AS called, count(*) FILTER (result <> favorite) AS ups,
  count(*) FILTER (result <> favorite AND 1 - CASE favorite WHEN 1 THEN p_home ELSE p_away END >= tau) AS hits FROM pf, t WHERE elo_gap >= 100 GROUP BY tau),
p AS (SELECT *, CASE WHEN called > 0 THEN hits / called ELSE 0 END AS pr, CASE WHEN ups > 0 THEN hits / ups ELSE 0 END AS re FROM u),
f1 AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM p)
SELECT tau, called, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1, row_number() OVER (ORDER BY f DESC, tau DESC) = 1 AS best FROM f1""")


def _bet_report(f, bets):
    out = backtest.strategies(f, bets)
    return out.select("strategy", "n", "wins", *(F.round(c, 4).alias(c) for c in ("pnl", "roi", "avg_odds")))


_BETS = "SELECT strategy, count(*) AS n, count(*) FILTER (won) AS wins, round(sum(CASE WHEN won THEN odds - 1 ELSE -1 END), 4) AS pnl, round(sum(CASE WHEN won THEN odds - 1 ELSE -1 END) / count(*) * 100, 4) AS roi, round(avg(odds), 4) AS avg_odds FROM b GROUP BY strategy"


def q26_strategies(spark, sf):
    """Strategies A to J at made-up market odds."""
    f = _upset_rows(spark, sf).withColumns({"odds_home": 1.2 + F.col("disc") * 20, "odds_draw": F.lit(3.2), "odds_away": 1.5 + F.col("tax") * 30})
    return _bet_report(f.withColumns(market.expected_goals(F.col("eh"), F.col("ea"))), backtest.upset_bets())


_EFG = "\n".join(
    f"""  UNION ALL SELECT 'E: P(upset)>={t:.2f}, best non-favorite', result = other, o_other FROM m WHERE pu >= {t}
  UNION ALL SELECT 'F: P(upset)>={t:.2f}, underdog', result = -favorite, o_dog FROM m WHERE pu >= {t}
  UNION ALL SELECT 'G: P(upset)>={t:.2f}, draw', result = 0, 3.2 FROM m WHERE pu >= {t}"""
    for t in backtest.BET_TAUS
)
Q26 = _with(f""",
o AS (SELECT *, CASE favorite WHEN 1 THEN p_away ELSE p_home END AS dp, 1 - CASE favorite WHEN 1 THEN p_home ELSE p_away END AS pu, 1.2 + disc * 20 AS oh, 1.5 + tax * 30 AS oa, greatest(2.55 * pe, 0.15) AS xh, greatest(2.55 * (1 - pe), 0.15) AS xa FROM pf WHERE elo_gap >= 100),
l AS (SELECT *, CASE WHEN dp > p_draw THEN -favorite ELSE 0 END AS other, greatest(dp, p_draw) AS op, CASE favorite WHEN 1 THEN oh ELSE oa END AS o_fav, CASE favorite WHEN 1 THEN oa ELSE oh END AS o_dog,
  CAST(round_even(xh, 0) AS INTEGER) AS ph, CAST(round_even(xa, 0) AS INTEGER) AS pa FROM o),
m AS (SELECT *, CASE WHEN other = 0 THEN 3.2 ELSE o_dog END AS o_other, exp(-xh) * pow(xh, ph) / factorial(ph) * (exp(-xa) * pow(xa, pa) / factorial(pa)) AS ps, hg = ph AND ag = pa AS exact FROM l),
b AS (SELECT 'A: favorite' AS strategy, result = favorite AS won, CAST(o_fav AS DOUBLE) AS odds FROM m UNION ALL SELECT 'B: underdog', result = -favorite, o_dog FROM m
  UNION ALL SELECT 'C: draw', result = 0, 3.2 FROM m UNION ALL SELECT 'D: best non-favorite', result = other, o_other FROM m
{_EFG}
  UNION ALL SELECT 'H: P(upset)>=0.45, value edge>=10%', result = other, o_other FROM m WHERE pu >= 0.45 AND op >= 1.10 / o_other
  UNION ALL SELECT 'I: correct score', exact, least(0.88 / greatest(ps, 0.0001), 250) FROM m
  UNION ALL SELECT 'J: P(upset)>=0.45, correct score with P>=6%', exact, least(0.88 / greatest(ps, 0.0001), 250) FROM m WHERE pu >= 0.45 AND ps >= 0.06 AND result <> favorite)
{_BETS}""")


def _bold(spark, sf):
    """A model that is not Elo's: where the market's odds are even, it picks against the favourite or a draw."""
    other = F.when(F.col("k") % 3 == 0, -F.col("favorite")).when(F.col("k") % 3 == 1, F.lit(0)).otherwise(F.col("favorite"))
    return predictions(spark, sf).withColumn("pick", other.cast("int"))


def q26b_pick_bets(spark, sf):
    return _bet_report(_bold(spark, sf), backtest.pick_bets())


_BOLD = "w AS (SELECT * REPLACE (CAST(CASE k % 3 WHEN 0 THEN -favorite WHEN 1 THEN 0 ELSE favorite END AS INTEGER) AS pick) FROM pf)"
Q26B = _with(f""",
{_BOLD}, v AS (SELECT *, 1 / greatest(1 - 1.0 / (1.0 + pow(10.0, -elo_gap / 400.0)), 0.01) AS od FROM w),
b AS (SELECT 'A: underdog' AS strategy, result = -favorite AS won, od AS odds FROM v WHERE pick = -favorite
  UNION ALL SELECT 'B: draw', result = 0, 4.0 FROM v WHERE pick = 0 AND elo_gap > 50
  UNION ALL SELECT 'C: underdog or draw', CASE WHEN pick = 0 THEN result = 0 ELSE result = -favorite END, CASE WHEN pick = 0 THEN 4.0 ELSE od END FROM v WHERE pick = -favorite OR pick = 0 AND elo_gap > 80)
{_BETS}""")


def q26c_contrarian(spark, sf):
    out = _bold(spark, sf).groupBy("grp").agg(*backtest.contrarian())
    return out.select("grp", "n", "wins", "pnl", r6("roi"))


Q26C = _with(f""",
{_BOLD}, c AS (SELECT grp, count(*) FILTER (pick <> elo_pick) AS n, count(*) FILTER (pick <> elo_pick AND pick = result) AS wins FROM w GROUP BY grp)
SELECT grp, n, wins, 2 * wins - n AS pnl, round(CASE WHEN n > 0 THEN (2 * wins - n) / n * 100 ELSE 0 END, 6) AS roi FROM c""")


def q27_alpha_sweep(spark, sf):
    f = predictions(spark, sf)
    q = market.devig(1.2 + F.col("disc") * 20, F.lit(3.2), 1.5 + F.col("tax") * 30)
    f = f.withColumns({"m_home": q["p_home"], "m_draw": q["p_draw"], "m_away": q["p_away"]})
    out = backtest.blend_sweep(f)
    return out.select("alpha", "n", F.round("accuracy", 6).alias("accuracy"), F.round("log_loss", 6).alias("log_loss"))


Q27 = _with(f""",
o AS (SELECT *, 1 / (1.2 + disc * 20) AS a, 1 / 3.2 AS b, 1 / (1.5 + tax * 30) AS c FROM pf),
t AS (SELECT CAST(unnest({list(backtest.ALPHAS)}) AS DOUBLE) AS alpha),
m AS (SELECT alpha, result, alpha * p_home + (1 - alpha) * a / (a + b + c) AS h, alpha * p_draw + (1 - alpha) * b / (a + b + c) AS d, alpha * p_away + (1 - alpha) * c / (a + b + c) AS w FROM o, t),
n AS (SELECT alpha, result, h / (h + d + w) AS h, d / (h + d + w) AS d, w / (h + d + w) AS w FROM m)
SELECT alpha, count(*) AS n, round(avg(CAST(CASE WHEN h >= d AND h >= w THEN 1 WHEN d >= w THEN 0 ELSE -1 END = result AS INTEGER)), 6) AS accuracy,
  round(avg(-ln(greatest(CASE result WHEN 1 THEN h WHEN 0 THEN d ELSE w END, 1e-15))), 6) AS log_loss FROM n GROUP BY alpha""")


def _goals(spark, sf):
    return simulate.predict(predictions(spark, sf).drop("p_home", "p_draw", "p_away", "pick").withColumnsRenamed({"eh": "elo_home", "ea": "elo_away"}))


def q28_goal_errors(spark, sf):
    return _goals(spark, sf).groupBy("grp").agg(F.count("*").alias("n"), *backtest.goal_accuracy()).select("grp", "n", r6("mae_home"), r6("mae_away"), r6("mae_total"), "exact", "exact_total")


GOALS_SQL = _with(""",
z AS (SELECT *, 1.0 / (1.0 + pow(10.0, -(eh - ea) / 400.0)) AS p0 FROM pf),
go AS (SELECT *, CAST(round_even(greatest(2.55 * p0, 0.15), 0) AS INTEGER) AS ph, CAST(round_even(greatest(2.55 * (1 - p0), 0.15), 0) AS INTEGER) AS pa FROM z)""")
Q28 = GOALS_SQL + """
SELECT grp, count(*) AS n, round(avg(abs(hg - ph)), 6) AS mae_home, round(avg(abs(ag - pa)), 6) AS mae_away, round(avg(abs(hg + ag - ph - pa)), 6) AS mae_total,
  count(*) FILTER (hg = ph AND ag = pa) AS exact, count(*) FILTER (hg + ag = ph + pa) AS exact_total FROM go GROUP BY grp"""


def q28b_over_under(spark, sf):
    out = backtest.over_under_accuracy(_goals(spark, sf))
    return out.select("line", "n", r6("accuracy"))


Q28B = GOALS_SQL + """, l AS (SELECT CAST(unnest([1.5, 2.5, 3.5]) AS DOUBLE) AS line)
SELECT line, count(*) AS n, round(avg(CAST((hg + ag > line) = (ph + pa > line) AS INTEGER)), 6) AS accuracy FROM go, l GROUP BY line"""


def q28d_scorelines(spark, sf):
    g = predictions(spark, sf).withColumns(market.expected_goals(F.col("eh"), F.col("ea")))
    return g.groupBy("grp").agg(*backtest.scoreline_accuracy())


Q28D = _with(""",
x AS (SELECT *, greatest(2.55 * pe, 0.15) AS xh, greatest(2.55 * (1 - pe), 0.15) AS xa FROM pf),
s AS (SELECT *, least(greatest(ceil(xh) - 1, 0), 6) AS ph, least(greatest(ceil(xa) - 1, 0), 6) AS pa FROM x)
SELECT grp, count(*) AS n, count(*) FILTER (hg = ph AND ag = pa) AS exact, count(*) FILTER (sign(ph - pa) = result) AS outcome_right FROM s GROUP BY grp""")


def q28c_error_severity(spark, sf):
    return backtest.error_severity(predictions(spark, sf))


Q28C = _with("SELECT abs(result - pick) AS off_by, count(*) AS n FROM pf GROUP BY 1")


def q29_class_report(spark, sf):
    out = backtest.class_report(predictions(spark, sf), "result", "pick", [1, 0, -1])
    return out.select("class", "support", r6("precision"), r6("recall"), r6("f1"))


Q29 = _with(""",
c AS (SELECT unnest([1, 0, -1]) AS class),
s AS (SELECT class, count(*) FILTER (result = class) AS support, count(*) FILTER (pick = class) AS pp, count(*) FILTER (result = class AND pick = class) AS tp FROM pf, c GROUP BY class),
r AS (SELECT class, support, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM s)
SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM r""")


def q29b_confusion(spark, sf):
    return backtest.confusion(predictions(spark, sf), "result", "pick")


Q29B = _with("SELECT result, pick, count(*) AS n FROM pf GROUP BY result, pick")


def q30_accuracy_sets(spark, sf):
    f = predictions(spark, sf).withColumn("season", F.year("d"))
    out = backtest.accuracy_sets(f, "season", "grp")
    return out.select("season", "grp", F.col("level").cast("int").alias("level"), "n", r6("accuracy"))


Q30 = _with(""", y AS (SELECT *, CAST(year(d) AS INTEGER) AS season FROM pf)
SELECT season, grp, CAST(grouping(season, grp) AS INTEGER) AS level, count(*) AS n, round(avg(CAST(correct AS INTEGER)), 6) AS accuracy FROM y GROUP BY CUBE (season, grp)""")


def q30b_alpha_analysis(spark, sf):
    return predictions(spark, sf).groupBy("grp").agg(*backtest.alpha_analysis(), *backtest.underdog_capture()).select(
        "grp", "n", "agree", "model_right", "elo_right", "elo_missed", "upsets_caught", "underdog_wins", "called", "hits", r6("recall"), r6("precision"), "false_alarms")


Q30B = _with(""", s AS (
SELECT grp, count(*) AS n, count(*) FILTER (pick = elo_pick) AS agree, count(*) FILTER (pick <> elo_pick AND pick = result) AS model_right, count(*) FILTER (pick <> elo_pick AND elo_pick = result) AS elo_right,
  count(*) FILTER (elo_pick <> result) AS elo_missed, count(*) FILTER (elo_pick <> result AND pick = result) AS upsets_caught,
  count(*) FILTER (result = -favorite) AS underdog_wins, count(*) FILTER (pick = -favorite) AS called, count(*) FILTER (pick = -favorite AND result = -favorite) AS hits FROM pf GROUP BY grp)
SELECT *, round(CASE WHEN underdog_wins > 0 THEN hits / underdog_wins ELSE 0.0 END, 6) AS recall, round(CASE WHEN called > 0 THEN hits / called ELSE 0.0 END, 6) AS precision, called - hits AS false_alarms FROM s""")


def q30c_tier_capture(spark, sf):
    f = predictions(spark, sf).withColumn("upset", (F.col("result") != F.col("favorite")).cast("int"))
    return backtest.tier_capture(f)


Q30C = _with("""
SELECT CASE WHEN elo_gap < 100 THEN 0 WHEN elo_gap < 200 THEN 1 ELSE 2 END AS tier, count(*) AS n, count(*) FILTER (result <> favorite) AS upsets,
  count(*) FILTER (result <> favorite AND pick = result) AS upsets_caught, count(*) FILTER (result = 0) AS draws, count(*) FILTER (result = 0 AND pick = 0) AS draws_caught FROM pf GROUP BY 1""")


def q41_elo_rolling(spark, sf):
    """Ratings before and after every match; a region's fold is serial by nature."""
    order = ["d", "k", "pk", "sk", "xp"]
    out = ratings.elo_fold(matchup(spark, sf).select("grp", "home", "away", "hg", "ag", *order), "grp", order)
    return out.select("grp", *order, "home", "away", *(F.round(c, 4).alias(c) for c in ("elo_home", "elo_away", "elo_home_after", "elo_away_after")))


def q38_market_json(spark, sf):
    e = read(spark, sf, "events").withColumn("n", F.get_json_object("props", "$.k").cast("int"))
    n = F.col("n")
    cell = F.when(n % 7 == 0, F.lit("[]")).otherwise(F.concat(
        F.lit("[{'1': '"), (n + 1).cast("string"), F.lit(".5', 'X': "), F.when(n % 5 == 0, F.lit("None")).otherwise(F.lit("'3.2'")), F.lit(", '2': '2.1', 'bookmaker_name': '"),
        F.when(n % 3 == 0, "Bet365").otherwise("Other"), F.lit("', 'period': 'FT'}, {'1': '9.0', 'X': '8.0', '2': '7.0', 'bookmaker_name': 'betway', 'period': 'FT'}]")))
    o = nested.market_odds(cell)
    return e.select("event_id", o.alias("o")).select("event_id", F.col("o.home").alias("home"), F.col("o.draw").alias("draw"), F.col("o.away").alias("away"), F.col("o.bookmaker").alias("bookmaker"))


def _elo_sql(columns):
    """``columns`` of every match by a fold over each region's: before and after ratings, and ranks among teams then seen."""
    return f"""WITH RECURSIVE {MATCHES_SQL},
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY d, k, pk, sk, xp) AS r FROM matchup),
s(grp, r, ratings, d, k, pk, sk, xp, home, away, eh, ea, ch, rank_home, rank_away) AS (
  SELECT DISTINCT grp, CAST(0 AS BIGINT), MAP([CAST('' AS VARCHAR)], [CAST(-1e9 AS DOUBLE)]), CAST(NULL AS TIMESTAMP), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST('' AS VARCHAR), CAST('' AS VARCHAR),
    CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS INTEGER), CAST(0 AS INTEGER) FROM o
  UNION ALL
  SELECT grp, r, map_concat(ratings, MAP([home, away], [eh + ch, ea - ch])), d, k, pk, sk, xp, home, away, eh, ea, ch,
    CAST(1 + CASE WHEN map_contains(ratings, home) THEN len(list_filter(map_values(ratings), lambda x: x > eh)) ELSE len(map_values(ratings)) - 1 END AS INTEGER),
    CAST(1 + CASE WHEN map_contains(ratings, away) THEN len(list_filter(map_values(ratings), lambda x: x > ea)) ELSE len(map_values(ratings)) - 1 END AS INTEGER) FROM (
    SELECT grp, r, ratings, d, k, pk, sk, xp, home, away, eh, ea,
      22.0 * (1 + 0.15 * least(abs(hg - ag), 3)) * (CASE WHEN hg > ag THEN 1.0 WHEN hg = ag THEN 0.5 ELSE 0.0 END - 1 / (1 + pow(10.0, -(eh + 60.0 - ea) / 400.0))) AS ch
    FROM (SELECT o.grp, o.r, s.ratings, o.d, o.k, o.pk, o.sk, o.xp, o.home, o.away, o.hg, o.ag, coalesce(element_at(s.ratings, o.home)[1], 1500.0) AS eh, coalesce(element_at(s.ratings, o.away)[1], 1500.0) AS ea
      FROM s JOIN o ON o.grp = s.grp AND o.r = s.r + 1)))
SELECT grp, d, k, pk, sk, xp, home, away, {columns} FROM s WHERE r > 0"""


Q41 = _elo_sql("round(eh, 4) AS elo_home, round(ea, 4) AS elo_away, round(eh + ch, 4) AS elo_home_after, round(ea - ch, 4) AS elo_away_after")
ELO_RANKS = _elo_sql("rank_home, rank_away")

Q38 = """WITH n AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN CASE WHEN k % 5 = 0 THEN NULL ELSE k + 1.5 END ELSE 9.0 END::DOUBLE AS home,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN CASE WHEN k % 5 = 0 THEN NULL ELSE 3.2 END ELSE 8.0 END::DOUBLE AS draw,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN CASE WHEN k % 5 = 0 THEN NULL ELSE 2.1 END ELSE 7.0 END::DOUBLE AS away,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN CASE WHEN k % 5 = 0 THEN NULL ELSE 'Bet365' END ELSE 'betway' END AS bookmaker FROM n"""

QUERIES = {
    "q01_standings": (q01_standings, Q01), "q02_elo_1x2": (q02_elo_1x2, Q02), "q03_expected_goals": (q03_expected_goals, Q03), "q04_poisson_matrix": (q04_poisson_matrix, Q04),
    "q05_top_scorelines": (q05_top_scorelines, Q05), "q06_devig_blend": (q06_devig_blend, Q06), "q19_home_away_diff": (q19_home_away_diff, Q19), "q20_odds_join": (q20_odds_join, Q20),
    "q21_upset_labels": (q21_upset_labels, Q21), "q22_three_upsets": (q22_three_upsets, Q22), "q23_confidence": (q23_confidence, Q23), "q24_threshold_sweep": (q24_threshold_sweep, Q24),
    "q24b_rules": (q24b_rules, Q24B), "q24c_best_rule": (q24c_best_rule, Q24C), "q25b_combined_sweep": (q25b_combined_sweep, Q25B), "q25c_upset_sweep": (q25c_upset_sweep, Q25C),
    "q26b_pick_bets": (q26b_pick_bets, Q26B), "q26c_contrarian": (q26c_contrarian, Q26C), "q28d_scorelines": (q28d_scorelines, Q28D), "q25_gated_sweep": (q25_gated_sweep, Q25), "q26_strategies": (q26_strategies, Q26), "q27_alpha_sweep": (q27_alpha_sweep, Q27),
    "q28_goal_errors": (q28_goal_errors, Q28), "q28b_over_under": (q28b_over_under, Q28B), "q28c_error_severity": (q28c_error_severity, Q28C), "q29_class_report": (q29_class_report, Q29),
    "q29b_confusion": (q29b_confusion, Q29B), "q30_accuracy_sets": (q30_accuracy_sets, Q30), "q30b_alpha_analysis": (q30b_alpha_analysis, Q30B), "q30c_tier_capture": (q30c_tier_capture, Q30C),
    "q38_market_json": (q38_market_json, Q38), "q41_elo_rolling": (q41_elo_rolling, Q41),
}
