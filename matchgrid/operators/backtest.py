"""Backtests: predictions in, reports out, all relational.

Prediction rows have match_id, result (1, 0, -1), p_home, p_draw, p_away and what each
report names besides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrid.functions import market, numbers

# Grids of the sweeps (fixed values).
THRESHOLDS = (0.33, 0.36, 0.38, 0.40, 0.42, 0.45, 0.48, 0.50, 0.55)
ALPHAS = (0.0, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 1.0)
#: Upset probabilities from which the gate opens: of the gated predictor, of the combined one, and of the upset model alone.
GATE_TAUS = (0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60)
COMBINED_TAUS = (0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65)
UPSET_TAUS = (0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60)
BET_TAUS = (0.40, 0.45, 0.50, 0.55)
#: Elo gaps between the tiers.
TIERS = (100.0, 200.0)


def frame(predictions: DataFrame) -> DataFrame:
    """Predictions with pick, correct, max_prob, prob_margin, norm_entropy, pick_odds and pnl."""
    p = [F.col(c) for c in ("p_home", "p_draw", "p_away")]
    pick = market.argmax_outcome(*p)
    best = F.greatest(*p)
    out = predictions.withColumns({"pick": pick, "max_prob": best, "prob_margin": numbers.top_margin(*p), "norm_entropy": numbers.entropy(*p)})
    out = out.withColumn("correct", F.col("pick") == F.col("result")).withColumn("pick_odds", market.fair_odds(F.col("max_prob")))
    return out.withColumn("pnl", market.profit(F.col("correct"), F.col("pick_odds")))


def summary() -> list[Column]:
    """n, accuracy, P&L and return of a subset."""
    n = F.count("*")
    return [n.alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.sum("pnl").alias("pnl"), (F.sum("pnl") / n * 100).alias("roi")]


def _level(value: Column, grid) -> Column:
    """How many values of an ascending grid are at most ``value``."""
    return F.size(F.filter(F.array(*(F.lit(float(v)) for v in grid)), lambda v: value >= v))


def _one_row_each(row: DataFrame, names: list[str], parts: tuple[str, ...], key: str) -> DataFrame:
    """A row for each name of a single row that has a column ``part_i`` for part and the name's place."""
    each = [F.struct(F.lit(n).alias(key), *(F.col(f"{p}_{i}").alias(p) for p in parts)) for i, n in enumerate(names)]
    return row.select(F.explode(F.array(*each)).alias("s")).select("s.*")


def threshold_sweep(f: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(threshold, summary) of the rows whose max_prob reaches it: rows are added up once, by the thresholds they pass."""
    bins = f.groupBy(_level(F.col("max_prob"), thresholds).alias("b")).agg(F.count("*").alias("n"), F.count_if("correct").alias("c"), F.sum("pnl").alias("p"))
    passed = F.slice(F.array(*(F.lit(float(v)) for v in thresholds)), F.lit(1), F.col("b"))
    n, pnl = F.sum("n"), F.sum("p")
    return bins.select("n", "c", "p", F.explode(passed).alias("threshold")).groupBy("threshold").agg(n.alias("n"), (F.sum("c") / n).alias("accuracy"), pnl.alias("pnl"), (pnl / n * 100).alias("roi"))


def rules() -> dict[str, Column]:
    """Named selections by confidence, margin, entropy, edge over Elo and agreement with its pick or its favourite (fixed values)."""
    c = F.col
    return {
        "baseline_all": F.lit(True),
        "max_prob>=0.42": c("max_prob") >= 0.42,
        "max_prob>=0.45": c("max_prob") >= 0.45,
        "max_prob>=0.45 & margin>=0.12": (c("max_prob") >= 0.45) & (c("prob_margin") >= 0.12),
        "max_prob>=0.45 & entropy<=0.85": (c("max_prob") >= 0.45) & (c("norm_entropy") <= 0.85),
        "max_prob>=0.42 & agree_elo": (c("max_prob") >= 0.42) & c("agree_elo"),
        "max_prob>=0.42 & agree_elo_fav": (c("max_prob") >= 0.42) & c("agree_elo_fav"),
        "edge>=0.05 & max_prob>=0.40": (c("edge_vs_elo") >= 0.05) & (c("max_prob") >= 0.40),
        "edge>=0.08 & max_prob>=0.38": (c("edge_vs_elo") >= 0.08) & (c("max_prob") >= 0.38),
        "disagree_elo & max_prob>=0.45": ~c("agree_elo") & (c("max_prob") >= 0.45),
    }


def rule_report(f: DataFrame, made: dict[str, Column] | None = None) -> DataFrame:
    """(rule, summary) of the rules that some row meets: one aggregation of conditional sums."""
    made = made or rules()
    sums = []
    for i, v in enumerate(made.values()):
        sums += [F.count_if(v).alias(f"n_{i}"), F.count_if(v & F.col("correct")).alias(f"c_{i}"), F.sum(F.when(v, F.col("pnl"))).alias(f"p_{i}")]
    out = _one_row_each(f.agg(*sums), list(made), ("n", "c", "p"), "rule").where("n > 0")
    return out.select("rule", "n", (F.col("c") / F.col("n")).alias("accuracy"), F.col("p").alias("pnl"), (F.col("p") / F.col("n") * 100).alias("roi"))


def best_rule(report: DataFrame, least: int = 15) -> DataFrame:
    """The rule of the highest return among those with enough rows."""
    return report.where(F.col("n") >= least).orderBy(F.desc("roi"), F.desc("n"), "rule").limit(1)


def accuracy_sets(f: DataFrame, tournament: str, phase: str) -> DataFrame:
    """Accuracy overall, by tournament, by phase and by both: one pass over grouping sets."""
    return f.cube(tournament, phase).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def gated_pick(p_upset: Column, tau: Column, favorite: Column, lopsided: Column, own: Column, p: dict[int, Column], draw_first: bool = False) -> Column:
    """Not lopsided: the model's own pick. Else, from ``tau`` on, the better of underdog and draw (ties to the underdog, or the draw); else the favourite."""
    dog = F.when(favorite == 1, p[-1]).otherwise(p[1])
    draw_wins = p[0] >= dog if draw_first else p[0] > dog
    return F.when(~lopsided, own).when(p_upset >= tau, F.when(draw_wins, 0).otherwise(-favorite)).otherwise(favorite)


def gate_sweep(f: DataFrame, taus=GATE_TAUS, last_best: bool = False) -> DataFrame:
    """(tau, n, accuracy, lopsided_accuracy, normal_accuracy, recall, precision, best) of gated picks.

    recall and precision are those of upsets called among lopsided matches, 0 where
    undefined; the first, or last, tau of the highest accuracy is best. Rows are added up
    once, by the taus that their upset probability reaches. Needs p_upset, favorite,
    is_lopsided, pick.
    """
    p = {1: F.col("p_home"), 0: F.col("p_draw"), -1: F.col("p_away")}
    pick = lambda open_: gated_pick(F.lit(1.0 if open_ else 0.0), F.lit(0.5), F.col("favorite"), F.col("is_lopsided"), F.col("pick"), p)
    hit = lambda open_: (pick(open_) == F.col("result")).cast("int")
    bins = f.groupBy(_level(F.col("p_upset"), taus).alias("b"), "is_lopsided").agg(
        F.count("*").alias("n"), F.count_if(F.col("result") != F.col("favorite")).alias("u"), F.sum(hit(True)).alias("open"), F.sum(hit(False)).alias("shut"),
    )
    grid = F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("tau")) for i, t in enumerate(taus)))
    each = bins.select("*", F.explode(grid).alias("g")).withColumn("on", F.col("b") >= F.col("g.i"))
    right = F.when(F.col("on"), F.col("open")).otherwise(F.col("shut"))
    lop = F.col("is_lopsided")
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    ratio = lambda a, b: F.when(b > 0, a / b)
    called, upsets, hits = total(lop & F.col("on"), F.col("n")), total(lop, F.col("u")), total(lop & F.col("on"), F.col("u"))
    out = each.groupBy(F.col("g.tau").alias("tau")).agg(
        F.sum("n").alias("n"), (F.sum(right) / F.sum("n")).alias("accuracy"), ratio(total(lop, right), total(lop, F.col("n"))).alias("lopsided_accuracy"),
        ratio(total(~lop, right), total(~lop, F.col("n"))).alias("normal_accuracy"), F.coalesce(ratio(hits, upsets), F.lit(0.0)).alias("recall"), F.coalesce(ratio(hits, called), F.lit(0.0)).alias("precision"),
    )
    order = F.desc("tau") if last_best else F.asc("tau")
    return out.withColumn("best", F.row_number().over(W.orderBy(F.desc("accuracy"), order)) == 1)


def upset_sweep(f: DataFrame, taus=UPSET_TAUS) -> DataFrame:
    """(tau, called, precision, recall, f1, best) of upsets called from ``tau`` on; the last tau of the highest F1 is best. Needs p_upset, upset."""
    bins = f.groupBy(_level(F.col("p_upset"), taus).alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col("upset") == 1).alias("u"))
    grid = F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("tau")) for i, t in enumerate(taus)))
    each = bins.select("*", F.explode(grid).alias("g")).withColumn("on", F.col("b") >= F.col("g.i"))
    total = lambda v: F.sum(F.when(F.col("on"), F.col(v)).otherwise(0))
    out = each.groupBy(F.col("g.tau").alias("tau")).agg(total("n").alias("called"), total("u").alias("hits"), F.sum("u").alias("upsets"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(F.col("hits"), F.col("called")), ratio(F.col("hits"), F.col("upsets"))
    out = out.select("tau", "called", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))
    return out.withColumn("best", F.row_number().over(W.orderBy(F.desc("f1"), F.desc("tau"))) == 1)


def blend_sweep(f: DataFrame, alphas=ALPHAS) -> DataFrame:
    """(alpha, n, accuracy, log_loss) of blends of p_* with market m_*: one aggregation."""
    model, odds = (F.col("p_home"), F.col("p_draw"), F.col("p_away")), (F.col("m_home"), F.col("m_draw"), F.col("m_away"))
    sums = []
    for i, alpha in enumerate(alphas):
        h, d, a = market.blend(model, odds, F.lit(float(alpha)))
        won = F.when(F.col("result") == 1, h).when(F.col("result") == 0, d).otherwise(a)
        sums += [F.count("*").alias(f"n_{i}"), F.avg((market.argmax_outcome(h, d, a) == F.col("result")).cast("double")).alias(f"accuracy_{i}"), F.avg(-F.log(F.greatest(won, F.lit(1e-15)))).alias(f"log_loss_{i}")]
    return _one_row_each(f.agg(*sums), [float(a) for a in alphas], ("n", "accuracy", "log_loss"), "alpha")


def log_loss(home: str, draw: str, away: str, floor: float = 1e-15) -> Column:
    p = F.when(F.col("result") == 1, F.col(home)).when(F.col("result") == 0, F.col(draw)).otherwise(F.col(away))
    return F.avg(-F.log(F.greatest(p, F.lit(floor))))


def strategies(f: DataFrame, bets: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """(strategy, n, wins, pnl, roi, avg_odds) of name -> (condition, won, odds), for those with a bet: one aggregation of conditional sums."""
    sums = []
    for i, (c, won, odds) in enumerate(bets.values()):
        sums += [F.count_if(c).alias(f"n_{i}"), F.count_if(c & won).alias(f"wins_{i}"), F.sum(F.when(c, market.profit(won, odds))).alias(f"pnl_{i}"), F.avg(F.when(c, odds)).alias(f"odds_{i}")]
    out = _one_row_each(f.agg(*sums), list(bets), ("n", "wins", "pnl", "odds"), "strategy").where("n > 0")
    return out.select("strategy", "n", "wins", "pnl", (F.col("pnl") / F.col("n") * 100).alias("roi"), F.col("odds").alias("avg_odds"))


def upset_bets(taus=BET_TAUS) -> dict[str, tuple[Column, Column, Column]]:
    """Strategies A to J on lopsided matches.

    Needs is_lopsided, favorite, result, hg, ag, p_home/draw/away, p_upset, odds_home/draw/
    away, xg_home, xg_away. J, as its model has it, leaves out matches that the favourite won.
    """
    c = F.col
    lop, fav, dog = c("is_lopsided"), c("favorite"), -c("favorite")
    side = lambda code, h, a: F.when(code == 1, c(h)).otherwise(c(a))
    p_dog = side(dog, "p_home", "p_away")
    other = F.when(p_dog > c("p_draw"), dog).otherwise(0)
    odds_fav, odds_dog, odds_draw = side(fav, "odds_home", "odds_away"), side(dog, "odds_home", "odds_away"), c("odds_draw")
    odds_other, p_other = F.when(other == 0, odds_draw).otherwise(odds_dog), F.greatest(p_dog, c("p_draw"))
    won = lambda code: c("result") == code
    h, a = F.bround("xg_home").cast("int"), F.bround("xg_away").cast("int")
    p_score = market.poisson(c("xg_home"), h) * market.poisson(c("xg_away"), a)
    exact = (c("hg") == h) & (c("ag") == a)
    out = {"A: favorite": (lop, won(fav), odds_fav), "B: underdog": (lop, won(dog), odds_dog), "C: draw": (lop, won(F.lit(0)), odds_draw), "D: best non-favorite": (lop, won(other), odds_other)}
    for t in taus:
        opens = lop & (c("p_upset") >= t)
        out[f"E: P(upset)>={t:.2f}, best non-favorite"] = (opens, won(other), odds_other)
        out[f"F: P(upset)>={t:.2f}, underdog"] = (opens, won(dog), odds_dog)
        out[f"G: P(upset)>={t:.2f}, draw"] = (opens, won(F.lit(0)), odds_draw)
    called = lop & (c("p_upset") >= 0.45)
    out["H: P(upset)>=0.45, value edge>=10%"] = (called & (p_other >= 1.10 / odds_other), won(other), odds_other)
    out["I: correct score"] = (lop, exact, market.score_odds(p_score))
    out["J: P(upset)>=0.45, correct score with P>=6%"] = (called & (p_score >= 0.06) & ~won(fav), exact, market.score_odds(p_score))
    return out


def pick_bets() -> dict[str, tuple[Column, Column, Column]]:
    """Strategies A to C on the model's picks, at odds that Elo without home advantage implies, a draw at 0.25. Needs pick, result, favorite, elo_gap."""
    c = F.col
    odds = lambda p: 1 / F.greatest(p, F.lit(0.01))
    p_dog = 1 - market.win_probability(c("elo_gap"), F.lit(0.0), 0.0)
    upset, draw = c("pick") == -c("favorite"), c("pick") == 0
    dog_won, drawn = c("result") == -c("favorite"), c("result") == 0
    return {
        "A: underdog": (upset, dog_won, odds(p_dog)),
        "B: draw": (draw & (c("elo_gap") > 50), drawn, odds(F.lit(0.25))),
        "C: underdog or draw": (upset | draw & (c("elo_gap") > 80), F.when(upset, dog_won).otherwise(drawn), F.when(upset, odds(p_dog)).otherwise(odds(F.lit(0.25)))),
    }


def contrarian() -> list[Column]:
    """Bets at even odds wherever the model's pick is not Elo's: n, wins, pnl, roi. Needs pick, elo_pick, result."""
    apart = F.col("pick") != F.col("elo_pick")
    n, wins = F.count_if(apart), F.count_if(apart & (F.col("pick") == F.col("result")))
    return [n.alias("n"), wins.alias("wins"), (2 * wins - n).alias("pnl"), F.when(n > 0, (2 * wins - n) / n * 100).otherwise(0.0).alias("roi")]


def alpha_analysis() -> list[Column]:
    """Agreement with Elo, who wins the disagreements, upsets caught. Needs pick, elo_pick, result."""
    apart = F.col("pick") != F.col("elo_pick")
    miss = F.col("elo_pick") != F.col("result")
    right = F.col("pick") == F.col("result")
    return [
        F.count("*").alias("n"), F.count_if(~apart).alias("agree"), F.count_if(apart & right).alias("model_right"), F.count_if(apart & ~miss).alias("elo_right"),
        F.count_if(miss).alias("elo_missed"), F.count_if(miss & right).alias("upsets_caught"),
    ]


def tier_capture(f: DataFrame, edges: tuple[float, ...] = TIERS) -> DataFrame:
    """By tiers of the Elo gap: matches, upsets, draws, and those the pick caught."""
    tier = reduce(lambda c, i: c.when(F.col("elo_gap") < edges[i], i), range(1, len(edges)), F.when(F.col("elo_gap") < edges[0], 0)).otherwise(len(edges))
    hit = F.col("pick") == F.col("result")
    return f.groupBy(tier.alias("tier")).agg(
        F.count("*").alias("n"), F.count_if(F.col("upset") == 1).alias("upsets"), F.count_if((F.col("upset") == 1) & hit).alias("upsets_caught"),
        F.count_if(F.col("result") == 0).alias("draws"), F.count_if((F.col("result") == 0) & hit).alias("draws_caught"),
    )


def underdog_capture() -> list[Column]:
    """Recall, precision and false alarms of underdog picks. Needs favorite."""
    called, won = F.col("pick") == -F.col("favorite"), F.col("result") == -F.col("favorite")
    hits = F.count_if(called & won)
    ratio = lambda n: F.when(n > 0, hits / n).otherwise(0.0)
    return [F.count_if(won).alias("underdog_wins"), F.count_if(called).alias("called"), hits.alias("hits"), ratio(F.count_if(won)).alias("recall"), ratio(F.count_if(called)).alias("precision"), F.count_if(called & ~won).alias("false_alarms")]


def class_report(f: DataFrame, truth: str, pred: str, classes: list[int]) -> DataFrame:
    """(class, support, precision, recall, f1), 0 where undefined: one aggregation, then one row a class."""
    row = f.agg(*(x for k in classes for x in (
        F.count_if((F.col(truth) == k) & (F.col(pred) == k)).alias(f"tp_{k}"), F.count_if(F.col(pred) == k).alias(f"pp_{k}"), F.count_if(F.col(truth) == k).alias(f"p_{k}"))))
    each = row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("class"), F.col(f"tp_{k}").alias("tp"), F.col(f"pp_{k}").alias("pp"), F.col(f"p_{k}").alias("support")) for k in classes))).alias("s")).select("s.*")
    prec = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return each.select("class", "support", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def confusion(f: DataFrame, truth: str, pred: str) -> DataFrame:
    return f.groupBy(truth, pred).agg(F.count("*").alias("n"))


def error_severity(f: DataFrame, truth: str = "result", pred: str = "pick") -> DataFrame:
    return f.groupBy(F.abs(F.col(truth) - F.col(pred)).alias("off_by")).agg(F.count("*").alias("n"))


def goal_accuracy() -> list[Column]:
    """Mean absolute errors and exact counts. Needs hg, ag and pred_h, pred_a."""
    eh, ea = F.abs(F.col("hg") - F.col("pred_h")), F.abs(F.col("ag") - F.col("pred_a"))
    et = F.abs(F.col("hg") + F.col("ag") - F.col("pred_h") - F.col("pred_a"))
    return [F.avg(eh).alias("mae_home"), F.avg(ea).alias("mae_away"), F.avg(et).alias("mae_total"), F.count_if((eh == 0) & (ea == 0)).alias("exact"), F.count_if(et == 0).alias("exact_total")]


def scoreline_accuracy() -> list[Column]:
    """Of the likeliest scores: n, exact ones, outcomes they get right. Needs hg, ag, result, xg_home, xg_away."""
    h, a = market.likeliest_goals(F.col("xg_home")), market.likeliest_goals(F.col("xg_away"))
    return [F.count("*").alias("n"), F.count_if((F.col("hg") == h) & (F.col("ag") == a)).alias("exact"), F.count_if(F.signum(h - a) == F.col("result")).alias("outcome_right")]


def over_under_accuracy(f: DataFrame, lines=(1.5, 2.5, 3.5)) -> DataFrame:
    """(line, n, accuracy): one aggregation."""
    sums = []
    for i, line in enumerate(lines):
        right = ((F.col("hg") + F.col("ag")) > line) == ((F.col("pred_h") + F.col("pred_a")) > line)
        sums += [F.count("*").alias(f"n_{i}"), F.avg(right.cast("double")).alias(f"accuracy_{i}")]
    return _one_row_each(f.agg(*sums), [float(x) for x in lines], ("n", "accuracy"), "line")


def effect_sizes(f: DataFrame, features: list[str], correct: str = "correct") -> DataFrame:
    """(feature, mean_correct, mean_wrong, effect): difference of means over the sample deviation; one aggregation."""
    sums = []
    for i, x in enumerate(features):
        mean = lambda c: F.avg(F.when(c, F.col(x)))  # noqa: B023, E731
        sums += [mean(F.col(correct)).alias(f"mean_correct_{i}"), mean(~F.col(correct)).alias(f"mean_wrong_{i}"), F.stddev_samp(x).alias(f"sd_{i}")]
    out = _one_row_each(f.agg(*sums), features, ("mean_correct", "mean_wrong", "sd"), "feature")
    return out.select("feature", "mean_correct", "mean_wrong", F.when(F.col("sd") > 0, F.abs(F.col("mean_correct") - F.col("mean_wrong")) / F.col("sd")).alias("effect"))


def lopsided_listing(f: DataFrame, least: float) -> DataFrame:
    return f.where(F.col("elo_gap") >= least).orderBy(F.desc("elo_gap"), "match_id")


def source_coverage() -> list[Column]:
    """Rows with bookmakers' odds, and with odds made from ratings. Needs odds_source."""
    return [F.count("*").alias("n"), F.count_if(F.col("odds_source").startswith("oddsportal")).alias("bookmaker"), F.count_if(F.col("odds_source") == "elo_fallback").alias("fallback")]


def stable_sample(f: DataFrame, key: str, n: int = 25, seed: int = 42) -> DataFrame:
    """The same n rows on every run."""
    return f.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
