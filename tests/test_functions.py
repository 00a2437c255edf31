import random

import pytest
from matchgrid.functions import dates, market, nested, numbers, text
from pyspark.sql import functions as F


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_names(spark):
    assert text.fold_ascii("Đorđe  Ćirić ßtraße Ødegård") == "Dorde Ciric sstrasse Odegard"
    assert one(spark, text.name_key(F.lit("  A  B ")), text.strip_ordinal(F.lit("12. Name")), text.primary_position(F.lit("fw, MF"))) == ("a b", "Name", "FW")
    entries = one(spark, text.squad_entries(F.lit("Ann Lee (Club A, on loan), Bo Li (Club B)")))[0]
    assert entries == ["Ann Lee (Club A, on loan)", "Bo Li (Club B)"]
    assert one(spark, text.entry_name(F.lit(entries[0])), text.entry_club(F.lit(entries[0])), text.entry_club(F.lit("x"))) == ("Ann Lee", "Club A", None)
    assert one(spark, text.number(F.lit(" 1,234.5")), text.whole(F.lit("1,234")), text.number(F.lit("n/a"))) == (1234.5, 1234, None)
    assert text.flat_names([("Unnamed: 0", "Player"), ("A", "Gls"), ("B", "Gls")]) == ["Player", "Gls", "B_Gls"]
    assert text.header_like(["Squad", "Goals For"], ["gls", "goals"]) == "Goals For"
    assert one(spark, text.first_class(F.lit("Serie A"), [("it", ["serie"]), ("x", ["a"])], "none"), text.contains_either(F.lit("ab"), F.lit("xabx")), text.before_label(F.lit("Jo Goalkeeper 1"), ["Goalkeeper"])) == ("it", True, "Jo")


def test_dates(spark):
    d = lambda t: F.date_format(dates.match_date(F.lit(t)), "yyyy-MM-dd")
    assert one(spark, d("05/08/2023"), d("5/8/23"), d("2023-08-05"), d("32/01/23")) == ("2023-08-05", "2023-08-05", None, None)
    assert one(spark, *(dates.previous_season(F.lit(c)) for c in ("2324", "0001", "9900", "2325", "x"))) == ("2022-2023", "1999-2000", "2098-2099", "2021-2022", "2021-2022")
    assert [tuple(r) for r in one(spark, dates.season_weights(F.lit("2022-2023")))[0]] == [("2020-2021", 0.3), ("2021-2022", 0.5), ("2022-2023", 1.0)]
    assert str(one(spark, dates.utc_time(F.lit("2018-06-22 08:00:00 UTC")))[0]) == "2018-06-22 08:00:00"


def test_numbers(spark):
    assert one(spark, numbers.per90(F.lit(3), F.lit(270)), numbers.per90(F.lit(3), F.lit(0)), numbers.half_even(F.lit(2.5)), numbers.truncated(F.lit(-1.7))) == (1.0, 0.0, 2.0, -1)
    third = F.lit(1 / 3)
    assert one(spark, F.round(numbers.entropy(third, third, third), 9), numbers.entropy(F.lit(1.0), F.lit(0.0), F.lit(0.0)), numbers.top_margin(F.lit(0.5), F.lit(0.2), F.lit(0.3))) == (1.0, 0.0, 0.2)
    assert one(spark, numbers.xg_proxy(F.lit(2), F.lit(5)), numbers.xg_proxy(F.lit(None).cast("int"), F.lit(None).cast("int"))) == (pytest.approx(0.76), None)
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 0.0)], "a double, b double")
    got = numbers.interactions(df, [("diff", "a", "b"), ("ratio", "a", "b"), ("square", "a", "")]).collect()
    assert [tuple(r)[2:] for r in got] == [(1.0, 0.5, 1.0), (3.0, 3000.0, 9.0)]
    with pytest.raises(ValueError):
        numbers.interactions(df, [("diff", "a", "zz")])
    assert sorted(r["a"] for r in numbers.z_scores(df, ["a"]).collect()) == [-1.0, 1.0]
    assert numbers.upper_median(spark.createDataFrame([("k", v) for v in (4, 1, 3, 2)], "k string, v int"), ["k"], ["v"]).first()["v"] == 3


def test_market_cells(spark):
    cell = "[{'1': '2.5', 'X': '3.1', '2': None, 'bookmaker_name': 'Other', 'period': 'FT'}, {'1': '2.4', 'X': '3.0', '2': '2.9', 'bookmaker_name': 'Betway', 'period': 'FT'}]"
    assert tuple(one(spark, nested.market_odds(F.lit(cell)))[0]) == (2.4, 3.0, 2.9, "Betway")
    assert one(spark, nested.market_odds(F.lit("[]")), nested.market_odds(F.lit("junk"))) == (None, None)


def test_stints(spark):
    rows = [([("00:00", "45:30", "x"), ("60:00", None, "x")],), ([],), ([("bad", "50:00", "x")],), (None,)]
    df = spark.createDataFrame(rows, "p array<struct<`from`:string,`to`:string,position:string>>")
    assert [tuple(r) for r in df.select(nested.stint_minutes(F.col("p")), nested.started(F.col("p"))).collect()] == [(75, True), (0, False), (0, False), (0, False)]


def test_probabilities(spark):
    p = market.outcome_probabilities(F.lit(1600.0), F.lit(1500.0))
    assert sum(one(spark, *p.values())) == pytest.approx(1)
    m = market.score_matrix(spark.range(1).select(F.lit(1.4).alias("h"), F.lit(1.1).alias("a")), "h", "a")
    got = m.agg(F.sum("p"), *market.outcome_sums(), *market.over_under(2.0)).first()
    assert got[0] == pytest.approx(1) and got[1] > got[3] and got[1] + got[2] + got[3] == pytest.approx(1) and got[4] + got[5] == pytest.approx(1)
    assert one(spark, market.argmax_outcome(F.lit(0.4), F.lit(0.2), F.lit(0.4)), market.argmax_outcome(F.lit(0.4), F.lit(0.2), F.lit(0.4), (-1, 0, 1))) == (1, -1)
    assert one(spark, market.score_odds(F.lit(0.0)), market.profit(F.lit(True), F.lit(2.5)), market.profit(F.lit(False), F.lit(2.5))) == (250.0, 1.5, -1.0)


def test_values_at_ranks_are_exact_however_many(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(numbers, "FEW", 40)
    rows = [("unique", rng.random() * 10 ** rng.randint(-8, 8)) for _ in range(3000)]
    rows += [("ties", float(rng.choice([1, 1, 1, 2, 3]))) for _ in range(2000)] + [("mixed", rng.choice([5.0, rng.random()])) for _ in range(2500)]
    rows += [(None, float(i)) for i in range(501)] + [("few", 3.0), ("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(5)
    ranks = {"first": F.lit(0), "upper": F.floor(F.col("n") / 2), "last": F.col("n") - 1, "third": F.floor(F.col("n") / 3)}
    got = {(r["g"], r["name"]): r["value"] for r in numbers.values_at(df, ["g"], ranks).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        v = sorted(x for k, x in rows if k == g and x is not None)
        if v:
            want |= {(g, "first"): v[0], (g, "upper"): v[len(v) // 2], (g, "last"): v[-1], (g, "third"): v[len(v) // 3]}
    assert got == want
    assert numbers.values_at(df.limit(0), ["g"], ranks).count() == 0
