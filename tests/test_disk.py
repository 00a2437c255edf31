"""What the match tables shuffle where only the smallest sides are broadcast, as at sizes where customers no longer are."""

import re
from collections import Counter

import pytest
from matchgrid.plans import base, registry


@pytest.fixture()
def few_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _shuffled_by(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return Counter(re.findall(r"Exchange hashpartitioning\((\w+)#", plan))


def test_line_items_are_shuffled_by_order_alone(spark, few_broadcasts):
    by = _shuffled_by(base.games(spark, "/root/testdata/sf0.01"))
    assert {k: by[k] for k in ("l_orderkey", "o_orderkey", "o_custkey", "c_custkey")} == dict.fromkeys(("l_orderkey", "o_orderkey", "o_custkey", "c_custkey"), 1)
    # ratings are added up by team; games themselves are not dealt by team or nation
    assert not set(by) - {"l_orderkey", "o_orderkey", "o_custkey", "c_custkey", "team", "n_name"}


def test_poisson_glm_joins_the_games_once(spark, sf):
    got = registry.QUERIES["q48_poisson_glm"](spark, sf)
    assert got.inputFiles() and all("/games-" in f for f in got.inputFiles())
    games = base.games(spark, sf).selectExpr("concat_ws('-', k, pk, sk, cast(floor(xp) as string)) as id").distinct().count()
    assert got.first()["n"] == games
