import os
import random

import pytest
from matchgrid.llm import common
from matchgrid.llm.common import connected_components, free_name
from matchgrid.llm.queries import QUERIES


def _brute(edges):
    head = {x: x for e in edges for x in e}

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        head[max(p, q)] = min(p, q)
    return {x: top(x) for x in head}


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)] + [(i, 500) for i in range(480, 500)]
    loose = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    edges = [(a, b) for a, b in chain + star + loose if a != b]
    rng.shuffle(edges)
    got = connected_components(spark.createDataFrame([*edges, (7, 7), (None, 3)], "u long, v long"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and dict(rows) == _brute(edges)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_free_names(spark):
    df = spark.createDataFrame([], "a int, A_x int, _b int")
    assert [free_name(df, c) for c in ("A", "c", "_b")] == ["_A", "c", "__b"]


def test_a_session_must_name_its_shared_folder():
    class Conf:
        get = staticmethod(lambda key, default: default)

    class Session:
        conf = Conf

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_release_frees_all_that_an_operator_made(spark, sf):
    """Also folders that its result only points to, such as archives and their index; another result's stay."""
    with common.recording() as others:
        other = QUERIES["op2_warc"](spark, sf)
    with common.recording() as paths:
        result = QUERIES["op2_warc"](spark, sf)
    there = lambda ps: [p for p in ps if os.path.exists(p.removeprefix("file://"))]
    n = result.count()
    assert {p.rsplit("/", 1)[-1].split("-")[0] for p in there(paths)} >= {"archives", "index", "top"}
    common.release(result)
    assert not there(paths) and there(others) and other.count() == n
    common.release(other)
    assert not there(others)
