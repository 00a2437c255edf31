import duckdb
import pytest
from matchgrid.llm import warc
from matchgrid.llm.common import new_path


def _query(spark, pages):
    archives, folder = new_path(spark, "a"), new_path(spark, "i")
    manifest = warc.write_archives(pages, archives)
    top = warc.build_index(manifest, folder, block_rows=3)
    return manifest, archives, folder, top


def test_query_matches_sql(spark, sf):
    got = warc.op2_warc(spark, sf).toPandas().sort_values("page_id").reset_index(drop=True)
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = db.execute(warc.OP2_SQL).df().sort_values("page_id").reset_index(drop=True)
    assert got.astype(object).where(got.notna(), None).astype(str).equals(want[got.columns].astype(object).where(want[got.columns].notna(), None).astype(str))


def test_revisits_nulls_and_ties(spark):
    big = "é" * 600
    rows = [(1, "http://www.A.example/x?q=1", big), (2, "https://b.example:8443", big), (3, None, big), (4, "http://a.example/x?q=1", "small"), (5, "http://a.example/x?q=1", "small"),
            (6, "ht tp://[bad\r\nurl%", None), (7, "http://a.example/x?q=1", ""), (None, "http://c.example/", big), (9, "http://d.example/", "WARC/1.1\r\n\r\n" * 200)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    manifest, archives, folder, top = _query(spark, pages)
    got = {r["page_id"]: r for r in warc.lookup(manifest.select("skey"), archives, folder, top, payloads=True).collect()}
    assert len(got) == len(rows)
    assert {k: r["refers_to"] for k, r in got.items() if r["record_type"] == "revisit"} == {1: 3, 2: 3}
    assert got[1]["payload_bytes"] == 1200 and bytes(got[3]["payload"]).decode() == big and got[6]["payload_bytes"] == 0
    assert bytes(got[9]["payload"]).decode() == "WARC/1.1\r\n\r\n" * 200
    assert {k: r["url"] for k, r in got.items()} == {p: u or "" for p, u, _ in rows}


def test_lookup_finds_keys_and_misses_the_rest(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 5}.example/p", f"text {i}") for i in range(40)], "page_id long, url string, html string")
    manifest, archives, folder, top = _query(spark, pages)
    keys = [warc.sort_key("http://h2.example/p", 7), warc.sort_key("http://h2.example/p", 8), warc.sort_key("http://zz.example/", 1), warc.sort_key("", 1)]
    found = warc.lookup(spark.createDataFrame([(k,) for k in keys], "skey string"), archives, folder, top).collect()
    assert [(r["page_id"], r["url"]) for r in found] == [(7, "http://h2.example/p")]


def test_long_payloads_and_repeated_pages(spark):
    big = "é<p>" * 1_000_000
    rows = [(1, "http://a.example/", big), (2, "http://a.example/", big), (2, "http://a.example/", big), (3, "http://a.example/", None), (3, "http://a.example/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest, archives, folder, top = _query(spark, pages)
    got = warc.lookup(manifest.select("skey"), archives, folder, top).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in got) == [(1, 5_000_000, "revisit", 2), (2, 5_000_000, "response", 0), (2, 5_000_000, "response", 0), (3, 0, "response", 0), (3, 0, "response", 0)]


def test_empty_table(spark):
    manifest, archives, folder, top = _query(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.lookup(manifest.select("skey"), archives, folder, top).count() == 0


@pytest.mark.parametrize("url,key", [("http://www.a.example/p?Q", "example,a)/p?q"), ("https://b.a.example:444", "example,a,b:444)/"), (None, ")"), ("no host", ")no host")])
def test_url_keys(url, key):
    assert warc.url_key(url) == key
