import random

import duckdb
from pyspark.sql import functions as F

from tests.llm.cases import write_tables
from vespertide.llm import urlfilter
from vespertide.llm.urlfilter import OP12_SQL, RULES, judged, op12_url_filters

ODD = [None, "", "no scheme", "http://", "://", "x://HOST.Com", "http://example.com", "http://example.com/en/", "http://www.EXAMPLE.com/en/a?q=/es/", "http://a.b.example.com/en/x#y", "http://net/es/", "http://x.net/es", "http://x.net./es/", "a://b://c.net/fr/", "http://u:p@x.net:80/fr/\n/z", "http://" + "a." * 2000 + "net/es/" + "s/" * 4000, "https://ÉXAMPLE.com/en/", "http://examplecom/en/"]


def want(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else None
    return host, path, best and best[3], best[2] if best else otherwise


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, rule string")


def held(spark, urls, rules):
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged(pages_of(spark, urls), table).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == want(u, rules), u


def test_odd_urls(spark):
    held(spark, ODD, RULES)


def test_random_rules_also_those_that_end_inside_a_segment(spark):
    rng = random.Random(1)
    hosts = ["a", "b.a", "c.b.a", "d.c.b.a", "b", "ab.a"]
    paths = ["", "/", "/x", "/x/", "/xy", "/x/y", "/x/y/", "/x//", "/xyz/x"]
    rules = sorted({(rng.choice(hosts), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(25)}.items())
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'x', '/x', '?/x/', '/'])}" for _ in range(400)]
    held(spark, urls, [(h, p, v) for (h, p), v in rules])


def test_many_rules_and_hot_urls(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 1)
    monkeypatch.setattr("vespertide.llm.common.HOT_ROWS", 20)
    held(spark, ODD + ["http://www.example.com/en/1"] * 100 + [f"http://h{i}.net/es/{i}" for i in range(60)], RULES)


def test_more_hot_keys_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr("vespertide.llm.common.HOT_ROWS", 2)
    monkeypatch.setattr("vespertide.llm.common.MOST_HOT_KEYS", 3)
    held(spark, [f"http://h{i % 9}.net/es/" for i in range(90)], RULES)


def test_block_wins_for_one_rule_given_twice_and_nulls_fit_nothing(spark):
    rules = spark.createDataFrame([("A.b", "/", "allow"), ("a.B", "/", "block"), (None, "/", "block"), ("c", None, "block"), ("d", "/", None)], "host string, path string, verdict string")
    got = judged(pages_of(spark, ["x://a.b/", "x://c/", "x://d/", None]), rules).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == ["block", "allow", "allow", "allow"]


def test_no_rules_and_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {(r["rule"], r["verdict"]) for r in judged(pages_of(spark, ODD), none, otherwise="block").collect()} == {(None, "block")}
    empty = pages_of(spark, ["x"]).limit(0)
    assert op12_url_filters(spark, write_tables(tmp_path / "none", pages=empty)).count() == 0


def test_sql_on_odd_urls(spark, tmp_path):
    path = write_tables(tmp_path / "odd", pages=pages_of(spark, ODD).coalesce(1).withColumn("html", F.lit(None).cast("string")))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/pages.parquet/*.parquet')")
    rows = sorted(map(repr, con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({OP12_SQL})").fetchall()))
    assert rows == sorted(repr(tuple(r)) for r in op12_url_filters(spark, path).collect())
