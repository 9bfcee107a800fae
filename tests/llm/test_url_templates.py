import random

import duckdb
from pyspark.sql import functions as F

from lotline.llm import url_templates as U

FIELDS = ("page_id", "host", "path", "rule", "verdict", "template")


def by_sql(rows):
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    if rows:
        db.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    found = db.sql(U.SQL)
    return sorted((tuple(dict(zip(found.columns, r))[c] for c in FIELDS) for r in found.fetchall()), key=repr)


def by_spark(spark, rows):
    pages = spark.createDataFrame([(i, u, "<p>", "x", 3) for i, u in rows], "page_id long, url string, html string, host string, n int").repartition(3)
    return sorted((tuple(r[c] for c in FIELDS) for r in U.judge(pages).collect()), key=repr)


def verdicts(rows):
    return {r[0]: r[3:5] for r in rows}


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "http://Example.ORG/es/x?q=1"), (2, "https://a.example.org/en/12"), (3, "http://example.org/en/2"), (4, "ftp://x.COM/fr/1#t"),
        (5, "x://com/de/"), (6, "http://com.de/de/"), (7, None), (8, "no scheme/fr/"), (9, ""), (10, "http://org"), (11, "http://org/"), (12, "http://notexample.org/es/"),
        (13, "http://a://b.com/fr/1"), (14, "http://h.com:80/fr/1"), (15, "http://ÄÖ.com/de/ü"), (None, "http://x.com/de/1"), (None, "http://x.com/de/1"), (16, "http://x.com?/fr/"),
        (17, "http://x.com/" + "a/" * 20_000), (18, "http://x.com/" + "b" * 300_000), (19, "http://q.net/\nline/2"),
    ]
    got = by_spark(spark, rows)
    assert got == by_sql(rows)
    v = {r[0]: r for r in got}
    assert v[1][1:5] == ("example.org", "/es/x", "example.org/es/", "block")
    assert v[2][3:5] == ("example.org/en/1", "block") and v[3][3:5] == ("org/", "allow")
    assert v[4][1:5] == ("x.com", "/fr/1", "com/fr/", "allow") and v[5][3:5] == ("com/de/", "block") and v[6][3] is None
    assert v[7][1:4] == v[8][1:4] == v[9][1:4] == ("", "", None)
    assert v[10][1:4] == ("org", "", None) and v[11][3:5] == ("org/", "allow") and v[12][3:5] == ("org/", "allow")
    assert v[13][1:4] == ("a:", "//b.com/fr/1", None) and v[14][1:4] == ("h.com:80", "/fr/1", None)
    assert v[16][1:4] == ("x.com", "", None) and len([r for r in got if r[0] is None]) == 2
    assert by_spark(spark, []) == []


def test_templates_carry_labels(spark):
    """Two sections of a host with like contents: in one host most labelled pages are blocked, in the other few."""
    rows, page = [], 0
    for host, blocked in (("bad.com", 0.95), ("good.com", 0.05)):
        for k in range(400):
            section = "de" if k / 400 < blocked else "fr"
            rows.append((page := page + 1, f"http://{host}/{section}/{k}"))
        rows += [(page := page + 1, f"http://{host}/en/{k}") for k in range(400)]
    got = by_spark(spark, rows)
    assert got == by_sql(rows)
    free = [r for r in got if r[3] is None]
    assert len(free) == 800 and all(r[4] == ("block" if r[1] == "bad.com" else "allow") for r in free)
    assert {r[5] for r in free} <= {"(*)/(*)", "en/{0}", "(*)/{0}", "en/(*)"}


def test_branches_merge_only_when_alike(spark):
    rng = random.Random(3)
    rows, page = [], 0
    for section in ("a1", "a2", "a3"):
        rows += [(page := page + 1, f"http://h.net/{section}/{rng.choice(['new', 'old'])}/{rng.randrange(10**6)}") for _ in range(300)]
    rows += [(page := page + 1, f"http://h.net/other/tag/x{k}y") for k in range(300)]
    got = by_spark(spark, rows)
    assert got == by_sql(rows)
    assert any(r[5].startswith("other/") for r in got) and not any(r[5].startswith("(*)/tag") for r in got)


def test_hot_keys_are_dealt(spark, tmp_path):
    rows = [(i, "http://hot.com/de/1") for i in range(3000)] + [(i, f"http://h{i}.com/en/{i}") for i in range(500)]
    assert by_spark(spark, rows) == by_sql(rows)
    left = spark.createDataFrame([(i, "a" if i % 3 else f"k{i}") for i in range(3000)], "v long, k string")
    left.write.parquet(str(tmp_path / "left"))
    left = spark.read.parquet(str(tmp_path / "left"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    assert sorted(map(tuple, U.dealt_join(left, right, ["k"], "n").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "v", "n", "m").collect()))
