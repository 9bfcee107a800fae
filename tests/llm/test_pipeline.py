"""Quality rules and decontamination against their SQL on awkward rows, and all stages against plain versions of each."""

import base64
import hashlib
import os
import random
import re
import tempfile

import corpus_pipeline
import duckdb
import public_tokenizers as P
import pyarrow as pa
import pytest

from lotline.llm import decontaminate, quality
from test_line_dup import brute as brute_lines
from test_near_dup import brute_classes

BENCH = ["the answer to the first item is a long string of words that nobody else would write down here", "short item", "Twice twice twice twice twice twice twice", "", None]


def words(rnd, n):
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega"]) + rnd.choice("abcdefghij") + str(rnd.randrange(60)) for _ in range(n))


def corpus(seed=6):
    rnd = random.Random(seed)
    out = []
    for i in range(90):
        lines = [words(rnd, rnd.randrange(5, 30)) for _ in range(rnd.randrange(2, 6))]
        if i % 2:
            lines.insert(0, "Subscribe  to our newsletter about everything")
        if i % 9 == 0:
            lines.append(BENCH[0] if i % 2 else BENCH[0].replace("nobody", "no one"))
        if i % 11 == 0:
            lines.append("Twice twice twice twice twice twice twice twice # * $ %")
        out.append("\n".join(lines))
    out += [out[4], out[5], out[5] + " more", "", None, "one", "same same same " * 40, "\x0b\x0c \n\n", "x y z\nx y z\n" * 3]
    rows = [(i, t, "en", "host0" if i % 5 else None, len(t or "")) for i, t in enumerate(out)]
    return rows + [(None, words(rnd, 60), "en", "host0", 1), rows[7], rows[7]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, items, sql):
    con = duckdb.connect()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    documents = pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    con.register("documents", documents)
    con.register("benchmark", pa.table([pa.array([i for i, _ in items], pa.int64()), pa.array([t for _, t in items], pa.string())], ["item_id", "text"]))
    return sorted(con.sql(sql).fetchall(), key=repr)


@pytest.fixture
def low_limits(monkeypatch):
    """A limit that the fixture's boilerplate passes."""
    sql = quality.SQL.replace(f"> {quality.LINE_DOCUMENTS} ", "> 5 ")
    monkeypatch.setattr(quality, "frequent_lines", lambda rows, f=quality.frequent_lines: f(rows, 5))
    return sql


def test_quality_equals_sql(spark, low_limits):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", n_words int")
    got = quality.quality(docs)
    want = plain(rows, [], low_limits)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(r[-2] for r in want) and any(not r[-1] and not r[-3] for r in want + [(0, 0, False, 0, False)])
    assert quality.quality(docs.limit(0)).collect() == []


def test_decontamination_equals_sql(spark):
    rows, items = corpus(), list(enumerate(BENCH))
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", item_id int")
    bench = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, doc_id int")
    got = decontaminate.contaminated(docs, bench)
    want = plain(rows, items, decontaminate.SQL)
    long = sorted(((r["doc_id"], r["item_id"], r["start"], r["n_words"], r["similarity"]) for r in got.where("item_id <> 1").collect()), key=repr)
    assert long == want and len(want) > 8
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(docs.limit(0), bench).collect() == []
    short = spark.createDataFrame([(1, "a Short ITEM here"), (2, "short  items"), (3, "short")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.contaminated(short, bench).collect()] == [(1, 1, 1)]


def test_stages_equal_brute_force(spark, low_limits):
    import tiktoken

    rows, items = corpus(), list(enumerate(BENCH))[:1]
    with tempfile.TemporaryDirectory(dir="/tmp") as root:
        spark.createDataFrame(rows, SCHEMA).write.parquet(os.path.join(root, "documents.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(os.path.join(root, "benchmark.parquet"))
        got = sorted(((r["doc_id"], r["ids"], r["decoded_sha256"], r["n_tokens"]) for r in corpus_pipeline.run(spark, root).collect()), key=repr)

    verdict = {r[0]: r[-1] for r in plain(rows, [], low_limits)}
    boiler = "subscribe to our newsletter about everything"
    hosts = {h for h in {r[3] for r in rows} if sum(boiler in " ".join((r[1] or "").lower().split()) for r in rows if r[3] == h) > 5}
    left = {(r[0], "\n".join(x for x in r[1].split("\n") if not (r[3] in hosts and " ".join(x.lower().split()) == boiler))) for r in rows if verdict[r[0]]}
    left = brute_lines(sorted(left, key=repr))
    names = dict(brute_classes(left))
    left = [(d, t) for d, t in left if names[d] == d]
    hit = {r[0] for r in plain([(d, t, "en", "x", 0) for d, t in left], items, decontaminate.SQL)}
    left = [(d, t) for d, t in left if d not in hit]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(d, library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest(), len(library.encode_ordinary(t))) for d, t in left]
    assert got == sorted(want, key=repr) and 0 < len(want) < len(rows)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in (1, 2, 4, 5, 6, 8, 10)} <= {n.split("_")[0] for n in names}
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_boilerplate_of_distinct_documents_goes(spark):
    """One line, with the smallest hash of all, in 200 different documents of a host goes from each; in copies of one text it stays."""
    rnd = random.Random(9)
    line = "subscribe aaaaaaaaaaaaaaaaaaaaaaaaaaaa newsletter"
    rows = [(i, line + "\n" + words(rnd, 80), "en", "h", 1) for i in range(200)] + [(1000 + i, words(rnd, 80) + "\n" + words(rnd, 20), "en", "h", 1) for i in range(100)]
    rows += [(2000 + i, "copied line of a text\n" + "word " * 3 + words(random.Random(1), 80), "en", "h", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert all(got[i]["n_removed_words"] == 3 and got[i]["kept"] for i in range(200))
    assert all(got[i]["n_removed_words"] == 0 for i in got if i >= 1000)
    assert sorted((tuple(r) for r in got.values()), key=repr) == plain(rows, [], quality.SQL)


def test_parts_in_another_order_are_found(spark):
    """Item A B, documents with B A, with A B changed and with only A; every window by brute force."""
    rnd = random.Random(2)
    a, b = words(rnd, 30), words(rnd, 30)
    bench = [(7, f"{a} {b}"), (8, words(rnd, 60)), (9, f"{b} {a}"), (10, words(rnd, 25) + " " + " ".join(["again and again"] * 12))]
    rows = [(1, f"{words(rnd, 300)} {b} {a} {words(rnd, 40)}"), (2, f"{b} {a}"), (3, a), (4, f"{words(rnd, 9)} {a} {b[:-2]}"), (5, bench[3][1] + " " + bench[1][1] + " " + bench[3][1]),
            (6, words(rnd, 400)), (7, " ".join(f"{a} {b}".split()[4:]) + " " + words(rnd, 2))]
    rows = [(i, t, "en", "h", 1) for i, t in rows]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["start"], r["n_words"], r["similarity"]) for r in decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), items).collect()), key=repr)
    assert got == plain(rows, bench, decontaminate.SQL)

    def best(text, item):
        from collections import Counter

        grams = lambda w: Counter(" ".join(w[i : i + 5]) for i in range(len(w) - 4))
        w, want = text.split(), grams(item.split())
        n = len(item.split())
        scores = []
        for s in range(max(1, len(w) - n + 1)):
            have = grams(w[s : s + n])
            common = sum((have & want).values())
            scores.append(common / (sum(have.values()) + sum(want.values()) - common))
        return max(scores)

    whole = {(d, i): best(t, x) for d, t, *_ in rows for i, x in bench}
    assert {(d, i): s for d, i, _, _, s in got} == {k: v for k, v in whole.items() if v >= 0.8}
    assert {(1, 7), (2, 7), (1, 9), (5, 8), (5, 10)} <= {r[:2] for r in got}


def test_no_row_of_words_is_moved_when_tables_are_too_large_to_broadcast(spark, monkeypatch):
    """A row of words takes several times the memory of its text; windows are cut in the task that splits the text."""
    plans, stored, before = [], decontaminate.keep, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    mode = spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    monkeypatch.setattr(decontaminate, "keep", lambda df: plans.append(df._jdf.queryExecution().explainString(mode)) or stored(df))
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"before {item} after {item}", "en", "x", 9), (2, "nothing here", "en", "x", 9), (1, f"before {item} after {item}", "en", "x", 9)]
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), bench).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [(r["doc_id"], r["item_id"], r["start"], r["n_words"], r["similarity"]) for r in got] == [(1, 1, 1, 20, 1.0)]
    moved = [columns for plan in plans for columns in re.findall(r"\) (?:Exchange|Sort)\s*\nInput +\[\d+\]: \[(.*?)\]\n", plan)]
    assert not any("words#" in columns for columns in moved)
    assert any("text#" in columns for columns in moved)
