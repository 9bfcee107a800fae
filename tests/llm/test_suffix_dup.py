import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lotline.llm import suffix_dup


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in data for k in range(len(t) - length + 1))
    out = []
    for i, t in data:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        left = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(2, 9)))
    passage = [" ".join(word() for _ in range(rnd.randrange(30, 80))) for _ in range(8)]
    out = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(rnd.randrange(1, 60))) for _ in range(rnd.randrange(1, 4))]
        if k % 2:
            own = rnd.choice(passage)
            low = rnd.randrange(0, 60)
            parts.insert(rnd.randrange(len(parts) + 1), own[low : low + rnd.randrange(150, 420)])
        out.append("".join(parts))
    out += [out[1], out[1], out[3] + "x", out[5][7:], "ab" * 400, "ab" * 150 + "c", "z" * 199, "z" * 200, "y" * 201, "", None, passage[0] * 2, out[7] * 3]
    return list(enumerate(out)) + [(None, out[9]), (2, out[2]), (2, out[2])]


@pytest.mark.parametrize(("length", "anchor", "chars"), [(200, 64, 6_000_000), (200, 64, 3000), (60, 20, 9000)])
def test_equals_brute_force(spark, monkeypatch, length, anchor, chars):
    monkeypatch.setattr(suffix_dup, "BLOCK_CHARS", chars)
    monkeypatch.setattr(suffix_dup, "AT_ONCE", chars)
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in corpus()], "doc_id long, text string, n_bytes int, block string")
    got = suffix_dup.repeated_bytes(docs, length, anchor).drop("kept").collect()
    want = brute(corpus(), length)
    assert sorted(map(tuple, got), key=repr) == want
    assert sum(r[2] > 0 for r in want) > 20


def test_no_rows(spark):
    assert suffix_dup.repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_string_has_an_anchor():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    starts = np.array([0, 5, 700, 900, 1099, 3000])
    of, places = suffix_dup.anchors(data, starts, 200, 64)
    inside = [any(s <= i and i + 200 <= e for s, e in zip(starts[:-1], starts[1:])) for i in range(len(of))]
    assert ((of > 0) == inside).all() and set(of[of > 0]) == set(places)


def test_copies_are_one_text_whatever_their_ids(spark):
    """No task gets a text twice, if ids are null or leave the same remainder, and every copy has its row."""
    copy, other = "one text in many copies " * 20, "x" * 250
    rows = [(None, copy)] * 300 + [(4 * k, copy) for k in range(300)] + [(1, other), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    placed = suffix_dup.collapsed(suffix_dup.texts(docs), 3).collect()
    assert sorted((r.text, r.copies) for r in placed) == [("", 1), (copy, 600), (other, 1)]
    got = suffix_dup.repeated_bytes(docs).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 200)


def test_texts_are_moved_once(spark):
    rows = spark.createDataFrame([(i, "same" if i % 3 else f"text {i}") for i in range(90)], "doc_id long, text string")
    placed = suffix_dup.collapsed(rows, 4)
    assert {r["text"]: r["copies"] for r in placed.collect()} == {"same": 60, **{f"text {i}": 1 for i in range(0, 90, 3)}}
    by_block = placed.groupBy("block").applyInArrow(lambda t: t.select(["block"]).slice(0, 1), "block int")
    assert by_block._jdf.queryExecution().sparkPlan() and by_block._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
