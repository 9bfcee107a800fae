import random
from fractions import Fraction

import numpy as np
import pytest

from lotline.llm import graph, near_dup


def shingled(text, k=5):
    words = (text or "").lower().split()
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    return {r: runs.count(r) for r in runs}


def plain_jp(a, b):
    total = Fraction(0)
    for d in a.keys() & b.keys():
        total += 1 / sum(max(Fraction(a.get(e, 0), a[d]), Fraction(b.get(e, 0), b[d])) for e in a.keys() | b.keys())
    return total


def brute_classes(rows, threshold=Fraction(8, 10)):
    sets = [shingled(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and (rows[i][1] == rows[j][1] or plain_jp(sets[i], sets[j]) >= threshold):
                up[max(find(i), find(j))] = min(find(i), find(j))
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            names[find(i)] = min(names.get(find(i), doc_id), doc_id)
    return sorted(((d, names.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(n=60, seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.6:
            words = rnd.choice(out).split()
            for _ in range(rnd.randrange(0, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rnd.choices(vocabulary, k=rnd.randrange(20, 90))))
    return out + ["", None, "one two", "One  two", "a b c d e", "spam " * 40, "spam " * 41 + "x", " \n "]


@pytest.mark.parametrize("blocks", [300_000, 200])
def test_classes_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(graph, "BLOCK_FEATURES", blocks)
    rows = list(enumerate(corpus())) + [(0, corpus()[0]), (None, "null id but a text here"), (None, corpus()[1])]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, size int, key string")
    got = sorted(((r["doc_id"], r["class_id"]) for r in near_dup.classes(docs).collect()), key=repr)
    assert got == brute_classes(rows)


def test_no_rows(spark):
    assert near_dup.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_registers_estimate_probability_jaccard():
    a, b = " ".join(f"w{i % 37}" for i in range(90)), " ".join(f"w{i % 41}" for i in range(80))
    doc, feature, weight = near_dup.weighted_shingles([a, b])
    signature = near_dup.prob_minhash(doc, feature, weight, 2, 6000)
    assert abs((signature[0] == signature[1]).mean() - float(plain_jp(shingled(a), shingled(b)))) < 0.03


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, 1000) for i in range(1001, 1200)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = dict.fromkeys(range(1200))
    groups = {i: {i} for i in range(1200)}
    for a, b in links:
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for x in groups[b]:
                groups[x] = groups[a]
    want = {x: min(g) for x, g in groups.items() if len(g) > 1}
    assert {k: v for k, v in got.items()} == want


def test_exact_probability_jaccard():
    rnd = np.random.default_rng(0)
    for _ in range(50):
        a, b = rnd.integers(0, 4, 12).astype(float), rnd.integers(0, 4, 12).astype(float)
        want = plain_jp({i: int(x) for i, x in enumerate(a) if x}, {i: int(x) for i, x in enumerate(b) if x})
        assert abs(graph.probability_jaccard(a, b) - float(want)) < 1e-9


def test_texts_of_two_blocks_are_compared_across_and_only_where_a_bound_allows(monkeypatch):
    """Same pairs as by all features at once, but these are compared only within groups that can be similar."""
    rnd = np.random.default_rng(3)
    families = [rnd.integers(0, 2**63, 120, dtype=np.uint64) for _ in range(5)]
    rows = []
    for k in range(300):
        own = families[k % 5].copy()
        own[rnd.integers(0, 120, k % 40)] = rnd.integers(0, 2**63, k % 40, dtype=np.uint64)
        rows.append(np.unique(own))
    doc, feature = np.repeat(np.arange(300), [len(r) for r in rows]), np.concatenate(rows)
    names = lambda found: {tuple(sorted(p)) for p in found.tolist()}
    for weight in (np.ones(len(doc)), np.where(feature % np.uint64(50) == 0, 2.0, 1.0)):
        sizes, plain = [], graph._similar
        want = names(plain(doc, feature, weight, 300, 0.8))
        monkeypatch.setattr(graph, "_similar", lambda d, f, w, n, t: sizes.append(n) or plain(d, f, w, n, t))
        assert names(graph.similar(doc, feature, weight, 300, 0.8)) == want and len(want) > 500
        side = np.arange(300) % 2 == 0
        across = names(graph.similar(doc, feature, weight, 300, 0.8, side))
        assert {p for p in want if side[p[0]] != side[p[1]]} <= across <= want
        assert max(sizes) <= 60
        monkeypatch.setattr(graph, "_similar", plain)
