import copy
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from lotline.llm import language_model as lm


def corpus(n=120, seed=5):
    rnd = random.Random(seed)
    pool = ["the", "of", "Anner", "tion", "réelle", "ß", "x", "Straße.", "under", "it's"]
    out = [(i, rnd.choice([" ", "\n", "\t "]).join(rnd.choice(pool) + rnd.choice(["", "ing", "ed"]) for _ in range(rnd.randrange(0, 120)))) for i in range(n)]
    return out + [(n, None), (n + 1, ""), (n + 2, "  \x0b É"), (None, "no id here"), out[3], (n + 3, "word " * 9000)]


def test_base_equals_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_CHARS", 9000)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, n_known int, score double")
    got = lm.score(docs, sample=40).collect()
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]) for i, t in rows]
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, ws in tokens if not fold(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, fold(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in ws)) for i, ws in tokens), key=repr)
    rows = sorted((tuple(r) for r in got), key=lambda r: repr(r[:6]))
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert all(abs(r[5] - w[5]) < 1e-6 * max(1, abs(w[5])) for r, w in zip(rows, want))
    assert all(r[6] < 0 for r in rows)
    long = [r for r in rows if r[1] and r[2] > 30]
    assert sum(r[6] for r in long) > sum(lm_uniform(r) for r in long)


def lm_uniform(row):
    return -row[2] * 3 * math.log10(lm.GROUPS * lm.PLACES)


def test_no_rows(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_subwords_give_the_words_back():
    pieces = lm.Pieces.of(P.path("byte_bpe_multi_50k.tiktoken"))
    values = [(t or "") for _, t in corpus(30)]
    ids, starts = lm.Block(values).subwords(pieces)
    for text, s, e in zip(values, starts[:-1], starts[1:]):
        assert ids[e - 1] == lm.END
        back = b"".join(pieces.tokens[i] for i in ids[s : e - 1]).decode()
        assert back == "".join(" " + w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))


@pytest.fixture(scope="module")
def fitted():
    values = [(t or "") for _, t in corpus(40)]
    return lm.Model().fit(*lm.Block(values).subwords(lm.Pieces.of(P.path("byte_bpe_multi_50k.tiktoken"))))


def test_windows_score_every_id_once(fitted):
    rng = np.random.default_rng(0)
    starts = np.concatenate([[0], np.cumsum([1, 2, lm.WINDOW - 1, lm.WINDOW, lm.WINDOW + 1, 100, 257])])
    ids = rng.integers(0, 500, starts[-1]).astype(np.int32)
    got = fitted.score(ids, starts)
    for k, (s, e) in enumerate(zip(starts[:-1], starts[1:])):
        own, total = ids[s:e], 0.0
        for t in range(len(own)):
            low = 0 if t < lm.WINDOW else ((t - lm.WINDOW) // (lm.WINDOW - lm.CONTEXT) + 1) * (lm.WINDOW - lm.CONTEXT)
            seen = np.concatenate([[lm.BEGIN], own])[low : t + 1]
            pad = np.zeros(lm.WINDOW, np.int64)
            pad[: len(seen)] = seen
            h = fitted.hidden(pad[None])[0][0, len(seen) - 1]
            total += float(fitted.log_probabilities(h[None], own[t : t + 1])[0][0])
        assert abs(total / math.log(10) - got[k]) < 1e-3 * max(1, abs(got[k]))


def test_probabilities_sum_to_one(fitted):
    h = fitted.hidden(np.arange(lm.WINDOW)[None])[0][0]
    every = np.arange(lm.GROUPS * lm.PLACES)
    assert abs(np.exp(fitted.log_probabilities(np.repeat(h[5:6], len(every), axis=0), every)[0]).sum() - 1) < 1e-3


def test_slopes_equal_differences():
    model = lm.Model(3)
    rng = np.random.default_rng(1)
    model.parts = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in model.parts.items()}
    inputs, target = rng.integers(0, 90, (2, lm.WINDOW)), rng.integers(0, 90, (2, lm.WINDOW))
    good = rng.random((2, lm.WINDOW)) < 0.7
    slopes = model.slopes(inputs, target, good)
    loss = lambda: -model.log_probabilities(model.hidden(inputs)[0][good], target[good])[0].mean()
    for name, part in model.parts.items():
        at = np.unravel_index(np.argmax(np.abs(slopes[name])), part.shape)
        part[at] += 1e-4
        up = loss()
        part[at] -= 2e-4
        down = loss()
        part[at] += 1e-4
        assert abs((up - down) / 2e-4 - slopes[name][at]) < 1e-3 * max(1, abs(slopes[name][at])), name


def test_attention_learns_from_every_training_text(spark, monkeypatch):
    """The 500 texts with the smallest hash of doc_id hold nothing of the topic of the others."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(lm, "BLOCK_CHARS", 30_000)
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    ids = [r[0] for r in spark.range(1500).orderBy(F.xxhash64("id")).collect()]
    train, held = [i for i in ids if not fold(i)], [i for i in ids if fold(i)][:20]
    rnd = random.Random(4)
    plain = lambda: " ".join(rnd.choice(["the", "under", "of", "is"]) for _ in range(30))
    topic = lambda: "zq wv kj qx " * 20
    rows = [(i, plain()) for i in train[:500]] + [(i, topic()) for i in train[500:900]] + [(i, topic()) for i in held]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    total = lambda df: sum(r.score for r in df.where("held_out").collect())
    whole = total(lm.score(docs))
    assert whole > 0.8 * total(lm.score(docs, sample=500))
    assert abs(whole - total(lm.score(docs.repartition(7)))) < 1e-6 * abs(whole)


def test_places_of_context_need_no_hidden_rows(monkeypatch):
    """All but a text's first window are fitted from WINDOW - CONTEXT hidden rows, equal to those of the whole window; each id is learned once a pass."""
    rng = np.random.default_rng(2)
    starts = np.concatenate([[0], np.cumsum([1, 30, 500, 24, 900])])
    ids = rng.integers(0, 300, starts[-1]).astype(np.int32)
    whole, made, learned = lm.Model.hidden, [], []
    plain = lm.Model.log_probabilities

    def hidden(self, inputs, *low):
        out = whole(self, inputs, *low)
        assert np.allclose(out[0], whole(self, inputs)[0][:, -out[0].shape[1] :], atol=1e-6)
        made.extend([out[0].shape[1]] * len(inputs))
        return out

    monkeypatch.setattr(lm.Model, "hidden", hidden)
    monkeypatch.setattr(lm.Model, "log_probabilities", lambda self, h, target, slopes=None: (learned.extend(target), plain(self, h, target, slopes))[1])
    lm.Model().fit(ids, starts, 1)
    assert Counter(made) == {lm.WINDOW: len(starts) - 1, lm.WINDOW - lm.CONTEXT: len(lm.windows(starts)[0]) - len(starts) + 1}
    assert Counter(learned) == Counter(ids)


def test_weights_beyond_the_range_of_exponentials():
    small = lm.Model(3)
    rng = np.random.default_rng(1)
    small.parts = {k: (v + rng.normal(0, 2, v.shape)).astype(np.float32) * np.float32(3) for k, v in small.parts.items()}
    large = copy.deepcopy(small)
    large.parts = {k: v.astype(np.float64) for k, v in small.parts.items()}
    inputs, target = rng.integers(0, 90, (3, lm.WINDOW)), rng.integers(0, 90, (3, lm.WINDOW))
    h = large.hidden(inputs)[0].reshape(-1, lm.WIDTH)
    assert np.abs(h @ large.parts["group"]).max() > 90
    got, want = (m.log_probabilities(h.astype(m.parts["q"].dtype), target.ravel())[0] for m in (small, large))
    assert np.allclose(got, want, rtol=1e-4, atol=1e-2)
    assert np.allclose(small.hidden(inputs)[0].reshape(h.shape), h, rtol=1e-2, atol=0.3)
    assert all(np.isfinite(g).all() for g in small.slopes(inputs, target, np.ones(inputs.shape, bool)).values())
