import base64
import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from lotline.llm import secrets
from lotline.llm.common import keep

BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base_spans(text):
    out = [(m.start(), k, m.end()) for k, (_, pattern, good) in enumerate(BASE) for m in pattern.finditer(text or "") if good(m)]
    return sorted(out)


def corpus():
    rnd = random.Random(8)
    key = lambda n: base64.b64encode(rnd.randbytes(n)).decode()
    texts = ["", None, "secret: token: abcdef", 'secret=token":abcdefgh', "password = 'hunter2hunter2' é token=x", "AKIA1AKIA" + "A" * 16 + " AKIA12", "é😀 " + "0f" * 12 + " " + "ab" * 13, "API_KEY:" + "x" * 6 + "=apikey==abcdef", "the quick brown fox " * 30]
    texts += [f"some words {key(60)} and {'internationalization' * 2} more/of/these/paths/here/that/Are2Long" for _ in range(30)]
    texts += ["passwd:abcdef1 ☃" * 600]
    pieces = ["token", "secret", "passwd", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "abcdef", "AKIA", "Z9" * 8, "0a1b2c3d" * 3, "é", "\n", "."]
    return texts + ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 30))) for _ in range(400)]


def test_base_spans_equal_regex(spark):
    rows = list(enumerate(corpus())) + [(None, "token=abcdefg"), (1, "token=abcdefg"), (1, "token=abcdefg")]
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, n_hex int, spans string")
    spans = F.col("spans")
    got = secrets.scan(docs).select("doc_id", *(secrets.counted(spans, k) for k in secrets.KINDS[:3]), F.sha2(secrets.listed(spans, 3), 256), secrets.listed(spans)).collect()
    want = []
    for doc_id, text in rows:
        found = base_spans(text)
        names = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in found)
        want.append((doc_id, *(sum(k == i for _, k, _ in found) for i in range(3)), hashlib.sha256(names.encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    added = {r["doc_id"]: r[5] for r in got}
    assert all("random:" in added[i] and added[i].count("random:") == 1 for i in range(9, 39))
    assert "random" not in added[8]
    assert secrets.scan(docs.limit(0)).collect() == []


WORDS = "the value of every user account is read from table index and written to storage when handler returns result page number".split()
WORDS += ["".join(random.Random(k).choice(["ta", "re", "in", "on", "es", "ti", "al", "or", "ment", "co", "de", "ver", "st", "er"]) for _ in range(2 + k % 3)) for k in range(400)]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def name(rnd):
    """An ordinary identifier of 20 characters or more."""
    parts = [rnd.choice(WORDS) for _ in range(12)]
    style = rnd.randrange(4)
    if style == 0:
        out = "".join(w.capitalize() for w in parts)[: rnd.randrange(20, 45)] + str(rnd.randrange(100))
    elif style == 1:
        out = "_".join(w.capitalize() for w in parts[:6]) + "_" + str(rnd.randrange(2000, 2030))
    elif style == 2:
        out = parts[0] + "".join(w.capitalize() for w in parts[1:7]) + rnd.choice(["", "V2", "2024"])
    else:
        out = parts[0].upper() + "-" + "-".join(parts[1:5]) + "-" + str(rnd.randrange(10**6))
    return out


def plain_neighbours(texts):
    symbol = lambda t: t.lower().translate(str.maketrans("123456789+/_", "000000000---"))
    seen = {}
    tokens = {symbol(t) for text in texts for t in re.findall(r"[A-Za-z0-9+/_-]+", text or "") if 1 < len(t) < 20}
    for t in tokens:
        for a, b in zip(t, t[1:]):
            seen[a + b] = seen.get(a + b, 0) + 1
    size = len(secrets.SYMBOLS)
    row = {a: sum(seen.get(a + b, 0) for b in secrets.SYMBOLS) for a in secrets.SYMBOLS}
    table = {a + b: math.log((seen.get(a + b, 0) + secrets.PRIOR / size) / (row[a] + secrets.PRIOR)) for a in secrets.SYMBOLS for b in secrets.SYMBOLS}
    total = sum(seen.values())
    mean = sum(n * table[k] for k, n in seen.items()) / total
    spread = math.sqrt(sum(n * table[k] ** 2 for k, n in seen.items()) / total - mean * mean)
    return table, min(mean, secrets.REGULAR), max(secrets.VARIED, spread), symbol


def plain_p(found, alphabet, model):
    table, mean, deviation, symbol = model
    n, steps = len(found), len(found) - 1
    equal, pairs = sum(found.count(c) * (found.count(c) - 1) / 2 for c in set(found)), n * (n - 1) / 2
    chance = max(secrets.EQUAL, secrets.EQUAL_OF_ALPHABET / len(alphabet))
    kind = lambda c: "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c
    changes = sum(kind(x) != kind(y) and x.isalnum() and y.isalnum() for x, y in zip(found, found[1:]))
    s = symbol(found)
    z = [
        (pairs * chance - equal) / math.sqrt(pairs * chance * (1 - chance) + secrets.EQUAL_SPREAD * n**3),
        (changes - secrets.CHANGES * steps) / math.sqrt(steps * secrets.CHANGES * (1 - secrets.CHANGES)),
        (mean * steps - sum(table[x + y] for x, y in zip(s, s[1:]))) / (math.sqrt(steps) * deviation * secrets.SERIAL_SPREAD),
    ]
    return math.erfc(sum(z) / math.sqrt(6)) / 2


def test_battery_and_discoveries_equal_plain_python(spark):
    rnd = random.Random(3)
    digits, lower, upper = secrets.DIGITS, secrets.LOWER, secrets.UPPER
    texts = [prose(rnd, 60) for _ in range(40)] + [name(rnd) for _ in range(20)] + [None, "", "é 日本 x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pairs, model = secrets.neighbours(docs.where("text is not null")), plain_neighbours(texts)
    assert max(abs(v - model[0][a + b]) for v, (a, b) in zip(pairs[0], [(a, b) for a in secrets.SYMBOLS for b in secrets.SYMBOLS])) < 1e-12
    assert abs(pairs[1] - model[1]) < 1e-12 and abs(pairs[2] - model[2]) < 1e-9
    runs = [("".join(rnd.choice(digits + upper + lower) for _ in range(n)) + "aA1", digits + upper + lower) for n in range(20, 90, 2)]
    runs += [("".join(rnd.choice(digits + lower[:6]) for _ in range(n)) + "a1", digits + lower[:6]) for n in range(20, 90, 3)]
    runs += [(name(rnd), None) for _ in range(60)]
    runs += [("Version1OfThe" * 3, digits + upper + lower), ("a1" * 20, digits + lower[:6]), ("x", None), ("justletters" * 3, None), ("12345678901234567890", None)]
    df = keep(secrets.battery(spark.createDataFrame([(r,) for r, _ in runs], "found string"), pairs))
    p = {r["found"]: r["p"] for r in df.collect()}
    for found, alphabet in runs:
        if alphabet is not None:
            want = plain_p(found, alphabet, model)
            assert abs(p[found] - want) < 1e-6 and (want > 1e-12 or p[found] < 1e-11), (found, p[found], want)
    assert all(p[x] is None for x in ("x", "justletters" * 3, "12345678901234567890"))
    got = {r["found"] for r in secrets.discovered(df).collect()}
    classes = {}
    for found, value in p.items():
        if value is not None:
            level = min(math.floor(-20 * math.log10(max(value, 1e-30))), 400)
            classes.setdefault(min(math.floor(2 * math.log2(len(found) / 20)), 12), []).append((level, found))
    want = set()
    for members in classes.values():
        fine = [v for v, _ in members if 10 ** (-v / 20) <= 0.05 * sum(u >= v for u, _ in members) / len(members)]
        want |= {f for v, f in members if fine and v >= min(fine)}
    assert got == want and want


def test_rare_keys_are_found_among_names(spark):
    """Keys of 20, 28 and 40 characters, one run in a hundred: recall of each length and the share of false discoveries."""
    rnd = random.Random(12)
    alphabet = secrets.DIGITS + secrets.UPPER + secrets.LOWER
    texts, keys = [], []
    for i in range(3000):
        run = name(rnd)
        if i % 100 == 0:
            run = "".join(rnd.choice(alphabet) for _ in range((20, 28, 40)[i // 100 % 3]))
            keys.append((i, run))
        prefix = "see docs/of_the/" if i % 200 == 0 else f"{prose(rnd, 12)} "
        texts.append(f"{prefix}{run} {prose(rnd, 8)}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["s"] for r in secrets.scan(docs).select("doc_id", secrets.listed(F.col("spans")).alias("s")).collect() if "random" in r["s"]}
    hit = {n: [i for i, k in keys if len(k) == n and i in found] for n in (20, 28, 40)}
    assert all(len(hit[n]) >= 0.9 * sum(len(k) == n for _, k in keys) for n in hit), {n: len(v) for n, v in hit.items()}
    assert len(set(found) - {i for i, _ in keys}) <= 0.05 * len(found)
    for i, key in keys:
        if i in found and i % 200 == 0:
            at = texts[i].index(key)
            assert f"random:{at}:{at + len(key)}" in found[i]
