import base64
import hashlib
import random

import public_tokenizers as P
import pytest

from lotline.llm import bpe_codec, token_automaton

TEXTS = ["", None, "Hello world's  best\n\n  test 123", "naïve café — ☃ 你好", "a" * 3000, " \t\n ", "'s'sd 'll''s x'RE", "\x1c\x1d y 　z\x85", "x" + " " * 700 + "y", "<|endoftext|>b"]


def noise(n, seed=5):
    rnd = random.Random(seed)
    pool = list("abcdehilnorstuvéñß '\n\t.,!0123—你☃") + ["the", " the", "'s", "ing", "  ", "<|endoftext|>", " "]
    return ["".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", 1) for i, t in enumerate(TEXTS + noise(300))] + [(None, "null id", "n", 1), (3, TEXTS[3], "n", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")


def test_codec_equals_library(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in docs.collect():
        text = r["text"] or ""
        want.append((r["doc_id"], library.encode_ordinary(text), text.encode()))
    got = [(r["doc_id"], r["ids"], bytes(r["decoded"])) for r in bpe_codec.encode_decode(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    short = [(i, len(ids), sha(",".join(map(str, ids)).encode()), sha(raw)) for i, ids, raw in want]
    assert sorted(map(tuple, bpe_codec.encode_decode(docs, digests=True).collect()), key=repr) == sorted(short, key=repr)


def test_codec_empty_table(docs):
    assert bpe_codec.encode_decode(docs.limit(0)).collect() == []


def test_ranks_with_holes_are_refused():
    with pytest.raises(ValueError):
        bpe_codec.serialise({bytes([b]): b + (b > 7) for b in range(256)})


def test_counts_equal_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for r in docs.collect():
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        want.append((r["doc_id"], len(text.encode()), n, n > 1024))
    got = [tuple(r) for r in token_automaton.count_tokens(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_automaton.count_tokens(docs.limit(0)).collect() == []


def test_chunk_maps_of_long_pretokens():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    automaton = token_automaton.Automaton(P.path("byte_bpe_50k.json"))
    rnd = random.Random(1)
    values = ["".join(rnd.choice("abcdeést") for _ in range(n)) for n in (1, 255, 256, 257, 5000)] + noise(40, 9)
    assert automaton.count(values).tolist() == [len(library.encode(v).ids) for v in values]


def test_chunk_maps_compose_by_doubling():
    """Pre-tokens of thousands of chunks: the scan tells nearly all states, so that few rounds of waiting are left."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    automaton = token_automaton.Automaton(P.path("byte_bpe_50k.json"))
    rnd = random.Random(3)
    for value in ("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(200_000)), "ab" * 50_000, "=" * 100_000, "日本" * 20_000, "x" + "a" * 60_000 + " the " + "q" * 3000):
        assert automaton.count([value]).tolist() == [len(library.encode(value).ids)]
        assert automaton.rounds <= 6, (value[:9], automaton.rounds)
