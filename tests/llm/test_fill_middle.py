import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lotline.llm import fill_middle as M


def plain(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


odd = st.lists(st.sampled_from(["a", "Zb", " ", "é", "日本", "😀", "<", "P>", "S", "M>", "\n", "0", "x" * 300, "<P>", "ß" * 200]), max_size=30).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-5, 10**12), odd), max_size=12))
def test_like_token_lists(rows):
    got = list(M.rearrange([r[0] for r in rows], [r[1].encode() for r in rows]))
    assert [(*r[:5], r[5].decode()) for r in got] == [plain(*r) for r in rows]
    assert [M.restore(r[2], r[5]).decode() for r in got] == [r[1] for r in rows]


@settings(max_examples=200, deadline=None)
@given(odd)
def test_index_turns_cuts_both_ways(text):
    index = M.ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
    chars = np.arange(len(text) + 1)
    edges = np.array([len(text[:i].encode()) for i in chars])
    assert index.bytes(chars).tolist() == edges.tolist()
    assert index.chars(edges).tolist() == chars.tolist()
    assert len(index.byte) == sum(ord(c) > 127 for c in text)


def test_rows_with_gaps(spark):
    rows = [(1, "ab cd é"), (None, "ab cd"), (None, None), (2, None), (3, ""), (4, "has <S> inside"), (1, "ab cd é"), (5, "wörd " * 900_000), (6, "日" * 1_500_000)]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, n string, output int")
    got = sorted(map(tuple, M.fill_in_middle(docs).collect()), key=repr)
    assert got == sorted((plain(*r) for r in rows), key=repr)
    coded = {(r.doc_id, r.n): r for r in M.fill_in_middle(docs, digests=True).collect()}
    for r in got:
        assert coded[r[0], r[1]].output_sha256 == hashlib.sha256(r[5].encode()).hexdigest()
    assert {r.restored_sha256 for r in coded.values()} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    assert M.fill_in_middle(docs.limit(0)).collect() == []
