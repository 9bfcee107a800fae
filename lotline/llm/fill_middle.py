"""Fill-in-middle transformation over UTF-8 bytes with a sparse exception index.

A text is cut into tokens (a run of ASCII letters, or any other single code point), two cuts between tokens make prefix, middle
and suffix, and the parts are put in another order between markers. Texts stay bytes: in an ASCII span a byte is a code
point, so only multibyte characters are recorded, by place and excess bytes; a binary search among them turns a byte cut into a code
point and back. Cuts are found by counting token starts in pages, then looking into the page that holds the cut.

Null and empty texts, and texts that contain a marker, stay plain. The cuts and forms depend on the decimal doc_id alone (null: no
digits), so rows that repeat an id and a text give equal rows. Other columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lotline.llm.common import portions, texts

MARKERS = (b"<P>", b"<S>", b"<M>")
#: Of 100 texts so many are rearranged, and of 100 rearranged ones so many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Bytes of texts looked at together, and bytes of a page of token starts.
BLOCK, PAGE = 4_000_000, 256

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class ExceptionIndex:
    """The multibyte characters of a byte array: where they begin, in bytes and in code points, and the excess bytes before each."""

    def __init__(self, data: np.ndarray):
        self.byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.byte]
        self.excess = np.zeros(len(lead) + 1, np.int64)
        np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0), out=self.excess[1:])
        self.char = self.byte - self.excess[:-1]

    def chars(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte cut (at a character's begin)."""
        return byte - self.excess[np.searchsorted(self.byte, byte)]

    def bytes(self, char: np.ndarray) -> np.ndarray:
        """Bytes before each code-point cut."""
        return char + self.excess[np.searchsorted(self.char, char)]


class TokenStarts:
    """Where tokens begin in texts that lie end to end: the number of starts before any byte, the byte of the k-th start."""

    def __init__(self, data: np.ndarray, text_starts: np.ndarray):
        letter = _LETTER[data]
        mark = (data & 0xC0) != 0x80
        mark[1:] &= ~(letter[1:] & letter[:-1])
        first = text_starts[text_starts < len(data)]
        mark[first] = True
        self.size = len(data)
        self.pages = np.zeros((len(data) // PAGE + 1, PAGE), bool)
        self.pages.ravel()[: len(data)] = mark
        self.before = np.zeros(len(self.pages) + 1, np.int64)
        np.cumsum(np.count_nonzero(self.pages, axis=1), out=self.before[1:])

    def rank(self, byte: np.ndarray) -> np.ndarray:
        page, rest = byte // PAGE, byte % PAGE
        inside = self.pages[page] & (np.arange(PAGE) < rest[:, None])
        return self.before[page] + np.count_nonzero(inside, axis=1)

    def place(self, k: np.ndarray) -> np.ndarray:
        """The k-th start counted from 0; one past the last is the end of the data."""
        page = np.minimum(np.searchsorted(self.before, k, "right") - 1, len(self.pages) - 1)
        within = np.cumsum(self.pages[page], axis=1, dtype=np.int16) > (k - self.before[page])[:, None]
        return np.where(within.any(axis=1), page * PAGE + within.argmax(axis=1), self.size)


def draws(doc_id: int | None, salt: int = 1) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    hexed = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24))


def join_parts(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = MARKERS
    if form == "psm":
        return b"".join((p, prefix, s, suffix, m, middle))
    if form == "spm":
        return b"".join((s, suffix, p, prefix, m, middle))
    return b"".join((prefix, middle, suffix))


def restore(form: str, output: bytes) -> bytes:
    """The text, from output and form alone: a text in parts holds no marker, so the first one of each kind is the cut."""
    p, s, m = MARKERS
    if form == "plain":
        return output
    second = s if form == "psm" else p
    cut = output.index(second, len(p))
    end = output.index(m, cut + len(second))
    one, two, middle = output[len(p) : cut], output[cut + len(second) : end], output[end + len(m) :]
    return b"".join((one, middle, two) if form == "psm" else (two, middle, one))


def rearrange(ids: list, raw: list[bytes]) -> Iterator[tuple]:
    """doc_id, n, form, prefix_chars, middle_chars, output of each of some texts."""
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(t) for t in raw], out=starts[1:])
    data = np.frombuffer(b"".join(raw), np.uint8)
    tokens, index = TokenStarts(data, starts[:-1]), ExceptionIndex(data)
    first = tokens.rank(starts)
    n = np.diff(first)
    drawn = [draws(i) for i in ids]
    ends = np.sort(np.array([d[:2] for d in drawn], np.int64).reshape(-1, 2) % (n + 1)[:, None], axis=1)
    at = np.stack([np.minimum(tokens.place(first[:-1] + ends[:, k]), starts[1:]) for k in (0, 1)], axis=1)
    chars = index.chars(at)
    begin = index.chars(starts[:-1])
    cuts = (at - starts[:-1, None]).tolist()
    for i, text in enumerate(raw):
        _, _, h3, h4 = drawn[i]
        if not text or h3 % 100 >= RATE or any(x in text for x in MARKERS):
            yield ids[i], int(n[i]), "plain", None, None, text
            continue
        form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
        a, b = cuts[i]
        yield ids[i], int(n[i]), form, int(chars[i, 0] - begin[i]), int(chars[i, 1] - chars[i, 0]), join_parts(form, text[:a], text[a:b], text[b:])


def fill_in_middle(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (code points, null if plain) and output, or with
    ``digests`` the SHA-256 of the output and of the text rebuilt from it. One pass over the rows, no shuffle."""
    head = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
    schema = f"{head}, output_sha256 string, restored_sha256 string" if digests else f"{head}, output string"
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * (len(names) - 5)]

    def finish(row: tuple) -> tuple:
        *some, form, prefix, middle, output = row
        tail = [hashlib.sha256(x).hexdigest() for x in (output, restore(form, output))] if digests else [output.decode("utf-8")]
        return (*some, form, prefix, middle, *tail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, limit=BLOCK):
                rows = [finish(row) for row in rearrange(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    return texts(docs).mapInArrow(run, schema)


#: The same by plain token lists.
SQL = """
WITH d AS (SELECT CAST(doc_id AS BIGINT) doc_id, coalesce("text", '') t FROM documents),
h AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') k, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) x FROM d),
g AS (SELECT *, CAST(len(k) AS BIGINT) n, CAST('0x' || substr(x, 1, 8) AS BIGINT) h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) h2,
  CAST('0x' || substr(x, 17, 8) AS BIGINT) h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END form FROM g),
p AS (SELECT *, array_to_string(k[1:a], '') pre, array_to_string(k[a + 1:b], '') mid, array_to_string(k[b + 1:], '') suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS out FROM p),
r AS (SELECT *, strpos(out, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) i, strpos(out, '<M>') j FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END middle_chars, sha256(out) output_sha256,
  sha256(CASE form WHEN 'plain' THEN out WHEN 'psm' THEN substr(out, 4, i - 4) || substr(out, j + 3) || substr(out, i + 3, j - i - 3)
    ELSE substr(out, i + 3, j - i - 3) || substr(out, j + 3) || substr(out, 4, i - 4) END) restored_sha256
FROM r
"""
