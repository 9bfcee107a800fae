"""Token counts by a byte-level BPE vocabulary compiled to a deterministic transducer.

A state holds, for every place where an unfinished token may have begun, the bytes since then, the last whole token
before it and the number of tokens up to it, relative to here. Only the neighbours in an encoding have to fit (two tokens fit
if they are the encoding of their own bytes), so a state and a byte fix the next state, and the transition carries how
many tokens the longer prefix has more (or fewer) than the shorter. States are compiled as texts reach them.

Pre-tokens that differ are laid end to end and cut into chunks of equal length that are read in lockstep, one byte of every chunk at
a time. A pre-token's first byte resets the state, so the map of a chunk with such a byte sends every state to one. The maps of
chunks within one pre-token are computed for the states that occur and composed by a parallel prefix scan, then all are read once
more from their true states; a chunk whose map lacks its true state waits for the chunk before.

Null and empty texts have 0 tokens. Length is not limited; memory is bounded by a batch. A special string inside a text
counts as one token and ends the text before it, the default of the library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from lotline.llm.common import blocks, columns, mix, span_hashes, texts

ROOT, UNKNOWN = 0, 1
CHUNK = 256
#: Entries of a chunk's map.
MAPPED = 4
#: The gain of a transition is kept in its low byte, counted from here.
ZERO = 128
#: States kept from one block of texts to the next.
KEPT_STATES = 150_000
LETTER, DIGIT, SPACE, WHITE, OTHER, NONE = range(6)

_automata: dict[str, Automaton] = {}


def _classes() -> np.ndarray:
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (WHITE, r"\s")):
        table[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
    table[32] = SPACE
    return table


def _byte_of_symbol() -> dict[str, int]:
    """The usual byte alphabet of such files: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = _byte_of_symbol()
        raw = lambda s: bytes(byte[c] for c in s)
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.tokens = {raw(t) for t in spec["model"]["vocab"] if all(c in byte for c in t)}
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.opens = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.kind = _classes()
        self.clear()

    @classmethod
    def of(cls, path: str) -> Automaton:
        if path not in _automata:
            _automata[path] = cls(path)
        return _automata[path]

    def clear(self) -> None:
        self.states: list[tuple] = [((b"", None, 0),), ()]
        self.number = {self.states[0]: ROOT}
        self.fitting: dict[tuple, bool] = {}
        self.column = np.full(256, -1, np.int64)
        self.bits = 6
        self.table = np.full((1024, 1 << self.bits), -1, np.int32)
        self.table[UNKNOWN] = UNKNOWN << 8 | ZERO

    def admit(self, data: np.ndarray) -> None:
        """Give every byte that occurs a column of the table; most texts use few of the 256."""
        new = np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0))
        used = int((self.column >= 0).sum())
        self.column[new] = np.arange(used, used + len(new))
        while used + len(new) > 1 << self.bits:
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
            self.bits += 1
        self.table[UNKNOWN] = UNKNOWN << 8 | ZERO

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding of one pre-token by merging the best-ranked neighbours."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda pair: self.rank.get(pair, len(self.rank)))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                both = i + 1 < len(parts) and (parts[i], parts[i + 1]) == best
                out.append(parts[i] + parts[i + 1] if both else parts[i])
                i += 1 + both
            parts = out
        return parts

    def fits(self, left: bytes | None, right: bytes) -> bool:
        if (left, right) not in self.fitting:
            want = [right] if left is None else [left, right]
            self.fitting[left, right] = self.merged(b"".join(want)) == want
        return self.fitting[left, right]

    def compile(self, state: int, byte: int) -> None:
        """Add the transition of a state by a byte."""
        grown = [(since + bytes([byte]), last, count) for since, last, count in self.states[state]]
        token, gain = next((since, count + 1) for since, last, count in grown if since in self.tokens and self.fits(last, since))
        after = (*((since, last, count - gain) for since, last, count in grown if since in self.opens), (b"", token, 0))
        if (to := self.number.get(after)) is None:
            to = self.number[after] = len(self.states)
            self.states.append(after)
            if to >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table[: len(self.table) // 2], -1)])
        if not 0 <= gain + ZERO < 256:
            raise OverflowError(f"a transition that emits {gain} tokens does not fit a byte")
        self.table[state, self.column[byte]] = to << 8 | gain + ZERO

    def step(self, states: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The transitions (state << 8 | tokens + ZERO) of states by bytes, both given as parts of a place in the table."""
        at = states | cells
        to = self.table.ravel()[at]
        while to.min() < 0:
            byte = np.argsort(np.where(self.column < 0, 256, self.column), kind="stable")
            for key in np.unique(at[to < 0]).tolist():
                self.compile(key >> self.bits, int(byte[key & ((1 << self.bits) - 1)]))
            to = self.table.ravel()[at]
        return to

    def gains(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each byte, the tokens that it adds; ``first`` marks the bytes that begin a pre-token."""
        self.admit(data)
        lanes = -(-len(data) // CHUNK)
        room = lanes * CHUNK - len(data)
        cells = np.ascontiguousarray(self.column[np.pad(data, (0, room), mode="edge")].reshape(lanes, CHUNK).T)
        first = np.ascontiguousarray(np.pad(first, (0, room), constant_values=True).reshape(lanes, CHUNK).T)
        held = np.where(first, 0, -1)
        out = np.zeros((CHUNK, lanes), np.uint8)
        place = np.full(lanes, UNKNOWN << self.bits, np.int64)
        for k in range(CHUNK):
            to = self.step(place & held[k], cells[k])
            out[k] = to & 255
            place = (to >> 8).astype(np.int64) << self.bits
        unknown = UNKNOWN << self.bits
        head = np.where(first.any(axis=0), first.argmax(axis=0), CHUNK)
        whole = np.flatnonzero(head == CHUNK)
        if len(whole):
            place[whole] = self.scanned(whole, place, cells)
        waiting = np.flatnonzero(head > 0)
        self.rounds = 0
        while len(waiting):
            self.rounds += 1
            ready = waiting[place[waiting - 1] != unknown]
            order = ready[np.argsort(-head[ready], kind="stable")]
            inner = place[order - 1]
            for k in range(head[order[0]]):
                live = np.searchsorted(-head[order], -k, "left")
                to = self.step(inner[:live], cells[k, order[:live]])
                out[k, order[:live]] = to & 255
                inner[:live] = (to >> 8).astype(np.int64) << self.bits
            whole = head[order] == CHUNK
            place[order[whole]] = inner[whole]
            waiting = np.setdiff1d(waiting, ready, assume_unique=True)
        return out.T.ravel()[: lanes * CHUNK - room].astype(np.int64) - ZERO

    def passed(self, lanes: np.ndarray, place: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Where chunks lead from the given places."""
        for k in range(CHUNK):
            place = (self.step(place, cells[k, lanes]) >> 8).astype(np.int64) << self.bits
        return place

    def scanned(self, lanes: np.ndarray, place: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Where chunks without a begin of a pre-token lead, as far as their maps tell; UNKNOWN for the others.

        A chunk's map lists MAPPED entries and their exits: the begin of a pre-token, what that leads its predecessor to, where the
        first chunk of its pre-token truly leads, and what that leads its predecessor to. Maps of neighbours are composed by doubling: after each step a map reaches back twice as far, so
        a pre-token of n chunks takes log n steps.
        """
        unknown = UNKNOWN << self.bits
        follows = np.append(False, lanes[1:] == lanes[:-1] + 1)
        enter = np.zeros((len(lanes), MAPPED), np.int64)
        leave = np.zeros_like(enter)
        head = np.maximum.accumulate(np.where(follows, 0, np.arange(len(lanes))))
        for r in range(MAPPED):
            if r == 2:
                enter[:, r] = leave[head, 0]
            elif r:
                enter[1:, r] = np.where(follows[1:], leave[:-1, r - 1], 0)
            known = ~follows & (lanes > 0)
            enter[known, r] = np.where(place[lanes[known] - 1] != unknown, place[lanes[known] - 1], 0)
            leave[:, r] = self.passed(lanes, enter[:, r].copy(), cells)
        start, out = np.arange(len(lanes)), leave.copy()
        while True:
            more = np.flatnonzero(follows[start])
            if not len(more):
                break
            before = start[more] - 1
            same = out[before][:, :, None] == enter[start[more]][:, None, :]
            met = np.take_along_axis(out[more], same.argmax(axis=2), axis=1)
            out[more], start[more] = np.where(same.any(axis=2), met, unknown), start[before]
        first = lanes[start] - 1
        told = (lanes[start] > 0) & (place[first] != unknown)
        return np.where(told, out[:, 0], unknown)

    def count_parts(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token; equal ones, as told by a 64-bit hash and the length, are read once."""
        end = np.append(begin[1:], len(data))
        name = mix(span_hashes(data, begin, end) ^ (end - begin).astype(np.uint64))
        _, one, which = np.unique(name, return_index=True, return_inverse=True)
        size = (end - begin)[one]
        offsets = np.zeros(len(one) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        flags = np.zeros(offsets[-1], bool)
        flags[offsets[:-1]] = True
        gains = self.gains(data[np.arange(offsets[-1]) + np.repeat(begin[one] - offsets[:-1], size)], flags)
        return np.add.reduceat(gains, offsets[:-1])[which]

    def starts(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which characters begin a pre-token; texts run from one offset to the next."""
        kind = self.kind[points]
        before = np.concatenate([[np.uint8(NONE)], kind[:-1]])
        after = np.concatenate([kind[1:], [np.uint8(NONE)]])
        filled = np.flatnonzero(np.diff(offsets))
        before[offsets[filled]] = NONE
        after[offsets[filled + 1] - 1] = NONE
        white = (kind == SPACE) | (kind == WHITE)
        was_white = (before == SPACE) | (before == WHITE)
        ends = white & (after != NONE) & (after != SPACE) & (after != WHITE)
        out = np.where(white, ~was_white | ends, (before != SPACE) & (before != kind))
        quote = np.flatnonzero((points == 39) & out)
        stop = offsets[np.searchsorted(offsets, quote, "right")]
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & (quote + 1 < stop)
        long = (quote + 2 < stop) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for found, length in ((quote[short], 2), (quote[long & ~short], 3)):
            out[found + 1] = False
            limit = offsets[np.searchsorted(offsets, found, "right")]
            out[(found + length)[found + length < limit]] = True
        return out

    def count(self, values: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(values), np.int64)
        pieces, owner = [], []
        for i, value in enumerate(values):
            parts = [value]
            for special in self.specials:
                parts = [x for part in parts for x in part.split(special)]
            total[i] = len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
        whole = "".join(pieces)
        if not whole:
            return total
        if len(self.states) > KEPT_STATES:
            self.clear()
        offsets = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=offsets[1:])
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        first = self.starts(points, offsets)
        data = np.frombuffer(whole.encode(), np.uint8)
        if len(data) != len(points):
            at = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF), out=at[1:])
            flags = np.zeros(len(data), bool)
            flags[at[:-1][first]] = True
            first, offsets = flags, at[offsets]
        begin = np.flatnonzero(first)
        sums = np.concatenate([[0], np.cumsum(self.count_parts(data, begin))])
        edges = np.searchsorted(begin, offsets)
        np.add.at(total, owner, sums[edges[1:]] - sums[edges[:-1]])
        return total


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and whether there are more than ``limit``, one row for each input row; no shuffle."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.of(path)
        for batch in batches:
            ids, values = columns(batch)
            counts = np.concatenate([np.zeros(0, np.int64), *(automaton.count(b) for b in blocks(values))])
            sizes = [len(v.encode()) for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
