"""Removal of every byte that a repeated 200-byte string covers.

Names stand for strings: the name of a triple of neighbouring names is a 64-bit fingerprint of it, and triples of triples name 3, 9, 27
and 81 bytes and, with overlapping members, 200. Equal strings have equal names, so suffixes sorted by name have equal prefixes side by side,
which is all that is compared. A sample is sorted first: in each 200-byte string the 64-byte name of the smallest value is its
anchor, a choice that any equal string makes alike. Anchors that occur once in all texts take their strings out; the strings of
the other anchors, and only those, are then named at full length, sorted and compared.

Equal texts are one text that counts as often as it occurs: those of a batch are collapsed before they are moved, the rest after. Results go back to the
doc_ids by the text's MD5; a task of the input sends one list of doc_ids for each of its texts, so a group of copies is as many rows as tasks.

Names are sorted by range owners: texts are dealt into blocks by hash, each block sends its distinct names once, packed, to the tasks that own
them, and gets back in its own order whether each occurs twice.

This is not the three-way merge of the difference-cover algorithm: its ranks would order suffixes of different text too, which
nothing here needs, at several shuffles of all suffixes (README). Names are 64-bit: strings that differ share one with probability 2^-64 a pair.

Null texts are empty; texts under 200 bytes lose nothing; rows that repeat are copies of each other. Every row gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import keep, texts

LENGTH, ANCHOR = 200, 64
BLOCK_CHARS, AT_ONCE = 6_000_000, 1_500_000
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _triple(names: np.ndarray, second: int, third: int) -> np.ndarray:
    """Names of (i, i + second, i + third) for every i that has them."""
    n = max(0, len(names) - third)
    x = names[:n] * _K[0]
    x += names[second : second + n] * _K[1]
    x ^= x >> np.uint64(31)
    x += names[third : third + n] * _K[2]
    x ^= x >> np.uint64(29)
    x *= _K[3]
    x ^= x >> np.uint64(32)
    return x


def named(data: np.ndarray, length: int) -> np.ndarray:
    """Names of all strings of ``length`` bytes (3 at least)."""
    names, covered = data.astype(np.uint64) + np.uint64(1), 1
    while covered < length:
        third = min(2 * covered, length - covered)
        names = _triple(names, min(covered, third), third)
        covered += third
    return names


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width] for every i that has them all."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x = pick(x[: len(x) - step], x[step:])
        span += step
    return x


def anchors(data: np.ndarray, starts: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every string of ``length`` bytes that lies in a text the anchor (0: it doesn't lie in one), and the anchor of each place
    that is one. Texts run from one start to the next."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    names = named(data, anchor)
    width = length - anchor + 1
    of = _slide(names, width, np.minimum)
    inside = np.zeros(len(of) + 1, np.int32)
    n = np.diff(starts)
    long = n >= length
    np.add.at(inside, starts[:-1][long], 1)
    np.add.at(inside, starts[1:][long] - length + 1, -1)
    of[np.cumsum(inside[:-1]) == 0] = 0
    around = np.zeros(len(of) + 2 * (width - 1), np.uint64)
    around[width - 1 : width - 1 + len(of)] = of
    most = _slide(around, width, np.maximum)
    return of, names[(most == names[: len(most)]) & (most > 0)]


def _parts(names: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    part = (names >> np.uint64(16)) % np.uint64(count)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(count + 1, dtype=np.uint64))


def _question(block: int, names: np.ndarray, times: np.ndarray, count: int) -> pa.Table:
    order, cuts = _parts(names, count)
    out = [(p, block, names[order[s:e]].tobytes(), np.minimum(times[order[s:e]], 2).astype(np.uint8).tobytes()) for p, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])) if e > s]
    return pa.table([pa.array(list(x), k) for x, k in zip(zip(*out) if out else [[]] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "block", "names", "times"])


def _answer(table: pa.Table) -> pa.Table:
    """Whether each name occurs twice or more over all questions to this task."""
    names = [np.frombuffer(x, np.uint64) for x in table.column("names").to_pylist()]
    times = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("times").to_pylist()])
    every = np.concatenate(names)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    twice = np.zeros(len(every), bool)
    same = ordered[1:] == ordered[:-1]
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    twice |= times > 1
    cuts = np.cumsum([0] + [len(x) for x in names])
    bits = [np.packbits(twice[s:e]).tobytes() for s, e in zip(cuts[:-1], cuts[1:])]
    return pa.table([table.column("block"), table.column("part"), pa.array(bits, pa.binary())], ["block", "part", "bits"])


def _answered(names: np.ndarray, back: pa.Table, count: int) -> np.ndarray:
    order, cuts = _parts(names, count)
    twice = np.zeros(len(names), bool)
    for p, bits in zip(back.column("part").to_pylist(), back.column("bits").to_pylist()):
        s, e = cuts[p], cuts[p + 1]
        twice[order[s:e]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s).astype(bool)
    return twice


def _runs_of(values: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Numbers of texts that are taken together, their bytes, and where each starts."""
    low = 0
    while low < len(values):
        high, size = low, 0
        while high < len(values) and (high == low or size + len(values[high]) <= AT_ONCE):
            size += len(values[high])
            high += 1
        yield low, high, np.frombuffer(b"".join(values[low:high]), np.uint8), np.concatenate([[0], np.cumsum([len(v) for v in values[low:high]])]).astype(np.int64)
        low = high


def collapsed(rows: DataFrame, count: int) -> DataFrame:
    """block, key (MD5), text, copies: one row for each different text. Copies within a batch are one before anything is moved, and texts
    are moved once, by block: what follows by block needs no other shuffle."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by("text").aggregate([([], "count_all")])
            yield from found.select(["text", "count_all"]).rename_columns(["text", "n"]).to_batches()

    block = F.pmod(F.xxhash64("text"), F.lit(count)).cast("int").alias("block")
    moved = rows.select("text").mapInArrow(once, "text string, n long").select(block, "text", "n").repartition("block")
    return moved.groupBy("block", "text").agg(F.sum("n").alias("copies")).select("block", F.unhex(F.md5("text")).alias("key"), "text", "copies")


def _ordered(table: pa.Table) -> tuple[list[bytes], list[bytes], list[int]]:
    """The block's texts in a fixed order, with their keys and copies."""
    values = [t.encode() for t in table.column("text").to_pylist()]
    order = sorted(range(len(values)), key=lambda k: (len(values[k]), values[k]))
    keys, copies = table.column("key").to_pylist(), table.column("copies").to_pylist()
    return [values[k] for k in order], [keys[k] for k in order], [copies[k] for k in order]


def _marked(data: np.ndarray, runs: list[list[int]], starts: np.ndarray) -> np.ndarray:
    """Places of the strings to compare: runs of (from, to) within each text."""
    spans = [(s + a, s + b) for s, own in zip(starts[:-1], runs) for a, b in zip(own[::2], own[1::2])]
    return np.concatenate([np.arange(a, b) for a, b in spans] or [np.zeros(0, np.int64)])


def repeated_bytes(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes left; null where all are)."""
    rows = texts(docs)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-int(chars) // BLOCK_CHARS))
    placed = collapsed(rows, count)

    def sampled(values: list[bytes], copies: list[int]) -> tuple[np.ndarray, np.ndarray]:
        found, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for low, high, data, starts in _runs_of(values):
            for many in (False, True):
                some = [v for v, n in zip(values[low:high], copies[low:high]) if (n > 1) == many]
                if some:
                    at = np.concatenate([[0], np.cumsum([len(v) for v in some])]).astype(np.int64)
                    names = anchors(np.frombuffer(b"".join(some), np.uint8), at, length, anchor)[1]
                    found.append(names)
                    times.append(np.full(len(names), 1 + many))
        names, which = np.unique(np.concatenate(found), return_inverse=True)
        return names, np.bincount(which, np.concatenate(times), len(names))

    def ask_anchors(table: pa.Table) -> pa.Table:
        values, _, copies = _ordered(table)
        return _question(table.column("block")[0].as_py(), *sampled(values, copies), count)

    found_schema = "block int, key binary, copies long, n_bytes long, sha string, text binary, runs array<int>"
    found_kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32())]
    found_names = [x.split()[0] for x in found_schema.split(", ")]

    def select(table: pa.Table, back: pa.Table) -> pa.Table:
        """Texts without a string to compare are done; the others go on with the places of those strings."""
        out = []
        if table.num_rows:
            number = table.column("block")[0].as_py()
            values, keys, copies = _ordered(table)
            names = sampled(values, copies)[0]
            wanted = np.sort(names[_answered(names, back, count)])
            for low, high, data, starts in _runs_of(values):
                of = anchors(data, starts, length, anchor)[0]
                place = np.minimum(np.searchsorted(wanted, of), max(0, len(wanted) - 1))
                good = (wanted[place] == of) & (of > 0) if len(wanted) else np.zeros(len(of), bool)
                edge = np.flatnonzero(np.diff(good, prepend=False, append=False))
                begin, end = edge[::2], edge[1::2]
                first, last = np.searchsorted(begin, starts[:-1]), np.searchsorted(begin, starts[1:])
                for k, value in enumerate(values[low:high]):
                    s, e = first[k], last[k]
                    own = (np.stack([begin[s:e], end[s:e]], axis=1).ravel() - starts[k]).tolist()
                    done = not own
                    out.append((number, keys[low + k], copies[low + k], len(value), hashlib.sha256(value).hexdigest() if done else None, None if done else value, own))
        return pa.table([pa.array(list(x), k) for x, k in zip(zip(*out) if out else [[]] * 7, found_kinds)], found_names)

    answers = placed.groupBy("block").applyInArrow(ask_anchors, "part int, block int, names binary, times binary").groupBy("part").applyInArrow(_answer, "block int, part int, bits binary")
    found = keep(placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(select, found_schema))
    more = found.where("text is not null")

    def full_names(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
        """The block's texts in a fixed order, with the name and the weight (copies) of every string to compare."""
        order = sorted(zip(*(table.column(c).to_pylist() for c in ("text", "key", "copies", "runs"))), key=lambda x: (len(x[0]), x[0]))
        names, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for low, high, data, starts in _runs_of([t for t, *_ in order]):
            at = _marked(data, [r for *_, r in order[low:high]], starts)
            names.append(named(data, length)[at])
            copies = np.array([n for _, _, n, _ in order[low:high]])
            times.append(copies[np.searchsorted(starts, at, "right") - 1])
        return order, np.concatenate(names), np.concatenate(times)

    def ask_strings(table: pa.Table) -> pa.Table:
        _, names, times = full_names(table)
        names, which = np.unique(names, return_inverse=True)
        return _question(table.column("block")[0].as_py(), names, np.bincount(which, times, len(names)), count)

    out_schema = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out_kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def remove(table: pa.Table, back: pa.Table) -> pa.Table:
        out = []
        if table.num_rows:
            order, names, _ = full_names(table)
            distinct, which = np.unique(names, return_inverse=True)
            twice = _answered(distinct, back, count)[which]
            used = 0
            for low, high, data, starts in _runs_of([t for t, *_ in order]):
                at = _marked(data, [r for *_, r in order[low:high]], starts)
                hit = at[twice[used : used + len(at)]]
                used += len(at)
                change = np.zeros(len(data) + 1, np.int32)
                np.add.at(change, hit, 1)
                np.add.at(change, hit + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                for k, (text, key, *_) in enumerate(order[low:high]):
                    own = gone[starts[k] : starts[k + 1]]
                    left = np.frombuffer(text, np.uint8)[~own].tobytes()
                    out.append((key, len(text), int(own.sum()), int(np.count_nonzero(np.diff(own, prepend=False) & own)), hashlib.sha256(left).hexdigest(), left))
        return pa.table([pa.array(list(x), k) for x, k in zip(zip(*out) if out else [[]] * 6, out_kinds)], [x.split()[0] for x in out_schema.split(", ")])

    answers = more.groupBy("block").applyInArrow(ask_strings, "part int, block int, names binary, times binary").groupBy("part").applyInArrow(_answer, "block int, part int, bits binary")
    cut = more.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, out_schema)
    same = found.where("text is null").select("key", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    lists = rows.select(F.unhex(F.md5("text")).alias("key"), "doc_id", F.spark_partition_id().alias("task"))
    lists = lists.groupBy("key", "task").agg(F.collect_list(F.struct("doc_id")).alias("docs"))
    # the lists of a group of copies meet their result in one task, and are dealt out again before they become rows
    met = cut.unionByName(same).join(lists, "key").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return met.select(F.inline("docs"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
