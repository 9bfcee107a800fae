"""Texts scored by a causal self-attention model over subword ids, beside a corpus-wide unigram base.

Base: words (runs without blanks, A-Z lowered) and an end are tokens; their counts over all training texts are summed
by Spark. Texts are dealt into blocks by hash; a block sends each of its distinct words (as 64-bit hashes, packed) once to the task that owns
the hash, and gets the count back in the order it asked, so that neither the words nor the counts of the corpus meet anywhere.

Model: a word, with a blank before it, is cut greedily into the longest tokens of a public byte-level vocabulary that have at most eight
bytes, the best-ranked that GROUPS times PLACES ids hold; an end closes the text. One attention layer of one head over a window of WINDOW ids, trained by Adam, gives
the next id's probability as that of its group and of its place there. Windows overlap by CONTEXT ids, and each id is scored once, in the first
window that holds it: with CONTEXT ids or more before it, but at the text's beginning. The weights are fitted on all training texts:
their ids are written once by block; in each of EPOCHS passes every block goes on from the same weights through all its windows, and the
blocks' weights, each counted by its windows, are averaged. Sums are whole numbers, so the order of tasks changes nothing; the driver only gets
MERGED rows of the size of the weights.

Null and empty texts are an end alone. A null doc_id is no held-out text. Every row gives one row; repeated rows count twice. Without
training texts N is 0 and the model is uniform over its ids.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.bpe_codec import read_ranks
from lotline.llm.common import keep, mix, span_hashes, text_bytes, texts, word_spans

SEED = 5
LONGEST = 8
GROUPS, PLACES = 32, 64
WIDTH, WINDOW, CONTEXT = 16, 24, 8
EPOCHS, BATCH, RATE = 3, 256, 0.01
#: Rows of summed weights that reach the driver at most, and steps of a weight in them.
MERGED, STEPS = 64, 2**20
#: Characters in a block of texts, and windows computed at once.
BLOCK_CHARS, LANES = 8_000_000, 512
#: Ids beyond the vocabulary's: the end of a text and, as input only, its beginning.
END, BEGIN = GROUPS * PLACES - 2, GROUPS * PLACES - 1

_pieces: dict[str, Pieces] = {}


class Pieces:
    """Greedy longest-match subwords, at all words of a block at once."""

    def __init__(self, path: str):
        tokens = [t for t, _ in sorted(read_ranks(path).items(), key=lambda x: x[1]) if len(t) <= LONGEST]
        self.tokens = tokens[: END]
        if missing := {bytes([b]) for b in range(256)}.difference(self.tokens):
            raise ValueError(f"bytes without a token: {sorted(missing)}")
        self.keys, self.ids = [], []
        for length in range(1, LONGEST + 1):
            own = sorted((int.from_bytes(t, "little"), i) for i, t in enumerate(self.tokens) if len(t) == length)
            self.keys.append(np.array([k for k, _ in own], np.uint64))
            self.ids.append(np.array([i for _, i in own], np.int32))

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in _pieces:
            _pieces[path] = cls(path)
        return _pieces[path]

    def cut(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each span of the bytes, and where each span's ids start."""
        padded = np.concatenate([data, np.zeros(LONGEST, np.uint8)]).astype(np.uint64)
        at, live, rounds = begin.copy(), np.arange(len(begin)), []
        while len(live):
            here, room = at[live], end[live] - at[live]
            found, size = np.zeros(len(live), np.int32), np.zeros(len(live), np.int64)
            key = np.zeros(len(live), np.uint64)
            for length in range(1, LONGEST + 1):
                key = key | padded[here + length - 1] << np.uint64(8 * (length - 1))
                keys = self.keys[length - 1]
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                good = (keys[place] == key) & (room >= length)
                found[good], size[good] = self.ids[length - 1][place[good]], length
            rounds.append((live, found))
            at[live] += size
            live = live[at[live] < end[live]]
        owner = np.concatenate([o for o, _ in rounds] or [np.zeros(0, np.int64)])
        ids = np.concatenate([f for _, f in rounds] or [np.zeros(0, np.int32)])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(begin)))])


class Block:
    """Words of some texts: distinct ones, and which of them stand where."""

    def __init__(self, values: list[str]):
        self.data, starts = text_bytes([v.encode().lower() for v in values])
        begin, end = word_spans(self.data)
        name = mix(span_hashes(self.data, begin, end)) if len(begin) else np.zeros(0, np.uint64)
        self.names, one, self.word = np.unique(name, return_index=True, return_inverse=True)
        self.begin, self.end = begin[one], end[one]
        self.offsets = np.searchsorted(begin, starts)

    def subwords(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each closed by END, and where each text starts."""
        # a word follows a blank in the bytes, whatever blank it was; the very first has none before it
        data = np.concatenate([[np.uint8(32)], self.data])
        begin = self.begin
        data[begin] = 32
        ids, cuts = pieces.cut(data, begin, self.end + 1)
        size = np.diff(cuts)[self.word]
        per_text = np.concatenate([[0], np.cumsum(size)])[self.offsets]
        n = np.diff(per_text) + 1
        starts = np.concatenate([[0], np.cumsum(n)])
        out = np.full(starts[-1], END, np.int32)
        inner = np.ones(starts[-1], bool)
        inner[starts[1:] - 1] = False
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        out[inner] = ids[np.arange(int(size.sum())) + np.repeat(cuts[self.word] - first, size)]
        return out, starts


def _exponentials(x: np.ndarray, again: Callable[[], np.ndarray], seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(x - m) in the place of x, 0 where not ``seen``, its sums over the last axis, and m: zero unless a row would
    leave the range of the type; then ``again`` makes x anew."""
    ones = np.ones(x.shape[-1], x.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(x, out=x)
        if seen is not None:
            x *= seen
        total = x @ ones
    if total.min(initial=1) > 1e-30 and total.max(initial=1) < 1e30:
        return x, total, 0.0
    x = again() if seen is None else np.where(seen > 0, again(), -np.inf)
    top = x.max(axis=-1, keepdims=True)
    x = np.exp(x - top)
    return x, x @ ones, top[..., 0]


def _products(x: np.ndarray, y: np.ndarray, rows: int = 256) -> np.ndarray:
    """x.T @ y for many narrow rows, some rows at a time."""
    n = len(x) // rows * rows
    some = lambda z: z[:n].reshape(-1, rows, z.shape[1])
    return (some(x).transpose(0, 2, 1) @ some(y)).sum(axis=0) + x[n:].T @ y[n:]


class Model:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(0, 0.1, shape)).astype(np.float32)
        self.parts = {
            "ids": draw(GROUPS * PLACES, WIDTH), "places": draw(WINDOW, WIDTH), "q": draw(WIDTH, WIDTH), "k": draw(WIDTH, WIDTH), "v": draw(WIDTH, WIDTH), "o": draw(WIDTH, WIDTH),
            "group": draw(WIDTH, GROUPS) * 0, "group_bias": np.zeros(GROUPS, np.float32), "place": draw(GROUPS, WIDTH, PLACES) * 0, "place_bias": np.zeros((GROUPS, PLACES), np.float32),
        }
        self.seen = np.tri(WINDOW, dtype=np.float32)

    def _projections(self) -> np.ndarray:
        """The weights of queries, scaled, keys and values side by side."""
        p = self.parts
        return np.concatenate([p["q"] * np.float32(WIDTH**-0.5), p["k"], p["v"]], axis=1)

    def hidden(self, inputs: np.ndarray, low: int = 0) -> tuple[np.ndarray, ...]:
        """Masked attention over a batch of windows of ids, at the places from ``low`` on; then what ``slopes`` needs.

        Exponentials are not divided by their sums; the narrow rows that they are multiplied by are."""
        p = self.parts
        x = p["ids"].take(inputs, axis=0)
        x += p["places"]
        q, k, v = np.split((x.reshape(-1, WIDTH) @ self._projections()).reshape(*inputs.shape, -1), 3, axis=2)
        q, turned = q[:, low:], np.ascontiguousarray(k.transpose(0, 2, 1))
        e, total, _ = _exponentials(q @ turned, lambda: q @ turned, self.seen[low:])
        share = (1 / total)[..., None]
        mixed = e @ v
        mixed *= share
        h = (mixed.reshape(-1, WIDTH) @ p["o"]).reshape(mixed.shape)
        h += x[:, low:]
        return h, x, q, k, v, e, mixed, share

    def log_probabilities(self, h: np.ndarray, target: np.ndarray, slopes: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of the probability of each target after hidden row h; with ``slopes`` also the gradient of their sum's negative."""
        p, order = self.parts, np.argsort(target.astype(np.int16), kind="stable")
        h, target = h.take(order, axis=0), target[order]
        group, place, rows = target // PLACES, target % PLACES, np.arange(len(h))
        size = np.bincount(group, minlength=GROUPS)
        cuts = np.cumsum(size)
        present = [(g, slice(cuts[g] - size[g], cuts[g])) for g in np.flatnonzero(size)]

        def places() -> np.ndarray:
            z = np.empty((len(h), PLACES), h.dtype)
            for g, own in present:
                z_own = np.matmul(h[own], p["place"][g], out=z[own])
                z_own += p["place_bias"][g]
            return z

        out, back = np.zeros(len(h), h.dtype), np.zeros_like(h)
        for part, logits, own in (("group", lambda: h @ p["group"] + p["group_bias"], group), ("place", places, place)):
            z = logits()
            out += z[rows, own]
            e, total, top = _exponentials(z, logits)
            out -= np.log(total) + top
            if slopes is None:
                continue
            # the gradient of a row's logits is (e - total at the target) / total
            e[rows, own] -= total
            share = 1 / total
            scaled, mean = h * share[:, None], np.empty_like(h)
            if part == "group":
                slopes["group"] += _products(scaled, e)
                slopes["group_bias"] += share @ e
                np.matmul(e, p["group"].T, out=mean)
            else:
                for g, some in present:
                    slopes["place"][g] += scaled[some].T @ e[some]
                    slopes["place_bias"][g] += share[some] @ e[some]
                    np.matmul(e[some], p["place"][g].T, out=mean[some])
            mean *= share[:, None]
            back += mean
        unsorted = np.empty_like(order)
        unsorted[order] = rows
        return out[unsorted], None if slopes is None else back.take(unsorted, axis=0)

    def slopes(self, inputs: np.ndarray, target: np.ndarray, good: np.ndarray, out: dict | None = None) -> dict:
        """Gradient of the mean negative log-probability of targets where ``good``, in ``out`` if given, which must be 0."""
        p, low = self.parts, 0 if good[:, :CONTEXT].any() else CONTEXT
        out = out or {k: np.zeros_like(x) for k, x in p.items()}
        h, x, q, k, v, e, mixed, share = self.hidden(inputs, low)
        scored = np.flatnonzero(good[:, low:])
        flat = lambda y: y.reshape(-1, y.shape[-1])
        dh = np.zeros_like(h)
        flat(dh)[scored] = self.log_probabilities(flat(h).take(scored, axis=0), target[:, low:].ravel()[scored], out)[1]
        out["o"] += _products(flat(mixed), flat(dh))
        back = (flat(dh) @ p["o"].T).reshape(h.shape)
        back *= share
        ds = back @ np.ascontiguousarray(v.transpose(0, 2, 1))
        ds -= np.einsum("ij,ij->i", flat(back), flat(mixed)).reshape(*h.shape[:2], 1)
        ds *= e
        d = np.zeros((*inputs.shape, 3 * WIDTH), h.dtype)
        d[:, low:, :WIDTH] = ds @ k
        d[..., WIDTH : 2 * WIDTH] = ds.transpose(0, 2, 1) @ q
        d[..., 2 * WIDTH :] = e.transpose(0, 2, 1) @ back
        dx = (flat(d) @ self._projections().T).reshape(x.shape)
        dx[:, low:] += dh
        for name, own in zip("qkv", np.split(_products(flat(x), flat(d)), 3, axis=1)):
            out[name] += own
        out["q"] *= np.float32(WIDTH**-0.5)
        out["places"] += dx.reshape(len(dx), -1).sum(axis=0).reshape(dx.shape[1:])
        order = np.argsort(inputs.ravel().astype(np.int16), kind="stable")
        ids = inputs.ravel()[order]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        out["ids"][ids[first]] += np.add.reduceat(flat(dx).take(order, axis=0), first, axis=0)
        for own in out.values():
            own *= np.float32(1 / max(1, len(scored)))
        return out

    def fit(self, ids: np.ndarray, starts: np.ndarray, epochs: int = EPOCHS, seed: int | list[int] = SEED) -> Model:
        at, good = windows(starts)
        rng = np.random.default_rng(seed)
        cuts = np.cumsum([x.size for x in self.parts.values()])[:-1]
        views = lambda row: {k: own.reshape(x.shape) for (k, x), own in zip(self.parts.items(), np.split(row, cuts))}
        whole = np.concatenate([x.ravel() for x in self.parts.values()])
        first, second, step, size, g = (np.zeros_like(whole) for _ in range(5))
        self.parts, slopes = views(whole), views(g)
        # a window is a row of these; what follows the last id is scored nowhere
        rows = [np.lib.stride_tricks.sliding_window_view(np.pad(x, (0, WINDOW)), WINDOW) for x in (previous(ids, starts), ids)]
        turn = 0
        for _ in range(epochs):
            # windows at the beginning of texts have batches of their own: of all others, CONTEXT places need no hidden rows
            order = [x[rng.permutation(len(x))] for x in (np.flatnonzero(good[:, 0]), np.flatnonzero(~good[:, 0]))]
            batches = [x[low : low + BATCH] for x in order for low in range(0, len(x), BATCH)]
            for b in rng.permutation(len(batches)):
                own = batches[b]
                turn += 1
                g[:] = 0
                self.slopes(rows[0][at[own]], rows[1][at[own]], good[own], slopes)
                # Adam: first and second are weighted means of the slopes and their squares
                np.subtract(g, first, out=step)
                step *= np.float32(0.1)
                first += step
                np.multiply(g, g, out=g)
                g -= second
                g *= np.float32(0.01)
                second += g
                np.sqrt(second, out=size)
                size *= np.float32((1 - 0.99**turn) ** -0.5)
                size += np.float32(1e-8)
                np.multiply(first, np.float32(RATE / (1 - 0.9**turn)), out=step)
                step /= size
                whole -= step
        return self

    def packed(self, times: int) -> np.ndarray:
        """All weights in a row, ``times`` over, in whole STEPS."""
        return np.rint(np.concatenate([x.ravel() for x in self.parts.values()]).astype(np.float64) * STEPS).astype(np.int64) * times

    def unpack(self, total: np.ndarray, times: int) -> Model:
        """Sets the weights to the mean of ``packed`` ones that were summed."""
        cuts = np.cumsum([x.size for x in self.parts.values()])[:-1]
        self.parts = {k: (own / (times * STEPS)).astype(x.dtype).reshape(x.shape) for (k, x), own in zip(self.parts.items(), np.split(total, cuts))}
        return self

    def score(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        at, good = windows(starts)
        before = previous(ids, starts)
        total = np.zeros(len(ids))
        for first in (True, False):
            some, skip = np.flatnonzero(good[:, 0] == first), 0 if first else CONTEXT
            for begin in range(0, len(some), LANES):
                lanes = some[begin : begin + LANES]
                place = np.minimum(at[lanes, None] + np.arange(WINDOW), len(ids) - 1)
                own = good[lanes, skip:]
                h = self.hidden(before[place], skip)[0]
                total[place[:, skip:][own]] = self.log_probabilities(h[own], ids[place[:, skip:][own]])[0]
        return np.add.reduceat(total, starts[:-1]) / np.log(10) if len(starts) > 1 else np.zeros(0)


def previous(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    before = np.concatenate([[BEGIN], ids[:-1]])
    before[starts[:-1]] = BEGIN
    return before


def windows(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin, and which of their places are scored: each place of each text in one window."""
    n, step = np.diff(starts), WINDOW - CONTEXT
    count = 1 + np.maximum(0, -(-(n - WINDOW) // step))
    turn = np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)])[:-1], count)
    at = np.repeat(starts[:-1], count) + turn * step
    place = np.arange(WINDOW)
    good = (at[:, None] + place < np.repeat(starts[1:], count)[:, None]) & ((turn == 0)[:, None] | (place >= CONTEXT))
    return at, good


def fitted(placed: DataFrame, path: str) -> Model:
    """The model of all texts of ``placed`` (block, doc_id, text)."""

    def cut(table: pa.Table) -> pa.Table:
        """The block's ids and where its texts start, in an order of their own."""
        values, pieces = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).column("text").to_pylist(), Pieces.of(path)
        ids, starts = Block(values).subwords(pieces)
        out = [[table.column("block")[0].as_py()], [ids.astype(np.int16).tobytes()], [starts.astype(np.int64).tobytes()]]
        return pa.table([pa.array(x, k) for x, k in zip(out, (pa.int32(), pa.binary(), pa.binary()))], ["block", "ids", "starts"])

    kinds = pa.schema([("part", pa.int32()), ("times", pa.int64()), ("weights", pa.binary())])

    def row(part: int, times: int, total: np.ndarray) -> list[pa.Array]:
        return [pa.array([x], k) for x, k in zip((part, times, total.tobytes()), kinds.types)]

    lessons = keep(placed.select("block", "doc_id", "text").groupBy("block").applyInArrow(cut, "block int, ids binary, starts binary"))
    model = Model()
    for turn in range(EPOCHS):
        sent = placed.sparkSession.sparkContext.broadcast(model)

        def study(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Summed weights of the task's blocks, each after all its windows."""
            total, times = 0, 0
            for batch in batches:
                for block, ids, starts in zip(*(batch.column(k) for k in range(3))):
                    starts = np.frombuffer(starts.as_py(), np.int64)
                    own = copy.deepcopy(sent.value).fit(np.frombuffer(ids.as_py(), np.int16).astype(np.int32), starts, 1, [SEED, turn, block.as_py()])  # noqa: B023
                    n = len(windows(starts)[0])
                    total, times = total + own.packed(n), times + n
            if times:
                yield pa.record_batch(row(TaskContext.get().partitionId() % MERGED, times, total), schema=kinds)

        def merge(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("weights"))
            return pa.table(row(table.column("part")[0].as_py(), sum(table.column("times").to_pylist()), total), schema=kinds)

        schema = "part int, times long, weights binary"
        merged = lessons.mapInArrow(study, schema).groupBy("part").applyInArrow(merge, schema).toArrow()
        if not merged.num_rows:
            break
        model = model.unpack(sum(np.frombuffer(x.as_py(), np.int64) for x in merged.column("weights")), sum(merged.column("times").to_pylist()))
    return model


def score(docs: DataFrame, path: str | None = None, sample: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. With ``sample`` the attention is fitted on
    so many training texts only, for trials."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = texts(docs).withColumn("held_out", held)
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    count = max(1, -(-int(chars) // BLOCK_CHARS))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int"))

    training = placed.where(~F.col("held_out"))
    model = fitted(training if sample is None else training.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample), path)

    def ask(table: pa.Table) -> pa.Table:
        """The block's distinct words with their number in training texts, by the task that owns them."""
        block = table.column("block")[0].as_py()
        own = Block(table.column("text").to_pylist())
        train = ~table.column("held_out").to_numpy()
        times = np.bincount(own.word, np.repeat(train, np.diff(own.offsets)), len(own.names)).astype(np.int32)
        part = (own.names >> np.uint64(16)) % np.uint64(count)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(count + 1, dtype=np.uint64))
        out = [(p, block, own.names[order[s:e]].tobytes(), times[order[s:e]].tobytes(), 0) for p, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])) if e > s]
        out.append((0, block, b"", b"", int(train.sum())))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()))], ["part", "block", "names", "times", "ends"])

    def answer(table: pa.Table) -> pa.Table:
        """Counts of the words in the order of each block's question, and the sums over the task's words."""
        part = table.column("part")[0].as_py()
        names = [np.frombuffer(x, np.uint64) for x in table.column("names").to_pylist()]
        whole, which = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(which, np.concatenate([np.frombuffer(x, np.int32) for x in table.column("times").to_pylist()]), len(whole)).astype(np.int64)
        back = np.split(total[which], np.cumsum([len(x) for x in names])[:-1])
        out = [(b, part, x.astype(np.int32 if not len(x) or x.max() < 2**31 else np.int64).tobytes(), 0, 0) for b, x in zip(table.column("block").to_pylist(), back) if len(x)]
        ends = sum(table.column("ends").to_pylist())
        out.append((-1, part, b"", int(total.sum()) + ends, int((total > 0).sum())))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))], ["block", "part", "counts", "tokens", "distinct"])

    asked = placed.groupBy("block").applyInArrow(ask, "part int, block int, names binary, times binary, ends long")
    answers = keep(asked.groupBy("part").applyInArrow(answer, "block int, part int, counts binary, tokens long, distinct long"))
    sums = answers.agg(F.sum("tokens"), F.sum("distinct")).first()
    ends = rows.where(~F.col("held_out")).count()
    n, distinct = int(sums[0] or 0), int(sums[1] or 0) + (ends > 0)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(own: pa.Table, back: pa.Table) -> pa.Table:
        ids, values, fold = (own.column(c) for c in ("doc_id", "text", "held_out"))
        values = values.to_pylist()
        if not values:
            return pa.table([pa.array([], k) for k in kinds], names)
        block = Block(values)
        part = (block.names >> np.uint64(16)) % np.uint64(count)
        counts = np.zeros(len(block.names), np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(count + 1, dtype=np.uint64))
        for p, raw in zip(back.column("part").to_pylist(), back.column("counts").to_pylist()):
            size = int(cuts[p + 1] - cuts[p])
            counts[order[cuts[p] : cuts[p + 1]]] = np.frombuffer(raw, np.int32 if len(raw) == 4 * size else np.int64)
        sure = lambda c: np.log10((c + 1) / (n + 1.0 * (distinct + 1)))
        summed = lambda x: np.concatenate([[0], np.cumsum(x)])[block.offsets]
        words = np.diff(block.offsets)
        known = np.diff(summed(counts[block.word] > 0)) + (ends > 0)
        base = np.diff(summed(sure(counts)[block.word])) + sure(ends)
        scores = sent.value.score(*block.subwords(Pieces.of(path)))
        columns = [ids, fold, pa.array(words + 1), pa.array(known), pa.array(np.full(len(values), n)), pa.array(base), pa.array(scores)]
        return pa.table([pa.array(c.to_pylist() if isinstance(c, pa.ChunkedArray) else c, k) for c, k in zip(columns, kinds)], names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names, kinds = [x.split()[0] for x in schema.split(", ")], [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]
    return placed.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(judge, schema)
