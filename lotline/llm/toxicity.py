"""Toxicity by a convolutional text classifier trained in numpy.

Words (runs without blanks and marks, A-Z lowered) are hashed to rows of an embedding table, whole and by their first and
last four bytes; a word is the sum of its rows. Filters over one, two and three
words run along the whole text; each filter's largest response is kept, and a logistic layer scores those. Training is
by Adam; the largest response sends its gradient to one place of the text only. The score is calibrated on labelled rows kept out of the
training: its logit is scaled and shifted so that 0.7 separates as well as can be. Thresholds by language are fitted on the same rows and given beside
the score; language, source, labels and doc_id never enter a score.

All labelled rows outside the held-out fold are used, a fifth of them (by hash) for calibration. They are dealt into blocks by hash and written once as
word buckets. In each of EPOCHS passes every block goes on from the same weights through all its texts, and the blocks' weights (and moments of training) are averaged, each
counted by its texts, an embedding by the texts of the block that have its bucket. Sums are whole numbers, so the order of tasks changes nothing; the
driver gets one set of weights a pass, and for calibration the numbers of rows by language, label and logit in steps of 1/STEP.

Null and empty texts have one padding word and a score like any other. Every row gives one row; rows repeated in labels count once (label 1 if any has it). Without both
classes among the labelled rows every score is the share of label 1.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import keep, mix, portions, span_hashes, text_bytes, texts, word_spans

#: Labelled rows and characters of all texts in a block, at most on average.
BLOCK_ROWS, BLOCK_CHARS = 6_000, 64_000_000
BUCKETS, PIECE, WIDTH, FILTERS, SPANS = 1 << 16, 4, 12, 12, (1, 2, 3)
#: Characters of texts turned into words at once, and words of texts scored or counted at once.
PART_CHARS, PART_WORDS = 500_000, 100_000
#: A bucket in fewer of the training texts has no embedding.
LEAST_TEXTS = 5
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.01, 1e-3
DECISION = 0.7
#: Pieces in which weights are added up, whole steps of a weight, steps of a logit in calibration and its largest size.
SLICES, STEPS, STEP, LARGEST = 16, 2**20, 256, 60
#: Added to second moments before their logarithm.
TINY = 1e-20
#: Marks, which stand between words like blanks do.
_PLAIN = re.compile(rb"[!-/:-@\[-`{-~]+")


def word_ids(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Three buckets for every word, from 1 (the word, its first PIECE bytes, its last), two padding words (0) behind each
    text, and where each text starts."""
    data, begins = text_bytes([_PLAIN.sub(b" ", v.encode().lower()) for v in values])
    begin, end = word_spans(data)
    count = np.diff(np.searchsorted(begin, begins))
    starts = np.zeros(len(values) + 1, np.int64)
    np.cumsum(count + max(SPANS) - 1, out=starts[1:])
    ids = np.zeros((starts[-1], 3), np.uint16)
    at = np.arange(len(begin)) + np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(count)])[:-1], count)
    for k, (s, e) in enumerate(((begin, end), (begin, np.minimum(begin + PIECE, end)), (np.maximum(end - PIECE, begin), end))):
        ids[at, k] = 1 + (mix(span_hashes(data, s, e), k) % np.uint64(BUCKETS - 1)).astype(np.uint16)
    return ids, starts


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: float = 1.0
    offset: float = 0.0
    #: First and second moments of training by part, and steps so far; not sent to the scoring.
    moments: list[tuple[np.ndarray, np.ndarray]] | None = None
    turn: int = 0

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.out]

    def responses(self, ids: np.ndarray, starts: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest response of each filter in each text, and (if asked) the first place of it."""
        length = np.diff(starts)
        vectors = self.embedding[ids[:, 0]]
        for column in ids.T[1:]:
            vectors += self.embedding[column]
        best, where = [], np.zeros((len(length), FILTERS * len(SPANS)), np.int64)
        for s, (span, weights) in enumerate(zip(SPANS, self.filters)):
            total = vectors @ weights[0]
            for k in range(1, span):
                total[: len(ids) - k] += vectors[k:] @ weights[k]
            # the window of a text's last word reaches into its padding, never into the next text
            total[np.concatenate([starts[1:] - 1 - k for k in range(span - 1)] or [[]]).astype(np.int64)] = -np.inf
            top = np.maximum.reduceat(total, starts[:-1], axis=0)
            best.append(top)
            if places:
                row, column = np.nonzero(total == np.repeat(top, length, axis=0))
                where[np.searchsorted(starts, row[::-1], "right") - 1, column[::-1] + s * FILTERS] = row[::-1]
        return np.concatenate(best, axis=1) + self.bias, where if places else None

    def logits(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.maximum(self.responses(ids, starts)[0], 0) @ self.out + self.shift

    def scores(self, values: list[str]) -> np.ndarray:
        z = self.logits(*word_ids(values)).astype(float) * self.scale + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class _Adam:
    def __init__(self, state: list[tuple[np.ndarray, np.ndarray]], turn: int):
        self.state, self.turn = state, turn

    def __call__(self, arrays: list[np.ndarray], slopes: list[np.ndarray]) -> None:
        self.turn += 1
        for (first, second), array, slope in zip(self.state, arrays, slopes):
            first += 0.1 * (slope - first)
            second += 0.001 * (slope * slope - second)
            array -= RATE * (first / (1 - 0.9**self.turn)) / (np.sqrt(second / (1 - 0.999**self.turn)) + 1e-8)


def start(times: np.ndarray, share: float, seed: int = 1) -> Model:
    """The untrained model; ``times`` is the number of training texts that have each bucket."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
    used = np.flatnonzero((times >= LEAST_TEXTS) | (np.arange(BUCKETS) == 0))
    # a word that training never saw is like padding: no filter was taught to answer to it
    embedding = _spread(draw(len(used), WIDTH, by=0.1), used)
    embedding[0] = 0
    n = FILTERS * len(SPANS)
    model = Model(embedding, [draw(span, WIDTH, FILTERS, by=0.3) for span in SPANS], np.zeros(n, np.float32), draw(n, by=0.3), float(np.log(share / (1 - share))))
    model.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parts()]
    return model


def bucket_times(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Texts that have each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for a, b in _parts(starts):
        text = np.repeat(np.arange(b - a), np.diff(starts[a : b + 1]))
        total += np.bincount(np.unique(text[:, None] * BUCKETS + ids[starts[a] : starts[b]]) % BUCKETS, minlength=BUCKETS)
    return total


def _parts(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about PART_WORDS words together, each as its first text and the one behind it."""
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, starts[-1], PART_WORDS)), len(starts) - 1)).tolist()
    return zip(cuts[:-1], cuts[1:])


def study(model: Model, ids: np.ndarray, starts: np.ndarray, label: np.ndarray, seed: int | list[int] = 1) -> Model:
    """The model after one pass over texts given as word buckets (with their padding)."""
    rng = np.random.default_rng(seed)
    present = np.zeros(BUCKETS, bool)
    present[ids.ravel()] = True
    # buckets without an embedding stay at the zeros of padding
    used = np.flatnonzero(present & model.embedding.any(axis=1))
    used = np.concatenate([[0], used[used > 0]])
    number = np.zeros(BUCKETS, np.uint16)
    number[used] = np.arange(len(used))
    own = number[ids]
    (first, second), *rest = model.moments
    adam = _Adam([(first[used], second[used]), *((a.copy(), b.copy()) for a, b in rest)], model.turn)
    model = Model(model.embedding[used], [f.copy() for f in model.filters], model.bias.copy(), model.out.copy(), model.shift)
    parts = model.parts()
    order = rng.permutation(len(label))
    for low in range(0, len(order), BATCH):
        batch = order[low : low + BATCH]
        words = np.concatenate([own[starts[i] : starts[i + 1]] for i in batch])
        begin = np.concatenate([[0], np.cumsum(np.diff(starts)[batch])])
        top, where = model.responses(words, begin, True)
        active = np.maximum(top, 0)
        z = np.clip(active @ model.out + model.shift, -30, 30)
        error = ((1 / (1 + np.exp(-z)) - label[batch]) / len(batch)).astype(np.float32)
        back = error[:, None] * model.out * (top > 0)
        slopes = [np.zeros_like(model.embedding)] + [np.zeros_like(f) for f in model.filters]
        for s, span in enumerate(SPANS):
            own_back, at = back[:, s * FILTERS : (s + 1) * FILTERS], where[:, s * FILTERS : (s + 1) * FILTERS]
            for k in range(span):
                word = words[np.minimum(at + k, len(words) - 1)]
                slopes[1 + s][k] = np.einsum("bf,bfd->df", own_back, model.embedding[word].sum(axis=2))
                for column in np.moveaxis(word, 2, 0):
                    np.add.at(slopes[0], column, own_back[:, :, None] * model.filters[s][k].T[None])
        slopes[0][0] = 0
        slopes += [back.sum(axis=0), active.T @ error]
        model.shift -= RATE * float(error.sum())
        adam(parts, [g + DECAY * p for g, p in zip(slopes, parts)])
    model.embedding, *moments = (_spread(x, used) for x in (model.embedding, *adam.state[0]))
    model.moments, model.turn = [tuple(moments), *adam.state[1:]], adam.turn
    return model


def _spread(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    whole = np.zeros((BUCKETS, WIDTH), np.float32)
    whole[at] = rows
    return whole


def train(ids: list[np.ndarray], label: np.ndarray, seed: int = 1) -> Model:
    """Fit to texts given as arrays of word buckets (with their padding)."""
    whole, starts = np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    model = start(bucket_times(whole, starts), float(label.mean()), seed)
    for turn in range(EPOCHS):
        model = study(model, whole, starts, label, [seed, turn])
    return model


def _packed(model: Model, times: np.ndarray, texts: int) -> np.ndarray:
    """Whole numbers to add up: weights, first moments and logarithms of second ones times the texts behind them, and those numbers of texts."""
    out = [np.rint([model.shift * STEPS, model.turn]).astype(np.int64) * texts, times, [texts]]
    for k, (part, (first, second)) in enumerate(zip(model.parts(), model.moments)):
        for x, steps in ((part, STEPS), (first, STEPS << 12), (np.log2(second.astype(np.float64) + TINY), 1 << 16)):
            whole = np.rint(x.astype(np.float64) * steps).astype(np.int64)
            out.append((whole * (times[:, None] if k == 0 else texts)).ravel())
    return np.concatenate(out)


def _mean(total: np.ndarray, before: Model) -> Model:
    """The mean of summed ``_packed`` models; of second moments the geometric one."""
    (shift, turn), times, texts = total[:2], total[2 : 2 + BUCKETS], total[2 + BUCKETS]
    at, parts, moments = 3 + BUCKETS, [], []
    for k, part in enumerate(before.parts()):
        mean = []
        for steps in (STEPS, STEPS << 12, 1 << 16):
            mean.append(total[at : at + part.size].reshape(part.shape) / (np.maximum(times, 1)[:, None] if k == 0 else texts) / steps)
            at += part.size
        if k == 0:  # buckets without an embedding
            mean[0][~before.embedding.any(axis=1)] = 0
        parts.append(mean[0].astype(np.float32))
        moments.append((mean[1].astype(np.float32), np.maximum(np.exp2(mean[2]) - TINY, 0).astype(np.float32)))
    embedding, *filters, bias, out = parts
    return Model(embedding, filters, bias, out, float(shift / texts / STEPS), moments=moments, turn=round(turn / texts))


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list]]:
    """block, word buckets, starts, labels and languages of each part of a block."""
    for k in range(batch.num_rows):
        block, ids, starts, label, lang = (batch.column(c)[k].as_py() for c in ("block", "ids", "starts", "label", "lang"))
        yield block, np.frombuffer(ids, np.uint16).reshape(-1, 3), np.frombuffer(starts, np.int64), np.frombuffer(label, np.uint8), lang


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers as their lowest bytes, then their second ones and so on, the sign as lowest bit: small numbers are mostly zeros to the shuffle's codec."""
    return np.ascontiguousarray(((x << 1) ^ (x >> 63)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _whole(data: bytes) -> np.ndarray:
    """The numbers of ``_planes``."""
    x = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def _summed(lessons: DataFrame, measure: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of a vector of whole numbers: tasks add up their own, then slices of it are added up."""
    kinds = pa.schema([("slice", pa.int32()), ("values", pa.binary())])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for block, ids, starts, label, _ in _read(batch):
                more = measure(block, ids, starts, label)
                total = more if isinstance(total, int) else np.add(total, more, out=total)
        if not isinstance(total, int):
            yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([_planes(x) for x in np.array_split(total, SLICES)], pa.binary())], schema=kinds)

    def merge(table: pa.Table) -> pa.Table:
        total = sum(_whole(x.as_py()) for x in table.column("values"))
        return pa.table([table.column("slice").slice(0, 1), pa.array([total.tobytes()], pa.binary())], schema=kinds)

    schema = "slice int, values binary"
    # a task for each core sends one sum, however many blocks there are
    few = lessons.coalesce(lessons.sparkSession.sparkContext.defaultParallelism)
    got = few.mapInArrow(own, schema).groupBy("slice").applyInArrow(merge, schema).toArrow().sort_by("slice")
    return np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in got.column("values")])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled texts outside the held-out fold as word buckets, by block and whether they are kept for calibration."""
    fold = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 3 != 1, F.lit(False))
    marks = labels.select(F.col("doc_id").cast("long").alias("l"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null").where(fold("l"))
    marks = marks.groupBy("l").agg(F.max("toxic").alias("toxic"))
    own = texts(docs, F.col("lang").cast("string").alias("lang")).where(fold("doc_id"))
    rows, chars = marks.count(), own.agg(F.sum(F.length("text"))).first()[0] or 0
    count = F.lit(max(1, -(-rows // BLOCK_ROWS), -(-int(chars) // BLOCK_CHARS)))
    block = lambda c: F.pmod(F.xxhash64(c), count).cast("int").alias("block")
    kinds = pa.schema([("block", pa.int32()), ("held", pa.bool_()), ("n", pa.int64()), ("positive", pa.int64()), ("ids", pa.binary()), ("starts", pa.binary()), ("label", pa.binary()), ("lang", pa.list_(pa.string()))])

    names = ["block", "doc_id", "ids", "label", "lang"]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as word buckets, a few at a time."""
        for batch in batches:
            for some in portions(batch, 2, PART_CHARS):
                ids, starts = word_ids(some.column("text").to_pylist())
                own = [ids[s:e].tobytes() for s, e in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()) if c == "ids" else some.column(c) for c in names], names)

    def cut(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        out, apart = [], mix(table.column("doc_id").to_numpy().astype(np.uint64)) % np.uint64(5) == 0
        for held in (False, True):
            some = table.filter(pa.array(apart == held))
            if some.num_rows:
                starts = np.concatenate([[0], np.cumsum(pc.binary_length(some.column("ids")).to_numpy() // (3 * 2))]).astype(np.int64)
                label = some.column("label").to_numpy().astype(np.uint8)
                out.append((table.column("block")[0].as_py(), held, len(label), int(label.sum()), b"".join(some.column("ids").to_pylist()), starts.tobytes(), label.tobytes(), some.column("lang").to_pylist()))
        return pa.table([pa.array(list(x), k) for x, k in zip(zip(*out) if out else [[]] * len(kinds), kinds.types)], schema=kinds)

    schema = "block int, held boolean, n long, positive long, ids binary, starts binary, label binary, lang array<string>"
    # only labelled texts go on, as buckets
    met = own.join(marks, F.col("doc_id") == F.col("l")).select(block("doc_id"), "doc_id", "text", (F.col("toxic") == 1).alias("label"), "lang")
    cells = met.mapInArrow(words, "block int, doc_id long, ids binary, label boolean, lang string")
    return keep(cells.groupBy("block").applyInArrow(cut, schema))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model | float, dict[str, float]]:
    """A model from all labelled rows outside the held-out fold, and a threshold for each language."""
    lessons = labelled(docs, labels)
    sizes = {r["held"]: (r["n"], r["p"]) for r in lessons.groupBy("held").agg(F.sum("n").alias("n"), F.sum("positive").alias("p")).collect()}
    both = lambda n, p: 0 < p < n
    n, p = (sum(x[k] for x in sizes.values()) for k in (0, 1))
    if not both(n, p):
        return p / n if n else 0.0, {}
    training, kept = lessons.where(~F.col("held")), lessons.where("held")
    if both(*sizes.get(False, (0, 0))):
        n, p = sizes[False]
    else:
        training, sizes = lessons, {}
    if not both(*sizes.get(True, (0, 0))):
        kept = lessons
    model = start(_summed(training, lambda block, ids, starts, label: bucket_times(ids, starts)), p / n)
    for turn in range(EPOCHS):
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def one(block: int, ids: np.ndarray, starts: np.ndarray, label: np.ndarray, sent=sent, turn: int = turn) -> np.ndarray:
            return _packed(study(sent.value, ids, starts, label, [1, turn, block]), bucket_times(ids, starts), len(label))

        model = _mean(_summed(training, one), model)
    model.moments = None
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for _, ids, starts, label, lang in _read(batch):
                z = np.concatenate([own.logits(ids[starts[a] : starts[b]], starts[a : b + 1] - starts[a]) for a, b in _parts(starts)])
                step = np.rint(np.clip(z, -LARGEST, LARGEST) * STEP).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(label.astype(np.int32)), pa.array(step)], ["lang", "label", "step"])

    counts = kept.mapInArrow(judge, "lang string, label int, step int").groupBy("lang", "label", "step").count().toArrow()
    langs, label, step, times = (counts.column(c).to_pylist() for c in ("lang", "label", "step", "count"))
    label, times, z = np.array(label), np.array(times, np.int64), np.array(step) / STEP
    edge = _threshold(z, label, times)
    middle = np.average(z, weights=times)
    spread = max(float(np.sqrt(np.average((z - middle) ** 2, weights=times))), 1e-6)
    model.scale, model.offset = 4.0 / spread, float(np.log(DECISION / (1 - DECISION)) - edge * 4.0 / spread)
    score = 1 / (1 + np.exp(-np.clip(z * model.scale + model.offset, -500, 500)))
    by_lang = {}
    for lang in sorted({x for x in langs if x}):
        mine = np.array([x == lang for x in langs])
        if label[mine].min() != label[mine].max():
            by_lang[lang] = float(_threshold(score[mine], label[mine], times[mine]))
    return model, by_lang


def _threshold(score: np.ndarray, label: np.ndarray, times: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the fewest errors; a score and label stands for ``times`` rows."""
    s, at = np.unique(score.astype(float), return_inverse=True)
    ones, zeros = (np.bincount(at, times * (label == k), len(s)) for k in (1, 0))
    wrong = np.concatenate([[0], np.cumsum(ones)]) + np.concatenate([np.cumsum(zeros[::-1])[::-1], [0]])
    edges = np.concatenate([[s[0] - 1e-3], (s[1:] + s[:-1]) / 2, [s[-1] + 1e-3]])
    width = np.concatenate([[0], np.diff(s), [0]])
    best = np.flatnonzero(wrong == wrong.min())
    return float(edges[best[np.argmax(width[best])]])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and whether the score reaches the threshold of the row's language."""
    model, by_lang = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for some in portions(batch, 1, PART_CHARS):
                score_ = np.full(some.num_rows, own) if isinstance(own, float) else own.scores(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("lang"), pa.array(score_)], ["doc_id", "lang", "score"])

    scored = texts(docs, F.col("lang").cast("string").alias("lang")).mapInArrow(run, "doc_id long, lang string, score double")
    limit = F.lit(DECISION)
    for lang, edge in by_lang.items():
        limit = F.when(F.col("lang") == lang, F.lit(edge)).otherwise(limit)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"), (F.col("score") >= limit).alias("by_language"))
