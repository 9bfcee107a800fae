"""Many k-means models in one scan: sweeps over k, restarts and stability samples share every pass over the rows.

A candidate is a number of clusters, a start and, for stability, a hash sample of the rows. Each round reads the stored rows once: a task
assigns its rows for all candidates with matrix products and sends one vector of sums for each (candidate, cluster), Spark adds
these up, and only centres (candidates x k x columns numbers) are on the driver. Starts are the rows with the smallest hash of start and
key, so results depend on nothing but the rows. Rows with a null or NaN in any column are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lotline.operators.ranked import hash_share
from lotline.runtime import stored


@dataclass(frozen=True)
class Candidate:
    k: int
    start: int = 0
    #: Seed of the hash sample that the model sees; None: all rows.
    sample: int | None = None


@dataclass
class Models:
    """Rows as stored (key, x, inside), the samples' seeds, the candidates and their centres (k x columns each)."""

    rows: DataFrame
    key: str
    samples: list[int]
    candidates: list[Candidate]
    centres: list[np.ndarray]

    def summed(self, measure: Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, int, np.ndarray]]]) -> dict[tuple[int, int], np.ndarray]:
        """Sums over all rows of vectors that ``measure`` gives for blocks of rows (x, inside), by (candidate, place)."""
        key = self.key

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for c, place, value in measure(*_arrays(batch)):
                    total[c, place] = total[c, place] + value if (c, place) in total else value
            names = [(c, j, i, float(v)) for (c, j), value in total.items() for i, v in enumerate(value)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*names) if names else [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.float64()))], ["c", "j", "i", "v"])

        sums = self.rows.drop(key).mapInArrow(part, "c int, j int, i int, v double").groupBy("c", "j", "i").agg(F.sum("v").alias("v"))
        out: dict[tuple[int, int], dict[int, float]] = {}
        for r in sums.collect():  # candidates x clusters x columns
            out.setdefault((r.c, r.j), {})[r.i] = r.v
        return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x, inside = (batch.column(batch.schema.get_field_index(c)) for c in ("x", "inside"))
    return (c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in (x, inside))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    which = gap.argmin(axis=1)
    return which, np.maximum(gap[np.arange(len(x)), which], 0.0)


def _sums(which: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    return (which[None, :] == np.arange(k)[:, None]).astype(float) @ values


def kmeans_many(df: DataFrame, key: str, cols: Sequence[str], candidates: Sequence[Candidate], rounds: int = 20, frac: float = 0.8) -> Models:
    """Lloyd's rounds for all candidates at once; a centre without rows stays where it is."""
    samples = sorted({c.sample for c in candidates if c.sample is not None})
    known = df.where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in cols))
    inside = F.array(F.lit(True), *[hash_share([key], s) < frac for s in samples])
    rows = stored(known.select(key, F.array(*[F.col(c).cast("double") for c in cols]).alias("x"), inside.alias("inside")))
    place = {None: 0, **{s: i + 1 for i, s in enumerate(samples)}}
    pairs = sorted({(c.start, place[c.sample]) for c in candidates})
    most = max(c.k for c in candidates)
    drawn = rows.select(key, "x", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])).alias("s"), "inside").where(F.get("inside", F.col("s.b")))
    order = F.md5(F.concat_ws("|", F.col("s.a").cast("string"), F.col(key).cast("string")))
    first = drawn.withColumn("r", F.row_number().over(W.partitionBy("s.a", "s.b").orderBy(order, key))).where(F.col("r") <= most)
    seeds: dict[tuple[int, int], list] = {}
    for r in first.select("s.a", "s.b", "r", "x").orderBy("r").collect():
        seeds.setdefault((r.a, r.b), []).append(r.x)
    some = list(candidates)
    centres = [np.array(seeds.get((c.start, place[c.sample]), [])[: c.k]).reshape(-1, len(cols)) for c in some]
    models = Models(rows, key, samples, some, centres)
    at = [place[c.sample] for c in some]
    for _ in range(rounds):
        now = models.centres

        def step(x: np.ndarray, inside: np.ndarray, now: list = now) -> Iterator[tuple[int, int, np.ndarray]]:
            for c, centre in enumerate(now):
                own = x[inside[:, at[c]]]
                if len(own) and len(centre):
                    which, _ = _nearest(own, centre)
                    total = _sums(which, np.column_stack([np.ones(len(own)), own]), len(centre))
                    yield from ((c, j, total[j]) for j in range(len(centre)) if total[j, 0])

        sums = models.summed(step)
        models.centres = [np.array([sums[c, j][1:] / sums[c, j][0] if (c, j) in sums else v for j, v in enumerate(centre)]).reshape(centre.shape) for c, centre in enumerate(now)]
        if all(np.array_equal(a, b) for a, b in zip(now, models.centres)):
            break
    return models


def labels(models: Models, which: Sequence[int]) -> DataFrame:
    """key and, for the chosen candidates, the cluster of every row as columns c<number>."""
    centres, key = {c: models.centres[c] for c in which}, models.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _arrays(batch)
            found = [pa.array(_nearest(x, v)[0], pa.int32()) for v in centres.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], [key, *[f"c{c}" for c in centres]])

    kind = models.rows.schema[key].dataType.simpleString()
    return models.rows.mapInArrow(run, ", ".join([f"{key} {kind}", *[f"c{c} int" for c in centres]]))


def indices(models: Models) -> DataFrame:
    """candidate, k, start, sample, cost (inertia), silhouette (squared Euclidean), calinski_harabasz, davies_bouldin, min_share of every
    candidate over the rows that it saw: two passes for all of them."""
    at = [0 if c.sample is None else models.samples.index(c.sample) + 1 for c in models.candidates]
    centres = models.centres

    def first(x: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        for c, centre in enumerate(centres):
            own = x[inside[:, at[c]]]
            if len(own) and len(centre):
                which, gap = _nearest(own, centre)
                total = _sums(which, np.column_stack([np.ones(len(own)), gap, (own * own).sum(axis=1), own]), len(centre))
                yield from ((c, j, total[j]) for j in range(len(centre)) if total[j, 0])

    stats = models.summed(first)
    full = {c: sorted(j for d, j in stats if d == c) for c in range(len(centres))}
    size = {c: np.array([stats[c, j][0] for j in full[c]]) for c in full}
    square = {c: np.array([stats[c, j][2] for j in full[c]]) for c in full}
    total = {c: np.array([stats[c, j][3:] for j in full[c]]).reshape(len(full[c]), -1) for c in full}

    def second(x: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        for c, centre in enumerate(centres):
            own = x[inside[:, at[c]]]
            if not len(own) or not len(centre):
                continue
            which = np.searchsorted(full[c], _nearest(own, centre)[0])
            mean = total[c] / size[c][:, None]
            away = np.sqrt(((own - mean[which]) ** 2).sum(axis=1))
            gaps = size[c] * (own * own).sum(axis=1)[:, None] + square[c] - 2 * own @ total[c].T
            row = np.arange(len(own))
            inner = gaps[row, which] / np.maximum(size[c][which] - 1, 1)
            others = gaps / size[c]
            others[row, which] = np.inf
            outer = others.min(axis=1)
            score = np.where((size[c][which] > 1) & np.isfinite(outer), (outer - inner) / np.maximum(np.maximum(inner, np.where(np.isfinite(outer), outer, 0.0)), 1e-300), 0.0)
            sums = _sums(which, np.column_stack([away, score]), len(full[c]))
            yield from ((c, j, sums[j]) for j in range(len(full[c])))

    spread = models.summed(second)
    out = []
    for c, cand in enumerate(models.candidates):
        k, n = len(full[c]), float(size[c].sum())
        cost = float(sum(stats[c, j][1] for j in full[c]))
        quality = [None, None, None]
        if k > 1:
            mean = total[c] / size[c][:, None]
            grand = total[c].sum(axis=0) / n
            between = float((size[c] * ((mean - grand) ** 2).sum(axis=1)).sum())
            within = float((square[c] - size[c] * (mean * mean).sum(axis=1)).sum())
            wide = np.array([spread[c, j][0] for j in range(k)]) / size[c]
            worst = [max((wide[a] + wide[b]) / math.dist(mean[a], mean[b]) for b in range(k) if b != a and math.dist(mean[a], mean[b]) > 0) for a in range(k)]
            quality = [float(sum(spread[c, j][1] for j in range(k)) / n), (between / (k - 1)) / (within / (n - k)) if within > 0 and n > k else None, float(sum(worst) / k)]
        out.append((c, cand.k, cand.start, cand.sample, cost, *quality, float(size[c].min() / n) if k else None))
    return models.rows.sparkSession.createDataFrame(out, "candidate int, k int, start int, sample int, cost double, silhouette double, calinski_harabasz double, davies_bouldin double, min_share double")


def agreement(models: Models, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """candidate a, candidate b, ari: adjusted Rand index of two candidates over the rows that the second one saw, all in one pass."""
    at = {b: 0 if models.candidates[b].sample is None else models.samples.index(models.candidates[b].sample) + 1 for _, b in pairs}
    centres = models.centres

    def count(x: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        of = {c: _nearest(x, centres[c])[0] for c in {c for pair in pairs for c in pair}}
        for p, (a, b) in enumerate(pairs):
            own = inside[:, at[b]]
            wide = len(centres[b])
            yield p, 0, np.bincount(of[a][own] * wide + of[b][own], minlength=len(centres[a]) * wide).astype(float)

    def two(n: np.ndarray) -> float:
        return float((n * (n - 1) / 2).sum())

    rows = []
    for (p, _), cells in sorted(models.summed(count).items()):
        a, b = pairs[p]
        table = cells.reshape(len(centres[a]), len(centres[b]))
        both, left, right, n = two(table), two(table.sum(axis=1)), two(table.sum(axis=0)), float(table.sum())
        expected, top = left * right / max(n * (n - 1) / 2, 1), (left + right) / 2
        rows.append((a, b, 1.0 if top == expected else float((both - expected) / (top - expected))))
    return models.rows.sparkSession.createDataFrame(rows, "a int, b int, ari double")


def kmeans_sweep(df: DataFrame, key: str, cols: Sequence[str], ks: Sequence[int], starts: int = 3, rounds: int = 20) -> DataFrame:
    """I4: for each k the start with the least cost (ties: the first) and its indices; all k and starts share every scan."""
    models = kmeans_many(df, key, cols, [Candidate(k, s) for k in ks for s in range(starts)], rounds)
    best = W.partitionBy("k").orderBy("cost", "start")
    found = indices(models).withColumn("_r", F.row_number().over(best)).where(F.col("_r") == 1)
    return found.select(F.lit("kmeans").alias("algo"), "k", "start", "cost", "silhouette", "calinski_harabasz", "davies_bouldin", "min_share")


def stability(df: DataFrame, key: str, cols: Sequence[str], ks: Sequence[int], samples: int = 15, frac: float = 0.8, rounds: int = 20) -> DataFrame:
    """I8: per k the mean and deviation of the ARI between the model of all rows and those of ``samples`` hash samples."""
    some = [Candidate(k, 0, s) for k in ks for s in [None, *range(1, samples + 1)]]
    models = kmeans_many(df, key, cols, some, rounds, frac)
    each = samples + 1
    found = agreement(models, [(i * each, i * each + s) for i in range(len(ks)) for s in range(1, each)])
    k = F.element_at(F.array(*[F.lit(k) for k in ks]), (F.col("a") / each).cast("int") + 1)
    return found.groupBy(k.alias("k")).agg(F.count("*").alias("rounds"), F.avg("ari").alias("ari_mean"), F.stddev_pop("ari").alias("ari_std"))
