"""Centroid clustering (Lloyd's rounds on integer vectors) that skips distances by Ptolemaic pivots.

For pivots p, s, a vector q and a centroid o, Ptolemy's inequality gives d(q,o) * d(p,s) >= |d(q,p) * d(o,s) - d(q,s) * d(o,p)|. The pivots are
fixed, so a vector's distances to them are computed once and stored beside it; a centroid's are computed once a round. Products are
rounded against the bound, so it is never above the true distance. The centroid of the least bound is measured first; those whose
bound is no more than that are measured too, in exact integers, and nothing else is.

Each round is one pass over the stored vectors. Tasks add up sums and counts of their vectors per cluster, one row a cluster leaves a
partition, and the driver sees k sums. So a cluster that holds nearly all vectors costs a task no more than an even one.

Kept are vectors of exactly ``dims`` components, none null or non-finite (nor when multiplied by ``scale``); others give no row. Seeds are the
rows with the smallest hash of their id (null: no digits), equal hashes by components; repeated rows are vectors of their own. Fewer kept
vectors than k give as many clusters. An empty table gives no rows. Components of any size are summed and compared exactly: a
vector with one of 2**27 or more is checked against every centroid in Python integers, a distance or sum beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import keep

K, ROUNDS, DIMS, SCALE, SALT = 40, 5, 64, 256, 2
#: Pivots are chosen among the seeds, each the farthest from those before; all pairs of them give bounds.
PIVOTS = 6
#: Components below this keep any squared distance of 64 components below 2**62.
WIDE = 1 << 27
#: Vectors compared together, and pairs measured together.
BLOCK, PAIRS = 4096, 65_536
#: Relative slack that covers the rounding of roots, products and the quotient.
SLACK = 2.0**-46
LONG = 2**63 - 1


def as_integers(row: list, scale: int = SCALE) -> list[int]:
    return [math.floor(scale * float(x)) for x in row]


def squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


@dataclass
class Pivots:
    points: np.ndarray  # pivots x dims
    pairs: list[tuple[int, int, float]]  # two pivots, and their distance

    @classmethod
    def among(cls, seeds: list[list[int]], n: int = PIVOTS) -> Pivots:
        """Farthest-first among the seeds; those with huge components are left out, equal ones too."""
        fit = [s for s in seeds if max(map(abs, s), default=0) < WIDE]
        chosen = fit[:1]
        while chosen and len(chosen) < n:
            far = max(fit, key=lambda s: min(squared(s, c) for c in chosen))
            if min(squared(far, c) for c in chosen) == 0:
                break
            chosen.append(far)
        width = len(seeds[0]) if seeds else 0
        pairs = [(i, j, math.sqrt(squared(chosen[i], chosen[j]))) for i in range(len(chosen)) for j in range(i)]
        return cls(np.array(chosen, np.int64).reshape(len(chosen), width), pairs)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From each row to each pivot; the square is an exact integer, the root is rounded."""
        out = np.empty((len(x), len(self.points)))
        for i, p in enumerate(self.points):
            gap = x - p
            out[:, i] = np.sqrt(np.einsum("ij,ij->i", gap, gap).astype(float))
        return out

    def bounds(self, rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """A number no larger than the distance of each row and centre, from the distances of both to the pivots."""
        best = np.zeros((len(rows), len(centres)))
        for i, j, apart in self.pairs:
            one, two = rows[:, i, None] * centres[:, j], rows[:, j, None] * centres[:, i]
            np.maximum(best, (np.abs(one - two) - (one + two) * SLACK) * ((1 - SLACK) / apart), out=best)
        return best


class Assigner:
    """The nearest centroid of each vector of a block."""

    def __init__(self, centroids: list[list[int]], pivots: Pivots):
        self.k, self.pivots = len(centroids), pivots
        self.whole = np.array(centroids, object).reshape(self.k, -1)
        self.narrow = all(max(map(abs, c), default=0) < WIDE for c in centroids)
        if self.narrow:
            self.centres = self.whole.astype(np.int64)
            self.reach = pivots.distances(self.centres)

    def exactly(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Against every centroid in integers of any size."""
        which, how_far = [], []
        for row in x.astype(object):
            all_of = [int(((row - c) ** 2).sum()) for c in self.whole]
            which.append(all_of.index(min(all_of)))
            how_far.append(min(all_of))
        return np.array(which, np.int64), how_far

    def measure(self, x: np.ndarray, row: np.ndarray, centre: np.ndarray) -> np.ndarray:
        out = np.empty(len(row), np.int64)
        for low in range(0, len(row), PAIRS):
            s = slice(low, low + PAIRS)
            gap = x[row[s]] - self.centres[centre[s]]
            np.einsum("ij,ij->i", gap, gap, out=out[s])
        return out

    def nearest(self, x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Cluster and squared distance of each row, and the number of distances that were measured."""
        low = self.pivots.bounds(rows, self.reach)
        at, first = np.arange(len(x)), low.argmin(axis=1)
        full = np.full(low.shape, LONG, np.int64)
        full[at, first] = near = self.measure(x, at, first)
        open_ = low <= (np.sqrt(near.astype(float)) * (1 + SLACK))[:, None]
        open_[at, first] = False
        row, centre = np.nonzero(open_)
        full[row, centre] = self.measure(x, row, centre)
        which = full.argmin(axis=1)
        return which, full[at, which], len(x) + len(row)


STORED = "vec_id long, components binary, reach binary, wide boolean"


def prepared(vectors: DataFrame, pivots: Pivots, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """Integer vectors (32-bit, wide ones 64-bit floats, which hold any floor of a float) and their distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                x = np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float) * scale).reshape(-1, dims)
                wide = (np.abs(x) >= WIDE).any(axis=1)
                reach = pivots.distances(np.where(wide[:, None], 0, x).astype(np.int64))
                held = [v.tobytes() if w else v.astype("<i4").tobytes() for v, w in zip(x, wide)]
                arrays = [part.column(0), pa.array(held, pa.binary()), pa.array([r.tobytes() for r in reach], pa.binary()), pa.array(wide)]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in STORED.split(", ")])

    return vectors.mapInArrow(run, STORED)


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray | None]]:
    """Rows with their components and pivot distances; wide ones as integers of any size without distances."""
    for low in range(0, batch.num_rows, BLOCK):
        part = batch.slice(low, BLOCK)
        wide = part.column("wide").to_numpy(zero_copy_only=False)
        for flag in (False, True):
            some = part.filter(pa.array(wide == flag))
            if not some.num_rows:
                continue
            raw = b"".join(some.column("components").to_pylist())
            if flag:
                yield some, np.array([int(v) for v in np.frombuffer(raw)], object).reshape(-1, dims), None
            else:
                yield some, np.frombuffer(raw, "<i4").astype(np.int64).reshape(-1, dims), np.frombuffer(b"".join(some.column("reach").to_pylist())).reshape(some.num_rows, -1)


def _assign(to: Assigner, x: np.ndarray, reach: np.ndarray | None) -> tuple[np.ndarray, list[int]]:
    if reach is None or not to.narrow:
        return to.exactly(x)
    which, far, _ = to.nearest(x, reach)
    return which, far.tolist()


def moved(stored: DataFrame, centroids: list[list[int]], pivots: Pivots, dims: int = DIMS) -> list[list[int]]:
    """The centroids after one round: exact floors of the means of their vectors; empty ones stay."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Assigner(centroids, pivots)
        count, sums = [0] * to.k, np.zeros((to.k, dims), object)
        for batch in batches:
            for _, x, reach in _blocks(batch, dims):
                which, _ = _assign(to, x, reach)
                for c in np.unique(which).tolist():
                    members = x[which == c]
                    count[c] += len(members)
                    sums[c] += members.sum(axis=0).astype(object)
        full = [c for c in range(to.k) if count[c]]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([count[c] for c in full], pa.int64()), pa.array([[str(v) for v in sums[c]] for c in full], pa.list_(pa.string()))], ["cluster", "n", "sums"])

    def total(table: pa.Table) -> pa.Table:
        sums = [0] * dims
        for row in table.column("sums"):
            sums = [a + int(b.as_py()) for a, b in zip(sums, row)]
        n = sum(table.column("n").to_pylist())
        return pa.table({"cluster": table.column("cluster").slice(0, 1), "mean": pa.array([[str(s // n) for s in sums]], pa.list_(pa.string()))})

    rows = stored.mapInArrow(part, "cluster int, n long, sums array<string>").groupBy("cluster").applyInArrow(total, "cluster int, mean array<string>").collect()
    means = {r.cluster: [int(v) for v in r.mean] for r in rows}
    return [means.get(c, old) for c, old in enumerate(centroids)]


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: int = SALT) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every kept row of vec_id and embedding."""
    spark = vectors.sparkSession
    limit = F.lit(1.7976931348623157e308)
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) <= limit))
    # NaN is above every number, so it fails the comparison
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where((F.size("embedding") == dims) & sound)
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = kept.select("embedding", digest.alias("h")).orderBy("h", "embedding").limit(k).collect()
    centroids = [as_integers(r.embedding, scale) for r in seeds]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    pivots = Pivots.among(centroids)
    stored = keep(prepared(kept, pivots, dims, scale))
    for _ in range(rounds):
        centroids = moved(stored, centroids, pivots, dims)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Assigner(centroids, pivots)
        for batch in batches:
            for some, x, reach in _blocks(batch, dims):
                which, far = _assign(to, x, reach)
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), pa.array(which, pa.int32()), pa.array([d if d <= LONG else None for d in far], pa.int64())], ["vec_id", "cluster", "distance"])

    found = keep(stored.mapInArrow(last, "vec_id long, cluster int, distance long"))
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(20,0)")))
    sums = {r.cluster: r.total for r in found.groupBy("cluster").agg(whole.alias("total")).collect()}
    everything = None if None in sums.values() else sum(map(int, sums.values()))
    fits = {c: int(v) if v is not None and v <= LONG else None for c, v in sums.items()}
    rows = [(c, fits.get(c), everything if everything is not None and everything <= LONG else None, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """All distances of all rounds, in plain SQL (components small enough for exact doubles)."""
    assign = """a{r} AS MATERIALIZED (SELECT rid, min({{'d': d, 'c': c}}) m FROM (SELECT rid, c, list_inner_product(v.x, v.x) + list_inner_product(o.x, o.x) - 2 * list_inner_product(v.x, o.x) d FROM v, c{r} o) GROUP BY rid)"""
    move = """s{r} AS (SELECT m.c c, i, sum(CAST(x[i] AS BIGINT)) s, count(*) n FROM a{r} JOIN v USING (rid), range(1, 65) g(i) GROUP BY ALL),
n{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS DOUBLE) ORDER BY i) x FROM s{r} GROUP BY c),
c{q} AS MATERIALIZED (SELECT o.c, coalesce(n{r}.x, o.x) x FROM c{r} o LEFT JOIN n{r} USING (c))"""
    steps = []
    for r in range(ROUNDS):
        steps += [assign.format(r=r), move.format(r=r, q=r + 1)]
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () rid, CAST(vec_id AS BIGINT) vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 c, x FROM (SELECT x, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) h FROM v) QUALIFY c < 40),
{", ".join(steps)},
{assign.format(r=ROUNDS)},
e AS (SELECT vec_id, m.c c, CAST(m.d AS BIGINT) d, o.x FROM a{ROUNDS} JOIN v USING (rid) JOIN c{ROUNDS} o ON o.c = m.c)
SELECT vec_id, CAST(c AS INTEGER) "cluster", d distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) cluster_inertia, CAST(sum(d) OVER () AS BIGINT) inertia,
  sha256(array_to_string(list_transform(o_x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ',')) centroid_sha256
FROM (SELECT vec_id, c, d, x o_x FROM e)
"""


SQL = _sql()
