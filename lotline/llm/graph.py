"""Links between ids, found and joined without a large group in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import keep, mix

#: Bucket values in one reduce task; features of a block of members, each counted as LEAST_FEATURES at least, so that a block
#: has a thousand members at most.
BUCKET_VALUES, BLOCK_FEATURES, LEAST_FEATURES = 1_000_000, 300_000, 300
#: Groups up to this many members, without weights, are compared many at once.
SMALL_GROUP = 16


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its connected component) for every node of the links (a, b), all long.

    Distributed union-find: large-star hangs a node's larger neighbours on its smallest one, small-star its smaller ones,
    in turns until nothing moves. Each turn is written to the shared folder. No links: no rows.
    """
    at = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = at.union(at.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        at = keep(small.where("a <> b").distinct())
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(at.select("b", "b").distinct())


def _stars(values: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of all ids of a value to one of them, and one id for each value."""
    order = np.argsort(values)
    values, ids = values[order], ids[order]
    first = np.flatnonzero(np.diff(values, prepend=values[:1] + np.uint64(1)))
    centre = np.repeat(ids[first], np.diff(np.append(first, len(ids))))
    far = ids != centre
    return ids[far], centre[far], values[first], ids[first]


def bucket_links(signatures: DataFrame, values: int, bands: int) -> DataFrame:
    """Links (a, b), not distinct, that join all ids with a bucket value in common; input: ids and bands, arrays of long with
    ``bands`` values for each id in turn.

    Values are packed as arrays. Each batch first joins its own ids of a value and sends one of them on, so a value that
    every id has costs a task no more than the number of batches. ``values``, their number, sets the number of reduce tasks.
    """
    width = max(1, -(-values // BUCKET_VALUES))
    names = ["part", "values", "ids"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            a, b, values, ids = _stars(values.view(np.uint64), np.repeat(ids, bands))
            part = (values >> np.uint64(20)) % np.uint64(width)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(width + 1, dtype=np.uint64))
            out = [(-1, a.tobytes(), b.tobytes())] + [(i, values[order[s:e]].tobytes(), ids[order[s:e]].tobytes()) for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])) if e > s]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, values, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if part < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (values, ids)], ["a", "b"])
                else:
                    held.setdefault(part, []).append((np.frombuffer(values, np.uint64), np.frombuffer(ids, np.int64)))
        for pairs in held.values():
            a, b, _, _ = _stars(np.concatenate([v for v, _ in pairs]), np.concatenate([i for _, i in pairs]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    packed = signatures.select("ids", "bands").mapInArrow(local, "part int, values binary, ids binary")
    spread = F.when(F.col("part") < 0, F.pmod(F.hash("values"), F.lit(width))).otherwise(F.col("part"))
    return packed.repartition(width, spread).mapInArrow(meet, "a long, b long")


Featurise = Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two weight vectors over the same features: the sum over d of 1 / sum over e of max(a[e] / a[d], b[e] / b[d])."""
    common = (a > 0) & (b > 0)
    if not common.any():
        return 0.0
    ratio = np.where(a > 0, b / np.where(a > 0, a, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    up = np.concatenate([[0.0], np.cumsum(a[order])])
    down = np.concatenate([np.cumsum(b[order][::-1])[::-1], [0.0]])
    at = np.searchsorted(ratio[order], ratio[common], "left")
    return float((1.0 / (up[at] / a[common] + down[at] / b[common])).sum())


#: Up to so many texts are compared by all features at once; of more, features dealt into SLOTS first tell which can be similar.
FEW_TEXTS, SLOTS = 64, 4096


def similar(doc: np.ndarray, feature: np.ndarray, weight: np.ndarray, n: int, threshold: float, side: np.ndarray | None = None) -> np.ndarray:
    """Pairs (i, j) of n texts whose probability Jaccard is at least ``threshold``; with ``side`` (of each text) all such pairs of
    two sides, and perhaps others. Features are in the order of texts.

    The mass of a text in slots that the other has features in bounds its mass on common features from above. The pairs within
    the bound part the texts into groups, and only within these the features themselves are compared.
    """
    if n <= FEW_TEXTS:
        return _similar(doc, feature, weight, n, threshold)
    total = np.bincount(doc, weight, n)
    rows, cols = (np.arange(n),) * 2 if side is None else (np.flatnonzero(side == v) for v in (False, True))
    grid = np.bincount(doc * SLOTS + (mix(feature, 11) % np.uint64(SLOTS)).astype(np.int64), weight, n * SLOTS).astype(np.float32).reshape(n, SLOTS)
    some, need = (grid > 0).astype(np.float32), (threshold - 1e-5) * total
    possible = grid[rows] @ some[cols].T >= need[rows][:, None]
    back = possible.T if side is None else grid[cols] @ some[rows].T >= need[cols][:, None]
    i, j = np.nonzero(possible & (back if side is None else back.T))
    del grid, some, possible, back
    i, j = rows[i], cols[j]
    i, j = i[i != j], j[i != j]
    group = np.arange(n)
    while True:
        least = group.copy()
        np.minimum.at(least, i, group[j])
        np.minimum.at(least, j, group[i])
        least = least[least]
        if (least == group).all():
            break
        group = least
    size = np.bincount(group, minlength=n)[group]
    plain = np.bincount(doc, weight != 1, n) == 0
    easy = (size <= SMALL_GROUP) & (np.bincount(group, ~plain, n)[group] == 0) & (size > 1)
    use = easy[doc]
    out = [similar_in_small_groups(group, doc[use], feature[use], n, threshold)]
    place = np.zeros(n, np.int64)
    for g in np.unique(group[(size > 1) & ~easy]):
        own = np.flatnonzero(group == g)
        place[own] = np.arange(len(own))
        use = group[doc] == g
        out.append(own[_similar(place[doc[use]], feature[use], weight[use], len(own), threshold)])
    return np.concatenate(out)


def _similar(doc: np.ndarray, feature: np.ndarray, weight: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Pairs (i, j) of n texts whose probability Jaccard is at least ``threshold``, by all features at once.

    The mass that either text has on common features bounds the similarity from above; only pairs within the bound are compared.
    """
    name, column = np.unique(feature, return_inverse=True)
    shared = np.bincount(column) > 1
    total = np.bincount(doc, weight, n)
    plain = np.bincount(doc, weight != 1, n) == 0
    mass = np.zeros((n, n), np.float32)
    use = shared[column]
    rank = (np.cumsum(shared) - 1)[column[use]]
    d, w = doc[use], weight[use]
    order = np.argsort(rank, kind="stable")
    d, w, rank = d[order], w[order], rank[order]
    step = max(1, 8_000_000 // max(1, n))
    for low in range(0, int(rank[-1]) + 1 if len(rank) else 0, step):
        s, e = np.searchsorted(rank, (low, low + step))
        grid = np.zeros((n, min(step, int(rank[-1]) + 1 - low)), np.float32)
        grid[d[s:e], rank[s:e] - low] = w[s:e]
        mass += grid @ (grid > 0).T.astype(np.float32)
    near = mass >= ((threshold - 1e-5) * total)[:, None]
    i, j = np.nonzero(np.triu(near & near.T, 1))
    both = mass[i, j].astype(float)
    score = both / (total[i] + total[j] - both)
    order = np.argsort(doc, kind="stable")
    cuts = np.searchsorted(doc[order], np.arange(n + 1))
    for k in np.flatnonzero(~(plain[i] & plain[j])):
        x, y = order[cuts[i[k]] : cuts[i[k] + 1]], order[cuts[j[k]] : cuts[j[k] + 1]]
        union, place = np.unique(np.concatenate([column[x], column[y]]), return_inverse=True)
        a, b = np.zeros(len(union)), np.zeros(len(union))
        a[place[: len(x)]], b[place[len(x) :]] = weight[x], weight[y]
        score[k] = probability_jaccard(a, b)
    good = score >= threshold - 1e-9
    return np.stack([i[good], j[good]], axis=1)


def similar_in_small_groups(group: np.ndarray, doc: np.ndarray, feature: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Pairs (i, j) of n texts of one group each whose Jaccard similarity is at least ``threshold``, for many groups at once.

    Features have no weights and are in the order of texts; pairs are counted per common feature, so groups should be small.
    """
    size = np.bincount(doc, minlength=n)
    name = mix(feature ^ mix(group[doc].astype(np.uint64), 5))
    order = np.argsort(name, kind="stable")
    name, doc = name[order], doc[order]
    found, lag = [np.zeros(0, np.int64)], 1
    at = np.arange(len(name))
    while True:
        at = at[at + lag < len(name)]
        at = at[name[at] == name[at + lag]]
        if not len(at):
            break
        found.append(doc[at] * n + doc[at + lag])
        lag += 1
    code, both = np.unique(np.concatenate(found), return_counts=True)
    i, j = code // n, code % n
    good = both >= (threshold - 1e-9) * (size[i] + size[j] - both)
    return np.stack([i[good], j[good]], axis=1)


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The pairs that a union-find needs, at most n - 1; those that join nothing new are left out many at a time."""
    up = list(range(n))
    out = []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    while len(pairs):
        _, one = np.unique(pairs[:, 1], return_index=True)
        for i, j in pairs[one].tolist():
            a, b = top(i), top(j)
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((i, j))
        roots = np.array([top(i) for i in range(n)])
        pairs = pairs[roots[pairs[:, 0]] != roots[pairs[:, 1]]]
    return out


def verified_links(members: DataFrame, features: Featurise, threshold: float) -> DataFrame:
    """Links (a, b) between members of a candidate group that are similar: enough of them to join all that similar pairs join.

    ``members``: id, root (its group), size (number of features) and text. A group beyond BLOCK_FEATURES is dealt into blocks and
    every two blocks meet in one task, so a task's memory is bounded whatever the group; small groups share tasks.
    """
    members = keep(members)
    sizes = members.groupBy("root").agg(F.sum(F.greatest("size", F.lit(LEAST_FEATURES))).alias("total"))
    whole = sizes.agg(F.sum("total")).first()[0] or 0
    tasks = max(1, int(whole) // BLOCK_FEATURES)
    blocks = F.ceil(F.col("total") / BLOCK_FEATURES).cast("long")
    placed = members.join(sizes, "root").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    alone = F.array(F.struct(F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("g"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j")))
    spread = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.col("root").alias("g"), F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j")))
    dealt = placed.select("root", "id", "text", "block", F.explode(F.when(F.col("blocks") == 1, alone).otherwise(spread)).alias("k")).select("k.*", "root", "id", "text", "block")

    def compare(table: pa.Table) -> pa.Table:
        roots, ids, block = (table.column(c).to_numpy() for c in ("root", "id", "block"))
        far = block == table.column("j")[0].as_py() if table.column("i")[0].as_py() != table.column("j")[0].as_py() else None  # the pairs within a block have a task
        _, one = np.unique(ids, return_index=True)
        one = one[np.argsort(roots[one], kind="stable")]
        roots, ids, far = roots[one], ids[one], far if far is None else far[one]
        doc, feature, weight = features(table.column("text").take(pa.array(one)).to_pylist())
        cuts = np.flatnonzero(np.diff(roots, prepend=roots[0] - 1, append=roots[-1] + 1))
        members = np.diff(cuts)
        group = np.repeat(np.arange(len(members)), members)
        easy = (members <= SMALL_GROUP) & (np.bincount(group[doc], weight != 1, len(members)) == 0)
        use = easy[group[doc]]
        pairs = similar_in_small_groups(group, doc[use], feature[use], len(ids), threshold)
        out = [(int(ids[i]), int(ids[j])) for i, j in forest(pairs, len(ids))]
        at = np.searchsorted(doc, cuts)
        for g in np.flatnonzero(~easy):
            s, e, x, y = cuts[g], cuts[g + 1], at[g], at[g + 1]
            pairs = similar(doc[x:y] - s, feature[x:y], weight[x:y], e - s, threshold, far)
            out += [(int(ids[s + i]), int(ids[s + j])) for i, j in forest(pairs, e - s)]
        return pa.table([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.groupBy("g", "i", "j").applyInArrow(compare, "a long, b long")
