import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lotline.llm import pivot_clusters as C


def lloyd(rows, k, rounds, dims):
    """Plain rounds over Python integers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(256 * x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = {n: sum(d for _, d, m in found if m == n) for n in range(k)}
    long = lambda n: n if n <= C.LONG else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    sums = {n: None if any(d > C.LONG for _, d, m in found if m == n) else long(t) for n, t in total.items()}
    whole = None if any(d > C.LONG for _, d, _ in found) else long(sum(total.values()))
    return sorted(((i, n, long(d), sums[n], whole, digest[n]) for i, d, n in found), key=repr)


points = st.lists(st.integers(-1000, 1000), min_size=3, max_size=3)


@settings(max_examples=150, deadline=None)
@given(st.lists(points, min_size=1, max_size=12), st.lists(points, min_size=1, max_size=40))
def test_bounds_stay_below_and_nothing_nearer_is_skipped(centres, rows):
    pivots = C.Pivots.among(centres)
    to = C.Assigner(centres, pivots)
    x = np.array(rows, np.int64)
    reach = pivots.distances(x)
    exact = np.array([[C.squared(r, c) for c in centres] for r in rows])
    assert (pivots.bounds(reach, to.reach) ** 2 <= exact).all()
    which, far, measured = to.nearest(x, reach)
    assert far.tolist() == exact.min(axis=1).tolist() and which.tolist() == exact.argmin(axis=1).tolist()
    assert len(rows) <= measured <= exact.size


def test_far_centroids_are_skipped():
    rng = np.random.default_rng(1)
    homes = rng.integers(-20_000, 20_000, (20, 64))
    x = homes[rng.integers(0, 20, 2000)] + rng.integers(-50, 50, (2000, 64))
    pivots = C.Pivots.among(homes.tolist())
    _, _, measured = C.Assigner(homes.tolist(), pivots).nearest(x, pivots.distances(x))
    assert measured < 2 * len(x)


@pytest.mark.parametrize("scale", [1.0, 1e-3, 3e5, 1e20])
def test_like_plain_rounds(spark, scale):
    rng = np.random.default_rng(7)
    base = [(rng.normal(size=4) * scale).tolist() for _ in range(120)]
    rows = [(i, v) for i, v in enumerate(base)] + [(i, base[0]) for i in range(200, 240)] + [(3, base[3]), (3, base[5]), (None, base[6]), (None, base[7])]
    rows += [(300, None), (301, []), (302, [1.0] * 3), (303, [1.0] * 5), (304, [1.0, None, 1.0, 1.0]), (305, [float("nan")] * 4), (306, [1.0, float("inf"), 0.0, 0.0]), (307, [1e308] * 4)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, cluster string").repartition(5)
    got = C.clusters(table, k=9, rounds=3, dims=4)
    assert sorted(map(tuple, got.collect()), key=repr) == lloyd(rows, 9, 3, 4)


def test_few_and_no_rows(spark):
    rows = [(1, [0.5, -0.5]), (2, [0.25, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, C.clusters(table, k=5, rounds=2, dims=2).collect()), key=repr) == lloyd(rows, 5, 2, 2)
    assert C.clusters(table.limit(0), k=5, rounds=2, dims=2).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "vec_id long, embedding array<float>")
    got = C.clusters(same, k=5, rounds=2, dims=2).collect()
    assert len(got) == 30 and {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}
