import math
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from lotline.operators import aggregates as A
from lotline.operators import category as G
from lotline.operators import joins as J
from lotline.operators import ordinals as O
from lotline.operators import ranked as R
from lotline.operators import spatial as S
from lotline.operators import statistics as H


def quantile(values, q):
    values = sorted(values)
    place = (len(values) - 1) * q
    low = math.floor(place)
    high = math.ceil(place)
    return values[low] + (values[high] - values[low]) * (place - low)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-5, 5), st.just(3))), min_size=1, max_size=60))
def test_exact_quantiles_match_sorting(spark, rows):
    df = spark.createDataFrame(rows, "g string, v int")
    got = {r["g"]: (r["lo"], r["mid"]) for r in O.exact_quantiles(df, "v", {"lo": 0.1, "mid": 0.5}, by=["g"], buckets=4).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        assert math.isclose(got[g][0], quantile(values, 0.1), abs_tol=1e-9)
        assert math.isclose(got[g][1], quantile(values, 0.5), abs_tol=1e-9)


def test_ranks_with_one_hot_value(spark):
    rng = random.Random(1)
    rows = [(i, 7 if i % 3 else rng.randint(0, 20)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v int")
    got = {r["id"]: r["rank"] for r in O.ordinal_rank(df, "v", "id").collect()}
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), start=1)}
    assert got == want
    names = spark.createDataFrame([("g", f"s{rng.random():.12f}") for _ in range(500)], "g string, m string")
    placed = {r["m"]: r["p"] for r in O.text_rank(names, ["g"], "m", "p", sample=7).collect()}
    assert [m for m, _ in sorted(placed.items(), key=lambda x: x[1])] == sorted(placed)


def test_period_grid_beyond_the_bound(spark):
    df = spark.createDataFrame([(p,) for p in (5, 9, 9, 2, 40)], "p int")
    for bound in (10, 2):  # the second is numbered across tasks
        assert {r["p"]: r["idx"] for r in O.dense_index(df, "p", bound=bound).collect()} == {2: 0, 5: 1, 9: 2, 40: 3}


def test_weighted_traps(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 0.25), (3.0, 0.25)], "v double, w double")
    assert A.weighted_median(df, [], "v", "w").first()[0] == 1.0
    nulls = spark.createDataFrame([(None, 1.0), (2.0, 1.0)], "v double, w double")
    assert nulls.agg(A.weighted_mean_expr("v", "w")).first()[0] == 1.0
    assert nulls.agg(A.weighted_mean_expr("v", "w", skip_null_weight=True)).first()[0] == 2.0


def test_share_and_composition_traps(spark):
    df = spark.createDataFrame([("k", None), ("k", 0.0), ("k", 0.2)], "k string, v double")
    row = A.conditional_share(df, ["k"], "v", F.col("v") > 0, "pos").first()
    assert (row["n_known"], row["n_pos"], row["share_pos"]) == (2, 1, 0.5)
    shares = spark.createDataFrame([("d", "a", 1.0), ("d", "b", 0.0), ("d", "c", 0.0)], "d string, c string, share double")
    row = A.composition_indices(shares, ["d"], "share").first()
    assert (row["entropy"], row["hhi"], row["top3_share"]) == (0.0, 1.0, 1.0)


def test_fallback_levels(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "id int, t string, c string")
    cell = spark.createDataFrame([("a", "x", 0.1)], "t string, c string, v double")
    kind = spark.createDataFrame([("a", 0.5)], "t string, v double")
    out = J.join_with_fallback(rows, [(cell, ["t", "c"], "cell"), (kind, ["t"], "type")], ["v"])
    assert {r["id"]: (r["v"], r["basis"]) for r in out.collect()} == {1: (0.1, "cell"), 2: (0.5, "type"), 3: (None, "none")}


def test_lookup_refuses_repeated_keys(spark):
    import pytest

    dim = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="lookup key repeats"):
        J.lookup(spark.createDataFrame([(1,)], "k int"), dim, "k", ["v"]).collect()


def test_overlapping_polygons_and_nearest(spark):
    def square(x, y, s):
        return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]

    polys = spark.createDataFrame([(2, square(0.0, 0.0, 10.0)), (1, square(5.0, 5.0, 10.0))], "pid int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 7.0, 7.0), (2, 1.0, 1.0), (3, 100.0, 5.5), (4, 2.0, 12.0)], "id int, x double, y double")
    inside = {r["id"]: r["pid"] for r in S.points_in_polygons(points, polys, point_id="id", polygon_id="pid", cell_m=3.0).collect()}
    assert inside == {1: 1, 2: 2, 3: None, 4: None}
    near = {r["id"]: (r["pid"], round(r["distance_m"], 6)) for r in
            S.nearest_polygon(points, polys, point_id="id", polygon_id="pid", cell_m=3.0).collect()}
    assert near == {1: (1, 0.0), 2: (2, 0.0), 3: (1, 85.0), 4: (2, 2.0)}


def haversine(a, b):
    lon1, lat1, lon2, lat2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(h))


def test_radius_and_nearest_with_a_hot_coordinate(spark):
    rng = random.Random(5)
    spots = [(126.9 + rng.random() / 50, 37.5 + rng.random() / 50) for _ in range(150)] + [(126.91, 37.51)] * 80
    rows = [(i, *p) for i, p in enumerate(spots)]
    points = spark.createDataFrame(rows, "id int, lon double, lat double")
    goals = [(f"t{i:02d}", 126.88 + rng.random() / 10, 37.48 + rng.random() / 10) for i in range(12)]
    targets = spark.createDataFrame(goals, "name string, lon double, lat double")
    got = {r["id"]: r["n"] for r in S.count_within(points, points, radius_m=400.0, name="n", exclude_self=True).collect()}
    assert got == {i: sum(haversine(p, q) <= 400.0 for q in spots) - 1 for i, p in enumerate(spots)}
    near = {r["id"]: (r["name"], r["distance_m"]) for r in S.nearest_point(points, targets, point_id="id", target="name").collect()}
    for i, p in enumerate(spots):
        best = min((haversine(p, g[1:]), g[0]) for g in goals)
        assert near[i][0] == best[1] and abs(near[i][1] - best[0]) < 1e-6


def test_far_clusters_meet_by_their_boxes(spark):
    """Thousands of points whose nearest targets all lie in one far crowd, at any latitude and across the date line."""
    import time

    rng = random.Random(8)
    spots = [(179.99 + rng.random() / 100, -60 + rng.random() / 100) for _ in range(4000)]
    goals = [(f"t{i:04d}", -150 + rng.random() / 100, 75 + rng.random() / 100) for i in range(4000)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "id int, lon double, lat double")
    targets = spark.createDataFrame([*goals, ("none", None, 1.0), ("nan", float("nan"), 1.0)], "name string, lon double, lat double")
    began = time.time()
    near = {r["id"]: (r["name"], r["distance_m"]) for r in S.nearest_point(points, targets, point_id="id", target="name").collect()}
    assert time.time() - began < 60
    for i in range(0, 4000, 400):
        best = min((haversine(spots[i], g[1:]), g[0]) for g in goals)
        assert near[i][0] == best[1] and abs(near[i][1] - best[0]) < 1e-3
    wide = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(300)] + [(180.0, 10.0), (-180.0, 10.0), (0.0, 90.0), (90.0, 90.0)]
    all_of = spark.createDataFrame([(i, *p) for i, p in enumerate(wide)], "id int, lon double, lat double")
    got = {r["id"]: r["n"] for r in S.count_within(all_of, all_of, radius_m=3e6, name="n").collect()}
    assert got == {i: sum(haversine(p, q) <= 3e6 for q in wide) for i, p in enumerate(wide)}


def test_nearest_polygons_of_many(spark):
    rng = random.Random(11)
    spots = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(200)] + [(1e5 + rng.random(), 5.0) for _ in range(200)]
    rings = []
    for k in range(120):
        x, y, w, h = rng.uniform(0, 100), rng.uniform(0, 100), rng.uniform(0.1, 30), rng.uniform(0.1, 3)
        rings.append((k, [(x, y), (x + w, y), (x + w / 2, y + h)]))
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)] + [(-1, None, 1.0)], "id int, x double, y double")
    polys = spark.createDataFrame(rings, "pid int, ring array<struct<x:double,y:double>>")

    def edge(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    def away(p, ring):
        sides = list(zip(ring, ring[1:] + ring[:1]))
        odd = sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in sides)
        return 0.0 if odd % 2 else min(edge(p, a, b) for a, b in sides)

    got = {r["id"]: (r["pid"], r["distance_m"]) for r in S.nearest_polygon(points, polys, point_id="id", polygon_id="pid", cell_m=5.0).collect()}
    assert got.pop(-1) == (None, None)
    for i, p in enumerate(spots):
        best = min((away(p, ring), k) for k, ring in rings)
        assert abs(got[i][1] - best[0]) < 1e-9 * max(1, best[0]) and abs(away(p, rings[got[i][0]][1]) - best[0]) < 1e-9 * max(1, best[0])


def test_statistics_against_known_values(spark):
    two = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5
    row = H.chi_square_v(spark.createDataFrame(two, "a string, b string"), "a", "b").first()
    e = [30 * 40 / 65, 30 * 25 / 65, 35 * 40 / 65, 35 * 25 / 65]
    want = sum((abs(o - x) - 0.5) ** 2 / x for o, x in zip([10, 20, 30, 5], e))
    assert math.isclose(row["chi2"], want, rel_tol=1e-9) and row["dof"] == 1
    km = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 0)], "t int, e int")
    assert {r["at"]: round(r["survival"], 9) for r in H.kaplan_meier(km, "t", "e", [0, 1, 2, 9]).collect()} == {0: 1.0, 1: 0.75, 2: 0.5, 9: 0.5}
    all_gone = spark.createDataFrame([(1, 1), (1, 1)], "t int, e int")
    assert H.survival_table(all_gone, "t", "e").first()["survival"] == 0.0


def test_category_revision_and_crosswalk(spark):
    base = [("s1", 1, "a"), ("s2", 1, "b"), ("s1", 2, "a"), ("s2", 2, "c"), ("s1", 3, "x"), ("s2", 3, "y"), ("s3", 2, "a"), ("s3", 1, "a")]
    df = spark.createDataFrame([(s, p, c, "big" if p == 3 else "old") for s, p, c in base], "shop string, period int, mid string, major string")
    assert G.detect_category_revision(df, "period", "mid").first()[0] == 3  # period 2 changes two names only
    comp = G.compress(df, "shop", "period", ["major", "mid"])
    walk = G.category_crosswalk(comp, "shop", "mid", [], 3)
    assert {(r["old_category"], r["new_category"], r["share"]) for r in walk.collect()} == {("a", "x", 1.0), ("c", "y", 1.0)}
    final = {r["shop"]: (r["mid"], r["major"]) for r in G.apply_crosswalk(comp, walk, "shop", "mid", "major", 3).collect()}
    assert final == {"s1": ("x", "big"), "s2": ("y", "big"), "s3": ("x", "big")}


def test_alternatives_exclude_self_and_history_is_ordered(spark):
    df = spark.createDataFrame([("g", i, float(i)) for i in range(5)], "g string, id int, score double")
    got = {r["id"]: [a["id"] for a in r["alternatives"]] for r in R.alternatives(df, ["g"], "id", "score", 2).collect()}
    assert got == {0: [1, 2], 1: [0, 2], 2: [0, 1], 3: [0, 1], 4: [0, 1]}


def test_value_history_runs(spark):
    df = spark.createDataFrame([("s", 1, "A"), ("s", 2, "B"), ("s", 3, "A")], "shop string, period int, name string")
    assert R.value_history(df, ["shop"], ["name"], "period").count() == 2
    runs = {(r["name"], r["first_q"], r["last_q"], r["changed"]) for r in R.value_history(df, ["shop"], ["name"], "period", runs=True).collect()}
    assert runs == {("A", 1, 1, True), ("B", 2, 2, True), ("A", 3, 3, True)}


def test_no_silent_local_folder():
    """Off a local master an unset shared folder is an error, never a folder on the driver's own disk."""
    from types import SimpleNamespace as N

    from lotline import runtime

    conf, unset = N(get=lambda key, default=None: default), N(getCheckpointDir=lambda: N(isDefined=lambda: False))
    context = N(getConf=lambda: conf, _jsc=N(sc=lambda: unset), master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_root(N(sparkContext=context))


def test_nan_zero_totals_and_one_value(spark):
    from lotline.operators import statistics as S

    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", 3.0), ("b", None)], "g string, v double")
    assert [r["m"] for r in O.exact_quantiles(df, "v", {"m": 0.5}).collect()] == [2.0]
    same = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, v double")
    assert S.kruskal(same, "g", "v").first()["h"] is None
    assert S.anova_eta(same, "g", "v").first()["f"] is None
    nothing = spark.createDataFrame([("a", "x", 0.0), ("a", "y", 0.0)], "g string, c string, m double")
    assert {r["share"] for r in A.share_and_dominant(nothing, key=["g"], category="c", measure="m").collect()} == {None}


def test_points_with_equal_ids_coordinates_or_none(spark):
    from lotline.operators.spatial import points_in_polygons

    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    rings = spark.createDataFrame([(7, [{"x": x, "y": y} for x, y in square], "n")], "pid int, ring array<struct<x:double,y:double>>, name string")
    points = spark.createDataFrame([(1, 5.0, 5.0), (1, 50.0, 5.0), (2, 5.0, 5.0), (3, None, 5.0)], "id int, x double, y double")
    got = points_in_polygons(points, rings, point_id="id", polygon_id="pid", keep=["name"], cell_m=4.0)
    assert sorted((r["id"], r["pid"], r["name"]) for r in got.where("x = 5").collect()) == [(1, 7, "n"), (2, 7, "n")]
    assert sorted((r["id"], r["pid"]) for r in got.where("x = 50 or x is null").collect()) == [(1, None), (3, None)]


def test_rows_for_a_partitioned_write_are_dealt_by_their_number(spark):
    from lotline.sources.sinks import dealt_by

    rows = spark.range(6000).select((F.col("id") % 10 >= 9).cast("int").alias("period"), "id")
    dealt = dealt_by(rows, "period", rows=500, least=2)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1000
