"""Tail probabilities against closed forms, k-th distances and trees against plain search."""

import math
import random

from pyspark.sql import functions as F

from lotline.functions.special import chi_square_tail, f_tail
from lotline.operators import clustering as C
from lotline.operators import spatial as S
from lotline.operators import statistics as H


def chi_exact(x, k):
    """Closed forms: a Poisson sum for an even number of degrees of freedom, erfc and a finite sum for an odd one."""
    y = x / 2
    if k % 2 == 0:
        return math.fsum(math.exp(i * math.log(y) - y - math.lgamma(i + 1)) for i in range(k // 2)) if y else 1.0
    more = math.fsum(math.exp((i + 0.5) * math.log(y) - y - math.lgamma(i + 1.5)) for i in range(k // 2)) if y else 0.0
    return math.erfc(math.sqrt(y)) + more


def test_chi_square_tail(spark):
    cases = [(x, k) for k in (1, 2, 3, 4, 7, 10, 25, 100, 999, 5000) for x in (0.0, 1e-6, 0.1, 1.0, 3.841458820694124, k * 0.5, float(k), k * 1.3, k + 200.0)]
    df = spark.createDataFrame(cases, "x double, k int")
    for r in df.withColumn("p", chi_square_tail(F.col("x"), F.col("k"))).collect():
        assert abs(r.p - chi_exact(r.x, r.k)) < 1e-9, r
    odd = spark.createDataFrame([(None, 3), (1.0, 0), (1e6, 2)], "x double, k int")
    assert [r[0] for r in odd.select(chi_square_tail(F.col("x"), F.col("k"))).collect()] == [None, None, 0.0]


def test_f_tail(spark):
    # exact where the first number is 2, and where the second is 2
    cases = [(f, 2, d) for d in (1, 2, 5, 40, 3000) for f in (0.0, 0.01, 1.0, 4.2, 90.0)] + [(f, d, 2) for d in (1, 3, 8, 50) for f in (0.01, 1.0, 4.2, 90.0)]
    df = spark.createDataFrame(cases, "f double, a int, b int")
    for r in df.withColumn("p", f_tail(F.col("f"), F.col("a"), F.col("b"))).collect():
        want = (1 + 2 * r.f / r.b) ** (-r.b / 2) if r.a == 2 else 1 - (r.a * r.f / (r.a * r.f + 2)) ** (r.a / 2)
        assert abs(r.p - want) < 1e-9, r
    # tables: t with 10 degrees of freedom at 2.228138852 has two-sided 5 %, F(5, 20) at 2.71088984 has 5 %
    tab = spark.createDataFrame([(2.2281388519649385**2, 1, 10), (2.7108898372096917, 5, 20)], "f double, a int, b int")
    assert all(abs(r[0] - 0.05) < 1e-9 for r in tab.select(f_tail(F.col("f"), F.col("a"), F.col("b"))).collect())


def test_tests_of_all_features_at_once(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.randrange(5), rng.random(), 1.0, None if rng.random() < 0.1 else float(rng.randrange(4))) for _ in range(200)]
    df = spark.createDataFrame(rows, "g int, a int, b double, flat double, gaps double")
    got = {(r.feature, r.g): r for r in C.cluster_profile(df, "g", ["a", "b", "flat", "gaps"]).collect()}
    for c in ("a", "b", "gaps"):
        one = H.kruskal(df, "g", c).first()
        assert all(abs(got[c, g].h - one["h"]) < 1e-9 and abs(got[c, g].p_value - chi_exact(one["h"], 2)) < 1e-9 for g in range(3))
    assert got["flat", 0].h is None and got["flat", 0].p_value is None


def test_kth_distance_and_eps(spark):
    rng = random.Random(6)
    spots = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(300)] + [(1.0, 1.0)] * 40 + [(1e6 + rng.random(), 0.0) for _ in range(60)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)] + [(-1, None, 0.0)], "id int, x double, y double")
    for k in (1, 5, 45):
        got = {r.id: r.distance for r in S.kth_distance(df, "x", "y", k).collect()}
        assert got.pop(-1) is None
        for i, p in enumerate(spots):
            assert abs(got[i] - sorted(math.dist(p, q) for q in spots)[k - 1]) < 1e-9
    far = sorted(sorted(math.dist(p, q) for q in spots)[4] for p in spots)
    place = 0.9 * (len(far) - 1)
    want = far[int(place)] + (far[int(place) + 1] - far[int(place)]) * (place - int(place))
    assert abs(C.density_eps(df, "x", "y", 5, [0.9])[0] - want) < 1e-9
    assert all(r.distance is None for r in S.kth_distance(df.limit(3), "x", "y", 5).collect())
