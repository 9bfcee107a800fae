import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lotline.operators import episodes as E
from lotline.operators.slots import assign_slots


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def check_merges(before, after, bad, grid):
    """``after`` is what merging may and must make of ``before``: lists of (tenant, start, end) of one place."""
    wholly_bad = lambda a, b: all(p in bad for p in grid if a <= p <= b)
    at = 0
    for tenant, start, end in after:
        run = [e for e in before if start <= e[1] and e[2] <= end]
        assert run == before[at:at + len(run)] and run  # spans take consecutive episodes, all of them, in order
        assert (run[0][0], run[0][1]) == (tenant, start) and (run[-1][0], run[-1][2]) == (tenant, end)
        others = [e for e in run if e[0] != tenant]
        assert all(wholly_bad(e[1], e[2]) for e in others)  # what is swallowed lies in bad periods
        assert len(run) == 1 or len(run) % 2 == 1
        at += len(run)
    assert at == len(before)
    for left, middle, right in zip(after, after[1:], after[2:]):
        assert not (left[0] == right[0] and wholly_bad(middle[1], middle[2]))  # nothing is left to merge


def random_panel(seed, places=40, periods=14, tenants="AB", holes=0.25):
    rng = random.Random(seed)
    return [
        (f"L{i}", p, rng.choice(tenants))
        for i in range(places) for p in range(1, periods + 1) if rng.random() > holes
    ]


def test_detect_and_metrics(spark):
    panel = frame(spark, [("x", 1, "A"), ("x", 2, "A"), ("x", 3, "B"), ("x", 5, "A"), ("y", 2, "C")],
                  "loc string, period int, shop string")
    eps = E.detect_episodes(panel, key=["loc"], period="period", value="shop")
    got = {(r["loc"], r["shop"], r["start"], r["end"], r["surv_q"], r["state"]) for r in eps.collect()}
    assert got == {("x", "A", 1, 2, 2, "closed"), ("x", "B", 3, 3, 1, "closed"), ("x", "A", 5, 5, 1, "open"),
                   ("y", "C", 2, 2, 1, "closed")}
    metrics = {r["loc"]: r for r in E.location_metrics(eps, key=["loc"]).collect()}
    assert metrics["x"]["turnover_cnt"] == 2 and abs(metrics["x"]["turnover_rate"] - 2 / 3) < 1e-12
    assert metrics["y"]["turnover_rate"] is None


def test_good_period_in_a_vacancy_stops_a_merge(spark):
    rows = [("x", p, t) for p, t in ((0, "C"), (1, "A"), (3, "B"), (4, "A"), (5, "C"))] + [("y", p, "D") for p in range(6)]
    panel = frame(spark, rows, "loc string, period int, shop string")
    cal = E.calendar(E.period_grid(panel, "period"), frame(spark, [(1,), (3,), (4,)], "period int"))
    eps = E.detect_episodes(panel, key=["loc"], period="period", value="shop")
    merged = E.merge_gap_episodes(eps, cal, key=["loc"], value="shop").where("loc = 'x'").orderBy("start").collect()
    # A[1,1] B[3,3] A[4,4] become one span, which holds the good period 2 that nobody was seen in: C stays in two parts
    assert [(r["shop"], r["start"], r["end"]) for r in merged] == [("C", 0, 0), ("A", 1, 4), ("C", 5, 5)]


def test_merges_and_what_follows(spark):
    rows = random_panel(7, tenants="AABC")
    panel = frame(spark, rows, "loc string, period int, shop string")
    grid = E.period_grid(panel, "period")
    bad = frame(spark, [(4,), (5,), (6,), (9,)], "period int")
    cal = E.calendar(grid, bad)
    eps = E.detect_episodes(panel, key=["loc"], period="period", value="shop")
    merged = E.merge_gap_episodes(eps, cal, key=["loc"], value="shop")
    got = {}
    for r in merged.orderBy("loc", "episode_id").collect():
        got.setdefault(r["loc"], []).append((r["shop"], r["start"], r["end"]))
    before = {}
    for r in eps.orderBy("loc", "episode_id").collect():
        before.setdefault(r["loc"], []).append((r["shop"], r["start"], r["end"]))
    every = sorted({p for _, p, _ in rows})
    assert got.keys() == before.keys()
    for loc in got:
        check_merges(before[loc], got[loc], {4, 5, 6, 9}, every)
    assert sum(map(len, got.values())) < sum(map(len, before.values()))  # the fixture does merge something

    fixed = E.recount_survival(merged, panel, cal, key=["loc"], value="shop")
    seen = {}
    for loc, p, shop in rows:
        seen.setdefault((loc, shop), set()).add(p)
    for r in fixed.collect():
        span = [p for p in every if r["start"] <= p <= r["end"]]
        assert r["surv_q_fixed"] == sum(p in seen[(r["loc"], r["shop"])] or p in {4, 5, 6, 9} for p in span)

    vac = {r["loc"]: r for r in E.vacancy(merged, cal, key=["loc"]).collect()}
    for loc, eps_of in got.items():
        occupied = {p for p in every for _, s, e in eps_of if s <= p <= e}
        span = [p for p in every if eps_of[0][1] <= p <= eps_of[-1][2] and not (p in {4, 5, 6, 9} and p not in occupied)]
        assert vac[loc]["span_q"] == len(span)
        assert vac[loc]["vacant_q"] == len([p for p in span if p not in occupied])


def test_vacancy_trap(spark):
    eps = frame(spark, [("a", 1, 2), ("a", 5, 6)], "loc string, start int, end int")
    cal = E.calendar(E.period_grid(spark.range(1, 7).select(F.col("id").cast("int").alias("period")), "period"),
                     frame(spark, [(3,)], "period int"))
    row = E.vacancy(eps, cal, key=["loc"]).first()
    assert (row["span_q"], row["vacant_q"]) == (5, 1)


def test_missing_periods_and_bad(spark):
    rows = [("a", 201603, "x"), ("a", 201609, "x"), ("b", 201606, "y"), ("b", 201609, "y")]
    panel = frame(spark, rows, "loc string, period int, shop string")
    grid = E.period_grid(panel, "period")
    eps = E.detect_episodes(panel, key=["loc"], period="period", value="shop")
    gaps = {r["loc"]: (r["expected_q"], r["surv_q"]) for r in E.gap_check(eps, grid).collect()}
    assert gaps["a"] == (3, 2)
    counts = E.missing_period_counts(eps, panel, grid, key=["loc"], value="shop")
    assert [tuple(r) for r in counts.collect()] == [(201606, 1)]
    assert [r[0] for r in E.structural_bad_periods(counts).collect()] == [201606]
    none = E.missing_period_counts(eps.where("loc = 'b'"), panel, grid, key=["loc"], value="shop")
    assert E.structural_bad_periods(none).isEmpty()


def check_slots(rows, got):
    """Properties that fix the assignment: stayers keep their slot, arrivals in order hold the smallest numbers left."""
    present = {}
    for group, period, member in rows:
        if member is not None:
            present.setdefault((group, period), set()).add(member)
    assert {k: set(v) for k, v in got.items()} == present
    for group in {g for g, _ in present}:
        earlier = {}
        for period in sorted(p for g, p in present if g == group):
            slots = got[group, period]
            assert len(set(slots.values())) == len(slots)
            stayers = slots.keys() & earlier.keys()
            assert all(slots[m] == earlier[m] for m in stayers)
            held = {slots[m] for m in stayers}
            open_numbers = [n for n in range(1, len(slots) + 1) if n not in held]
            arrivals = sorted(slots.keys() - stayers)
            assert [slots[m] for m in arrivals] == open_numbers[:len(arrivals)]
            earlier = slots


@pytest.mark.parametrize("kind", ["string", "int", "date", "decimal(9,2)"])
def test_slots_are_the_same_at_every_group_size(spark, kind):
    rng = random.Random(3)
    name = {
        "string": lambda m: f"s{m}", "int": lambda m: m * 7 - 20, "decimal(9,2)": lambda m: Decimal(m * 3 - 11) / 4,
        "date": lambda m: datetime.date(1969, 12, 1) + datetime.timedelta(days=9 * m),
    }[kind]
    rows = [(f"g{g}", p, name(m)) for g in range(3) for p in range(1, 4) for m in range(11) if rng.random() < 0.4]
    rows += [("g0", 3, None), ("g0", 9, None), ("g0", 10, name(0)), ("g9", 1, None)]
    panel = frame(spark, rows, f"g string, period int, shop {kind}")
    # all groups folded, some, all scanned, some dealt into blocks of slots, all of them
    ways = [(20_000, 10**6, 4096), (12, 10**6, 4096), (0, 10**6, 4096), (0, 12, 2), (0, 0, 3)]
    for hot_rows, scan_rows, block in ways if kind == "string" else [ways[0], ways[2], ways[4]]:
        slotted = assign_slots(panel, group=["g"], period="period", member="shop", hot_rows=hot_rows, scan_rows=scan_rows, block=block)
        assert slotted.schema["shop"].dataType == panel.schema["shop"].dataType
        got = {}
        for r in slotted.collect():
            got.setdefault((r["g"], r["period"]), {})[r["shop"]] = r["slot"]
        check_slots(rows, got)


def test_scan_over_many_batches(spark):
    """A group of many Arrow batches, null group keys, repeated rows."""
    rng = random.Random(5)
    rows = [(None if g else "a", g, p, f"m{m:05d}") for g in range(2) for p in range(6) for m in range(6000) if rng.random() < 0.5]
    panel = frame(spark, rows + rows[:1000], "g string, h int, period int, shop string")
    got = {}
    for r in assign_slots(panel, group=["g", "h"], period="period", member="shop", hot_rows=0).collect():
        got.setdefault(((r["g"], r["h"]), r["period"]), {})[r["shop"]] = r["slot"]
    check_slots([((g, h), p, m) for g, h, p, m in rows], got)
    again = {}
    for r in assign_slots(panel, group=["g", "h"], period="period", member="shop", hot_rows=0, scan_rows=0, block=1000).collect():
        again.setdefault(((r["g"], r["h"]), r["period"]), {})[r["shop"]] = r["slot"]
    assert again == got


def test_slots_trap(spark):
    rows = [("L", 1, "a"), ("L", 1, "b"), ("L", 2, "b"), ("L", 2, "c"), ("L", 4, "c"), ("L", 4, "a"), ("L", 4, "d")]
    panel = frame(spark, rows, "g string, period int, shop string")
    got = assign_slots(panel, group=["g"], period="period", member="shop")
    assert {(r["period"], r["shop"]): r["slot"] for r in got.collect()} == {
        (1, "a"): 1, (1, "b"): 2, (2, "b"): 2, (2, "c"): 1, (4, "c"): 1, (4, "a"): 2, (4, "d"): 3}
