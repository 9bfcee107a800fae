"""Episodes, gaps, repair, vacancy, slots (E1-E11, E18, D17) and the products built straight on them."""

from pyspark.sql import functions as F

from lotline.catalog import views as V
from lotline.catalog.registry import query
from lotline.operators import episodes as E
from lotline.operators import ranked as R
from lotline.operators.slots import assign_slots, max_concurrency
from lotline.plans import products as P
from lotline.runtime import stored, table

KEY = ["location_id"]


@query("e1_detect_episodes", "SELECT * FROM episodes", ("episodes",))
def _(spark, root):
    return V.episodes(spark, root)


@query("e1_event_runs", """
SELECT user_id, CAST(ep AS BIGINT) AS episode_id, min(kind) AS event_type, min(d) AS "start", max(d) AS "end",
  count(*) AS surv_q, CASE WHEN max(d) = (SELECT CAST(max(strftime(ts, '%Y%m%d')) AS BIGINT) FROM events) THEN 'open' ELSE 'closed' END AS state
FROM (SELECT *, sum(CASE WHEN prev = kind THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS ep
  FROM (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY d) AS prev
    FROM (SELECT user_id, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS d, min(event_type) AS kind FROM events GROUP BY ALL) a) b) c
GROUP BY user_id, ep
""")
def _(spark, root):
    days = table(spark, root, "events").withColumn("day", F.date_format("ts", "yyyyMMdd").cast("int"))
    return E.detect_episodes(days, key=["user_id"], period="day", value="event_type")


@query("e2_location_metrics", "SELECT location_id, obs_quarters, turnover_cnt, round(mean_surv, 6) AS mean_surv, max_surv, "
       "round(turnover_rate, 6) AS turnover_rate FROM metrics", ("metrics",))
def _(spark, root):
    return V.metrics(spark, root)


@query("e3_period_grid", "SELECT CAST(period AS BIGINT) AS period, CAST(idx AS BIGINT) AS idx FROM grid", ("grid",))
def _(spark, root):
    return V.grid(spark, root)


@query("e4_gap_check", 'SELECT * FROM gaps', ("gaps",))
def _(spark, root):
    return E.gap_check(V.episodes(spark, root), V.grid(spark, root))


@query("e5_missing_period_counts", "SELECT period, n_missing FROM missing_counts", ("missing_counts",))
def _(spark, root):
    cells = stored(V.panel(spark, root))
    grid = E.period_grid(cells, "period")
    return E.missing_period_counts(V.episodes(spark, root, cells), cells, grid, key=KEY, value="shop_id")


@query("e6_structural_bad_periods", "SELECT period FROM bad", ("bad",))
def _(spark, root):
    cells = stored(V.panel(spark, root))
    return V.bad_periods(spark, root, V.episodes(spark, root, cells), cells, E.period_grid(cells, "period"))


def repaired(spark, root):
    """Panel, calendar, episodes and merged episodes."""
    cells = stored(V.panel(spark, root))  # read by five steps below, far smaller than its source
    grid = E.period_grid(cells, "period")
    eps = stored(V.episodes(spark, root, cells))
    cal = E.calendar(grid, V.bad_periods(spark, root, eps, cells, grid))
    return cells, cal, eps, E.merge_gap_episodes(eps, cal, key=KEY, value="shop_id")


# One step per episode of a place; the good periods of a merged span are counted on the calendar, between its ends.
V._sql("cal", ("grid", "bad"), """
SELECT g.period, g.idx, b.period IS NOT NULL AS bad,
  CAST(sum(CASE WHEN b.period IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY g.idx) AS BIGINT) AS good_upto
FROM grid g LEFT JOIN bad b ON g.period = b.period
""")
V._sql("lists", ("episodes", "cal"), """
SELECT location_id, list({'s': "start", 'e': "end", 'v': shop_id, 'g0': before, 'g1': upto} ORDER BY "start") AS xs
FROM (SELECT e.*, a.good_upto - CASE WHEN a.bad THEN 0 ELSE 1 END AS before, z.good_upto AS upto
      FROM episodes e JOIN cal a ON e."start" = a.period JOIN cal z ON e."end" = z.period) t GROUP BY location_id
""")
FOLD = """
WITH RECURSIVE fold AS (
  SELECT location_id, xs, 1 AS i, xs[1:1] AS stack, 0 AS merges FROM lists
  UNION ALL
  SELECT location_id, xs, i + 1,
    CASE WHEN len(stack) >= 2 AND stack[len(stack) - 1].v = xs[i + 1].v AND stack[len(stack)].g0 = stack[len(stack)].g1
      THEN list_append(stack[1:len(stack) - 2], {'s': stack[len(stack) - 1].s, 'e': xs[i + 1].e, 'v': xs[i + 1].v,
        'g0': stack[len(stack) - 1].g0, 'g1': xs[i + 1].g1})
      ELSE list_append(stack, xs[i + 1]) END,
    merges + CASE WHEN len(stack) >= 2 AND stack[len(stack) - 1].v = xs[i + 1].v AND stack[len(stack)].g0 = stack[len(stack)].g1 THEN 1 ELSE 0 END
  FROM fold WHERE i < len(xs)),
merged AS (
  SELECT location_id, unnest(stack) AS x, generate_subscripts(stack, 1) AS episode_id, merges FROM fold WHERE i = len(xs)),
corrected AS (
  SELECT m.location_id, m.episode_id, m.x.v AS shop_id, m.x.s AS "start", m.x.e AS "end",
    (SELECT count(*) FROM cal c WHERE c.period BETWEEN m.x.s AND m.x.e AND (c.bad OR EXISTS (
      SELECT 1 FROM panel p WHERE p.location_id = m.location_id AND p.shop_id = m.x.v AND p.period = c.period))) AS surv_q_fixed,
    CASE WHEN m.x.e = (SELECT max(period) FROM cal) THEN 'open' ELSE 'closed' END AS state
  FROM merged m)
"""
FOLD_VIEWS = ("panel", "episodes", "cal", "lists")


@query("e7_merge_gap_episodes", FOLD + """
SELECT location_id, episode_id, x.v AS shop_id, x.s AS "start", x.e AS "end" FROM merged""", FOLD_VIEWS)
def _(spark, root):
    return repaired(spark, root)[3]


@query("e7_merge_summary", FOLD + """
SELECT CAST(merges AS BIGINT) AS merges, count(*) AS n_locations FROM fold WHERE i = len(xs) GROUP BY merges""", FOLD_VIEWS)
def _(spark, root):
    _, cal, eps, _ = repaired(spark, root)
    return E.merge_summary(E.merge_gap_episodes(eps, cal, key=KEY, value="shop_id", detail=True))


@query("e8_recount_survival", FOLD + "SELECT * FROM corrected", FOLD_VIEWS)
def _(spark, root):
    cells, cal, _, merged = repaired(spark, root)
    return E.recount_survival(merged, cells, cal, key=KEY, value="shop_id")


@query("e9_correction_diff", FOLD + """
SELECT diff_q, count(*) AS n, round(avg(before_q), 6) AS mean_before, round(avg(after_q), 6) AS mean_after FROM (
  SELECT c.surv_q_fixed - e.surv_q AS diff_q, e.surv_q AS before_q, c.surv_q_fixed AS after_q
  FROM episodes e JOIN corrected c ON e.location_id = c.location_id AND e.shop_id = c.shop_id) d GROUP BY diff_q""", FOLD_VIEWS)
def _(spark, root):
    cells, cal, eps, merged = repaired(spark, root)
    fixed = E.recount_survival(merged, cells, cal, key=KEY, value="shop_id")
    diff = E.correction_diff(eps, fixed, ["location_id", "shop_id"])
    return diff.groupBy("diff_q").agg(
        F.count(F.lit(1)).alias("n"), F.avg("before_q").alias("mean_before"), F.avg("after_q").alias("mean_after"))


@query("e18_vacancy", FOLD + """,
span AS (SELECT location_id, min("start") AS first_q, max("end") AS last_q FROM corrected GROUP BY location_id),
expected AS (
  SELECT s.location_id, s.first_q, s.last_q, c.period, c.bad, EXISTS (SELECT 1 FROM corrected e
    WHERE e.location_id = s.location_id AND c.period BETWEEN e."start" AND e."end") AS busy
  FROM span s JOIN cal c ON c.period BETWEEN s.first_q AND s.last_q)
SELECT location_id, CAST(first_q AS BIGINT) AS first_q, CAST(last_q AS BIGINT) AS last_q,
  count(CASE WHEN busy OR NOT bad THEN 1 END) AS span_q, count(CASE WHEN NOT busy AND NOT bad THEN 1 END) AS vacant_q,
  round(count(CASE WHEN NOT busy AND NOT bad THEN 1 END) / nullif(count(CASE WHEN busy OR NOT bad THEN 1 END), 0), 6) AS vacancy_rate
FROM expected GROUP BY location_id, first_q, last_q""", FOLD_VIEWS)
def _(spark, root):
    cells, cal, _, merged = repaired(spark, root)
    return E.vacancy(merged, cal, key=KEY)


SLOTS = """
WITH RECURSIVE steps AS (
  SELECT parcel, floor, list({'p': period, 'ids': ids} ORDER BY period) AS steps FROM (
    SELECT parcel, floor, period, list(shop_id ORDER BY shop_id) AS ids FROM snapshot GROUP BY ALL) t GROUP BY parcel, floor),
fold AS (
  SELECT parcel, floor, steps, 1 AS i, list_transform(range(1, len(steps[1].ids) + 1), lambda k: {'m': steps[1].ids[k], 's': k}) AS active FROM steps
  UNION ALL
  SELECT parcel, floor, steps, i + 1, list_concat(stay, list_transform(range(1, len(fresh) + 1), lambda k: {'m': fresh[k],
      's': list_filter(range(1, len(stay) + len(fresh) + 1), lambda z: NOT list_contains(list_transform(stay, lambda a: a.s), z))[k]}))
  FROM (SELECT *, list_filter(active, lambda a: list_contains(steps[i + 1].ids, a.m)) AS stay,
          list_filter(steps[i + 1].ids, lambda id: NOT list_contains(list_transform(active, lambda a: a.m), id)) AS fresh
        FROM fold WHERE i < len(steps)) f),
slotted AS (SELECT parcel, floor, steps[i].p AS period, x.m AS shop_id, x.s AS slot
  FROM (SELECT parcel, floor, steps, i, unnest(active) AS x FROM fold) u)
"""


@query("e10_assign_slots", SLOTS + "SELECT parcel, floor, period, shop_id, slot FROM slotted", ("snapshot",))
def _(spark, root):
    return assign_slots(V.snapshot(spark, root), group=["parcel", "floor"], period="period", member="shop_id")


@query("e10_assign_slots_hot", SLOTS + "SELECT parcel, floor, period, shop_id, slot FROM slotted", ("snapshot",))
def _(spark, root):
    # every group by the ordered scan
    return assign_slots(V.snapshot(spark, root), group=["parcel", "floor"], period="period", member="shop_id", hot_rows=0)


@query("d17_max_concurrency", """
SELECT parcel, floor, max(n) AS max_concurrent FROM (SELECT parcel, floor, period, count(*) AS n FROM snapshot GROUP BY ALL) t
GROUP BY parcel, floor HAVING max(n) >= 5""", ("snapshot",))
def _(spark, root):
    # the largest slot number equals the largest number of tenants at one time
    slotted = assign_slots(V.snapshot(spark, root), group=["parcel", "floor"], period="period", member="shop_id")
    return max_concurrency(slotted, group=["parcel", "floor"], min_n=5)


@query("e11_prior_count", """
SELECT location_id, episode_id, shop_id, "start", row_number() OVER (PARTITION BY location_id ORDER BY "start") - 1 AS prior_tenants
FROM episodes""", ("episodes",))
def _(spark, root):
    return E.prior_count(V.episodes(spark, root), key=KEY, order="start").select(
        "location_id", "episode_id", "shop_id", "start", "prior_tenants")


@query("e16_ordered_diff", """
SELECT surv_q AS length, n, n - lag(n) OVER (ORDER BY surv_q) AS diff FROM (SELECT surv_q, count(*) AS n FROM episodes GROUP BY surv_q) t
""", ("episodes",))
def _(spark, root):
    counts = V.episodes(spark, root).groupBy(F.col("surv_q").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    return R.ordered_diff(counts, "length", "n")


@query("g20_survival_histogram", """
SELECT surv_q AS length, n, round(n / sum(n) OVER (), 6) AS share, n - lag(n) OVER (ORDER BY surv_q) AS diff
FROM (SELECT surv_q, count(*) AS n FROM episodes GROUP BY surv_q) t""", ("episodes",))
def _(spark, root):
    return P.survival_histogram(V.episodes(spark, root))


@query("g20_spike_starts", """
SELECT "start", count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM episodes WHERE surv_q BETWEEN 4 AND 8 GROUP BY "start"
""", ("episodes",))
def _(spark, root):
    return P.spike_starts(V.episodes(spark, root), (4, 8))


@query("g2_frequent_flag", """
SELECT location_id, obs_quarters, turnover_cnt, round(mean_surv, 6) AS mean_surv, max_surv, round(turnover_rate, 6) AS turnover_rate,
  CAST(CASE WHEN mean_surv < 2 THEN 1 ELSE 0 END AS BIGINT) AS frequent FROM metrics WHERE obs_quarters >= 15""", ("metrics",))
def _(spark, root):
    return P.frequent_flag(V.metrics(spark, root), 15, 2.0)


# customers as places, months as periods, the first priority of a month as tenant
V._sql("visits", (), """
SELECT o_custkey AS location_id, CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS period, min(o_orderpriority) AS shop_id FROM orders GROUP BY ALL""")
V._sql("visit_metrics", ("visits",), """
SELECT location_id, CAST(sum(n) AS BIGINT) AS obs_quarters, count(*) - 1 AS turnover_cnt, avg(n) AS mean_surv, max(n) AS max_surv,
  CASE WHEN sum(n) > 1 THEN (count(*) - 1) / (sum(n) - 1) END AS turnover_rate
FROM (SELECT location_id, ep, count(*) AS n FROM (SELECT *, sum(flag) OVER (PARTITION BY location_id ORDER BY period ROWS UNBOUNDED PRECEDING) AS ep FROM (
  SELECT *, CASE WHEN lag(shop_id) OVER (PARTITION BY location_id ORDER BY period) = shop_id THEN 0 ELSE 1 END AS flag FROM visits) a) b GROUP BY ALL) c GROUP BY location_id""")


@query("g3_underperformers", """
SELECT location_id, obs_quarters, turnover_cnt, round(mean_surv, 6) AS mean_surv, max_surv, round(turnover_rate, 6) AS turnover_rate
FROM visit_metrics WHERE obs_quarters >= 3 AND turnover_cnt = 2 AND max_surv < (
  SELECT sum(mean_surv * (turnover_cnt + 1)) / sum(turnover_cnt + 1) FROM visit_metrics WHERE obs_quarters >= 3)""", ("visit_metrics",))
def _(spark, root):
    visits = table(spark, root, "orders").select(
        F.col("o_custkey").alias("location_id"), F.date_format("o_orderdate", "yyyyMM").cast("int").alias("period"), F.col("o_orderpriority").alias("shop_id"))
    eps = E.detect_episodes(visits, key=KEY, period="period", value="shop_id")
    return P.underperformers(E.location_metrics(eps, key=KEY), 2, 3)


@query("e2_top_turnover_places", """
SELECT location_id, obs_quarters, turnover_cnt, round(mean_surv, 6) AS mean_surv, max_surv, round(turnover_rate, 6) AS turnover_rate
FROM metrics ORDER BY turnover_rate DESC NULLS LAST, turnover_cnt DESC, location_id LIMIT 50""", ("metrics",))
def _(spark, root):
    return R.top_n(V.metrics(spark, root), [("turnover_rate", "desc"), ("turnover_cnt", "desc"), ("location_id", "asc")], 50)
