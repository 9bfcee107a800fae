"""Location, district and industry products: compositions of the operators, one plan each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.functions.columns import brand_key, cut_bins, floor_category, floor_number, period_year, ratio
from lotline.operators import aggregates as A
from lotline.operators import episodes as E
from lotline.operators import ranked as R
from lotline.operators.cleaning import flag_cascade, rare_to_other
from lotline.operators.joins import attach, join_with_fallback, outer_features
from lotline.operators.ordinals import quantile_values
from lotline.operators.spatial import count_within, nearest_point, points_in_polygons
from lotline.runtime import keyed_join, scalar, stored

UNASSIGNED = "UNASSIGNED"


def blank_floor(col: str) -> Column:
    """No floor information: null, blank, or the text nan."""
    text = F.lower(F.trim(F.col(col)))
    return F.col(col).isNull() | text.isin("", "nan")


def reliability_flags(
    rows: DataFrame, *, parcel: str = "parcel", floor: str = "floor_raw", total_floors: str = "total_floors",
    matched: str = "matched", min_floors: int = 5, ratio: float = 0.8,
) -> DataFrame:
    """G1: unmatched, no_floor, floor1_skew (tall building whose rows are nearly all on floor 1), verified.

    The share is taken over all matched rows of the parcel, those without a floor included.
    """
    stats = rows.where(F.col(matched)).groupBy(parcel).agg(
        F.avg(F.coalesce((F.col(floor) == "1").cast("double"), F.lit(0.0))).alias("_share"),
        F.max(total_floors).alias("_floors"),
    )
    skewed = stats.where((F.col("_floors") >= min_floors) & (F.col("_share") >= ratio)).select(parcel, F.lit(True).alias("_skew"))
    joined = rows.join(skewed, parcel, "left")
    return flag_cascade(joined, [
        ("unmatched", ~F.col(matched)), ("no_floor", blank_floor(floor)), ("floor1_skew", F.col("_skew")),
    ]).drop("_skew")


def frequent_flag(metrics: DataFrame, min_obs: int = 15, max_mean: float = 8.0) -> DataFrame:
    """Reliable places with their frequent-change flag (mean survival below the limit)."""
    return metrics.where(F.col("obs_quarters") >= min_obs).withColumn(
        "frequent", F.when(F.col("mean_surv") < max_mean, 1).otherwise(0)
    )


def underperformers(metrics: DataFrame, turnover: int = 2, min_obs: int = 15) -> DataFrame:
    """Places with few changes that still never held a tenant as long as the episode-weighted mean."""
    reliable = metrics.where(F.col("obs_quarters") >= min_obs)
    n_episodes = F.col("turnover_cnt") + 1
    mean = scalar(reliable, F.sum(F.col("mean_surv") * n_episodes) / F.sum(n_episodes))
    return reliable.where((F.col("turnover_cnt") == turnover) & (F.col("max_surv") < mean))


def ratio_by_area(locations: DataFrame, subset_flag: str, area: str) -> DataFrame:
    """Flagged places per area against all reliable ones, in one pass."""
    return locations.where(F.col(area).isNotNull()).groupBy(area).agg(
        F.count(F.lit(1)).alias("n_all"), F.sum(subset_flag).alias("n_subset"), F.avg(subset_flag).alias("ratio")
    )


def vacancy_types(locations: DataFrame, frequent: DataFrame, area: Sequence[str]) -> DataFrame:
    """Frequent places with the vacancy baseline of their area (over all places) and its type: stagnant
    at or above the median area, competitive below, unclassified without a baseline."""
    base = locations.where(F.col(area[0]).isNotNull()).groupBy(*area).agg(
        F.count(F.lit(1)).alias("n_area"), F.avg("vacancy_rate").alias("area_vacancy")
    )
    middle = F.lit(quantile_values(base, "area_vacancy", [0.5])[0])
    out = attach(frequent, base.select(area[0], "n_area", "area_vacancy"), [area[0]])
    rate = F.col("area_vacancy")
    return out.withColumn(
        "vacancy_type", F.when(rate.isNull(), "unclassified").when(rate >= middle, "stagnant").otherwise("competitive")
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """G5 check: keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def full_locations(
    metrics: DataFrame, coords: DataFrame, vacancy: DataFrame, industry: DataFrame, polygons: DataFrame, *,
    key: str = "location_id", min_obs: int = 15, max_mean: float = 8.0,
) -> DataFrame:
    """Metrics with coordinates, vacancy, dominant industry, district by polygon and the assigned flag."""
    placed = points_in_polygons(
        coords.where(F.col("x").isNotNull() & F.col("y").isNotNull()), polygons,
        point_id=key, polygon_id="polygon_id", keep=["polygon_name"],
    ).select(key, F.col("polygon_id").alias("district_id"), F.col("polygon_name").alias("district_name"))
    out = metrics
    for side in (vacancy, industry, coords, placed):
        out = attach(out, side, [key])
    return out.withColumn("assigned", F.col("district_id").isNotNull()).withColumn(
        "frequent", F.when((F.col("obs_quarters") >= min_obs) & (F.col("mean_surv") < max_mean), 1).otherwise(0)
    )


def named_unassigned(locations: DataFrame, code: str = "district_id", kind: str = "district_type") -> DataFrame:
    return locations.withColumns({
        code: F.coalesce(F.col(code), F.lit(UNASSIGNED)), kind: F.coalesce(F.col(kind), F.lit("outside")),
    })


def area_baseline(locations: DataFrame, keys: Sequence[str] = ("district_id", "district_type"), min_obs: int = 15,
                  min_n: int = 30) -> DataFrame:
    """Baseline per district with an UNASSIGNED group. Medians are of metrics built from quarter counts,
    hence with few distinct values. Vacancy counts leave unknown rates out on both sides."""
    rows = named_unassigned(locations.where(F.col("obs_quarters") >= min_obs))
    seen = F.col("vacancy_rate").isNotNull()
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_locations"), F.sum("frequent").alias("n_frequent"),
        F.avg("turnover_rate").alias("mean_rate"), F.median("turnover_rate").alias("median_rate"),
        F.avg("mean_surv").alias("avg_surv"), F.median("mean_surv").alias("median_surv"),
        F.avg("vacancy_rate").alias("mean_vacancy"), F.count_if(seen & (F.col("vacancy_rate") > 0)).alias("n_vacant"),
        F.count_if(seen).alias("n_vacancy_known"), F.min("first_q").alias("from_q"), F.max("last_q").alias("to_q"),
    ).withColumns({
        "frequent_ratio": F.col("n_frequent") / F.col("n_locations"),
        "vacant_ratio": ratio("n_vacant", "n_vacancy_known"),
        "enough": F.col("n_locations") >= min_n,
        "real_area": F.col(keys[0]) != UNASSIGNED,
    })
    return keyed_join(base, A.top_categories_text(rows, keys, "dominant_ind", 3, "top_industries"), keys, "left")


_MEANS = {"mean_rate": "turnover_rate", "avg_surv": "mean_surv", "mean_vacancy": "vacancy_rate"}
_MEDIANS = {"median_rate": "turnover_rate", "median_surv": "mean_surv"}


def industry_rows(locations: DataFrame, shares: DataFrame, min_obs: int = 15) -> DataFrame:
    """Reliable places, one row per industry with its share as weight. Written once: each weighted median
    reads it three times."""
    rows = named_unassigned(locations.where(F.col("obs_quarters") >= min_obs))
    return stored(rows.join(shares.select("location_id", "industry", "share"), "location_id"))


def cell_baseline(expanded: DataFrame, min_n: float = 10) -> DataFrame:
    """Share-weighted baseline per district and industry, with sample and real-district flags."""
    keys = ["district_id", "district_type", "industry"]
    return A.weighted_baseline(expanded, keys, "share", "frequent", _MEANS, _MEDIANS).withColumns(
        {"enough": F.col("n_w") >= min_n, "real_area": F.col("district_id") != UNASSIGNED})


def type_baseline(expanded: DataFrame) -> DataFrame:
    """The same per district type and industry."""
    return A.weighted_baseline(expanded, ["district_type", "industry"], "share", "frequent", _MEANS, _MEDIANS)


def industry_baseline(expanded: DataFrame) -> DataFrame:
    """The same per industry, with the deviation of the district medians."""
    overall = A.weighted_baseline(expanded, ["industry"], "share", "frequent", _MEANS, _MEDIANS)
    per_district = A.weighted_median(expanded, ["industry", "district_id"], "turnover_rate", "share", "median_rate")
    return attach(overall, A.between_group_std(per_district, ["industry"], "median_rate", "rate_std_between_districts"), ["industry"])


def conservation_check(expanded: DataFrame, locations: DataFrame, min_obs: int = 15) -> DataFrame:
    """Sums of weights against the number of places and of frequent places (they must agree)."""
    rows = locations.where(F.col("obs_quarters") >= min_obs)
    return expanded.agg(
        F.sum("share").alias("sum_w"), F.sum(F.col("share") * F.col("frequent")).alias("sum_flag_w")
    ).withColumns({"n_locations": scalar(rows, F.count(F.lit(1))), "n_frequent": scalar(rows, F.sum("frequent"))})


def relative_metrics(locations: DataFrame, area: DataFrame, cell: DataFrame, kind: DataFrame, min_obs: int = 15) -> DataFrame:
    """Difference to the district mean and to the industry cell (district x industry if large enough, else
    type x industry), the basis used, and the four-way class."""
    rows = named_unassigned(locations.where(F.col("obs_quarters") >= min_obs)).withColumn(
        "real_area", F.col("district_id") != UNASSIGNED)
    out = attach(rows, area.select("district_id", F.col("mean_rate").alias("area_rate"), F.col("avg_surv").alias("area_surv")),
                 ["district_id"])
    industry = F.col("industry").alias("dominant_ind")
    values = [F.col("mean_rate").alias("adj_rate"), F.col("avg_surv").alias("adj_surv")]
    out = join_with_fallback(
        out,
        [(cell.where("enough").select("district_id", industry, *values), ["district_id", "dominant_ind"], "district x industry"),
         (kind.select("district_type", industry, *values), ["district_type", "dominant_ind"], "type x industry")],
        ["adj_rate", "adj_surv"], basis="basis", none="none",
    )
    out = out.withColumn("basis", F.when(F.col("real_area"), F.col("basis")).otherwise(
        F.concat(F.lit("outside mean ("), F.col("basis"), F.lit(")"))))
    out = out.withColumns({
        "rel_rate": F.col("turnover_rate") - F.col("area_rate"), "rel_surv": F.col("mean_surv") - F.col("area_surv"),
        "adj_rel_rate": F.col("turnover_rate") - F.col("adj_rate"), "adj_rel_surv": F.col("mean_surv") - F.col("adj_surv"),
    })
    high, long = F.col("adj_rel_rate") > 0, F.col("adj_rel_surv") > 0
    return out.withColumn(
        "class",
        F.when(F.col("adj_rel_rate").isNull() | F.col("adj_rel_surv").isNull(), "unclassified")
        .when(high & ~long, "more turnover, shorter survival").when(high & long, "more turnover, longer survival")
        .when(~high & ~long, "less turnover, shorter survival").otherwise("less turnover, longer survival"),
    )


def relative_candidates(relative: DataFrame, area_q: float = 0.25, excess_q: float = 0.9) -> DataFrame:
    """Places in quiet districts (rate at most the lower quartile) whose adjusted excess is in the top decile."""
    real = relative.where("real_area")
    quiet, loud = quantile_values(real, "area_rate", [area_q])[0], quantile_values(real, "adj_rel_rate", [excess_q])[0]
    return real.where((F.col("area_rate") <= F.lit(quiet)) & (F.col("adj_rel_rate") > F.lit(loud)))


def compare_assigned(df: DataFrame, flag: str, class_col: str, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Class shares within assigned / unassigned places, and the means of metrics in both."""
    counts = df.where(F.col(class_col).isNotNull()).groupBy(flag, class_col).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(flag).agg(F.sum("n").alias("_t"))
    shares = counts.join(totals, flag).withColumn("share", F.col("n") / F.col("_t")).drop("_t")
    means = df.groupBy(flag).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])
    return shares, means


def risk_base(
    locations: DataFrame, *, area: str = "district_id", q: float = 0.90, q_top: float = 0.95, min_area: int = 10,
    min_obs: int = 15, bases: Sequence[str] = ("turnover_rate", "turnover_cnt"), chosen: str = "turnover_rate",
) -> tuple[DataFrame, DataFrame]:
    """Excess over the district mean; the label is the top decile of the excess, on two bases; plus one
    summary row per basis. Places outside districts and small districts are left out."""
    rows = locations.where((F.col("obs_quarters") >= min_obs) & F.col(area).isNotNull())
    names = [*bases, "mean_surv"]
    means = rows.groupBy(area).agg(F.count(F.lit(1)).alias("n_area"), *[F.avg(c).alias(f"area_{c}") for c in names])
    df = rows.join(means.where(F.col("n_area") >= min_area), area).withColumns(
        {f"excess_{c}": F.col(c) - F.col(f"area_{c}") for c in names}
    )
    df = stored(df)
    summaries = []
    edges = {}
    for b in bases:
        low, high = quantile_values(df, f"excess_{b}", [q, q_top])
        edges[b] = (F.lit(low), F.lit(high))
    df = df.withColumns({f"risk_{b}": F.when(F.col(f"excess_{b}") >= edges[b][0], 1).otherwise(0) for b in bases})
    df = df.withColumns({
        "risk": F.col(f"risk_{chosen}"), "top5": F.when(F.col(f"excess_{chosen}") >= edges[chosen][1], 1).otherwise(0),
    })
    for b in bases:
        hit, rest = F.col(f"risk_{b}") == 1, F.col(f"risk_{b}") == 0
        summaries.append(df.agg(
            F.lit(b).alias("basis"), F.sum(f"risk_{b}").alias("n_risk"), F.avg(f"risk_{b}").alias("risk_share"),
            F.avg(F.when(hit, F.col("mean_surv"))).alias("risk_mean_surv"),
            F.median(F.when(hit, F.col("mean_surv"))).alias("risk_median_surv"),
            F.min(F.when(hit, F.col("turnover_cnt"))).alias("risk_min_turnover"),
            F.median(F.when(hit, F.col("turnover_cnt"))).alias("risk_median_turnover"),
            F.avg(F.when(rest, F.col("mean_surv"))).alias("rest_mean_surv"),
        ).withColumns({"q90": edges[b][0], "q95": edges[b][1]}))
    return df, R.union_named(summaries)


def area_profile(facts: DataFrame, visitors: DataFrame, workers: DataFrame, residents: DataFrame,
                 span: tuple[int, int], *, key: str = "district_id", time: str = "quarter") -> DataFrame:
    """District profile from long quarterly facts: population ratios and entropy, worker and resident
    shares, sales ratios, growth and variation; joined fully, so a district in one source only stays."""
    within = F.col(time).between(*span)

    def mean_of(df: DataFrame) -> DataFrame:
        cols = [c for c in df.columns if c not in (key, time)]
        return df.where(within).groupBy(key).agg(*[F.avg(c).alias(c) for c in cols])

    v = mean_of(visitors)
    parts = [c for c in v.columns if c.startswith("part_")]
    v = v.select(
        key, F.col("total").alias("visitors"), F.log1p("total").alias("visitors_log"),
        (F.col("female") / F.col("total")).alias("visitor_female_ratio"),
        *[(F.col(p) / F.col("total")).alias(f"ratio_{p}") for p in parts],
    )
    v = v.withColumn("visitor_entropy", A.row_entropy([f"ratio_{p}" for p in parts]))
    w = mean_of(workers).select(key, F.col("total").alias("workers"), F.log1p("total").alias("workers_log"))
    r = mean_of(residents).select(
        key, F.col("total").alias("residents"), (F.col("apartments") / F.col("households")).alias("apartment_ratio"))
    sums = ["amount", "weekend_amount", "night_amount", "n_sales"]
    quarterly = facts.where(within).groupBy(key, time).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums])
    s = quarterly.groupBy(key).agg(*[F.avg(c).alias(c) for c in sums]).select(
        key, F.col("amount").alias("sales"), F.log1p("amount").alias("sales_log"),
        ratio("amount", "n_sales").alias("amount_per_sale"), (F.col("weekend_amount") / F.col("amount")).alias("weekend_ratio"),
        (F.col("night_amount") / F.col("amount")).alias("night_ratio"),
    )
    g = A.growth_and_cv(quarterly, [key], time, "amount")
    out = outer_features([v, w, r, s.join(g, key, "left")], [key])
    return out.withColumns({
        "visitors_per_resident": ratio("visitors", "residents"), "workers_per_resident": ratio("workers", "residents"),
        "sales_per_visitor": ratio("sales", "visitors"),
    })


def final_profile(profile: DataFrame, cells: DataFrame, industries: Sequence[str], keep: DataFrame, *,
                  key: str = "district_id", weight: str = "n_w") -> DataFrame:
    """Profile plus industry composition (shares, entropy, HHI, top 3, log size), own districts only,
    rows with a null left out."""
    total = cells.groupBy(key).agg(F.sum(weight).alias("_t"))
    share = cells.join(total, key).withColumn("share", F.col(weight) / F.col("_t"))
    wide = A.pivot_fill(share, [key], "industry", "share", industries, prefix="share_")
    index = A.composition_indices(share, [key], "share")
    size = total.select(key, F.log1p("_t").alias("size_log"))
    out = profile.join(keep.select(key).distinct(), key, "left_semi")
    for side in (wide, index, size):
        out = out.join(side, key, "left")
    return out.na.drop()


def location_features(
    base: DataFrame, universe: DataFrame, buildings: DataFrame, registry: DataFrame, stations: DataFrame, *,
    year: int = 2025, density_m: float = 200.0, station_m: float = 500.0, rare: float = 0.005,
) -> DataFrame:
    """Physical features of each place: floor class and number, building area, floors, age and use (from the
    one representative building, else from the parcel aggregate), places in the building, density, stations."""
    per_building = universe.groupBy("parcel").agg(F.count(F.lit(1)).alias("n_in_building"))
    out = base.withColumns({"floor_class": floor_category("floor"), "floor_no": floor_number("floor")})
    for side in (buildings, registry, per_building):
        out = out.join(side, "parcel", "left")
    out = out.withColumns({
        "floors": F.coalesce("floors_up", "total_floors"), "use_raw": F.coalesce("use", "registry_use"),
        "age": F.when(F.col("approval_year").isNotNull(), F.greatest(F.lit(year) - F.col("approval_year"), F.lit(0))),
    }).withColumn("floors", F.when(F.col("floors") > 0, F.col("floors")))
    out = rare_to_other(out, "use_raw", rare, name="use_class")
    # the spatial steps read coordinates several times, so they run on a written narrow table
    places = stored(base.select("location_id", "lon", "lat"))
    around = stored(universe.select("lon", "lat"))
    unique = stored(stations.groupBy("station").agg(F.min_by("lon", F.struct("lat", "lon")).alias("lon"), F.min("lat").alias("lat")))
    density = count_within(places, around, radius_m=density_m, name="density_200m", exclude_self=True)
    nearest = nearest_point(places, stations, point_id="location_id", target="station").select(
        "location_id", F.col("station").alias("nearest_station"), F.col("distance_m").alias("station_m"))
    reach = count_within(places, unique, radius_m=station_m, name="stations_500m").select("location_id", "stations_500m")
    for side in (density.select("location_id", "density_200m"), nearest, reach):
        out = out.join(side, "location_id", "left")
    return out.withColumn("district_type", F.coalesce("district_type", F.lit("missing"))).select(
        "location_id", "floor_class", "floor_no", "use_class", "use_raw", "area", "area_total", "floors", "age",
        "n_in_building", "density_200m", "station_m", "nearest_station", "stations_500m", "district_type",
    )


# Bins of the risk profile.
FIXED_BINS: dict[str, tuple[list[float], list[str]]] = {
    "area": ([0, 500, 1000, 3000, 10000, float("inf")], ["<500", "500-1k", "1k-3k", "3k-10k", ">10k"]),
    "floors": ([0, 2, 4, 9, 19, float("inf")], ["1-2", "3-4", "5-9", "10-19", "20+"]),
    "n_in_building": ([0, 1, 3, 9, 29, float("inf")], ["1", "2-3", "4-9", "10-29", "30+"]),
    "station_m": ([-1, 250, 500, 1000, float("inf")], ["<=250", "250-500", "500-1k", ">1k"]),
}
# Grade labels from safest to riskiest.
GRADES = ["very_safe", "safe", "normal", "risky", "very_risky"]


def binned(df: DataFrame, var: str, name: str = "bin", q: int = 5) -> DataFrame:
    """Text variable as it is, listed variables by fixed bins, other numbers by quintile; unknown = missing."""
    if df.schema[var].dataType.simpleString() == "string":
        return df.withColumn(name, F.coalesce(F.col(var), F.lit("missing")))
    if var in FIXED_BINS:
        return df.withColumn(name, F.coalesce(cut_bins(var, *FIXED_BINS[var])["label"], F.lit("missing")))
    out = R.quantile_bins(df, var, q, "_q")
    return out.withColumn(name, F.coalesce(F.col("_q.label"), F.lit("missing"))).drop("_q")


def risk_profile(df: DataFrame, variables: Sequence[str], label: str) -> DataFrame:
    """Per variable and bin: size, risk count and rate, lift, share of places and share of risks."""
    base, total, risks = scalar(df, F.avg(label)), scalar(df, F.count(F.lit(1))), scalar(df, F.sum(label))
    parts = [
        binned(df, v).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("n_risk"))
        .select(F.lit(v).alias("variable"), "bin", "n", "n_risk") for v in variables
    ]
    rate = F.col("n_risk") / F.col("n")
    return R.union_named(parts).withColumns({
        "rate": rate, "lift": rate / base, "share": F.col("n") / total, "risk_share": F.col("n_risk") / risks,
    })


def segment_risk(df: DataFrame, keys: Sequence[str], label: str, min_n: int = 300) -> DataFrame:
    """Rate and lift of every combination with enough rows."""
    base = scalar(df, F.avg(label))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("n_risk")).withColumn(
        "rate", F.col("n_risk") / F.col("n")).withColumn("lift", F.col("rate") / base)
    return A.min_sample(out, "n", min_n)


def map_documents(rows: DataFrame, history: DataFrame, recommended: DataFrame, *, area: str = "district_id",
                  key: str = "location_id", group: str = "floor_class", score: str = "score", k: int = 3) -> DataFrame:
    """One nested record per place (history, recommendations, safer alternatives), keyed by district.

    Rows stay rows; the sink partitions them by district, so no district is gathered in one task.
    """
    out = R.alternatives(rows, [area, group], key, score, k)
    return attach(attach(out, history, [key]), recommended, [key])


def area_document_summary(rows: DataFrame, area: str, grade: str, score: str) -> DataFrame:
    """Per district: size, mean score and number of places per grade."""
    counts = [F.count_if(F.col(grade) == g).alias(g) for g in GRADES]
    return rows.groupBy(area).agg(F.count(F.lit(1)).alias("n_locations"), F.avg(score).alias("mean_score"), *counts).withColumns({
        "n_risky": F.col("risky") + F.col("very_risky"), "n_safe": F.col("safe") + F.col("very_safe"),
    })


def flag_franchise(
    stores: DataFrame, *, store: str = "store_id", name: str = "name", branch: str = "branch", area: str = "gu",
    rules: Sequence[tuple[str, int, int, float]] = (("branch rule", 10, 3, 0.3), ("large brand rule", 100, 20, 0.15)),
    external: DataFrame | None = None, external_min: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Stores with brand and franchise flag, and the brand table with the rule that applied.

    Rules are (label, stores, areas, share of stores with a branch name); brands of one character do not
    count. An optional list of brand names adds brands with at least ``external_min`` stores.
    """
    marked = stores.withColumn("brand", brand_key(name, branch)).withColumn(
        "_has", (F.col(branch).isNotNull() & (F.trim(F.col(branch)) != "")).cast("int"))
    brands = marked.where(F.length("brand") >= 2).groupBy("brand").agg(
        F.count(F.lit(1)).alias("n_stores"), F.count_distinct(area).alias("n_areas"),
        F.avg("_has").alias("branch_share"), F.min(name).alias("example"),
    )
    reason = None
    for label, n, areas, share in rules:
        test = (F.col("n_stores") >= n) & (F.col("n_areas") >= areas) & (F.col("branch_share") >= share)
        reason = F.when(test, label) if reason is None else reason.when(test, label)
    brands = brands.withColumn("reason", reason.otherwise(""))
    if external is not None:
        listed = external.select(brand_key(external.columns[0]).alias("brand")).distinct().withColumn("_l", F.lit(True))
        brands = brands.join(listed, "brand", "left").withColumn("reason", F.when(
            (F.col("reason") == "") & F.col("_l") & (F.col("n_stores") >= external_min), "external list"
        ).otherwise(F.col("reason"))).drop("_l")
    brands = brands.withColumn("franchise", F.when(F.col("reason") != "", 1).otherwise(0))
    out = marked.join(brands.select("brand", "franchise"), "brand", "left").select(
        store, "brand", F.coalesce("franchise", F.lit(0)).alias("franchise"))
    return out, brands


def store_episodes(
    episodes: DataFrame, base: DataFrame, cal: DataFrame, *, key: str = "location_id", length: str = "surv_q",
    two_years: int = 8, entry_cutoff: int = 202301,
) -> DataFrame:
    """Episodes of the analysed places with tenancy order, left censoring (start = first period of the grid),
    whether two years could be observed, closure within two years, entry year and scope."""
    n = scalar(cal, F.max("idx")) + 1
    kept = episodes.join(base.select(key), key, "left_semi")
    starts = cal.select(F.col("period").alias("start"), F.col("idx").alias("_i"))
    out = E.prior_count(kept, key=[key], order="start").join(starts, "start")
    out = out.withColumns({
        "left_censored": F.col("_i") == 0, "observable_2y": F.col("_i") <= n - two_years,
        "closed_2y": F.when((F.col("state") == E.CLOSED) & (F.col(length) < two_years), 1).otherwise(0),
        "entry_year": period_year("start"),
    })
    return out.withColumn(
        "in_scope", ~F.col("left_censored") & F.col("observable_2y") & (F.col("start") < entry_cutoff)
    ).drop("_i")


def rate_tables(stores: DataFrame, key_sets: Sequence[Sequence[str]], outcome: str, min_n: int = 300) -> DataFrame:
    """Closure rate per combination of several key sets in one grouping-sets pass, small cells left out."""
    cols = sorted({c for keys in key_sets for c in keys})
    sets = [[F.col(c) for c in keys] for keys in key_sets]
    out = stores.groupingSets(sets, *[F.col(c) for c in cols]).agg(
        F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("rate"), F.grouping_id().alias("_g")
    )
    name = F.lit(None).cast("string")
    for keys in key_sets:
        bits = sum(1 << (len(cols) - 1 - cols.index(c)) for c in cols if c not in keys)
        name = F.when(F.col("_g") == bits, " x ".join(keys)).otherwise(name)
    return A.min_sample(out, "n", min_n).select(name.alias("key_set"), *cols, "n", "rate")


def survival_histogram(episodes: DataFrame, length: str = "surv_q") -> DataFrame:
    """Episodes per length, share, and change against the next shorter length seen."""
    counts = episodes.groupBy(F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    return R.ordered_diff(counts.withColumn("share", F.col("n") / scalar(counts, F.sum("n"))), "length", "n", "diff")


def spike_starts(episodes: DataFrame, spike: tuple[int, int], length: str = "surv_q") -> DataFrame:
    """In which periods the episodes of a length spike began."""
    return A.frequency(episodes.where(F.col(length).between(*spike)), "start")
