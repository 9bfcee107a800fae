"""Spatial joins on grid cells: every join has an equi key, no pair of far cells is ever formed.

Equal coordinates are collapsed first (a market hall with a third of all shops is one coordinate with a
count), so the work depends on distinct places. Nearest and radius searches descend two trees of cells at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lotline.functions.geo import EARTH_RADIUS_M, haversine_m, inside_ring, ring_distance, ring_edges
from lotline.runtime import stored


def _cell(col: Column, size: float) -> Column:
    return F.floor(col / F.lit(float(size))).cast("long")


def points_in_polygons(
    points: DataFrame, polygons: DataFrame, *, point_id: str, polygon_id: str, keep: Sequence[str] = (),
    cell_m: float = 1000.0,
) -> DataFrame:
    """Left join of points (x, y) with the polygons (ring of x, y) they lie within; of several the
    lowest id wins; points in none keep nulls. ``keep`` names further polygon columns.

    Polygons are listed under the cells of their bounding box; a point meets only its own cell. Equal coordinates
    are looked up once, and every row keeps its place: rows that share an id are not merged.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    cells = (
        polygons.withColumn("_e", ring_edges(F.col("ring")))
        .withColumn("_cx", F.explode(F.sequence(_cell(F.array_min(xs), cell_m), _cell(F.array_max(xs), cell_m))))
        .withColumn("_cy", F.explode(F.sequence(_cell(F.array_min(ys), cell_m), _cell(F.array_max(ys), cell_m))))
        .select("_cx", "_cy", "_e", F.struct(F.col(polygon_id), *[F.col(c) for c in keep if c != polygon_id]).alias("_p"))
    )
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    spots = points.where(known).select("x", "y").distinct()
    placed = spots.withColumn("_cx", _cell(F.col("x"), cell_m)).withColumn("_cy", _cell(F.col("y"), cell_m))
    met = placed.join(cells, ["_cx", "_cy"]).where(inside_ring(F.col("x"), F.col("y"), F.col("_e")))
    hits = met.groupBy("x", "y").agg(F.min("_p").alias("_hit"))
    names = [polygon_id, *[c for c in keep if c != polygon_id]]
    order = [point_id, *[c for c in points.columns if c != point_id]]
    found = points.where(known).join(hits, ["x", "y"], "left").select(*order, *[F.col(f"_hit.{c}").alias(c) for c in names])
    kinds = {f.name: f.dataType for f in found.schema.fields}
    nowhere = points.where(~known).select(*order, *[F.lit(None).cast(kinds[c]).alias(c) for c in names])
    return found.union(nowhere)


def polygon_bounds(polygons: DataFrame, polygon_id: str) -> tuple[DataFrame, DataFrame]:
    """Bounding box of each polygon, and the box around all of them."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    each = polygons.select(
        polygon_id, F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"),
    )
    whole = each.agg(
        F.count(F.lit(1)).alias("n_polygons"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"),
        F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"),
    )
    return each, whole


#: Targets and points of a pair of cells that is compared coordinate by coordinate, and the number of such pairs of a radius count.
FEW, MANY, PAIRS = 128, 1024, 4096
#: A cell is cut into 4 per axis at each step; after so many steps cells are smaller than any coordinate's rounding.
DEEPEST = 20
#: What bounds may be off by rounding, in metres and relative.
SLACK_M, SLACK = 1e-6, 1e-9


@dataclass(frozen=True)
class _Frame:
    """The cube around all items; cells of every depth are cut out of it."""

    axes: tuple[str, ...]
    low: tuple[float, ...]
    span: float

    @classmethod
    def around(cls, axes: Sequence[str], *parts: DataFrame) -> _Frame:
        """Items have columns lo_<axis> and hi_<axis> (one row of extremes comes to the driver)."""
        each = [df.select(*[f"{side}_{a}" for a in axes for side in ("lo", "hi")]) for df in parts]
        row = reduce(DataFrame.union, each).agg(*[F.min(f"lo_{a}") for a in axes], *[F.max(f"hi_{a}") for a in axes]).first()
        low, high = row[: len(axes)], row[len(axes) :]
        if None in low:
            return cls(tuple(axes), (0.0,) * len(axes), 1.0)
        return cls(tuple(axes), tuple(low), max(h - b for h, b in zip(high, low)) or 1.0)

    def cell(self, depth: int) -> Column:
        """The cell of an item's middle."""

        def index(axis: str, low: float) -> Column:
            middle = (F.col(f"lo_{axis}") + F.col(f"hi_{axis}")) / 2
            at = F.floor((middle - F.lit(low)) / F.lit(self.span) * F.lit(4.0**depth)).cast("long")
            return F.greatest(F.lit(0).cast("long"), F.least(at, F.lit(4**depth - 1).cast("long"))).alias(axis)

        return F.struct(*[index(a, b) for a, b in zip(self.axes, self.low)])

    def next_depth(self, depth: int, pairs: DataFrame) -> int | None:
        """Where to cut the open pairs next: at the first depth that can part the widest of their boxes; None if no pair is open."""
        wide = pairs.agg(F.max("wide")).first()[0]
        if wide is None:
            return None
        if wide <= 0:
            return DEEPEST
        return min(DEEPEST, max(depth + 1, math.ceil(math.log(self.span / wide, 4))))

    def nodes(self, items: DataFrame, depth: int, above: int, name: str) -> DataFrame:
        """Cells that hold items: the box around these items and their number (by weight ``_w`` where they have one)."""
        boxes = [f(f"{side}_{a}").alias(f"{name}_{side}_{a}") for a in self.axes for side, f in (("lo", F.min), ("hi", F.max))]
        found = items.groupBy(self.cell(depth).alias(name)).agg(*boxes, (F.sum("_w") if "_w" in items.columns else F.count(F.lit(1))).alias(f"{name}_n"))
        return found.withColumn(f"{name}_up", F.struct(*[F.shiftright(F.col(name)[a], 2 * (depth - above)).alias(a) for a in self.axes]))

    def split(self, pairs: DataFrame | None, points: DataFrame, targets: DataFrame, depth: int, above: int) -> DataFrame:
        """The pairs (q, t) of cells of ``depth`` within ``pairs`` of depth ``above`` (None: in the whole cube, of depth 0), the least
        and the largest distance that their boxes allow, and the widest side of their boxes."""
        q, t = self.nodes(points, depth, above, "q"), self.nodes(targets, depth, above, "t")
        if pairs is None:
            met = q.join(t, F.col("q_up") == F.col("t_up"))
        else:
            above = pairs.select(F.col("q").alias("q_up"), F.col("t").alias("t_up"))
            met = above.join(q, "q_up").join(t, "t_up")
        gap, reach = F.lit(0.0), F.lit(0.0)
        for a in self.axes:
            low = F.greatest(F.lit(0.0), F.col(f"q_lo_{a}") - F.col(f"t_hi_{a}"), F.col(f"t_lo_{a}") - F.col(f"q_hi_{a}"))
            high = F.greatest(F.abs(F.col(f"q_hi_{a}") - F.col(f"t_lo_{a}")), F.abs(F.col(f"t_hi_{a}") - F.col(f"q_lo_{a}")))
            gap, reach = gap + low * low, reach + high * high
        sides = [F.col(f"{n}_hi_{a}") - F.col(f"{n}_lo_{a}") for a in self.axes for n in "qt"]
        return met.select("q", "t", "q_n", "t_n", F.sqrt(gap).alias("gap"), F.sqrt(reach).alias("reach"), F.greatest(*sides).alias("wide"))

    def met(self, points: DataFrame, leaves: DataFrame, depths: Sequence[int], targets: DataFrame) -> DataFrame:
        """Points with the targets of the cells that are left for theirs: leaves (depth, q, t)."""

        def at(items: DataFrame, name: str) -> DataFrame:
            return items.withColumn("_at", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), self.cell(d).alias(name)) for d in depths]))).select(
                "_at.depth", f"_at.{name}", *[c for c in items.columns if not c.startswith(("lo_", "hi_"))])

        return at(points, "q").join(leaves, ["depth", "q"]).join(at(targets, "t"), ["depth", "t"])


def _nearest_pairs(points: DataFrame, targets: DataFrame, axes: Sequence[str], k: int = 1) -> DataFrame:
    """Each point with a few targets, among them all of its ``k`` nearest ones (a target of weight ``_w`` counts so often).

    Points and targets lie in two trees of cells over one cube. A pair of cells is cut into its children as long as the point cell
    has more than FEW targets left; a pair goes once its boxes are farther apart than another target cell can be at
    most. So two far clusters meet by their boxes, not point by point, and a crowded cell is cut until few candidates are left. The
    steps number as the logarithm of the crowd; each is written to the shared folder.
    """
    frame = _Frame.around(axes, points, targets)
    leaves, pairs, depths, depth = [], None, [], 1
    own = W.partitionBy("q")
    while depth is not None:
        step = frame.split(pairs, points, targets, depth, depths[-1] if depths else 0)
        sure = F.col("reach")
        if k > 1:
            step = step.withColumn("sure", F.sum("t_n").over(own.orderBy("reach")))
            sure = F.when(F.col("sure") >= k, F.col("reach"))
        step = step.withColumn("best", F.coalesce(F.min(sure).over(own), F.lit(float("inf"))))
        step = step.where(F.col("gap") <= F.col("best") * (1 + SLACK) + SLACK_M)
        leaf = (F.sum("t_n").over(own) <= max(FEW, 4 * k)) & (F.col("q_n") <= MANY) if depth < DEEPEST else F.lit(True)
        step = stored(step.select("q", "t", "wide", leaf.alias("leaf")))
        leaves.append(step.where("leaf").select(F.lit(depth).alias("depth"), "q", "t"))
        depths.append(depth)
        pairs = step.where(~F.col("leaf"))
        depth = frame.next_depth(depth, pairs)
    return frame.met(points, reduce(DataFrame.union, leaves), depths, targets)


def _boxed(df: DataFrame, **axes: Column) -> DataFrame:
    """``df`` with the boxes of points."""
    return df.withColumns({f"{side}_{a}": c for a, c in axes.items() for side in ("lo", "hi")})


def kth_distance(points: DataFrame, x: str, y: str, k: int, name: str = "distance") -> DataFrame:
    """Distance of each row to its ``k``-th nearest row in the plane, itself being the first; null with a null coordinate (or NaN) or
    fewer than ``k`` rows. Rows of equal coordinates are one target that counts as often as they occur."""
    return kth_distances(points, x, y, [k], name).withColumnRenamed(f"{name}_{k}", name)


def kth_distances(points: DataFrame, x: str, y: str, ks: Sequence[int], name: str = "distance") -> DataFrame:
    """``kth_distance`` for several k from one search: a column ``name``_k for each."""
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    spots = known.groupBy(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_w"))
    spots = stored(_boxed(spots, x=F.col("_x"), y=F.col("_y")))
    near = _nearest_pairs(spots.drop("_w"), spots.withColumnsRenamed({"_x": "_tx", "_y": "_ty"}), "xy", max(ks))
    gap = F.sqrt((F.col("_x") - F.col("_tx")) * (F.col("_x") - F.col("_tx")) + (F.col("_y") - F.col("_ty")) * (F.col("_y") - F.col("_ty")))
    near = near.select("_x", "_y", gap.alias("d"), "_w").withColumn("c", F.sum("_w").over(W.partitionBy("_x", "_y").orderBy("d")))
    kth = near.groupBy("_x", "_y").agg(*[F.min(F.when(F.col("c") >= k, F.col("d"))).alias(f"{name}_{k}") for k in ks])
    on = (F.col(x).cast("double") == F.col("_x")) & (F.col(y).cast("double") == F.col("_y"))
    return points.join(kth, on, "left").select(*points.columns, *[f"{name}_{k}" for k in ks])


def nearest_polygon(
    points: DataFrame, polygons: DataFrame, *, point_id: str, polygon_id: str, keep: Sequence[str] = (), cell_m: float = 1000.0,
) -> DataFrame:
    """Nearest polygon of each point (x, y) and its distance (0 inside); ties go to the lowest id.

    Containing polygons are found by cells of ``cell_m``, the nearest edges by descent of two trees.
    """
    px, py, x, y = F.col("x"), F.col("y"), F.col("_x"), F.col("_y")
    names = [polygon_id, *[c for c in keep if c != polygon_id]]
    coords = stored(points.where(px.isNotNull() & py.isNotNull()).select(px.alias("_x"), py.alias("_y")).distinct())
    listed = polygons.select(F.struct(*names).alias("_p"), "ring", ring_edges(F.col("ring")).alias("_e"))
    edges = listed.select("_p", F.explode("_e").alias("_e"))
    sides = {"lo": F.least, "hi": F.greatest}
    edges = stored(edges.withColumns({f"{side}_{a}": f(F.col(f"_e.a{a}"), F.col(f"_e.b{a}")) for a in "xy" for side, f in sides.items()}))
    near = _nearest_pairs(_boxed(coords, x=x, y=y), edges, "xy")
    outer = near.select("_x", "_y", F.struct(ring_distance(x, y, F.array("_e")).alias("d"), F.col("_p").alias("p")).alias("_c"))
    inner = coords.join(_inside_pairs(coords, listed, cell_m), ["_x", "_y"]).select("_x", "_y", F.struct(F.lit(0.0).alias("d"), F.col("_p").alias("p")).alias("_c"))
    best = outer.union(inner).groupBy("_x", "_y").agg(F.min("_c").alias("_best"))
    return points.join(best, (px == x) & (py == y), "left").select(
        *points.columns, *[F.col(f"_best.p.{c}").alias(c) for c in names], F.col("_best.d").alias("distance_m")
    )


def _inside_pairs(coords: DataFrame, listed: DataFrame, cell_m: float) -> DataFrame:
    """Coordinates (_x, _y) with the polygons (_p, ring, edges _e) that hold them."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    cells = (
        listed.withColumn("_cx", F.explode(F.sequence(_cell(F.array_min(xs), cell_m), _cell(F.array_max(xs), cell_m))))
        .withColumn("_cy", F.explode(F.sequence(_cell(F.array_min(ys), cell_m), _cell(F.array_max(ys), cell_m))))
        .select("_cx", "_cy", "_e", "_p")
    )
    placed = coords.withColumn("_cx", _cell(F.col("_x"), cell_m)).withColumn("_cy", _cell(F.col("_y"), cell_m))
    return placed.join(cells, ["_cx", "_cy"]).where(inside_ring(F.col("_x"), F.col("_y"), F.col("_e"))).select("_x", "_y", "_p")


def _on_sphere(df: DataFrame) -> DataFrame:
    """Boxes of coordinates as points in space, so that no latitude, pole or date line is special; the straight
    distance of two grows with their great-circle distance."""
    lon, lat = F.radians("lon"), F.radians("lat")
    return _boxed(df, x=F.cos(lat) * F.cos(lon) * EARTH_RADIUS_M, y=F.cos(lat) * F.sin(lon) * EARTH_RADIUS_M, z=F.sin(lat) * EARTH_RADIUS_M)


_KNOWN = "lon is not null and lat is not null and not isnan(lon) and not isnan(lat)"


def nearest_point(points: DataFrame, targets: DataFrame, *, point_id: str, target: str) -> DataFrame:
    """Nearest target of each point (lon, lat) by great-circle distance; ties go to the lowest name."""
    coords = stored(_on_sphere(points.where(_KNOWN).select("lon", "lat").distinct()))
    goals = targets.where(_KNOWN).groupBy("lon", "lat").agg(F.min(target).alias("_t"))
    goals = stored(_on_sphere(goals).withColumnsRenamed({"lon": "_tlon", "lat": "_tlat"}))
    distance = haversine_m(F.col("lon"), F.col("lat"), F.col("_tlon"), F.col("_tlat"))
    best = _nearest_pairs(coords, goals, "xyz").groupBy("lon", "lat").agg(
        F.min(F.struct(distance.alias("d"), F.col("_t").alias("t"))).alias("_best")
    )
    return points.join(best, ["lon", "lat"], "left").select(
        *points.columns, F.col("_best.t").alias(target), F.col("_best.d").alias("distance_m")
    )


def count_within(
    points: DataFrame, targets: DataFrame, *, radius_m: float, name: str = "n_within", exclude_self: bool = False,
) -> DataFrame:
    """Number of targets (lon, lat) within a great-circle radius of each point, minus itself if asked.

    Pairs of cells of two trees are counted whole where even their far corners are within the radius, dropped where their near
    ones are not, and cut into children otherwise, until few coordinates are left to compare one by one. So the work follows the
    circles, not the crowds in them. Null coordinates give a null count.
    """
    chord = 2 * EARTH_RADIUS_M * math.sin(min(radius_m / (2 * EARTH_RADIUS_M), math.pi / 2))
    coords = stored(_on_sphere(points.where(_KNOWN).select("lon", "lat").distinct()))
    goals = targets.where(_KNOWN).groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("_tn"))
    goals = stored(_on_sphere(goals).withColumnsRenamed({"lon": "_tlon", "lat": "_tlat"}))
    frame = _Frame.around("xyz", coords, goals)
    whole, leaves, pairs, depths, depth = [], [], None, [], 1
    while depth is not None:
        step = frame.split(pairs, coords, goals, depth, depths[-1] if depths else 0).where(F.col("gap") <= chord * (1 + SLACK) + SLACK_M)
        full = F.col("reach") <= chord * (1 - SLACK) - SLACK_M
        leaf = F.col("q_n") * F.col("t_n") <= PAIRS if depth < DEEPEST else F.lit(True)
        step = stored(step.select("q", "t", "wide", F.when(full, "whole").when(leaf, "leaf").otherwise("split").alias("kind")))
        whole.append(step.where("kind = 'whole'").select(F.lit(depth).alias("depth"), "q", "t"))
        leaves.append(step.where("kind = 'leaf'").select(F.lit(depth).alias("depth"), "q", "t"))
        depths.append(depth)
        pairs = step.where("kind = 'split'")
        depth = frame.next_depth(depth, pairs)
    near = frame.met(coords, reduce(DataFrame.union, leaves), depths, goals)
    near = near.where(haversine_m(F.col("lon"), F.col("lat"), F.col("_tlon"), F.col("_tlat")) <= radius_m).select("lon", "lat", "_tn")
    at = [F.struct(F.lit(d).alias("depth"), frame.cell(d).alias("c")) for d in depths]
    cells = goals.select("_tn", F.explode(F.array(*at)).alias("_at")).groupBy("_at.depth", F.col("_at.c").alias("t")).agg(F.sum("_tn").alias("_tn"))
    sums = reduce(DataFrame.union, whole).join(cells, ["depth", "t"]).groupBy("depth", "q").agg(F.sum("_tn").alias("_tn"))
    far = coords.select("lon", "lat", F.explode(F.array(*at)).alias("_at")).select("lon", "lat", "_at.depth", F.col("_at.c").alias("q"))
    counted = near.union(far.join(sums, ["depth", "q"]).select("lon", "lat", "_tn")).groupBy("lon", "lat").agg(F.sum("_tn").alias("_n"))
    counted = coords.select("lon", "lat").join(counted, ["lon", "lat"], "left").select(
        "lon", "lat", (F.coalesce("_n", F.lit(0)) - F.lit(1 if exclude_self else 0)).alias(name))
    return points.join(counted, ["lon", "lat"], "left").select(*points.columns, name)
