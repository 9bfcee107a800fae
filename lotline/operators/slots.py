"""Slots: a stable number for each tenant among those who share a (parcel, floor) at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.operators.ordinals import text_rank
from lotline.runtime import dealt_join, keyed_join, pinned, stored

HOT_GROUP_ROWS = 20_000
#: Rows of a group that one task reads in order, holding the members of one period.
SCAN_GROUP_ROWS = 20_000_000
#: Slots in a block of a group that is larger still.
BLOCK_SLOTS = 4096


def assign_slots(
    panel: DataFrame, *, group: Sequence[str], period: str, member: str, hot_rows: int = HOT_GROUP_ROWS,
    scan_rows: int = SCAN_GROUP_ROWS, block: int = BLOCK_SLOTS,
) -> DataFrame:
    """In period order, members that vanished give their slot back and arrivals, in the order of
    their id, take the smallest free slots. Only periods in which the group has rows are stepped.

    Groups up to ``hot_rows`` rows are folded inside one array expression after a single shuffle on
    the group. Larger ones are scanned once in the order of period and member, with the free slots in a heap; many
    groups share a task. A group beyond ``scan_rows`` is no task's job: its slots are dealt into blocks of ``block``, arrivals are
    ranked across tasks for all periods at once, and in each period the blocks take the ranks that the free slots before them leave.
    Either way members are text, integers, decimals of up to 18 digits, dates or timestamps, in the order of
    their type; a null is nobody, and a period with nothing else is not stepped.
    """
    rows = panel.select(*group, period, member).where(F.col(member).isNotNull())
    encode, decode = _sortable(rows, member)
    big = pinned(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows))
    largest = big.agg(F.max("_n")).first()[0]
    if largest is None:
        return _fold(rows, group, period, member)
    hot = keyed_join(rows, big, group).distinct()
    out = _fold(keyed_join(rows, big.select(*group), group, "left_anti"), group, period, member)
    out = out.unionByName(_scan(hot.where(F.col("_n") <= scan_rows).drop("_n"), group, period, member))
    if largest > scan_rows:
        huge = hot.where(F.col("_n") > scan_rows).drop("_n").withColumn(member, encode)
        out = out.unionByName(_by_blocks(huge, group, period, member, block).withColumn(member, decode))
    return out


def _sortable(rows: DataFrame, member: str) -> tuple[Column, Column]:
    """Text that sorts as the member's own type does, and the way back: integers by their hex digits, sign bit turned."""
    kind, col = rows.schema[member].dataType, F.col(member)
    if isinstance(kind, T.StringType):
        return col, col
    sign = F.lit(-(1 << 63))
    halves = [F.conv(F.substring(col, at, 8), 16, 10).cast("long") for at in (1, 9)]
    number = F.shiftleft(halves[0], 32).bitwiseOR(halves[1]).bitwiseXOR(sign)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        as_long, back = col.cast("long"), number.cast(kind)
    elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
        power = F.lit(10**kind.scale)
        as_long, back = (col * power).cast("long"), (number.cast("decimal(19,0)") / power).cast(kind)
    elif isinstance(kind, T.DateType):
        as_long, back = F.unix_date(col).cast("long"), F.date_from_unix_date(number.cast("int"))
    elif isinstance(kind, T.TimestampType):
        as_long, back = F.unix_micros(col), F.timestamp_micros(number)
    else:
        raise ValueError(f"a member of type {kind.simpleString()} has no order to assign slots by")
    return F.lpad(F.hex(as_long.bitwiseXOR(sign)), 16, "0"), back


def _fold(rows: DataFrame, group: Sequence[str], period: str, member: str) -> DataFrame:
    steps = (
        rows.repartition(*group)  # one shuffle serves the three aggregations below
        .groupBy(*group, period).agg(F.sort_array(F.collect_set(member)).alias("ids"))
        .groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(period, "ids"))).alias("steps"))
    )
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key_type, when_type = types[member], types[period]

    def step(acc: Column, x: Column) -> Column:
        ids = x["ids"]
        stay = F.map_filter(acc["active"], lambda k, _: F.array_contains(ids, k))
        fresh = F.array_except(ids, F.map_keys(stay))
        free = F.array_except(F.sequence(F.lit(1), F.size(ids)), F.map_values(stay))
        taken = F.map_from_arrays(fresh, F.slice(free, F.lit(1), F.size(fresh)))
        active = F.map_concat(stay, taken)
        entry = F.struct(x[period].alias("p"), F.map_entries(active).alias("m"))
        return F.struct(active.alias("active"), F.concat(acc["out"], F.array(entry)).alias("out"))

    start = F.struct(
        F.create_map().cast(f"map<{key_type},int>").alias("active"),
        F.array().cast(f"array<struct<p:{when_type},m:array<struct<key:{key_type},value:int>>>>").alias("out"),
    )
    folded = steps.select(*group, F.explode(F.aggregate("steps", start, step)["out"]).alias("o"))
    return folded.select(*group, F.col("o.p").alias(period), F.explode("o.m").alias("e")).select(
        *group, period, F.col("e.key").alias(member), F.col("e.value").alias("slot")
    )


def _scan(rows: DataFrame, group: Sequence[str], period: str, member: str) -> DataFrame:
    """One pass over distinct rows in order; a task holds the slots and the rows of one period of one group."""
    keys = [*group, period]
    ordered = rows.repartition(*group).sortWithinPartitions(*keys, member)
    names = [*keys, member, "slot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        slots: list[int] = []
        here, when, held, free, top = None, None, {}, [], 0
        ids: list = []

        def settle() -> None:
            nonlocal top
            present = set(ids)
            for gone in [m for m in held if m not in present]:
                heappush(free, held.pop(gone))
            for m in ids:
                if m not in held:
                    if free:
                        held[m] = heappop(free)
                    else:
                        top += 1
                        held[m] = top
                slots.append(held[m])
            ids.clear()

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            while waiting and (last or len(slots) >= waiting[0].num_rows):
                batch = waiting.pop(0)
                done = pa.array(slots[: batch.num_rows], pa.int32())
                del slots[: batch.num_rows]
                yield pa.RecordBatch.from_arrays([*batch.columns, done], names)

        for batch in batches:
            waiting.append(batch)
            columns = [c.to_pylist() for c in batch.columns]
            for *key, at, m in zip(*columns, strict=True):
                if (key, at) != (here, when):
                    settle()
                    if key != here:
                        held, free, top = {}, [], 0
                    here, when = key, at
                ids.append(m)
            yield from ready(False)
        settle()
        yield from ready(True)

    schema = T.StructType([*[rows.schema[c] for c in names[:-1]], T.StructField("slot", T.IntegerType())])
    return ordered.select(*names[:-1]).mapInArrow(run, schema)


def _by_blocks(rows: DataFrame, group: Sequence[str], period: str, member: str, width: int) -> DataFrame:
    """The same for groups too large for one task; members are text that sorts as they do.

    A stay is a run of the group's periods; its slot is the j-th free one when it begins, j being its rank among the arrivals of
    that period, which does not depend on slots and so is known beforehand. A block of slots keeps its stays until they
    end; the free slots of the blocks before it say which ranks it takes. There is one step for each of a group's periods, with all
    groups and blocks in parallel.
    """
    name = F.to_json(F.struct(*group), {"ignoreNullFields": "false"})
    rows = stored(rows.withColumn("_g", name))
    calendar = rows.groupBy("_g", period).agg(F.count(F.lit(1)).alias("_n"))
    calendar = stored(calendar.withColumn("_t", F.row_number().over(W.partitionBy("_g").orderBy(period))))
    own = W.partitionBy("_g", member)
    run = F.col("_t") - F.row_number().over(own.orderBy("_t"))
    placed = dealt_join(rows, calendar, ["_g", period], "_n").withColumn("_run", run)
    placed = stored(placed.withColumn("_s", F.min("_t").over(W.partitionBy("_g", member, "_run"))).drop("_n", "_run"))
    stays = placed.groupBy("_g", member, "_s").agg(F.max("_t").alias("_e"))
    stay = F.struct(F.col("_j").alias("j"), F.col(member).alias("m"), F.col("_e").alias("e"))
    arrivals = text_rank(stays, ["_g", "_s"], member, "_j").groupBy("_g", "_s", F.floor((F.col("_j") - 1) / width).alias("_c"))
    arrivals = stored(arrivals.agg(F.sort_array(F.collect_list(stay)).alias("_new")))
    last = F.ceil(F.col("n") / width).cast("long") - 1
    held_type = "array<struct<slot:int,e:int>>"
    state = stored(calendar.groupBy("_g").agg(F.max("_n").alias("n")).select(
        "_g", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_b"), F.array().cast(held_type).alias("held")))
    steps = calendar.agg(F.max("_t")).first()[0] or 0
    done = []
    for t in range(1, steps + 1):
        live = state.select("_g", "_b", F.filter("held", lambda h: h["e"] >= t).alias("held"))
        free = F.lit(width) - F.size("held")
        upto = F.sum(free).over(W.partitionBy("_g").orderBy("_b"))
        ranged = live.select("_g", "_b", "held", (upto - free).alias("_low"), upto.alias("_high"))
        asks = F.sequence(F.floor(F.col("_low") / width), F.floor((F.col("_high") - 1) / width))
        asking = ranged.where("_high > _low").select("_g", "_b", "_low", "_high", F.explode(asks).alias("_c"))
        mine = F.filter("_new", lambda a: (a["j"] > F.col("_low")) & (a["j"] <= F.col("_high")))
        got = asking.join(arrivals.where(F.col("_s") == t), ["_g", "_c"]).groupBy("_g", "_b").agg(
            F.sort_array(F.flatten(F.collect_list(mine))).alias("_mine"))
        first = F.col("_b").cast("int") * width
        numbers = F.array_except(F.sequence(first + 1, first + width), F.col("held.slot"))
        seated = F.zip_with(F.slice(numbers, 1, F.size("_mine")), F.col("_mine"), lambda n, a: F.struct(n.alias("slot"), a["e"].alias("e"), a["m"].alias("m")))
        empty = F.array().cast(got.schema["_mine"].dataType)
        met = live.join(got, ["_g", "_b"], "left").withColumn("_mine", F.coalesce("_mine", empty)).withColumn("_seated", seated)
        kept = F.concat("held", F.transform("_seated", lambda x: F.struct(x["slot"].alias("slot"), x["e"].alias("e"))))
        state = stored(met.select("_g", "_b", kept.alias("held"), F.transform("_seated", lambda x: F.struct(x["slot"].alias("slot"), x["m"].alias("m"))).alias("new")))
        done.append(state.select("_g", F.lit(t).alias("_s"), F.explode("new").alias("x")))
    out = reduce(DataFrame.union, done).select("_g", "_s", F.col("x.m").alias(member), F.col("x.slot").alias("slot"))
    return placed.join(out, ["_g", "_s", member]).select(*group, period, member, "slot")


def max_concurrency(slotted: DataFrame, *, group: Sequence[str], slot: str = "slot", min_n: int = 30) -> DataFrame:
    """(parcel, floor) whose largest slot number, i.e. most tenants at one time, reaches ``min_n``."""
    return slotted.groupBy(*group).agg(F.max(slot).alias("max_concurrent")).where(F.col("max_concurrent") >= min_n)
