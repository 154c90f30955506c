"""Statistics of day windows from partials over 2**k days.

A window of days is cut into whole cells of 2**k days, at most two for each k, and readings are added up per day and then per cell.
Windows and cells meet on equal keys; no reading meets a window it does not lie in, and a long window costs as
many rows as a short one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Cells of up to 2**LEVELS days; longer windows take several of those.
LEVELS = 12
# Added to day numbers so that none is negative.
DAY_ZERO = 1 << 31


def day_number(day: Column) -> Column:
    return F.unix_date(day).cast("long")


def window_cells(start: Column, end: Column, levels: int = LEVELS) -> Column:
    """Array of (level, cell): the days from `start` to `end`, both included, each in one cell; empty if there are none."""
    first, stop = day_number(start), day_number(end) + 1
    found = []
    for k in range(levels + 1):
        size = 1 << k
        # Whole cells of this level lie in [low, high); those in [2 * above_low, 2 * above_high) are parts of larger ones.
        low, high = F.ceil(first / size), F.floor(stop / size)
        if k == levels:
            cells = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
        else:
            above_low, above_high = F.ceil(first / (2 * size)), F.floor(stop / (2 * size))
            ends = F.when(low < high, F.array_distinct(F.array(low, high - 1))).otherwise(F.array().cast("array<bigint>"))
            cells = F.when(above_low < above_high, F.filter(ends, lambda c: (c < 2 * above_low) | (c >= 2 * above_high))).otherwise(ends)
        found.append(_at_level(cells, k))
    return F.concat(*found)


def _at_level(cells: Column, level: int) -> Column:
    return F.transform(cells, lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))


def day_partials(readings: DataFrame, keys: Sequence[str], day: str = "day", value: str = "value_num", home: Sequence[str] | None = None) -> DataFrame:
    """Per key and day: n, total, extremes, sums of distances from a value near those of the key (`d1`, `d2`) and `place`.

    Squares of the values themselves would cancel where a series varies little about a large mean. `place` grows with the
    greatest value of a day, of equal ones towards the first day, and carries the day, so its maximum names the peak.
    Rows of equal `home`, some of the keys, end up in one task, so that they can meet windows by them without being sent again.
    """
    v = F.col(value)
    daily = readings.where(v.isNotNull()).groupBy(*keys, day).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.max(v).alias("most"), F.min(v).alias("least"), (F.var_pop(v) * F.count(v)).alias("_m2"))
    # A key has no more rows here than it has days.
    of_key = W.partitionBy(*keys)
    daily = daily.repartition(*(home or keys))
    near = daily.withColumns({
        "_near": F.avg(F.col("total") / F.col("n")).over(of_key),
        "_rank": F.row_number().over(of_key.orderBy(F.col("most"), F.desc(day)))})
    d1 = F.col("total") - F.col("n") * F.col("_near")
    place = F.shiftleft(F.col("_rank").cast("long"), 32).bitwiseOR(day_number(F.col(day)) + DAY_ZERO)
    return near.withColumns({"d1": d1, "d2": F.col("_m2") + d1 * d1 / F.col("n"), "place": place}).drop("_m2", "_near", "_rank")


def place_day(place: Column) -> Column:
    return F.date_from_unix_date((place.bitwiseAND(F.lit((1 << 32) - 1)) - DAY_ZERO).cast("int"))


def cell_partials(daily: DataFrame, keys: Sequence[str], reach: DataFrame, join_keys: Sequence[str], day: str = "day", levels: int = LEVELS) -> DataFrame:
    """Partials of cells from those of days, for each key of `reach` (join_keys, days) up to cells of so many days."""
    top = F.least(F.lit(levels), F.floor(F.log2("days") + 1e-9)).cast("int")
    placed = daily.join(reach.hint("merge"), list(join_keys)).select(
        *keys, "n", "total", "d1", "d2", "most", "least", "place", day_number(F.col(day)).alias("_no"), F.explode(F.sequence(F.lit(0), top)).alias("level"))
    # Added up before they are sent: a key has about two cells for each of its days, whatever the levels.
    return placed.groupBy(*keys, "level", F.expr("shiftright(_no, level)").alias("cell")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2"), F.min("least").alias("least"),
        F.max("most").alias("most"), F.max("place").alias("place"))


def window_totals(windows: DataFrame, daily: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(extra, keys, start_date, end_date, n, total, variance, most, least, peak_day) of the distinct windows that hold a reading.

    `daily` may come in several versions, told apart by the columns `extra`.
    """
    base = [*keys, "start_date", "end_date"]
    spans = windows.select(*base).where("start_date <= end_date").distinct()
    cells = spans.select(*base, F.explode(window_cells(F.col("start_date"), F.col("end_date"))).alias("_c")).select(*base, "_c.level", "_c.cell")
    reach = spans.groupBy(*keys).agg((F.max(F.date_diff("end_date", "start_date")) + 1).alias("days"))
    parts = cell_partials(daily, [*extra, *keys], reach, keys)
    # Rows as many as the windows are never sent to all executors, however small they are when compressed.
    whole = cells.hint("merge").join(parts, [*keys, "level", "cell"]).groupBy(*extra, *base).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("d1").alias("_d1"), F.sum("d2").alias("_d2"), F.min("least").alias("least"),
        F.max("most").alias("most"), F.max("place").alias("_place"))
    spread = F.greatest(F.col("_d2") - F.col("_d1") * F.col("_d1") / F.col("n"), F.lit(0.0))
    return whole.select(*extra, *base, "n", "total", F.when(F.col("n") > 1, spread / (F.col("n") - 1)).alias("variance"), "most", "least",
                        place_day(F.col("_place")).alias("peak_day"))
