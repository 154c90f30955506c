"""Per-user readings and life events: fuzzy lookups, range joins, interval overlap, statistics.

All users are in one frame; every join carries the user and a month bucket as equi keys, so a
user with very many rows is spread over its months.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import text as tx
from scorelake.functions.dates import event_end, week_key
from scorelake.functions.dates import overlap_days as shared_days
from scorelake.functions.numbers import settled
from scorelake.operators.dyadic import day_partials, window_totals
from scorelake.operators.ranking import exact_median, ranked, top_k

# --- fixed values: indicator groups -----------------------------------------------------------
INDICATOR_GROUPS = {
    "sleep": ["DeepSleep", "LightSleep", "REM", "SleepEfficiency", "SleepLatency",
              "SleepRecovery", "TotalSleepTime", "WakeAfterSleepOnset", "NumberofAwakenings"],
    "cardio": ["HeartRate", "RestingHeartRate", "MaximumHeartRate", "HRV", "RMSSD",
               "BloodPressure", "Systolic", "Diastolic", "HeartRateRecovery", "LF/HF"],
    "activity": ["Step", "Distance", "Exercise", "ActiveCalories", "ActiveEnergy",
                 "MET", "Training", "VO2Max", "Vigorous", "Moderate", "Light", "Sedentary",
                 "Standing", "Lying"],
    "oxygen": ["SpO2", "LowestSpO2", "MeanSpO2"],
    "metabolic": ["Glucose", "FBG", "MeanGlucose", "BMR", "TDEE", "Calories", "Energy"],
    "weight": ["BodyWeight", "BMI", "BodyFat", "MuscleMass", "VisceralFat"],
}
# ----------------------------------------------------------------------------------------------


# --- lookups ----------------------------------------------------------------------------------

def all_readings(device: DataFrame, exams: DataFrame) -> DataFrame:
    """Bag union of device and exam readings with a `source` column."""
    return device.withColumn("source", F.lit("device")).unionByName(
        exams.withColumn("source", F.lit("exam")), allowMissingColumns=True)


def lookup_readings(device: DataFrame, exams: DataFrame, indicator: str, date: str = "", source: str = "auto",
                    names: Sequence[str] = ("indicator",)) -> DataFrame:
    """Readings whose name or key matches, on one day or on all."""
    frames = {"device": [device.withColumn("source", F.lit("device"))],
              "exam": [exams.withColumn("source", F.lit("exam"))]}
    frames["auto"] = frames["device"] + frames["exam"]
    hits = None
    for frame in frames[source]:
        matching = frame.where(tx.match_name(indicator, *[F.col(n) for n in names if n in frame.columns]))
        if date:
            matching = matching.where(F.col("day") == F.lit(date).cast("date"))
        hits = matching if hits is None else hits.unionByName(matching, allowMissingColumns=True)
    return hits


def page(df: DataFrame, order: Sequence[Column], offset: int, size: int) -> DataFrame:
    """One page with its totals. The rows pass through a bounded top-n; the total is a scalar subquery.

    Deep pages come from a `PageIndex`.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    slice_ = df.orderBy(*order).offset(offset).limit(size).withColumn("total", total)
    last = F.lit(offset) + F.least(F.lit(size), F.greatest(F.col("total") - offset, F.lit(0)))
    return slice_.withColumns({
        "has_more": last < F.col("total"), "next_offset": F.when(last < F.col("total"), last),
        "total_pages": F.ceil(F.col("total") / size)})


class PageIndex:
    """Rows of a table in order, in files of known sizes: any page is read from the files it lies in."""

    def __init__(self, df: DataFrame, order: Sequence[Column], folder: str):
        """Write `df` to `folder`, cut into ranges of its order; rows that tie in all of `order` may come in any order."""
        self.spark, self.folder, self.order = df.sparkSession, folder, list(order)
        rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
        numbered = rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
        numbered.write.partitionBy("_part").parquet(folder)
        self.schema = numbered.schema
        # One number for each range.
        counts = self._rows().groupBy("_part").count().orderBy("_part").collect()
        self.starts, self.total = {}, 0
        for r in counts:
            self.starts[r["_part"]] = (self.total, r["count"])
            self.total += r["count"]

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def parts(self, offset: int, size: int) -> list[int]:
        """The ranges that a page lies in."""
        return [p for p, (start, n) in self.starts.items() if start < offset + size and start + n > offset]

    def page(self, offset: int, size: int) -> DataFrame:
        """Like `page`, with the place of each row in `_row`."""
        rows, found = self._rows(), None
        for p in self.parts(offset, size):
            start = self.starts[p][0]
            part = rows.where((F.col("_part") == p) & F.col("_at").between(offset - start, offset + size - start - 1)).withColumn("_row", F.col("_at") + start)
            found = part if found is None else found.unionByName(part)
        found = rows.limit(0).withColumn("_row", F.col("_at")) if found is None else found
        last = min(offset + size, self.total)
        more = last < self.total
        return found.drop("_part", "_at").withColumns({
            "total": F.lit(self.total).cast("long"), "has_more": F.lit(more), "next_offset": F.lit(last if more else None).cast("long"),
            "total_pages": F.lit(-(-self.total // size)).cast("long")})


def page_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], offset: int, size: int) -> DataFrame:
    """The same page of every group."""
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    rows = top_k(df, keys, order, offset + size).where(F.col("rank") > offset)
    last = F.least(F.lit(offset + size), F.col("total"))
    return rows.join(totals, list(keys)).withColumns({
        "has_more": last < F.col("total"),
        "next_offset": F.when(last < F.col("total"), last),
        "total_pages": F.ceil(F.col("total") / size),
    })


def event_matches(name: str, medications: str | None = None) -> Column:
    """Name in the event name, the description or the medication records."""
    hit = tx.contains_ci(F.col("event_name"), name) | tx.contains_ci(F.col("description"), name)
    if medications:
        hit = hit | tx.contains_ci(F.to_json(medications), name)
    return hit


def lookup_events(events: DataFrame, name: str = "", date: str = "") -> DataFrame:
    """Events by name and by date text in start, time or end."""
    hits = events
    if name:
        hits = hits.where(event_matches(name, "medications" if "medications" in events.columns else None))
    if date:
        dated = [c for c in ("start_date", "time", "end_date") if c in events.columns]
        any_date = F.lit(False)
        for c in dated:
            any_date = any_date | tx.contains_ci(F.col(c).cast("string"), date)
        hits = hits.where(any_date)
    if "affected_indicators" in events.columns:
        hits = hits.withColumn("indicator_names", F.transform(
            "affected_indicators", lambda a: F.coalesce(a["indicator_name"], a["indicator_key"], F.lit("?"))))
    return hits


def latest_events(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest event per key; the higher id wins a tie. A plain aggregate, no sort."""
    newest = events.groupBy(*keys).agg(
        F.max_by(F.struct(*[c for c in events.columns if c not in keys]), F.struct("start_date", "event_id")).alias("_e"))
    return newest.select(*keys, "_e.*")


# --- intervals ---------------------------------------------------------------------------------

def with_end(events: DataFrame) -> DataFrame:
    return events.withColumn("end_date", event_end(F.col("start_date"), F.col("duration_days"), F.col("interruption_date")))


def _months(start: Column, end: Column) -> Column:
    first, last = F.trunc(start, "month"), F.trunc(end, "month")
    return F.explode(F.sequence(first, F.greatest(first, last), F.expr("INTERVAL 1 MONTH")))


def overlapping_events(targets: DataFrame, events: DataFrame, key: str = "user_id") -> DataFrame:
    """Other events of the same user that share a day with a target, one per (name, start).

    Both sides are spread over the months they touch. A pair meets in several months but is kept
    only in the month of the later start, so nothing has to be removed afterwards.
    """
    t = with_end(targets).select(
        key, F.col("event_id").alias("target_id"), F.col("event_name").alias("target_name"),
        F.col("start_date").alias("t_start"), F.col("end_date").alias("t_end"))
    t = t.where(F.col("t_start").isNotNull()).withColumn("_month", _months(F.col("t_start"), F.col("t_end")))
    e = with_end(events).where(F.col("start_date").isNotNull()).withColumn(
        "_month", _months(F.col("start_date"), F.col("end_date")))
    pairs = t.join(e, [key, "_month"]).where(
        (F.col("start_date") <= F.col("t_end")) & (F.col("end_date") >= F.col("t_start"))
        & (F.trunc(F.greatest("start_date", "t_start"), "month") == F.col("_month"))
        & ~((F.col("event_id") == F.col("target_id")) & (F.col("start_date") == F.col("t_start"))))
    return pairs.groupBy(key, "target_id", "target_name", "event_name", "start_date").agg(
        F.max_by(F.struct("event_id", "event_type"), "event_id").alias("_last")
    ).select(key, "target_id", "target_name", "event_name", "start_date", "_last.event_id", "_last.event_type")


def overlap_days(a: DataFrame, b: DataFrame, key: str = "user_id") -> DataFrame:
    """Shared days of two picked events per user, 0 when disjoint."""
    left = with_end(a).select(key, F.col("event_id").alias("id_a"), F.col("start_date").alias("s_a"), F.col("end_date").alias("e_a"))
    right = with_end(b).select(key, F.col("event_id").alias("id_b"), F.col("start_date").alias("s_b"), F.col("end_date").alias("e_b"))
    return left.join(right, key).select(key, "id_a", "id_b", shared_days(
        F.col("s_a"), F.col("e_a"), F.col("s_b"), F.col("e_b")).alias("overlap_days"))


# --- events and their indicators ------------------------------------------------------------------

def matched_terms(terms: Sequence[str], *names: Column) -> Column:
    flags = [F.when(tx.match_name(t, *names), F.lit(t)) for t in terms]
    return F.array_compact(F.array(*flags))


def events_by_indicators(links: DataFrame, terms: Sequence[str], mode: str = "all",
                         names: Sequence[str] = ("indicator_name",), key: str = "event_id") -> DataFrame:
    """Events linked to all (or any) of the terms, with the terms they match.

    At most one value per term survives in the aggregate, however many links an event has.
    """
    hits = links.withColumn("_term", F.explode(matched_terms(terms, *[F.col(n) for n in names]))).groupBy(key).agg(
        F.sort_array(F.collect_set("_term")).alias("matched_terms"))
    wanted = len(set(terms)) if mode == "all" else 1
    return hits.where(F.size("matched_terms") >= wanted)


def events_touching(events: DataFrame, links: DataFrame, term: str) -> DataFrame:
    """Events with at least one matching indicator."""
    return events.join(links.where(tx.match_name(term, F.col("indicator_name"))), "event_id", "left_semi")


def count_events_by_indicator(events: DataFrame, links: DataFrame, term: str, keys: Sequence[str]) -> DataFrame:
    identity = F.coalesce(F.col("event_id").cast("string"), F.concat_ws("|", "event_name", "start_date"))
    return events_touching(events, links, term).groupBy(*keys).agg(F.count_distinct(identity).alias("n_events"))


def preview_events_by_indicator(events: DataFrame, links: DataFrame, term: str, keys: Sequence[str], k: int) -> DataFrame:
    return top_k(events_touching(events, links, term), keys, [F.col("start_date"), F.col("event_name"), F.col("event_id")], k)


def events_by_medication(events: DataFrame, medications: DataFrame, name: str, keys: Sequence[str],
                         event_type: str = "health_event") -> DataFrame:
    """Exact name matches per key; only where there are none, the substring matches."""
    flags = medications.groupBy("event_id").agg(
        F.max(F.lower("medication") == F.lower(F.lit(name.strip()))).alias("_exact"),
        F.max(tx.contains_ci(F.col("medication"), name)).alias("_fuzzy"),
    ).where(F.col("_exact") | F.col("_fuzzy"))
    hits = events.where(F.col("event_type") == event_type).join(flags, "event_id")
    any_exact = hits.groupBy(*keys).agg(F.max("_exact").alias("_any"))
    return hits.join(any_exact, list(keys)).where(F.col("_exact") | ~F.col("_any")).select(
        *events.columns, F.when(F.col("_any"), F.lit("exact")).otherwise(F.lit("contains")).alias("match_type"))


def count_events_by_medication(events: DataFrame, medications: DataFrame, name: str, keys: Sequence[str],
                               event_type: str = "health_event") -> DataFrame:
    return events_by_medication(events, medications, name, keys, event_type).groupBy(*keys, "match_type").agg(
        F.count_distinct("event_id").alias("n_events"))


def count_event_indicators(events: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct indicators of each given event, 0 for events without any."""
    names = links.where(F.coalesce("indicator_name", F.lit("")) != "").groupBy("event_id").agg(
        F.sort_array(F.collect_set("indicator_name")).alias("indicator_names"))
    return events.join(names, "event_id", "left").withColumn(
        "indicator_count", F.coalesce(F.size("indicator_names"), F.lit(0)))


def names_on_date(readings: DataFrame, keys: Sequence[str] = ("user_id", "day"), name: str = "indicator",
                  group: str | None = None, value: str | None = None) -> DataFrame:
    """Distinct sorted names and their number; `value` set: only names with a reading count."""
    rows = readings.where(F.col(name).isNotNull() & (F.col(name) != ""))
    if value:
        rows = rows.where(F.col(value).isNotNull())
    keywords = INDICATOR_GROUPS.get(group or "", [])
    if keywords:
        rows = rows.where(tx.has_any(F.lower(name), [k.lower() for k in keywords]))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set(name)).alias("names")).withColumn("n_names", F.size("names"))


# --- windows over readings --------------------------------------------------------------------------

def window_join(windows: DataFrame, readings: DataFrame, keys: Sequence[str] = ("user_id", "indicator"),
                carry: Sequence[str] = ()) -> DataFrame:
    """Readings inside closed day windows: equi keys and month bucket, BETWEEN as the rest.

    `carry` names further columns of the readings to keep.
    """
    w = windows.withColumn("_month", _months(F.col("start_date"), F.col("end_date")))
    r = readings.where(F.col("value_num").isNotNull()).withColumn("_month", F.trunc("day", "month"))
    return w.join(r.select(*keys, "_month", "day", "value_num", *carry), [*keys, "_month"]).where(
        F.col("day").between(F.col("start_date"), F.col("end_date"))).drop("_month")


def days_of(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, day) of all days that lie in a window."""
    return windows.select(*keys, F.explode(F.when(F.col("start_date") <= F.col("end_date"), F.sequence("start_date", "end_date"))).alias("day")).distinct()


def range_stats(windows: DataFrame, readings: DataFrame, keys: Sequence[str] = ("user_id", "indicator"), median: bool | Column = True,
                vary: Callable[[DataFrame], DataFrame] | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Statistics of the distinct windows that hold a reading, rounded to four digits.

    All but the median come from partials over 2**k days (see `dyadic`). The median needs the values: those of the
    windows for which `median` holds are joined day by day. `vary` makes several versions of the readings inside
    the windows, told apart by the columns `extra`: a window then has a row for each.
    """
    base = [*keys, "start_date", "end_date"]
    span = [*extra, *base]
    rows = readings.where(F.col("value_num").isNotNull())
    if vary is None:
        rows = rows.join(windows.select(*keys).distinct().hint("merge"), list(keys), "left_semi")
    else:
        # Versions are made of what a window holds, not of all.
        rows = vary(rows.join(days_of(windows.select(*base).distinct(), keys).hint("merge"), [*keys, "day"], "left_semi")).where(F.col("value_num").isNotNull())
    rows = rows.select(*extra, *keys, "day", "value_num")
    totals = window_totals(windows, day_partials(rows, [*extra, *keys], home=keys), keys, extra)
    mean = F.col("total") / F.col("n")
    stats = totals.select(
        *span, F.col("n").alias("n_points"), mean.alias("raw_mean"), settled(mean).alias("mean"), F.round("most", 4).alias("max"), F.round("least", 4).alias("min"),
        settled(F.coalesce(F.sqrt("variance"), F.lit(0.0))).alias("stddev"), settled(F.col("most") - F.col("least")).alias("range"),
        F.col("peak_day").alias("argmax_date"))
    if median is not False:
        asked = windows if median is True else windows.where(median)
        each = asked.select(*base).distinct().select(*base, F.explode(F.when(F.col("start_date") <= F.col("end_date"), F.sequence("start_date", "end_date"))).alias("day"))
        mid = exact_median(each.hint("merge").join(rows, [*keys, "day"]).select(*span, "value_num"), span, "value_num", many=True)
        stats = stats.join(mid.select(*span, settled(F.col("median")).alias("median")).hint("merge"), span, "left")
    return stats


def window_stats(windows: DataFrame, readings: DataFrame, keys: Sequence[str] = ("user_id", "indicator"),
                 by: Sequence[str] | None = None, median: bool | Column = True) -> DataFrame:
    """Every window with its statistics (see `range_stats`); `unanswerable` without readings."""
    # Queries often ask for the same range: every range is answered once.
    base = [*keys, "start_date", "end_date"]
    stats = range_stats(windows, readings, keys, median)
    asked = windows.select(*dict.fromkeys([*(by or base), *base]))
    return asked.join(stats.hint("merge"), base, "left").withColumns({
        "n_points": F.coalesce("n_points", F.lit(0)), "unanswerable": F.col("mean").isNull()})


def two_window_delta(pairs: DataFrame, readings: DataFrame, by: Sequence[str],
                     keys: Sequence[str] = ("user_id", "indicator")) -> DataFrame:
    """mean(second) - mean(first) per pair; NULL when either window is empty."""
    phases = _phase_means(pairs, readings, by, keys, ("w1", "w2"))
    return phases.withColumn("delta", settled(F.col("mean_w2") - F.col("mean_w1"))).drop("mean_w1", "mean_w2")


def three_phase_means(triples: DataFrame, readings: DataFrame, by: Sequence[str],
                      keys: Sequence[str] = ("user_id", "indicator")) -> DataFrame:
    """Means before, during and after; NULL if any phase is empty."""
    names = ("pre", "during", "post")
    phases = _phase_means(triples, readings, by, keys, names)
    complete = F.lit(True)
    for n in names:
        complete = complete & F.col(f"mean_{n}").isNotNull()
    return phases.select(*by, F.when(complete, F.array(*[settled(F.col(f"mean_{n}")) for n in names])).alias("means"))


def _phase_means(df: DataFrame, readings: DataFrame, by: Sequence[str], keys: Sequence[str],
                 names: Sequence[str]) -> DataFrame:
    """Columns {name}_start / {name}_end to mean_{name}, n_{name}: one join for all phases."""
    phases = F.explode(F.array(*[
        F.struct(F.lit(n).alias("phase"), F.col(f"{n}_start").alias("start_date"), F.col(f"{n}_end").alias("end_date"))
        for n in names]))
    cols = list(dict.fromkeys([*by, *keys]))
    long = df.select(*cols, phases.alias("_p")).select(*cols, "_p.*")
    rows = readings.where(F.col("value_num").isNotNull()).join(long.select(*keys).distinct(), list(keys), "left_semi")
    totals = window_totals(long, day_partials(rows.select(*keys, "day", "value_num"), keys), keys).select(*keys, "start_date", "end_date", "n", (F.col("total") / F.col("n")).alias("mean"))
    met = long.join(totals, [*keys, "start_date", "end_date"])
    means = met.groupBy(*by).agg(*[
        agg for n in names for agg in (
            F.max(F.when(F.col("phase") == n, F.col("mean"))).alias(f"mean_{n}"),
            F.max(F.when(F.col("phase") == n, F.col("n"))).alias(f"n_{n}"))])
    return df.select(*by).join(means, list(by), "left").withColumns(
        {f"n_{n}": F.coalesce(f"n_{n}", F.lit(0)) for n in names})


def value_at(lookups: DataFrame, readings: DataFrame, order: str = "time",
             keys: Sequence[str] = ("user_id", "day", "indicator")) -> DataFrame:
    """The last reading per lookup; tells a missing day from a missing indicator."""
    wanted = lookups.select(*keys).distinct()
    values = readings.join(wanted, list(keys), "left_semi").groupBy(*keys).agg(
        F.round(F.max_by("value_num", F.struct(order, "value_num")), 4).alias("value"))
    day_keys = [k for k in keys if k != "indicator"]
    days = readings.join(wanted.select(*day_keys).distinct(), day_keys, "left_semi").select(
        *day_keys, F.lit(True).alias("_day")).distinct()
    return lookups.join(values, list(keys), "left").join(days, day_keys, "left").withColumn(
        "reason", F.when(F.col("value").isNotNull(), F.lit(None)).when(F.col("_day").isNull(), F.lit("day missing"))
        .otherwise(F.lit("indicator missing"))).drop("_day")


# --- weekly summaries ----------------------------------------------------------------------------------

def _halves(readings: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, cell: Column | None, *aggregates: Column) -> DataFrame:
    """Trend of each group, and further aggregates from the same pass."""
    cell = F.date_trunc("hour", F.col(order[0])) if cell is None else cell
    rows = ranked(readings.where(F.col(value).isNotNull()), keys, [F.col(c) for c in order], cell, "_rank", "_size")
    mid = F.floor(F.col("_size") / 2)
    halves = rows.groupBy(*keys).agg(
        F.max("_size").alias("n"),
        F.avg(F.when(F.col("_rank") <= mid, F.col(value))).alias("_first"),
        F.avg(F.when(F.col("_rank") > mid, F.col(value))).alias("_second"),
        *aggregates,
    )
    ratio = (F.col("_second") - F.col("_first")) / (F.abs("_first") + 1e-9)
    trend = (
        F.when(F.col("n") < 4, F.lit("stable")).when(ratio > 0.1, F.lit("rising"))
        .when(ratio < -0.1, F.lit("falling")).otherwise(F.lit("stable")))
    return halves.withColumn("trend", trend).drop("_first", "_second")


def half_trend(readings: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value_num",
               cell: Column | None = None) -> DataFrame:
    """rising / falling / stable: mean of the later half against the earlier half, from 4 values on.

    Rows are ordered by `order`; `cell` splits long groups (default: the hour of the first order column).
    """
    return _halves(readings, keys, order, value, cell)


def weekly_summary(readings: DataFrame, order: Sequence[str] = ("time", "value_num")) -> DataFrame:
    """Mean, minimum, maximum, trend and anomaly flag (peak over 1.5 times the mean, 3 values or more) per week."""
    v = F.col("value_num")
    weeks = _halves(readings.withColumn("week", week_key(F.col("day"))), ["user_id", "week", "indicator"], order, "value_num", None,
                    F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    return weeks.withColumn("anomaly", (F.col("max") > F.col("mean") * 1.5) & (F.col("n") >= 3))


def event_batches(events: DataFrame, size: int = 10, key: str = "user_id") -> DataFrame:
    """Events of a user in order, numbered in consecutive batches of `size`."""
    order = [F.col("start_date"), F.col("event_id")]
    rows = ranked(events, [key], order, F.trunc("start_date", "month"), "position")
    return rows.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("int"))
