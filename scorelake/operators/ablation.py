"""Seeded deletion and noise on readings, and the ground truth recomputed from what is left.

All users and all variants run in one job: the variant is a column of the readings, and every
query kind is served by the same range join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.functions.numbers import hash_normal, hash_uniform, settled
from scorelake.operators.readings import INDICATOR_GROUPS, range_stats

# --- fixed values: variant name, kind, parameter ------------------------------------------------
VARIANTS = [
    ("del10pct", "delete", 0.10),
    ("del20pct", "delete", 0.20),
    ("del30pct", "delete", 0.30),
    ("noise10pct", "noise", 0.10),
    ("noise20pct", "noise", 0.20),
]
# -------------------------------------------------------------------------------------------------


def day_ranks(readings: DataFrame, seed: int, user: str = "user_id", day: str = "day") -> DataFrame:
    """Distinct days of a user in a seeded random order, with their number."""
    days = readings.select(user, day).distinct()
    order = W.partitionBy(user).orderBy(hash_uniform(F.col(user), F.col(day), F.lit(seed)), day)
    return days.select(user, day, F.row_number().over(order).alias("_day_rank"),
                       F.count(F.lit(1)).over(W.partitionBy(user)).alias("_n_days"))


def perturb_delete(readings: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Remove exactly floor(days x ratio) days per user."""
    ranks = day_ranks(readings, seed).where(F.col("_day_rank") > F.floor(F.col("_n_days") * ratio))
    return readings.join(ranks.select("user_id", "day"), ["user_id", "day"], "left_semi")


def noisy(value: Column, sigma: Column, *key: Column) -> Column:
    """v x (1 + N(0, sigma)) to four digits; zero and NULL stay."""
    return F.when(value.isNull() | (value == 0), value).otherwise(settled(value * (1 + sigma * hash_normal(*key))))


def perturb_noise(readings: DataFrame, sigma: float, seed: int, key: str = "reading_id") -> DataFrame:
    return readings.withColumn("value_num", noisy(F.col("value_num"), F.lit(sigma), F.col(key), F.lit(seed)))


def variants_of(ranked_days: DataFrame, seed: int, variants: Sequence[tuple[str, str, float]] = VARIANTS, key: str = "reading_id") -> DataFrame:
    """Rows of every variant, with a `variant` column, from rows that carry their key and the rank of their day."""
    choices = F.explode(F.array(*[
        F.struct(F.lit(n).alias("variant"), F.lit(k).alias("_kind"), F.lit(p).alias("_param")) for n, k, p in variants]))
    every = ranked_days.withColumn("_v", choices).select(*ranked_days.columns, "_v.*")
    kept = every.where((F.col("_kind") != "delete") | (F.col("_day_rank") > F.floor(F.col("_n_days") * F.col("_param"))))
    value = F.when(F.col("_kind") == "noise", noisy(F.col("value_num"), F.col("_param"), F.col(key), F.lit(seed))).otherwise(F.col("value_num"))
    return kept.withColumn("value_num", value).drop("_kind", "_param", "_day_rank", "_n_days")


def perturb_all(readings: DataFrame, seed: int, variants: Sequence[tuple[str, str, float]] = VARIANTS,
                key: str = "reading_id") -> DataFrame:
    """Readings of every variant, with a `variant` column: one pass, one join to the day order."""
    return variants_of(readings.join(day_ranks(readings, seed), ["user_id", "day"]), seed, variants, key)


# --- recomputation ---------------------------------------------------------------------------------

_RECOMPUTE: dict[str, Callable[[Callable[[str], Column]], dict[str, Column]]] = {}
_WITHOUT_MEDIAN: set[str] = set()


def recompute(kind: str, median: bool = True):
    """Register how a query kind reads its answer from the statistics of its ranges.

    The function gets `stats(role)`, a struct column with n_points, mean, max, min, median, stddev,
    range and argmax_date (NULL if the range is empty), and returns the answer columns. `median` says whether
    it reads the median, which costs a join with the values; else it is NULL.
    """
    def register(fn):
        _RECOMPUTE[kind] = fn
        (_WITHOUT_MEDIAN.discard if median else _WITHOUT_MEDIAN.add)(kind)
        return fn
    return register


def recompute_kinds() -> list[str]:
    return sorted([*_RECOMPUTE, "device", "device_day_to_indicators"])


def _single(field: str, target: str = "expected_num"):
    return lambda stats: {target: stats("range")[field], "n_points": stats("range")["n_points"]}


for _kind, _field in [("device_timeseries", "mean"), ("event_window_peak_value", "max"), ("event_window_min_value", "min"),
                      ("event_window_median_value", "median"), ("event_window_stddev_value", "stddev"),
                      ("event_window_range", "range")]:
    recompute(_kind, _field == "median")(_single(_field))
for _kind in ("event_window_peak_date", "peak_date"):
    recompute(_kind, False)(_single("argmax_date", "expected_date"))


@recompute("two_window_delta", False)
def _delta(stats):
    return {"expected_num": settled(stats("window2")["raw_mean"] - stats("window1")["raw_mean"])}


@recompute("three_phase_means", False)
def _phases(stats):
    means = [stats(p)["mean"] for p in ("pre", "during", "post")]
    complete = means[0].isNotNull() & means[1].isNotNull() & means[2].isNotNull()
    return {"expected_nums": F.when(complete, F.array(*means))}


_ANSWER_TYPES = {"expected_num": "double", "expected_date": "date", "expected_nums": "array<double>", "n_points": "bigint"}


_STATS = ["n_points", "mean", "raw_mean", "max", "min", "median", "stddev", "range", "argmax_date"]
_VERSION = "variant"


def recompute_truth(queries: DataFrame, readings: DataFrame, versions: Sequence[str] = (), vary: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Answers of (query_id, user_id, kind, indicator, day, group_filter, ranges) against the readings.

    `ranges` is an array of (role, start_date, end_date). `vary` makes the versions of the readings, told apart by their
    column `variant`; every query is then answered for each of `versions`. Kinds without a recomputation are left out.
    """
    extra = [_VERSION] if versions else []
    asked = queries.where(F.col("kind").isin(list(_RECOMPUTE)))
    with_median = ~F.col("kind").isin(sorted(_WITHOUT_MEDIAN))
    base = ["user_id", "indicator", "start_date", "end_date"]
    # Queries often ask for the same range: it is answered once, for all versions.
    spans = asked.select("user_id", "indicator", with_median.alias("_median"), F.explode("ranges").alias("_r")).groupBy(
        "user_id", "indicator", F.col("_r.start_date").alias("start_date"), F.col("_r.end_date").alias("end_date")).agg(F.max("_median").alias("_median"))
    stats = range_stats(spans, readings, ["user_id", "indicator"], F.col("_median"), vary, extra).where(F.col("mean").isNotNull())
    # A range has one row with its statistics by version, so queries are multiplied after they have met it, and not sent again.
    version = F.col(_VERSION) if versions else F.lit("")
    by_span = stats.groupBy(*base).agg(F.map_from_entries(F.collect_list(F.struct(version, F.struct(*_STATS)))).alias("_by"))
    one = F.size("ranges") == 1
    cols = ["query_id", "user_id", "indicator", "kind"]
    single = asked.where(one).select(*cols, F.col("ranges")[0].alias("_r")).select(*cols, "_r.*").join(by_span.hint("merge"), base, "left").select(
        "query_id", "kind", F.when(F.col("_by").isNotNull(), F.array(F.struct("role", "_by"))).alias("_roles"))
    several = asked.where(F.coalesce(~one, F.lit(True)))
    parts = several.select("query_id", "user_id", "indicator", F.explode("ranges").alias("_r")).select("query_id", "user_id", "indicator", "_r.*")
    per_query = parts.join(by_span.hint("merge"), base).groupBy("query_id").agg(F.collect_list(F.struct("role", "_by")).alias("_roles"))
    found = single.unionByName(several.select("query_id", "kind").join(per_query.hint("merge"), "query_id", "left"))
    answered = found.withColumn("_version", F.explode(F.array(*[F.lit(v) for v in versions or [""]])))

    def role(name: str) -> Column:
        return F.try_element_at("_stats", F.lit(name))
    of_version = F.filter(F.transform("_roles", lambda r: F.struct(r["role"].alias("role"), F.try_element_at(r["_by"], F.col("_version")).alias("s"))),
                          lambda r: r["s"].isNotNull())
    answered = answered.select(*([F.col("_version").alias(_VERSION)] if versions else []), "query_id", "kind", F.map_from_entries(of_version).alias("_stats"))

    columns = {}
    for out, typ in _ANSWER_TYPES.items():
        value = F.lit(None).cast(typ)
        for kind, fn in _RECOMPUTE.items():
            answer = fn(role)
            if out in answer:
                value = F.when(F.col("kind") == kind, answer[out].cast(typ)).otherwise(value)
        columns[out] = value
    ranged = answered.select(*extra, "query_id", "kind", *[c.alias(n) for n, c in columns.items()])
    ranged = ranged.withColumn("unanswerable", F.col("expected_num").isNull() & F.col("expected_date").isNull()
                               & F.col("expected_nums").isNull())
    single_range = ~F.col("kind").isin("two_window_delta", "three_phase_means")
    ranged = ranged.withColumns({
        "n_points": F.when(single_range, F.coalesce("n_points", F.lit(0))),
        "reason": F.when(F.col("unanswerable"), F.lit("no data in range"))})
    return ranged.unionByName(_on_days(queries, readings, versions, vary), allowMissingColumns=True)


def _on_days(queries: DataFrame, readings: DataFrame, versions: Sequence[str], vary: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Single values and name lists of one day: one aggregate per (user, day, indicator) that is asked for."""
    extra = [_VERSION] if versions else []
    wanted = queries.where(F.col("kind").isin("device", "device_day_to_indicators"))
    days = [*extra, "user_id", "day"]
    near = readings.join(wanted.select("user_id", "day").distinct().hint("merge"), ["user_id", "day"], "left_semi")
    near = near if vary is None else vary(near)
    per_name = near.groupBy(*days, "indicator").agg(
        F.max_by("value_num", F.struct("time", "value_num")).alias("_value"), F.count("value_num").alias("_n"))
    per_day = per_name.groupBy(*days).agg(F.sort_array(F.collect_set(F.when(F.col("_n") > 0, F.col("indicator")))).alias("_names"))
    if versions:
        wanted = wanted.withColumn(_VERSION, F.explode(F.array(*[F.lit(v) for v in versions])))
    out = wanted.join(per_day.hint("merge"), days, "left").join(per_name.select(*days, "indicator", "_value").hint("merge"), [*days, "indicator"], "left")
    groups = F.create_map(*[x for g, words in INDICATOR_GROUPS.items() for x in (
        F.lit(g), F.array(*[F.lit(w.lower()) for w in words]))])
    keywords = F.try_element_at(groups, F.coalesce("group_filter", F.lit("")))
    names = F.when(keywords.isNull(), F.col("_names")).otherwise(F.filter(
        "_names", lambda n: F.exists(keywords, lambda k: F.contains(F.lower(n), k))))
    listing = F.col("kind") == "device_day_to_indicators"
    missing_day = F.col("_names").isNull()
    return out.select(
        *extra, "query_id", "kind", F.when(~listing, settled(F.col("_value"))).alias("expected_num"),
        F.when(listing, F.coalesce(names, F.array().cast("array<string>"))).alias("expected_names"),
        (missing_day | (~listing & F.col("_value").isNull())).alias("unanswerable"),
        F.when(missing_day, F.lit("day missing")).when(~listing & F.col("_value").isNull(), F.lit("indicator missing")).alias("reason"))


# --- patches --------------------------------------------------------------------------------------------

def expected_text(df: DataFrame) -> Column:
    """The recomputed answer as text, whatever its type."""
    return F.coalesce(
        F.col("expected_num").cast("string"), F.col("expected_date").cast("string"),
        F.to_json("expected_nums"), F.array_join("expected_names", ";"))


def apply_patches(cases: DataFrame, patches: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Cases with the recomputed value, the unanswerable mark and the first n_points key point refreshed."""
    p = patches.select(*keys, F.col("expected_value").alias("_value"), F.col("n_points").alias("_n"),
                       F.col("unanswerable").alias("_un"), F.col("reason").alias("_why"), F.lit(True).alias("patched"))
    out = cases.join(p.hint("merge"), list(keys), "left")
    counted = F.transform("key_points", lambda k: F.contains(k, F.lit("n_points")) | F.contains(k, F.lit("数据点")))
    first = F.array_position(counted, True)
    refreshed = F.when(F.col("_n").isNotNull() & (first > 0), F.transform("key_points", lambda k, i: F.when(
        i == first - 1, F.concat(F.lit("n_points: "), F.col("_n").cast("string"))).otherwise(k))).otherwise(F.col("key_points"))
    return out.withColumns({
        "expected_value": F.when(F.col("patched"), F.col("_value")).otherwise(F.col("expected_value")),
        "key_points": refreshed,
        "unanswerable": F.coalesce("_un", F.lit(False)),
        "unanswerable_reason": F.when(F.col("_un"), F.coalesce("_why", F.lit("data missing"))),
        "patched": F.coalesce("patched", F.lit(False)),
    }).drop("_value", "_n", "_un", "_why")


def perturb_stats(patched: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return patched.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("patched").alias("n_patched"),
        F.count_if("unanswerable").alias("n_unanswerable"), F.count_if(~F.col("patched")).alias("n_unchanged"))


def ablation_truth(queries: DataFrame, readings: DataFrame, seed: int, variants: Sequence[tuple[str, str, float]] = VARIANTS) -> DataFrame:
    """Recomputed answers of every query under every variant. Variants are made of the readings that a query asks for, not of all."""
    ranks = day_ranks(readings, seed)
    return recompute_truth(queries, readings, [n for n, _, _ in variants],
                           lambda rows: variants_of(rows.join(ranks.hint("merge"), ["user_id", "day"]), seed, variants))


def truth_stats(truth: DataFrame, cases: DataFrame) -> DataFrame:
    """`perturb_stats` of each variant from the truth alone: no case is patched to be counted."""
    total = cases.agg(F.count(F.lit(1))).scalar()
    counts = truth.join(cases.select(F.col("id").alias("query_id")).hint("merge"), "query_id", "left_semi").groupBy("variant").agg(
        F.count(F.lit(1)).alias("n_patched"), F.count_if("unanswerable").alias("n_unanswerable"))
    return counts.select("variant", total.alias("total"), "n_patched", "n_unanswerable", (total - F.col("n_patched")).alias("n_unchanged"))


def ablate(cases: DataFrame, queries: DataFrame, readings: DataFrame, seed: int,
           variants: Sequence[tuple[str, str, float]] = VARIANTS) -> DataFrame:
    """Every case under every variant, with recomputed expectations. Case ids are query ids."""
    truth = ablation_truth(queries, readings, seed, variants)
    patches = truth.withColumnRenamed("query_id", "id").withColumn("expected_value", expected_text(truth))
    return apply_patches(cases.withColumn("variant", F.explode(F.array(*[F.lit(n) for n, _, _ in variants]))), patches, ["variant", "id"])
