"""Report roll-ups: pass rates, tag statistics, A/B tables, deltas, cost and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.functions.numbers import settled
from scorelake.functions.text import tag_value
from scorelake.operators.ranking import top_k


# --- joins over ids ---------------------------------------------------------------------------

def attach_answers(submissions: DataFrame, cases: DataFrame) -> DataFrame:
    return submissions.join(cases, "id")


def check_submission(submissions: DataFrame, cases: DataFrame) -> DataFrame:
    """Counts of matched, extra and missed ids. One full join over distinct ids."""
    s = submissions.select("id").distinct().withColumn("_s", F.lit(True))
    c = cases.select("id").distinct().withColumn("_c", F.lit(True))
    return s.join(c, "id", "full").agg(
        F.count_if(F.col("_s") & F.col("_c")).alias("matched"),
        F.count_if(F.col("_s") & F.col("_c").isNull()).alias("extra"),
        F.count_if(F.col("_s").isNull() & F.col("_c")).alias("missed"),
    )


def unmatched_ids(left: DataFrame, right: DataFrame, k: int | None = None) -> DataFrame:
    """The ids of `left` that `right` lacks, in order; the first k if k is given."""
    ids = left.select("id").distinct().join(right, "id", "left_anti").orderBy("id")
    return ids if k is None else ids.limit(k)


def matched_tags(submissions: DataFrame, cases: DataFrame) -> DataFrame:
    return tag_distribution(cases.join(submissions, "id", "left_semi"))


def complete_with_zero(results: DataFrame, cases: DataFrame) -> DataFrame:
    """All cases; those without a result fail with 0."""
    return cases.join(results, "id", "left").withColumns({
        "result": F.coalesce("result", F.lit("fail")), "score": F.coalesce("score", F.lit(0.0))})


def remaining_cases(cases: DataFrame, log: DataFrame) -> DataFrame:
    """Cases without a finished result; cancelled ones run again."""
    return cases.join(log.where(F.col("status") != "cancelled"), "id", "left_anti")


def merge_results(finished: DataFrame, fresh: DataFrame, cases: DataFrame) -> DataFrame:
    """Finished and new results with the position of their case."""
    return finished.unionByName(fresh).join(cases.select("id", "ord"), "id")


# --- summaries ------------------------------------------------------------------------------------

def pass_rate(passed: Column, failed: Column) -> Column:
    return F.when(passed + failed > 0, passed / (passed + failed)).otherwise(F.lit(0.0))


def _measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("result") == "pass").alias("pass_count"),
        F.count_if(F.col("result") == "fail").alias("fail_count"),
        F.round(pass_rate(F.count_if(F.col("result") == "pass").cast("double"),
                          F.count_if(F.col("result") == "fail").cast("double")), 6).alias("pass_rate"),
        settled(F.avg("score"), 6).alias("avg_score"),
    ]


def seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def run_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pass rate over pass and fail only, average score over all rows, summed durations."""
    return results.groupBy(*by).agg(
        *_measures(), F.sum(seconds(F.col("start_ts"), F.col("end_ts"))).alias("total_seconds"))


def stats_by_tag(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same per tag; a tag repeated in a case counts each time."""
    return results.withColumn("tag", F.explode("tags")).groupBy(*by, "tag").agg(*_measures())


def tag_distribution(cases: DataFrame) -> DataFrame:
    return cases.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "tag")


def tag_categories(cases: DataFrame) -> DataFrame:
    """`category:value` tags as categories with more than one value."""
    pairs = cases.select(F.explode("tags").alias("tag")).where(F.locate(":", F.col("tag")) > 1).select(
        F.substring_index("tag", ":", 1).alias("category"),
        F.expr("substring(tag, locate(':', tag) + 1)").alias("value")).distinct()
    return pairs.groupBy("category").agg(F.sort_array(F.collect_set("value")).alias("vals")).where(F.size("vals") > 1)


def filter_results(results: DataFrame, status: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
    if status:
        results = results.where(F.col("result") == status)
    for t in tags:
        results = results.where(F.array_contains("tags", t))
    return results


def ab_rates(results: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Pass share per opening and per opening x persona level; all cases are in the denominator."""
    opening = tag_value(F.col("tags"), "opening")
    levels = F.explode(F.array(
        F.struct(F.lit(None).cast("string").alias("dim"), F.lit(None).cast("string").alias("level")),
        *[F.struct(F.lit(d).alias("dim"), tag_value(F.col("tags"), d).alias("level")) for d in dimensions]))
    long = results.select(opening.alias("opening"), "result", levels.alias("_l")).select("opening", "result", "_l.*")
    return long.where(F.col("dim").isNull() | F.col("level").isNotNull()).groupBy("opening", "dim", "level").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("result") == "pass").alias("passed"),
    ).withColumn("rate", F.round(F.col("passed") / F.col("total"), 6))


# --- comparisons -------------------------------------------------------------------------------------

def old_new(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Pairs of scores and their difference to four digits."""
    o = old.withColumnRenamed("score", "old_score")
    n = new.select(*keys, F.col("score").alias("new_score"))
    return o.join(n, list(keys)).withColumn("delta", settled(F.col("new_score") - F.col("old_score")))


def reeval_summary(pairs: DataFrame, changed_only: bool = False) -> DataFrame:
    """Overall, per answer type and per difficulty; `changed_only` narrows the overall averages alone."""
    changed = F.abs("delta") > 0.001
    groups = F.explode(F.array(
        F.struct(F.lit("all").alias("scope"), F.lit("all").alias("bucket")),
        F.struct(F.lit("answer_type").alias("scope"), F.col("answer_type").alias("bucket")),
        F.struct(F.lit("difficulty").alias("scope"), F.col("difficulty").alias("bucket"))))
    long = pairs.select("old_score", "new_score", "delta", groups.alias("_g")).select("*", "_g.*").drop("_g")
    counted = (F.col("scope") != "all") | changed if changed_only else F.lit(True)
    def mean(c: str) -> Column:
        return F.avg(F.when(counted, F.col(c)))
    return long.groupBy("scope", "bucket").agg(
        F.count_if(counted).alias("n"), F.count_if(changed).alias("n_changed"),
        settled(mean("old_score")).alias("old_avg"), settled(mean("new_score")).alias("new_avg"),
        settled(mean("delta")).alias("avg_delta"))


def top_changes(pairs: DataFrame, k: int, tie: Sequence[str] = ("id",)) -> DataFrame:
    return pairs.where(F.abs("delta") > 0.001).orderBy(F.desc(F.abs("delta")), *tie).limit(k)


def failures(results: DataFrame, k: int, order: Sequence[str] = ("id",), chars: int | None = None) -> DataFrame:
    """The first k failures; `chars` cuts their feedback."""
    rows = results.where(F.col("result") == "fail").orderBy(*order).limit(k)
    return rows if chars is None else rows.withColumn("feedback", F.substring("feedback", 1, chars))


def leaderboard(results: DataFrame, system: str = "system_id") -> DataFrame:
    """Average score, total time and rank per system."""
    per = results.groupBy(system).agg(
        F.count(F.lit(1)).alias("n_cases"), settled(F.avg("score"), 6).alias("avg_score"),
        F.sum(seconds(F.col("start_ts"), F.col("end_ts"))).alias("total_seconds"))
    return rank_systems(per)


def rank_systems(per_system: DataFrame, score: str = "avg_score") -> DataFrame:
    """Ranks over the given rows in one partition: a table of systems has a row for each, not for each result."""
    w = W.partitionBy(F.lit(0)).orderBy(F.desc(score))
    return per_system.withColumns({"rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w)})


def score_matrix(results: DataFrame, row: str, column: str, values: Sequence, low: float = 0.7) -> DataFrame:
    """Average score per row and column value; given values spare the pivot a pass over the data."""
    m = results.groupBy(row).pivot(column, list(values)).agg(settled(F.avg("score"), 6))
    m = m.withColumnsRenamed({str(v): f"s_{v}" for v in values})
    weakest = F.least(*[F.col(f"s_{v}") for v in values]) if len(values) > 1 else F.col(f"s_{values[0]}")
    return m.withColumn("any_low", weakest < low)


def latest_run(runs: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(runs, keys, order, 1).drop("rank")


def wall_span(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return results.groupBy(*by).agg(seconds(F.min("start_ts"), F.max("end_ts")).alias("wall_seconds"))


def progress(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases per status (NULL: still open) and the mean score so far."""
    done = results.select("id", "result", "score")
    return cases.select("id").join(done, "id", "left").groupBy("result").agg(
        F.count(F.lit(1)).alias("n"), settled(F.avg("score"), 6).alias("avg_score"))


def completeness(documents: DataFrame, required: Sequence[str], user: str = "user_id", kind: str = "kind") -> DataFrame:
    """Users with the required kinds they lack; one aggregate, no product of users and kinds."""
    have = documents.groupBy(user).agg(F.collect_set(F.when(F.col(kind).isin(list(required)), F.col(kind))).alias("_have"))
    wanted = F.array(*[F.lit(r) for r in required])
    return have.select(user, F.sort_array(F.array_except(wanted, "_have")).alias("missing")).withColumn(
        "complete", F.size("missing") == 0)


def dataset_complete(per_user: DataFrame) -> DataFrame:
    """Complete only with at least one user and nothing missing."""
    return per_user.agg(
        F.count(F.lit(1)).alias("n_users"), F.count_if(~F.col("complete")).alias("n_incomplete"),
        F.coalesce(F.every("complete"), F.lit(False)).alias("complete"))


# --- cost ------------------------------------------------------------------------------------------------

# --- fixed values: default price in USD per million tokens, overhead and pace of an estimate
DEFAULT_PRICE = {"input": 2.00, "cached_input": 0.50, "output": 8.00}
DEFAULT_EVAL_OVERHEAD = 0.010
SECONDS_PER_CASE = 12
DEFAULT_CONCURRENCY = 5
# --------------------------------------------------------------------------------------------


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Unit prices per usage row: the model's, else the defaults; cached input falls back to input."""
    p = prices.select("model", F.col("input").alias("_in"), F.col("cached_input").alias("_cached"), F.col("output").alias("_out"))
    known = F.col("_in").isNotNull()
    return usage.join(p, "model", "left").withColumns({
        "price_in": F.coalesce("_in", F.lit(DEFAULT_PRICE["input"])),
        "price_cached": F.when(known, F.coalesce("_cached", "_in")).otherwise(F.lit(DEFAULT_PRICE["cached_input"])),
        "price_out": F.coalesce("_out", F.lit(DEFAULT_PRICE["output"])),
    }).drop("_in", "_cached", "_out")


def token_totals(usage: DataFrame, by: Sequence[str]) -> DataFrame:
    """Summed tokens; `cached_tokens` is the part of the input that was read from a cache."""
    return usage.groupBy(*by).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum(F.coalesce("cached_tokens", F.lit(0))).alias("cached_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


def usage_by_model(usage: DataFrame) -> DataFrame:
    return token_totals(usage, ["model"])


def priced_tokens() -> Column:
    """USD of a priced usage row: cached input at its own price, the rest of the input at the full one."""
    cached = F.least(F.coalesce("cached_tokens", F.lit(0)), F.col("input_tokens"))
    fresh = F.col("input_tokens") - cached
    return (fresh * F.col("price_in") + cached * F.col("price_cached") + F.col("output_tokens") * F.col("price_out")) / 1_000_000


def cost_rollup(usage: DataFrame, prices: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """Tokens and cost per role. Tokens are summed per (role, model) before prices are looked up.

    `reported` (role, total_cost) replaces the computed cost where it is known.
    """
    priced = price_usage(token_totals(usage, ["role", "model"]), prices)
    per_role = priced.groupBy("role").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("cached_tokens").alias("cached_tokens"), F.sum("output_tokens").alias("output_tokens"),
        settled(F.sum(priced_tokens())).alias("cost"))
    if reported is None:
        return per_role
    return per_role.join(reported, "role", "left").withColumn("cost", F.coalesce("total_cost", "cost")).drop("total_cost")


def estimate_cost(cases: DataFrame, spec: DataFrame, prices: DataFrame) -> DataFrame:
    """Expected cost and time of a run per target: spec has target, model, tokens per case (input, cached, output), concurrency."""
    n = cases.groupBy("target").agg(F.count(F.lit(1)).alias("n_cases"))
    priced = price_usage(spec, prices)
    per_case = priced_tokens() + F.coalesce("eval_overhead", F.lit(DEFAULT_EVAL_OVERHEAD))
    pace = F.ceil(F.col("n_cases") * SECONDS_PER_CASE / F.coalesce(F.nullif("concurrency", F.lit(0)), F.lit(DEFAULT_CONCURRENCY)))
    return n.join(priced, "target").select(
        "target", "n_cases", settled(F.col("n_cases") * per_case).alias("cost"), pace.alias("seconds"))


# --- files and names -----------------------------------------------------------------------------------------

def longest_prefix(names: DataFrame, known: DataFrame, name: str = "name", dataset: str = "dataset") -> DataFrame:
    """Dataset of a report name: itself, else the longest known `dataset_` prefix, else the whole name.

    Every prefix that ends before an underscore is an equi-join key, so no pair is compared twice.
    """
    parts = F.split(name, "_")
    prefixes = F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_")))
    uniq = names.select(name).distinct()
    best = uniq.withColumn(dataset, prefixes).join(known.select(dataset).distinct(), dataset, "left_semi").groupBy(name).agg(
        F.max_by(dataset, F.length(dataset)).alias("_best"))
    return names.join(best, name, "left").withColumn(dataset, F.coalesce("_best", name)).drop("_best").withColumn(
        "label", F.when(F.col(name) != F.col(dataset), F.expr(f"substring({name}, length({dataset}) + 2)")))


def changed_batches(remote: DataFrame, local: DataFrame, force: bool = False,
                    versions: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Remote batches that are new or whose checksum differs; `force` takes all.

    `versions` are those of the remote and the local manifest; while they are equal nothing has changed.
    """
    if not force and versions[0] is not None and versions[0] == versions[1]:
        return remote.limit(0)
    both = remote.join(local.select("batch", F.col("checksum").alias("_have")), "batch", "left")
    return (both if force else both.where(~F.col("checksum").eqNullSafe(F.col("_have")))).drop("_have")


def newest_first(index: DataFrame) -> DataFrame:
    """Report index by date text; dates with and without a time sort together."""
    return index.orderBy(F.desc("date"), "name")


def case_cost(usage: DataFrame, prices: DataFrame, details: DataFrame, target_role: str) -> DataFrame:
    """Tokens and cost per case over its roles.

    `details` (id, tokens, total_cost) holds what the target itself reported; where present it
    replaces the target's computed tokens and cost.
    """
    priced = price_usage(token_totals(usage, ["id", "role", "model"]), prices)
    per_role = priced.groupBy("id", "role").agg(
        F.sum("total_tokens").alias("_tokens"),
        F.sum(priced_tokens()).alias("_cost"))
    said = details.select("id", F.lit(target_role).alias("role"), F.col("tokens").alias("_said"), "total_cost")
    return per_role.join(said, ["id", "role"], "left").groupBy("id").agg(
        F.sum(F.coalesce("_said", "_tokens")).alias("total_tokens"),
        settled(F.sum(F.coalesce("total_cost", "_cost"))).alias("cost"))
