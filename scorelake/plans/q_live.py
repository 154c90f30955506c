"""Streaming queries run to the end of the available files, and the judge boundary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from scorelake.operators import scoring as sc
from scorelake.plans.q_reports import MEASURES
from scorelake.plans.registry import query
from scorelake.session import scratch_path
from scorelake.streaming import streams as st


def result_lines(t) -> str:
    """The result log as JSON lines, every line written twice as after a restart."""
    r = t.results.join(t.tagged_cases, "id").select(
        F.col("system_id").cast("string").alias("run_id"), F.col("id").cast("string").alias("id"), "result", "score", "tags",
        F.timestamp_seconds(1_700_000_000 + F.col("id") % 1000).alias("finished_at"))
    path = scratch_path(t.spark, "results")
    r.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy").write.option("compression", "gzip").json(path)
    return path


def merged(t, totals, by):
    """The changes of the result stream, with running totals of what each micro-batch changed."""
    table, sums = scratch_path(t.spark, "results-table"), scratch_path(t.spark, "totals")
    changes = st.first_finished(st.stream_results(t.spark, result_lines(t)))
    st.run_available(changes, scratch_path(t.spark, "offsets"), st.append_changes(table, st.keep_totals(sums, totals)), "update")
    return st.read_totals(t.spark, sums, by)


@query("st01_stream_results", "SELECT CAST(system_id AS VARCHAR) AS run_id, CAST(id AS VARCHAR) AS id, result, score FROM v_results")
def _(t):
    table = scratch_path(t.spark, "results-table")
    st.run_available(st.first_finished(st.stream_results(t.spark, result_lines(t))), scratch_path(t.spark, "offsets"), st.append_changes(table), "update")
    return st.current_results(t.spark, table).select("run_id", "id", "result", "score")


@query("st02_stream_tag_stats", f"SELECT tag, {MEASURES} FROM v_results JOIN v_case_tags USING (id) GROUP BY tag")
def _(t):
    return st.tag_stats(merged(t, st.tag_totals, ["tag"]))


@query("st03_stream_progress", """WITH c AS (SELECT CAST(system_id AS VARCHAR) AS run_id, result, count(*) AS n FROM v_results GROUP BY ALL), d AS (SELECT run_id, CAST(sum(n) AS BIGINT) AS completed, (SELECT count(*) FROM v_cases) AS total FROM c GROUP BY run_id)
       SELECT run_id, result, n, completed, total FROM c JOIN d USING (run_id) UNION ALL SELECT run_id, NULL, total - completed, completed, total FROM d""")
def _(t):
    return st.progress_snapshot(merged(t, st.status_totals, ["run_id", "result"]), t.cases)


@query("st04_stream_weekly_stats", """SELECT user_id, CAST(CAST(date_trunc('week', time) AS DATE) AS VARCHAR) AS monday, indicator, count(*) AS n, round(avg(value_num), 6) AS mean, min(value_num) AS min, max(value_num) AS max FROM v_readings GROUP BY ALL""")
def _(t):
    schema = t.raw("events").schema
    events = t.spark.readStream.schema(schema).parquet(f"{t.root}/events*.parquet").selectExpr(
        "user_id", "ts AS time", "event_type AS indicator", "value AS value_num")
    out = scratch_path(t.spark, "weeks")
    st.run_available(st.stream_weekly_stats(events, "7 days"), scratch_path(t.spark, "offsets"), st.overwrite_with(out), "complete")
    weekly = t.spark.read.parquet(out)
    return weekly.select("user_id", F.col("week.start").cast("date").cast("string").alias("monday"), "indicator", "n", F.round("mean", 6).alias("mean"), "min", "max")


@query("st04_stream_week_trends", """WITH ev AS (SELECT user_id, event_type AS indicator, ts AS time, value, CAST(date_trunc('week', ts) AS DATE) AS monday, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('week', ts) ORDER BY ts, value) AS rk,
         count(*) OVER (PARTITION BY user_id, event_type, date_trunc('week', ts)) AS n FROM events),
       w AS (SELECT user_id, indicator, monday, max(n) AS n, avg(value) AS mean, min(value) AS min, max(value) AS max, avg(value) FILTER (rk <= n // 2) AS a, avg(value) FILTER (rk > n // 2) AS b FROM ev GROUP BY ALL)
       SELECT user_id, CAST(monday AS VARCHAR) AS monday, indicator, n, round(mean, 6) AS mean, min, max, CASE WHEN n < 4 THEN 'stable' WHEN (b - a) / (abs(a) + 1e-9) > 0.1 THEN 'rising' WHEN (b - a) / (abs(a) + 1e-9) < -0.1 THEN 'falling' ELSE 'stable' END AS trend,
         n >= 3 AND max > mean * 1.5 AS anomaly FROM w""")
def _(t):
    """Readings as two files, the later weeks in the second; a last reading of nobody, years later, closes all weeks."""
    rows = t.readings.select("user_id", "indicator", F.col("time").cast("timestamp").alias("time"), "value_num")
    middle = rows.agg(F.percentile_approx("time", 0.5)).first()[0]
    end = rows.agg(F.timestamp_seconds(F.unix_timestamp(F.max("time")) + 100_000_000).alias("time")).select(
        F.lit(-1).cast(dict(rows.dtypes)["user_id"]).alias("user_id"), F.lit("end").alias("indicator"), "time", F.lit(0.0).alias("value_num"))
    folder, out, offsets = (scratch_path(t.spark, n) for n in ("readings", "weeks", "offsets"))
    for part in (rows.where(F.col("time") < middle), rows.where(F.col("time") >= middle), end):
        part.write.mode("append").parquet(folder)
        stream = t.spark.readStream.schema(rows.schema).parquet(folder)
        st.run_available(st.stream_week_trends(stream, "400 days"), offsets, st.append_rows(out))
    weeks = t.spark.read.parquet(out).where("user_id <> -1")
    return weeks.select("user_id", F.col("monday").cast("string").alias("monday"), "indicator", "n", F.round("mean", 6).alias("mean"), "min", "max", "trend", "anomaly")


@query("st04_stream_late_rows", """WITH r AS (SELECT user_id, event_type AS indicator, value, CAST(date_trunc('week', ts) AS DATE) AS monday FROM events)
       SELECT user_id, CAST(monday AS VARCHAR) AS monday, indicator, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM r GROUP BY ALL""")
def _(t):
    """Update mode: a copy of the first readings that comes after all weeks were left behind changes no week."""
    rows = t.readings.select("user_id", "indicator", F.col("time").cast("timestamp").alias("time"), "value_num")
    end = rows.agg(F.timestamp_seconds(F.unix_timestamp(F.max("time")) + 100_000_000).alias("time")).select(
        F.lit(-1).cast(dict(rows.dtypes)["user_id"]).alias("user_id"), F.lit("end").alias("indicator"), "time", F.lit(0.0).alias("value_num"))
    folder, out, offsets = (scratch_path(t.spark, n) for n in ("readings", "weeks", "offsets"))
    for part in (rows, end, rows.withColumn("value_num", F.col("value_num") + 1000)):
        part.write.mode("append").parquet(folder)
        stream = t.spark.readStream.schema(rows.schema).parquet(folder)
        st.run_available(st.stream_weekly_stats(stream, "7 days"), offsets, st.append_rows(out), "update")
    weeks = t.spark.read.parquet(out).where("user_id <> -1").groupBy("user_id", "week", "indicator").agg(F.max_by(F.struct("n", "mean", "min", "max"), "_part").alias("_l"))
    return weeks.select("user_id", F.col("week.start").cast("date").cast("string").alias("monday"), "indicator", "_l.n", F.round("_l.mean", 6).alias("mean"), "_l.min", "_l.max")


@query("st05_ingest_changed", """WITH b AS (SELECT concat(o_orderstatus, '-', substring(o_orderpriority, 1, 1)) AS batch, * FROM orders), r AS (SELECT batch, count(*) AS n, count(*) FILTER (o_orderstatus = 'F' OR o_totalprice > 20000) AS had FROM b GROUP BY batch)
       SELECT batch, n FROM r WHERE n <> had""")
def _(t):
    rows = t.raw("orders").selectExpr("concat(o_orderstatus, '-', substring(o_orderpriority, 1, 1)) AS batch", "o_orderkey AS id", "o_orderstatus = 'F' OR o_totalprice > 20000 AS had")
    source, table, staging = (scratch_path(t.spark, n) for n in ("batches", "table", "staging"))
    # The rows of a batch come in several files.
    rows.where("id % 2 = 0").write.json(source)
    rows.where("id % 2 = 1").write.mode("append").json(source)
    manifest = rows.groupBy("batch").agg(F.md5(F.count(F.lit(1)).cast("string")).alias("checksum"))
    local = rows.groupBy("batch").agg(F.md5(F.count_if("had").cast("string")).alias("checksum"))
    st.ingest_changed(t.spark, source, "batch STRING, id BIGINT", manifest, local, table, staging, scratch_path(t.spark, "offsets"))
    return t.spark.read.parquet(table).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("agg25_latency_by_turn", "SELECT event_id, round(CASE WHEN event_type = 'click' THEN value / 100 ELSE value END, 4) AS latency_s FROM events")
def _(t):
    at = "CAST(ts AS TIMESTAMP)"
    turns = t.raw("events").selectExpr(
        "event_id", f"{at} AS request_time", f"timestampadd(MICROSECOND, CAST(round(value * 1000000) AS BIGINT), {at}) AS response_time",
        f"IF(event_type = 'click', array(named_struct('type', 'reply', 'timestamp', CAST(NULL AS STRING)), named_struct('type', 'annotation', 'timestamp', CAST(timestampadd(MICROSECOND, CAST(round(value * 10000) AS BIGINT), {at}) AS STRING))), array(named_struct('type', 'reply', 'timestamp', CAST(NULL AS STRING)))) AS messages")
    return sc.latency_by_turn(turns).select("event_id", F.round("latency_s", 4).alias("latency_s"))


def _length_judge():
    """A stand-in for a model: the verdict is the prompt length. A closure travels to the workers by value."""
    def judge(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "verdict": (pdf["prompt"].str.len() % 5 + 1).astype("int64")})
    return judge


@query("udf03_apply_judge", "SELECT id, length(concat('Rate: ', answer)) % 5 + 1 AS verdict FROM v_answers")
def _(t):
    from scorelake.operators.cases import judge_batch
    prompts = judge_batch(t.answers, "Rate: {answer}", ["answer"])
    return sc.apply_judge(prompts, _length_judge(), "id bigint, verdict bigint")
