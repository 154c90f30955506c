"""Readings and life events: lookups, intervals, range joins, windows, weekly summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import text as tx
from scorelake.functions.dates import week_key
from scorelake.operators import readings as rd
from scorelake.operators.cases import where_contains
from scorelake.operators.ranking import exact_median
from scorelake.plans import sqltext as q
from scorelake.plans.registry import query
from scorelake.session import scratch_path

# --- lookups ------------------------------------------------------------------------------------


@query("set01_all_readings", """SELECT source, count(*) AS n, count(DISTINCT user_id) AS users, strftime(min(time), '%Y-%m-%d %H:%M:%S') AS first_time FROM
       (SELECT 'device' AS source, user_id, time FROM v_readings UNION ALL SELECT 'exam', user_id, time FROM v_exams) u GROUP BY source""")
def _(t):
    return rd.all_readings(t.readings, t.exams).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"),
        F.date_format(F.min("time"), "yyyy-MM-dd HH:mm:ss").alias("first_time"))


@query("prj06_lookup_readings", f"""SELECT source, user_id, CAST(day AS VARCHAR) AS day, indicator, value_num FROM
       (SELECT 'device' AS source, user_id, day, indicator, value_num FROM v_readings UNION ALL SELECT 'exam', user_id, day, indicator, value_num FROM v_exams) u
       WHERE contains({q.compact('indicator')}, 'ur')""")
def _(t):
    return rd.lookup_readings(t.readings, t.exams, "U-R").select(
        "source", "user_id", F.col("day").cast("string").alias("day"), "indicator", "value_num")


@query("prj06_lookup_on_day", """SELECT user_id, indicator, value_num FROM v_readings WHERE contains(lower(indicator), 'click') AND day = DATE '2024-01-05'""")
def _(t):
    return rd.lookup_readings(t.readings, t.exams, "Click", date="2024-01-05").select("user_id", "indicator", "value_num")


@query("prj07_lookup_events", """SELECT event_id, event_name, CAST(start_date AS VARCHAR) AS start_date FROM v_life_events
       WHERE (contains(lower(event_name), 'urgent') OR contains(lower(concat('order of ', event_type)), 'urgent')
              OR contains(lower(concat('[{"name":"drug ', CAST(event_id % 9 AS VARCHAR), '"}]')), 'urgent'))
       AND contains(CAST(start_date AS VARCHAR), '1999-0')""")
def _(t):
    e = t.life_events.selectExpr(
        "*", "concat('order of ', event_type) AS description",
        "array(named_struct('name', concat('drug ', CAST(event_id % 9 AS STRING)))) AS medications")
    return rd.lookup_events(e, "URGENT", "1999-0").select("event_id", "event_name", F.col("start_date").cast("string").alias("start_date"))


@query("prj07_lookup_events_by_drug", """SELECT event_id FROM v_life_events WHERE contains(lower(concat('[{"name":"drug ', CAST(event_id % 9 AS VARCHAR), '"}]')), 'drug 7')""")
def _(t):
    e = t.life_events.selectExpr(
        "*", "concat('order of ', event_type) AS description",
        "array(named_struct('name', concat('drug ', CAST(event_id % 9 AS STRING)))) AS medications")
    return rd.lookup_events(e, "Drug 7").select("event_id")


@query("prj12_page", """SELECT event_id, (SELECT count(*) FROM v_life_events) AS total, true AS has_more, CAST(70 AS BIGINT) AS next_offset, CAST(ceil((SELECT count(*) FROM v_life_events) / 20.0) AS BIGINT) AS total_pages
       FROM v_life_events ORDER BY start_date, event_id LIMIT 20 OFFSET 50""")
def _(t):
    return rd.page(t.life_events, [F.col("start_date"), F.col("event_id")], 50, 20).select(
        "event_id", "total", "has_more", "next_offset", "total_pages")


@query("prj12_deep_page", """SELECT event_id, rn - 1 AS row, n AS total, rn_last < n AS has_more, CASE WHEN rn_last < n THEN rn_last END AS next_offset, CAST(ceil(n / 20.0) AS BIGINT) AS total_pages FROM
       (SELECT event_id, row_number() OVER (ORDER BY start_date DESC, event_id) AS rn, count(*) OVER () AS n, least(n * 9 // 10 + 20, n) AS rn_last FROM v_life_events) x WHERE rn > n * 9 // 10 AND rn <= n * 9 // 10 + 20""")
def _(t):
    index = rd.PageIndex(t.life_events, [F.desc("start_date"), F.col("event_id")], scratch_path(t.spark, "pages"))
    return index.page(index.total * 9 // 10, 20).select("event_id", F.col("_row").alias("row"), "total", "has_more", "next_offset", "total_pages")


@query("prj12_page_per_user", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY start_date, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS total FROM v_life_events)
       SELECT user_id, event_id, total, total > 8 AS has_more, CASE WHEN total > 8 THEN CAST(8 AS BIGINT) END AS next_offset, CAST(ceil(total / 4.0) AS BIGINT) AS total_pages FROM r WHERE rn > 4 AND rn <= 8""")
def _(t):
    return rd.page_per_key(t.life_events, ["user_id"], [F.col("start_date"), F.col("event_id")], 4, 4).select(
        "user_id", "event_id", "total", "has_more", "next_offset", "total_pages")


# --- intervals -----------------------------------------------------------------------------------

LATEST = """latest AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_date DESC, event_id DESC) AS rn FROM v_intervals WHERE contains(lower(event_name), 'urgent'))"""


def latest_urgent(t):
    return rd.latest_events(t.life_events.where(tx.contains_ci(F.col("event_name"), "urgent")), ["user_id"])


@query("w02_latest_event", f"WITH {LATEST} SELECT user_id, event_id, CAST(start_date AS VARCHAR) AS start_date FROM latest WHERE rn = 1")
def _(t):
    return latest_urgent(t).select("user_id", "event_id", F.col("start_date").cast("string").alias("start_date"))


@query("j07_overlapping_events", f"""WITH {LATEST}, t AS (SELECT * FROM latest WHERE rn = 1)
       SELECT t.user_id, t.event_id AS target_id, e.event_name, CAST(e.start_date AS VARCHAR) AS start_date, max(e.event_id) AS event_id
       FROM t JOIN v_intervals e ON e.user_id = t.user_id AND e.start_date <= t.end_date AND e.end_date >= t.start_date
       WHERE NOT (e.event_id = t.event_id AND e.start_date = t.start_date) GROUP BY ALL""")
def _(t):
    return rd.overlapping_events(latest_urgent(t), t.life_events).select(
        "user_id", "target_id", "event_name", F.col("start_date").cast("string").alias("start_date"), "event_id")


@query("j08_overlap_days", f"""WITH {LATEST}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_date DESC, event_id DESC) AS rn FROM v_intervals WHERE event_type = 'F')
       SELECT a.user_id, a.event_id AS id_a, b.event_id AS id_b, greatest(date_diff('day', greatest(a.start_date, b.start_date), least(a.end_date, b.end_date)) + 1, 0) AS overlap_days
       FROM latest a JOIN b ON a.user_id = b.user_id WHERE a.rn = 1 AND b.rn = 1""", longs=("overlap_days",))
def _(t):
    finished = rd.latest_events(t.life_events.where("event_type = 'F'"), ["user_id"])
    return rd.overlap_days(latest_urgent(t), finished)


@query("w06_event_batches", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY start_date, event_id) AS rn FROM v_life_events)
       SELECT user_id, CAST((rn - 1) // 10 AS INT) AS batch, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS ids FROM r GROUP BY ALL""")
def _(t):
    b = rd.event_batches(t.life_events)
    return b.groupBy("user_id", "batch").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("position", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("ids"))


# --- events and indicators --------------------------------------------------------------------------

TERM_HITS = f"""hits AS (SELECT event_id, 'IND-1' AS term FROM v_event_indicators WHERE contains({q.compact('indicator_name')}, 'ind1')
       UNION SELECT event_id, 'ind 22' FROM v_event_indicators WHERE contains({q.compact('indicator_name')}, 'ind22'))"""


@query("j09_events_by_indicators_all", f"WITH {TERM_HITS} SELECT event_id, string_agg(term, '|' ORDER BY term) AS matched_terms FROM hits GROUP BY event_id HAVING count(*) = 2")
def _(t):
    return rd.events_by_indicators(t.event_indicators, ["IND-1", "ind 22"]).select("event_id", F.array_join("matched_terms", "|").alias("matched_terms"))


@query("j09_events_by_indicators_any", f"WITH {TERM_HITS} SELECT event_id, string_agg(term, '|' ORDER BY term) AS matched_terms FROM hits GROUP BY event_id")
def _(t):
    return rd.events_by_indicators(t.event_indicators, ["IND-1", "ind 22"], "any").select("event_id", F.array_join("matched_terms", "|").alias("matched_terms"))


@query("agg14_count_events_by_indicator", """SELECT user_id, count(DISTINCT event_id) AS n_events FROM v_life_events WHERE event_id IN
       (SELECT event_id FROM v_event_indicators WHERE contains(indicator_name, 'ind-4')) GROUP BY user_id""")
def _(t):
    return rd.count_events_by_indicator(t.life_events, t.event_indicators, "ind-4", ["user_id"])


@query("agg14_preview_events_by_indicator", """SELECT user_id, event_id, rn AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY start_date, event_name, event_id) AS rn FROM v_life_events WHERE event_id IN
       (SELECT event_id FROM v_event_indicators WHERE contains(indicator_name, 'ind-4'))) x WHERE rn <= 12""", longs=("rank",))
def _(t):
    return rd.preview_events_by_indicator(t.life_events, t.event_indicators, "ind-4", ["user_id"], 12).select("user_id", "event_id", "rank")


@query("agg15_count_events_by_medication", """WITH m AS (SELECT l_orderkey AS event_id, p_name AS med FROM lineitem JOIN part ON l_partkey = p_partkey),
       f AS (SELECT event_id, max(lower(med) = 'red widget') AS ex, max(contains(lower(med), 'red widget')) AS fz FROM m GROUP BY event_id),
       h AS (SELECT e.user_id, e.event_id, f.ex FROM v_life_events e JOIN f USING (event_id) WHERE e.event_type = 'F' AND (f.ex OR f.fz)),
       a AS (SELECT user_id, max(ex) AS anyex FROM h GROUP BY user_id)
       SELECT h.user_id, CASE WHEN anyex THEN 'exact' ELSE 'contains' END AS match_type, count(DISTINCT event_id) AS n_events FROM h JOIN a USING (user_id) WHERE h.ex OR NOT a.anyex GROUP BY ALL""")
def _(t):
    meds = t.raw("lineitem").select("l_orderkey", "l_partkey").join(
        t.raw("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("event_id"), F.col("p_name").alias("medication"))
    return rd.count_events_by_medication(t.life_events, meds, "Red Widget", ["user_id"], "F")


@query("agg16_count_event_indicators", f"""WITH {LATEST} SELECT l.user_id, l.event_id, count(DISTINCT i.indicator_name) AS indicator_count,
       string_agg(DISTINCT i.indicator_name, '|' ORDER BY i.indicator_name) AS names FROM latest l LEFT JOIN v_event_indicators i USING (event_id) WHERE rn = 1 GROUP BY ALL""", longs=("indicator_count",))
def _(t):
    return rd.count_event_indicators(latest_urgent(t), t.event_indicators).select(
        "user_id", "event_id", "indicator_count", F.array_join("indicator_names", "|").alias("names"))


@query("agg13_names_on_date", "SELECT user_id, CAST(day AS VARCHAR) AS day, string_agg(DISTINCT indicator, '|' ORDER BY indicator) AS names, count(DISTINCT indicator) AS n_names FROM v_readings GROUP BY user_id, day", longs=("n_names",))
def _(t):
    return rd.names_on_date(t.readings).select("user_id", F.col("day").cast("string").alias("day"), F.array_join("names", "|").alias("names"), "n_names")


@query("agg13_group_names", """WITH named AS (SELECT user_id, day, CASE indicator WHEN 'click' THEN 'HeartRate-HR' WHEN 'view' THEN 'DeepSleep' ELSE indicator END AS indicator FROM v_readings)
       SELECT user_id, CAST(day AS VARCHAR) AS day, count(DISTINCT indicator) AS n_names FROM named WHERE contains(lower(indicator), 'heartrate') GROUP BY user_id, day""", longs=("n_names",))
def _(t):
    named = t.readings.withColumn("indicator", F.expr(
        "CASE indicator WHEN 'click' THEN 'HeartRate-HR' WHEN 'view' THEN 'DeepSleep' ELSE indicator END"))
    return rd.names_on_date(named, group="cardio", value="value_num").select("user_id", F.col("day").cast("string").alias("day"), "n_names")


# --- range joins ---------------------------------------------------------------------------------------

JOINED = """j AS (SELECT w.user_id, w.indicator, w.start_date, w.end_date, r.day, r.value_num AS v FROM v_windows w JOIN v_readings r
       ON r.user_id = w.user_id AND r.indicator = w.indicator AND r.day BETWEEN w.start_date AND w.end_date)"""


@query("j06_window_join", f"WITH {JOINED} SELECT user_id, indicator, CAST(start_date AS VARCHAR) AS start_date, CAST(day AS VARCHAR) AS day, v AS value_num FROM j")
def _(t):
    return rd.window_join(t.windows, t.readings).select(
        "user_id", "indicator", F.col("start_date").cast("string").alias("start_date"), F.col("day").cast("string").alias("day"), "value_num")


@query("agg17_window_stats", f"""WITH w2 AS (SELECT user_id, indicator, start_date, end_date FROM v_windows UNION ALL SELECT user_id, indicator, start_date - 400, start_date - 300 FROM v_windows),
       j AS (SELECT w.*, r.day, r.value_num AS v, max(r.value_num) OVER (PARTITION BY w.user_id, w.indicator, w.start_date) AS mx FROM w2 w LEFT JOIN v_readings r
       ON r.user_id = w.user_id AND r.indicator = w.indicator AND r.day BETWEEN w.start_date AND w.end_date)
       SELECT user_id, indicator, CAST(start_date AS VARCHAR) AS start_date, count(v) AS n_points, CAST(round(CAST(avg(v) AS DECIMAL(28, 9)), 4) AS DOUBLE) AS mean, round(max(v), 4) AS max, round(min(v), 4) AS min,
       CAST(round(CAST(quantile_cont(v, 0.5) AS DECIMAL(28, 9)), 4) AS DOUBLE) AS median, CASE WHEN count(v) > 0 THEN CAST(round(CAST(coalesce(stddev_samp(v), 0) AS DECIMAL(28, 9)), 4) AS DOUBLE) END AS stddev, CAST(round(CAST(max(v) - min(v) AS DECIMAL(28, 9)), 4) AS DOUBLE) AS range,
       CAST(min(day) FILTER (v = mx) AS VARCHAR) AS argmax_date, count(v) = 0 AS unanswerable FROM j GROUP BY user_id, indicator, start_date""")
def _(t):
    empty = t.windows.select("user_id", "indicator", F.date_sub("start_date", 400).alias("start_date"),
                             F.date_sub("start_date", 300).alias("end_date"))
    s = rd.window_stats(t.windows.unionByName(empty), t.readings)
    return s.select("user_id", "indicator", F.col("start_date").cast("string").alias("start_date"), "n_points", "mean", "max", "min",
                    "median", "stddev", "range", F.col("argmax_date").cast("string").alias("argmax_date"), "unanswerable")


@query("agg17_exact_median", "SELECT user_id, quantile_cont(value, 0.5) AS median FROM events GROUP BY user_id")
def _(t):
    return exact_median(t.readings, ["user_id"], "value_num")


def phases(t):
    return t.windows.selectExpr(
        "user_id", "indicator", "start_date AS w1_start", "date_add(start_date, 6) AS w1_end",
        "date_add(start_date, 7) AS w2_start", "date_add(start_date, 13) AS w2_end",
        "start_date AS pre_start", "date_add(start_date, 4) AS pre_end",
        "date_add(start_date, 5) AS during_start", "date_add(start_date, 9) AS during_end",
        "date_add(start_date, 10) AS post_start", "date_add(start_date, 14) AS post_end")


def phase(name, lo, hi):
    return f"avg(v) FILTER (day BETWEEN start_date + {lo} AND start_date + {hi}) AS m_{name}, count(v) FILTER (day BETWEEN start_date + {lo} AND start_date + {hi}) AS n_{name}"


WIDE = """j AS (SELECT w.user_id, w.indicator, w.start_date, r.day, r.value_num AS v FROM v_windows w JOIN v_readings r
       ON r.user_id = w.user_id AND r.indicator = w.indicator AND r.day BETWEEN w.start_date AND w.start_date + 14)"""


@query("agg18_two_window_delta", f"WITH {WIDE}, p AS (SELECT user_id, indicator, {phase('w1', 0, 6)}, {phase('w2', 7, 13)} FROM j GROUP BY user_id, indicator) SELECT user_id, indicator, n_w1, n_w2, CAST(round(CAST(m_w2 - m_w1 AS DECIMAL(28, 9)), 4) AS DOUBLE) AS delta FROM p")
def _(t):
    return rd.two_window_delta(phases(t), t.readings, ["user_id", "indicator"])


@query("agg19_three_phase_means", f"""WITH {WIDE}, p AS (SELECT user_id, indicator, {phase('pre', 0, 4)}, {phase('during', 5, 9)}, {phase('post', 10, 14)} FROM j GROUP BY user_id, indicator)
       SELECT user_id, indicator, CASE WHEN n_pre > 0 AND n_during > 0 AND n_post > 0 THEN CAST(round(CAST(m_pre AS DECIMAL(28, 9)), 4) AS DOUBLE) END AS pre,
       CASE WHEN n_pre > 0 AND n_during > 0 AND n_post > 0 THEN CAST(round(CAST(m_during AS DECIMAL(28, 9)), 4) AS DOUBLE) END AS during, CASE WHEN n_pre > 0 AND n_during > 0 AND n_post > 0 THEN CAST(round(CAST(m_post AS DECIMAL(28, 9)), 4) AS DOUBLE) END AS post FROM p""")
def _(t):
    m = rd.three_phase_means(phases(t), t.readings, ["user_id", "indicator"])
    return m.select("user_id", "indicator", *[F.get("means", F.lit(i)).alias(n) for i, n in enumerate(("pre", "during", "post"))])


@query("agg20_value_at", """WITH l AS (SELECT DISTINCT user_id, start_date + 3 AS day, indicator FROM v_windows),
       v AS (SELECT user_id, day, indicator, arg_max(value_num, time) AS value FROM v_readings GROUP BY ALL), d AS (SELECT DISTINCT user_id, day FROM v_readings)
       SELECT l.user_id, CAST(l.day AS VARCHAR) AS day, l.indicator, round(v.value, 4) AS value, CASE WHEN v.value IS NOT NULL THEN NULL WHEN d.day IS NULL THEN 'day missing' ELSE 'indicator missing' END AS reason
       FROM l LEFT JOIN v USING (user_id, day, indicator) LEFT JOIN d ON d.user_id = l.user_id AND d.day = l.day""")
def _(t):
    lookups = t.windows.select("user_id", F.date_add("start_date", 3).alias("day"), "indicator")
    return rd.value_at(lookups, t.readings).withColumn("day", F.col("day").cast("string"))


# --- weekly ------------------------------------------------------------------------------------------------

RANKED_WEEKS = f"""r AS (SELECT user_id, {q.week_key('day')} AS week, indicator, value_num AS v, row_number() OVER (PARTITION BY user_id, {q.week_key('day')}, indicator ORDER BY time, value_num) AS rn,
       count(*) OVER (PARTITION BY user_id, {q.week_key('day')}, indicator) AS n FROM v_readings)"""
TREND = """CASE WHEN n < 4 THEN 'stable' WHEN (s - f) / (abs(f) + 1e-9) > 0.1 THEN 'rising' WHEN (s - f) / (abs(f) + 1e-9) < -0.1 THEN 'falling' ELSE 'stable' END"""


@query("w03_half_trend", f"""WITH {RANKED_WEEKS}, h AS (SELECT user_id, week, indicator, max(n) AS n, avg(v) FILTER (rn <= n // 2) AS f, avg(v) FILTER (rn > n // 2) AS s FROM r GROUP BY ALL)
       SELECT user_id, week, indicator, n, {TREND} AS trend FROM h""")
def _(t):
    return rd.half_trend(t.readings.withColumn("week", week_key(F.col("day"))), ["user_id", "week", "indicator"], ["time", "value_num"])


@query("agg24_weekly_summary", f"""WITH {RANKED_WEEKS}, h AS (SELECT user_id, week, indicator, max(n) AS n, avg(v) AS mean, min(v) AS mn, max(v) AS mx, avg(v) FILTER (rn <= n // 2) AS f, avg(v) FILTER (rn > n // 2) AS s FROM r GROUP BY ALL)
       SELECT user_id, week, indicator, n, round(mean, 6) AS mean, mn AS min, mx AS max, {TREND} AS trend, mx > mean * 1.5 AND n >= 3 AS anomaly FROM h""")
def _(t):
    return rd.weekly_summary(t.readings).withColumn("mean", F.round("mean", 6))


@query("prj03_where_contains", """SELECT event_id, 'x' AS kind FROM v_life_events WHERE contains(lower(event_name), 'low') OR false""")
def _(t):
    return where_contains(t.life_events, "event_name", " LOW").select("event_id", F.lit("x").alias("kind"))


@query("prj03_where_date", """SELECT event_id FROM v_life_events WHERE contains(CAST(start_date AS VARCHAR), '2000-02')""")
def _(t):
    return where_contains(t.life_events, "date", "2000-02", ["event_id"])
