"""Report queries: summaries, tags, A/B, comparisons, cost, leaderboards, id joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import reports as rp
from scorelake.plans import sqltext as q
from scorelake.plans.q_scoring import BY_TYPE
from scorelake.plans.registry import query

RATE = "CASE WHEN count(*) FILTER (result IN ('pass', 'fail')) > 0 THEN round(count(*) FILTER (result = 'pass') / (count(*) FILTER (result IN ('pass', 'fail')))::DOUBLE, 6) ELSE 0.0::DOUBLE END AS pass_rate"
MEASURES = ("count(*) AS total, count(*) FILTER (result = 'pass') AS pass_count, count(*) FILTER (result = 'fail') AS fail_count, "
            f"{RATE}, {q.settled('avg(score)', 6)} AS avg_score")


def tagged_results(t):
    return t.results.join(t.tagged_cases, "id")


# --- id joins -----------------------------------------------------------------------------------


def submissions(t):
    """A submission with ids that are no case here."""
    return t.submitted.select("id").unionByName(t.raw("customer").selectExpr("c_custkey + 100000000 AS id"))


SUBMITTED = "sub AS (SELECT id FROM v_submitted UNION ALL SELECT c_custkey + 100000000 FROM customer)"


@query("j01_attach_answers", "SELECT a.id, a.answer, c.answer_type, c.expected_value FROM v_submitted a JOIN v_cases c USING (id)")
def _(t):
    return rp.attach_answers(t.submitted, t.cases).select("id", "answer", "answer_type", "expected_value")


@query("j02_check_submission", f"""WITH {SUBMITTED} SELECT (SELECT count(*) FROM sub WHERE id IN (SELECT id FROM v_cases)) AS matched,
       (SELECT count(*) FROM sub WHERE id NOT IN (SELECT id FROM v_cases)) AS extra, (SELECT count(*) FROM v_cases WHERE id NOT IN (SELECT id FROM sub)) AS missed""")
def _(t):
    return rp.check_submission(submissions(t), t.cases)


@query("j02_missed_ids", f"WITH {SUBMITTED} SELECT id FROM v_cases WHERE id NOT IN (SELECT id FROM sub) ORDER BY id LIMIT 50")
def _(t):
    return rp.unmatched_ids(t.cases, submissions(t), 50)


@query("j02_matched_tags", "SELECT tag, count(*) AS n FROM v_case_tags WHERE id IN (SELECT id FROM v_submitted) GROUP BY tag")
def _(t):
    return rp.matched_tags(submissions(t), t.tagged_cases)


@query("j03_complete_with_zero", """SELECT c.id, coalesce(CASE WHEN a.id IS NOT NULL THEN 'scored' END, 'fail') AS result, coalesce(CASE WHEN a.id IS NOT NULL THEN 0.5 END, 0.0)::DOUBLE AS score FROM v_cases c LEFT JOIN v_submitted a USING (id)""")
def _(t):
    r = t.submitted.select("id", F.lit("scored").alias("result"), F.lit(0.5).alias("score"))
    return rp.complete_with_zero(r, t.cases.select("id"))


@query("j04_remaining_cases", "SELECT id FROM v_cases WHERE id NOT IN (SELECT id FROM v_results WHERE result <> 'scored')")
def _(t):
    log = t.results.select("id", F.when(F.col("result") == "scored", F.lit("cancelled")).otherwise(F.col("result")).alias("status"))
    return rp.remaining_cases(t.cases, log).select("id")


@query("set02_id_sets", f"""WITH {SUBMITTED} SELECT 'both' AS side, count(*) AS n FROM (SELECT id FROM sub INTERSECT SELECT id FROM v_cases) a
       UNION ALL SELECT 'submitted', count(*) FROM (SELECT id FROM sub EXCEPT SELECT id FROM v_cases) b UNION ALL SELECT 'cases', count(*) FROM (SELECT id FROM v_cases EXCEPT SELECT id FROM sub) c""")
def _(t):
    s, c = submissions(t), t.cases.select("id")
    sides = {"both": s.intersect(c), "submitted": s.subtract(c), "cases": c.subtract(s)}
    out = None
    for side, ids in sides.items():
        one = ids.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("set05_merge_results", "SELECT id, system_id, result FROM v_results")
def _(t):
    cases = t.cases.select("id", F.col("id").alias("ord"))
    cols = ["id", "system_id", "result"]
    finished, fresh = t.results.where("system_id < 4").select(cols), t.results.where("system_id >= 4").select(cols)
    return rp.merge_results(finished, fresh, cases).select(cols)


# --- summaries --------------------------------------------------------------------------------------


@query("agg01_run_summary", f"SELECT system_id, {MEASURES}, CAST(sum(date_diff('second', start_ts, end_ts)) AS BIGINT) AS total_seconds FROM v_results GROUP BY system_id")
def _(t):
    return rp.run_summary(t.results, ["system_id"])


@query("agg02_stats_by_tag", f"SELECT tag, {MEASURES} FROM v_results JOIN v_case_tags USING (id) GROUP BY tag")
def _(t):
    return rp.stats_by_tag(tagged_results(t))


@query("agg02_stats_by_tag_and_system", f"SELECT system_id, tag, {MEASURES} FROM v_results JOIN v_case_tags USING (id) GROUP BY system_id, tag")
def _(t):
    return rp.stats_by_tag(tagged_results(t), ["system_id"])


@query("agg03_tag_distribution", "SELECT tag, count(*) AS n FROM v_case_tags GROUP BY tag")
def _(t):
    return rp.tag_distribution(t.tagged_cases)


@query("agg04_tag_categories", "SELECT split_part(tag, ':', 1) AS category, string_agg(DISTINCT substring(tag, strpos(tag, ':') + 1), '|' ORDER BY substring(tag, strpos(tag, ':') + 1)) AS vals FROM v_case_tags GROUP BY 1 HAVING count(DISTINCT tag) > 1")
def _(t):
    return rp.tag_categories(t.tagged_cases).select("category", F.array_join("vals", "|").alias("vals"))


@query("prj13_filter_results", "SELECT id, system_id, score FROM v_results WHERE result = 'pass' AND id IN (SELECT id FROM v_case_tags WHERE tag = 'status:F') AND id IN (SELECT id FROM v_case_tags WHERE tag = 'opening:02')")
def _(t):
    return rp.filter_results(tagged_results(t), "pass", ["status:F", "opening:02"]).select("id", "system_id", "score")


@query("agg06_ab_rates", """WITH r AS (SELECT v.id, result, max(CASE WHEN starts_with(tag, 'opening:') THEN substring(tag, 9) END) AS opening, max(CASE WHEN starts_with(tag, 'difficulty:') THEN substring(tag, 12) END) AS difficulty,
       max(CASE WHEN starts_with(tag, 'status:') THEN substring(tag, 8) END) AS status FROM v_results v JOIN v_case_tags t USING (id) GROUP BY v.id, v.system_id, result),
       l AS (SELECT opening, NULL AS dim, NULL AS level, result FROM r UNION ALL SELECT opening, 'difficulty', difficulty, result FROM r UNION ALL SELECT opening, 'status', status, result FROM r)
       SELECT opening, dim, level, count(*) AS total, count(*) FILTER (result = 'pass') AS passed, round(count(*) FILTER (result = 'pass') / count(*)::DOUBLE, 6) AS rate FROM l GROUP BY opening, dim, level""")
def _(t):
    return rp.ab_rates(tagged_results(t), ["difficulty", "status", "disclosure"])


BOARD = "b AS (SELECT system_id, count(*) AS n_cases, " + q.settled("avg(score)", 6) + " AS avg_score, CAST(sum(date_diff('second', start_ts, end_ts)) AS BIGINT) AS total_seconds FROM v_results GROUP BY system_id)"


@query("agg07_leaderboard", f"WITH {BOARD} SELECT *, rank() OVER (ORDER BY avg_score DESC) AS rank, dense_rank() OVER (ORDER BY avg_score DESC) AS dense_rank FROM b", longs=("rank", "dense_rank",))
def _(t):
    return rp.leaderboard(t.results)


@query("w07_rank_systems", """WITH b AS (SELECT role, model, CAST(sum(output_tokens) AS BIGINT) AS used FROM v_usage GROUP BY role, model), m AS (SELECT model, max(used) // 1000000 AS avg_score FROM b GROUP BY model)
       SELECT model, avg_score, rank() OVER (ORDER BY avg_score DESC) AS rank, dense_rank() OVER (ORDER BY avg_score DESC) AS dense_rank FROM m""", longs=("rank", "dense_rank",))
def _(t):
    used = t.usage.groupBy("role", "model").agg(F.sum("output_tokens").alias("used")).groupBy("model").agg(
        F.max("used").alias("used")).selectExpr("model", "used DIV 1000000 AS avg_score")
    return rp.rank_systems(used)


SYSTEMS = list(range(1, 8))
PIVOT = ", ".join(f"{q.settled(f'avg(score) FILTER (system_id = {i})', 6)} AS s_{i}" for i in SYSTEMS)


@query("agg08_score_matrix", f"WITH m AS (SELECT difficulty, {PIVOT} FROM v_results JOIN v_cases USING (id) GROUP BY difficulty) SELECT *, least({', '.join(f's_{i}' for i in SYSTEMS)}) < 0.7 AS any_low FROM m")
def _(t):
    return rp.score_matrix(t.results.join(t.cases.select("id", "difficulty"), "id"), "difficulty", "system_id", SYSTEMS)


@query("agg08_case_matrix", f"WITH m AS (SELECT id, {PIVOT} FROM v_results GROUP BY id) SELECT *, least({', '.join(f's_{i}' for i in SYSTEMS)}) < 0.7 AS any_low FROM m")
def _(t):
    return rp.score_matrix(t.results, "id", "system_id", SYSTEMS)


@query("agg12_wall_span", "SELECT system_id, CAST(date_diff('second', min(start_ts), max(end_ts)) AS BIGINT) AS wall_seconds FROM v_results GROUP BY system_id")
def _(t):
    return rp.wall_span(t.results, ["system_id"])


@query("agg23_progress", f"""SELECT r.result, count(*) AS n, {q.settled('avg(r.score)', 6)} AS avg_score FROM v_cases c LEFT JOIN v_results r USING (id) GROUP BY r.result""")
def _(t):
    return rp.progress(t.results, t.cases)


@query("agg26_completeness", """WITH have AS (SELECT user_id, list(DISTINCT indicator) AS kinds FROM v_readings GROUP BY user_id)
       SELECT user_id, array_to_string(list_filter(['click', 'devices', 'error', 'purchase'], lambda k: NOT list_contains(kinds, k)), '|') AS missing, list_has_all(kinds, ['click', 'devices', 'error', 'purchase']) AS complete FROM have""")
def _(t):
    c = rp.completeness(t.readings, ["purchase", "click", "error", "devices"], kind="indicator")
    return c.select("user_id", F.array_join("missing", "|").alias("missing"), "complete")


@query("agg26_dataset_complete", """WITH have AS (SELECT user_id, list(DISTINCT indicator) AS kinds FROM v_readings GROUP BY user_id), c AS (SELECT list_has_all(kinds, ['click', 'error']) AS ok FROM have)
       SELECT count(*) AS n_users, count(*) FILTER (NOT ok) AS n_incomplete, bool_and(ok) AS complete FROM c""")
def _(t):
    return rp.dataset_complete(rp.completeness(t.readings, ["click", "error"], kind="indicator"))


# --- comparisons ----------------------------------------------------------------------------------------

PAIRS = f"""old AS (SELECT id, max(score) AS score FROM v_results GROUP BY id), new AS (SELECT id, min(score) AS score FROM v_results GROUP BY id),
       pairs AS (SELECT o.id, c.answer_type, c.difficulty, o.score AS old_score, n.score AS new_score, {q.settled('n.score - o.score')} AS delta FROM old o JOIN new n USING (id) JOIN v_cases c USING (id))"""


def pairs(t):
    old = t.results.groupBy("id").agg(F.max("score").alias("score"))
    new = t.results.groupBy("id").agg(F.min("score").alias("score"))
    return rp.old_new(old.join(t.cases.select("id", "answer_type", "difficulty"), "id"), new)


@query("j15_old_new", f"WITH {PAIRS} SELECT id, old_score, new_score, delta FROM pairs")
def _(t):
    return pairs(t).select("id", "old_score", "new_score", "delta")


def reeval_sql(counted: str, source: str = PAIRS) -> str:
    return f"""WITH {source}, g AS (SELECT 'all' AS scope, 'all' AS bucket, * FROM pairs UNION ALL SELECT 'answer_type', answer_type, * FROM pairs UNION ALL SELECT 'difficulty', difficulty, * FROM pairs)
       SELECT scope, bucket, count(*) FILTER ({counted}) AS n, count(*) FILTER (abs(delta) > 0.001) AS n_changed, {q.settled(f'avg(old_score) FILTER ({counted})')} AS old_avg,
       {q.settled(f'avg(new_score) FILTER ({counted})')} AS new_avg, {q.settled(f'avg(delta) FILTER ({counted})')} AS avg_delta FROM g GROUP BY scope, bucket"""


@query("agg05_reeval_summary", reeval_sql("true"))
def _(t):
    return rp.reeval_summary(pairs(t))


@query("agg05_reeval_changed_only", reeval_sql("scope <> 'all' OR abs(delta) > 0.001"))
def _(t):
    return rp.reeval_summary(pairs(t), changed_only=True)


@query("tk01_top_changes", f"WITH {PAIRS} SELECT id, delta FROM pairs WHERE abs(delta) > 0.001 ORDER BY abs(delta) DESC, id LIMIT 10")
def _(t):
    return rp.top_changes(pairs(t), 10).select("id", "delta")


@query("tk02_failures", "SELECT id, system_id, substring(concat('score was ', CAST(result AS VARCHAR), repeat(' because of reasons', 8)), 1, 80) AS feedback FROM v_results WHERE result = 'fail' ORDER BY id, system_id LIMIT 20")
def _(t):
    feedback = F.concat(F.lit("score was "), "result", F.repeat(F.lit(" because of reasons"), 8))
    return rp.failures(t.results.withColumn("feedback", feedback), 20, ["id", "system_id"], chars=80).select("id", "system_id", "feedback")


@query("tk05_largest_tags", "SELECT tag, count(*) AS total FROM v_results JOIN v_case_tags USING (id) GROUP BY tag")
def _(t):
    return rp.stats_by_tag(tagged_results(t)).orderBy(F.desc("total"), "tag").select("tag", "total")


# --- cost -------------------------------------------------------------------------------------------------

PRICED = """t AS (SELECT role, model, CAST(sum(input_tokens) AS BIGINT) AS tin, CAST(sum(coalesce(cached_tokens, 0)) AS BIGINT) AS tc, CAST(sum(output_tokens) AS BIGINT) AS tout FROM v_usage GROUP BY role, model),
       p AS (SELECT t.*, coalesce(input, 2.0) AS pin, CASE WHEN input IS NULL THEN 0.5 ELSE coalesce(cached_input, input) END AS pc, coalesce(output, 8.0) AS pout FROM t LEFT JOIN v_prices USING (model))"""


def prices(t):
    """Prices of three models with one cached price unknown; the other models fall to the defaults."""
    return t.spark.createDataFrame([("m0", 2.5, 0.25, 15.0), ("m1", 0.75, None, 4.5), ("m2", 0.2, 0.02, 1.25)],
                                   "model string, input double, cached_input double, output double")


@query("j13_price_usage", "SELECT u.id, u.role, u.model, u.input_tokens, coalesce(p.input, 2.0) AS price_in, CASE WHEN p.model IS NULL THEN 0.5 ELSE coalesce(p.cached_input, p.input) END AS price_cached, coalesce(p.output, 8.0) AS price_out FROM v_usage u LEFT JOIN v_prices p USING (model)")
def _(t):
    return rp.price_usage(t.usage, prices(t)).drop("output_tokens", "cached_tokens")


@query("agg09_usage_by_model", "SELECT model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(coalesce(cached_tokens, 0)) AS BIGINT) AS cached_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens FROM v_usage GROUP BY model")
def _(t):
    return rp.usage_by_model(t.usage)


@query("agg10_cost_rollup", f"WITH {PRICED} SELECT role, CAST(sum(tin) AS BIGINT) AS input_tokens, CAST(sum(tc) AS BIGINT) AS cached_tokens, CAST(sum(tout) AS BIGINT) AS output_tokens, {q.settled('sum(((tin - tc) * pin + tc * pc + tout * pout) / 1000000)')} AS cost FROM p GROUP BY role")
def _(t):
    return rp.cost_rollup(t.usage, prices(t))


@query("agg10_case_cost", f"""WITH b AS (SELECT id, CAST(sum(input_tokens) AS BIGINT) AS bt FROM v_usage WHERE model = 'm4' AND role = 'R' GROUP BY id),
       u AS (SELECT id, role, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tt, sum(((input_tokens - coalesce(cached_tokens, 0)) * coalesce(input, 2.0) + coalesce(cached_tokens, 0) * CASE WHEN input IS NULL THEN 0.5 ELSE coalesce(cached_input, input) END + output_tokens * coalesce(output, 8.0)) / 1000000) AS c FROM v_usage LEFT JOIN v_prices USING (model) GROUP BY id, role)
       SELECT u.id, CAST(sum(CASE WHEN role = 'R' THEN coalesce(b.bt, tt) ELSE tt END) AS BIGINT) AS total_tokens, {q.settled("sum(CASE WHEN role = 'R' AND b.bt IS NOT NULL THEN b.bt / 1000000.0::DOUBLE ELSE c END)")} AS cost FROM u LEFT JOIN b USING (id) GROUP BY u.id""")
def _(t):
    details = t.usage.where("model = 'm4' AND role = 'R'").groupBy("id").agg(F.sum("input_tokens").alias("tokens")).withColumn(
        "total_cost", F.col("tokens") / 1_000_000)
    return rp.case_cost(t.usage, prices(t), details, "R")


@query("agg11_estimate_cost", f"""WITH n AS (SELECT answer_type AS target, count(*) AS n_cases FROM v_cases GROUP BY 1),
       s AS (SELECT answer_type AS target, concat('m', CAST(min(id) AS VARCHAR)) AS model, 1200 AS ti, 400 AS tc, 300 AS tout, CASE WHEN answer_type = 'list' THEN NULL ELSE 7 END AS conc, CASE WHEN answer_type = 'text' THEN 0.03 END AS oh FROM v_cases GROUP BY answer_type)
       SELECT n.target, n_cases, {q.settled('n_cases * (((ti - tc) * coalesce(p.input, 2.0) + tc * CASE WHEN p.input IS NULL THEN 0.5 ELSE coalesce(p.cached_input, p.input) END + tout * coalesce(p.output, 8.0)) / 1000000 + coalesce(oh, 0.01::DOUBLE))')} AS cost, CAST(ceil(n_cases * 12 / coalesce(conc, 5)::DOUBLE) AS BIGINT) AS seconds
       FROM n JOIN s USING (target) LEFT JOIN v_prices p USING (model)""")
def _(t):
    spec = t.cases.groupBy(F.col("answer_type").alias("target")).agg(F.concat(F.lit("m"), F.min("id").cast("string")).alias("model")).selectExpr(
        "target", "model", "1200 AS input_tokens", "400 AS cached_tokens", "300 AS output_tokens", "IF(target = 'list', NULL, 7) AS concurrency",
        "IF(target = 'text', 0.03D, NULL) AS eval_overhead")
    return rp.estimate_cost(t.cases.withColumnRenamed("answer_type", "target"), spec, prices(t))


# --- runs and files -------------------------------------------------------------------------------------------


@query("w08_latest_run", "SELECT o_custkey AS benchmark, o_orderpriority AS dataset, max(o_orderkey) AS run FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) x WHERE rn = 1 GROUP BY 1, 2")
def _(t):
    runs = t.raw("orders").selectExpr("o_custkey AS benchmark", "o_orderpriority AS dataset", "o_orderdate AS finished", "o_orderkey AS run")
    return rp.latest_run(runs, ["benchmark", "dataset"], [F.desc("finished"), F.desc("run")]).select("benchmark", "dataset", "run")


@query("w05_first_users", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 7)")
def _(t):
    from scorelake.operators.cases import first_users_sample
    return first_users_sample(t.raw("events").select("event_id", "user_id"), 7)


@query("w04_stratified_sample", """SELECT id, difficulty FROM (SELECT id, difficulty, row_number() OVER (PARTITION BY difficulty ORDER BY md5(concat(CAST(id AS VARCHAR), '7')), id) AS rn FROM v_cases) x WHERE rn <= 100""")
def _(t):
    from scorelake.operators.cases import stratified_sample
    return stratified_sample(t.cases.select("id", "difficulty"), "difficulty", 100, 7)


@query("j12_longest_prefix", """WITH k AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS dataset FROM part UNION SELECT DISTINCT replace(p_name, ' ', '_') FROM part WHERE p_size > 25),
       n AS (SELECT p_partkey, concat(replace(p_name, ' ', '_'), '_', replace(p_brand, '#', '_')) AS name FROM part),
       m AS (SELECT n.name, k.dataset, row_number() OVER (PARTITION BY n.name ORDER BY length(k.dataset) DESC) AS rn FROM (SELECT DISTINCT name FROM n) n JOIN k ON n.name = k.dataset OR starts_with(n.name, k.dataset || '_'))
       SELECT n.p_partkey, n.name, coalesce(m.dataset, n.name) AS dataset, CASE WHEN m.dataset IS NOT NULL AND m.dataset <> n.name THEN substring(n.name, length(m.dataset) + 2) END AS label FROM n LEFT JOIN m ON m.name = n.name AND m.rn = 1""")
def _(t):
    part = t.raw("part")
    known = part.selectExpr("split_part(p_name, ' ', 1) AS dataset").unionByName(
        part.where("p_size > 25").selectExpr("replace(p_name, ' ', '_') AS dataset")).distinct()
    names = part.selectExpr("p_partkey", "concat(replace(p_name, ' ', '_'), '_', replace(p_brand, '#', '_')) AS name")
    return rp.longest_prefix(names, known)


@query("j14_changed_batches", """WITH r AS (SELECT o_custkey AS batch, md5(CAST(count(*) AS VARCHAR)) AS checksum FROM orders GROUP BY 1), l AS (SELECT o_custkey AS batch, md5(CAST(count(*) FILTER (o_totalprice > 20000) AS VARCHAR)) AS checksum FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice > 100000 GROUP BY 1)
       SELECT r.batch FROM r LEFT JOIN l USING (batch) WHERE l.checksum IS DISTINCT FROM r.checksum""")
def _(t):
    o = t.raw("orders").withColumnRenamed("o_custkey", "batch")
    remote = o.groupBy("batch").agg(F.md5(F.count(F.lit(1)).cast("string")).alias("checksum"))
    local = o.where("o_orderstatus <> 'P' OR o_totalprice > 100000").groupBy("batch").agg(
        F.md5(F.count_if(F.col("o_totalprice") > 20000).cast("string")).alias("checksum"))
    return rp.changed_batches(remote, local).select("batch")


@query("tk04_newest_first", "SELECT strftime(o_orderdate, '%Y%m%d') AS date, o_orderkey AS name FROM orders")
def _(t):
    index = t.raw("orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("date"), F.col("o_orderkey").alias("name"))
    return rp.newest_first(index)


RESCORED = f"{BY_TYPE}, pairs AS (SELECT t.id, c.answer_type, c.difficulty, 0.5::DOUBLE AS old_score, least(greatest(t.score, 0), 1) AS new_score, {q.settled('least(greatest(t.score, 0), 1) - 0.5')} AS delta FROM typed t JOIN v_cases c USING (id))"


@query("sc17_rescore", reeval_sql("true", RESCORED))
def _(t):
    from scorelake.operators.scoring import rescore
    stored = t.answers.join(t.cases.select("id", "answer_type", "difficulty", "expected_value"), "id").withColumn("score", F.lit(0.5))
    dialogue = stored.withColumn("replies", F.array("answer")).drop("answer")
    return rp.reeval_summary(rescore(dialogue))
