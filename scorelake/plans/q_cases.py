"""Case table queries: selection, JSON access, conversion, generation, ablation."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import ablation as ab
from scorelake.operators import cases as cs
from scorelake.plans import sqltext as q
from scorelake.plans.registry import query

# --- selection ---------------------------------------------------------------------------------


@query("prj01_filter_cases", "SELECT id FROM v_cases WHERE id IN (SELECT id FROM v_submitted) ORDER BY id DESC LIMIT 25")
def _(t):
    cases = t.cases.select("id", (-F.col("id")).alias("ord"))
    return cs.filter_cases(cases, t.submitted, 25).select("id")


@query("prj01_unmatched_ids", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_orderkey FROM orders) UNION SELECT c_custkey + 100000000 FROM customer")
def _(t):
    ids = t.raw("customer").selectExpr("explode(array(c_custkey, c_custkey + 100000000)) AS id")
    return cs.unmatched_filter_ids(t.cases, ids)


@query("prj02_get_case", "SELECT id, difficulty, expected_value FROM v_cases WHERE id = 77")
def _(t):
    return cs.get_case(t.cases, 77).select("id", "difficulty", "expected_value")


# --- JSON -----------------------------------------------------------------------------------------


def nested(t):
    """A nested document per event."""
    return t.raw("events").select("event_id", F.concat(
        F.lit('{"user": {"id": "u'), F.col("user_id"), F.lit('"}, "entries": [{"indicator": "'), "event_type",
        F.lit('", "tags": ["first", "'), "event_type", F.lit('"]}, {"indicator": "extra", "props": '), "props", F.lit('}]}')).alias("doc"))


@query("prj04_json_path", """SELECT event_id, '$.entries[0].indicator' AS path, event_type AS value FROM events UNION ALL SELECT event_id, '$.entries[1].indicator', 'extra' FROM events""")
def _(t):
    docs = nested(t).select("event_id", F.try_parse_json("doc").alias("doc"))
    return cs.json_path(docs, "doc", "$.entries.indicator", ["event_id"]).select(
        "event_id", "path", F.try_variant_get("value", "$", "string").alias("value"))


@query("prj04_json_path_index", """SELECT event_id, '$.entries[0].tags[1]' AS path, event_type AS value FROM events""")
def _(t):
    docs = nested(t).select("event_id", F.try_parse_json("doc").alias("doc"))
    return cs.json_path(docs, "doc", "entries[*].tags[-1]", ["event_id"]).select(
        "event_id", "path", F.try_variant_get("value", "$", "string").alias("value"))


@query("prj05_json_search", """SELECT event_id, '$.entries[0].indicator' AS path, 'value' AS match, event_type AS preview FROM events WHERE contains(event_type, 'p')
       UNION ALL SELECT event_id, '$.entries[0].tags[1]', 'value', event_type FROM events WHERE contains(event_type, 'p')
       UNION ALL SELECT event_id, '$.entries[1].props', 'key', replace(props, ' ', '') FROM events""")
def _(t):
    return cs.json_search(nested(t), "doc", "P", ["event_id"], preview=360)


@query("prj24_json_profile", """SELECT event_id, 'object' AS root_type, 'user|entries' AS top_keys, 2 AS key_count, NULL::INT AS length FROM events""")
def _(t):
    return cs.json_profile(nested(t), "doc", ["event_id"], keys=20).select(
        "event_id", "root_type", F.array_join("top_keys", "|").alias("top_keys"), "key_count", "length")


@query("prj10_resolve_refs", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN '["shared"]' WHEN o_orderstatus = 'O' THEN '{"$ref": "nobody"}' ELSE '{"own": 1}' END AS eval FROM orders""")
def _(t):
    cases = t.raw("orders").selectExpr("o_orderkey AS id", """CASE WHEN o_orderstatus = 'F' THEN '{"$ref": "AFRICA"}' WHEN o_orderstatus = 'O' THEN '{"$ref": "nobody"}' ELSE '{"own": 1}' END AS eval""")
    params = t.raw("region").selectExpr("r_name AS key", "'[\"shared\"]' AS value")
    return cs.resolve_refs(cases, params, "eval").select("id", "eval")


# --- publishing ---------------------------------------------------------------------------------------


@query("prj08_strip_answers", "SELECT id, answer_type, 'manual' AS user_type FROM v_cases")
def _(t):
    cases = t.cases.select(
        "id", F.struct("answer_type", "expected_value", F.lit("typed_qa").alias("evaluator")).alias("eval"),
        F.struct(F.lit("manual").alias("type"), F.col("user_id").alias("target_overrides")).alias("user"), "expected_value")
    published = cs.strip_answers(cases)
    return published.select("id", *[F.col(f"eval.{n}") for n in published.schema["eval"].dataType.names], F.col("user.type").alias("user_type"))


@query("prj09_anonymise_ids", """SELECT e.event_id, coalesce(c.c_name, CAST(e.user_id AS VARCHAR)) AS user_id, concat(coalesce(c.c_name, CAST(e.user_id AS VARCHAR)), '_Q', CAST(e.event_id AS VARCHAR)) AS id
       FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY') c ON c.c_custkey = e.user_id""")
def _(t):
    rows = t.raw("events").select("event_id", "user_id", F.concat(F.col("user_id").cast("string"), F.lit("_Q"), F.col("event_id").cast("string")).alias("id"))
    mapping = t.raw("customer").where("c_mktsegment = 'MACHINERY'").selectExpr("c_custkey AS raw_id", "c_name AS new_id")
    return cs.anonymise_ids(rows, mapping)


@query("prj11_resolve_overrides", """SELECT id, coalesce(CASE WHEN status_tag = 'F' THEN concat('m-', difficulty) WHEN status_tag = 'O' THEN 'sib' END, 'm-default') AS model, '9' AS top_k,
       CASE WHEN status_tag = 'P' THEN concat('u', CAST(user_id AS VARCHAR)) END AS email, CASE WHEN status_tag = 'P' THEN '' ELSE 'email' END AS missing FROM v_cases""")
def _(t):
    cases = t.cases.select("id", F.expr("""CASE status_tag WHEN 'F' THEN map('main', map('model', concat('m-', difficulty), 'top_k', NULL))
        WHEN 'O' THEN map('sibling', map('model', 'sib')) ELSE map('chat', map('address', concat('u', CAST(user_id AS STRING)))) END""").alias("target_overrides"))
    spec = {"model": {"default": "m-default", "editable": False}, "top_k": {"default": 5, "editable": True}, "email": {"required": True}}
    out = cs.resolve_overrides(cases, "main", spec, {"model": "ignored", "top_k": 9}, ["sibling"], [("chat", "address", "email")])
    return out.select("id", F.col("effective")["model"].alias("model"), F.col("effective")["top_k"].alias("top_k"),
                      F.try_element_at("effective", F.lit("email")).alias("email"), F.array_join("missing_fields", "|").alias("missing"))


@query("prj14_bounded_sql", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    from scorelake.operators.adhoc import bounded_sql
    return bounded_sql(t.spark, "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY 1", {"orders": t.raw("orders")}, 200, 300).drop("truncated")


@query("prj15_target_label", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'eval-only' WHEN o_orderstatus = 'F' THEN concat('api_', replace(concat('v/', o_orderpriority), '/', '-'), '_k10') ELSE 'api_expert' END AS label FROM orders""")
def _(t):
    o = t.raw("orders").selectExpr("o_orderkey AS id", "IF(o_orderstatus = 'P', NULL, 'api') AS type", "IF(o_orderstatus = 'F', concat('v/', o_orderpriority), NULL) AS model",
                                   "IF(o_orderstatus = 'O', 'expert', NULL) AS agent", "IF(o_orderstatus = 'F', 10, NULL) AS top_k")
    return o.select("id", cs.target_label(F.col("type"), F.col("model"), F.col("agent"), F.col("top_k")).alias("label"))


# --- conversions ------------------------------------------------------------------------------------------


@query("prj16_queries_to_cases", """SELECT CASE WHEN event_id % 2 = 0 THEN concat('user', CAST(user_id AS VARCHAR), '_AT_demo_Q', CAST(event_id AS VARCHAR)) ELSE concat('x', CAST(event_id AS VARCHAR), '_Q1') END AS id,
       concat('[', CASE event_type WHEN 'click' THEN 'direct' WHEN 'view' THEN 'multi_hop' ELSE 'hard' END, '] ', substring(concat('What was ', event_type, ' of user ', CAST(user_id AS VARCHAR), ' on the given day and why did it change?'), 1, 60)) AS title,
       CASE event_type WHEN 'click' THEN 'numeric_value' WHEN 'view' THEN 'boolean' ELSE 'list' END AS answer_type FROM events""")
def _(t):
    queries = t.raw("events").selectExpr(
        "IF(event_id % 2 = 0, concat(CAST(user_id AS STRING), '_Q', CAST(event_id AS STRING)), concat('x', CAST(event_id AS STRING), '_Q1')) AS query_id",
        "concat('user', CAST(user_id AS STRING), '@demo') AS user_email",
        "concat('What was ', event_type, ' of user ', CAST(user_id AS STRING), ' on the given day and why did it change?') AS query_text",
        "CASE event_type WHEN 'click' THEN 'basic' WHEN 'view' THEN 'advanced' ELSE 'hard' END AS difficulty",
        "CASE event_type WHEN 'click' THEN 'number' WHEN 'view' THEN 'bool' ELSE 'list' END AS answer_type", "CAST(value AS STRING) AS expected_value")
    return cs.queries_to_cases(queries, title_chars=60).select("id", "title", "answer_type")


@query("prj17_rubric_to_cases", """WITH u AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'user' GROUP BY conv_id)
       SELECT concat('hb_', CAST(c.conv_id AS VARCHAR)) AS id, concat('Rubric — t', CAST(c.conv_id % 3 AS VARCHAR)) AS title, md5(max(CASE WHEN c.turn = u.last THEN c.text END)) AS input, count(*) FILTER (c.turn < u.last AND c.text <> '') AS n_history
       FROM conversations c JOIN u USING (conv_id) GROUP BY c.conv_id""")
def _(t):
    msgs = t.turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    entries = msgs.select(
        F.col("conv_id").cast("string").alias("prompt_id"), F.array(F.concat(F.lit("theme:t"), F.col("conv_id") % 3)).alias("example_tags"),
        F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("prompt"),
        F.array(F.struct(F.lit("c").alias("criterion"), F.lit(1).alias("points"))).alias("rubrics"))
    return cs.rubric_to_cases(entries).select("id", "title", F.md5("input").alias("input"), F.size("history").cast("bigint").alias("n_history"))


@query("prj18_calculator_to_cases", f"""WITH r AS (SELECT p_partkey, p_size, p_type, p_brand, p_name, CASE WHEN p_size = 1 THEN 'weeks_days' WHEN p_type = 'ECONOMY' THEN 'decimal' WHEN p_type = 'PROMO' THEN 'date' WHEN p_type = 'STANDARD' THEN 'decimal' ELSE 'integer' END AS output_type FROM part)
       SELECT concat('mc_', CAST(p_partkey AS VARCHAR)) AS id, output_type, concat('calculator:', lower(replace(replace(p_brand, '#', '_'), ' ', '_')), '|category:', lower(replace(p_name, ' ', '_')), '|output_type:', output_type) AS tags FROM r
       WHERE p_size <> 2 AND NOT (output_type = 'decimal' AND p_size = 3)""")
def _(t):
    rows = t.raw("part").selectExpr(
        "p_partkey AS row_number", "IF(p_size = 1, 69, 5) AS calculator_id", "p_brand AS calculator_name", "p_name AS category",
        "IF(p_type = 'ECONOMY', ' Decimal ', '') AS output_type", "IF(p_size = 2, ' ', 'note') AS patient_note", "'q?' AS question",
        "CASE p_type WHEN 'PROMO' THEN '1/2/2020' WHEN 'STANDARD' THEN '1.5' ELSE '7' END AS ground_truth", "IF(p_size = 3, NULL, '1') AS lower_limit", "'2' AS upper_limit")
    return cs.calculator_to_cases(rows).select("id", "output_type", F.array_join("tags", "|").alias("tags"))


def profiles(t):
    """Profiles from customers: age, gender and occupation follow from the columns."""
    return t.raw("customer").selectExpr(
        "concat('obesity_', CAST(c_custkey AS STRING)) AS profile_id", "CAST(20 + c_nationkey * 2 AS INT) AS age",
        "IF(c_acctbal > 3000, 'male', 'female') AS gender", "CASE c_mktsegment WHEN 'MACHINERY' THEN '工程师' WHEN 'HOUSEHOLD' THEN '司机' WHEN 'BUILDING' THEN '研究生' ELSE '' END AS occupation",
        "CAST(c_nationkey + 20 AS STRING) AS bmi", "IF(c_nationkey > 12, array('高血压', '脂肪肝'), CAST(array() AS ARRAY<STRING>)) AS comorbidities",
        "c_mktsegment AS motivation", "IF(c_acctbal < 0, 'in debt', NULL) AS background")


PROFILES = """p AS (SELECT concat('obesity_', CAST(c_custkey AS VARCHAR)) AS profile_id, CAST(20 + c_nationkey * 2 AS INT) AS age, CASE WHEN c_acctbal > 3000 THEN 'male' ELSE 'female' END AS gender,
       CASE c_mktsegment WHEN 'MACHINERY' THEN '工程师' WHEN 'HOUSEHOLD' THEN '司机' WHEN 'BUILDING' THEN '研究生' ELSE '' END AS occupation, CAST(c_nationkey + 20 AS VARCHAR) AS bmi, c_nationkey, c_mktsegment AS motivation, CASE WHEN c_acctbal < 0 THEN 'in debt' END AS background FROM customer)"""


@query("prj19_build_context", f"""WITH {PROFILES} SELECT profile_id, concat(CASE WHEN occupation <> '' THEN concat('你是一位', age, '岁的', CASE gender WHEN 'male' THEN '男性' ELSE '女性' END, '，职业是', occupation, '，BMI ', bmi, '。') ELSE '' END,
       CASE WHEN c_nationkey > 12 THEN '合并症：高血压、脂肪肝。' ELSE '' END, '减肥动机：', motivation, '。', coalesce(background, ''), chr(10), chr(10), '你的说话风格：', 'x') AS context FROM p""")
def _(t):
    return profiles(t).select("profile_id", cs.build_context(F.lit("x")).alias("context"))


@query("prj20_reply_text", """SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant' AND text <> '') AS reply FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0""")
def _(t):
    msgs = t.turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    reaction = msgs.where(F.exists("m", lambda x: x["role"] == "assistant")).select("conv_id", F.transform("m", lambda x: F.struct(
        F.when(x["role"] != "assistant", F.lit("annotation")).alias("type"), x["text"].alias("content"))).alias("messages"))
    return reaction.select("conv_id", cs.reply_text(F.lit("message"), F.col("messages")).alias("reply"))


@query("prj21_append_hint", "SELECT p_partkey, concat(p_brand, '|', p_name, CASE WHEN p_size > 10 THEN ' (short)' ELSE '' END) AS inputs FROM part")
def _(t):
    hint = F.when(F.col("p_size") > 10, F.lit(" (short)"))
    return t.raw("part").select("p_partkey", F.array_join(cs.append_hint(F.array("p_brand", "p_name"), hint), "|").alias("inputs"))


@query("prj22_judge_batch", """SELECT a.id, concat('Expected: ', expected_value, chr(10), 'Answer: ', answer, CASE WHEN difficulty < '3' THEN concat(chr(10), chr(10), '- be brief', CASE WHEN status_tag = 'F' THEN concat(chr(10), '- be kind') ELSE '' END) WHEN status_tag = 'F' THEN concat(chr(10), chr(10), '- be kind') ELSE '' END) AS prompt
       FROM v_answers a JOIN v_cases c USING (id)""")
def _(t):
    cases = t.answers.join(t.cases, "id")
    persona = cases.select("id", F.explode(F.expr("array(named_struct('dim', 'a', 'level', substring(difficulty, 1, 1)), named_struct('dim', 'b', 'level', status_tag))")).alias("p")).select("id", "p.*")
    criteria = t.raw("region").selectExpr("stack(3, 'a', '1', 'be brief', 'a', '2', 'be brief', 'b', 'F', 'be kind') AS (dim, level, fragment)").distinct()
    return cs.judge_batch(cases, "Expected: {expected_value}\nAnswer: {answer}", ["expected_value", "answer"], persona, criteria)


@query("prj23_case_summaries", """SELECT id, substring(CASE WHEN status_tag = 'F' THEN concat('Title ', repeat(difficulty, 20)) WHEN status_tag = 'O' THEN 'first input' ELSE 'goal' END, 1, 100) AS title, 'manual' AS user_type, CASE WHEN status_tag = 'P' THEN '' ELSE 'api' END AS target_type, answer_type AS evaluator FROM v_cases""")
def _(t):
    cases = t.cases.selectExpr(
        "id", "IF(status_tag = 'F', concat('Title ', repeat(difficulty, 20)), '') AS title", "IF(status_tag = 'O', array('first input'), CAST(array() AS ARRAY<STRING>)) AS strict_inputs",
        "'goal' AS goal", "'manual' AS user_type", "IF(status_tag = 'P', CAST(map() AS MAP<STRING,STRING>), map('api', 'x')) AS target_overrides", "answer_type AS evaluator")
    return cs.case_summaries(cases, title_chars=100)


@query("prj25_normalize_legacy", """SELECT conv_id, string_agg(CASE WHEN turn = 6 THEN '?' ELSE role END, ',' ORDER BY turn) AS roles, CASE WHEN max(turn) >= 6 THEN 'unknown message role' END AS error FROM conversations GROUP BY conv_id""")
def _(t):
    msgs = t.turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    legacy = msgs.select("conv_id", F.transform("m", lambda x: F.struct(
        F.when(x["turn"] == 6, F.lit("robot")).when(x["turn"] < 3, x["role"]).alias("role"),
        F.when(x["role"] == "user", F.lit("human")).when(x["role"] == "assistant", F.lit("ai")).otherwise(x["role"]).alias("type"),
        x["text"].alias("content"))).alias("history"))
    return cs.normalize_legacy(legacy).select(
        "conv_id", F.array_join(F.transform("history", lambda h: F.coalesce(h["role"], F.lit("?"))), ",").alias("roles"), "error")


@query("w01_pair_turns", """SELECT conv_id, turn, user_text, assistant_text FROM (SELECT conv_id, turn, role, text AS user_text, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS assistant_text FROM (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN turn * 2 ELSE turn END AS turn, role, text FROM conversations) c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) x WHERE role = 'user'""")
def _(t):
    return cs.pair_turns(t.turns.withColumn("turn", F.expr("IF(conv_id % 3 = 0, turn * 2, turn)")))


@query("w09_keep_first", r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS ws FROM documents),
       w AS (SELECT doc_id, unnest(ws) AS item, generate_subscripts(ws, 1) AS pos FROM s),
       f AS (SELECT doc_id, lower(item) AS k, min(pos) AS pos, arg_min(item, pos) AS item FROM w WHERE length(lower(item)) >= 2 GROUP BY ALL)
       SELECT doc_id, count(*) AS n, md5(string_agg(item, ' ' ORDER BY pos)) AS h FROM f GROUP BY doc_id""")
def _(t):
    from scorelake.functions.text import keep_first
    words = t.raw("documents").select("doc_id", keep_first(F.split(F.regexp_replace("text", r"\s+", " "), " ")).alias("items"))
    return words.where(F.size("items") > 0).select("doc_id", F.size("items").cast("bigint").alias("n"), F.md5(F.array_join("items", " ")).alias("h"))


# --- generation --------------------------------------------------------------------------------------------


def persona_sql(dim: str) -> str:
    a, b, c = cs.PERSONA_LEVELS[dim]
    u = q.uniform("profile_id", q.lit(dim), "42")
    return f"CASE WHEN {u} < 0.5 THEN '{a}' WHEN {u} < 0.8 THEN '{b}' ELSE '{c}' END"


PERSONAS = ", ".join(f"{persona_sql(d)} AS {d}" for d in cs.PERSONA_LEVELS)


@query("gen01_assign_persona", f"WITH {PROFILES} SELECT profile_id, {PERSONAS} FROM p")
def _(t):
    return cs.assign_persona(profiles(t), 42).select("profile_id", *cs.PERSONA_LEVELS)


def style_sql() -> str:
    young, middle, old = "age <= 28", "age > 28 AND age <= 45", "age > 45"
    knows, hands, learns = (q.contains_any("occupation", w) for w in (cs.KNOWLEDGE_JOBS, cs.MANUAL_JOBS, cs.STUDENT_JOBS))
    w = lambda *rules: "(" + " * ".join(["1.0::DOUBLE"] + [f"CASE WHEN {c} THEN {f}.0::DOUBLE ELSE 1.0::DOUBLE END" for c, f in rules]) + ")"
    ws = [w((young, 3), (learns, 2)), w((middle, 3)), w((old, 3)), w((middle, 2), (knows, 2)), w((hands, 2)), w((young, 2)), w((young, 2), (learns, 2)), w((old, 2))]
    cols = ", ".join(f"{x} AS w{i}" for i, x in enumerate(ws))
    u = f"{q.uniform('profile_id', q.lit('style'), '42')} * ({' + '.join(f'w{i}' for i in range(8))})"
    cases = " ".join(f"WHEN {u} < {' + '.join(f'w{j}' for j in range(i + 1))} THEN '{s}'" for i, s in enumerate(cs.STYLES[:-1]))
    return f"WITH {PROFILES}, w AS (SELECT profile_id, {cols} FROM p) SELECT profile_id, CASE {cases} ELSE '{cs.STYLES[-1]}' END AS style FROM w"


@query("gen02_assign_style", style_sql())
def _(t):
    return cs.assign_style(profiles(t), 42).select("profile_id", "style")


OPENINGS = [("01", "你好"), ("02", "最近睡得怎么样？"), ("03", "想聊聊体重吗？")]
MOVED = ", ".join(f"CASE WHEN {d} <> '{levels[0]}' THEN {d} END" for d, levels in cs.PERSONA_LEVELS.items())


@query("j10_cross_cases", f"WITH {PROFILES} SELECT profile_id, opening_id FROM p, (VALUES ('01'), ('02'), ('03')) o(opening_id)")
def _(t):
    return cs.cross_cases(profiles(t), OPENINGS).select("profile_id", "opening_id")


@query("gen03_generate_cases", f"""WITH {PROFILES}, g AS (SELECT *, {PERSONAS} FROM p), o AS (SELECT * FROM (VALUES ('01'), ('02'), ('03')) o(opening_id)),
       m AS (SELECT *, list_filter([{MOVED}], lambda x: x IS NOT NULL) AS moved FROM g, o)
       SELECT concat('vu_o', opening_id, '_', replace(profile_id, 'obesity_', 'p')) AS id, concat('开场白', opening_id, ' × ', age, '岁', CASE gender WHEN 'male' THEN '男' ELSE '女' END, 'BMI', bmi, CASE WHEN len(moved) > 0 THEN concat(' [', array_to_string(moved, '/'), ']') ELSE '' END) AS title,
       concat_ws('|', concat('opening:', opening_id), concat('profile:', profile_id), {', '.join(f"concat('{d}:', {d})" for d in cs.PERSONA_LEVELS)}) AS tags FROM m""")
def _(t):
    return cs.generate_cases(profiles(t), OPENINGS).select("id", "title", F.array_join("tags", "|").alias("tags"))


# --- ablation ------------------------------------------------------------------------------------------------

DAYS = f"""d AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY {q.uniform('user_id', 'day', '11')}, day) AS rk, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT DISTINCT user_id, day FROM v_readings) x)"""
GAUSS = f"(sqrt(-2.0 * ln(1.0 - {q.uniform('reading_id', '11', q.lit('a'))})) * cos(2.0 * pi() * {q.uniform('reading_id', '11', q.lit('b'))}))"


@query("gen04_perturb_delete", f"WITH {DAYS} SELECT r.reading_id, r.user_id, r.value_num FROM v_readings r JOIN d USING (user_id, day) WHERE d.rk > floor(d.n * 0.2)")
def _(t):
    return ab.perturb_delete(t.readings, 0.2, 11).select("reading_id", "user_id", "value_num")


@query("gen05_perturb_noise", f"SELECT reading_id, CASE WHEN value_num = 0 THEN value_num ELSE {q.settled(f'value_num * (1 + 0.1 * {GAUSS})')} END AS value_num FROM v_readings")
def _(t):
    return ab.perturb_noise(t.readings, 0.1, 11).select("reading_id", "value_num")


KINDS = ["device_timeseries", "event_window_peak_value", "event_window_min_value", "event_window_median_value", "event_window_stddev_value",
         "event_window_range", "event_window_peak_date", "peak_date", "two_window_delta", "three_phase_means", "device", "device_day_to_indicators", "untouched_kind"]


def truth_queries(t):
    """One query of every kind per window of the readings."""
    kinds = F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind")
    w = t.windows.select("user_id", "indicator", "start_date", kinds)

    def rng(role: str, lo: int, hi: int):
        return F.struct(F.lit(role).alias("role"), F.date_add("start_date", lo).alias("start_date"), F.date_add("start_date", hi).alias("end_date"))

    ranges = (F.when(F.col("kind") == "two_window_delta", F.array(rng("window1", 0, 6), rng("window2", 7, 13)))
              .when(F.col("kind") == "three_phase_means", F.array(rng("pre", 0, 4), rng("during", 5, 9), rng("post", 10, 14)))
              .otherwise(F.array(rng("range", 0, 13))))
    return w.select(F.concat_ws("-", "user_id", "indicator", "kind").alias("query_id"), "user_id", "indicator", "kind",
                    F.date_add("start_date", 3).alias("day"), F.lit(None).cast("string").alias("group_filter"), ranges.alias("ranges"))


def truth_sql(readings: str, variant: str) -> str:
    """CTE chain ending in `truth` (variant, query_id, expected, n_points, unanswerable)."""
    s = q.settled
    f = lambda lo, hi: f"FILTER (day BETWEEN s + {lo} AND s + {hi})"
    return f"""base AS (SELECT v.variant, w.user_id, w.indicator, w.start_date AS s FROM v_windows w, (SELECT DISTINCT {variant} AS variant FROM {readings}) v),
    j AS (SELECT b.*, r.day, r.value_num AS v, max(CASE WHEN r.day <= b.s + 13 THEN r.value_num END) OVER (PARTITION BY b.variant, b.user_id, b.indicator) AS mx FROM base b
          LEFT JOIN {readings} r ON r.user_id = b.user_id AND r.indicator = b.indicator AND {variant.replace('variant', 'r.variant')} = b.variant AND r.day BETWEEN b.s AND b.s + 14),
    st AS (SELECT variant, user_id, indicator, s, count(v) {f(0, 13)} AS n, avg(v) {f(0, 13)} AS mean, max(v) {f(0, 13)} AS mx, min(v) {f(0, 13)} AS mn, quantile_cont(v, 0.5) {f(0, 13)} AS med,
          coalesce(stddev_samp(v) {f(0, 13)}, 0) AS sd, min(day) FILTER (v = mx AND day <= s + 13) AS peak, avg(v) {f(0, 6)} AS w1, avg(v) {f(7, 13)} AS w2, avg(v) {f(0, 4)} AS pre, avg(v) {f(5, 9)} AS during, avg(v) {f(10, 14)} AS post
          FROM j GROUP BY variant, user_id, indicator, s),
    dayv AS (SELECT {variant} AS variant, user_id, day, indicator, max({{'t': time, 'v': value_num}}).v AS v FROM {readings} GROUP BY ALL),
    dayn AS (SELECT variant, user_id, day, string_agg(indicator, ';' ORDER BY indicator) AS names FROM dayv GROUP BY ALL),
    nums AS (SELECT variant, user_id, indicator, k.kind, n, CASE k.kind WHEN 'device_timeseries' THEN {s('mean')} WHEN 'event_window_peak_value' THEN round(mx, 4) WHEN 'event_window_min_value' THEN round(mn, 4)
          WHEN 'event_window_median_value' THEN {s('med')} WHEN 'event_window_stddev_value' THEN CASE WHEN n > 0 THEN {s('sd')} END WHEN 'event_window_range' THEN {s('mx - mn')} END AS x
          FROM st, (SELECT unnest(['device_timeseries','event_window_peak_value','event_window_min_value','event_window_median_value','event_window_stddev_value','event_window_range']) AS kind) k),
    truth AS (SELECT variant, concat_ws('-', user_id, indicator, kind) AS query_id, CAST(x AS VARCHAR) AS expected, n AS n_points, x IS NULL AS unanswerable FROM nums
      UNION ALL SELECT variant, concat_ws('-', user_id, indicator, k.kind), CAST(peak AS VARCHAR), n, n = 0 FROM st, (SELECT unnest(['event_window_peak_date','peak_date']) AS kind) k
      UNION ALL SELECT variant, concat_ws('-', user_id, indicator, 'two_window_delta'), CAST({s('w2 - w1')} AS VARCHAR), NULL, w1 IS NULL OR w2 IS NULL FROM st
      UNION ALL SELECT variant, concat_ws('-', user_id, indicator, 'three_phase_means'), CASE WHEN pre IS NOT NULL AND during IS NOT NULL AND post IS NOT NULL THEN concat('[', {s('pre')}, ',', {s('during')}, ',', {s('post')}, ']') END, NULL, pre IS NULL OR during IS NULL OR post IS NULL FROM st
      UNION ALL SELECT b.variant, concat_ws('-', b.user_id, b.indicator, 'device'), CAST({s('d.v')} AS VARCHAR), NULL, d.v IS NULL FROM base b LEFT JOIN dayv d ON d.variant = b.variant AND d.user_id = b.user_id AND d.indicator = b.indicator AND d.day = b.s + 3
      UNION ALL SELECT b.variant, concat_ws('-', b.user_id, b.indicator, 'device_day_to_indicators'), coalesce(d.names, ''), NULL, d.names IS NULL FROM base b LEFT JOIN dayn d ON d.variant = b.variant AND d.user_id = b.user_id AND d.day = b.s + 3)"""


@query("agg21_recompute_truth", f"WITH r0 AS (SELECT 'none' AS variant, * FROM v_readings), {truth_sql('r0', 'variant')} SELECT query_id, expected, n_points, unanswerable FROM truth")
def _(t):
    truth = ab.recompute_truth(truth_queries(t), t.readings)
    return truth.select("query_id", ab.expected_text(truth).alias("expected"), "n_points", "unanswerable")


VARIED = f"""{DAYS}, r0 AS (SELECT vr.variant, r.reading_id, r.user_id, r.day, r.time, r.indicator, CASE WHEN vr.kind = 'noise' AND r.value_num <> 0 THEN {q.settled(f'r.value_num * (1 + vr.param * {GAUSS})')} ELSE r.value_num END AS value_num
       FROM v_readings r JOIN d USING (user_id, day), (VALUES ('del10pct','delete',0.1::DOUBLE),('del20pct','delete',0.2::DOUBLE),('del30pct','delete',0.3::DOUBLE),('noise10pct','noise',0.1::DOUBLE),('noise20pct','noise',0.2::DOUBLE)) vr(variant, kind, param)
       WHERE vr.kind = 'noise' OR d.rk > floor(d.n * vr.param))"""


def ablated(t):
    queries = truth_queries(t)
    cases = queries.select(F.col("query_id").alias("id"), F.lit("old").alias("expected_value"), F.array(F.lit("n_points: 99"), F.lit("other")).alias("key_points"))
    return ab.ablate(cases, queries, t.readings, 11)


@query("gen06_ablate", f"WITH {VARIED}, {truth_sql('r0', 'variant')} SELECT variant, query_id AS id, expected AS expected_value, unanswerable, concat(CASE WHEN n_points IS NULL THEN 'n_points: 99' ELSE concat('n_points: ', n_points) END, '|other') AS key_points FROM truth")
def _(t):
    return ablated(t).where("patched").select("variant", "id", "expected_value", "unanswerable", F.array_join("key_points", "|").alias("key_points"))


@query("agg22_perturb_stats", f"""WITH {VARIED}, {truth_sql('r0', 'variant')} SELECT variant, count(*) + (SELECT count(*) FROM v_windows) AS total, count(*) AS n_patched, count(*) FILTER (unanswerable) AS n_unanswerable, (SELECT count(*) FROM v_windows) AS n_unchanged FROM truth GROUP BY variant""")
def _(t):
    queries = truth_queries(t)
    return ab.truth_stats(ab.ablation_truth(queries, t.readings, 11), queries.select(F.col("query_id").alias("id")))


@query("j05_apply_patches", """SELECT id, CASE WHEN a.id IS NOT NULL THEN 'new' ELSE expected_value END AS expected_value, coalesce(length(answer) > 20, false) AS unanswerable, CASE WHEN a.id IS NOT NULL THEN concat('n_points: ', length(answer)) ELSE 'n_points: ?' END AS key_points FROM v_cases c LEFT JOIN v_submitted a USING (id)""")
def _(t):
    cases = t.cases.select("id", "expected_value", F.array(F.lit("first"), F.lit("n_points: ?")).alias("key_points"))
    patches = t.submitted.selectExpr("id", "'new' AS expected_value", "length(answer) AS n_points", "length(answer) > 20 AS unanswerable", "'gone' AS reason")
    return ab.apply_patches(cases, patches).select("id", "expected_value", "unanswerable", F.col("key_points")[1].alias("key_points"))


@query("udf02_recompute_registry", f"""WITH r0 AS (SELECT 'none' AS variant, * FROM v_readings), {truth_sql('r0', 'variant')},
       k AS (SELECT unnest(['""" + "','".join(KINDS[:-1]) + """']) AS kind) SELECT kind, count(*) AS n, count(*) FILTER (unanswerable) AS n_unanswerable, md5(string_agg(concat(query_id, '=', coalesce(expected, '')), ';' ORDER BY query_id)) AS h
       FROM truth JOIN k ON ends_with(query_id, '-' || kind) GROUP BY kind""")
def _(t):
    truth = ab.recompute_truth(truth_queries(t), t.readings).where(F.col("kind").isin(ab.recompute_kinds()))
    line = F.concat("query_id", F.lit("="), F.coalesce(ab.expected_text(truth), F.lit("")))
    return truth.select("kind", "unanswerable", F.struct("query_id", line.alias("l")).alias("s")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("unanswerable").alias("n_unanswerable"),
        F.md5(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["l"]), ";")).alias("h"))
