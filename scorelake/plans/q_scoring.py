"""Scoring queries: rule scorers, typed answers, verdict aggregation, dialogue text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.functions.numbers import settled
from scorelake.operators import scoring as sc
from scorelake.plans import sqltext as q
from scorelake.plans.flagship import score_submission
from scorelake.plans.registry import query

# --- oracle pieces --------------------------------------------------------------------------

NUMERIC_SCORE = """CASE WHEN len(std) = 0 THEN kw_ratio WHEN hits = len(std) THEN 1.0::DOUBLE
    WHEN status = 'data_not_found' THEN 0.0::DOUBLE WHEN hits > 0 THEN hits / len(std)::DOUBLE
    WHEN len(gen) > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END"""


def numeric_ctes(source: str) -> str:
    """CTE chain n1..n4 over a relation with id, answer, expected_value."""
    fallback = q.ratio("gnorm", "sterms")
    return f"""
    n1 AS (SELECT *, {q.answer_line('answer')} AS al, {q.data_status('answer')} AS status,
           {q.numbers('expected_value')} AS std, {q.normalize('answer')} AS gnorm,
           {q.terms(q.normalize('expected_value'))} AS sterms FROM {source}),
    n2 AS (SELECT *, {q.numbers('coalesce(al, answer)')} AS near, {fallback} AS kw_ratio FROM n1),
    n3 AS (SELECT *, CASE WHEN al IS NOT NULL AND len(near) = 0 AND len(std) > 0 THEN {q.numbers('answer')} ELSE near END AS gen FROM n2),
    n4 AS (SELECT *, len(list_filter(std, lambda s: len(list_filter(gen, lambda g: {q.close_numbers('s', 'g', '0.01')})) > 0)) AS hits FROM n3)"""


def boolean_score(answer: str, expected: str) -> str:
    text = f"lower(coalesce({q.answer_line(answer)}, {answer}))"
    pos, neg = q.word_hits(text, sc.POSITIVE_SIGNALS), q.word_hits(text, sc.NEGATIVE_SIGNALS)
    yes = ", ".join(q.lit(w) for w in sc.TRUE_WORDS)
    return (f"CASE WHEN {pos} = 0 AND {neg} = 0 THEN 0.0::DOUBLE WHEN ({pos} > {neg}) = (lower(trim({expected})) IN ({yes}))"
            " THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")


def list_ctes(source: str) -> str:
    """CTE chain l1..l5 with f1; items split on semicolons."""
    found = lambda norm: f"len(list_filter(terms, lambda t: {q.ratio(norm, 't')} >= 0.4))"
    items = q.stripped_list("string_split(expected_value, chr(59))")
    right = f"len(list_filter(gitems, lambda g: len(list_filter(terms, lambda t: {q.ratio('g', 't')} >= 0.4)) > 0))"
    return f"""
    l1 AS (SELECT *, {q.answer_line('answer')} AS al, list_transform({items}, lambda e: {q.terms(q.normalize('e'))}) AS terms FROM {source}),
    l2 AS (SELECT *, {q.normalize('coalesce(al, answer)')} AS norm, {q.normalize('answer')} AS fullnorm FROM l1),
    l3 AS (SELECT *, {found('norm')} AS f1, {found('fullnorm')} AS f2 FROM l2),
    l4 AS (SELECT *, CASE WHEN al IS NOT NULL AND f1 = 0 THEN f2 ELSE f1 END / len(terms)::DOUBLE AS recall,
           CASE WHEN al IS NULL OR f1 = 0 THEN answer ELSE al END AS ev FROM l3),
    l5 AS (SELECT *, {q.response_items('ev')} AS raw_items FROM l4),
    l6 AS (SELECT *, list_transform({q.keep_first('raw_items')}, lambda m: {q.normalize('m')}) AS gitems FROM l5),
    l7 AS (SELECT *, CASE WHEN len(gitems) > 0 THEN {right} / len(gitems)::DOUBLE ELSE recall END AS prec FROM l6),
    l8 AS (SELECT *, CASE WHEN prec + recall > 0 THEN 2 * prec * recall / (prec + recall) ELSE 0.0::DOUBLE END AS f1score FROM l7)"""


ANSWERED = "ans AS (SELECT c.id, c.answer_type, c.difficulty, c.expected_value, a.answer FROM v_answers a JOIN v_cases c ON a.id = c.id)"
LISTED = """ans AS (SELECT doc_id AS id, text AS answer, concat(source, ';', lang, '; the of and;', substring(text, 1, 12)) AS expected_value FROM documents)"""


def answered(t):
    return t.answers.join(t.cases.select("id", "answer_type", "difficulty", "expected_value"), "id")


def scored(df):
    return df.select("id", "result", F.round("score", 6).alias("score"))


@query("sc01_score_numeric", f"WITH {ANSWERED}, {numeric_ctes('ans')} SELECT id, 'scored' AS result, round({NUMERIC_SCORE}, 6) AS score FROM n4")
def _(t):
    return scored(sc.score_numeric(answered(t)))


@query("sc02_score_boolean", f"""WITH b AS (SELECT conv_id, turn, text AS answer, CASE WHEN role = 'user' THEN 'Yes' ELSE 'no' END AS expected_value FROM v_turns
       UNION ALL SELECT id + 1000000, 0, answer, 'true' FROM v_answers)
       SELECT conv_id, turn, 'scored' AS result, {boolean_score('answer', 'expected_value')} AS score FROM b""")
def _(t):
    spoken = t.turns.selectExpr("conv_id", "turn", "text AS answer", "CASE WHEN role = 'user' THEN 'Yes' ELSE 'no' END AS expected_value")
    given = t.answers.selectExpr("id + 1000000 AS conv_id", "0L AS turn", "answer", "'true' AS expected_value")
    return sc.score_boolean(spoken.unionByName(given)).select("conv_id", "turn", "result", "score")


@query("sc03_score_list", f"WITH {LISTED}, {list_ctes('ans')} SELECT id, 'scored' AS result, round(f1score, 6) AS score FROM l8")
def _(t):
    d = t.raw("documents").selectExpr(
        "doc_id AS id", "text AS answer", "concat(source, ';', lang, '; the of and;', substring(text, 1, 12)) AS expected_value")
    # A file with one row group is one task, however many rows it has.
    return scored(sc.score_list(d.repartition("id", "answer")))


@query("sc04_score_text_rule", f"""WITH {ANSWERED}, k AS (SELECT id, {q.normalize(f"coalesce({q.answer_line('answer')}, answer)")} AS g, {q.terms(q.normalize("concat(difficulty, ' ', expected_value)"))} AS terms FROM ans)
       SELECT id, 'scored' AS result, round({q.ratio('g', 'terms')}, 6) AS score FROM k""")
def _(t):
    return scored(sc.score_text_rule(answered(t).withColumn("expected_value", F.concat_ws(" ", "difficulty", "expected_value"))))


BY_TYPE = f"""{ANSWERED}, {numeric_ctes("(SELECT * FROM ans WHERE answer_type = 'numeric_value')")},
       {list_ctes("(SELECT * FROM ans WHERE answer_type = 'list')")},
       tx AS (SELECT id, {q.normalize(f"coalesce({q.answer_line('answer')}, answer)")} AS g, {q.terms(q.normalize('expected_value'))} AS terms FROM ans WHERE answer_type = 'text'),
       typed AS (SELECT id, {NUMERIC_SCORE} AS score FROM n4
         UNION ALL SELECT id, {boolean_score('answer', 'expected_value')} FROM ans WHERE answer_type = 'boolean'
         UNION ALL SELECT id, f1score FROM l8 UNION ALL SELECT id, {q.ratio('g', 'terms')} FROM tx)"""


@query("sc05_score_by_type", f"WITH {BY_TYPE} SELECT id, 'scored' AS result, round(least(greatest(score, 0), 1), 6) AS score FROM typed")
def _(t):
    return scored(sc.score_by_type(answered(t)))


@query("flagship_submission_tags", f"""WITH {BY_TYPE}, full_cases AS (SELECT c.id, coalesce(CASE WHEN s.id IS NOT NULL THEN 'scored' END, 'fail') AS result, coalesce(s.score, 0.0::DOUBLE) AS score
       FROM v_cases c LEFT JOIN (SELECT * FROM typed WHERE id IN (SELECT id FROM v_submitted)) s ON c.id = s.id)
       SELECT tag, count(*) AS total, count(*) FILTER (result = 'pass') AS pass_count, count(*) FILTER (result = 'fail') AS fail_count,
       0.0::DOUBLE AS pass_rate, round(avg(score), 6) AS avg_score FROM full_cases JOIN v_case_tags USING (id) GROUP BY tag""")
def _(t):
    return score_submission(t)


def calc(t):
    """Calculator answers made from orders: the price as number, the date, the duration."""
    return t.raw("orders").selectExpr(
        "o_orderkey AS id",
        "CASE o_orderstatus WHEN 'F' THEN 'decimal' WHEN 'O' THEN 'integer' ELSE CASE WHEN o_orderpriority < '3' THEN 'date' ELSE 'weeks_days' END END AS output_type",
        "o_totalprice", "o_orderdate", "o_orderkey", "o_orderpriority")


CALC_SPARK = {
    "extracted": """CASE output_type WHEN 'decimal' THEN format_number(o_totalprice, 1)
        WHEN 'integer' THEN CAST(CAST(o_totalprice AS DECIMAL(18,1)) AS STRING)
        WHEN 'date' THEN date_format(o_orderdate, 'M/d/yyyy')
        ELSE concat(CAST(o_orderkey % 40 AS STRING), ' weeks and ', CAST(o_orderkey % 7 AS STRING), ' days') END""",
    "ground_truth": """CASE output_type WHEN 'date' THEN date_format(o_orderdate, 'MM/dd/yyyy')
        WHEN 'weeks_days' THEN concat('(', CAST(o_orderkey % 40 AS STRING), ' weeks, ', CAST(o_orderkey % 5 AS STRING), ' days)')
        ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END""",
    "lower_limit": "CAST(CAST(o_totalprice - 0.04D AS DECIMAL(18,2)) AS STRING)",
    "upper_limit": "CAST(CAST(o_totalprice + 0.02D AS DECIMAL(18,2)) AS STRING)",
}


@query("sc06_match_decimal", """SELECT o_orderkey AS id, CAST(CAST(o_totalprice AS DECIMAL(18,1)) AS DOUBLE)
       BETWEEN CAST(CAST(o_totalprice - 0.04::DOUBLE AS DECIMAL(18,2)) AS DOUBLE) AND CAST(CAST(o_totalprice + 0.02::DOUBLE AS DECIMAL(18,2)) AS DOUBLE) AS hit FROM orders""")
def _(t):
    o = t.raw("orders").selectExpr(
        "o_orderkey AS id", "CAST(CAST(o_totalprice AS DECIMAL(18,1)) AS STRING) AS x",
        f"{CALC_SPARK['lower_limit']} AS lo", f"{CALC_SPARK['upper_limit']} AS hi")
    return o.select("id", sc.match_decimal(F.col("x"), F.col("lo"), F.col("hi")).alias("hit"))


@query("sc07_match_integer", """SELECT o_orderkey AS id, round_even(floor(o_totalprice * 2) / 2, 0) = trunc(o_totalprice) AS hit FROM orders""")
def _(t):
    o = t.raw("orders").selectExpr("o_orderkey AS id", "CAST(CAST(floor(o_totalprice * 2) / 2 AS DECIMAL(18,1)) AS STRING) AS x",
                                   "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS truth")
    return o.select("id", sc.match_integer(F.col("x"), F.col("truth")).alias("hit"))


@query("sc08_match_date", """SELECT o_orderkey AS id, day(o_orderdate) <= 12 AND month(o_orderdate) = day(o_orderdate) OR o_orderkey % 2 = 0 AS hit FROM orders""")
def _(t):
    o = t.raw("orders").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'M/d/yyyy') ELSE date_format(o_orderdate, 'd/M/yyyy') END AS x",
        "date_format(o_orderdate, 'MM/dd/yyyy') AS truth")
    return o.select("id", sc.match_date(F.col("x"), F.col("truth")).alias("hit"))


@query("sc09_match_weeks_days", "SELECT o_orderkey AS id, o_orderkey % 7 = o_orderkey % 5 AS hit FROM orders")
def _(t):
    o = t.raw("orders").selectExpr(
        "o_orderkey AS id", "concat(CAST(o_orderkey % 40 AS STRING), ' weeks ', CAST(o_orderkey % 7 AS STRING), ' days') AS x",
        "concat('(', CAST(o_orderkey % 40 AS STRING), ' Weeks, ', CAST(o_orderkey % 5 AS STRING), ' days)') AS truth")
    return o.select("id", sc.match_weeks_days(F.col("x"), F.col("truth")).alias("hit"))


@query("sc10_score_typed", r"""WITH c AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'decimal' WHEN 'O' THEN 'integer' ELSE CASE WHEN o_orderpriority < '3' THEN 'date' ELSE 'weeks_days' END END AS kind, * FROM orders),
       h AS (SELECT id, CASE kind WHEN 'decimal' THEN CAST(CAST(o_totalprice AS DECIMAL(18,1)) AS DOUBLE)
         BETWEEN CAST(CAST(o_totalprice - 0.04::DOUBLE AS DECIMAL(18,2)) AS DOUBLE) AND CAST(CAST(o_totalprice + 0.02::DOUBLE AS DECIMAL(18,2)) AS DOUBLE)
         WHEN 'integer' THEN round_even(CAST(CAST(o_totalprice AS DECIMAL(18,1)) AS DOUBLE), 0) = trunc(o_totalprice)
         WHEN 'date' THEN true ELSE false END AS hit FROM c)
       SELECT id, CASE WHEN hit THEN 'pass' ELSE 'fail' END AS result, CAST(hit AS INT)::DOUBLE AS score FROM h""")
def _(t):
    frame = calc(t).selectExpr("id", "output_type", *[f"{v} AS {k}" for k, v in CALC_SPARK.items()])
    return sc.score_typed(frame).select("id", "result", "score")


# --- verdicts ------------------------------------------------------------------------------------

ITEMS = """items AS (SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS item_idx,
       CAST(floor(l_quantity) AS INT) % 11 - 3 AS points, l_discount >= 0.05 AS met, l_returnflag FROM lineitem)"""


def rubric(t):
    """Lineitems as rubric items; the position makes the key unique."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t.raw("lineitem").select(
        F.col("l_orderkey").alias("case_id"), (F.row_number().over(order) - 1).alias("item_idx"),
        F.expr("CAST(floor(l_quantity) AS INT) % 11 - 3").alias("points"),
        (F.col("l_discount") >= 0.05).alias("met"), "l_returnflag")


def grades(items):
    return items.where(F.col("l_returnflag") != "R").select("case_id", "item_idx", "met")


@query("j16_attach_verdicts", f"WITH {ITEMS} SELECT case_id, item_idx, points, CASE WHEN l_returnflag <> 'R' THEN met ELSE false END AS met FROM items", longs=("item_idx",))
def _(t):
    items = rubric(t)
    return sc.attach_verdicts(items.select("case_id", "item_idx", "points"), grades(items))


@query("sc11_score_rubric", f"""WITH {ITEMS}, g AS (SELECT case_id, sum(points) FILTER (points > 0) AS possible,
       sum(CASE WHEN met AND l_returnflag <> 'R' THEN points ELSE 0 END) AS achieved, count(*) FILTER (met AND l_returnflag <> 'R') AS met_count, count(*) AS n_items FROM items GROUP BY case_id)
       SELECT case_id, CASE WHEN possible IS NULL THEN 'fail' ELSE 'scored' END AS result,
       CASE WHEN possible IS NULL THEN 0.0::DOUBLE ELSE {q.settled('least(greatest(achieved / possible::DOUBLE, 0.0), 1.0)', 6)} END AS score, met_count, n_items FROM g""")
def _(t):
    items = rubric(t)
    return sc.score_rubric(items.drop("met"), grades(items)).withColumn("score", settled(F.col("score"), 6))


CRITERIA = """crit AS (SELECT l_orderkey AS case_id, l_linenumber AS name, CAST(floor(sum(l_quantity)) AS BIGINT) AS weight, CAST(round(max(l_discount) * 1000) AS BIGINT) AS verdict
       FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def criteria(t):
    return t.raw("lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("name")).agg(
        F.floor(F.sum("l_quantity")).alias("weight"), F.round(F.max("l_discount") * 1000).cast("bigint").alias("verdict"))


@query("sc12_score_criteria", f"""WITH {CRITERIA}, tot AS (SELECT case_id, sum(weight) AS total FROM crit GROUP BY case_id),
       w AS (SELECT case_id, CASE WHEN total = 100 THEN weight::DOUBLE ELSE round_even(weight * 100 / total::DOUBLE, 0) END AS w,
             CASE WHEN verdict > 60 THEN 50 ELSE verdict END::DOUBLE AS s, CASE WHEN verdict <= 60 THEN 1 ELSE 0 END AS given FROM crit JOIN tot USING (case_id)),
       f AS (SELECT case_id, CASE WHEN sum(given) > 0 AND sum(w) > 0 THEN sum(s * w) / sum(w) / 100 ELSE 0 END AS score FROM w GROUP BY case_id)
       SELECT case_id, {q.settled('score', 6)} AS score, CASE WHEN score >= 0.4 THEN 'pass' ELSE 'fail' END AS result FROM f""")
def _(t):
    c = criteria(t)
    v = c.where("verdict <= 60").select("case_id", "name", "verdict")
    return sc.score_criteria(c.drop("verdict"), v, 0.4).withColumn("score", settled(F.col("score"), 6))


@query("sc13_score_dimensions", f"""WITH {CRITERIA}, s AS (SELECT case_id, weight, CASE WHEN verdict <= 60 THEN 1 ELSE 0 END AS given, CASE WHEN verdict <= 60 AND verdict // 15 BETWEEN 1 AND 5 THEN verdict // 15 ELSE 3 END::DOUBLE AS s FROM crit),
       f AS (SELECT case_id, sum(given) AS given, CASE WHEN sum(given) > 0 THEN (sum(s * weight) / sum(weight) - 1) / 4 ELSE 0 END AS score FROM s GROUP BY case_id)
       SELECT case_id, {q.settled('score', 6)} AS score, CASE WHEN given = 0 THEN 'error' WHEN score >= 0.6 THEN 'pass' ELSE 'fail' END AS result FROM f""")
def _(t):
    c = criteria(t).withColumns({"given": F.col("verdict") <= 60, "verdict": F.expr("verdict DIV 15")})
    return sc.score_dimensions(c.drop("verdict", "given"), c.where("given").select("case_id", "name", "verdict")).withColumn("score", settled(F.col("score"), 6))


@query("sc15_score_label", """SELECT d.doc_id, CASE WHEN d.lang = 'de' THEN 0.0 WHEN l.doc_id IS NULL THEN 0.0 WHEN l.quality = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS score,
       CASE WHEN d.lang = 'de' THEN 'error' WHEN l.doc_id IS NULL THEN 'fail' WHEN l.quality = 1 THEN 'pass' ELSE 'fail' END AS result
       FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(t):
    return sc.score_label(labelled(t)).select("doc_id", "score", "result")


def labelled(t):
    return t.raw("documents").select("doc_id", "lang").join(t.raw("labels"), "doc_id", "left").select(
        "doc_id", F.when(F.col("lang") != "de", F.lit("Hello")).alias("opening"),
        F.when(F.col("quality").isNotNull(), F.lit("Hi")).alias("reply"),
        F.when(F.col("quality") == 1, F.lit("engaged")).otherwise(F.lit("not_engaged")).alias("label"))


def checkpoints(t):
    return t.turns.where("role = 'user'").selectExpr(
        "conv_id", "turn + 1 AS turn", "CASE turn % 3 WHEN 0 THEN 'record_ack' WHEN 1 THEN 'skip' ELSE 'retrieval_data' END AS type",
        "array(substring(text, 1, 2)) AS echo_keywords", "400 AS max_chars", "5.0D AS max_seconds", "array('e', 'Tion') AS must_contain")


def replies(t):
    return t.turns.where("role = 'assistant'").selectExpr("conv_id", "turn", "text AS response", "CAST(turn AS DOUBLE) AS latency_s")


CHECKPOINTS = f"""cp AS (SELECT u.conv_id, CASE u.turn % 3 WHEN 0 THEN 'record_ack' WHEN 1 THEN 'skip' ELSE 'retrieval_data' END AS type,
       substring(u.text, 1, 2) AS echo, a.text AS response, a.turn::DOUBLE AS latency
       FROM v_turns u LEFT JOIN (SELECT * FROM v_turns WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'),
       p AS (SELECT conv_id, CASE WHEN type = 'skip' THEN NULL WHEN response IS NULL OR response = '' THEN false
       WHEN type = 'record_ack' THEN length(response) <= 400 AND NOT {q.contains_any('lower(response)', sc.ADVICE_WORDS)} AND contains(response, echo) AND latency <= 5
       ELSE contains(lower(response), 'e') AND contains(lower(response), 'tion') END AS passed FROM cp)"""


@query("sc14_score_checkpoints", f"""WITH {CHECKPOINTS}, g AS (SELECT conv_id, count(*) FILTER (passed) AS n_passed, count(passed) AS n_checked FROM p GROUP BY conv_id)
       SELECT conv_id, n_passed, n_checked, round(CASE WHEN n_checked = 0 THEN 1.0 ELSE n_passed / n_checked::DOUBLE END, 6) AS score,
       CASE WHEN n_checked = 0 OR n_passed / n_checked::DOUBLE >= 0.8 THEN 'pass' ELSE 'fail' END AS result FROM g""")
def _(t):
    return sc.score_checkpoints(checkpoints(t), replies(t)).withColumn("score", F.round("score", 6))


# --- dialogues -------------------------------------------------------------------------------------

SPOKEN = "spoken AS (SELECT *, coalesce(count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS num FROM v_turns WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> '')"


@query("sc16_flatten_dialogue", f"""WITH {SPOKEN} SELECT conv_id,
       md5(string_agg(concat(CASE WHEN role = 'user' THEN 'user: ' ELSE 'assistant: ' END, text), chr(10) || chr(10) ORDER BY turn)) AS rubric,
       md5(string_agg(concat('[Turn ', num, '] ', CASE WHEN role = 'user' THEN '用户: ' ELSE 'AI: ' END, text), chr(10) ORDER BY turn)) AS numbered,
       md5(string_agg(concat(CASE WHEN role = 'user' THEN 'User: ' ELSE 'AI Assistant: ' END, CASE WHEN role = 'assistant' AND length(text) > 2000 THEN substring(text, 1, 2000) || '...(truncated)' ELSE text END), chr(10) || chr(10) ORDER BY turn)) AS semantic
       FROM spoken GROUP BY conv_id""")
def _(t):
    out = None
    for style in ("rubric", "numbered", "semantic"):
        one = sc.flatten_dialogue(t.turns, style, assistant_chars=2000 if style == "semantic" else None).select("conv_id", F.md5("dialogue").alias(style))
        out = one if out is None else out.join(one, "conv_id")
    return out


@query("udf01_score_all", f"""WITH {BY_TYPE}, {ITEMS}, {CRITERIA}, {CHECKPOINTS},
       rub AS (SELECT case_id, sum(points) FILTER (points > 0) AS possible, sum(CASE WHEN met AND l_returnflag <> 'R' THEN points ELSE 0 END) AS achieved FROM items GROUP BY case_id),
       tot AS (SELECT case_id, sum(weight) AS total FROM crit GROUP BY case_id),
       cw AS (SELECT case_id, CASE WHEN total = 100 THEN weight::DOUBLE ELSE round_even(weight * 100 / total::DOUBLE, 0) END AS w, weight, verdict,
              CASE WHEN verdict > 60 THEN 50 ELSE verdict END::DOUBLE AS s, CASE WHEN verdict <= 60 AND verdict BETWEEN 1 AND 5 THEN verdict ELSE 3 END::DOUBLE AS s5 FROM crit JOIN tot USING (case_id)),
       cr AS (SELECT case_id, count(*) FILTER (verdict <= 60) AS given, sum(w) AS w, sum(s * w) AS sw, (sum(s5 * weight) / sum(weight) - 1) / 4 AS dim FROM cw GROUP BY case_id),
       ck AS (SELECT conv_id, count(*) FILTER (passed) AS n_passed, count(passed) AS n_checked FROM p GROUP BY conv_id),
       everything AS (SELECT id, 'typed_qa' AS evaluator, 'scored' AS result, score::DOUBLE AS score FROM typed
       UNION ALL SELECT o_orderkey, 'calculator', CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'pass' ELSE 'fail' END, CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 1.0 ELSE 0.0 END FROM orders
       UNION ALL SELECT case_id, 'rubric', CASE WHEN possible IS NULL THEN 'fail' ELSE 'scored' END, CASE WHEN possible IS NULL THEN 0 ELSE least(greatest(achieved / possible::DOUBLE, 0.0), 1.0) END FROM rub
       UNION ALL SELECT case_id, 'criteria', CASE WHEN given > 0 AND w > 0 AND sw / w / 100 >= 0.6 THEN 'pass' ELSE 'fail' END, CASE WHEN given > 0 AND w > 0 THEN sw / w / 100 ELSE 0 END FROM cr
       UNION ALL SELECT case_id, 'dimensions', CASE WHEN given = 0 THEN 'error' WHEN dim >= 0.6 THEN 'pass' ELSE 'fail' END, CASE WHEN given > 0 THEN dim ELSE 0 END FROM cr
       UNION ALL SELECT conv_id, 'checkpoints', CASE WHEN n_checked = 0 OR n_passed / n_checked::DOUBLE >= 0.8 THEN 'pass' ELSE 'fail' END, CASE WHEN n_checked = 0 THEN 1 ELSE n_passed / n_checked::DOUBLE END FROM ck
       UNION ALL SELECT -conv_id - 1, 'checkpoints', 'fail', 0 FROM ck
       UNION ALL SELECT doc_id, 'label', CASE WHEN d.lang = 'de' THEN 'error' WHEN l.quality = 1 THEN 'pass' ELSE 'fail' END, CASE WHEN d.lang <> 'de' AND l.quality = 1 THEN 1 ELSE 0 END FROM documents d LEFT JOIN labels l USING (doc_id)
       UNION ALL SELECT c_custkey, 'unheard_of', 'error', 0.0 FROM customer)
       SELECT id, evaluator, result, {q.settled('score', 6)} AS score FROM everything""")
def _(t):
    typed = answered(t).withColumn("evaluator", F.lit("typed_qa"))
    calculator = t.raw("orders").selectExpr(
        "o_orderkey AS id", "'calculator' AS evaluator", "'date' AS output_type",
        "CASE WHEN o_orderdate < TIMESTAMP_NTZ '2000-01-01 00:00:00' THEN date_format(o_orderdate, 'M/d/yyyy') ELSE 'NONE' END AS extracted",
        "date_format(o_orderdate, 'MM/dd/yyyy') AS ground_truth", "'' AS lower_limit", "'' AS upper_limit")
    judged = t.raw("lineitem").selectExpr("l_orderkey AS id", "explode(array('rubric', 'criteria', 'dimensions')) AS evaluator").distinct()
    # Every second conversation has no checkpoints.
    talked = t.turns.where("role = 'user'").selectExpr("explode(array(conv_id, -conv_id - 1)) AS id", "'checkpoints' AS evaluator").distinct()
    label = labelled(t).withColumnsRenamed({"doc_id": "id"}).withColumn("evaluator", F.lit("label"))
    unknown = t.raw("customer").selectExpr("c_custkey AS id", "'unheard_of' AS evaluator")
    cases = typed
    for more in (calculator, judged, talked, label, unknown):
        cases = cases.unionByName(more, allowMissingColumns=True)
    items, c = rubric(t), criteria(t)
    given = c.where("verdict <= 60").select("case_id", "name", "verdict")
    tables = {"rubric_items": items.drop("met"), "rubric_verdicts": grades(items), "criteria_items": c.drop("verdict"), "criteria_verdicts": given,
              "dimension_items": c.drop("verdict"), "dimension_verdicts": given, "checkpoints": checkpoints(t), "turns": replies(t)}
    return sc.score_all(cases, tables).withColumn("score", settled(F.col("score"), 6))
