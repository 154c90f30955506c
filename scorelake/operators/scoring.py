"""Scorers: one job over all cases and systems instead of one call per case.

Every scorer takes a frame with the answer and the expectation in columns and adds
`result`, `score` and `detail`. Work that only one answer type needs is guarded, so the
routed scorer makes a single pass over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scorelake.functions import text as tx
from scorelake.functions.numbers import clip01, settled

# --- fixed values: signal words of the boolean scorer, phrases of broken backends -------
TRUE_WORDS = ["true", "yes", "是", "对", "正确", "有", "存在"]
POSITIVE_SIGNALS = ["yes", "true", "correct", "是的", "对的", "正确", "确实", "有的", "存在"]
NEGATIVE_SIGNALS = ["no", "not", "false", "never", "incorrect", "不是", "没有", "不对", "不正确", "不存在", "否"]
BROKEN_BACKEND = ["502 Bad Gateway", "API 调用失败"]
ADVICE_WORDS = ["建议", "注意", "提醒", "应该", "需要注意", "小贴士", "温馨提示",
                "recommend", "suggest", "should", "advice", "tips", "reminder"]
LIST_THRESHOLD = 0.4
WRONG_NUMBER_CREDIT = 0.2
# ------------------------------------------------------------------------------------------



def _guard(when: Column | None, value: Column) -> Column:
    return value if when is None else F.when(when, value)


def _numeric(df: DataFrame, response: str, expected: str, tolerance: Column, when: Column | None) -> DataFrame:
    r, e = F.col(response), F.col(expected)
    df = df.withColumns({
        "_answer": _guard(when, tx.answer_line(r)),
        "_status": _guard(when, tx.data_status(r)),
        "_std": _guard(when, tx.number_strings(e)),
    })
    df = df.withColumn("_near", _guard(when, tx.number_strings(F.coalesce("_answer", r))))
    df = df.withColumn("_gen", F.when(
        F.col("_answer").isNotNull() & (F.size("_near") == 0) & (F.size("_std") > 0), tx.number_strings(r)
    ).otherwise(F.col("_near")))
    df = df.withColumn("_hits", F.size(F.filter(
        "_std", lambda s: F.exists("_gen", lambda g: tx.close_numbers(s, g, tolerance)))))
    n = F.size("_std")
    score = (
        F.when(n == 0, tx.keyword_ratio(r, e))
        .when(F.col("_hits") == n, F.lit(1.0))
        .when(F.col("_status") == "data_not_found", F.lit(0.0))
        .when(F.col("_hits") > 0, F.col("_hits") / n)
        .when(F.size("_gen") > 0, F.lit(WRONG_NUMBER_CREDIT))
        .otherwise(F.lit(0.0))
    )
    detail = F.when(n == 0, F.concat(F.lit("words "), F.col("_status"))).otherwise(
        F.concat_ws(" ", F.concat_ws("/", F.col("_hits"), n), F.col("_status")))
    return df.withColumns({"_score": _guard(when, score), "_detail": _guard(when, detail)}).drop(
        "_answer", "_status", "_std", "_near", "_gen", "_hits")


def _boolean(df: DataFrame, response: str, expected: str, when: Column | None) -> DataFrame:
    r, e = F.col(response), F.col(expected)
    df = df.withColumn("_text", _guard(when, F.lower(F.coalesce(tx.answer_line(r), r))))

    def hits(words: Sequence[str]) -> Column:
        total = F.lit(0)
        for w in words:
            total = total + tx.word_match(w, F.col("_text")).cast("int")
        return total

    df = df.withColumns({"_pos": hits(POSITIVE_SIGNALS), "_neg": hits(NEGATIVE_SIGNALS)})
    wanted = F.lower(tx.strip(e)).isin(TRUE_WORDS)
    score = F.when((F.col("_pos") == 0) & (F.col("_neg") == 0), F.lit(0.0)).otherwise(
        ((F.col("_pos") > F.col("_neg")) == wanted).cast("double"))
    detail = F.concat(F.lit("pos="), F.col("_pos"), F.lit(" neg="), F.col("_neg"))
    return df.withColumns({"_score": _guard(when, score), "_detail": _guard(when, detail)}).drop("_text", "_pos", "_neg")


def split_expected(expected: Column) -> Column:
    return F.filter(F.transform(F.split(expected, ";"), tx.strip), lambda x: x != "")


def _list(df: DataFrame, response: str, items: Column, when: Column | None) -> DataFrame:
    r = F.col(response)
    df = df.withColumns({
        "_answer": _guard(when, tx.answer_line(r)),
        "_terms": _guard(when, F.transform(items, lambda i: tx.match_terms(tx.normalize_text(i)))),
    })
    n = F.size("_terms")

    def found(norm: Column) -> Column:
        # Spark puts a column that is used once where it is used: within the lambda, once for each word.
        return tx.let(norm, lambda text: F.size(F.filter("_terms", lambda t: tx.term_ratio(text, t) >= LIST_THRESHOLD)))

    df = df.withColumn("_norm", _guard(when, tx.normalize_text(F.coalesce("_answer", r))))
    df = df.withColumn("_found", found(F.col("_norm")))
    retry = F.col("_answer").isNotNull() & (F.col("_found") == 0)
    df = df.withColumns({
        "_eval": F.when(F.col("_answer").isNull() | retry, r).otherwise(F.col("_answer")),
        "_full": F.when(retry, tx.normalize_text(r)),
    })
    df = df.withColumns({
        "_recall": F.try_divide(F.when(retry, found(F.col("_full"))).otherwise(F.col("_found")), n),
        "_items": _guard(when, tx.response_items(F.col("_eval"))),
    })
    df = df.withColumn("_items", tx.keep_first(F.col("_items")))
    df = df.withColumn("_items", F.transform("_items", tx.normalize_text))
    right = F.size(F.filter(
        "_items", lambda g: F.exists("_terms", lambda t: tx.term_ratio(g, t) >= LIST_THRESHOLD)))
    df = df.withColumn("_precision", F.when(F.size("_items") > 0, right / F.size("_items")).otherwise(F.col("_recall")))
    p, q = F.col("_precision"), F.col("_recall")
    score = F.when(n == 0, F.lit(0.0)).when(p + q > 0, 2 * p * q / (p + q)).otherwise(F.lit(0.0))
    detail = F.concat(F.lit("expected "), n, F.lit(" extracted "), F.size("_items"))
    return df.withColumns({"_score": _guard(when, score), "_detail": _guard(when, detail)}).drop(
        "_answer", "_terms", "_norm", "_found", "_eval", "_full", "_recall", "_items", "_precision")


def _text(df: DataFrame, response: str, expected: str, judge: str | None, when: Column | None) -> DataFrame:
    r, e = F.col(response), F.col(expected)
    eval_text = F.coalesce(tx.answer_line(r), r)
    if judge is None:
        score, detail = tx.keyword_ratio(eval_text, e), F.lit("words")
    else:
        # With key points a judge decides; without its verdict the whole answer is matched.
        j = F.col(judge)
        score = F.when(F.col("has_key_points"), F.coalesce(j, tx.keyword_ratio(r, e))).otherwise(
            tx.keyword_ratio(eval_text, e))
        detail = F.when(F.col("has_key_points") & j.isNotNull(), F.lit("judge")).otherwise(F.lit("words"))
    return df.withColumns({"_score": _guard(when, score), "_detail": _guard(when, detail)})


def _finish(df: DataFrame, result: Column | str = "scored") -> DataFrame:
    res = F.lit(result) if isinstance(result, str) else result
    return df.withColumns({
        "result": res, "score": clip01(F.col("_score")), "detail": F.col("_detail")}).drop("_score", "_detail")


def score_numeric(df: DataFrame, response="answer", expected="expected_value", tolerance: float | Column = 0.01) -> DataFrame:
    tol = F.lit(tolerance) if isinstance(tolerance, float) else tolerance
    return _finish(_numeric(df, response, expected, tol, None))


def score_boolean(df: DataFrame, response="answer", expected="expected_value") -> DataFrame:
    return _finish(_boolean(df, response, expected, None))


def score_list(df: DataFrame, response="answer", expected="expected_value", expected_items: str | None = None) -> DataFrame:
    items = F.col(expected_items) if expected_items else split_expected(F.col(expected))
    return _finish(_list(df, response, items, None))


def score_text_rule(df: DataFrame, response="answer", expected="expected_value", judge: str | None = None) -> DataFrame:
    """`judge` names a verdict column (NULL where the judge failed) next to `has_key_points`."""
    return _finish(_text(df, response, expected, judge, None))


def score_by_type(df: DataFrame, response="answer", expected="expected_value", answer_type="answer_type",
                  tolerance: float | Column = 0.01, judge: str | None = None) -> DataFrame:
    """Route every row on its answer type in one pass."""
    tol = F.lit(tolerance) if isinstance(tolerance, float) else tolerance
    r, kind = F.col(response), F.col(answer_type)
    branches = {
        "numeric_value": lambda d, w: _numeric(d, response, expected, tol, w),
        "boolean": lambda d, w: _boolean(d, response, expected, w),
        "list": lambda d, w: _list(d, response, split_expected(F.col(expected)), w),
        "text": lambda d, w: _text(d, response, expected, judge, w),
    }
    for name, branch in branches.items():
        df = branch(df, kind == name).withColumnsRenamed({"_score": f"_score_{name}", "_detail": f"_detail_{name}"})
    empty = r.isNull() | (r == "")
    broken = tx.has_any(r, BROKEN_BACKEND)
    known = kind.isin(*branches)
    scores = F.coalesce(*[F.col(f"_score_{n}") for n in branches], F.lit(0.0))
    details = F.coalesce(*[F.col(f"_detail_{n}") for n in branches])
    df = df.withColumns({
        "_score": F.when(empty | broken | ~known, F.lit(0.0)).otherwise(scores),
        "_detail": F.when(empty, F.lit("empty answer")).when(broken, F.lit("backend failure"))
        .when(~known, F.lit("unknown answer type")).otherwise(details),
    })
    result = F.when(empty, F.lit("fail")).when(broken, F.lit("error")).when(~known, F.lit("fail")).otherwise(F.lit("scored"))
    return _finish(df, result).drop(*[f"_score_{n}" for n in branches], *[f"_detail_{n}" for n in branches])


# --- typed calculator answers ---------------------------------------------------------------

def _plain_number(c: Column) -> Column:
    return F.replace(tx.strip(c), F.lit(","), F.lit("")).try_cast("double")


def match_decimal(extracted: Column, lower: Column, upper: Column) -> Column:
    hit = _plain_number(extracted).between(lower.try_cast("double"), upper.try_cast("double"))
    return F.coalesce(hit, F.lit(False))


def match_integer(extracted: Column, truth: Column) -> Column:
    """Answer rounded half to even, truth truncated."""
    t = truth.try_cast("double")
    whole = F.when(t < 0, F.ceil(t)).otherwise(F.floor(t)).cast("double")
    return F.coalesce(F.rint(_plain_number(extracted)) == whole, F.lit(False))


def match_date(extracted: Column, truth: Column) -> Column:
    def parsed(c: Column) -> Column:
        return F.try_to_timestamp(tx.strip(c), F.lit("M/d/yyyy"))
    return F.coalesce(parsed(extracted) == parsed(truth), F.lit(False))


def match_weeks_days(extracted: Column, truth: Column) -> Column:
    return F.coalesce(tx.weeks_days(extracted) == tx.weeks_days(truth), F.lit(False))


def score_typed(df: DataFrame, extracted="extracted", truth="ground_truth", output_type="output_type",
                lower="lower_limit", upper="upper_limit") -> DataFrame:
    x, kind = F.col(extracted), F.col(output_type)
    hit = (
        F.when(x.isNull() | (F.upper(x) == "NONE"), F.lit(False))
        .when(kind == "decimal", match_decimal(x, F.col(lower), F.col(upper)))
        .when(kind == "integer", match_integer(x, F.col(truth)))
        .when(kind == "date", match_date(x, F.col(truth)))
        .when(kind == "weeks_days", match_weeks_days(x, F.col(truth)))
        .otherwise(F.lit(False))
    )
    df = df.withColumns({"_score": hit.cast("double"), "_detail": kind})
    return _finish(df, F.when(F.col("_score") == 1.0, F.lit("pass")).otherwise(F.lit("fail")))


# --- verdict based scores --------------------------------------------------------------------

def attach_verdicts(items: DataFrame, verdicts: DataFrame, keys: Sequence[str] = ("case_id", "item_idx")) -> DataFrame:
    """Rubric items with their grades by position; a missing grade counts as not met."""
    return items.join(verdicts, list(keys), "left").withColumn("met", F.coalesce("met", F.lit(False)))


def score_rubric(items: DataFrame, verdicts: DataFrame, key: str = "case_id") -> DataFrame:
    """Points of met items over the positive points; no positive points is a failure."""
    graded = attach_verdicts(items, verdicts, (key, "item_idx"))
    positive = F.sum(F.when(F.col("points") > 0, F.col("points")))
    per_case = graded.groupBy(key).agg(
        positive.alias("_possible"),
        F.sum(F.when(F.col("met"), F.col("points")).otherwise(F.lit(0))).alias("_achieved"),
        F.count_if("met").alias("met_count"),
        F.count(F.lit(1)).alias("n_items"),
    )
    usable = F.col("_possible").isNotNull()
    return per_case.select(
        key,
        F.when(usable, F.lit("scored")).otherwise(F.lit("fail")).alias("result"),
        F.when(usable, clip01(F.col("_achieved") / F.col("_possible"))).otherwise(F.lit(0.0)).alias("score"),
        "met_count", "n_items",
    )


def score_criteria(items: DataFrame, verdicts: DataFrame, threshold: float = 0.6, key: str = "case_id") -> DataFrame:
    """Weights brought to 100, missing dimensions at 50, weighted mean of 0-100 scores; without any verdict a failure."""
    totals = items.groupBy(key).agg(F.sum(F.coalesce("weight", F.lit(0))).alias("_total"), F.count(F.lit(1)).alias("_n"))
    w = F.coalesce("weight", F.lit(0))
    weighted = (
        items.join(verdicts, [key, "name"], "left").join(totals, key)
        .withColumn("_w", F.when(F.col("_total") == 0, F.floor(F.lit(100) / F.col("_n")).cast("double"))
                    .when(F.col("_total") == 100, w.cast("double"))
                    .otherwise(F.rint(w * 100 / F.col("_total"))))
        .withColumn("_s", F.coalesce("verdict", F.lit(50)).cast("double"))
    )
    per_case = weighted.groupBy(key).agg(
        F.sum(F.col("_s") * F.col("_w")).alias("_sum"), F.sum("_w").alias("_weight"), F.count("verdict").alias("_given"))
    score = F.when((F.col("_weight") > 0) & (F.col("_given") > 0), F.col("_sum") / F.col("_weight") / 100).otherwise(F.lit(0.0))
    return per_case.select(key, score.alias("score")).withColumn(
        "result", F.when(F.col("score") >= threshold, F.lit("pass")).otherwise(F.lit("fail")))


def score_dimensions(items: DataFrame, verdicts: DataFrame, threshold: float = 0.6, key: str = "case_id") -> DataFrame:
    """1-5 scores, 3 where missing or out of range, weighted mean mapped to 0-1; without any verdict an error."""
    graded = items.join(verdicts, [key, "name"], "left").withColumn(
        "_s", F.when(F.col("verdict").between(1, 5), F.col("verdict")).otherwise(F.lit(3)).cast("double"))
    per_case = graded.groupBy(key).agg(
        F.sum(F.col("_s") * F.col("weight")).alias("_sum"), F.sum("weight").alias("_weight"), F.count("verdict").alias("_given"))
    failed = F.col("_given") == 0
    score = F.when(failed | (F.col("_weight") == 0), F.lit(0.0)).otherwise((F.col("_sum") / F.col("_weight") - 1) / 4)
    result = F.when(failed, F.lit("error")).when(score >= threshold, F.lit("pass")).otherwise(F.lit("fail"))
    return per_case.select(key, score.alias("score"), result.alias("result"))


def score_label(df: DataFrame, opening="opening", reply="reply", label="label", positive="engaged",
                threshold: float = 0.5) -> DataFrame:
    """Engaged or not; no opening is an error, no reply a failure."""
    def missing(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) == "")
    engaged = F.coalesce(F.col(label) == positive, F.lit(False)).cast("double")
    score = F.when(missing(opening) | missing(reply), F.lit(0.0)).otherwise(engaged)
    result = (
        F.when(missing(opening), F.lit("error")).when(missing(reply), F.lit("fail"))
        .when(score >= threshold, F.lit("pass")).otherwise(F.lit("fail"))
    )
    return df.withColumns({"score": score, "result": result})


def check_points(checkpoints: DataFrame, turns: DataFrame, keys: Sequence[str] = ("conv_id", "turn")) -> DataFrame:
    """One row per checkpoint with `passed`; NULL for skipped ones."""
    cp = checkpoints.join(turns.select(*keys, "response", "latency_s"), list(keys), "left")
    r, low = F.col("response"), F.lower("response")
    acknowledged = (
        (F.length(r) <= F.col("max_chars"))
        & ~tx.has_any(low, ADVICE_WORDS)
        & F.forall(F.coalesce("echo_keywords", F.array().cast("array<string>")), lambda k: F.contains(r, k))
        & F.coalesce(F.col("latency_s") <= F.col("max_seconds"), F.lit(True))
    )
    retrieved = F.forall(
        F.coalesce("must_contain", F.array().cast("array<string>")), lambda k: F.contains(low, F.lower(k)))
    passed = (
        F.when(F.col("type") == "skip", F.lit(None).cast("boolean"))
        .when(r.isNull() | (r == ""), F.lit(False))
        .when(F.col("type") == "record_ack", acknowledged)
        .when(F.col("type") == "retrieval_data", retrieved)
        .otherwise(F.lit(False))
    )
    return cp.withColumn("passed", passed)


def score_checkpoints(checkpoints: DataFrame, turns: DataFrame, threshold: float = 0.8, key: str = "conv_id") -> DataFrame:
    """Share of passed checkpoints; all skipped is a pass, none at all cannot occur here."""
    per_case = check_points(checkpoints, turns, (key, "turn")).groupBy(key).agg(
        F.count_if("passed").alias("n_passed"), F.count("passed").alias("n_checked"))
    score = F.when(F.col("n_checked") == 0, F.lit(1.0)).otherwise(F.col("n_passed") / F.col("n_checked"))
    return per_case.select(
        key, "n_passed", "n_checked", score.alias("score"),
        F.when(score >= threshold, F.lit("pass")).otherwise(F.lit("fail")).alias("result"))


def latency_by_turn(turns: DataFrame) -> DataFrame:
    """Seconds to the response; the first annotation that carries a time stamp replaces the full reply."""
    noted = F.try_to_timestamp(F.get(F.filter(
        "messages", lambda m: (m["type"] == "annotation") & m["timestamp"].isNotNull()), F.lit(0))["timestamp"])
    def seconds(c: Column) -> Column:
        return c.cast("timestamp").cast("double") - F.col("request_time").cast("timestamp").cast("double")
    return turns.withColumn("latency_s", F.coalesce(seconds(noted), seconds(F.col("response_time"))))


# --- dialogue text -----------------------------------------------------------------------------

# style -> (user label, assistant label, separator, numbered turns)
DIALOGUE_STYLES = {
    "rubric": ("user: ", "assistant: ", "\n\n", False),
    "numbered": ("用户: ", "AI: ", "\n", True),
    "semantic": ("User: ", "AI Assistant: ", "\n\n", False),
}


def flatten_dialogue(turns: DataFrame, style: str, key: str = "conv_id", assistant_chars: int | None = None) -> DataFrame:
    """One text per conversation from (key, turn, role, text) rows, empty turns dropped.

    `assistant_chars` clips the assistant's lines, for judges with a small window.

    A conversation is the unit that a judge reads, so its turns are gathered in one row. The turn
    number advances after every assistant line. A boolean `ghost` column marks closing user turns that
    were never sent; only the numbered style shows them.
    """
    user_label, ai_label, separator, numbered = DIALOGUE_STYLES[style]
    body = F.col("text")
    if assistant_chars is not None:
        body = F.when((F.col("role") == "assistant") & (F.length("text") > assistant_chars),
                      F.concat(F.substring("text", 1, assistant_chars), F.lit("...(truncated)"))).otherwise(body)
    line = F.concat(F.when(F.col("role") == "user", F.lit(user_label)).otherwise(F.lit(ai_label)), body)
    spoken = turns.where(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
    if "ghost" in turns.columns and not numbered:
        spoken = spoken.where(~F.coalesce("ghost", F.lit(False)))
    if numbered:
        before = W.partitionBy(key).orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
        number = 1 + F.coalesce(F.count_if(F.col("role") == "assistant").over(before), F.lit(0))
        line = F.concat(F.lit("[Turn "), number.cast("string"), F.lit("] "), line)
    lines = spoken.select(key, "turn", line.alias("_line"))
    return lines.groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "_line"))), lambda s: s["_line"]),
                     separator).alias("dialogue"))


# --- registry ------------------------------------------------------------------------------------

_ROW_SCORERS: dict[str, tuple[Callable[[DataFrame], DataFrame], dict[str, str]]] = {}
_TABLE_SCORERS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {}


def scorer(name: str, needs: Mapping[str, str] | None = None):
    """Register a `DataFrame -> DataFrame` scorer of single rows under an evaluator name.

    `needs` names its columns and their types; cases without such a column have NULL in it.
    """
    def register(fn: Callable[[DataFrame], DataFrame]):
        _ROW_SCORERS[name] = (fn, dict(needs or {}))
        return fn
    return register


def table_scorer(name: str, *tables: str):
    """Register a scorer that makes (case, result, score) from tables of items and verdicts, given in this order."""
    def register(fn: Callable[..., DataFrame]):
        _TABLE_SCORERS[name] = (fn, tables)
        return fn
    return register


scorer("typed_qa", {"answer": "string", "expected_value": "string", "answer_type": "string"})(score_by_type)
scorer("calculator", {"extracted": "string", "ground_truth": "string", "output_type": "string", "lower_limit": "string",
                      "upper_limit": "string"})(score_typed)
scorer("label", {"opening": "string", "reply": "string", "label": "string"})(score_label)
table_scorer("rubric", "rubric_items", "rubric_verdicts")(score_rubric)
table_scorer("criteria", "criteria_items", "criteria_verdicts")(score_criteria)
table_scorer("dimensions", "dimension_items", "dimension_verdicts")(score_dimensions)
table_scorer("checkpoints", "checkpoints", "turns")(score_checkpoints)


def registered_scorers() -> list[str]:
    return sorted([*_ROW_SCORERS, *_TABLE_SCORERS])


def score_all(cases: DataFrame, tables: Mapping[str, DataFrame] | None = None,
              columns: Sequence[str] = ("id", "evaluator", "result", "score")) -> DataFrame:
    """Score every row by its `evaluator`, in one pass over the cases.

    Evaluators of items and verdicts read `tables`, whose first column is the case id; a case without
    items fails, and one whose evaluator's tables are missing is an error, as is an unknown evaluator.
    """
    tables = tables or {}
    df, results, scores = cases, [], []
    is_for = lambda name: F.coalesce(F.col("evaluator") == name, F.lit(False))
    for i, (name, (fn, needs)) in enumerate(sorted(_ROW_SCORERS.items())):
        df = df.withColumns({c: F.lit(None).cast(kind) for c, kind in needs.items() if c not in df.columns})
        df = fn(df).drop("detail").withColumnsRenamed({"result": f"_result{i}", "score": f"_score{i}"})
        results.append(F.when(is_for(name), F.col(f"_result{i}")))
        scores.append(F.when(is_for(name), F.col(f"_score{i}")))
    judged, ready = None, []
    for name, (fn, needed) in sorted(_TABLE_SCORERS.items()):
        if not all(t in tables for t in needed):
            continue
        ready.append(name)
        scored = fn(*[tables[t] for t in needed])
        part = scored.select(F.col(scored.columns[0]).alias("_case"), F.lit(name).alias("_by"), F.col("result").alias("_table_result"), F.col("score").alias("_table_score"))
        judged = part if judged is None else judged.unionByName(part)
    if judged is not None:
        df = df.join(judged, (F.col("id") == F.col("_case")) & (F.col("evaluator") == F.col("_by")), "left")
        mine = F.coalesce(F.col("evaluator").isin(ready), F.lit(False))
        results.append(F.when(mine, F.coalesce("_table_result", F.lit("fail"))))
        scores.append(F.when(mine, F.coalesce("_table_score", F.lit(0.0))))
    return df.withColumns({"result": F.coalesce(*results, F.lit("error")), "score": F.coalesce(*scores, F.lit(0.0))}).select(*columns)


def rescore(stored: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Score stored dialogues (`replies` joined by newlines) again and pair new with old scores."""
    answers = stored.withColumn("_response", F.array_join("replies", "\n")).withColumnRenamed("score", "old_score")
    again = score_by_type(answers, "_response", tolerance=tolerance).withColumnRenamed("score", "new_score")
    return again.withColumn("delta", settled(F.col("new_score") - F.col("old_score"))).drop("_response", "detail")


def apply_judge(prompts: DataFrame, judge, schema: str) -> DataFrame:
    """Hand prompt rows to a user's batch judge: an iterator of frames in, an iterator of verdict frames out.

    The only Python boundary of the scorers; batches stream through Arrow.
    """
    return prompts.mapInPandas(judge, schema)
