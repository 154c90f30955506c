"""Case tables: selection, conversion to the one case schema, JSON access, generation."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.functions import text as tx
from scorelake.functions.numbers import hash_uniform
from scorelake.operators.ranking import top_k

# --- fixed values: names that other columns stand in for, conversion tables, persona levels -----
DATE_ALIASES = ["date", "exam_date", "start_date", "time", "timestamp"]
SECRET_EVAL_FIELDS = ["expected_value", "key_points", "source_data"]
ANSWER_TYPES = {
    "numeric": "numeric_value", "number": "numeric_value", "date": "text",
    "datetime": "text", "string": "text", "bool": "boolean",
}
DIFFICULTIES = {
    "basic": "direct", "intermediate": "single_hop", "advanced": "multi_hop",
    "expert": "multi_hop_temporal", "attribution": "attribution",
}
MESSAGE_ROLES = ["user", "assistant", "system", "tool"]
MESSAGE_TYPES = {"human": "user", "ai": "assistant", "system": "system", "tool": "tool"}
WEEKS_DAYS_CALCULATOR = 69
PERSONA_LEVELS = {
    "disclosure": ["responsive", "reluctant", "withholding"],
    "attitude": ["compliant", "impatient", "dominant"],
    "cognition": ["accurate", "partial_understanding", "complete_denial"],
    "logic": ["consistent", "occasional_contradiction", "fabricating"],
    "expression": ["normal", "vague", "incoherent"],
}
LEVEL_WEIGHTS = [0.5, 0.3, 0.2]
STYLES = ["年轻直接型", "中年务实型", "老年谨慎型", "知识分子型", "体力劳动者型", "焦虑型", "佛系型", "社交型"]
KNOWLEDGE_JOBS = ["工程师", "研究", "医", "护士", "教师"]
MANUAL_JOBS = ["司机", "厨师", "餐饮", "超市", "货"]
STUDENT_JOBS = ["学生", "研究生"]
GENDER_LONG = {"male": "男性", "female": "女性"}
GENDER_SHORT = {"male": "男", "female": "女"}
GUI_REPLY = "[系统展示了页面截图]"
PROMPT_LIMITS = {"expected": 500, "source": 1000, "answer": 3000, "embedding": 24_000, "extraction": 12_000}
# ---------------------------------------------------------------------------------------------------


def _map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def mapped(c: Column, values: Mapping[str, str]) -> Column:
    """Look up a value; unknown ones stay as they are."""
    return F.coalesce(F.try_element_at(_map(values), c), c)


# --- selection --------------------------------------------------------------------------------------

def filter_cases(cases: DataFrame, ids: DataFrame | None = None, limit: int | None = None, order: str = "ord") -> DataFrame:
    """The id set first, then the first `limit` cases in file order."""
    if ids is not None:
        cases = cases.join(ids.select("id").distinct(), "id", "left_semi")
    return cases.orderBy(order).limit(limit) if limit is not None else cases


def unmatched_filter_ids(cases: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(cases, "id", "left_anti")


def get_case(cases: DataFrame, case_id) -> DataFrame:
    return cases.where(F.col("id") == F.lit(case_id))


def where_contains(df: DataFrame, key: str, value: str, select: Sequence[str] | None = None) -> DataFrame:
    """Case-insensitive substring on a field; `date` looks at every date-like column.

    An empty value asks only for the field to be present.
    """
    names = [c for c in (DATE_ALIASES if key == "date" else [key]) if c in df.columns]
    if not names:
        return df.limit(0)
    if value.strip():
        hit = F.lit(False)
        for n in names:
            text = tx.date_prefix(F.col(n)) if key == "date" else F.col(n)
            hit = hit | tx.contains_ci(text, value)
        df = df.where(hit)
    return df.select(*select) if select else df


# --- JSON -----------------------------------------------------------------------------------------------

def _children(value: Column, path: Column) -> Column:
    """All children of an array or object as structs (path, key, value)."""
    items = F.transform(
        F.try_variant_get(value, "$", "array<variant>"),
        lambda v, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"),
                              F.lit(None).cast("string").alias("key"), v.alias("value")))
    fields = F.transform(
        F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")),
        lambda e: F.struct(F.concat(path, F.lit("."), e["key"]).alias("path"), e["key"].alias("key"), e["value"].alias("value")))
    return F.when(is_array(value), items).when(is_object(value), fields)


def is_array(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("ARRAY<"))


def is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT<"))


def path_tokens(path: str) -> list[str | int]:
    """`$.a.b[0].c`, `entries[*].name`, `[-1]`, `["key"]` as steps."""
    steps: list[str | int] = []
    for step in re.findall(r"\[[^\]]*\]|[^.\[\]]+", path.strip().removeprefix("$")):
        inner = step[1:-1].strip() if step.startswith("[") else step
        if step.startswith("[") and re.fullmatch(r"-?\d+", inner):
            steps.append(int(inner))
        else:
            steps.append(inner.strip("\"'"))
    return steps


def json_path(df: DataFrame, col: str, path: str, keep: Sequence[str]) -> DataFrame:
    """Rows (keep..., path, value) reached by a path; a key step on an array looks into its objects."""
    nodes = df.select(*keep, F.lit("$").alias("path"), F.col(col).alias("value"))
    for step in path_tokens(path):
        p, v = F.col("path"), F.col("value")
        if step == "*":
            found = _children(v, p)
        elif isinstance(step, int):
            found = F.filter(F.when(is_array(v), _children(v, p)), lambda c, i: i == (
                F.lit(step) if step >= 0 else F.size(F.try_variant_get(v, "$", "array<variant>")) + step))
        else:
            field = f'$["{step}"]'
            own = F.array(F.struct(F.concat(p, F.lit(f".{step}")).alias("path"), F.lit(None).cast("string").alias("key"),
                                   F.try_variant_get(v, field, "variant").alias("value")))
            inner = F.transform(_children(v, p), lambda c: F.struct(
                F.concat(c["path"], F.lit(f".{step}")).alias("path"), c["key"].alias("key"),
                F.try_variant_get(c["value"], field, "variant").alias("value")))
            found = F.filter(F.when(is_array(v), inner).otherwise(own), lambda c: c["value"].isNotNull())
        nodes = nodes.select(*keep, F.explode(found).alias("_n")).select(*keep, "_n.path", "_n.value")
    return nodes


def _json_walker(keyword: str, preview: int | None):
    """A function over texts. Its helpers are made here, so it travels to the workers by value, which need not have this package."""
    import json

    class Number(str):
        """A number as it is written."""

    load, write, wanted = json.loads, json.dumps, keyword.strip().lower()

    def pieces(value):
        """Compact JSON bit by bit, keys in order; numbers stay as written."""
        open_ = [value]
        while open_:
            v = open_.pop()
            if isinstance(v, tuple):
                yield v[0]
            elif isinstance(v, dict):
                open_.append(("}",))
                for i, k in enumerate(sorted(v, reverse=True)):
                    open_ += [v[k], (f"{'' if i == len(v) - 1 else ','}{write(k, ensure_ascii=False)}:",)]
                yield "{"
            elif isinstance(v, list):
                open_.append(("]",))
                for i in range(len(v) - 1, -1, -1):
                    open_ += [v[i], (",",)] if i else [v[i]]
                yield "["
            else:
                yield str(v) if isinstance(v, Number) else write(v, ensure_ascii=False)

    def shown(value) -> str:
        """Only as much is written as the preview shows."""
        if isinstance(value, str) or value is True or value is False:
            text = value if isinstance(value, str) else write(value)
            return text if preview is None else text[:preview]
        out, size = [], 0
        for piece in pieces(value):
            out.append(piece)
            size += len(piece)
            if preview is not None and size >= preview:
                break
        return "".join(out) if preview is None else "".join(out)[:preview]

    def hits(text: str | None) -> list[tuple]:
        try:
            root = load(text, parse_int=Number, parse_float=Number) if text is not None else None
        except (ValueError, RecursionError):
            return []
        found, open_ = [], [("$", None, root)] if text is not None else []
        while open_:
            path, key, value = open_.pop()
            if key is not None and wanted in key.lower():
                found.append((path, "key", shown(value)))
            if isinstance(value, dict):
                open_ += [(f"{path}.{k}", k, v) for k, v in value.items()]
            elif isinstance(value, list):
                open_ += [(f"{path}[{i}]", None, v) for i, v in enumerate(value)]
            elif value is not None:
                plain = value if isinstance(value, str) else "true" if value else "false"
                if plain and wanted in plain.lower():
                    found.append((path, "value", shown(value)))
        return found

    def search(texts: pd.Series) -> pd.Series:
        return pd.Series([hits(t) for t in texts], dtype=object)
    return search


def json_search(df: DataFrame, col: str, keyword: str, keep: Sequence[str], preview: int | None = None) -> DataFrame:
    """Rows (keep..., path, match, preview) where a key or a scalar at any depth holds the keyword.

    Texts nest to any depth, which built-in expressions can only follow level by level with a scan for each, so one
    Arrow-batched function walks each text once.
    """
    found = F.pandas_udf(_json_walker(keyword, preview), "array<struct<path:string,match:string,preview:string>>")
    return df.select(*keep, F.explode(found(F.col(col))).alias("_h")).select(*keep, "_h.*")


def json_profile(df: DataFrame, col: str, keep: Sequence[str], keys: int | None = None) -> DataFrame:
    """Root type, keys (the first of them if `keys` is given), key count or length, type of the first item."""
    v = F.try_parse_json(col)
    kind = F.lower(F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1))
    names = F.json_object_keys(col)
    return df.select(
        *keep, kind.alias("root_type"), (names if keys is None else F.slice(names, 1, keys)).alias("top_keys"), F.size(names).alias("key_count"),
        F.json_array_length(col).alias("length"),
        F.lower(F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, "$[0]", "variant")), r"^(\w+)", 1)).alias("item_type"))


# --- publishing ---------------------------------------------------------------------------------------------

def strip_answers(cases: DataFrame, eval_col: str = "eval", user_col: str = "user") -> DataFrame:
    """Remove expectations and overrides before a dataset is handed out."""
    secret = [*SECRET_EVAL_FIELDS, "evaluator"]
    out = cases
    if eval_col in cases.columns:
        left = [f for f in cases.schema[eval_col].dataType.names if f not in secret]
        out = out.withColumn(eval_col, F.struct(*[F.col(f"{eval_col}.{f}").alias(f) for f in left])) if left else out.drop(eval_col)
    if user_col in cases.columns:
        out = out.withColumn(user_col, F.col(user_col).dropFields("target_overrides"))
    return out.drop(*secret)


def anonymise_ids(df: DataFrame, mapping: DataFrame, user: str = "user_id", case: str = "id") -> DataFrame:
    """Replace raw user ids, and the `<raw>_` prefix of case ids, by a mapping (raw_id, new_id)."""
    m = mapping.select(F.col("raw_id").cast("string").alias("_raw"), F.col("new_id").alias("_new"))
    out = df.join(m, F.col(user).cast("string") == F.col("_raw"), "left")
    renamed = F.when(F.startswith(F.col(case), F.concat("_raw", F.lit("_"))), F.concat(
        "_new", F.substring(case, F.length("_raw") + 1, F.length(case)))).otherwise(F.col(case))
    return out.withColumns({case: renamed, user: F.coalesce("_new", F.col(user).cast("string"))}).drop("_raw", "_new")


# --- references and overrides -----------------------------------------------------------------------------------

def resolve_refs(df: DataFrame, params: DataFrame, col: str) -> DataFrame:
    """Replace `{"$ref": key}` in a JSON text column by the shared parameter; unknown keys stay."""
    key = F.when(F.array_size(F.json_object_keys(col)) == 1, F.get_json_object(col, "$.$ref"))
    p = params.select(F.col("key").alias("_ref"), F.col("value").alias("_value"))
    out = df.withColumn("_key", key).join(p, F.col("_key") == F.col("_ref"), "left")
    return out.withColumn(col, F.coalesce("_value", col)).drop("_key", "_ref", "_value")


def resolve_overrides(df: DataFrame, target: str, spec: Mapping[str, Mapping], runtime: Mapping[str, str] | None = None,
                      siblings: Sequence[str] = (), derived: Sequence[tuple[str, str, str]] = (),
                      col: str = "target_overrides") -> DataFrame:
    """Defaults < case overrides < runtime values of editable fields, as a map; missing required fields reported.

    `siblings` name target types whose overrides may stand in; `derived` (type, field, new name) carries
    single fields over from another type.
    """
    empty = F.create_map().cast("map<string,string>")
    options = [F.try_element_at(col, F.lit(t)) for t in (target, *siblings)]
    for other, field, name in derived:
        value = F.try_element_at(F.try_element_at(col, F.lit(other)), F.lit(field))
        options.append(F.when(value.isNotNull(), F.create_map(F.lit(name), value)))
    case_level = F.map_filter(F.coalesce(*options, empty), lambda k, v: v.isNotNull())
    defaults = {k: str(f["default"]) for k, f in spec.items() if f.get("default") is not None}
    allowed = {k: str(v) for k, v in (runtime or {}).items() if v is not None and spec.get(k, {}).get("editable", k in spec)}

    def layer(values: Mapping[str, str]) -> Column:
        return _map(values) if values else empty

    merged = F.map_zip_with(
        layer(allowed), F.map_zip_with(case_level, layer(defaults), lambda k, a, b: F.coalesce(a, b)),
        lambda k, a, b: F.coalesce(a, b))
    required = F.array(*[F.lit(k) for k, f in spec.items() if f.get("required")]).cast("array<string>")
    return df.withColumn("effective", merged).withColumn(
        "missing_fields", F.array_except(required, F.map_keys("effective")))


def normalize_messages(col: Column) -> Column:
    """Messages with `role` or `type` to (role, content); an unknown one gets a NULL role."""
    def role(m: Column) -> Column:
        return F.when(m["role"].isNotNull(), F.when(m["role"].isin(MESSAGE_ROLES), m["role"])).otherwise(
            F.try_element_at(_map(MESSAGE_TYPES), m["type"]))
    return F.transform(col, lambda m: F.struct(role(m).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))


def normalize_legacy(cases: DataFrame) -> DataFrame:
    """History roles unified, override lists keyed by type, unknown roles reported."""
    out = cases.withColumn("history", normalize_messages(F.col("history")))
    out = out.withColumn("error", F.when(F.exists("history", lambda m: m["role"].isNull()), F.lit("unknown message role")))
    if "overrides_list" in cases.columns:
        out = out.withColumn("target_overrides", F.map_from_entries(F.transform(
            "overrides_list", lambda o: F.struct(o["type"], o["values"])))).drop("overrides_list")
    return out


def flat_target_to_spec(col: Column) -> Column:
    """Flat map of target settings to field specs: all editable, required where a value is set."""
    kept = F.map_filter(col, lambda k, v: ~k.isin("type", "target_configurable"))
    return F.transform_values(kept, lambda k, v: F.struct(
        v.alias("default"), F.lit(True).alias("editable"), v.isNotNull().alias("required")))


# --- small projections ------------------------------------------------------------------------------------------------

def target_label(kind: Column, model: Column, agent: Column, top_k_: Column) -> Column:
    label = F.concat_ws("_", kind, F.replace(model, F.lit("/"), F.lit("-")), agent,
                        F.concat(F.lit("k"), top_k_.cast("string")))
    return F.when(kind.isNull(), F.lit("eval-only")).otherwise(label)


def reply_text(kind: Column, messages: Column, snapshots: Column | None = None, custom: Column | None = None) -> Column:
    replies = F.filter(messages, lambda m: (F.coalesce(m["type"], F.lit("reply")) == "reply")
                       & (F.coalesce(m["content"], F.lit("")) != ""))
    text = F.when(kind == "message", F.array_join(F.transform(replies, lambda m: m["content"]), "\n"))
    if snapshots is not None:
        text = text.when((kind == "gui") & (F.size(snapshots) > 0), F.lit(GUI_REPLY))
    if custom is not None:
        text = text.when((kind == "custom") & custom.isNotNull(), custom)
    return F.coalesce(text, F.lit(""))


def append_hint(inputs: Column, hint: Column) -> Column:
    """Add the hint to the last scripted input."""
    n = F.size(inputs)
    return F.when(hint.isNull() | (n == 0), inputs).otherwise(
        F.transform(inputs, lambda x, i: F.when(i == n - 1, F.concat(x, hint)).otherwise(x)))


def fill_template(template: str, **values: Column) -> Column:
    """`{name}` placeholders replaced by columns. Pieces are joined, so values are never searched."""
    pieces = re.split(r"(\{\w+\})", template)
    return F.concat(*[values[p[1:-1]] if p.startswith("{") and p[1:-1] in values else F.lit(p) for p in pieces if p])


def judge_batch(cases: DataFrame, template: str, inputs: Sequence[str], persona: DataFrame | None = None,
                criteria: DataFrame | None = None, heading: str = "\n\n", limits: Mapping[str, int] | None = None) -> DataFrame:
    """Offline prompt table: one row per case with the template filled by the columns `inputs`.

    `limits` cuts single inputs to a number of characters, as PROMPT_LIMITS does for a model's window.
    `persona` (id, dim, level) and `criteria` (dim, level, fragment) append the criteria that apply.
    """
    values = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in inputs}
    for c, n in (limits or {}).items():
        values[c] = F.substring(values[c], 1, n)
    out = cases.withColumn("prompt", fill_template(template, **values))
    if persona is None or criteria is None:
        return out.select("id", "prompt")
    extra = persona.join(criteria, ["dim", "level"]).groupBy("id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_set(F.struct("dim", "fragment"))), lambda s: F.concat(F.lit("- "), s["fragment"])), "\n").alias("_extra"))
    return out.join(extra, "id", "left").select(
        "id", F.concat("prompt", F.coalesce(F.concat(F.lit(heading), "_extra"), F.lit(""))).alias("prompt"))


def case_summaries(cases: DataFrame, title_chars: int | None = None) -> DataFrame:
    """Id, one-line title, user and target type, evaluator."""
    def filled(c: Column) -> Column:
        return F.nullif(c, F.lit(""))
    title = F.coalesce(filled(F.col("title")), filled(F.get("strict_inputs", F.lit(0))), filled(F.col("goal")), F.lit(""))
    return cases.select(
        "id", (title if title_chars is None else F.substring(title, 1, title_chars)).alias("title"), F.coalesce("user_type", F.lit("")).alias("user_type"),
        F.coalesce(F.get(F.map_keys("target_overrides"), F.lit(0)), F.lit("")).alias("target_type"),
        F.coalesce("evaluator", F.lit("")).alias("evaluator"))


# --- conversions ----------------------------------------------------------------------------------------------------------

def queries_to_cases(queries: DataFrame, difficulty: str | None = None, limit: int | None = None, title_chars: int | None = None) -> DataFrame:
    """Knowledge queries (query_id, user_email, query_text, difficulty, answer_type, expected_value) to cases."""
    q = queries.where(F.col("difficulty") == difficulty) if difficulty else queries
    if limit is not None:
        q = top_k(q, ["user_email"], [F.col("query_id")], limit).drop("rank")
    folder = tx.user_to_folder(F.col("user_email"))
    numeric_prefix = F.regexp_like("query_id", F.lit(r"^\d+_"))
    case_id = F.when(numeric_prefix, F.concat(folder, F.regexp_replace("query_id", r"^\d+_", "_"))).otherwise(F.col("query_id"))
    diff = mapped(F.coalesce("difficulty", F.lit("direct")), DIFFICULTIES)
    kind = mapped(F.coalesce("answer_type", F.lit("text")), ANSWER_TYPES)
    title = F.col("query_text") if title_chars is None else F.substring("query_text", 1, title_chars)
    return q.select(
        case_id.alias("id"),
        F.concat(F.lit("["), diff, F.lit("] "), title).alias("title"),
        F.col("query_text").alias("description"), F.array("query_text").alias("strict_inputs"),
        kind.alias("answer_type"), "expected_value", diff.alias("difficulty"),
        F.array(F.concat(F.lit("difficulty:"), diff), F.concat(F.lit("answer_type:"), kind)).alias("tags"))


def rubric_to_cases(entries: DataFrame, prefix: str = "hb_", label: str = "Rubric") -> DataFrame:
    """Rubric entries (prompt_id, example_tags, prompt, rubrics): last user message is the input."""
    last_user = F.size("prompt") - F.array_position(F.reverse(F.transform("prompt", lambda m: m["role"])), "user")
    usable = entries.where((F.size("prompt") > 0) & (F.size("rubrics") > 0) & F.exists("prompt", lambda m: m["role"] == "user"))
    theme = tx.tag_value(F.col("example_tags"), "theme")
    return usable.withColumn("_last", last_user).select(
        F.concat(F.lit(prefix), "prompt_id").alias("id"),
        F.when(theme.isNotNull(), F.concat(F.lit(f"{label} — "), theme)).otherwise(F.lit(f"{label} evaluation")).alias("title"),
        F.concat(F.lit(f"{label} rubric evaluation ("), F.size("rubrics").cast("string"), F.lit(" criteria)")).alias("description"),
        F.get("prompt", F.col("_last"))["content"].alias("input"),
        F.filter(F.slice("prompt", F.lit(1), F.col("_last")), lambda m: (F.coalesce(m["role"], F.lit("")) != "")
                 & (F.coalesce(m["content"], F.lit("")) != "")).alias("history"),
        "rubrics", F.col("example_tags").alias("tags"))


def calculator_to_cases(rows: DataFrame, prefix: str = "mc_") -> DataFrame:
    """Calculator rows to typed cases; rows without note, question, truth or needed limits are dropped."""
    def clean(c: str) -> Column:
        return tx.strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
    declared, truth = F.lower(clean("output_type")), clean("ground_truth")
    kind = (
        F.when(F.col("calculator_id").cast("int") == WEEKS_DAYS_CALCULATOR, F.lit("weeks_days"))
        .when(declared.isin("decimal", "integer", "date"), declared)
        .when(F.contains(truth, F.lit("/")), F.lit("date"))
        .when(F.contains(truth, F.lit(".")), F.lit("decimal"))
        .otherwise(F.lit("integer")))
    cleaned = rows.select(
        F.concat(F.lit(prefix), clean("row_number")).alias("id"), clean("calculator_name").alias("_name"),
        clean("category").alias("_category"), clean("patient_note").alias("_note"), clean("question").alias("_question"),
        truth.alias("ground_truth"), clean("lower_limit").alias("_lo"), clean("upper_limit").alias("_hi"), kind.alias("output_type"))
    decimal = F.col("output_type") == "decimal"
    usable = cleaned.where((F.col("_note") != "") & (F.col("_question") != "") & (F.col("ground_truth") != "")
                           & (~decimal | ((F.col("_lo") != "") & (F.col("_hi") != ""))))
    tags = F.array_compact(F.array(
        F.when(F.col("_name") != "", F.concat(F.lit("calculator:"), tx.slug(F.col("_name")))),
        F.when(F.col("_category") != "", F.concat(F.lit("category:"), F.replace(F.lower("_category"), F.lit(" "), F.lit("_")))),
        F.concat(F.lit("output_type:"), F.col("output_type"))))
    return usable.select(
        "id", F.concat("_note", F.lit("\n\n"), "_question").alias("input"), "ground_truth",
        F.when(decimal, F.col("_lo")).otherwise(F.lit("")).alias("lower_limit"),
        F.when(decimal, F.col("_hi")).otherwise(F.lit("")).alias("upper_limit"), "output_type", tags.alias("tags"))


def pair_turns(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Every user message with the assistant message right after it, NULL where another role or nothing follows.

    Neighbours are found in order, so turn numbers may have gaps. A conversation is sorted in one task.
    """
    along = W.partitionBy(key).orderBy(order)
    after = F.lead(F.struct("role", "text")).over(along)
    return messages.select(key, order, "role", F.col("text").alias("user_text"), after.alias("_next")).where(F.col("role") == "user").select(
        key, order, "user_text", F.when(F.col("_next.role") == "assistant", F.col("_next.text")).alias("assistant_text"))


# --- sampling ----------------------------------------------------------------------------------------------------------------

def stratified_sample(df: DataFrame, stratum: str, n: int, seed: int, key: str = "id") -> DataFrame:
    """Exactly min(n, size) rows per stratum, chosen by the hash of the key."""
    return top_k(df, [stratum], [F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)], n).drop("rank")


def first_users_sample(df: DataFrame, k: int, user: str = "user_id") -> DataFrame:
    """All rows of the first k users."""
    return df.join(df.select(user).distinct().orderBy(user).limit(k), user, "left_semi")


# --- generation ----------------------------------------------------------------------------------------------------------------

def assign_persona(profiles: DataFrame, seed: int, key: str = "profile_id") -> DataFrame:
    """Five dimensions drawn 50 / 30 / 20 from hashes of (profile, dimension, seed)."""
    def level(dim: str) -> Column:
        u = hash_uniform(F.col(key), F.lit(dim), F.lit(seed))
        first, second, third = PERSONA_LEVELS[dim]
        return F.when(u < LEVEL_WEIGHTS[0], first).when(u < LEVEL_WEIGHTS[0] + LEVEL_WEIGHTS[1], second).otherwise(third)
    return profiles.withColumns({d: level(d) for d in PERSONA_LEVELS})


def style_weights(age: Column, occupation: Column) -> list[Column]:
    """Weight of every style given age and occupation."""
    young, middle = age <= 28, (age > 28) & (age <= 45)
    old = age > 45
    knows, hands, learns = (tx.has_any(occupation, w) for w in (KNOWLEDGE_JOBS, MANUAL_JOBS, STUDENT_JOBS))

    def times(*rules: tuple[Column, float]) -> Column:
        w = F.lit(1.0)
        for condition, factor in rules:
            w = w * F.when(condition, F.lit(float(factor))).otherwise(F.lit(1.0))
        return w

    return [
        times((young, 3), (learns, 2)), times((middle, 3)), times((old, 3)), times((middle, 2), (knows, 2)),
        times((hands, 2)), times((young, 2)), times((young, 2), (learns, 2)), times((old, 2)),
    ]


def assign_style(profiles: DataFrame, seed: int, key: str = "profile_id") -> DataFrame:
    """Weighted choice of a speech style."""
    weights = style_weights(F.coalesce("age", F.lit(35)), F.coalesce("occupation", F.lit("")))
    df = profiles.withColumn("_w", F.array(*weights))
    total = F.aggregate("_w", F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("_u", hash_uniform(F.col(key), F.lit("style"), F.lit(seed)) * total)
    pick, upto = F.lit(STYLES[-1]), F.lit(0.0)
    chain = None
    for i, style in enumerate(STYLES[:-1]):
        upto = upto + F.col("_w")[i]
        chain = F.when(F.col("_u") < upto, style) if chain is None else chain.when(F.col("_u") < upto, style)
    return df.withColumn("style", chain.otherwise(pick)).drop("_w", "_u")


def build_context(style_text: Column | None = None) -> Column:
    """Profile text from age, gender, occupation, bmi, comorbidities, motivation, background; empty parts skipped."""
    gender = F.try_element_at(_map(GENDER_LONG), F.col("gender"))
    have = (F.col("age") > 0) & gender.isNotNull() & (F.coalesce("occupation", F.lit("")) != "")
    parts = [
        F.when(have, F.concat(F.lit("你是一位"), F.col("age").cast("string"), F.lit("岁的"), gender, F.lit("，职业是"),
                              F.col("occupation"), F.lit("，BMI "), F.col("bmi").cast("string"), F.lit("。"))),
        F.when(F.size("comorbidities") > 0, F.concat(F.lit("合并症："), F.array_join("comorbidities", "、"), F.lit("。"))),
        F.when(F.col("motivation") != "", F.concat(F.lit("减肥动机："), "motivation", F.lit("。"))),
        F.when(F.col("background") != "", F.col("background")),
    ]
    if style_text is not None:
        parts.append(F.concat(F.lit("\n\n你的说话风格："), style_text))
    return F.concat_ws("", *parts)


def cross_cases(profiles: DataFrame, openings: Sequence[tuple[str, str]]) -> DataFrame:
    """Every profile with every opening of a short list, by a generator on the profile row."""
    literal = F.array(*[F.struct(F.lit(o).alias("opening_id"), F.lit(c).alias("opening")) for o, c in openings])
    return profiles.withColumn("_o", F.explode(literal)).select("*", "_o.*").drop("_o")


def generate_cases(profiles: DataFrame, openings: Sequence[tuple[str, str]], seed: int = 42,
                   style_texts: Mapping[str, str] | None = None) -> DataFrame:
    """Cases for an opening test: persona and style fixed per profile, one case per opening."""
    people = assign_style(assign_persona(profiles, seed), seed)
    style = mapped(F.col("style"), style_texts) if style_texts else F.col("style")
    people = people.withColumn("context", build_context(style))
    crossed = cross_cases(people, openings)
    moved = F.array_compact(F.array(*[F.when(F.col(d) != PERSONA_LEVELS[d][0], F.col(d)) for d in PERSONA_LEVELS]))
    short = F.coalesce(F.try_element_at(_map(GENDER_SHORT), F.col("gender")), F.lit(""))
    title = F.concat(F.lit("开场白"), "opening_id", F.lit(" × "), F.col("age").cast("string"), F.lit("岁"), short, F.lit("BMI"),
                     F.col("bmi").cast("string"),
                     F.when(F.size(moved) > 0, F.concat(F.lit(" ["), F.array_join(moved, "/"), F.lit("]"))).otherwise(F.lit("")))
    tags = F.array(F.concat(F.lit("opening:"), "opening_id"), F.concat(F.lit("profile:"), F.col("profile_id").cast("string")),
                   *[F.concat(F.lit(f"{d}:"), d) for d in PERSONA_LEVELS])
    return crossed.select(
        F.concat(F.lit("vu_o"), "opening_id", F.lit("_"), F.replace(F.col("profile_id").cast("string"), F.lit("obesity_"), F.lit("p"))).alias("id"),
        title.alias("title"), "context", F.struct(*PERSONA_LEVELS).alias("persona"),
        F.array(F.struct(F.lit("assistant").alias("role"), F.col("opening").alias("content"))).alias("history"),
        F.lit("engagement").alias("evaluator"), tags.alias("tags"))
