"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import dates, numbers
from scorelake.functions import text as tx
from scorelake.plans import sqltext as q
from scorelake.plans.registry import query


@query("fn01_contains_ci", "SELECT conv_id, turn FROM v_turns WHERE contains(lower(coalesce(text, '')), 'tion')")
def _(t):
    return t.turns.where(tx.contains_ci(F.col("text"), " TION ")).select("conv_id", "turn")


@query("fn02_match_name", f"""SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red-wid')
       OR contains({q.compact('p_name')}, 'redwid') OR contains(lower(p_brand), 'red-wid')""")
def _(t):
    return t.raw("part").where(tx.match_name("Red-Wid", F.col("p_name"), F.col("p_brand"))).select("p_partkey")


@query("fn03_date_prefix", "SELECT substring(strftime(time, '%Y-%m-%d %H:%M:%S'), 1, 10) AS d, count(*) AS n FROM v_readings GROUP BY 1")
def _(t):
    return t.readings.groupBy(tx.date_prefix(F.col("time")).alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("fn04_event_end", "SELECT event_id, CAST(end_date AS VARCHAR) AS end_date, CAST(CAST(start_date + duration_days AS DATE) AS VARCHAR) AS open_end FROM v_intervals")
def _(t):
    return t.life_events.select(
        "event_id",
        dates.event_end(F.col("start_date"), F.col("duration_days"), F.col("interruption_date")).cast("string").alias("end_date"),
        dates.exclusive_end(F.col("start_date"), F.col("duration_days")).cast("string").alias("open_end"))


@query("fn05_week_key", f"SELECT {q.week_key('CAST(o_orderdate AS DATE)')} AS week, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.exams.groupBy(dates.week_key(F.col("day")).alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("fn06_answer_line", f"SELECT id, {q.answer_line('answer')} AS line FROM v_answers")
def _(t):
    return t.answers.select("id", tx.answer_line(F.col("answer")).alias("line"))


@query("fn07_numbers", f"""SELECT event_id, array_to_string(list_transform({q.numbers('txt')}, lambda x: CAST({q.to_number('x')} AS VARCHAR)), '|') AS numbers
       FROM (SELECT event_id, concat(strftime(ts, '%Y-%m-%d'), ' −', CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), ' of 1,234.5 ', props) AS txt FROM events) e""")
def _(t):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" −"), F.col("value").cast("decimal(18,2)").cast("string"),
                    F.lit(" of 1,234.5 "), F.col("props"))
    parsed = F.transform(tx.number_strings(text), lambda x: tx.to_number(x).cast("string"))
    return t.raw("events").select("event_id", F.array_join(parsed, "|").alias("numbers"))


@query("fn08_close", f"""SELECT o_orderkey AS id, {q.close_numbers('a', 'b', '0.01')} AS close FROM (
       SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS a,
       CAST(CAST(floor(o_totalprice * (1.0::DOUBLE + (o_orderkey % 30) / 1000.0::DOUBLE)) AS BIGINT) AS VARCHAR) AS b FROM orders) o""")
def _(t):
    pairs = t.raw("orders").selectExpr(
        "o_orderkey AS id", "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS a",
        "CAST(CAST(floor(o_totalprice * (1.0D + (o_orderkey % 30) / 1000.0D)) AS BIGINT) AS STRING) AS b")
    return pairs.select("id", tx.close_numbers(F.col("a"), F.col("b"), F.lit(0.01)).alias("close"))


@query("fn09_data_status", f"SELECT {q.data_status('answer')} AS status, count(*) AS n FROM v_answers GROUP BY 1")
def _(t):
    return t.answers.groupBy(tx.data_status(F.col("answer")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("fn10_normalize_text", f"SELECT doc_id, md5({q.normalize('text')}) AS h FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("h"))


@query("fn11_keyword_match", f"""WITH n AS (SELECT p_partkey, {q.normalize("concat(p_type, ' ', p_name)")} AS g, {q.normalize('p_name')} AS s FROM part)
       , k AS (SELECT p_partkey, g, {q.terms('s')} AS terms FROM n)
       SELECT p_partkey, round({q.ratio('replace(g, chr(114), chr(113))', 'terms')}, 6) AS ratio FROM k""")
def _(t):
    norm = tx.normalize_text(F.concat_ws(" ", "p_type", "p_name"))
    part = t.raw("part").select("p_partkey", F.replace(norm, F.lit("r"), F.lit("q")).alias("g"),
                                tx.match_terms(tx.normalize_text(F.col("p_name"))).alias("terms"))
    return part.select("p_partkey", F.round(tx.term_ratio(F.col("g"), F.col("terms")), 6).alias("ratio"))


@query("fn12_response_items", f"""WITH i AS (SELECT doc_id, {q.response_items('text')} AS items FROM documents),
       k AS (SELECT doc_id, {q.keep_first('items')} AS items FROM i)
       SELECT doc_id, len(items) AS n_items, md5(array_to_string(items, '|')) AS h FROM k""", longs=("n_items",))
def _(t):
    items = t.raw("documents").select("doc_id", tx.response_items(F.col("text")).alias("items"))
    kept = items.select("doc_id", tx.keep_first(F.col("items")).alias("items"))
    return kept.select("doc_id", F.size("items").alias("n_items"), F.md5(F.array_join("items", "|")).alias("h"))


@query("fn13_word_match", f"SELECT id, {q.word_hits('lower(answer)', ['no', 'yes', 'it', 'correct', '没有'])} AS hits FROM v_answers")
def _(t):
    total = F.lit(0)
    for w in ["no", "yes", "it", "correct", "没有"]:
        total = total + tx.word_match(w, F.lower("answer")).cast("int")
    return t.answers.select("id", total.alias("hits"))


@query("fn14_weeks_days", r"""SELECT event_id, CAST(regexp_extract(s, '(\d+)\s*weeks?\s*[,\s]*(\d+)\s*days?', 1) AS BIGINT) AS weeks,
       CAST(regexp_extract(s, '(\d+)\s*weeks?\s*[,\s]*(\d+)\s*days?', 2) AS BIGINT) AS days
       FROM (SELECT event_id, concat(CAST(duration_days // 7 AS VARCHAR), ' weeks, ', CAST(duration_days % 7 AS VARCHAR), ' day') AS s FROM v_life_events) e""")
def _(t):
    text = F.expr("concat(CAST(duration_days DIV 7 AS STRING), ' Weeks, ', CAST(duration_days % 7 AS STRING), ' day')")
    return t.life_events.select("event_id", tx.weeks_days(text).alias("w")).select("event_id", "w.weeks", "w.days")


@query("fn15_parse_judge_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def _(t):
    e = t.raw("events")
    fence = F.concat(F.lit("verdict:\n```json\n"), F.col("props"), F.lit("\n```"))
    prose = F.concat(F.lit("I think "), F.col("props"), F.lit(" fits"))
    reply = F.when(F.col("event_type") == "click", fence).when(F.col("event_type") == "error", prose).otherwise(F.col("props"))
    return e.select("event_id", F.try_variant_get(tx.parse_judge_json(reply), "$.k", "bigint").alias("k"))


@query("fn16_user_folder", "SELECT c_custkey, replace(concat(c_name, '@demo'), '@', '_AT_') AS folder, concat(c_name, '@demo') AS email FROM customer")
def _(t):
    email = F.concat("c_name", F.lit("@demo"))
    folder = tx.user_to_folder(email)
    return t.raw("customer").select("c_custkey", folder.alias("folder"), tx.folder_to_user(folder).alias("email"))


@query("fn17_name_to_key", "SELECT o_orderpriority AS name, replace(replace(lower(o_orderpriority), '-', '_'), ' ', '') AS k, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    return t.raw("orders").groupBy(F.col("o_orderpriority").alias("name"), tx.name_to_key(F.col("o_orderpriority")).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("fn18_tag_value", "SELECT id, substring(tag, 9) AS opening FROM v_case_tags WHERE starts_with(tag, 'opening:')")
def _(t):
    return t.tagged_cases.select("id", tx.tag_value(F.col("tags"), "opening").alias("opening"))


@query("fn19_char_windows", """WITH w AS (SELECT doc_id, CASE WHEN length(text) <= 1000 THEN [text] ELSE
       list_transform(range(0, length(text), 800), lambda s: substring(text, s + 1, 1000)) END AS pieces FROM documents)
       SELECT doc_id, i - 1 AS piece, md5(pieces[i]) AS h FROM (SELECT doc_id, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM w) x""", longs=("piece",))
def _(t):
    return t.raw("documents").select("doc_id", F.posexplode(tx.char_windows(F.col("text"), 1000, 200)).alias("piece", "part")).select(
        "doc_id", "piece", F.md5("part").alias("h"))


@query("fn20_cosine", """SELECT v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], r.embedding::DOUBLE[]) / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))
       / sqrt(list_dot_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[])), 6) AS cos
       FROM embeddings v JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) r USING (label)""")
def _(t):
    first = t.vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))
    return t.vectors.join(first, "label").select("vec_id", F.round(numbers.cosine(F.col("embedding"), F.col("ref")), 6).alias("cos"))


SPACED_NAME = r"regexp_replace(concat(p_brand, ' ', p_name, '(', p_type, ')'), '[^\p{L}\p{N}_\s]', ' ', 'g')"


@query("fn21_slug", rf"SELECT p_partkey, lower(regexp_replace({q.strip(SPACED_NAME)}, '\s+', '_', 'g')) AS slug FROM part")
def _(t):
    name = F.concat("p_brand", F.lit(" "), "p_name", F.lit("("), "p_type", F.lit(")"))
    return t.raw("part").select("p_partkey", tx.slug(name).alias("slug"))


@query("fn22_clip01", "SELECT c_custkey, least(greatest(c_acctbal / 5000, 0.0), 1.0) AS x FROM customer")
def _(t):
    return t.raw("customer").select("c_custkey", numbers.clip01(F.col("c_acctbal") / 5000).alias("x"))


@query("fn23_user_of_case", r"SELECT event_id, concat('user', CAST(user_id AS VARCHAR), '_Q1_a') AS user_part FROM events")
def _(t):
    case_id = F.concat(F.lit("user"), F.col("user_id"), F.lit("_Q1_a_Q"), F.lpad(F.col("event_id").cast("string"), 4, "0"))
    return t.raw("events").select("event_id", tx.user_of_case(case_id).alias("user_part"))


@query("fn24_hash_uniform", f"SELECT event_id, {q.uniform('event_id', '42')} AS u FROM events")
def _(t):
    return t.raw("events").select("event_id", numbers.hash_uniform(F.col("event_id"), F.lit(42)).alias("u"))
