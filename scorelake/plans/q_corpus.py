"""Corpus queries: chunk kinds, packing, fingerprints, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import corpus as cp
from scorelake.plans import sqltext as q
from scorelake.plans.q_readings import RANKED_WEEKS, TREND
from scorelake.plans.registry import query


def profiles(t):
    return t.raw("customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit('{"segment": "'), "c_mktsegment", F.lit('"}')).alias("profile"))


def exams(t):
    return t.exams.withColumn("unit", F.lit("usd")).withColumn("exam_location", F.lit(None).cast("string"))


def fixed(x: str, d: int) -> str:
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(28, 9)), {d}) AS DECIMAL(28, {d})) AS VARCHAR)"


PROFILE_SQL = """SELECT c_custkey AS user_id, 'profile' AS kind, '' AS part, 0 AS piece, concat('[PROFILE]', chr(10), '{"segment": "', c_mktsegment, '"}') AS text FROM customer"""


def event_fields(sep: str) -> str:
    return (f"concat('Type: ', event_type, {sep}, 'Event ID: ', event_id, {sep}, 'Start: ', start_date, {sep}, 'Duration: ', duration_days, ' days', {sep}, 'Interrupted: ',"
            f" CASE WHEN interruption_date IS NULL THEN 'False' ELSE concat('True', {sep}, 'Interruption date: ', interruption_date::DATE) END)")


def event_sql(sep: str) -> str:
    return f"SELECT user_id, 'event' AS kind, concat(start_date, ' ', event_id) AS part, 0 AS piece, concat('[EVENT] ', event_name, {sep}, {event_fields(sep)}) AS text FROM v_life_events"


EXAM_SQL = """SELECT user_id, 'exam' AS kind, CAST(day AS VARCHAR) AS part, 0 AS piece, concat('[EXAM] Date: ', day, ', Location: ?, Type: ', arg_min(exam_type, exam_id), chr(10),
       string_agg(concat('  ', indicator, ' = ', CAST(value_num AS VARCHAR), ' usd'), chr(10) ORDER BY time, exam_id)) AS text FROM v_exams GROUP BY user_id, day"""
WEEK_CTE = f"""{RANKED_WEEKS}, h AS (SELECT user_id, week, indicator, max(n) AS n, avg(v) AS mean, min(v) AS mn, max(v) AS mx, avg(v) FILTER (rn <= n // 2) AS f, avg(v) FILTER (rn > n // 2) AS s FROM r GROUP BY ALL),
       wl AS (SELECT user_id, week, indicator, concat('  ', indicator, ': mean=', {fixed('mean', 2)}, ', min=', {fixed('mn', 2)}, ', max=', {fixed('mx', 2)}, ', trend=', {TREND}) AS l,
       CASE WHEN mx > mean * 1.5 AND n >= 3 THEN concat(indicator, ' peaked at ', {fixed('mx', 2)}, ' (mean ', {fixed('mean', 2)}, ')') END AS p FROM h)"""
WEEK_SQL = """SELECT user_id, 'week' AS kind, week AS part, 0 AS piece, concat('[DEVICE SUMMARY] Week: ', week, chr(10), string_agg(l, chr(10) ORDER BY indicator),
       coalesce(concat(chr(10), '  Notable: ', string_agg(p, '; ' ORDER BY indicator) FILTER (p IS NOT NULL)), '')) AS text FROM wl GROUP BY user_id, week"""
WEEK_SQL = WEEK_SQL.replace("coalesce(concat(chr(10), '  Notable: ', string_agg(p, '; ' ORDER BY indicator) FILTER (p IS NOT NULL)), '')",
                            "CASE WHEN count(p) > 0 THEN chr(10) || '  Notable: ' || string_agg(p, '; ' ORDER BY indicator) FILTER (p IS NOT NULL) ELSE '' END")


def raw_sql(header: str, size: int, overlap: int, kind: str = "raw") -> str:
    step = size - overlap
    return f"""SELECT user_id, '{kind}' AS kind, CAST(day AS VARCHAR) AS part, CAST(s // {step} AS INT) AS piece, substring(full_text, s + 1, {size}) AS text FROM
       (SELECT user_id, day, full_text, unnest(CASE WHEN length(full_text) <= {size} THEN [0] ELSE range(0, length(full_text), {step}) END) AS s FROM
       (SELECT user_id, day, concat('{header}', day, chr(10), string_agg(concat('  ', indicator, ' = ', CAST(value_num AS VARCHAR), ' u'), chr(10) ORDER BY time, reading_id)) AS full_text FROM v_readings GROUP BY user_id, day) x) y"""


CORPUS_CTES = f"{WEEK_CTE}, c AS ({PROFILE_SQL} UNION ALL {event_sql('chr(10)')} UNION ALL {EXAM_SQL} UNION ALL {WEEK_SQL} UNION ALL {raw_sql('[DEVICE RAW] Date: ', 15000, 500)})"


def corpus(t):
    return cp.chunk_corpus(profiles(t), t.life_events, exams(t), t.readings)


@query("rg01_chunk_corpus", f"WITH {CORPUS_CTES} SELECT user_id, kind, part, piece, kind <> 'raw' AS semantic, md5(text) AS h FROM c")
def _(t):
    return corpus(t).select("user_id", "kind", "part", "piece", "semantic", F.md5("text").alias("h"))


@query("rg01_chunk_numbers", f"WITH {CORPUS_CTES} SELECT user_id, md5(text) AS h, row_number() OVER (PARTITION BY user_id ORDER BY list_position(['profile', 'event', 'exam', 'week', 'raw'], kind), part, piece) - 1 AS chunk_idx FROM c")
def _(t):
    return cp.numbered(corpus(t)).select("user_id", F.md5("text").alias("h"), "chunk_idx")


@query("rg01_raw_windows", f"SELECT user_id, part, piece, text FROM ({raw_sql('[DEVICE RAW] Date: ', 64, 20)}) z")
def _(t):
    return cp.raw_chunks(t.readings, max_chars=64, overlap=20).select("user_id", "part", "piece", "text")


@query("rg02_chunk_flat", f"""WITH c AS ({event_sql("' | '")} UNION ALL SELECT user_id, 'exam', CAST(exam_id AS VARCHAR), 0, concat('[EXAM] ', day, ' | ', indicator, ' = ', CAST(value_num AS VARCHAR), ' usd | Location: ? | Type: ', exam_type) FROM v_exams
       UNION ALL {raw_sql('[DEVICE] Date: ', 64, 0, 'day')}) SELECT user_id, kind, part, piece, md5(text) AS h FROM c""")
def _(t):
    return cp.chunk_flat(t.life_events, exams(t), t.readings, max_chars=64).select("user_id", "kind", "part", "piece", F.md5("text").alias("h"))


NODES = f"""wk AS (SELECT user_id, {q.week_key('day')} AS week, indicator, avg(value_num) AS m, min(value_num) AS mn, max(value_num) AS mx, min(day) AS d FROM v_readings GROUP BY ALL),
       nodes AS (SELECT user_id, week, concat('Device indicators for ', week, ': ', string_agg(concat(indicator, ': mean=', {fixed('m', 1)}, ', min=', {fixed('mn', 1)}, ', max=', {fixed('mx', 1)}, ' u'), '; ' ORDER BY indicator)) AS sentence,
       CAST(CAST(date_trunc('week', min(d)) AS DATE) AS VARCHAR) AS ts FROM wk GROUP BY user_id, week)"""


@query("rg03_device_week_nodes", f"WITH {NODES} SELECT user_id, week, sentence, ts AS timestamp, concat('event-', md5(concat(sentence, '-', ts))) AS event_id FROM nodes")
def _(t):
    return cp.device_week_nodes(t.readings).drop("entities")


@query("rg03_chunk_grouped", f"""WITH {NODES}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_date, event_id) AS rn FROM v_life_events),
       c AS (SELECT user_id, 'events' AS kind, CAST((rn - 1) // 10 AS VARCHAR) AS part, concat('[DATA] Health Events', chr(10), string_agg(concat('[', start_date, '] Event: ', event_name, ', Type: ', event_type, ', Start: ', start_date, ', Duration: ', duration_days, ' days, Interrupted: ',
         CASE WHEN interruption_date IS NULL THEN 'False' ELSE concat('True, Interruption date: ', interruption_date::DATE) END), chr(10) ORDER BY rn)) AS text FROM n GROUP BY user_id, (rn - 1) // 10
       UNION ALL SELECT user_id, 'exams', CAST(day AS VARCHAR), concat('[DATA] Exam Results on ', day, chr(10), string_agg(concat(indicator, ' = ', CAST(value_num AS VARCHAR), ' usd'), chr(10) ORDER BY time, exam_id)) FROM v_exams GROUP BY user_id, day
       UNION ALL SELECT user_id, 'device_week', week, sentence FROM nodes) SELECT user_id, kind, part, md5(text) AS h FROM c""")
def _(t):
    return cp.chunk_grouped(t.life_events, exams(t), t.readings).select("user_id", "kind", "part", F.md5("text").alias("h"))


@query("rg04_pack_lines", """WITH RECURSIVE l AS (SELECT doc_id, lang, unnest(ls) AS ln, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, lang, list_prepend('[DATA]', string_split(text, chr(10))) AS ls FROM documents) x),
       r AS (SELECT doc_id, lang, i, ln, length(ln) + 1 AS n, 0 AS ch FROM l WHERE i = 1 UNION ALL
         SELECT l.doc_id, l.lang, l.i, l.ln, CASE WHEN r.n + length(l.ln) + 1 > 2000 THEN length(l.ln) + 1 ELSE r.n + length(l.ln) + 1 END, CASE WHEN r.n + length(l.ln) + 1 > 2000 THEN r.ch + 1 ELSE r.ch END FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
       SELECT doc_id, ch + 1 AS pos, md5(concat('[PROFILE]', chr(10), 'lang: ', lang, chr(10), string_agg(ln, chr(10) ORDER BY i))) AS h FROM r GROUP BY doc_id, lang, ch
       UNION ALL SELECT doc_id, 0, md5(concat('[PROFILE]', chr(10), 'lang: ', lang)) FROM documents""")
def _(t):
    text = F.concat(F.lit("[PROFILE]\nlang: "), "lang", F.lit("\n[DATA]\n"), "text")
    docs = t.raw("documents").select("doc_id", text.alias("doc"))
    return docs.select("doc_id", F.posexplode(cp.pack_lines(F.col("doc"), 2000)).alias("pos", "chunk")).select("doc_id", "pos", F.md5("chunk").alias("h"))


@query("rg05_semantic_chunks", f"WITH {CORPUS_CTES} SELECT user_id, kind, part, md5(text) AS h FROM c WHERE kind <> 'raw'")
def _(t):
    return cp.semantic_chunks(corpus(t)).select("user_id", "kind", "part", F.md5("text").alias("h"))


def limbs(row: str) -> str:
    sums = ", ".join(f"CAST(sum(CAST('0x' || substring({row}, {1 + 8 * i}, 8) AS UBIGINT)) AS VARCHAR)" for i in range(4))
    return f"md5(concat_ws(':', CAST(count(*) AS VARCHAR), {sums}))"


@query("src15_content_fingerprint", f"SELECT lang AS user_id, count(*) AS n_rows, {limbs('md5(text)')} AS fingerprint FROM documents GROUP BY lang")
def _(t):
    return cp.content_fingerprint(t.chunks, ["user_id"], F.col("text"))


@query("src15_ordered_fingerprint", f"SELECT conv_id, count(*) AS n_rows, {limbs('md5(concat_ws(chr(31), CAST(turn AS VARCHAR), text))')} AS fingerprint FROM conversations GROUP BY conv_id")
def _(t):
    return cp.content_fingerprint(t.turns, ["conv_id"], F.col("turn"), F.col("text"))


@query("rg13_assemble_context", """WITH h AS (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents), g AS (SELECT lang, string_agg(text, chr(10) || chr(10) ORDER BY rn) AS ctx FROM h WHERE rn <= 3 GROUP BY lang)
       SELECT query_id, md5(concat(coalesce(ctx, '(No relevant memories found)'), chr(10), chr(10), 'Question: what?', chr(10), 'Thought: ')) AS h FROM (SELECT DISTINCT lang AS query_id FROM documents UNION SELECT r_name FROM region) k LEFT JOIN g ON g.lang = k.query_id""")
def _(t):
    from scorelake.operators.ranking import top_k
    docs = t.raw("documents")
    hits = top_k(docs.withColumn("summary", F.lit("")), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 3).withColumnRenamed("lang", "query_id")
    questions = docs.select(F.col("lang").alias("query_id")).distinct().union(t.raw("region").select("r_name")).withColumn("question", F.lit("what?"))
    return cp.assemble_context(questions, hits, ["summary", "text"]).select("query_id", F.md5("prompt").alias("h"))
