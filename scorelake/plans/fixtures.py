"""Evaluation-shaped views over the TPC-H-like test tables, in Spark and as oracle SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.session import tune


class Tables:
    """Lazy access to the raw tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = tune(spark)
        self.root = root.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def readings(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "user_id", "ts AS time", "CAST(ts AS DATE) AS day", "event_type AS indicator",
            "value AS value_num", "'u' AS unit", "props", "event_id AS reading_id")

    @cached_property
    def exams(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_custkey AS user_id", "o_orderdate AS time", "CAST(o_orderdate AS DATE) AS day",
            "o_orderpriority AS indicator", "o_orderstatus AS exam_type", "o_totalprice AS value_num",
            "o_orderkey AS exam_id")

    @cached_property
    def life_events(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_custkey AS user_id", "o_orderkey AS event_id", "o_orderpriority AS event_name",
            "o_orderstatus AS event_type", "CAST(o_orderdate AS DATE) AS start_date",
            "CAST(1 + o_orderkey % 30 AS INT) AS duration_days",
            "CASE WHEN o_orderkey % 7 = 0 THEN date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 5 AS INT)) END"
            " AS interruption_date")

    @cached_property
    def event_indicators(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS event_id", "concat('ind-', CAST(l_partkey % 50 AS STRING)) AS indicator_name").distinct()

    @cached_property
    def windows(self) -> DataFrame:
        return (
            self.raw("events")
            .groupBy("user_id", F.col("event_type").alias("indicator"))
            .agg(F.min("ts").cast("date").alias("start_date"))
            .withColumn("end_date", F.date_add("start_date", 13))
        )

    @cached_property
    def cases(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id", "o_custkey AS user_id", "o_orderpriority AS difficulty",
            "CASE o_orderkey % 4 WHEN 0 THEN 'numeric_value' WHEN 1 THEN 'boolean' WHEN 2 THEN 'list'"
            " ELSE 'text' END AS answer_type",
            "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS expected_value",
            "o_orderstatus AS status_tag")

    @cached_property
    def case_tags(self) -> DataFrame:
        return self.tagged_cases.select("id", F.explode("tags").alias("tag"))

    @cached_property
    def tagged_cases(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id",
            "array(concat('difficulty:', o_orderpriority), concat('status:', o_orderstatus),"
            " concat('opening:0', CAST(1 + o_orderkey % 3 AS STRING))) AS tags")

    @cached_property
    def answers(self) -> DataFrame:
        """An answer to every case; some with full-width digits."""
        return self._answered(self.raw("orders"))

    @cached_property
    def submitted(self) -> DataFrame:
        """A submission that leaves out the cheap orders."""
        return self._answered(self.raw("orders").where("o_totalprice >= 40000"))

    def _answered(self, orders: DataFrame) -> DataFrame:
        return orders.selectExpr(
            "o_orderkey AS id",
            "CASE o_orderkey % 5"
            " WHEN 0 THEN concat('Thought', chr(10), 'ANSWER: ', translate(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING),"
            " '0123456789', IF(o_orderkey % 3 = 0, '０１２３４５６７８９', '0123456789')))"
            " WHEN 1 THEN concat('about ', CAST(CAST(floor(o_totalprice * 1.005D) AS BIGINT) AS STRING))"
            " WHEN 2 THEN 'I cannot find that value, maybe 7'"
            " WHEN 3 THEN concat('it was ', CAST(CAST(floor(o_totalprice * 2) AS BIGINT) AS STRING))"
            " ELSE 'Yes, this is correct' END AS answer")

    @cached_property
    def results(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("system_id"))
            .agg(
                F.expr("CASE WHEN max(l_discount) >= 0.05D THEN 'pass' WHEN max(l_discount) >= 0.02D THEN 'fail'"
                       " ELSE 'scored' END").alias("result"),
                (F.max("l_discount") * 10).alias("score"),
                F.min("l_shipdate").alias("start_ts"),
                F.max("l_shipdate").alias("end_ts"),
            )
        )

    @cached_property
    def usage(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS id", "l_returnflag AS role", "concat('m', CAST(l_suppkey % 5 AS STRING)) AS model",
            "CAST(floor(l_quantity * 100) AS BIGINT) AS input_tokens",
            "IF(l_linenumber = 1, NULL, CAST(floor(l_quantity * 10 * (l_linenumber % 4)) AS BIGINT)) AS cached_tokens",
            "CAST(floor(l_extendedprice / 10) AS BIGINT) AS output_tokens")

    @cached_property
    def turns(self) -> DataFrame:
        return self.raw("conversations").select("conv_id", "turn", "role", "text")

    @cached_property
    def verdicts(self) -> DataFrame:
        return self.raw("labels").selectExpr("doc_id AS id", "quality", "toxic")

    @cached_property
    def chunks(self) -> DataFrame:
        return self.raw("documents").selectExpr("doc_id AS chunk_id", "lang AS user_id", "text")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select("vec_id", "label", "embedding")

    @cached_property
    def mentions(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS chunk_id", "concat('p', CAST(l_partkey % 40 AS STRING)) AS entity").distinct()


# The same views for the oracle engine. A view may use the ones before it.
VIEW_SQL = {
    "v_readings": "SELECT user_id, ts AS time, CAST(ts AS DATE) AS day, event_type AS indicator,"
    " value AS value_num, 'u' AS unit, props, event_id AS reading_id FROM events",
    "v_exams": "SELECT o_custkey AS user_id, o_orderdate AS time, CAST(o_orderdate AS DATE) AS day,"
    " o_orderpriority AS indicator, o_orderstatus AS exam_type, o_totalprice AS value_num, o_orderkey AS exam_id FROM orders",
    "v_life_events": "SELECT o_custkey AS user_id, o_orderkey AS event_id, o_orderpriority AS event_name,"
    " o_orderstatus AS event_type, CAST(o_orderdate AS DATE) AS start_date,"
    " CAST(1 + o_orderkey % 30 AS INT) AS duration_days,"
    " CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) END AS interruption_date"
    " FROM orders",
    "v_intervals": "SELECT *, CAST(CASE WHEN interruption_date < start_date + duration_days - 1 THEN interruption_date"
    " ELSE start_date + duration_days - 1 END AS DATE) AS end_date FROM v_life_events",
    "v_event_indicators": "SELECT DISTINCT l_orderkey AS event_id,"
    " concat('ind-', CAST(l_partkey % 50 AS VARCHAR)) AS indicator_name FROM lineitem",
    "v_windows": "SELECT user_id, event_type AS indicator, CAST(min(ts) AS DATE) AS start_date,"
    " CAST(min(ts) AS DATE) + 13 AS end_date FROM events GROUP BY user_id, event_type",
    "v_cases": "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS difficulty,"
    " CASE o_orderkey % 4 WHEN 0 THEN 'numeric_value' WHEN 1 THEN 'boolean' WHEN 2 THEN 'list' ELSE 'text' END AS answer_type,"
    " CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS expected_value, o_orderstatus AS status_tag FROM orders",
    "v_case_tags": "SELECT o_orderkey AS id, concat('difficulty:', o_orderpriority) AS tag FROM orders"
    " UNION ALL SELECT o_orderkey, concat('status:', o_orderstatus) FROM orders"
    " UNION ALL SELECT o_orderkey, concat('opening:0', CAST(1 + o_orderkey % 3 AS VARCHAR)) FROM orders",
    "v_answers": "SELECT o_orderkey AS id, CASE o_orderkey % 5"
    " WHEN 0 THEN concat('Thought', chr(10), 'ANSWER: ', translate(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR),"
    " '0123456789', CASE WHEN o_orderkey % 3 = 0 THEN '０１２３４５６７８９' ELSE '0123456789' END))"
    " WHEN 1 THEN concat('about ', CAST(CAST(floor(o_totalprice * 1.005::DOUBLE) AS BIGINT) AS VARCHAR))"
    " WHEN 2 THEN 'I cannot find that value, maybe 7'"
    " WHEN 3 THEN concat('it was ', CAST(CAST(floor(o_totalprice * 2) AS BIGINT) AS VARCHAR))"
    " ELSE 'Yes, this is correct' END AS answer FROM orders",
    "v_submitted": "SELECT a.* FROM v_answers a JOIN orders ON o_orderkey = id WHERE o_totalprice >= 40000",
    "v_results": "SELECT l_orderkey AS id, l_linenumber AS system_id,"
    " CASE WHEN max(l_discount) >= 0.05 THEN 'pass' WHEN max(l_discount) >= 0.02 THEN 'fail' ELSE 'scored' END AS result,"
    " max(l_discount) * 10 AS score, min(l_shipdate) AS start_ts, max(l_shipdate) AS end_ts"
    " FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "v_usage": "SELECT l_orderkey AS id, l_returnflag AS role, concat('m', CAST(l_suppkey % 5 AS VARCHAR)) AS model,"
    " CAST(floor(l_quantity * 100) AS BIGINT) AS input_tokens,"
    " CASE WHEN l_linenumber <> 1 THEN CAST(floor(l_quantity * 10 * (l_linenumber % 4)) AS BIGINT) END AS cached_tokens,"
    " CAST(floor(l_extendedprice / 10) AS BIGINT) AS output_tokens FROM lineitem",
    "v_prices": "SELECT model, input::DOUBLE AS input, cached_input::DOUBLE AS cached_input, output::DOUBLE AS output"
    " FROM (VALUES ('m0',2.5,0.25,15.0),('m1',0.75,NULL,4.5),('m2',0.2,0.02,1.25)) p(model,input,cached_input,output)",
    "v_turns": "SELECT conv_id, turn, role, text FROM conversations",
    "v_verdicts": "SELECT doc_id AS id, quality, toxic FROM labels",
    "v_chunks": "SELECT doc_id AS chunk_id, lang AS user_id, text FROM documents",
    "v_vectors": "SELECT vec_id, label, embedding FROM embeddings",
    "v_mentions": "SELECT DISTINCT l_orderkey AS chunk_id, concat('p', CAST(l_partkey % 40 AS VARCHAR)) AS entity FROM lineitem",
}


def with_views(sql: str) -> str:
    """Prefix the oracle SQL with the views it names, directly or through other views."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name, body in VIEW_SQL.items():
            if name in text and name not in needed:
                needed.add(name)
                pending.append(body)
    ctes = [f"{name} AS ({body})" for name, body in VIEW_SQL.items() if name in needed]
    if not ctes:
        return sql
    stripped = sql.lstrip()
    for keyword in ("WITH RECURSIVE ", "WITH "):
        if stripped.upper().startswith(keyword):
            return f"{keyword}{', '.join(ctes)}, {stripped[len(keyword):]}"
    return f"WITH {', '.join(ctes)} {stripped}"
