"""Retrieval corpus: text chunks from per-user tables, fingerprints, context assembly.

Texts that can grow without bound (a user's raw readings of one day) are never gathered whole:
lines get their character offset from prefix sums and go straight to the windows they touch.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.functions import text as tx
from scorelake.functions.dates import monday, week_key
from scorelake.operators.ranking import ranked
from scorelake.operators.readings import event_batches, weekly_summary

MAX_CHUNK_CHARS = 15_000
OVERLAP_CHARS = 500


def _fixed(x: Column, digits: int) -> Column:
    """A number as text with a fixed number of decimals, rounded half up."""
    return F.round(x.cast("decimal(28,9)"), digits).cast(f"decimal(28,{digits})").cast("string")


def _or_mark(c: str, columns: Sequence[str]) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("?")) if c in columns else F.lit("?")


def reading_line(columns: Sequence[str], prefix: str = "  ") -> Column:
    value = "value" if "value" in columns else "value_num"
    unit = F.coalesce(F.col("unit"), F.lit("")) if "unit" in columns else F.lit("")
    return F.concat(F.lit(prefix), _or_mark("indicator", columns), F.lit(" = "), _or_mark(value, columns), F.lit(" "), unit)


def joined_lines(df: DataFrame, keys: Sequence[str], order: Sequence[str], line: Column, separator: str = "\n") -> DataFrame:
    """Lines of a bounded group (one exam, one batch, one week) as one text."""
    return df.select(*keys, F.struct(*order, line.alias("_line")).alias("_s")).groupBy(*keys).agg(F.array_join(
        F.transform(F.sort_array(F.collect_list("_s")), lambda s: s["_line"]), separator).alias("body"))


def windowed_text(lines: DataFrame, keys: Sequence[str], order: Sequence[str], header: Column, cell: Column,
                  max_chars: int = MAX_CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Overlapping windows over header + lines of each group: rows (keys..., piece, text).

    `lines` has a `line` column; `cell` never decreases along `order` and splits long groups.
    Every aggregate holds at most one window of text.
    """
    step = max_chars - overlap
    body = lines.select(*keys, *order, cell.alias("_cell"), F.concat(F.lit("\n"), "line").alias("_piece"))
    heads = lines.select(*keys).distinct().withColumns({"_piece": header, "_cell": F.lit(None).cast(body.schema["_cell"].dataType)})
    rows = body.unionByName(heads, allowMissingColumns=True).withColumn("_len", F.length("_piece").cast("bigint"))
    cells = rows.groupBy(*keys, "_cell").agg(F.sum("_len").alias("_sum"))
    along = W.partitionBy(*keys).orderBy(F.col("_cell").asc_nulls_first())
    names = [f"_k{i}" for i in range(len(keys))]
    starts = cells.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_cell").alias("_at"),
        (F.sum("_sum").over(along) - F.col("_sum")).alias("_before"),
        F.sum("_sum").over(W.partitionBy(*keys)).alias("_total"))
    on = F.col("_cell").eqNullSafe(F.col("_at"))
    for k, n in zip(keys, names):
        on = on & F.col(k).eqNullSafe(F.col(n))
    within = W.partitionBy(*keys, "_cell").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    placed = rows.join(starts, on).withColumn("_off", F.col("_before") + F.sum("_len").over(
        within.rowsBetween(W.unboundedPreceding, 0)) - F.col("_len"))
    n_windows = F.when(F.col("_total") <= max_chars, F.lit(1)).otherwise(F.ceil(F.col("_total") / step))
    first = F.greatest(F.floor((F.col("_off") - max_chars) / step) + 1, F.lit(0))
    last = F.least(F.floor((F.col("_off") + F.col("_len") - 1) / step), n_windows - 1)
    touched = placed.withColumn("piece", F.explode(F.when(first <= last, F.sequence(first, last))))
    base = F.col("piece") * step
    cut_from = F.greatest(base - F.col("_off"), F.lit(0))
    cut_to = F.least(base + max_chars - F.col("_off"), F.col("_len"))
    parts = touched.select(*keys, "piece", F.struct(
        F.col("_off"), F.substring(F.col("_piece"), (cut_from + 1).cast("int"), (cut_to - cut_from).cast("int")).alias("t")).alias("_s"))
    return parts.groupBy(*keys, "piece").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list("_s")), lambda s: s["t"]), "").alias("text"))


# --- chunk kinds ---------------------------------------------------------------------------------------


def profile_chunks(profiles: DataFrame) -> DataFrame:
    """(user_id, profile): one chunk each."""
    return profiles.select("user_id", F.lit("profile").alias("kind"), F.lit("").alias("part"), F.lit(0).alias("piece"),
                           F.concat(F.lit("[PROFILE]\n"), "profile").alias("text"))


def _interrupted(columns: Sequence[str]) -> Column:
    """The event's own mark; tables without one have a date for interrupted events only."""
    dated = F.col("interruption_date").isNotNull() if "interruption_date" in columns else F.lit(False)
    return F.coalesce("interrupted", F.lit(False)) if "interrupted" in columns else dated


def _event_fields(columns: Sequence[str], separator: str, with_id: bool) -> Column:
    parts = [F.concat(F.lit("Type: "), _or_mark("event_type", columns))]
    if with_id:
        parts.append(F.concat(F.lit("Event ID: "), _or_mark("event_id", columns)))
    interrupted = _interrupted(columns)
    parts += [
        F.concat(F.lit("Start: "), _or_mark("start_date", columns)),
        F.concat(F.lit("Duration: "), _or_mark("duration_days", columns), F.lit(" days")),
        F.concat(F.lit("Interrupted: "), F.when(interrupted, F.lit("True")).otherwise(F.lit("False"))),
        F.when(interrupted, F.concat(F.lit("Interruption date: "), F.col("interruption_date").cast("string"))),
    ]
    return F.concat_ws(separator, *parts)


def event_chunks(events: DataFrame, separator: str = "\n") -> DataFrame:
    head = F.concat(F.lit("[EVENT] "), _or_mark("event_name", events.columns))
    return events.select(
        "user_id", F.lit("event").alias("kind"), F.concat_ws(" ", F.col("start_date").cast("string"), F.col("event_id").cast("string")).alias("part"),
        F.lit(0).alias("piece"), F.concat(head, F.lit(separator), _event_fields(events.columns, separator, True)).alias("text"))


def exam_chunks(exams: DataFrame, order: Sequence[str] = ("time", "exam_id")) -> DataFrame:
    """One chunk per exam day; place and type come from its first row."""
    body = joined_lines(exams, ["user_id", "day"], order, reading_line(exams.columns))
    first = exams.groupBy("user_id", "day").agg(F.min_by(F.struct(
        _or_mark("exam_location", exams.columns).alias("place"), _or_mark("exam_type", exams.columns).alias("type")), F.struct(*order)).alias("f"))
    text = F.concat(F.lit("[EXAM] Date: "), F.col("day").cast("string"), F.lit(", Location: "), F.col("f.place"),
                    F.lit(", Type: "), F.col("f.type"), F.lit("\n"), F.col("body"))
    return body.join(first, ["user_id", "day"]).select(
        "user_id", F.lit("exam").alias("kind"), F.col("day").cast("string").alias("part"), F.lit(0).alias("piece"), text.alias("text"))


def weekly_chunks(readings: DataFrame) -> DataFrame:
    """Weekly summary text with trends and notable peaks."""
    s = weekly_summary(readings)
    line = F.concat(F.lit("  "), "indicator", F.lit(": mean="), _fixed(F.col("mean"), 2), F.lit(", min="), _fixed(F.col("min"), 2),
                    F.lit(", max="), _fixed(F.col("max"), 2), F.lit(", trend="), "trend")
    peak = F.when(F.col("anomaly"), F.concat("indicator", F.lit(" peaked at "), _fixed(F.col("max"), 2), F.lit(" (mean "), _fixed(F.col("mean"), 2), F.lit(")")))
    weeks = s.groupBy("user_id", "week").agg(F.sort_array(F.collect_list(F.struct("indicator", line.alias("l"), peak.alias("p")))).alias("r"))
    peaks = F.array_compact(F.transform("r", lambda x: x["p"]))
    text = F.concat(F.lit("[DEVICE SUMMARY] Week: "), "week", F.lit("\n"), F.array_join(F.transform("r", lambda x: x["l"]), "\n"),
                    F.when(F.size(peaks) > 0, F.concat(F.lit("\n  Notable: "), F.array_join(peaks, "; "))).otherwise(F.lit("")))
    return weeks.select("user_id", F.lit("week").alias("kind"), F.col("week").alias("part"), F.lit(0).alias("piece"), text.alias("text"))


def raw_chunks(readings: DataFrame, order: Sequence[str] = ("time", "reading_id"), max_chars: int = MAX_CHUNK_CHARS,
               overlap: int = OVERLAP_CHARS, header: str = "[DEVICE RAW] Date: ") -> DataFrame:
    """Raw readings per day, cut into overlapping windows."""
    lines = readings.select("user_id", "day", *order, reading_line(readings.columns).alias("line"))
    pieces = windowed_text(lines, ["user_id", "day"], list(order), F.concat(F.lit(header), F.col("day").cast("string")),
                           F.date_trunc("minute", F.col(order[0])), max_chars, overlap)
    return pieces.select("user_id", F.lit("raw").alias("kind"), F.col("day").cast("string").alias("part"), F.col("piece").cast("int").alias("piece"), "text")


_KIND_ORDER = ["profile", "event", "exam", "week", "raw"]


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunk numbers per user: profile, events, exams, weeks, raw days."""
    kind = F.array_position(F.array(*[F.lit(k) for k in _KIND_ORDER]), F.col("kind"))
    cell = F.concat(kind.cast("string"), F.substring("part", 1, 7))
    order = [kind, F.col("part"), F.col("piece")]
    return ranked(chunks, ["user_id"], order, cell, "chunk_idx").withColumn("chunk_idx", F.col("chunk_idx") - 1)


def chunk_corpus(profiles: DataFrame, events: DataFrame, exams: DataFrame, readings: DataFrame,
                 max_chars: int = MAX_CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """All chunks of all users; `semantic` marks everything but the raw readings."""
    parts = [profile_chunks(profiles), event_chunks(events), exam_chunks(exams), weekly_chunks(readings),
             raw_chunks(readings, max_chars=max_chars, overlap=overlap)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("semantic", F.col("kind") != "raw")


def semantic_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where("semantic")


def chunk_flat(events: DataFrame, exams: DataFrame, readings: DataFrame, max_chars: int = MAX_CHUNK_CHARS) -> DataFrame:
    """Row chunks for events and exams; a day of readings is one chunk, or consecutive pieces of bounded size."""
    ex = exams.select("user_id", F.lit("exam").alias("kind"), F.col("exam_id").cast("string").alias("part"), F.lit(0).alias("piece"), F.concat(
        F.lit("[EXAM] "), F.col("day").cast("string"), F.lit(" | "), reading_line(exams.columns, ""), F.lit(" | Location: "),
        _or_mark("exam_location", exams.columns), F.lit(" | Type: "), _or_mark("exam_type", exams.columns)).alias("text"))
    days = raw_chunks(readings, max_chars=max_chars, overlap=0, header="[DEVICE] Date: ").withColumn("kind", F.lit("day"))
    return event_chunks(events, " | ").unionByName(ex).unionByName(days)


def device_week_nodes(readings: DataFrame, order: Sequence[str] = ("time", "reading_id")) -> DataFrame:
    """Weekly device nodes: sentence, Monday date and an id from both."""
    week = week_key(F.col("day"))
    per = readings.where(F.col("value_num").isNotNull()).groupBy("user_id", week.alias("week"), "indicator").agg(
        F.avg("value_num").alias("m"), F.min("value_num").alias("mn"), F.max("value_num").alias("mx"),
        F.min_by("unit", F.struct(*order)).alias("unit"), F.min(F.struct(*order, F.col("day"))).alias("first"))
    line = F.concat("indicator", F.lit(": mean="), _fixed(F.col("m"), 1), F.lit(", min="), _fixed(F.col("mn"), 1), F.lit(", max="),
                    _fixed(F.col("mx"), 1), F.lit(" "), F.coalesce("unit", F.lit("")))
    weeks = per.groupBy("user_id", "week").agg(
        F.sort_array(F.collect_list(F.struct("indicator", line.alias("l")))).alias("r"), F.min("first").alias("first"))
    sentence = F.concat(F.lit("Device indicators for "), "week", F.lit(": "), F.array_join(F.transform("r", lambda x: x["l"]), "; "))
    nodes = weeks.select("user_id", "week", sentence.alias("sentence"), monday(F.col("first.day")).cast("string").alias("timestamp"),
                         F.transform("r", lambda x: x["indicator"]).alias("entities"))
    return nodes.withColumn("event_id", F.concat(F.lit("event-"), F.md5(F.concat_ws("-", "sentence", "timestamp"))))


def event_batch_chunks(events: DataFrame, size: int = 10) -> DataFrame:
    """Events in consecutive groups per user."""
    c = events.columns
    interrupted = _interrupted(c)
    line = F.concat(
        F.lit("["), F.col("start_date").cast("string"), F.lit("] Event: "), _or_mark("event_name", c), F.lit(", Type: "), _or_mark("event_type", c),
        F.lit(", Start: "), _or_mark("start_date", c), F.lit(", Duration: "), _or_mark("duration_days", c), F.lit(" days, Interrupted: "),
        F.when(interrupted, F.lit("True")).otherwise(F.lit("False")),
        F.when(interrupted & F.col("interruption_date").isNotNull(), F.concat(F.lit(", Interruption date: "), F.col("interruption_date").cast("string"))).otherwise(F.lit("")))
    body = joined_lines(event_batches(events, size), ["user_id", "batch"], ["position"], line)
    return body.select("user_id", F.lit("events").alias("kind"), F.col("batch").cast("string").alias("part"),
                       F.concat(F.lit("[DATA] Health Events\n"), "body").alias("text"))


def exam_day_chunks(exams: DataFrame, order: Sequence[str] = ("time", "exam_id")) -> DataFrame:
    body = joined_lines(exams, ["user_id", "day"], order, reading_line(exams.columns, ""))
    return body.select("user_id", F.lit("exams").alias("kind"), F.col("day").cast("string").alias("part"), F.concat(
        F.lit("[DATA] Exam Results on "), F.col("day").cast("string"), F.lit("\n"), "body").alias("text"))


def chunk_grouped(events: DataFrame, exams: DataFrame, readings: DataFrame, size: int = 10) -> DataFrame:
    """Events by tens, exams per day, weekly device nodes."""
    weeks = device_week_nodes(readings).select("user_id", F.lit("device_week").alias("kind"), F.col("week").alias("part"), F.col("sentence").alias("text"))
    return event_batch_chunks(events, size).unionByName(exam_day_chunks(exams)).unionByName(weeks)


def pack_lines(text: Column, max_chars: int = MAX_CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Pack the data lines of one document greedily; every chunk repeats the profile part.

    Without data lines the text is cut by characters. A line's chunk depends on all lines before it, and a fold that
    appends to an array copies it with each line, so this one pass over the lines is an Arrow-batched function.
    """
    return F.pandas_udf(_line_packer(max_chars, overlap), "array<string>")(text)


def _line_packer(max_chars: int, overlap: int):
    white = tx.WHITE_SPACE

    def sections(lines: list[str]) -> tuple[list[str], list[str]]:
        head, data, in_data = [], [], False
        for line in lines:
            mark = line.strip(white)
            if mark == "[PROFILE]":
                in_data = False
                continue
            in_data = in_data or mark.startswith("[DATA]")
            (data if in_data else head).append(line)
        return head, data

    def chunks(text: str) -> list[str]:
        head, data = sections(text.split("\n"))
        if not data:
            step = max_chars - overlap
            return [text] if len(text) <= max_chars else [text[i:i + max_chars] for i in range(0, len(text), step)]
        groups: list[list[str]] = [[]]
        size = 0
        for line in data:
            if groups[-1] and size + len(line) + 1 > max_chars:
                groups.append([])
                size = 0
            groups[-1].append(line)
            size += len(line) + 1
        packed = ["\n".join(g) for g in groups]
        if not head:
            return packed
        profile = "[PROFILE]\n" + "\n".join(head)
        return [profile, *(profile + "\n" + p for p in packed)]

    def pack(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else chunks(t) for t in texts], dtype=object)
    return pack


# --- fingerprints -----------------------------------------------------------------------------------------


def content_fingerprint(df: DataFrame, keys: Sequence[str], *parts: Column) -> DataFrame:
    """Fingerprint of the multiset of rows per key, whatever their order.

    Row digests are added up, so the work is a plain aggregate and no group is gathered. Put a
    position among `parts` to make the order count.
    """
    digest = F.md5(F.concat_ws("\x1f", *[p.cast("string") for p in parts]))

    def limb(start: int) -> Column:
        return F.sum(F.conv(F.substring(digest, start, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")

    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[limb(1 + 8 * i).alias(f"_s{i}") for i in range(4)])
    return sums.select(*keys, "n_rows", F.md5(F.concat_ws(":", F.col("n_rows").cast("string"), *[
        F.col(f"_s{i}").cast("string") for i in range(4)])).alias("fingerprint"))


# --- context -------------------------------------------------------------------------------------------------

# --- fixed values: frame of the retrieval prompt, text fields in order of preference
NO_HITS = "(No relevant memories found)"
TEXT_FIELDS = ["episode", "summary", "memory", "content", "text"]
# -----------------------------------------------------------------------------------


def assemble_context(queries: DataFrame, hits: DataFrame, fields: Sequence[str] = ("text",)) -> DataFrame:
    """Ranked hits joined by blank lines, then the question. A query has at most its top k hits."""
    text = F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in fields])
    gathered = hits.groupBy("query_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", text.alias("t")))), lambda s: s["t"]), "\n\n").alias("_context"))
    context = F.coalesce("_context", F.lit(NO_HITS))
    return queries.join(gathered, "query_id", "left").select(
        "query_id", F.concat(context, F.lit("\n\nQuestion: "), "question", F.lit("\nThought: ")).alias("prompt"))
