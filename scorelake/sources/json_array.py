"""Objects of one huge JSON array per file, in byte ranges, up to the first damage.

Spark's text source cuts a file at closing braces, which may be anywhere: within strings and nested objects. Whether
a brace ends an object of the outer array follows from what came before it. So every byte range of a cut
file is first summed up (is a string open at its end, how deep are brackets, from either state at its start); the
sums of a file's ranges, put together in order, tell where each range starts, and then all ranges are read
at once. Objects that lie over a border are put together from their pieces.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.session import checkpointed

_RANGE = "path string, start long, size long, bytes long, open_a int, depth_a long, open_b int, depth_b long"
_PIECE = "path string, start long, n long, kind string, text string"


def _lexer():
    """The step over one stretch of text, as a closure: it travels to the workers by value."""
    import re

    escaped = re.compile(r"\\.", re.DOTALL)

    def step(text: str, inside: int) -> tuple[int, int]:
        """Whether a string is open after the text, and how much deeper brackets are."""
        parts = (escaped.sub("", text) if "\\" in text else text).split('"')
        deeper = 0
        for p in parts[1::2] if inside else parts[0::2]:
            deeper += p.count("{") + p.count("[") - p.count("}") - p.count("]")
        return (len(parts) - 1 + inside) % 2, deeper
    return step


def _sum_up():
    step = _lexer()

    def run(batches):
        key, row = None, None
        for pdf in batches:
            out = []
            for path, start, size, length, text in zip(pdf["path"], pdf["start"], pdf["size"], pdf["length"], pdf["value"]):
                if (path, start) != key:
                    if key is not None:
                        out.append(tuple(row))
                    key, row = (path, start), [path, start, size, 0, 0, 0, 1, 0]
                row[3] += length + 1
                for at in (4, 6):
                    row[at], deeper = step(text + "}", row[at])
                    row[at + 1] += deeper
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _RANGE.split(", ")])
        if key is not None:
            yield pd.DataFrame([tuple(row)], columns=[c.split()[0] for c in _RANGE.split(", ")])
    return run


def _place(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ranges of one file to the state at the start of each."""
    inside, depth, before, out = 0, 0, 0, []
    for r in pdf.sort_values("start").itertuples():
        out.append((r.path, r.start, inside, depth, before))
        inside, depth = (r.open_b, depth + r.depth_b) if inside else (r.open_a, depth + r.depth_a)
        before += r.bytes
    return pd.DataFrame(out, columns=["path", "start", "inside", "depth", "before"])


def _cut():
    """Records of byte ranges, in order and next to the state at the start of their range, to whole objects and pieces of objects."""
    step = _lexer()

    def run(batches):
        key, held, n, inside, depth, used, headless = None, [], 0, 0, 0, 0, False

        def rest(out: list) -> None:
            # What a range ends with is the start, or the middle, of an object.
            text = "".join(held)
            if text.strip(" \t\r\n,[]"):
                out.append((key[0], key[1], n, "middle" if headless else "start", text))

        for pdf in batches:
            out: list[tuple] = []
            columns = ("path", "start", "size", "length", "value", "inside", "depth", "before")
            for path, start, size, length, text, was_inside, was_depth, before in zip(*(pdf[c] for c in columns)):
                if (path, start) != key:
                    if key is not None:
                        rest(out)
                    key, held, n = (path, start), [], 0
                    if start and was_inside < 0:
                        raise RuntimeError("byte ranges have changed since they were summed up; set spark.sql.files.minPartitionNum")
                    inside, depth, used = (was_inside, was_depth, before) if start else (0, 0, 0)
                    headless = bool(inside) or depth > 1
                used += length + 1
                ended = used <= size  # else the file stops before the brace
                text = text + "}" if ended else text
                held.append(text)
                inside, deeper = step(text, inside)
                depth += deeper
                if ended and not inside and depth == 1:
                    out.append((path, start, n, "end" if headless else "whole", "".join(held)))
                    held, n, headless = [], n + 1, False
            yield pd.DataFrame(out, columns=["path", "start", "n", "kind", "text"])
        out = []
        if key is not None:
            rest(out)
        yield pd.DataFrame(out, columns=["path", "start", "n", "kind", "text"])
    return run


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, n, text) of the objects of each file's outer array; (start, n) is their order within the file.

    A file that is cut short gives its whole objects. Texts are not parsed here; see `until_damage`.
    """
    m = "_metadata.file_"
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.col(f"{m}path").alias("path"), F.col(f"{m}block_start").alias("start"), F.col(f"{m}size").alias("size"),
        F.octet_length("value").cast("long").alias("length"), "value", F.col(f"{m}block_length").alias("_part"))
    cut = rows.where("_part < size").drop("_part")
    ranges = checkpointed(cut.mapInPandas(_sum_up(), _RANGE))
    whole_files = ranges.isEmpty()
    # One row for each range that starts within a file; the join leaves the records of a range in order.
    none = [F.lit(-1).alias("inside"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("before")]
    if whole_files:
        known = rows.select("*", *none)
    else:
        placed = ranges.groupBy("path").applyInPandas(_place, "path string, start long, inside int, depth long, before long")
        known = rows.join(F.broadcast(placed.where("start > 0")), ["path", "start"], "left").fillna(-1, ["inside"]).fillna(0, ["depth", "before"])
    pieces = known.select("path", "start", "size", "length", "value", "inside", "depth", "before").mapInPandas(_cut(), _PIECE)
    if whole_files:
        return _bare(pieces.where("kind = 'whole'").select("path", "start", "n", "text"))
    pieces = checkpointed(pieces)
    whole = pieces.where("kind = 'whole'").select("path", "start", "n", "text")
    # At most two pieces for each range; an object takes the place of its first piece.
    along = W.partitionBy("path").orderBy("start", "n")
    numbered = pieces.where("kind <> 'whole'").withColumn("_object", F.count_if(F.col("kind") == "start").over(along))
    joined = numbered.groupBy("path", "_object").agg(
        F.sort_array(F.collect_list(F.struct("start", "n", "kind", "text"))).alias("_p")).where(
        (F.element_at("_p", -1)["kind"] == "end") & (F.col("_p")[0]["kind"] == "start"))
    sewn = joined.select("path", F.col("_p")[0]["start"].alias("start"), F.col("_p")[0]["n"].alias("n"), F.array_join("_p.text", "").alias("text"))
    return _bare(whole.unionByName(sewn))


def _bare(objects: DataFrame) -> DataFrame:
    """Objects without the comma, bracket or blank before them."""
    return objects.withColumn("text", F.regexp_replace("text", r"^[\s,]*\[?[\s,]*", ""))


def until_damage(objects: DataFrame, schema: str) -> DataFrame:
    """`objects` parsed into the column `item`, of each file only those before the first that is no JSON object."""
    bad = "_bad"
    parsed = objects.withColumn("item", F.from_json("text", f"{schema}, {bad} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})).drop("text")
    broken = F.col("item").isNull() | F.col(f"item.{bad}").isNotNull()
    first = parsed.where(broken).groupBy("path").agg(F.min(F.struct("start", "n")).alias("_first"))
    return parsed.where(~broken).join(first, "path", "left").where(
        F.col("_first").isNull() | (F.struct("start", "n") < F.col("_first"))).drop("_first")
