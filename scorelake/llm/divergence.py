"""How far the sources of each language differ in their words, over collapsed copies.

Identical texts of a language become one row with the number of its copies in each source, so that a text is
tokenized once however often it was copied; its document frequency and its counts are added with these
multiplicities. Terms of enough documents of a language are kept. Their smoothed shares, in whole billionths, are compared
between the sources of the language, pair by pair, from the rows of occurring terms alone: a term that occurs in neither
block of sources adds the same difference as any other such term, so those are only counted. Terms over-represented in
a source against its language are listed beside it.

Rules for odd input: null text, lang and source are ''; a text without terms counts as a document of its source
only; a language without kept terms has pairs of value 0; repeated rows are copies, whatever their ids; an empty
table has no rows. Other columns are ignored. Values are exact whatever the size of the counts (38 digits).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.llm.common import stored

MIN_DOCS = 30
PRIOR = 5
TOP = 50
UNIT = 1_000_000_000
# Entries of the term counts that a task holds before it passes them on.
HELD = 300_000
# Sources that are compared with each other in one matrix, and rows of terms that go into it in one task.
SOURCES = 64
SLICE_ROWS = 16_384
# Rows of a table of languages or sources up to which it is sent to all executors; beyond, it is joined by a shuffle.
SENT_ROWS = 100_000
# Slices of a source in which its terms are ranked first.
RANK_SLICES = 16

# Letters of terms: A to Z in lower case, all bytes from 128 on as they are; anything else parts terms.
_LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def sent(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """`df`, a stored table, for a broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, data, sources): each distinct text of a language, and [(source, copies)]."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("data")).withColumn("dg", F.sha2("data", 256))
    # Copies are combined before each shuffle: a task sends a text once, and a count once for each source.
    copies = rows.groupBy("lang", "dg", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "dg").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    return rows.select("lang", "dg", "data").dropDuplicates(["lang", "dg"]).join(copies, ["lang", "dg"]).select("lang", "data", "sources")


def _count_terms(held: int):
    """Collapsed texts to rows (lang, source, term, n, docs), combined within the task as far as memory allows."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out():
            for (lang, source), (n, docs) in found.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()),
                                                  pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], names=names)

        for batch in batches:
            for lang, data, sources in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                terms = Counter(terms_of(data))
                for s in sources:
                    n, docs = found.setdefault((lang, s["source"]), (Counter(), Counter()))
                    before, copies = len(n), s["n"]
                    if copies == 1:
                        n.update(terms)
                        docs.update(terms.keys())
                    else:
                        for t, c in terms.items():
                            n[t] += c * copies
                            docs[t] += copies
                    size += len(n) - before
                if size > held:
                    yield from out()
                    found, size = {}, 0
        yield from out()
    return run


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * kinds)), exactly."""
    over = (count + F.lit(PRIOR)).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    under = (total + F.lit(PRIOR) * kinds).cast("decimal(19,0)")
    # The remainder goes first, so that the quotient is whole and no rounding can happen.
    return F.lit(1).cast("long") + ((over - over % under) / under).cast("long")


class Audit:
    """Counts of kept terms: `terms` (lang, source, term, n, p, q), `groups` (lang, source, total, kinds, p0)."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, held: int = HELD):
        once = stored(collapsed(docs).mapInArrow(_with_groups(held), "lang string, source string, term binary, n long, docs long"), "counts")
        counts = once.where("term is not null").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        counts = stored(counts, "terms")
        often = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"), "often")
        langs = stored(often.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n_lang").alias("lang_total")), "langs")
        own = stored(counts.drop("docs").join(often, ["lang", "term"]), "kept")
        totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        pairs = once.select("lang", "source").distinct()
        groups = pairs.join(totals, ["lang", "source"], "left").join(sent(langs), "lang", "left").select(
            "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kinds", F.lit(0)).alias("kinds"),
            F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
        p0 = F.when(F.col("kinds") > 0, share(F.lit(0), F.col("total"), F.col("kinds"))).otherwise(F.lit(0).cast("long"))
        self.groups = stored(groups.withColumn("p0", p0), "groups")
        with_totals = own.join(sent(self.groups), ["lang", "source"])
        self.terms = stored(with_totals.select(
            "lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"),
            share(F.col("n_lang"), F.col("lang_total"), F.col("kinds")).alias("q")), "shares")

    def typical(self, top: int = TOP) -> DataFrame:
        """(lang, source, term, value, rank): the terms a source has more of than its language, most first."""
        over = self.terms.where("p > q").select("lang", "source", "term", (F.col("p") - F.col("q")).alias("value"))
        order = [F.desc("value"), F.asc("term")]
        # A source may hold a third of all terms: its slices are cut first, each by many tasks.
        cut = over.withColumn("_s", F.pmod(F.xxhash64("term"), F.lit(RANK_SLICES))).withColumn(
            "_r", F.row_number().over(W.partitionBy("lang", "source", "_s").orderBy(*order))).where(F.col("_r") <= top).drop("_s", "_r")
        return cut.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)

    def distances(self, sources: int = SOURCES, slice_rows: int = SLICE_ROWS) -> DataFrame:
        """(lang, source, other, value) for each two sources of a language, both ways.

        Sources are dealt to blocks and terms to slices; a task gets the rows of one slice for two blocks and returns
        sums for pairs of sources, of which there are far fewer than rows.
        """
        size = self.groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources")).join(
            self.terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows")), "lang", "left").select(
            "lang", F.ceil(F.col("n_sources") / sources).cast("int").alias("blocks"),
            F.greatest(F.ceil(F.coalesce("n_rows", F.lit(0)) / slice_rows), F.lit(1)).cast("int").alias("slices"))
        size = sent(stored(size, "sizes"))
        block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        rows = self.terms.join(size, "lang").select("lang", "source", "term", "p", block.alias("block"), F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"), other)
        marks = self.groups.join(size, "lang").select("lang", "source", F.lit(None).cast("binary").alias("term"), F.col("p0").alias("p"), block.alias("block"), "slices", other).select(
            "lang", "source", "term", "p", "block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "other")
        met = rows.unionByName(marks).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        keys = ["lang", "low", "high", "slice"]
        parts = met.select(*keys, "source", "block", "term", "p").repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_first("term")).mapInArrow(
            _pair_sums, "lang string, a string, b string, value decimal(38,0), seen long")
        sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
        p0 = sent(self.groups.select("lang", "source", "kinds", "p0"))
        whole = sums.join(p0.select("lang", F.col("source").alias("a"), "kinds", F.col("p0").alias("pa")), ["lang", "a"]).join(
            p0.select("lang", F.col("source").alias("b"), F.col("p0").alias("pb")), ["lang", "b"])
        value = (F.col("value") + ((F.col("kinds") - F.col("seen")) * F.abs(F.col("pa") - F.col("pb")))).cast("long")
        both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("other")), F.struct(F.col("b").alias("source"), F.col("a").alias("other")))).alias("_x")
        return whole.select("lang", value.alias("value"), both).select("lang", "_x.source", "_x.other", "value")


def _with_groups(held: int):
    """Counted terms, and a row without a term for each (lang, source) that a task meets."""
    count = _count_terms(held)

    def run(batches):
        met: set[tuple[str, str]] = set()

        def seen():
            for batch in batches:
                for lang, sources in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    met.update((lang, s["source"]) for s in sources)
                yield batch
        yield from count(seen())
        rows = sorted(met)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.nulls(len(rows), pa.binary()),
                                          pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], names=["lang", "source", "term", "n", "docs"])
    return run


def _pair_sums(batches):
    """Sorted rows of slices to sums of absolute differences for pairs of sources of the two blocks.

    A slice starts with all sources of both blocks and their share of a term that they lack.
    """
    from decimal import Decimal

    key, names, at, blocks, missing = None, [], {}, [], []
    sums, seen, term, row = None, 0, None, None

    def close_term():
        nonlocal sums, seen
        if row is not None:
            line = np.array(row, np.int64)
            sums += np.abs(line[:, None] - line[None, :])
            seen += 1

    def close_slice():
        close_term()
        total = np.zeros((len(names), len(names)), np.int64) if sums is None else sums
        wanted = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if key[1] == key[2] or blocks[i] != blocks[j]]
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(wanted), pa.string()), pa.array([names[i] for i, _ in wanted], pa.string()), pa.array([names[j] for _, j in wanted], pa.string()),
                                           pa.array([Decimal(int(total[i, j])) for i, j in wanted], pa.decimal128(38, 0)), pa.array([seen] * len(wanted), pa.int64())],
                                          names=["lang", "a", "b", "value", "seen"])

    for batch in batches:
        for now in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if now[:4] != key:
                if key is not None:
                    yield close_slice()
                key, names, at, blocks, missing = now[:4], [], {}, [], []
                sums, seen, term, row = None, 0, None, None
            source, block, this, p = now[4:]
            if this is None:
                at[source] = len(names)
                names.append(source)
                blocks.append(block)
                missing.append(p)
                continue
            if sums is None:
                sums = np.zeros((len(names), len(names)), np.int64)
            if this != term:
                close_term()
                term, row = this, list(missing)
            row[at[source]] = p
    if key is not None:
        yield close_slice()


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): `pair` with all other sources, `term` with the first `top` terms."""
    found = Audit(docs, min_docs)
    pairs = found.distances().select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))
    terms = found.typical(top).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    return ranked.unionByName(terms)
