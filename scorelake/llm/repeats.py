"""Byte repeats across documents by common-prefix intervals over a sparse suffix array.

Every string of `min_bytes` bytes holds at least one anchor: a position whose hash of the next
GRAM bytes is least among those of the string. Equal strings have equal anchors at equal offsets,
so only anchors that occur twice or more can lie in a repeat, and all occurrences of a repeat meet
at the key of their anchor. There the suffixes from the anchors are sorted, their common-prefix
intervals are found by a stack scan, and each interval is tested for how far its members agree to
the left; members that agree over `min_bytes` bytes in all form a maximal repeat group.

Passages of `min_words` words, where they are asked for, are found in the same way in the strings
of the words' codes, so the white space between words does not count there.

Rules for odd input: null and empty texts have no bytes and no repeats; rows without doc_id are
treated like others; equal texts, also under one doc_id, are copies of each other and repeats
from end to end if they have `min_bytes` bytes or `min_words` words. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import MASK, given_id, mixed, solid_id, splitmix, stored

MIN_BYTES = 400
GRAM = 64
# A passage of over 50 words.
MIN_WORDS = 51
# Bytes of a word's code.
CODE = 8
# Occurrences of one anchor that one task sorts together; more are split by the bytes their windows share.
GROUP_ROWS = 1024
# Bytes of contexts that a task hands on at once.
OUT_BYTES = 1 << 22
# Parts into which a range of windows is cut where too many contexts share its bytes.
PARTS = 8

_CTX = "key long, _id long, _dg string, lefts int, ctx binary, positions array<int>"
_FOUND = "_id long, _dg string, start int, stop int"
_SPANS = "array<struct<start:int,stop:int,by_word:boolean>>"
_REACH = "kind binary, left int, right int"


# --- anchors of one document -----------------------------------------------------------------------

NUMBERS = splitmix(256, 1)
BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
BASE = 0x9E3779B97F4A7C15


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and where they stop."""
    inside = np.zeros(len(text) + 2, bool)
    inside[1:-1] = ~BLANK[np.frombuffer(bytearray(text), np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_codes(text: bytes) -> bytes:
    """The words of a text as hashes of CODE bytes each."""
    starts, stops = word_places(text)
    if not len(starts):
        return b""
    data = np.frombuffer(text, np.uint8)[starts[0]: stops[-1]]
    place = np.arange(len(data)) - np.repeat(starts - starts[0], np.diff(starts, append=stops[-1]))
    powers = np.full(place.max() + 1, BASE, np.uint64)
    powers[0] = 1
    values = np.where(BLANK[data], np.uint64(0), NUMBERS[data] * np.cumprod(powers)[place])
    return mixed(np.add.reduceat(values, starts - starts[0])).tobytes()


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of `gram` bytes (a power of two), by doubling."""
    h, span = NUMBERS[data], 1
    while span < gram:
        h = h[:-span] * np.uint64(pow(BASE, span, MASK + 1)) + h[span:]
        span *= 2
    return mixed(h)


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each run of w values."""
    padded = np.full(-(-len(v) // w) * w, MASK, dtype=np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(v) - w + 1], ahead[w - 1: len(v)])


def anchors(text: bytes, min_bytes: int, gram: int) -> tuple[np.ndarray, ...]:
    """(position, key, first, last): anchors, and the first and last window each is the least of.

    Of equal hashes the first is taken, so each window has one anchor, which its bytes decide.
    """
    if len(text) < min_bytes:
        return (np.empty(0, np.int64),) * 4
    h = gram_hashes(np.frombuffer(text, np.uint8), gram)
    low = np.uint64(len(h).bit_length())
    ranked = ((h >> low) << low) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_least(ranked, min_bytes - gram + 1) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    return at[first], h[at[first]].view(np.int64), first, last


# --- groups of occurrences -------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi - 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def prefix_intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of each interval of a suffix array, inner ones first."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now = int(lcp[i]) if i < len(lcp) else -1
        first = i - 1
        while stack and stack[-1][0] > now:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if not stack or stack[-1][0] < now:
            stack.append((now, first))


def scan_group(lefts: list[bytes], rights: list[bytes], min_bytes: int, groups: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How far each occurrence repeats left and right of its anchor; zeros where it doesn't.

    `lefts` are the bytes before the anchors, read backwards. If `groups` is given, maximal repeat
    groups are appended to it as (left length, right length, members).
    """
    m = len(rights)
    reach_l, reach_r = np.zeros(m, np.int64), np.zeros(m, np.int64)
    order = sorted(range(m), key=rights.__getitem__)
    lcp = np.array([0] + [common(rights[order[i - 1]], rights[order[i]]) for i in range(1, m)], np.int64)
    by_left = sorted(range(m), key=lefts.__getitem__)
    left_lcp = np.array([0] + [common(lefts[by_left[i - 1]], lefts[by_left[i]]) for i in range(1, m)], np.int64)
    rank = np.empty(m, np.int64)
    rank[by_left] = np.arange(m)
    back, suffix = np.array(by_left), np.array(order)
    place = np.empty(m, np.int64)
    place[suffix] = np.arange(m)
    most_left = int(left_lcp.max(initial=0))
    for depth, first, last in prefix_intervals(lcp):
        if depth + most_left < min_bytes:
            continue
        ranks = np.sort(rank[suffix[first:last + 1]])
        near = np.minimum.reduceat(left_lcp[: ranks[-1] + 1], ranks[:-1] + 1)
        best = np.maximum(np.append(near, 0), np.insert(near, 0, 0))
        hit = best + depth >= min_bytes
        who = back[ranks[hit]]
        reach_l[who] = np.maximum(reach_l[who], best[hit])
        reach_r[who] = np.maximum(reach_r[who], depth)
        if groups is not None:
            for left, a, b in prefix_intervals(np.insert(near, 0, 0)):
                members = back[ranks[a:b + 1]]
                at = place[members]
                # Those that agree further to the right are a group of an inner interval.
                if b > a and near[a:b].min() == left and left + depth >= min_bytes and lcp[at.min() + 1:at.max() + 1].min() == depth:
                    groups.append((left, depth, sorted(members.tolist())))
    return reach_l, reach_r


def _contexts(by_word: bool, min_bytes: int):
    """Rows (document, its repeated anchors) to one row per anchor key and distinct context."""
    names = ["key", "_id", "_dg", "lefts", "ctx", "positions"]

    def run(batches):
        for pdf in batches:
            out, held = [], 0
            for id_, dg, text, found in zip(pdf["_id"], pdf["_dg"], pdf["data"], pdf["found"], strict=True):
                text = word_codes(text) if by_word else text
                own: dict[tuple, list[int]] = {}
                for a in found:
                    at, lo = a["pos"], a["first"]
                    own.setdefault((a["key"], at - lo, text[lo: a["last"] + min_bytes]), []).append(at)
                out += [(key, id_, dg, left, ctx, at) for (key, left, ctx), at in own.items()]
                held += sum(len(ctx) for _, _, ctx in own)
                # Contexts overlap, so those of a batch take several times its bytes.
                if held >= OUT_BYTES:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)
    return run


def _by_group(rows_of, to_rows, columns: list[str]):
    """A function for mapInPandas over rows sorted by their first value: `to_rows` takes the rows of one value."""
    def run(batches):
        held: list[tuple] = []
        out: list[tuple] = []
        for pdf in batches:
            for row in zip(*(pdf[c] for c in rows_of), strict=True):
                if held and held[0][0] != row[0]:
                    out += to_rows(held)
                    held = []
                held.append(row)
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if held:
            out += to_rows(held)
        yield pd.DataFrame(out, columns=columns)
    return run


def _scan(min_bytes: int):
    """Context rows sorted by key to repeated stretches of documents, group after group."""
    def of_group(rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        seen: dict[tuple, list[tuple]] = {}
        for row in rows:
            seen.setdefault((row[3], bytes(row[4])), []).append(row)
        kinds = list(seen)
        if len(kinds) > 1:
            lefts, rights = [c[:n][::-1] for n, c in kinds], [c[n:] for n, c in kinds]
            reach_l, reach_r = scan_group(lefts, rights, min_bytes)
        else:
            reach_l, reach_r = [0], [0]
        for (n, c), left, right in zip(kinds, reach_l, reach_r, strict=True):
            own = seen[n, c]
            if len(c) >= min_bytes and (len(own) > 1 or len(own[0][5]) > 1):
                left, right = n, len(c) - n
            if right:
                out += [(r[1], r[2], p - int(left), p + int(right)) for r in own for p in r[5]]
        return out
    return _by_group(["key", "_id", "_dg", "lefts", "ctx", "positions"], of_group, ["_id", "_dg", "start", "stop"])


def _scan_parts(min_bytes: int):
    """Distinct parts of contexts, sorted by the bytes they share, to how far each repeats around its anchor."""
    def of_group(rows: list[tuple]) -> list[tuple]:
        parts = [(n, bytes(part)) for _, _, n, part in rows]
        reach_l, reach_r = scan_group([c[:n][::-1] for n, c in parts], [c[n:] for n, c in parts], min_bytes)
        return [(row[1], int(x), int(y)) for row, x, y in zip(rows, reach_l, reach_r, strict=True) if y]
    return _by_group(["core", "kind", "hi", "part"], of_group, ["kind", "left", "right"])


def _digest(part: Column, *numbers: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.format_string("%d " * len(numbers), *numbers).cast("binary"), part), 256))


def _in_range(parts: DataFrame, min_bytes: int, width: int) -> DataFrame:
    """Adds to parts their digest `sub` and that of the bytes all windows of their range share, `core`.

    A part holds the windows that start `lo` to `hi` bytes before the anchor, of the range of `width`
    windows from `least`.
    """
    core = F.substr("part", F.col("hi") - F.col("least") + 1, F.lit(min_bytes - width + 1))
    return parts.withColumn("sub", _digest(F.col("part"), F.col("lo"), F.col("hi"))).withColumn("core", _digest(core, F.col("least")))


def crowded_spans(contexts: DataFrame, min_bytes: int, gram: int, group_rows: int) -> DataFrame:
    """Repeated stretches (_id, _dg, spans) from context rows of anchors that occur very often.

    Windows that are equal start equally far before their anchor, so a range of such distances needs
    to meet only where the bytes that all its windows share are equal. Equal parts of contexts count
    as one. Where up to `group_rows` different ones share these bytes, they are sorted together;
    where more do, the range is cut into PARTS, down to single windows, which are equal if shared.
    """
    width = min_bytes - gram + 1
    found = stored(_in_range(contexts.select(
        "_id", "_dg", "positions", F.lit(0).alias("least"), (F.col("lefts") - F.octet_length("ctx") + min_bytes).alias("lo"),
        F.col("lefts").alias("hi"), F.col("ctx").alias("part")), min_bytes, width).withColumn("kind", F.col("sub")), "crowded")
    open_, times = found, F.sum(F.size("positions"))
    reaches = []
    while True:
        distinct = stored(open_.groupBy("sub").agg(
            times.alias("times"), F.min("kind").alias("kind"), *(F.any_value(c).alias(c) for c in ("core", "least", "lo", "hi", "part"))), "parts")
        # `kind` of the first round is `sub`: one row will do for all that have it.
        equal = distinct if open_ is found else open_.join(distinct.where("times > 1").select("sub"), "sub").withColumn("times", F.lit(2))
        reaches.append(equal.where("times > 1").select("kind", F.col("hi").alias("left"), (min_bytes - F.col("lo")).alias("right")))
        shared = stored(distinct.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
        few = distinct.join(shared.where(F.col("n") <= group_rows).select("core"), "core").select("core", "kind", "hi", "part")
        reaches.append(few.repartition("core").sortWithinPartitions("core").mapInPandas(_scan_parts(min_bytes), _REACH))
        many = shared.where(F.col("n") > group_rows).select("core")
        if width == 1 or many.isEmpty():
            break
        width = -(-width // PARTS)
        cells = distinct.join(many, "core").select(
            "kind", "lo", "hi", "part", "least", F.explode(F.sequence(
                F.floor((F.col("lo") - F.col("least")) / width).cast("int"), F.floor((F.col("hi") - F.col("least")) / width).cast("int"))).alias("cell"))
        cells = cells.withColumn("least", F.col("least") + F.col("cell") * width)
        lo, hi = F.greatest("lo", "least"), F.least("hi", F.col("least") + width - 1)
        open_ = stored(_in_range(cells.select(
            "kind", "least", lo.alias("lo"), hi.alias("hi"), F.substr("part", F.col("hi") - hi + 1, hi - lo + min_bytes).alias("part")), min_bytes, width), "cells")
        times = F.count(F.lit(1))
    reach = reaches[0]
    for more in reaches[1:]:
        reach = reach.unionByName(more)
    reach = stored(reach.groupBy("kind").agg(F.max("left").alias("left"), F.max("right").alias("right")), "reach")
    return found.select("kind", "_id", "_dg", "positions").join(reach, "kind").select("_id", "_dg", F.transform(
        "positions", lambda at: F.struct((at - F.col("left")).alias("start"), (at + F.col("right")).alias("stop"))).alias("spans"))


def _find_anchors(lengths: dict[bool, int], gram: int):
    """Anchors of texts; the last bit of a key tells whether it is one of bytes or of words' codes."""
    def run(batches):
        for pdf in batches:
            for by_word, length in lengths.items():
                found = [anchors(word_codes(t) if by_word else t, length, gram) for t in pdf["data"]]
                each = [len(f[0]) for f in found]
                columns = {c: np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i, c in enumerate(("pos", "key", "first", "last"))}
                columns["key"] = columns["key"] & ~1 | int(by_word)
                yield pd.DataFrame({"_id": np.repeat(pdf["_id"].to_numpy(), each), "_dg": np.repeat(pdf["_dg"].to_numpy(), each)} | columns)
    return run


def _by_word(key: Column) -> Column:
    return key.bitwiseAND(1) == 1


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(_id, _dg, data): the texts as bytes under their id and digest."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(solid_id("doc_id").alias("_id"), data.alias("data")).withColumn("_dg", F.sha2("data", 256))


class Repeats:
    """What repeats in `docs`.

    `ids` has a row (_id, _dg, n_bytes, long, copies) for each document, `candidates` the distinct
    texts that share an anchor with another place, and `spans` the stretches of those that repeat,
    in bytes or in words' codes; they may overlap. One copy of a text stands for all copies in the
    search. Without `min_words`, words are not looked at.
    """

    def __init__(self, docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, group_rows: int = GROUP_ROWS, min_words: int | None = None):
        self.lengths = {False: min_bytes} | ({} if min_words is None else {True: min_words * CODE})
        texts, size = keyed_texts(docs), F.octet_length("data")
        long, least = size >= min_bytes, min_bytes
        if min_words is not None:
            least = min(min_bytes, 2 * min_words - 1)
            words = F.regexp_count(F.col("data").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))
            long = F.when(size < least, False).when(long, True).otherwise(words >= min_words)
        rows = texts.select("_id", "_dg", size.cast("bigint").alias("n_bytes"), long.alias("long"))
        kinds = rows.groupBy("_dg").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("copies"))
        self.ids = stored(rows.join(kinds, "_dg"), "texts")
        found = stored(texts.where(size >= least).mapInPandas(
            _find_anchors(self.lengths, gram), "_id long, _dg string, pos int, key long, first int, last int"), "anchors")
        single = found.join(self.ids.where("_id = _rep").select("_id", "_dg").distinct(), ["_id", "_dg"], "left_semi")
        # Stored, so that the join below has a shuffle on either side and its hot keys can be split.
        often = stored(single.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
        # A short hash of the digest tells texts of one id apart.
        texts, single = (df.withColumn("_at", F.xxhash64("_dg")) for df in (texts, single))
        per_doc = single.drop("_dg").join(often, "key").groupBy("_id", "_at").agg(F.collect_list(F.struct("key", "n", "pos", "first", "last")).alias("found"))
        self.candidates = stored(texts.join(per_doc, ["_id", "_at"]).drop("_at"), "candidates")
        settled = []
        for by_word, length in self.lengths.items():
            few = self._contexts_where(by_word, lambda a: a["n"] <= group_rows).repartition("key").sortWithinPartitions("key")
            settled.append(stored(few.mapInPandas(_scan(length), _FOUND), "spans").select(
                "_id", "_dg", F.array(F.struct("start", "stop", F.lit(by_word).alias("by_word"))).alias("spans")))
            if not often.where((F.col("n") > group_rows) & (_by_word(F.col("key")) == by_word)).isEmpty():
                many = crowded_spans(self._contexts_where(by_word, lambda a: a["n"] > group_rows), length, gram, group_rows)
                settled.append(many.select("_id", "_dg", F.transform(
                    "spans", lambda x: x.withField("by_word", F.lit(by_word))).alias("spans")))  # noqa: B023
        spans = settled[0]
        for more in settled[1:]:
            spans = spans.unionByName(more)
        self.spans = spans.groupBy("_id", "_dg").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def _contexts_where(self, by_word: bool, wanted) -> DataFrame:
        """Context rows of the anchors of bytes or of words' codes that are wanted."""
        some = self.candidates.select("_id", "_dg", "data", F.filter(
            "found", lambda a: (_by_word(a["key"]) == by_word) & wanted(a)).alias("found")).where(F.size("found") > 0)
        return some.mapInPandas(_contexts(by_word, self.lengths[by_word]), _CTX)

    def whole(self) -> Column:
        """Whether a text repeats from end to end because it has a copy."""
        return (F.col("copies") > 1) & F.col("long")


def in_bytes(text: bytes, spans) -> list[tuple[int, int]]:
    """Stretches as places in the text; those of codes go from their first whole word to their last."""
    out = [(s["start"], s["stop"]) for s in spans if not s["by_word"]]
    if len(out) < len(spans):
        starts, stops = word_places(text)
        out += [(int(starts[-(-s["start"] // CODE)]), int(stops[s["stop"] // CODE - 1])) for s in spans if s["by_word"]]
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint stretches; touching ones join."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def cut(text: bytes, spans) -> tuple[bytes, int]:
    """The bytes outside the stretches, and how many separate stretches went."""
    runs, kept, last = merged(in_bytes(text, spans)), [], 0
    for start, stop in runs:
        kept.append(text[last:start])
        last = stop
    return b"".join(kept) + text[last:], len(runs)


def _measure(batches):
    for pdf in batches:
        out = []
        for id_, dg, text, spans in zip(pdf["_id"], pdf["_dg"], pdf["data"], pdf["spans"], strict=True):
            left, runs = cut(text, spans)
            out.append((id_, dg, len(text) - len(left), runs, hashlib.sha256(left).hexdigest()))
        yield pd.DataFrame(out, columns=["_id", "_dg", "gone", "runs", "left_sha256"])


def measure_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row (doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of `docs`."""
    found = Repeats(docs, min_bytes, gram, group_rows)
    part = found.candidates.select("_id", "_dg", "data").join(found.spans, ["_id", "_dg"]).mapInPandas(
        _measure, "_id long, _dg string, gone long, runs long, left_sha256 string").dropDuplicates(["_id", "_dg"])
    whole, none = found.whole(), F.sha2(F.lit(b""), 256)
    return found.ids.join(part, ["_id", "_dg"], "left").select(
        given_id("_id").alias("doc_id"), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, none).otherwise(F.coalesce("left_sha256", "_dg")).alias("kept_sha256"))


def _cut_text(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([cut(t, s)[0].decode("utf-8", "ignore") for t, s in zip(text, spans, strict=True)], dtype=object)


def without_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, group_rows: int = GROUP_ROWS, min_words: int | None = None) -> DataFrame:
    """`docs` (doc_id, text, lang, source, n_chars) with all repeats cut out of the texts.

    These are strings of `min_bytes` bytes and, if `min_words` is given, runs of that many words. Bytes of a character that a cut has split go too, and n_chars is counted anew where something
    was cut. A text that repeats as a whole becomes empty; null stays null.
    """
    found = Repeats(docs, min_bytes, gram, group_rows, min_words)
    everything = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("stop"), F.lit(False).alias("by_word")))
    spans = found.ids.distinct().join(found.spans, ["_id", "_dg"], "left").select(
        "_id", "_dg", F.when(found.whole(), everything).otherwise(F.col("spans")).alias("spans")).where("spans is not null")
    keyed = docs.select("doc_id", "text", "lang", "source", "n_chars", solid_id("doc_id").alias("_id"),
                        F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("_dg"))
    shorten = F.pandas_udf(_cut_text, "string")
    nothing = F.array().cast(_SPANS)
    cells = keyed.join(spans, ["_id", "_dg"], "left").withColumn(
        "_cut", shorten(F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.coalesce("spans", nothing)))
    changed = F.col("spans").isNotNull() & F.col("text").isNotNull()
    return cells.select("doc_id", F.when(changed, F.col("_cut")).otherwise(F.col("text")).alias("text"), "lang", "source",
                        F.when(changed, F.char_length("_cut").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))
