"""Product codes of vectors, fitted on all of them over Hilbert-sorted flat blocks.

Components become integers floor(scale * x); a vector is cut into parts of consecutive components, and each
part position has its own codebook. The parts of one position are sorted along a Hilbert curve (Skilling, 2004)
and cut into flat blocks of bounded size, each with the least and greatest value of every component (its box) and
the sums of its members. In each round an entry stays on a block's shortlist only if its least distance to the
box is not above the smallest greatest distance of any entry; a block with one entry left is assigned by its
sums alone, any other by a small integer kernel over its shortlist. All arithmetic is exact: integers that could
leave 64 bits are handled as Python integers, and sums travel as 31-bit limbs.

Rules for odd input: rows whose vector is null, or holds a null, NaN or infinite component (or one beyond the range
of a float), are left out, as are those whose length is not the most frequent one (the longer one on a tie). If
the length is no multiple of `parts`, the first parts are one component longer. Rows with a null or repeated id
are coded like others; seeds are taken in the order of ids (null last) and, within an id, of vectors. With fewer
vectors than entries there are fewer entries. An error that does not fit in 64 bits is null, and so is the sum
it goes into. An empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK_ROWS = 256
# Labels with more than this share of all rows (so there are fewer than 256) get their sums from a table that is sent to all.
HOT_SHARE = 1 / 256
# Components beyond the range of a float count as not finite.
LARGEST = 3.5e38
LIMBS = 6
_LIMB = 31


# --- exact integers --------------------------------------------------------------------------------


def cut_points(dim: int, parts: int) -> list[int]:
    """Where the parts of a vector start; the last entry is its end."""
    short, longer = divmod(dim, parts)
    at = [0]
    for p in range(parts):
        at.append(at[-1] + short + (p < longer))
    return at


def to_limbs(values: list[int]) -> list[int]:
    """Integers as LIMBS numbers of 31 bits each, lowest first; the last carries the sign."""
    mask = (1 << _LIMB) - 1
    return [(v >> (_LIMB * i)) & mask if i < LIMBS - 1 else v >> (_LIMB * i) for v in values for i in range(LIMBS)]


def from_limbs(limbs: list[int]) -> list[int]:
    return [sum(int(x) << (_LIMB * i) for i, x in enumerate(limbs[at: at + LIMBS])) for at in range(0, len(limbs), LIMBS)]


class Packing:
    """Integers of one job as bytes: 16 or 32 bits where all fit, else limbs and Python integers."""

    def __init__(self, most: float):
        self.kind = "<i2" if most < 2**15 - 1 else "<i4" if most < 2**31 - 1 else None

    def whole(self, scaled: np.ndarray) -> np.ndarray:
        """floor() of doubles as exact integers."""
        low = np.floor(scaled)
        if self.kind:
            return low.astype(np.int64)
        return np.array([int(x) for x in low.ravel()], dtype=object).reshape(low.shape)

    def pack(self, values: np.ndarray) -> bytes:
        if self.kind:
            return values.astype(self.kind).tobytes()
        return np.array(to_limbs(values.ravel().tolist()), "<i8").tobytes()

    def unpack(self, data, width: int) -> np.ndarray:
        if self.kind:
            return np.frombuffer(data, self.kind).astype(np.int64).reshape(-1, width)
        limbs = np.frombuffer(data, "<i8").tolist()
        return np.array(from_limbs(limbs), dtype=object).reshape(-1, width)


def fits(reach: int, width: int) -> bool:
    """Whether squared distances between points within `reach` of 0 stay in 64 bits."""
    return 4 * reach * reach * max(width, 1) < 2**63


# --- Hilbert order ---------------------------------------------------------------------------------


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points with components in [0, 2**bits); bits * components <= 63."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    if not n:
        return np.zeros(len(cells), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def grid_cells(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, int]:
    """Cells of the components between their usual bounds, outliers in the outer ones; and bits a component."""
    used = min(values.shape[1], 63)
    if not used:
        return np.zeros((len(values), 0), np.int64), 1
    bits = min(16, 63 // used)
    span = np.maximum(high[:used] - low[:used], 1e-300)
    with np.errstate(over="ignore", invalid="ignore"):
        at = np.nan_to_num((values[:, :used] - low[:used]) / span, nan=0.0) * (1 << bits)
    return np.clip(at, 0, (1 << bits) - 1).astype(np.int64), bits


# --- blocks ----------------------------------------------------------------------------------------


def _summary(scale: int):
    """Rows (length, n, most, low, high): what a batch says of the layout. It never decides a result."""
    def run(batches):
        schema = pa.schema([("length", pa.int32()), ("n", pa.int64()), ("most", pa.float64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
        for batch in batches:
            column = batch.column(0)
            lengths = np.diff(column.offsets.to_numpy())
            flat, ends = column.flatten().to_numpy(), np.cumsum(lengths)
            rows = []
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                own = flat[(ends[at] - length)[:, None] + np.arange(length)] * float(scale)
                if length:
                    low, high = np.quantile(own, [0.005, 0.995], axis=0)
                    rows.append((length, len(at), float(np.abs(own).max()), low.tolist(), high.tolist()))
                else:
                    rows.append((0, len(at), 0.0, [], []))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
    return run


def _to_parts(scale: int, cuts: list[int], packing: Packing, low: np.ndarray, high: np.ndarray, id_type: pa.DataType, label_type: pa.DataType):
    """Vectors to rows (part, place, row, data), the id and label with part 0."""
    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            scaled = batch.column(0).flatten().to_numpy().reshape(n, cuts[-1]) * float(scale)
            whole = packing.whole(scaled)
            rows = pa.array(np.arange(row, row + n))
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                cells, bits = grid_cells(scaled[:, a:b], low[a:b], high[a:b])
                raw = packing.pack(np.ascontiguousarray(whole[:, a:b]))
                each = len(raw) // n
                data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, len(raw) + 1, each, dtype="<i4") if each else np.zeros(n + 1, "<i4")), pa.py_buffer(raw)])
                own = (batch.column(1), batch.column(2)) if not p else (pa.nulls(n, id_type), pa.nulls(n, label_type))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(hilbert_keys(cells, bits)), rows, data, *own],
                                                 names=["part", "place", "row", "data", "id", "label"])
            row += n
    return run


def _cut_blocks(cuts: list[int], packing: Packing, block_rows: int):
    """Sorted part rows to blocks of one part each."""
    def block(part: int, table: pa.Table) -> pa.RecordBatch:
        # Blocks are small, so each is one row; ids and labels come with part 0 only.
        width = cuts[part + 1] - cuts[part]
        raw = b"".join(table["data"].to_pylist())
        n, values = table.num_rows, packing.unpack(raw, width) if width else np.zeros((table.num_rows, 0), np.int64)
        ids, labels = table["id"].combine_chunks(), table["label"].combine_chunks()

        def one(values) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        own = [one(ids), one(labels)] if part == 0 else [one(ids[:0]), one(labels[:0])]
        sums = to_limbs([int(s) for s in values.sum(axis=0)])
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([packing.pack(values.min(axis=0))], pa.binary()),
             pa.array([packing.pack(values.max(axis=0))], pa.binary()), pa.array([sums], pa.list_(pa.int64())), one(table["row"].combine_chunks()),
             pa.array([raw], pa.binary()), *own], names=["part", "n", "low", "high", "sums", "rows", "data", "ids", "labels"])

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            parts, start, made = held["part"].to_numpy(), 0, []
            ends = np.append(np.flatnonzero(np.diff(parts)) + 1, len(parts)).tolist()
            for end in ends:
                last = end == len(parts)
                while end - start >= block_rows or (not last and start < end):
                    take = min(block_rows, end - start)
                    made.append(block(int(parts[start]), held.slice(start, take)))
                    start += take
            held = held.slice(start)
            if made:
                yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
        if held is not None and held.num_rows:
            yield block(int(held["part"][0].as_py()), held)
    return run


# --- rounds ----------------------------------------------------------------------------------------


def shortlist(low: list[int], high: list[int], entries: list[list[int]]) -> list[int]:
    """Entries that may be nearest to some point of a box, or tie there."""
    least, most = [], []
    for e in entries:
        near = far = 0
        for a, b, c in zip(low, high, e):
            gap = a - c if c < a else c - b if c > b else 0
            reach = max(b - c, c - a)
            near += gap * gap
            far += reach * reach
        least.append(near)
        most.append(far)
    bound = min(most)
    return [i for i, d in enumerate(least) if d <= bound]


class Codebooks:
    """Entries of each part as plain integers, with the arrays the kernels use."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries
        self.reach = [max((abs(x) for e in part for x in e), default=0) for part in entries]
        self.arrays = [np.array(part, dtype=np.int64 if reach < 2**62 else object).reshape(len(part), -1) for part, reach in zip(entries, self.reach, strict=True)]

    def shortlist(self, part: int, low: np.ndarray, high: np.ndarray) -> list[int]:
        """`shortlist` by arrays where its numbers fit."""
        width = len(low)
        reach = max(self.reach[part], *(abs(int(x)) for x in low), *(abs(int(x)) for x in high)) if width else 0
        if low.dtype == object or not fits(reach, width):
            return shortlist([int(x) for x in low], [int(x) for x in high], self.entries[part])
        c = self.arrays[part]
        gap = np.maximum(np.maximum(low - c, c - high), 0)
        far = np.maximum(high - c, c - low)
        return np.flatnonzero((gap * gap).sum(axis=1) <= (far * far).sum(axis=1).min()).tolist()

    def nearest(self, part: int, values: np.ndarray, among: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row; the lower entry on a tie."""
        if not values.shape[1]:
            return np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        c = self.arrays[part][among]
        reach = max(self.reach[part], int(np.abs(values).max()))
        if values.dtype == object or not fits(reach, values.shape[1]):
            values, c = values.astype(object), c.astype(object)
        gap = values[:, None, :] - c[None, :, :]
        square = (gap * gap).sum(axis=2)
        at = np.argmin(square, axis=1) if square.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in square.tolist()])
        return np.array(among)[at], square[np.arange(len(values)), at]


def _assign_sums(books: Codebooks, cuts: list[int], packing: Packing):
    """Blocks to one row (part, entry, n, sums) a task for each entry that got members."""
    def run(batches):
        n_of: dict[tuple[int, int], int] = {}
        sums_of: dict[tuple[int, int], list[int]] = {}

        def add(part, entry, n, sums):
            key = (part, entry)
            n_of[key] = n_of.get(key, 0) + n
            old = sums_of.get(key)
            sums_of[key] = sums if old is None else [a + b for a, b in zip(old, sums, strict=True)]

        for batch in batches:
            for part, n, low, high, sums, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                width = cuts[part + 1] - cuts[part]
                if not width:
                    add(part, 0, n, [])
                    continue
                among = books.shortlist(part, packing.unpack(low, width)[0], packing.unpack(high, width)[0])
                if len(among) == 1:
                    add(part, among[0], n, from_limbs(sums))
                    continue
                values = packing.unpack(data, width)
                entry, _ = books.nearest(part, values, among)
                for e in np.unique(entry).tolist():
                    own = values[entry == e]
                    add(part, e, len(own), [int(x) for x in own.sum(axis=0)])
        keys = sorted(n_of)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([n_of[k] for k in keys], pa.int64()),
                                          pa.array([to_limbs(sums_of[k]) for k in keys], pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])
    return run


def _assign_rows(books: Codebooks, cuts: list[int], packing: Packing, id_type: pa.DataType, label_type: pa.DataType):
    """Blocks to rows (row, part, entry, error, id, label)."""
    def run(batches):
        for batch in batches:
            parts, lows, highs, datas = (batch.column(i).to_pylist() for i in range(4))
            for i, (part, low, high, data) in enumerate(zip(parts, lows, highs, datas, strict=True)):
                rows, width = batch.column(4)[i].values, cuts[part + 1] - cuts[part]
                n = len(rows)
                values = packing.unpack(data, width) if width else np.zeros((n, 0), np.int64)
                among = books.shortlist(part, packing.unpack(low, width)[0], packing.unpack(high, width)[0]) if width else [0]
                entry, error = books.nearest(part, values, among)
                if error.dtype == object:
                    error = pa.array([int(x) if x < 2**63 else None for x in error], pa.int64())
                ids, labels = (batch.column(5)[i].values, batch.column(6)[i].values) if part == 0 else (pa.nulls(n, id_type), pa.nulls(n, label_type))
                yield pa.RecordBatch.from_arrays([rows, pa.array(np.full(n, part, np.int32)), pa.array(entry.astype(np.int32)), pa.array(error), ids, labels],
                                                 names=["row", "part", "entry", "error", "id", "label"])
    return run


# --- the operator ----------------------------------------------------------------------------------


def usable(vector: str) -> Column:
    """Whether a vector has finite components only."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) <= LARGEST))


@dataclass
class Compressed:
    """`rows` has (id, label, entries, code_bits, error); `codebooks[part][entry]` is a list of integers."""

    rows: DataFrame
    codebooks: list[list[list[int]]]

    def sha256(self) -> str:
        flat = ",".join(str(x) for part in self.codebooks for e in part for x in e)
        return hashlib.sha256(flat.encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> Compressed | None:
    """Fit codebooks on all vectors and code them; None if there is no vector.

    `rows` has one row for each coded vector: (id, label, code, error), the code being 2 hex digits for each part.
    The blocks are sorted once and stored; every round is one pass over them that returns at most parts x
    entries rows a task.
    """
    if entries > 256 or parts > 64:
        raise ValueError("a code has 2 hex digits for each of at most 64 parts")
    types = dict(vectors.dtypes)
    id_type, label_type = types[vec_id], types[label]
    whole = vectors.select(F.col(vector).cast("array<double>").alias("v"), F.col(vec_id).alias("id"), F.col(label).alias("label")).where(usable("v"))

    # The layout: length, width of integers, usual bounds of the components. Bounded: one row a length, one a component.
    seen = stored(whole.select("v").mapInArrow(_summary(scale), "length int, n long, most double, low array<double>, high array<double>"), "layout")
    lengths = seen.groupBy("length").agg(F.sum("n").alias("n"), F.max("most").alias("most")).orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    if not lengths:
        return None
    dim, most = lengths[0]["length"], lengths[0]["most"]
    bounds = seen.where(F.col("length") == dim).select(F.posexplode(F.arrays_zip("low", "high")).alias("i", "x")).groupBy("i").agg(
        F.percentile_approx("x.low", 0.5).alias("low"), F.percentile_approx("x.high", 0.5).alias("high")).orderBy("i").collect()
    low, high = np.array([b["low"] for b in bounds]), np.array([b["high"] for b in bounds])
    cuts, packing = cut_points(dim, parts), Packing(most + 1)
    kept = whole.where(F.size("v") == dim)

    first = kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    start = [[int(x) for x in packing.whole(np.array(r["v"], dtype=np.float64) * float(scale))] for r in first]
    books = [[v[a:b] for v in start] for a, b in zip(cuts, cuts[1:])]

    schema = f"part int, place long, row long, data binary, id {id_type}, label {label_type}"
    arrow_id, arrow_label = (_arrow_type(vectors, c) for c in (vec_id, label))
    flat = kept.mapInArrow(_to_parts(scale, cuts, packing, low, high, arrow_id, arrow_label), schema)
    blocks = stored(flat.repartitionByRange("part", "place", "row").sortWithinPartitions("part", "place", "row").mapInArrow(
        _cut_blocks(cuts, packing, block_rows),
        f"part int, n int, low binary, high binary, sums array<long>, rows array<long>, data binary, ids array<{id_type}>, labels array<{label_type}>"), "blocks")

    for _ in range(rounds):
        members = blocks.select("part", "n", "low", "high", "sums", "data").mapInArrow(
            _assign_sums(Codebooks(books), cuts, packing), "part int, entry int, n long, sums array<long>")
        widest = max(b - a for a, b in zip(cuts, cuts[1:]))
        totals = members.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(widest * LIMBS)]).alias("sums")).collect()
        for r in totals:
            width = cuts[r["part"] + 1] - cuts[r["part"]]
            books[r["part"]][r["entry"]] = [s // r["n"] for s in from_limbs(list(r["sums"])[: width * LIMBS])]

    coded = blocks.select("part", "low", "high", "data", "rows", "ids", "labels").mapInArrow(
        _assign_rows(Codebooks(books), cuts, packing, arrow_id, arrow_label), f"row long, part int, entry int, error long, id {id_type}, label {label_type}")
    # Eight parts to a long: their bits never overlap, so a sum puts them together.
    words = range(-(-parts // 8))
    bits = [F.sum(F.when(F.floor(F.col("part") / 8) == w, F.expr("shiftleft(CAST(entry AS BIGINT), 8 * (7 - part % 8))"))).alias(f"_w{w}") for w in words]
    hexed = F.concat(*[F.lower(F.lpad(F.hex(f"_w{w}"), 16, "0")) for w in words])
    # A part's error beyond 64 bits is null, and then so is the sum.
    rows = coded.groupBy("row").agg(*bits, F.when(F.count("error") == parts, F.try_sum("error")).alias("error"), F.max("id").alias("id"), F.max("label").alias("label")).select(
        "id", "label", F.substring(hexed, 1, 2 * parts).alias("code"), "error")
    return Compressed(rows, books)


def _arrow_type(df: DataFrame, c: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[c].dataType)


def with_label_errors(rows: DataFrame, label: str = "label", error: str = "error", hot_share: float = HOT_SHARE) -> DataFrame:
    """`rows` with label_error, the sum over the rows of an equal label (nulls together).

    Labels that hold more than a share of all rows, fewer than 1 / hot_share, are joined from a table sent to all
    executors; all others by a shuffle, in which no label is hot.
    """
    rows = stored(rows, "coded")
    sums = stored(rows.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"), F.when(F.count(error) == F.count(F.lit(1)), F.try_sum(error)).alias("_sum")), "labels")
    total = sums.agg(F.sum("_n")).first()[0] or 0
    hot = sums.where(F.col("_n") > total * hot_share)
    flagged = rows.join(F.broadcast(hot.select("_label", F.col("_sum").alias("_hot_sum"), F.lit(True).alias("_hot"))), F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
    known = flagged.where("_hot").withColumn("label_error", F.col("_hot_sum"))
    other = flagged.where("_hot IS NULL").join(sums.where(F.col("_n") <= total * hot_share).select("_label", "_sum"), F.col(label).eqNullSafe(F.col("_label"))).withColumn(
        "label_error", F.col("_sum"))
    return known.select(*rows.columns, "label_error").unionByName(other.select(*rows.columns, "label_error"))


def code_rows(vectors: DataFrame, **options) -> DataFrame:
    """One row (vec_id, code, error, label_error, codebooks_sha256) for each coded vector."""
    made = compress(vectors, **options)
    if made is None:
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"),
                              F.lit("").alias("codebooks_sha256")).limit(0)
    return with_label_errors(made.rows).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(made.sha256()).alias("codebooks_sha256"))
