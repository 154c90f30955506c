"""Token ids in raw shard files under a minimal perfect hash of the document keys.

Texts are sorted by key over all partitions; each task encodes its stretch and writes shards of bounded size: a
payload of nothing but ids (16 bits each if the vocabulary allows, else 32) and a file of offsets, one for each
document. Keys are dealt to buckets. For each bucket a minimal perfect hash (levels of bits, each set by the one key
that falls there; keys that collide go on to the next level; Limasset et al., 2017) gives every key its own slot
in a table of entries (fingerprint, shard, place in it, copies). Finding a document by key takes one bucket
file, one slot, two offsets and one stretch of a payload, however many documents there are. Shards, buckets and
counts are listed in a manifest, which holds only files of tasks that have ended well, so a task that runs twice
leaves an unlisted file and nothing else.

Rules for odd input: null is an empty text and has the end id alone; a null key sorts first and is found under
null; documents with one key lie next to each other, ordered by a hash of their texts, and are all found; a key that
was not written is not found, but for a chance of 2**-32 that its fingerprint agrees; an empty table has no
shards and no documents. Texts of any length are encoded in stretches that end at white space. Columns other than
the key and the text are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from bisect import bisect_right
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import given_id, mixed, solid_id, splitmix, stored
from scorelake.llm.wordbpe import WordEncoder, WordSplitter

SHARD_IDS = 1 << 25
SHARD_DOCS = 1 << 20
# Most keys of a bucket on average; its file has some 21 bytes for each.
BUCKET_KEYS = 1 << 18
# Characters that are encoded together, and of words that a worker remembers.
STRETCH = 4_000_000
HELD_CHARS = 10_000_000
# Bytes of a payload that are read at once.
READ_BYTES = 1 << 24
# Bits for each key that comes to a level of the hash.
GAMMA = 2.0
_MAGIC = b"IDXMPH01"
_ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("at", "<u4"), ("copies", "<u4")])


# --- files -----------------------------------------------------------------------------------------


def files_of(path: str):
    """(file system, path in it) of a folder that all executors share."""
    from pyarrow import fs

    if re.match(r"file:|/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes) -> None:
    system, at = files_of(path)
    with system.open_output_stream(at) as f:
        f.write(data)


def read_at(file, offset: int, size: int) -> bytes:
    return file.read_at(size, offset) if size else b""


# --- encoding --------------------------------------------------------------------------------------


class StretchEncoder:
    """Texts to raw ids. What stands between white space is looked up; new words are encoded in one call.

    The normaliser and the word pattern of the tokenizer never reach over white space, so a text is
    the sum of such pieces. The memory of pieces and words is dropped when it has grown too large.
    """

    def __init__(self, spec: dict, dtype: str, stretch: int = STRETCH, held: int = HELD_CHARS):
        from tokenizers import Tokenizer

        self.spec = spec
        self.dtype, self.stretch, self.held = dtype, stretch, held
        suffix, vocab = spec["model"].get("end_of_word_suffix"), spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for p, i in vocab.items() if p.endswith(suffix)]] = True
        apart = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        joined = spec | {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None, "post_processor": None,
                         "pre_tokenizer": {"type": "Sequence", "pretokenizers": [apart, spec["pre_tokenizer"]["pretokenizers"][-1]]}}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.joined = Tokenizer.from_str(json.dumps(joined))
        self.pattern = regex.compile(WordSplitter(spec).words.pattern + r"|\n")
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.chars = 0

    @cached_property
    def whole(self):
        """The tokenizer itself, for odd pieces."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(json.dumps(self.spec | {"truncation": None, "padding": None}))

    @cached_property
    def slow(self) -> WordEncoder:
        return WordEncoder(self.spec)

    def _raw(self, ids) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    @staticmethod
    def _odd(pieces: set[str]) -> list[str]:
        """Left to the library: special tokens, and code points that only some Unicode versions know."""
        marks = "".join(c for c in set().union(*pieces) if c == "<" or unicodedata.category(c) == "Cn")
        if not marks:
            return []
        mark = re.compile(f"[{re.escape(marks)}]")
        return [p for p in pieces if mark.search(p)]

    def _learn_words(self, words: set[str]) -> None:
        plain = [w for w in words if w not in self.words]
        ids = np.array(self.joined.encode(" ".join(plain), add_special_tokens=False).ids, dtype=np.int64) if plain else np.empty(0, np.int64)
        stops = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
        if len(stops) == len(plain):
            raw, size = self._raw(ids), np.dtype(self.dtype).itemsize
            bounds = [0, *(stops * size).tolist()]
            self.words.update((w, raw[a:b]) for w, a, b in zip(plain, bounds, bounds[1:], strict=False))
        else:  # a vocabulary that doesn't mark the ends of words
            self.words.update((w, self._raw(x)) for w, x in zip(plain, self.slow(plain), strict=True))
        self.chars += sum(map(len, plain))

    def _learn(self, pieces: set[str]) -> None:
        odd = self._odd(pieces)
        plain = list(pieces.difference(odd) if odd else pieces)
        found = self.pattern.findall(unicodedata.normalize("NFC", "\n".join(plain)).replace("Σ", "σ").lower())
        self._learn_words({w for w in found if w != "\n"})
        get, own, at = self.words.__getitem__, [], 0
        for w in found:
            if w == "\n":
                self.pieces[plain[at]] = b"".join(own)
                own, at = [], at + 1
            else:
                own.append(get(w))
        if plain:
            self.pieces[plain[at]] = b"".join(own)
        if odd:
            self.pieces.update((p, self._raw(e.ids)) for p, e in zip(odd, self.whole.encode_batch(odd, add_special_tokens=False), strict=True))
        self.chars += sum(map(len, pieces))

    def _stretches(self, text: str):
        at, space = 0, re.compile(r"[ \t-\r]")
        while len(text) - at > self.stretch:
            cut = space.search(text, at + self.stretch)
            if cut is None:
                break
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def __call__(self, texts: list[str]):
        """Raw ids of each text, bit by bit: an iterator of bytes for each."""
        group, size = [], 0
        for text in texts:
            if size + len(text) > self.stretch and group:
                yield from self._group(group)
                group, size = [], 0
            if len(text) > self.stretch:
                yield (x for s in self._stretches(text) for one in self._group([s]) for x in one)
                continue
            group.append(text)
            size += len(text)
        yield from self._group(group)

    def _group(self, texts: list[str]):
        if self.chars > self.held:
            self.pieces, self.words, self.chars = {}, {}, 0
        # Python takes four control characters for white space which the tokenizer does not.
        lists = [None if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        new = set()
        for pieces in lists:
            if pieces:
                new.update(pieces)
        new.difference_update(self.pieces)
        if new:
            self._learn(new)
        for text, pieces in zip(texts, lists, strict=True):
            if pieces is None:
                yield [self._raw(self.whole.encode(text, add_special_tokens=False).ids)]
            else:
                yield [b"".join(map(self.pieces.__getitem__, pieces))]


def worker_encoder(spec: dict, dtype: str) -> StretchEncoder:
    """The encoder of this Python worker. It outlives a task, and with it the words it has learnt."""
    import sys
    import types

    memory = sys.modules.setdefault("scorelake_worker_memory", types.ModuleType("scorelake_worker_memory")).__dict__
    key = f"encoder {zlib.crc32(json.dumps(spec, sort_keys=True).encode())} {dtype}"
    if key not in memory:
        memory[key] = StretchEncoder(spec, dtype)
    return memory[key]


# --- the minimal perfect hash ----------------------------------------------------------------------

_SEEDS = splitmix(256, 91)


def key_prints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.int64).view(np.uint64) ^ _SEEDS[255]) >> np.uint64(32)).astype(np.uint32)


def level_places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = _SEEDS[level % 254] + np.uint64(level // 254)
    return (mixed(mixed(keys.view(np.uint64) ^ seed)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Distinct 64-bit keys to the numbers 0 to n - 1, each once."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.bitwise_count(w).astype(np.int64) for w in levels]
        before = np.cumsum([0, *(int(c.sum()) for c in counts)])
        self.ranks = [b + np.cumsum(c) - c for b, c in zip(before, counts)]
        self.n = int(before[-1])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = GAMMA) -> PerfectHash:
        keys, levels = np.ascontiguousarray(keys, np.int64), []
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        while len(keys):
            size = 64 * max(1, -(-int(gamma * len(keys)) // 64))
            at = level_places(keys, len(levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            keys = keys[~alone]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 or any number for keys it was not built from."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            at = level_places(np.ascontiguousarray(keys[left], np.int64), level, 64 * len(words))
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = ((words[word] >> bit) & np.uint64(1)) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (ranks[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return out

    def to_bytes(self, entries: np.ndarray) -> bytes:
        sizes = np.array([self.n, len(self.levels), *map(len, self.levels)], "<u8").tobytes()
        return _MAGIC + sizes + b"".join(w.astype("<u8").tobytes() for w in self.levels) + entries.astype(_ENTRY).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, np.ndarray]:
        if data[:8] != _MAGIC:
            raise ValueError("not an index file")
        n, count = np.frombuffer(data, "<u8", 2, 8).tolist()
        sizes, at, levels = np.frombuffer(data, "<u8", count, 24).tolist(), 24 + 8 * count, []
        for size in sizes:
            levels.append(np.frombuffer(data, "<u8", size, at))
            at += 8 * size
        return cls(levels), np.frombuffer(data, _ENTRY, n, at)


def bucket_of(key: int, buckets: int) -> int:
    return zlib.crc32(str(key).encode()) % buckets


# --- writing ---------------------------------------------------------------------------------------


class _Shard:
    """One shard in the making; ids pass through, offsets are kept."""

    def __init__(self, folder: str, dtype: str):
        self.name = f"shard-{uuid.uuid4().hex}"
        self.system, self.at = files_of(f"{folder}/{self.name}")
        self.payload, self.size = self.system.open_output_stream(f"{self.at}.ids", buffer_size=1 << 20), np.dtype(dtype).itemsize
        self.offsets, self.ids = [0], 0

    def add(self, bits, end: bytes) -> None:
        for raw in bits:
            self.payload.write(raw)
            self.ids += len(raw) // self.size
        self.payload.write(end)
        self.ids += 1
        self.offsets.append(self.ids)

    def close(self) -> None:
        self.payload.close()
        with self.system.open_output_stream(f"{self.at}.offsets") as f:
            f.write(np.array(self.offsets, "<u8").tobytes())


_WRITTEN = "part long, shard int, name string, docs long, ids long, first long, last long, key long, at long"


def _write_shards(spec: dict, folder: str, end: int, dtype: str, shard_ids: int, shard_docs: int):
    """Sorted rows (key, text) to shard files; a row for each document and one for each shard."""
    names = [c.split()[0] for c in _WRITTEN.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        part, number, shard = TaskContext.get().partitionId(), 0, None
        encode, last = worker_encoder(spec, dtype), np.array([end], dtype).tobytes()
        first_key = last_key = None

        def closed() -> pa.RecordBatch:
            shard.close()
            row = {"part": part, "shard": number, "name": shard.name, "docs": len(shard.offsets) - 1, "ids": shard.ids, "first": first_key, "last": last_key}
            return pa.RecordBatch.from_pydict({c: pa.array([row.get(c)], _ARROW[c]) for c in names})

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            places, numbers = [], []
            for key, bits in zip(keys, encode(texts)):
                if shard is None:
                    shard, first_key = _Shard(folder, dtype), key
                places.append(len(shard.offsets) - 1)
                numbers.append(number)
                shard.add(bits, last)
                last_key = key
                if shard.ids >= shard_ids or len(shard.offsets) > shard_docs:
                    yield closed()
                    shard, number = None, number + 1
            n = len(keys)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part] * n, pa.int64()), "shard": pa.array(numbers, pa.int32()), "name": pa.nulls(n, pa.string()), "docs": pa.nulls(n, pa.int64()), "ids": pa.nulls(n, pa.int64()),
                "first": pa.nulls(n, pa.int64()), "last": pa.nulls(n, pa.int64()), "key": pa.array(keys, pa.int64()), "at": pa.array(places, pa.int64())})
        if shard is not None:
            yield closed()
    return run


_ARROW = {"part": pa.int64(), "shard": pa.int32(), "name": pa.string(), "docs": pa.int64(), "ids": pa.int64(), "first": pa.int64(), "last": pa.int64(), "key": pa.int64(), "at": pa.int64()}


def _by_bucket(batches, column: int = 0):
    """Sorted rows of batches, one bucket (or shard) at a time as (number, table)."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        numbers = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if now is not None and numbers[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(numbers[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _write_buckets(folder: str, shard_of: dict[tuple[int, int], int]):
    """Rows (bucket, key, part, shard, at, copies), sorted by bucket, to index files."""
    def run(batches):
        for bucket, rows in _by_bucket(batches):
            keys = rows["key"].to_numpy()
            perfect = PerfectHash.build(keys)
            entries = np.zeros(len(keys), _ENTRY)
            slot = perfect.slots(keys)
            entries["print"][slot] = key_prints(keys)
            entries["shard"][slot] = [shard_of[k] for k in zip(rows["part"].to_pylist(), rows["shard"].to_pylist())]
            entries["at"][slot] = rows["at"].to_numpy()
            entries["copies"][slot] = rows["copies"].to_numpy()
            name = f"index-{uuid.uuid4().hex}"
            write_file(f"{folder}/{name}", perfect.to_bytes(entries))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([name]), pa.array([len(keys)], pa.int64())], names=["bucket", "name", "keys"])
    return run


def write(docs: DataFrame, path: str, folder: str, end: int, key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS,
          shard_docs: int = SHARD_DOCS, bucket_keys: int = BUCKET_KEYS) -> IdStore:
    """Encode all texts with the tokenizer at `path` and write shards, index and manifest to a new `folder`.

    Documents lie in ascending order of their keys, each followed by the id `end`.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:  # of a fixed size; it goes to the tasks with their code
        spec = json.load(f)
    dtype = "<u2" if max(spec["model"]["vocab"].values(), default=0) < 1 << 16 and max((t["id"] for t in spec["added_tokens"]), default=0) < 1 << 16 and end < 1 << 16 else "<u4"
    system, at = files_of(folder)
    system.create_dir(at, recursive=True)
    rows = docs.select(solid_id(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The row number only parts rows that are equal, so that they need not share a task.
    order = ["key", "h", "row"]
    dealt = rows.select("key", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    written = stored(dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text").mapInArrow(
        _write_shards(spec, folder, end, dtype, shard_ids, shard_docs), _WRITTEN), "written")
    # The manifest: one row for each shard and bucket.
    shards = written.where("name is not null").orderBy("part", "shard").collect()
    for a, b in zip(shards, shards[1:]):
        if a["last"] > b["first"]:
            raise RuntimeError("shards are not in the order of keys")
    shard_of = {(s["part"], s["shard"]): i for i, s in enumerate(shards)}
    keys = written.where("name is null").groupBy("key").agg(F.min(F.struct("part", "shard", "at")).alias("x"), F.count(F.lit(1)).alias("copies"))
    keys = stored(keys.select("key", "x.part", "x.shard", "x.at", "copies"), "keys")
    n = keys.count()
    buckets = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // bucket_keys))))
    index = stored(keys.select(_bucket("key", buckets).alias("bucket"), "*").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _write_buckets(folder, shard_of), "bucket int, name string, keys long"), "buckets")
    manifest = {"dtype": dtype, "end": end, "buckets": buckets, "index": {str(r["bucket"]): r["name"] for r in index.collect()},
                "shards": [[s["name"], s["docs"], s["ids"]] for s in shards]}
    write_file(f"{folder}/manifest.json", json.dumps(manifest).encode())
    return IdStore(folder, manifest)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(buckets)).cast("int")


# --- reading ---------------------------------------------------------------------------------------


@dataclass
class IdStore:
    """Shards, index and manifest of a folder."""

    folder: str
    manifest: dict

    @classmethod
    def open(cls, folder: str) -> IdStore:
        system, at = files_of(folder)
        with system.open_input_file(f"{at}/manifest.json") as f:
            return cls(folder, json.loads(f.read()))

    def places(self) -> tuple[list[int], list[int]]:
        """Documents and ids before each shard; the last entries are the totals."""
        shards = self.manifest["shards"]
        return list(accumulate((s[1] for s in shards), initial=0)), list(accumulate((s[2] for s in shards), initial=0))

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of all documents under a key, read by one look into the index."""
        own = -(2**63) if key is None else key
        name = self.manifest["index"].get(str(bucket_of(own, self.manifest["buckets"])))
        if name is None:
            return []
        system, at = files_of(self.folder)
        with system.open_input_file(f"{at}/{name}") as f:
            perfect, entries = PerfectHash.from_bytes(f.read())
        one = np.array([own], np.int64)
        slot = int(perfect.slots(one)[0])
        if slot < 0 or entries["print"][slot] != key_prints(one)[0]:
            return []
        before, _ = self.places()
        first, out = before[int(entries["shard"][slot])] + int(entries["at"][slot]), []
        for shard, a, b in spread(before, first, int(entries["copies"][slot])):
            out += [x for _, _, x in _documents(self.folder, self.manifest, shard, a, b)]
        return out

    def find(self, keys: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, shard, first, last): where the documents of each distinct key lie; unknown keys have no row."""
        buckets = self.manifest["buckets"]
        asked = keys.select(solid_id(key).alias("key")).distinct()
        return asked.select(_bucket("key", buckets).alias("bucket"), "key").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
            _look_up(self.folder, self.manifest["index"], self.places()[0]), "key long, shard int, first long, last long")

    def documents(self, keys: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, start, ids) of all documents of the given keys; start is the number of ids before."""
        return self._read(keys, key, _ids_of, "ids array<int>")

    def checks(self, keys: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, start, n_tokens, ids_crc32) of all documents of the given keys, read in pieces of bounded size."""
        return self._read(keys, key, _crc_of, "n_tokens long, ids_crc32 long")

    def _read(self, keys: DataFrame, key: str, read, columns: str) -> DataFrame:
        found = self.find(keys, key)
        # A shard has a bounded size, so no task gets more than a few of them.
        return found.repartition("shard").sortWithinPartitions("shard", "first").mapInArrow(
            read(self.folder, self.manifest, self.places()[1]), f"key long, start long, {columns}").select(
            given_id("key").alias(key), "start", *[c.split()[0] for c in columns.split(", ")])


def spread(before: list[int], first: int, copies: int):
    """(shard, first, last) of a run of documents, which may go over shards."""
    shard, left = bisect_right(before, first) - 1, copies
    while left:
        a = max(first - before[shard], 0)
        b = min(before[shard + 1] - before[shard], a + left)
        if b > a:
            yield shard, a, b
            left -= b - a
        shard, first = shard + 1, before[shard + 1]


def _look_up(folder: str, index: dict[str, str], before: list[int]):
    def run(batches):
        for bucket, rows in _by_bucket(batches):
            name = index.get(str(bucket))
            if name is None:
                continue
            system, at = files_of(folder)
            with system.open_input_file(f"{at}/{name}") as f:
                perfect, entries = PerfectHash.from_bytes(f.read())
            keys = rows["key"].to_numpy()
            slot = perfect.slots(keys)
            entry = entries[np.maximum(slot, 0)]
            known = np.flatnonzero((slot >= 0) & (entry["print"] == key_prints(keys)))
            out = [(int(keys[i]), *s) for i in known.tolist() for s in spread(before, before[int(entry["shard"][i])] + int(entry["at"][i]), int(entry["copies"][i]))]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int64()),
                                              pa.array([o[3] for o in out], pa.int64())], names=["key", "shard", "first", "last"])
    return run


def _runs(first: list[int], last: list[int], a: int, b: int):
    """Row ranges [i, j) within [a, b) whose document ranges touch one another."""
    i = a
    for j in range(a + 1, b + 1):
        if j == b or first[j] != last[j - 1]:
            yield i, j
            i = j


class _Open:
    """A shard that is being read; offsets and ids come in bounded pieces."""

    def __init__(self, folder: str, manifest: dict, shard: int):
        system, at = files_of(folder)
        name = manifest["shards"][shard][0]
        self.dtype = manifest["dtype"]
        self.size = np.dtype(self.dtype).itemsize
        self.payload, self.places = system.open_input_file(f"{at}/{name}.ids"), system.open_input_file(f"{at}/{name}.offsets")

    def offsets(self, first: int, last: int) -> np.ndarray:
        return np.frombuffer(read_at(self.places, 8 * first, 8 * (last - first + 1)), "<u8").astype(np.int64)

    def ids(self, a: int, b: int) -> np.ndarray:
        return np.frombuffer(read_at(self.payload, a * self.size, (b - a) * self.size), self.dtype)

    def documents(self, first: int, last: int):
        """(document, offset, pieces of its ids) in order."""
        step = max(1, READ_BYTES // self.size)
        for low in range(first, last, 65_536):
            high = min(last, low + 65_536)
            at = self.offsets(low, high)
            i = 0
            while i < high - low:
                # As many whole documents as fit into one piece, or one that is longer, bit by bit.
                j = max(i + 1, int(np.searchsorted(at, at[i] + step, side="right")) - 1)
                if at[j] - at[i] > step:
                    yield low + i, int(at[i]), (self.ids(x, min(int(at[j]), x + step)) for x in range(int(at[i]), int(at[j]), step))
                else:
                    ids = self.ids(int(at[i]), int(at[j]))
                    for k in range(i, j):
                        yield low + k, int(at[k]), [ids[int(at[k] - at[i]): int(at[k + 1] - at[i])]]
                i = j

    def close(self) -> None:
        self.payload.close()
        self.places.close()


def _documents(folder: str, manifest: dict, shard: int, first: int, last: int):
    own = _Open(folder, manifest, shard)
    try:
        for doc, at, bits in own.documents(first, last):
            yield doc, at, np.concatenate([np.asarray(b) for b in bits])
    finally:
        own.close()


def _reader(folder: str, manifest: dict, ids_before: list[int], value, schema: pa.Schema, rows: int):
    """Rows (key, shard, first, last) sorted by place, to a row for each document."""
    def run(batches):
        number, own, out = None, None, []
        for batch in batches:
            keys, shards, first, last = (batch.column(i).to_pylist() for i in range(4))
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if shards[a] != number:
                    if own is not None:
                        own.close()
                    number, own = shards[a], _Open(folder, manifest, shards[a])
                for i, j in _runs(first, last, a, b):
                    k = i
                    for doc, at, bits in own.documents(first[i], last[j - 1]):
                        while doc >= last[k]:
                            k += 1
                        out.append((keys[k], ids_before[number] + at, *value(bits)))
                        if len(out) >= rows:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o, strict=True)) for o in out], schema=schema)
                            out = []
        if own is not None:
            own.close()
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o, strict=True)) for o in out], schema=schema)
    return run


def _crc_of(folder: str, manifest: dict, ids_before: list[int]):
    def value(bits) -> tuple[int, int]:
        n = crc = 0
        for ids in bits:
            n, crc = n + len(ids), zlib.crc32(ids.astype("<u4").tobytes(), crc)
        return n, crc
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return _reader(folder, manifest, ids_before, value, schema, 10_000)


def _ids_of(folder: str, manifest: dict, ids_before: list[int]):
    def value(bits) -> tuple[list[int]]:
        return ([x for ids in bits for x in ids.tolist()],)
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _reader(folder, manifest, ids_before, value, schema, 200)
