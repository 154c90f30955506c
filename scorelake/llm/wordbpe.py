"""BPE encoding over a table of distinct words, and decoding over a table of pieces.

Texts are split into words within blocks of bounded size; a block becomes the list of its distinct
words and, for each text, the numbers of its words in order. The word lists are dealt out by a hash of
the word, so that all places of a word meet in one bucket and the word is encoded once, however
many blocks hold it: a block sends one row to each bucket, so a frequent word costs no more than a
rare one. The ids come back to the block by its number, and each text is joined with them by position.

Rules for odd input: null is an empty text; a text without words has no ids; rows without doc_id or
with a repeated one are encoded like others; columns other than doc_id and text are ignored. The strings
of the special tokens stand for these tokens, as in the tokenizer itself.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
import zlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import given_id, solid_id

BLOCK_CHARS = 12_000_000
_ROWS = "block long, bucket int, _id long, data binary, words string"
_COLUMNS = ["block", "bucket", "_id", "data", "words"]


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte planes apart so that small ones cost little."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


class WordSplitter:
    """Texts to the words that the tokenizer's normaliser and pre-tokenizer make of them."""

    def __init__(self, spec: dict):
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"]:
            raise ValueError("a tokenizer with NFC, white space and lower-case normalisers and a word pattern is needed")
        # The pattern's \s is the Unicode property, which Python's differs from.
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        specials = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.specials = regex.compile("(" + "|".join(specials) + ")") if specials else None

    def _plain(self, text: str) -> list[str]:
        # Letter by letter, so a capital sigma at a word's end becomes the common small one.
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def __call__(self, text: str) -> list[str]:
        if self.specials is None or "<" not in text:
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self.specials.split(text)):
            out += [part] if i % 2 else self._plain(part)
        return out


class WordEncoder:
    """Words to ids, without normalising or splitting them again."""

    def __init__(self, spec: dict):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.special = {t["content"]: [t["id"]] for t in spec["added_tokens"]}
        bare = spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][-1],
                       "truncation": None, "padding": None}
        self.tokenizer = Tokenizer.from_str(json.dumps(bare))

    def __call__(self, words: list[str]) -> list[list[int]]:
        found = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return [self.special.get(w, ids) for w, ids in zip(words, found, strict=True)] if self.special else found


def _split_blocks(spec: dict, buckets: int, block_chars: int):
    def run(batches):
        from pyspark import TaskContext

        split = WordSplitter(spec)
        block, size, known = TaskContext.get().partitionId() << 32, 0, {}

        def lists() -> pd.DataFrame:
            held: dict[int, tuple[list, list]] = {}
            for word, number in known.items():
                own = held.setdefault(zlib.crc32(word.encode()) % buckets, ([], []))
                own[0].append(word)
                own[1].append(number)
            return pd.DataFrame([(block, b, 0, _pack(np.diff(np.array(n, np.int64), prepend=0)), " ".join(w)) for b, (w, n) in held.items()],
                                columns=_COLUMNS)

        for pdf in batches:
            rows = []
            for id_, text in zip(pdf["_id"], pdf["text"], strict=True):
                if size > block_chars:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    yield lists()
                    block, size, known, rows = block + 1, 0, {}, []
                words = split(text)
                codes = np.array([known.setdefault(w, len(known)) for w in words], np.uint32)
                rows.append((block, -1, id_, _pack(codes), None))
                size += len(text)
            yield pd.DataFrame(rows, columns=_COLUMNS)
        yield lists()
    return run


def _only_lists(batches):
    for pdf in batches:
        yield pdf[pdf["bucket"] >= 0]


def _encode_buckets(spec: dict):
    """Word lists, sorted by bucket, to lists of ids; each distinct word of a bucket is encoded once."""
    def run(batches):
        encode = WordEncoder(spec)
        bucket, known = None, {}
        for pdf in batches:
            rows = []
            for block, b, data, joined in zip(pdf["block"], pdf["bucket"], pdf["data"], pdf["words"], strict=True):
                if b != bucket:
                    bucket, known = b, {}
                words = joined.split(" ")
                new = list(dict.fromkeys(w for w in words if w not in known))
                for w, ids in zip(new, encode(new), strict=True):
                    known[w] = ids
                found = [known[w] for w in words]
                numbers = np.cumsum(_unpack(data).astype(np.int64))
                parts = [_pack(numbers), _pack(np.array([len(f) for f in found])), _pack(np.array([i for f in found for i in f]))]
                sizes = np.array([len(p) for p in parts[:2]], "<u4").tobytes()
                rows.append((block, b, 0, sizes + b"".join(parts), None))
            yield pd.DataFrame(rows, columns=_COLUMNS)
    return run


def _by_position(pieces: list[str], digests: bool):
    """Texts of a block and the ids of its words to the ids, or their digests, of the texts."""
    piece_bytes = [p.encode() for p in pieces]

    def words_of(lists: pd.DataFrame) -> tuple[list[bytes], list[bytes]]:
        ids: dict[int, bytes] = {}
        for data in lists["data"]:
            a, b = np.frombuffer(data[:8], "<u4").tolist()
            numbers, lengths, flat = _unpack(data[8:8 + a]), _unpack(data[8 + a:8 + a + b]), _unpack(data[8 + a + b:])
            ends = np.cumsum(lengths.astype(np.int64)) * 4
            raw = flat.astype("<u4").tobytes()
            for number, start, end in zip(numbers.tolist(), (ends - 4 * lengths.astype(np.int64)).tolist(), ends.tolist(), strict=True):
                ids[number] = raw[start:end]
        in_order = [ids[i] for i in range(len(ids))]
        return in_order, [b" ".join([piece_bytes[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in in_order] if digests else []

    def run(rows: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        ids, texts = words_of(lists)
        out = []
        for id_, data, bucket in zip(rows["_id"], rows["data"], rows["bucket"], strict=True):
            if bucket >= 0:
                continue
            codes = _unpack(data).tolist()
            flat = b"".join([ids[c] for c in codes])
            if digests:
                decoded = b" ".join([texts[c] for c in codes])
                out.append((id_, len(flat) // 4, hashlib.sha256(flat).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            else:
                out.append((id_, np.frombuffer(flat, "<u4").astype(np.int32)))
        return pd.DataFrame(out, columns=["_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["_id", "ids"])
    return run


def _spec(path: str) -> dict:
    """The tokenizer's file, read by the driver; it has a fixed size and goes to the tasks with their code."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _pieces(spec: dict) -> list[str]:
    table = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [table.get(i, "") for i in range(max(table) + 1)]


def _encoded(docs: DataFrame, path: str, block_chars: int, digests: bool) -> DataFrame:
    spec = _spec(path)
    spark = docs.sparkSession
    buckets = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(solid_id("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Both uses below share this one exchange, so each text is split once.
    blocks = texts.mapInPandas(_split_blocks(spec, buckets, block_chars), _ROWS).repartition("block")
    lists = blocks.mapInPandas(_only_lists, _ROWS).repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_encode_buckets(spec), _ROWS)
    schema = "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "_id long, ids array<int>"
    return blocks.groupBy("block").cogroup(lists.groupBy("block")).applyInPandas(_by_position(_pieces(spec), digests), schema).withColumn(
        "doc_id", given_id("_id"))


def encode(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids) of each row of `docs`, as the tokenizer at `path` encodes its text."""
    return _encoded(docs, path, block_chars, digests=False).select("doc_id", "ids")


def digests(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of `docs`."""
    return _encoded(docs, path, block_chars, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def _join_pieces(pieces: list[str]):
    def run(batches):
        for pdf in batches:
            pdf["text"] = [" ".join([pieces[i] for i in ids]) for ids in pdf.pop("ids")]
            yield pdf
    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); the pieces stand apart by a space, as the tokenizer has no decoder."""
    rows = encoded.select(solid_id("doc_id").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInPandas(_join_pieces(_pieces(_spec(path))), "doc_id long, text string").select(
        given_id("doc_id").alias("doc_id"), "text")
