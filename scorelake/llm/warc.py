"""WARC derivatives: metadata and plain-text conversion records of response records.

Both derivatives name the response by WARC-Refers-To and keep its target, date and payload digest; the
metadata record carries the source's WARC and HTTP headers, title and links, and names the conversion.
Ids are made from the response's id, so that a run repeated gives the same records.

Rules for odd input: a missing page is an empty payload; a response without a proper header has no
derivatives of its own content: its headers are empty and its whole content is the payload; a missing
url is an empty target; equal rows give equal records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import given_id, solid_id
from scorelake.llm.html import all_blocks, links_of, title_of

# Pages carry no time of capture; records need one.
CAPTURED = "2024-01-01T00:00:00Z"
_SPACES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w\-]+)", re.I)
_OUT = ("_id long, record_type string, record_id string, refers_to string, target_uri string, source_digest string, "
        "block_digest string, content_length long, record binary")
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACES, name)}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record; its length and block digest are added to the headers."""
    full = [*headers, ("WARC-Block-Digest", sha1(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in full)
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def split_headers(data: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """First line, headers in order and what follows the empty line; without one all is content."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        return "", [], data
    lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = [(k.strip(), v.strip()) for k, colon, v in (x.partition(":") for x in lines[1:]) if colon]
    return lines[0], pairs, rest


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; a block is as long as its header says."""
    version, pairs, rest = split_headers(data)
    if not version.startswith("WARC/"):
        return {}, data
    headers = dict(pairs)
    length = headers.get("Content-Length", "")
    return headers, rest[: int(length)] if length.isdigit() else rest


def response(page_id: int, url: str, page: bytes, date: str = CAPTURED) -> bytes:
    """The response record of a page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(page)
    return record([("WARC-Type", "response"), ("WARC-Record-ID", urn(f"{page_id} {url}")), ("WARC-Date", date), ("WARC-Target-URI", url),
                   ("WARC-Payload-Digest", sha1(page)), ("Content-Type", "application/http; msgtype=response")], http + page)


def derive(source: bytes) -> list[tuple]:
    """The metadata and conversion records of a response record, as in _OUT from record_type on."""
    headers, block = parse(source)
    status, http, payload = split_headers(block) if block.startswith(b"HTTP/") else ("", [], block)
    digest = headers.get("WARC-Payload-Digest") or sha1(payload)
    target, origin = headers.get("WARC-Target-URI", ""), headers.get("WARC-Record-ID", "")
    charset = _CHARSET.search(next((v for k, v in http if k.lower() == "content-type"), ""))
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    text = "".join(b + "\n" for b in all_blocks(page)).encode()
    ids = {kind: urn(f"{kind} {origin} {digest}") for kind in ("metadata", "conversion")}
    envelope = {
        "warc-headers": headers, "http-status": status, "http-headers": [list(p) for p in http], "payload-digest": digest,
        "payload-length": len(payload), "title": title_of(page), "links": links_of(page), "conversion": ids["conversion"]}
    blocks = {"metadata": json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode(), "conversion": text}
    kinds = {"metadata": "application/json", "conversion": "text/plain; charset=utf-8"}
    out = []
    for kind, content in blocks.items():
        own = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", headers.get("WARC-Date", CAPTURED)), ("WARC-Target-URI", target),
               ("WARC-Refers-To", origin), ("WARC-Source-Payload-Digest", digest), ("Content-Type", kinds[kind])]
        out.append((kind, ids[kind], origin, target, digest, sha1(content), len(content), record(own, content)))
    return out


def _respond(batches):
    for pdf in batches:
        yield pd.DataFrame({"_id": pdf["_id"], "record": [
            response(i, u, h) for i, u, h in zip(pdf["_id"], pdf["url"], pdf["html"], strict=True)]})


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record): a response record for each row of `pages` (page_id, url, html)."""
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    rows = pages.select(solid_id("page_id").alias("_id"), url.alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    return rows.mapInPandas(_respond, "_id long, record binary").select(given_id("_id").alias("page_id"), "record")


def _derive(batches):
    for pdf in batches:
        yield pd.DataFrame([(i, *row) for i, r in zip(pdf["_id"], pdf["record"], strict=True) for row in derive(r)], columns=_COLUMNS)


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response record of `records` (page_id, record): its metadata and conversion.

    Columns: page_id, record_type, record_id, refers_to, target_uri, source_digest, block_digest,
    content_length and the record itself.
    """
    rows = records.select(solid_id("page_id").alias("_id"), F.coalesce("record", F.lit(b"")).alias("record"))
    return rows.mapInPandas(_derive, _OUT).withColumn("page_id", given_id("_id")).select("page_id", *_COLUMNS[1:])
