"""Main text of web pages by site style trees (after Yi, Liu and Li, 2003).

The pages of a host are merged into one tree whose nodes are chains of styles (element and class). A
node's presentation importance is the entropy of the child sequences it shows over the host's
pages, and its content importance is one less the mean entropy of the texts and link targets below
it: what many pages repeat has no importance. Branches of low composite importance are removed from
each page, along with elements that are by name not part of an article; what lies in the page's
article or main element is kept otherwise, since pages may share an article.

Rules for odd input: a null or empty page has an empty text; pages without url form one host; a host
with one page tells nothing, so all its nodes are important; equal pages count each; columns other than
page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import given_id, solid_id, stored
from scorelake.llm.html import Node, clean, events

DAMPING = 0.9
LEAST_IMPORTANCE = 0.2
# Hosts with less pages say too little about repetition.
LEAST_PAGES = 5
SENT_NODES = 500_000

# Elements and names of parts that are not the article.
NOISE_TAGS = frozenset("nav footer aside form button select dialog menu head".split())
NOISE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu menubar modal nav "
    "navbar navigation newsletter notice notification outbrain popup promo promoted promotion related remark replies reply respond share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription taboola toolbar".split())
HEADER_NAMES = frozenset("header masthead topbar".split())
MAIN_TAGS = frozenset(("article", "main"))


def is_noise(path: list[Node]) -> bool:
    """Whether an open element is by its name a menu, notice, advert or the like.

    A header is part of the article if it lies inside it.
    """
    inside = False
    for n in path:
        if n.tag in NOISE_TAGS or not NOISE_NAMES.isdisjoint(n.names) and n.tag not in ("html", "body"):
            return True
        if not inside and (n.tag == "header" or not HEADER_NAMES.isdisjoint(n.names)):
            return True
        inside = inside or n.tag in MAIN_TAGS
    return False


def node_key(path: list[Node]) -> int:
    chain = "/".join(n.style for n in path).encode()
    return int.from_bytes(hashlib.blake2b(chain, digest_size=8).digest(), "little", signed=True)


def text_key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def style_features(page: str) -> tuple[dict[int, str], set[tuple[int, int]]]:
    """Child sequences of the nodes of a page, and the (node, text) pairs below them.

    A node that occurs several times shows its sequences joined.
    """
    children: dict[int, list[str]] = {}
    features: set[tuple[int, int]] = set()
    keys: list[int] = []
    parts: list[str] = []
    depth = 0
    for e in events(page):
        if e.kind == "text":
            parts.append(e.text)
            continue
        if parts:
            text = clean(parts)
            parts = []
            if text:
                features |= {(k, text_key(text)) for k in keys[:depth]}
        if e.kind == "open":
            del keys[len(e.path) - 1:]
            while len(keys) < len(e.path):
                keys.append(node_key(e.path[: len(keys) + 1]))
            if len(keys) > 1:
                children.setdefault(keys[-2], []).append(e.path[-1].style)
        depth = len(e.path)
    # Runs of like children, such as paragraphs, are one style whatever their number.
    shown = {k: " ".join(s for i, s in enumerate(c) if not i or c[i - 1] != s) for k, c in children.items()}
    return shown, features


def _collect(batches):
    for pdf in batches:
        counts: Counter = Counter()
        for host, page in zip(pdf["host"], pdf["html"], strict=True):
            shown, features = style_features(page)
            counts.update((host, k, True, text_key(s)) for k, s in shown.items())
            counts.update((host, k, False, f) for k, f in features)
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["host", "node", "style", "value", "n"])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def importance(pages: DataFrame) -> DataFrame:
    """(host, node, pages, presentation, content, importance) of every node of the hosts' style trees."""
    rows = pages.select(host_of(F.col("url")).alias("host"), "html").where(F.col("html").isNotNull())
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counted = rows.mapInPandas(_collect, "host string, node long, style boolean, value long, n long").groupBy(
        "host", "node", "style", "value").agg(F.sum("n").alias("n"))
    log_n = F.log(F.col("n"))
    nodes = counted.groupBy("host", "node").agg(
        F.sum(F.when(F.col("style"), F.col("n"))).alias("shown"), F.sum(F.when(F.col("style"), F.col("n") * log_n)).alias("n_log_n"),
        F.count_if("style").alias("styles"), F.avg(F.when(~F.col("style"), log_n)).alias("repeated"))
    log_m = F.log(F.col("pages"))
    # Entropy of the shares n / shown, and mean entropy of texts that are in n pages each, to the base of all pages.
    presentation = F.when(F.col("styles") > 0, F.least((F.log("shown") - F.col("n_log_n") / F.col("shown")) / log_m, F.lit(1.0)))
    content = 1 - F.least(F.col("repeated") / log_m, F.lit(1.0))
    kept = F.pow(F.lit(DAMPING), F.col("styles"))
    joined = nodes.join(sizes, "host").withColumns({
        "presentation": F.when(F.col("pages") > 1, presentation), "content": F.when(F.col("pages") > 1, content)})
    combined = (1 - kept) * F.coalesce("presentation", F.lit(0.0)) + kept * F.coalesce("content", F.lit(1.0))
    return joined.select("host", "node", "pages", "presentation", "content", F.when(F.col("pages") > 1, combined).otherwise(F.lit(1.0)).alias("importance"))


def main_text(page: str | None, low: frozenset[int]) -> str:
    """The page's blocks outside noise and low branches, joined by line ends."""
    out: list[str] = []
    parts: list[str] = []
    drop, state = False, {}
    for e in events(page or ""):
        if e.kind == "text":
            if not drop:
                parts.append(e.text)
            continue
        if e.kind == "break" and parts:
            out.append(clean(parts))
            parts = []
        # Whether the open elements are dropped depends on their chain only.
        chain = tuple(e.path)
        if chain not in state:
            article = any(n.tag in MAIN_TAGS for n in chain)
            state[chain] = is_noise(e.path) or not article and bool(low) and any(node_key(e.path[:i]) in low for i in range(1, len(chain) + 1))
        if state[chain] and not drop and parts:
            out.append(clean(parts))
            parts = []
        drop = state[chain]
    out.append(clean(parts))
    return "\n".join(b for b in out if b)


def _extract(batches):
    for pdf in batches:
        texts = [main_text(page, frozenset(low.tolist()) if low is not None else frozenset()) for page, low in zip(pdf["html"], pdf["low"], strict=True)]
        yield pd.DataFrame({"_id": pdf["_id"], "url": pdf["url"], "text": texts})


def extract(pages: DataFrame, least_importance: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row (page_id, url, text, n_chars) for each row of `pages` (page_id, url, html)."""
    weak = importance(pages).where((F.col("importance") < least_importance) & (F.col("pages") >= least_pages))
    low = stored(weak.groupBy("host").agg(F.collect_list("node").alias("low")), "styles")
    small = (low.agg(F.coalesce(F.sum(F.size("low")), F.lit(0))).first()[0]) <= SENT_NODES
    rows = pages.select(solid_id("page_id").alias("_id"), "url", "html", host_of(F.col("url")).alias("host"))
    texts = rows.join(F.broadcast(low) if small else low, "host", "left").select("_id", "url", "html", "low").mapInPandas(
        _extract, "_id long, url string, text string")
    return texts.select(given_id("_id").alias("page_id"), "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
