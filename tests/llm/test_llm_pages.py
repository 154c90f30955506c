"""Pages, records, licences and the pipeline."""

import base64
import hashlib
import html
import json
import math
import re

import pytest

import corpus_pipeline
from scorelake.llm import licenses, sitetree, warc
from scorelake.llm.common import table
from scorelake.llm.html import all_blocks, links_of, title_of

PAGES = "page_id long, url string, html string"


# --- main text -------------------------------------------------------------------------------------


def article_by_force(page):
    """The article element's paragraphs of the test tables' pages."""
    inner = re.search(r"<article>(.*)</article>", page or "", re.S)
    if not inner:
        return ""
    blocks = re.split(r"</?(?:p|h1)>", inner[1])
    texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in blocks]
    return "\n".join(t for t in texts if t)


def test_articles_of_a_table(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    rows = sitetree.extract(pages).collect()
    assert len(rows) == len(source)
    assert all(r.text == article_by_force(source[r.page_id]) and r.n_chars == len(r.text) for r in rows)


def test_noise_by_name_and_by_repetition(spark):
    def page(i):
        return (i, f"http://site.example/{i}", f"""<html><head><title>T{i}</title><style>p {{}}</style></head><body class="home">
            <header><h1>Site</h1></header><div class="top-menu"><a href="/x">Home</a></div>
            <div class="strip"><p>Always the same line.</p></div>
            <div class="story"><h2>Head {i} &amp; more</h2><p>Body  of <i>text</i> {i}<br>next<script>x("<p>no</p>")</script></p><!-- no --><ul><li>one {i}<li>two {i}</ul></div>
            <form>Mail <input></form><aside>Other</aside><div id="comments"><p>First!</p></div><footer>Foot {i}</footer>""")
    rows = sitetree.extract(spark.createDataFrame([page(i) for i in range(12)], PAGES)).collect()
    for r in rows:
        assert r.text.split("\n") == [f"Head {r.page_id} & more", f"Body of text {r.page_id} next", f"one {r.page_id}", f"two {r.page_id}"]
    # One page alone says nothing about repetition.
    alone = sitetree.extract(spark.createDataFrame([page(1)], PAGES)).first()
    assert "Always the same line." in alone.text and "Foot" not in alone.text


def test_importance_is_entropy(spark):
    same = "<body><div class=a><p>same</p></div><div class=b><p>own {}</p></div></body>"
    pages = spark.createDataFrame([(i, "http://h.example/", same.format(i)) for i in range(8)], PAGES)
    rows = sitetree.importance(pages).collect()
    by_content = sorted(round(r.content, 6) for r in rows if r.content is not None)
    assert by_content[0] == 0.0 and by_content[-1] == 1.0
    # The body has both texts: the mean entropy of "same" in all pages and of eight texts of one page each.
    body = [r for r in rows if r.presentation is not None and 0 < r.content < 1]
    assert len(body) == 1 and body[0].content == pytest.approx(1 - (math.log(8) / math.log(8)) / 9)


def test_pages_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://x.example", "<p>a</p>"), (4, "x", "no markup &lt; at all"), (4, "x", "no markup &lt; at all"),
            (5, "y", "<p>open <b>bold <p>next<div>in"), (6, "z", "<article><header><h1>Kept</h1></header><p>x</article>"), (7, "q", "a" * 300_000)]
    got = sitetree.extract(spark.createDataFrame(rows, PAGES)).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 8 and texts[1] == texts[2] == "" and texts[None] == "a" and texts[4] == "no markup < at all"
    assert texts[5] == "open bold\nnext\nin" and texts[6] == "Kept\nx" and len(texts[7]) == 300_000
    assert sitetree.extract(spark.createDataFrame([], PAGES)).collect() == []


# --- records ---------------------------------------------------------------------------------------


def test_derivatives_refer_to_their_response(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    source = {r.page_id: r for r in pages.collect()}
    responses = warc.responses(pages)
    origin = {r.page_id: bytes(r.record) for r in responses.collect()}
    rows = warc.derivatives(responses).collect()
    assert len(rows) == 2 * len(source) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        page = source[r.page_id].html.encode()
        headers, block = warc.parse(bytes(r.record))
        first, _ = warc.parse(origin[r.page_id])
        digest = "sha1:" + base64.b32encode(hashlib.sha1(page).digest()).decode()
        assert r.refers_to == headers["WARC-Refers-To"] == first["WARC-Record-ID"]
        assert r.source_digest == headers["WARC-Source-Payload-Digest"] == first["WARC-Payload-Digest"] == digest
        assert r.block_digest == headers["WARC-Block-Digest"] == warc.sha1(block) and len(block) == r.content_length == int(headers["Content-Length"])
        assert r.target_uri == headers["WARC-Target-URI"] == source[r.page_id].url
        if r.record_type == "metadata":
            envelope = json.loads(block)
            assert envelope["warc-headers"] == first and envelope["title"] == title_of(source[r.page_id].html)
            assert envelope["conversion"] in {x.record_id for x in rows if x.record_type == "conversion" and x.page_id == r.page_id}
            assert ["Content-Type", "text/html; charset=utf-8"] in envelope["http-headers"] and envelope["payload-length"] == len(page)
        else:
            assert block.decode() == "".join(b + "\n" for b in all_blocks(source[r.page_id].html))


def test_record_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "u\r\nX: y", "<a href='/p?a=1&amp;b=2'>x</a>")]
    records = warc.responses(spark.createDataFrame(rows, PAGES))
    got = warc.derivatives(records).collect()
    assert len(got) == 6 and {r.target_uri for r in got} == {"", "uX: y"}
    odd = spark.createDataFrame([(1, bytearray(b"no record")), (2, None), (3, bytearray(b"WARC/1.1\r\nContent-Length: zz\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nope\r\n\r\n<p>hi"))],
                                "page_id long, record binary")
    bodies = {r.page_id: warc.parse(bytes(r.record))[1] for r in warc.derivatives(odd).collect() if r.record_type == "conversion"}
    assert bodies == {1: b"no record\n", 2: b"", 3: b"hi\n"}
    assert warc.derivatives(records.limit(0)).collect() == []
    assert links_of("<a href='/p?a=1&amp;b=2'>x</a><A HREF=q>y</A><a name=z>") == ["/p?a=1&b=2", "q"]


# --- licences --------------------------------------------------------------------------------------

FILES = "file_id long, path string, text string"


def test_own_and_inherited_licences(spark):
    mit, apache = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["Apache-2.0"][0]
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c/x.py", "code"), (3, "a/b/COPYING.txt", "words\n\n" + apache + "\nmore words"), (4, "a/b/c/y.py", "# " + apache + "\ncode"),
            (5, "a/z.py", None), (6, "z.py", ""), (7, "other/z.py", "the licence of the work is open"), (None, "a/q.py", "x"), (9, None, "x"), (9, None, mit),
            (10, "a/b/NOTICE", "nothing here"), (11, "a/LICENSE-2", mit)]
    got = {(r.file_id, r.path): (r.license, r.found, r.licence_path) for r in licenses.scan(spark.createDataFrame(rows[:-3] + rows[-2:], FILES)).collect()}
    assert got == {
        (1, "a/LICENSE"): ("MIT", "own", None), (2, "a/b/c/x.py"): ("Apache-2.0", "inherited", "a/b/COPYING.txt"), (3, "a/b/COPYING.txt"): ("Apache-2.0", "own", None),
        (4, "a/b/c/y.py"): ("Apache-2.0", "own", None), (5, "a/z.py"): ("MIT", "inherited", "a/LICENSE"), (6, "z.py"): (None, "none", None),
        (7, "other/z.py"): (None, "none", None), (None, "a/q.py"): ("MIT", "inherited", "a/LICENSE"), (9, None): (None, "none", None),
        (10, "a/b/NOTICE"): ("Apache-2.0", "inherited", "a/b/COPYING.txt"), (11, "a/LICENSE-2"): ("MIT", "own", None)}
    assert licenses.scan(spark.createDataFrame([], FILES)).collect() == []
    root = licenses.scan(spark.createDataFrame([(1, "LICENSE", mit), (2, "a/b.py", "x"), (3, "c.py", "y")], FILES)).collect()
    assert {(r.file_id, r.found) for r in root} == {(1, "own"), (2, "inherited"), (3, "inherited")}


def test_texts_are_matched_once(spark):
    """The templates' matches are stored; the joins on them read no text again."""
    found = licenses.scan(spark.createDataFrame([(1, "LICENSE", licenses.TEMPLATES["MIT"][0]), (2, "a/b.py", "x")], FILES))
    assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_cosine_matches_brute_force():
    idf = {"licensed": 3.0, "mit": 4.0, "the": 1.0}
    matcher = licenses.Matcher({"A": ["Licensed the MIT"], "B": ["the the licensed"]}, idf, 5.0)

    def vector(text):
        words = text.lower().split()
        return {w: words.count(w) * idf.get(w, 5.0) for w in words}

    def cosine(a, b):
        return sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    text = "the foo licensed"
    scores = {n: cosine(vector(text), vector(t)) for n, t in (("A", "licensed the mit"), ("B", "the the licensed"))}
    name, score = matcher.best("unrelated\n" + text)
    assert name == max(scores, key=scores.get) and score == pytest.approx(max(scores.values()), abs=1e-8)


# --- pipeline --------------------------------------------------------------------------------------


def test_each_stage_keeps_columns_and_acts(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stored(stage(spark, docs, sf_dir), "stage")
        assert kept.columns == docs.columns, name
        before, after = docs.count(), kept.count()
        assert after == before if name == "repeated passages" else after < before, name
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count()
