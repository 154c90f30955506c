"""SQL (DuckDB) that the training-data queries must agree with, where SQL can say it."""

from __future__ import annotations

from scorelake.llm import quality

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"'[^\x20\x09-\x0D]+'"


def words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), {WORD})"


def runs(source: str, keep: str) -> str:
    """Rows (keep, p, s): the 5-word runs of the word lists w of a relation, shorter lists being one run."""
    return (f"SELECT {keep}, p, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM "
            f"(SELECT {keep}, w, unnest(range(0, greatest(len(w) - 4, 1))) AS p FROM {source} WHERE len(w) > 0) x")


NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, {words('text')} AS w FROM documents), s AS (SELECT DISTINCT doc_id, s FROM ({runs('d', 'doc_id')}) y),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 75 * (nx.n + ny.n - shared)),
    u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
    r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, u.y FROM r JOIN u ON r.root = u.x)
    SELECT doc_id, coalesce(max(n.n), 0) AS n_shingles, min(root) AS component_id, min(root) = doc_id AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""

LEAKS = f"""WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents), i AS (SELECT item_id, {words('text')} AS w FROM benchmark),
    dr AS ({runs('d', 'doc_id')}), ir AS ({runs('i', 'item_id')}),
    st AS (SELECT DISTINCT doc_id, item_id, greatest(dr.p - ir.p, 0) AS start FROM dr JOIN ir USING (s)),
    win AS (SELECT st.doc_id, st.item_id, st.start, d.w[st.start + 1 : st.start + len(i.w)] AS w FROM st JOIN d USING (doc_id) JOIN i USING (item_id)),
    wc AS (SELECT doc_id, item_id, start, s, count(*) AS n FROM ({runs('win', 'doc_id, item_id, start')}) y GROUP BY ALL),
    ic AS (SELECT item_id, s, count(*) AS n FROM ir GROUP BY ALL),
    common AS (SELECT doc_id, item_id, start, sum(least(wc.n, ic.n)) AS shared FROM wc JOIN ic USING (item_id, s) GROUP BY ALL),
    sized AS (SELECT b.doc_id, b.item_id, b.start, shared / (greatest(len(win.w) - 4, 1) + greatest(len(i.w) - 4, 1) - shared)::DOUBLE AS similarity
              FROM common b JOIN win USING (doc_id, item_id, start) JOIN i USING (item_id)),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS rn FROM sized WHERE similarity * 100 >= 75)
    SELECT doc_id, item_id, start, similarity FROM best WHERE rn = 1"""


def _grid(rule: str) -> str:
    return "[" + ", ".join(f"{x}::DOUBLE" for x in quality.GRID[rule]) + "]"


_PASSED = ", ".join(f"len(list_filter({_grid(r)}, lambda x: {r} > x))" for r in quality.RULES)
_CUTS = " UNION ALL ".join(f"SELECT {i + 1} AS rule, unnest(range(1, {len(quality.GRID[r]) + 1})) AS cut, unnest({_grid(r)}) AS cutoff" for i, r in enumerate(quality.RULES))
_RISK = f"({quality.RISK}::DOUBLE / {len(quality.RULES)})"
_OVER = " OR ".join(f"coalesce({r} > c{i + 1}, false)" for i, r in enumerate(quality.RULES))
_PIVOT = ", ".join(f"max(cutoff) FILTER (rule = {i + 1}) AS c{i + 1}" for i in range(len(quality.RULES)))

QUALITY = rf"""WITH d AS (SELECT doc_id, lang, text, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
    lines AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d) x
              WHERE regexp_matches(line, {WORD}) GROUP BY row),
    win AS (SELECT row, p, count(*) OVER (PARTITION BY row, s) AS c FROM (SELECT row, p, array_to_string(w[p + 1 : p + {quality.WINDOW}], ' ') AS s FROM
            (SELECT row, w, unnest(range(0, len(w) - {quality.WINDOW - 1})) AS p FROM d) x) y),
    rep AS (SELECT row, count(DISTINCT p + k) AS n_repeat_words FROM win, range(0, {quality.WINDOW}) t(k) WHERE c > 1 GROUP BY row),
    f AS (SELECT doc_id, coalesce(lang, '') AS stratum, text, len(w) AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
          length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
          coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(coalesce(text, ''), '[^\p{{Lu}}]', '', 'g')) AS n_upper
          FROM d LEFT JOIN lines USING (row) LEFT JOIN rep USING (row)),
    m AS (SELECT doc_id, stratum, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
          coalesce(n_symbols / nullif(word_chars, 0)::DOUBLE, 0) AS symbol_share, coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) AS dup_line_share,
          coalesce(n_repeat_words / nullif(n_words, 0)::DOUBLE, 0) AS repeat_share, coalesce(n_upper / nullif(word_chars, 0)::DOUBLE, 0) AS upper_share,
          coalesce(word_chars / nullif(n_words, 0)::DOUBLE, 0) AS word_length,
          n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
    lab AS (SELECT DISTINCT stratum, text, quality = 1 AS good, [{_PASSED}] AS passed FROM m JOIN labels USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL),
    cell AS (SELECT stratum, good, unnest(passed) AS passed, generate_subscripts(passed, 1) AS rule FROM lab),
    cuts AS ({_CUTS}), strata AS (SELECT stratum, count(*) FILTER (good) AS n FROM lab GROUP BY stratum),
    rate AS (SELECT stratum, rule, cut, cutoff, n, count(*) FILTER (good AND passed >= cut) AS lost, count(*) FILTER (NOT good AND passed >= cut) AS gone
             FROM cell JOIN cuts USING (rule) JOIN strata USING (stratum) GROUP BY ALL),
    ok AS (SELECT * FROM rate WHERE gone > {quality.LOSS} * lost AND lost < {_RISK} * n AND
           list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RISK}) + (n - i) * ln(1 - {_RISK}))))
           <= {quality.DELTA}::DOUBLE / ((SELECT count(*) FROM strata) * {len(quality.RULES) * max(map(len, quality.GRID.values()))})),
    best AS (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY gone - {quality.LOSS} * lost DESC, cutoff DESC) AS rn FROM ok) x WHERE rn = 1),
    t AS (SELECT stratum, {_PIVOT} FROM best GROUP BY stratum)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {', '.join(quality.RULES)}, base_failed, NOT (base_failed OR {_OVER}) AS kept
    FROM m LEFT JOIN t USING (stratum)"""


def vector_codes(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Codes of vectors of parts x width components, one chain of relations for each round."""
    square = "list_sum(list_transform(list_zip(pt.v, {c}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM
            (SELECT pt.rid, part, c{r}.entry, {square.format(c=f'c{r}')} AS d FROM pt JOIN c{r} USING (part)) x GROUP BY rid, part)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT part, entry, i, sum(x) AS s, count(*) AS n FROM (SELECT part, entry, unnest(range({width})) AS i, unnest(v) AS x FROM a{r} JOIN pt USING (rid, part)) y GROUP BY ALL),
            c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(new.v, c{r}.v) AS v FROM c{r} LEFT JOIN
                (SELECT part, entry, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS v FROM m{r} GROUP BY part, entry) new USING (part, entry))""")
    return f"""WITH kept AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pt AS MATERIALIZED (SELECT rid, part, list_transform(embedding[part * {width} + 1 : (part + 1) * {width}], lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v
            FROM kept, range({parts}) t(part)),
        c0 AS (SELECT part, rid - 1 AS entry, v FROM pt WHERE rid <= {entries}), {", ".join(steps)},
        coded AS (SELECT rid, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
        books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS digest FROM c{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT digest FROM books) AS codebooks_sha256 FROM coded JOIN kept USING (rid)"""


DIVERGENCE = rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
    often AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
    langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM often GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN often USING (lang, term) GROUP BY lang, source, term),
    gt AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
    cells AS (SELECT gt.lang, gt.source, o.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (gt.total + 5 * l.v) AS p,
                     1 + (1000000000::HUGEINT * (o.n + 5)) // (l.total + 5 * l.v) AS q
              FROM gt JOIN often o ON o.lang = gt.lang JOIN langs l ON l.lang = gt.lang LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = o.term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN cells x ON x.lang = a.lang AND x.source = a.source LEFT JOIN cells y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
    f AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM cells WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM
        (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) x WHERE part = 'pair' OR rank <= 50"""
