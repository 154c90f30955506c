"""Oracle SQL fragments for the text functions (DuckDB dialect)."""

from __future__ import annotations

from collections.abc import Sequence

from scorelake.functions import text as tx

W = r"[\p{L}\p{N}_]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def compact(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]', '', 'g')"


def contains_any(c: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(w)})" for w in words) + ")"


def answer_line(c: str) -> str:
    p = lit(tx.ANSWER_PATTERN)
    return f"CASE WHEN regexp_matches({c}, {p}) THEN {strip(f'regexp_extract({c}, {p}, 1)')} END"


def numbers(c: str) -> str:
    return f"regexp_extract_all(translate({c}, '−０１２３４５６７８９', '-0123456789'), {lit(tx.NUMBER_PATTERN)})"


def to_number(c: str) -> str:
    return f"TRY_CAST(replace({c}, ',', '') AS DOUBLE)"


def places(c: str) -> str:
    return rf"length(regexp_extract({c}, '\.(\d+)$', 1))"


def close(a: str, b: str, tol: str) -> str:
    return (f"(CASE WHEN {a} = 0 AND {b} = 0 THEN true WHEN {a} = 0 OR {b} = 0 THEN abs({a} - {b}) < 1e-6"
            f" ELSE abs({a} - {b}) <= {tol} * greatest(abs({a}), abs({b})) END)")


def close_numbers(a: str, b: str, tol: str) -> str:
    x, y = to_number(a), to_number(b)
    scale = f"pow(10.0::DOUBLE, least({places(a)}, {places(b)}))"
    rx, ry = f"(round_even({x} * {scale}, 0) / {scale})", f"(round_even({y} * {scale}, 0) / {scale})"
    return f"({close(x, y, tol)} OR {close(rx, ry, tol)})"


def data_status(c: str) -> str:
    return (f"CASE WHEN {contains_any(f'lower({c})', tx.REFUSAL_PHRASES + tx.TOOL_ERROR_PHRASES)}"
            " THEN 'data_not_found' ELSE 'data_found' END")


def normalize(c: str) -> str:
    steps = [
        (r"\*{1,3}|_{1,3}", ""), (r"(?m)^#{1,6}\s*", ""), (r"`([^`]*)`", r"\1"),
        (r"\[([^\]]*)\]\([^\)]*\)", r"\1"), (r"([a-z])([A-Z])", r"\1 \2"),
        (r"([A-Z]+)([A-Z][a-z])", r"\1 \2"), (r"[-;/]", " "), (r"[^\p{L}\p{N}_\s]", ""), (r"\s+", " "),
    ]
    for pattern, replacement in steps:
        c = f"regexp_replace({c}, {lit(pattern)}, {lit(replacement)}, 'g')"
    return f"trim(lower({c}))"


def terms(norm: str) -> str:
    words = f"list_filter(string_split({norm}, ' '), lambda w: length(w) >= 2)"
    return (f"CASE WHEN len({words}) > 1 THEN {words}"
            f" WHEN length({norm}) >= 2 THEN list_transform(range(1, length({norm})), lambda i: substring({norm}, i, 2))"
            f" WHEN length({norm}) = 1 THEN [{norm}] ELSE []::VARCHAR[] END")


def ratio(norm_gen: str, term_list: str) -> str:
    return (f"CASE WHEN len({term_list}) > 0 THEN len(list_filter({term_list}, lambda w: contains({norm_gen}, w)))"
            f" / len({term_list})::DOUBLE ELSE 0.0::DOUBLE END")


def word_hits(c: str, words: Sequence[str]) -> str:
    parts = []
    for w in words:
        if len(w) <= 5 and w.isascii():
            parts.append(rf"CAST(regexp_matches({c}, '(^|[^\p{{L}}\p{{N}}_]){w}([^\p{{L}}\p{{N}}_]|$)') AS INT)")
        else:
            parts.append(f"CAST(contains({c}, {lit(w)}) AS INT)")
    return "(" + " + ".join(parts) + ")"


def stripped_list(items: str) -> str:
    return f"list_filter(list_transform({items}, lambda x: {strip('x')}), lambda x: x <> '')"


def response_items(c: str) -> str:
    bullets = f"regexp_extract_all({c}, {lit('(?m)' + tx.BULLET_PATTERN)}, 1)"
    rows = f"regexp_extract_all({c}, {lit('(?m)' + tx.TABLE_ROW_PATTERN)}, 1)"
    cells = lambda r: stripped_list(f"string_split({r}, '|')")
    rule = lambda r: (f"len(list_filter({cells(r)}, lambda q: NOT regexp_matches(q, '{tx.SEPARATOR_CELL_PATTERN}'))) = 0")
    first = f"coalesce(list_position(list_transform({rows}, lambda rr: {rule('rr')}), true), 0)"
    body = f"list_filter({rows}, lambda r, i: {first} > 0 AND i > {first} AND NOT {rule('r')})"
    table = (f"list_filter(list_transform({body}, lambda r2: array_to_string(list_filter({cells('r2')},"
             rf" lambda z: NOT regexp_matches(z, '^\d+$')), ' ')), lambda y: y <> '')")
    bare = "regexp_replace(lower(ln), '^[*#: ]+|[*#: ]+$', '', 'g')"
    words = ", ".join(lit(w) for w in tx.HEADER_WORDS)
    namelike = (f"NOT regexp_matches(ln, {lit('(?i)' + tx.VALUE_LINE_PATTERN)})"
                f" AND NOT regexp_matches(ln, {lit(tx.HEADER_LINE_PATTERN)}) AND {bare} NOT IN ({words})"
                f" AND NOT (length(ln) > 40 AND {contains_any('lower(ln)', tx.SENTENCE_MARKS)})"
                " AND length(ln) BETWEEN 2 AND 80")
    lines = f"list_filter({stripped_list(f'string_split({c}, chr(10))')}, lambda ln: {namelike})"
    return (f"CASE WHEN len({bullets}) >= 2 THEN {stripped_list(bullets)}"
            rf" WHEN regexp_matches({c}, '(?m)^\s*\|.+\|') THEN {table}"
            f" WHEN contains({c}, ';') THEN {stripped_list(f'string_split({c}, chr(59))')}"
            f" WHEN length({c}) - length(replace({c}, ',', '')) >= 2 THEN {stripped_list(f'string_split({c}, chr(44))')}"
            f" WHEN len({lines}) >= 5 THEN {lines} ELSE []::VARCHAR[] END")


def keep_first(items: str) -> str:
    keys = f"list_transform({items}, lambda k: lower({strip('k')}))"
    return (f"list_filter({items}, lambda v, j: length(lower({strip('v')})) >= 2"
            f" AND list_position({keys}, lower({strip('v')})) = j)")


def uniform(*key: str) -> str:
    joined = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"(CAST('0x' || substring(md5(concat_ws(':', {joined})), 1, 8) AS UBIGINT) / 4294967296.0::DOUBLE)"


def week_key(d: str) -> str:
    return f"strftime({d}, '%Y-W%W')"


def settled(x: str, digits: int = 4) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28, 9)), {digits}) AS DOUBLE)"
