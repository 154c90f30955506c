"""Text columns: matching, normalising, extracting. Every function maps Column to Column."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: phrases, word lists and patterns that decide results ---------------

REFUSAL_PHRASES = [
    "i cannot find", "i don't have", "i couldn't find",
    "no data", "no record", "not available", "not found",
    "无法找到", "没有找到", "未找到", "无相关记录", "查不到",
    "could you provide", "could you clarify", "can you specify",
    "请提供", "请确认", "需要更多信息", "需要你提供",
]
TOOL_ERROR_PHRASES = [
    "api call failed", "verification failed", "invalid code",
    "error occurred", "request failed", "connection refused",
    "timed out", "timeout", "rate limit", "429",
    "500 internal server error", "502 bad gateway", "503 service unavailable",
    "tool execution failed", "function call error",
    "接口报错", "调用失败", "请求超时",
]
NUMBER_PATTERN = r"-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
ANSWER_PATTERN = r"(?:^|\n)\s*ANSWER\s*:\s*(.+?)(?:\n|$)"
BULLET_PATTERN = r"^\s*(?:[-•]\s|\*\s|\d+[.)]\s)\s*(.+)"
TABLE_ROW_PATTERN = r"^\s*\|(.+)\|"
SEPARATOR_CELL_PATTERN = r"^:?-+:?$"
VALUE_LINE_PATTERN = (
    r"^[\d.,+\-]+\s*(%|mg|kg|cm|mm|bpm|mmHg|mmol|g/dL|mL|µg|IU|"
    r"mg/dL|mEq|mIU|ng|pg|fl|fL|U/L|cells|k/µL|M/µL|µmol|"
    r"mm/hr|sec|min|hours?|days?|years?|lbs?|in\.?|°[CF])?$"
)
HEADER_LINE_PATTERN = r"^(\*{1,2})?(\d+[).]\s|#{1,4}\s|[A-Z][A-Z\s&]{5,}$)"
HEADER_WORDS = [
    "indicator", "value", "unit", "name", "result", "range",
    "normal range", "reference", "status", "date", "category",
    "指标", "数值", "单位", "参考范围", "结果",
]
SENTENCE_MARKS = [
    " are ", " is ", " the ", " here ", " based on ",
    " following ", " recorded ", " below",
]
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006" \
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# --------------------------------------------------------------------------------------

# Decimal digits outside ASCII and what they mean, by the Unicode tables.
_OTHER_DIGITS = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) == "Nd"]
_THEIR_VALUES = "".join(str(unicodedata.decimal(c)) for c in _OTHER_DIGITS)


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`; inside a lambda it would run per element."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def contains_ci(haystack: Column, needle: Column | str) -> Column:
    n = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(F.coalesce(haystack.cast("string"), F.lit(""))), F.lower(strip(n)))


def alnum_compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def match_name(query: Column | str, *values: Column) -> Column:
    """Substring match on the plain or the letters-and-digits form of any value."""
    q = F.lit(query) if isinstance(query, str) else query
    compact = alnum_compact(q)
    hit = F.lit(False)
    for v in values:
        text = F.coalesce(v.cast("string"), F.lit(""))
        hit = hit | contains_ci(text, q) | ((compact != "") & F.contains(alnum_compact(text), compact))
    return (strip(q) == "") | hit


def date_prefix(c: Column) -> Column:
    return F.substring(strip(F.coalesce(c.cast("string"), F.lit(""))), 1, 10)


def answer_line(c: Column) -> Column:
    """Text of the first `ANSWER:` line, NULL without one."""
    pattern = F.lit("(?dU)" + ANSWER_PATTERN)
    return F.when(F.regexp_like(c, pattern), strip(F.regexp_extract(c, "(?dU)" + ANSWER_PATTERN, 1)))


def ascii_digits(c: Column) -> Column:
    """Decimal digits of all scripts, such as full-width ones, as ASCII digits."""
    return F.when(F.regexp_like(c, F.lit(r"[\p{Nd}&&[^0-9]]")), F.translate(c, "".join(_OTHER_DIGITS), _THEIR_VALUES)).otherwise(c)


def number_strings(c: Column) -> Column:
    return F.regexp_extract_all(F.translate(ascii_digits(c), "−", "-"), F.lit(NUMBER_PATTERN), F.lit(0))


def decimal_places(number: Column) -> Column:
    return F.length(F.regexp_extract(number, r"\.(\d+)$", 1))


def to_number(number: Column) -> Column:
    return F.replace(number, F.lit(","), F.lit("")).try_cast("double")


def close(a: Column, b: Column, tolerance: Column) -> Column:
    larger = F.greatest(F.abs(a), F.abs(b))
    return (
        F.when((a == 0) & (b == 0), F.lit(True))
        .when((a == 0) | (b == 0), F.abs(a - b) < 1e-6)
        .otherwise(F.abs(a - b) <= tolerance * larger)
    )


def _round_to(x: Column, places: Column) -> Column:
    scale = F.pow(F.lit(10.0), places)
    return F.rint(x * scale) / scale


def close_numbers(a: Column, b: Column, tolerance: Column) -> Column:
    """`close` on two number strings, tried again at the coarser of their precisions."""
    x, y = to_number(a), to_number(b)
    places = F.least(decimal_places(a), decimal_places(b))
    return close(x, y, tolerance) | close(_round_to(x, places), _round_to(y, places), tolerance)


def has_any(c: Column, phrases: Sequence[str]) -> Column:
    """One pass over the text for a fixed list of literal phrases."""
    alternation = "|".join(r"\Q" + p + r"\E" for p in phrases)
    return F.regexp_like(c, F.lit(alternation))


def data_status(c: Column) -> Column:
    hit = has_any(F.lower(c), REFUSAL_PHRASES + TOOL_ERROR_PHRASES)
    return F.when(hit, F.lit("data_not_found")).otherwise(F.lit("data_found"))


def normalize_text(c: Column) -> Column:
    steps = [
        (r"\*{1,3}|_{1,3}", ""),
        (r"(?mU)^#{1,6}\s*", ""),
        (r"`([^`]*)`", "$1"),
        (r"\[([^\]]*)\]\([^\)]*\)", "$1"),
        (r"([a-z])([A-Z])", "$1 $2"),
        (r"([A-Z]+)([A-Z][a-z])", "$1 $2"),
        (r"[-;/]", " "),
        (r"(?U)[^\p{L}\p{N}_\s]", ""),
        (r"(?U)\s+", " "),
    ]
    for pattern, replacement in steps:
        c = F.regexp_replace(c, pattern, replacement)
    return F.trim(F.lower(c))


def match_terms(norm_standard: Column) -> Column:
    """Words of two or more characters; character pairs where there are fewer than two words."""
    return let(norm_standard, _terms_of)


def _terms_of(norm_standard: Column) -> Column:
    words = F.filter(F.split(norm_standard, " "), lambda w: F.length(w) >= 2)
    pairs = F.transform(
        F.sequence(F.lit(1), F.length(norm_standard) - 1),
        lambda i: F.substring(norm_standard, i, F.lit(2)),
    )
    return (
        F.when(F.size(words) > 1, words)
        .when(F.length(norm_standard) >= 2, pairs)
        .when(F.length(norm_standard) == 1, F.array(norm_standard))
        .otherwise(F.array().cast("array<string>"))
    )


def term_ratio(norm_generated: Column, terms: Column) -> Column:
    hits = F.filter(terms, lambda w: F.contains(norm_generated, w))
    return F.when(F.size(terms) > 0, F.size(hits) / F.size(terms)).otherwise(F.lit(0.0))


def keyword_ratio(generated: Column, standard: Column) -> Column:
    terms = match_terms(normalize_text(standard))
    return let(normalize_text(generated), lambda g: term_ratio(g, terms))


def _stripped(items: Column) -> Column:
    return F.filter(F.transform(items, strip), lambda x: x != "")


def bullet_items(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?mdU)" + BULLET_PATTERN), F.lit(1))


def table_items(c: Column) -> Column:
    """Body rows of a pipe table, index cells removed, cells joined by a blank."""
    rows = F.transform(
        F.regexp_extract_all(c, F.lit("(?mdU)" + TABLE_ROW_PATTERN), F.lit(1)),
        lambda r: _stripped(F.split(r, r"\|")),
    )
    def is_rule(cells: Column) -> Column:
        return F.forall(cells, lambda x: x.rlike(SEPARATOR_CELL_PATTERN))

    body = let(rows, lambda rs: let(
        F.array_position(F.transform(rs, is_rule), True),
        lambda first: F.filter(rs, lambda cells, i: (first > 0) & (i >= first) & ~is_rule(cells))))
    joined = F.transform(
        body, lambda cells: F.array_join(F.filter(cells, lambda x: ~x.rlike(r"(?U)^\d+$")), " "))
    return F.filter(joined, lambda x: x != "")


def line_items(c: Column) -> Column:
    """Short lines that read like names; empty unless at least five remain."""
    def looks_like_name(line: Column) -> Column:
        lowered = F.lower(line)
        bare = F.regexp_replace(lowered, r"^[*#: ]+|[*#: ]+$", "")
        return (
            ~line.rlike("(?iuU)" + VALUE_LINE_PATTERN)
            & ~line.rlike("(?U)" + HEADER_LINE_PATTERN)
            & ~bare.isin(HEADER_WORDS)
            & ~((F.length(line) > 40) & has_any(lowered, SENTENCE_MARKS))
            & F.length(line).between(2, 80)
        )

    lines = F.filter(_stripped(F.split(c, "\n")), looks_like_name)
    return let(lines, lambda kept: F.when(F.size(kept) >= 5, kept).otherwise(F.array().cast("array<string>")))


def response_items(c: Column) -> Column:
    """List items in free text: bullets, table rows, semicolons, commas, then name-like lines."""
    bullets = bullet_items(c)
    return (
        F.when(F.size(bullets) >= 2, _stripped(bullets))
        .when(c.rlike(r"(?mdU)^\s*\|.+\|"), table_items(c))
        .when(F.contains(c, F.lit(";")), _stripped(F.split(c, ";")))
        .when(F.length(c) - F.length(F.replace(c, F.lit(","), F.lit(""))) >= 2, _stripped(F.split(c, ",")))
        .otherwise(line_items(c))
    )


def keep_first(items: Column) -> Column:
    """Case-insensitive distinct, order kept, one-character items dropped. Sorts instead of comparing pairs."""
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(
        F.lower(strip(x)).alias("key"), i.alias("pos"), x.alias("item"))))
    firsts = let(keyed, lambda s: F.filter(
        s, lambda x, i: (F.length(x["key"]) >= 2) & ((i == 0) | (F.get(s, i - 1)["key"] != x["key"]))))
    in_order = F.sort_array(F.transform(firsts, lambda x: F.struct(x["pos"].alias("pos"), x["item"].alias("item"))))
    return F.transform(in_order, lambda x: x["item"])


def word_match(pattern: str, text: Column) -> Column:
    """Whole-word match for short ASCII patterns, substring otherwise."""
    if len(pattern) <= 5 and pattern.isascii():
        return text.rlike(rf"(?<![\p{{L}}\p{{N}}_]){pattern}(?![\p{{L}}\p{{N}}_])")
    return F.contains(text, F.lit(pattern))


def weeks_days(c: Column) -> Column:
    pattern = r"(?U)(\d+)\s*weeks?\s*[,\s]*(\d+)\s*days?"
    text = F.lower(ascii_digits(c))
    return F.when(
        text.rlike(pattern),
        F.struct(
            F.regexp_extract(text, pattern, 1).try_cast("bigint").alias("weeks"),
            F.regexp_extract(text, pattern, 2).try_cast("bigint").alias("days"),
        ),
    )


def parse_judge_json(c: Column) -> Column:
    """First reading that parses: fenced block, whole text, outermost braces. VARIANT or NULL."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(
        F.try_parse_json(F.nullif(fenced, F.lit(""))),
        F.try_parse_json(c),
        F.try_parse_json(F.nullif(braces, F.lit(""))),
    )


def user_to_folder(c: Column) -> Column:
    return F.replace(c, F.lit("@"), F.lit("_AT_"))


def folder_to_user(c: Column) -> Column:
    return F.replace(c, F.lit("_AT_"), F.lit("@"))


def name_to_key(c: Column) -> Column:
    return F.replace(F.replace(F.lower(c), F.lit("-"), F.lit("_")), F.lit(" "), F.lit(""))


def tag_value(tags: Column, prefix: str) -> Column:
    """Value of the first `prefix:` tag."""
    hit = F.filter(tags, lambda t: F.startswith(t, F.lit(prefix + ":")))
    return F.when(F.size(hit) > 0, F.substring(hit[0], F.lit(len(prefix) + 2), F.length(hit[0])))


def slug(c: Column) -> Column:
    spaced = F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.lower(F.regexp_replace(strip(spaced), r"(?U)\s+", "_"))


def user_of_case(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("_Q")), F.regexp_extract(c, r"(?s)^(.*)_Q", 1)).otherwise(c)


def char_windows(c: Column, max_chars: int, overlap: int = 500) -> Column:
    """Overlapping pieces of at most `max_chars`; starts step by max_chars - overlap."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(max_chars - overlap))
    return F.when(F.length(c) <= max_chars, F.array(c)).otherwise(
        F.transform(starts, lambda s: F.substring(c, s + 1, F.lit(max_chars)))
    )
