"""Tokens, typed terms and wildcards."""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN, STRING, NUMBER, DATE, BOOLEAN, NA = range(6)
SEPARATOR = "¤"
NUMBER_PATTERN = r"^[+-]?(0|[1-9][0-9]*)(\.[0-9]+)?$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
_WORD = re.compile(r"[^\W_]+")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_tokens(text: str) -> list[str]:
    """The same for a query word, on the driver."""
    return _WORD.findall(text.lower())


def term_type(value: Column) -> Column:
    """Type code of a JSON string: numbers without leading zeros or bare points, ISO instants, true and false; else a string."""
    return F.when(value.rlike(NUMBER_PATTERN), NUMBER).when(value.rlike(DATE_PATTERN) & F.try_to_timestamp(value).isNotNull(), DATE).when(F.lower(value).isin("true", "false"), BOOLEAN).otherwise(STRING).cast("tinyint")


def term_number(value: Column, kind: Column) -> Column:
    """Sort key of numbers; beyond DECIMAL(38,18) it is null, and the text still matches."""
    return F.when(kind == NUMBER, value.try_cast("decimal(38,18)"))


def general_field(path: Column) -> Column:
    """Array positions become [*]."""
    return F.regexp_replace(path, r"\[\d+\]", "[*]")


def looks_base64(value: Column) -> Column:
    """Decodable, of a length divisible by four, with a digit, both cases and no space."""
    alphabet = r"^[A-Za-z0-9+/]{16,}={0,2}$"
    return (F.length(value) % 4 == 0) & value.rlike(alphabet) & value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]") & F.try_to_binary(value, F.lit("base64")).isNotNull()


def iso_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


_accented = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]) if c == c.lower() and unicodedata.normalize("NFD", c) != c]
_MARKS = "".join(map(chr, range(0x300, 0x370)))
_plain = "".join("".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))[:1] for c in _accented)


def normalize(text: Column) -> Column:
    """Lower case without accents, of Latin, Greek and Cyrillic letters and of combining marks."""
    return F.translate(F.lower(text), "".join(_accented) + _MARKS, _plain)


def normal_terms(text: Column) -> Column:
    """The whole value as one normal term: an index tokenizer for fields that are not taken apart."""
    return F.array(normalize(F.trim(text)))


def is_number(text: str) -> bool:
    try:
        return Decimal(text).is_finite()
    except InvalidOperation:
        return False


# Wildcards: * is any run of characters, ? one character.


def has_wildcards(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def compact(pattern: str) -> str:
    return re.sub(r"\*+", "*", pattern)


def literal_prefix(pattern: str) -> str:
    return re.match(r"[^*?]*", pattern)[0]


def wildcard_regex(pattern: str) -> str:
    """For whole strings, newlines and NULs included."""
    quoted = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) if c.isascii() and not c.isalnum() and c != "\0" else c for c in compact(pattern))
    return f"(?s)\\A{quoted}\\z"


def wildcard_match(pattern: str, text: str) -> bool:
    return bool(pattern) and re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), text, re.S) is not None


def wildcard(column: Column, pattern: str) -> Column:
    """Whether a column matches; plain patterns and prefixes stay predicates that can be pushed down."""
    if not pattern:
        return F.lit(False)
    if not has_wildcards(pattern):
        return column == pattern
    prefix = literal_prefix(pattern)
    if pattern == prefix + "*":
        return column.startswith(prefix)
    return (column.startswith(prefix) & column.rlike(wildcard_regex(pattern))) if prefix else column.rlike(wildcard_regex(pattern))


def any_wildcard(column: Column, patterns: list[str] | set[str]) -> Column:
    """Any of some patterns; plain ones become one IN list."""
    plain = sorted(p for p in patterns if p and not has_wildcards(p))
    out = column.isin(plain) if plain else F.lit(False)
    for p in sorted(p for p in patterns if has_wildcards(p)):
        out = out | wildcard(column, p)
    return out


def wildcard_filter(column: Column, patterns: list[str], match_all: bool = False) -> Column:
    """AND or OR of patterns; a null value passes, no pattern is true for AND and false for OR."""
    out = F.lit(match_all)
    for p in patterns:
        out = (out & wildcard(column, p)) if match_all else (out | wildcard(column, p))
    return F.coalesce(out, F.lit(True))


def term_predicate(term: Column, kind: Column, reverse: Column, pattern: str) -> Column:
    """A term as written in a query. A leading wildcard is looked up in the reversed term, of strings only."""
    if pattern[:1] in ("*", "?") and pattern[-1:] in ("*", "?"):
        raise ValueError("a term can't begin and end with a wildcard")
    if pattern[:1] in ("*", "?"):
        return (kind == STRING) & wildcard(reverse, pattern[::-1])
    return wildcard(term, pattern)


def way_predicate(pattern: str, way: str | None = None) -> Column:
    """The same on rows that are kept in two directions: forward ones by term, backward ones by term_rev. Which one is looked at
    depends on the pattern, unless ``way`` is given."""
    leading = pattern[:1] in ("*", "?")
    if leading and pattern[-1:] in ("*", "?"):
        raise ValueError("a term can't begin and end with a wildcard")
    way = way or ("b" if leading else "f")
    own = (wildcard(F.col("term_rev"), pattern[::-1]) if way == "b" else wildcard(F.col("term"), pattern)) & ((F.col("term_type") == STRING) if leading else F.lit(True))
    return (F.col("way") == way) & own
