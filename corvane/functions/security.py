"""Visibility labels of rows and fields, and who sees them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ADM, RAW_DATA, RAW_FILE = "ADM", "RAW_DATA", "RAW_FILE"


def label(text: str) -> str:
    """Without array positions, other characters as underscores, trimmed, upper case."""
    return re.sub(r"\s+|[^a-zA-Z0-9_]", "_", re.sub(r"\[\d+\]|\[\*\]", "", text)).strip().upper()


def label_column(text: Column) -> Column:
    # \W is [^a-zA-Z0-9_], but looked up in a table; most texts have no such character
    plain = F.regexp_replace(F.regexp_replace(text, r"\[\d+\]|\[\*\]", ""), r"\s+|\W", "_")
    return F.upper(F.when(text.rlike(r"\W"), F.trim(plain)).otherwise(text))


def path_labels(path: str, separator: str = "¤") -> list[str]:
    """Labels of the first three levels of a path."""
    levels = path.split(separator)
    return [label("_".join(levels[: i + 1])) for i in range(min(3, len(levels)))]


def path_labels_column(path: Column, separator: str = "¤") -> Column:
    levels = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size(levels))), lambda i: label_column(F.array_join(F.slice(levels, F.lit(1), i), "_")))


def narrow(auths: set[str] | None, prefix: str | None = None, suffix: str | None = None) -> set[str]:
    """The authorisations that matter for a dataset: ADM, and those with the prefix or suffix."""
    start = label(prefix) + "_" if prefix else None
    end = "_" + label(suffix) if suffix else None
    if start is None and end is None:
        return set(auths or ())
    return {a for a in auths or () if a == ADM or ((start is None or a.startswith(start)) and (end is None or a.endswith(end)))}


def visible(labels: Column, auths: set[str] | None) -> Column:
    """Rows without labels are for all; else one label has to be held."""
    held = F.array(*[F.lit(a) for a in sorted(auths or ())]).cast("array<string>")
    return (F.size(F.coalesce(labels, F.array().cast("array<string>"))) == 0) | F.arrays_overlap(labels, held)


def evaluate(expression: str, auths: set[str]) -> bool:
    """A visibility expression of labels, &, | and parentheses; an empty one is true."""
    parts = re.findall(r'"[^"]*"|[\w.:/-]+|[&|()]', expression)
    if not parts:
        return True
    at = 0

    def one() -> bool:
        nonlocal at
        if at >= len(parts):
            raise ValueError(f"incomplete visibility expression: {expression}")
        part, at = parts[at], at + 1
        if part != "(":
            return part.strip('"') in auths
        value = whole()
        if at >= len(parts) or parts[at] != ")":
            raise ValueError(f"unbalanced visibility expression: {expression}")
        at += 1
        return value

    def whole() -> bool:
        nonlocal at
        value, sign = one(), None
        while at < len(parts) and parts[at] in "&|":
            if sign not in (None, parts[at]):
                raise ValueError(f"& and | need parentheses: {expression}")
            sign, at = parts[at], at + 1
            other = one()
            value = (value and other) if sign == "&" else (value or other)
        return value

    value = whole()
    if at < len(parts):
        raise ValueError(f"unexpected {parts[at]} in {expression}")
    return value
