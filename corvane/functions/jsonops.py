"""JSON documents: flattening, projection, masking and tests of fields.

Numbers keep the text they were written with. Control characters in strings are allowed."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.hashing import hash_text, hash_texts
from corvane.functions.security import ADM, RAW_DATA, label, path_labels
from corvane.functions.text import SEPARATOR, wildcard_match

MASK = "MASKED_"
#: Paths that are remembered.
PATHS = 1 << 16


class Lexeme(str):
    """A number as it was written."""


_decode = json.JSONDecoder(strict=False, parse_int=Lexeme, parse_float=Lexeme, parse_constant=Lexeme).decode


def loads(text: str | None):
    """The document, or None if it is none (a scalar is none either)."""
    try:
        out = _decode(text) if text else None
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict | list) else None


class Hole(int):
    """Stands for a value whose hash is made later, with all others of a batch."""


def dumps(value, hashes: list[str] | None = None) -> str:
    if isinstance(value, Hole):
        return f'"{MASK}{hashes[value]}"'
    if isinstance(value, Lexeme):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{_quoted(k)}:{dumps(v, hashes)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(dumps(v, hashes) for v in value) + "]"
    return _quoted(value) if isinstance(value, str) else json.dumps(value)


_quoted = json.JSONEncoder(ensure_ascii=False).encode


def flatten(document, prefix: str = "") -> dict[str, object]:
    """{path: scalar}; empty objects and arrays are values of their own."""
    out: dict[str, object] = {}
    stack = [(prefix, document)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict) and value:
            stack += [(f"{path}{SEPARATOR}{k}" if path else k, v) for k, v in reversed(value.items())]
        elif isinstance(value, list) and value:
            stack += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
        else:
            out[path] = value
    return out


@lru_cache(PATHS)
def _steps(path: str) -> tuple[str, ...]:
    steps: list[str] = []
    for level in path.split(SEPARATOR):
        name = re.match(r"[^\[]*", level)[0]
        steps += [name] if name or not level.startswith("[") else []
        steps += re.findall(r"\[\d+\]", level)
    return tuple(steps)


def unflatten(flat: dict[str, object]):
    """The document again; positions of arrays that are left close up."""
    root: dict = {}
    for path, value in flat.items():
        steps = _steps(path)
        node = root
        for step in steps[:-1]:
            node = node.setdefault(step, {})
        node[steps[-1]] = value

    def close(node):
        if not isinstance(node, dict):
            return node
        if node and all(re.fullmatch(r"\[\d+\]", k) for k in node):
            return [close(v) for _, v in sorted(node.items(), key=lambda kv: int(kv[0][1:-1]))]
        return {k: close(v) for k, v in node.items()}

    return close(root)


def text_of(value) -> str | None:
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, str) else dumps(value)


class Projection:
    """Keeps fields that match a pattern; what the patterns say of a path is looked up once."""

    def __init__(self, patterns: list[str]):
        self.patterns, self.known = patterns, {}

    def keeps(self, path: str) -> bool:
        out = self.known.get(path)
        if out is None:
            out = self.known[path] = any(wildcard_match(p, path) for p in self.patterns)
        return out

    def __call__(self, text: str | None) -> str | None:
        document = loads(text)
        if document is None:
            return text
        if len(self.known) > PATHS:
            self.known.clear()
        return dumps(unflatten({k: v for k, v in flatten(document).items() if self.keeps(k)}))


def project_document(text: str | None, patterns: list[str]) -> str | None:
    """Only fields that match a pattern; what is no JSON stays as it is."""
    return Projection(patterns)(text)


class Masking:
    """Fields none of whose first three levels is authorised become MASKED_ and a hash; all hashes of a batch are
    made together."""

    def __init__(self, dataset: str, auths: set[str], salt: str | None = None, magic: str = "__id__"):
        self.start, self.auths, self.salt, self.magic = label(dataset) + "_", frozenset(auths), salt or "", magic
        self.known: dict[str, bool] = {}

    def shows(self, path: str) -> bool:
        out = self.known.get(path)
        if out is None:
            out = self.known[path] = path == self.magic or any(self.start + x in self.auths for x in path_labels(path))
        return out

    def _walk(self, value, path: str, holes: dict[str, Hole]):
        if isinstance(value, dict) and value:
            return {k: self._walk(v, f"{path}{SEPARATOR}{k}" if path else k, holes) for k, v in value.items()}
        if isinstance(value, list) and value:
            return [self._walk(v, f"{path}[{i}]", holes) for i, v in enumerate(value)]
        return value if self.shows(path) else holes.setdefault(text_of(value) or "", Hole(len(holes)))

    def __call__(self, texts: Iterable[str | None]) -> list[str | None]:
        texts = list(texts)
        if self.start + RAW_DATA in self.auths:
            return texts
        holes: dict[str, Hole] = {}
        documents = [loads(t) for t in texts]
        walked = [None if d is None else self._walk(d, "", holes) for d in documents]
        hashes = hash_texts(list(holes), self.salt)
        if len(self.known) > PATHS:
            self.known.clear()
        return [t if w is None else dumps(w, hashes) for t, w in zip(texts, walked)]


def mask_document(text: str | None, dataset: str, auths: set[str], salt: str | None = None, magic: str = "__id__") -> str | None:
    """Of one document; see ``Masking``."""
    return Masking(dataset, auths, salt, magic)([text])[0]


class Matching:
    """Whether every wanted field has its value, or a value with the MASKED_ hash; by exact path, else by pattern.
    All hashes of a batch are made together, and what the patterns say of a path is looked up once."""

    def __init__(self, wanted: dict[str, str]):
        self.wanted = wanted
        self.known: dict[str, dict[str, bool]] = {k: {} for k in wanted}

    def _texts(self, flat: dict[str, object], name: str) -> list[str | None]:
        """Texts of the values that a wanted field may be."""
        if name in flat:
            return [text_of(flat[name])]
        known, out = self.known[name], []
        for path, value in flat.items():
            if path not in known:
                known[path] = wildcard_match(name, path)
            if known[path]:
                out.append(text_of(value))
        if len(known) > PATHS:
            known.clear()
        return out

    def __call__(self, texts: Iterable[str | None]) -> list[bool]:
        hashed = [k for k, want in self.wanted.items() if want.startswith(MASK)]
        found: list[dict[str, list[str | None]] | None] = []
        for text in texts:
            document = loads(text)
            flat = None if document is None else flatten(document)
            found.append(None if flat is None else {k: self._texts(flat, k) for k in self.wanted})
        distinct = list(dict.fromkeys(x or "" for f in found if f is not None for k in hashed for x in f[k]))
        masked = {x: MASK + h for x, h in zip(distinct, hash_texts(distinct))}

        def good(own: str | None, want: str) -> bool:
            return own == want or masked.get(own or "") == want

        return [f is not None and all(any(good(x, want) for x in f[k]) for k, want in self.wanted.items()) for f in found]


def fields_match(text: str | None, wanted: dict[str, str]) -> bool:
    """Of one document; see ``Matching``."""
    return Matching(wanted)([text])[0]


def project(value: Column, patterns: list[str]) -> Column:
    keep = Projection(patterns)
    return F.pandas_udf(lambda s: s.map(keep), "string")(value)


def mask(value: Column, dataset: str, auths: set[str], salt: str | None = None, magic: str = "__id__") -> Column:
    masking = Masking(dataset, auths, salt, magic)
    return F.pandas_udf(lambda s: pd.Series(masking(s), index=s.index, dtype=object), "string")(value)


def where_fields(value: Column, wanted: dict[str, str]) -> Column:
    """``Matching`` of a column. Not deterministic for Spark, which would else move the test below a repartition and so
    into as few tasks as read the table."""
    matching = Matching(wanted)
    return F.pandas_udf(lambda s: pd.Series(matching(s), index=s.index, dtype=bool), "boolean").asNondeterministic()(value)


def hidden(labels: Column, auths: set[str]) -> Column:
    """Whether a value that is no JSON is seen as its hash only: by an administrator without another of its labels."""
    rest = F.array(*[F.lit(a) for a in sorted(auths - {ADM})]).cast("array<string>")
    return F.lit(ADM in auths) & F.array_contains(labels, ADM) & ~F.arrays_overlap(labels, rest)


def flat_rows(raw: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, path, text, kind): a row for each scalar of each document; kind is n, s, b, or z for null.

    Rows whose value is no JSON object or array have no row. Keys are taken as Arrow columns; Python sees the
    documents alone."""
    types = dict(raw.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, path, text, kind = [], [], [], []
            for i, source in enumerate(batch.column(len(keys)).to_pylist()):
                document = loads(source)
                if not document:
                    continue
                flat = flatten(document)
                row += [i] * len(flat)
                path += flat
                for scalar in flat.values():
                    text.append(text_of(scalar))
                    kind.append("z" if scalar is None else "n" if isinstance(scalar, Lexeme) else "b" if isinstance(scalar, bool) else "s")
            at = pa.array(row, pa.int64())
            columns = [batch.column(k).take(at) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(path, pa.string()), pa.array(text, pa.string()), pa.array(kind, pa.string())], [*keys, "path", "text", "kind"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", path string, text string, kind string"
    return raw.select(*keys, value).mapInArrow(run, schema)
