"""Secret scans through a trigram inverted index.

From each rule's regex follows a Boolean query over trigrams that every match holds
(AND along a concatenation, OR over alternatives). The trigrams that some rule asks for
are indexed, block by block as texts stream through: a posting list for each trigram, as a
bitmap over the block's texts. A rule's query intersects and unites postings, and only the
texts that are left are verified with the regex itself. A rule whose query is empty, as
it has no mandatory trigram, scans every text.

The index folds ASCII case, so a rule that ignores case costs no more terms.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.arrowtext import _FOLD, arrow_batches, pieces, utf8

#: A value without quotes: at least 16 characters, one of them a digit, or any word in prose would do.
_BARE = "(?:" + "|".join(rf"[A-Za-z_+~-][A-Za-z_./+~-]{{{i - 1}}}[0-9][0-9A-Za-z_./+=~-]{{{15 - i},}}" if i else r"[0-9][0-9A-Za-z_./+=~-]{15,}" for i in range(16)) + r"|[A-Za-z_+~-][A-Za-z_./+~-]{15,}[0-9][0-9A-Za-z_./+=~-]*)"

#: Rules in the syntax that Python's re and RE2 share.
RULES: dict[str, str] = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36,}\b",
    "gitlab_token": r"\bglpat-[0-9A-Za-z_-]{20,}",
    "slack_token": r"\bxox[abeprs]-[0-9A-Za-z-]{10,}",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}\b",
    "npm_token": r"\bnpm_[0-9A-Za-z]{36}\b",
    "private_key": r"-----BEGIN (?:[A-Z0-9]{1,10} ){0,2}PRIVATE KEY(?: BLOCK)?-----",
    "jwt": r"\beyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "url_password": r"\b[A-Za-z][0-9A-Za-z+.-]{1,20}://[^\s/:@\"'<>]*:[^\s/@\"'<>]{3,}@[0-9A-Za-z.-]+",
    "assigned_secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]*(?::=|=|:)[ \t]*(?:[\"'][0-9A-Za-z_./+=~-]{16,}[\"']|" + _BARE + ")",
    "bot_token": r"\b[0-9]{8,10}:[0-9A-Za-z_-]{35}\b",
}

_NEWLINE = r"[ \t]*(?:\r?\n|\\r\\n|\\n)+[ \t>\"'#*]*+"
_LINE_END = r"(?=[ \t]*(?:[\r\n\\\"']|\Z))"
#: A key's block: up to its END line, or if that is missing its headers and lines of base64.
_KEY_BLOCK = (
    RULES["private_key"]
    + r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z0-9]{1,10} ){0,2}PRIVATE KEY(?: BLOCK)?-----"
    + rf"|(?:{_NEWLINE}[A-Za-z][0-9A-Za-z-]*: [^\r\n\\]*)*(?:{_NEWLINE}[0-9A-Za-z+/=]{{16,}}{_LINE_END})+(?:{_NEWLINE}[0-9A-Za-z+/=]+{_LINE_END})?"
    + rf"|{_NEWLINE}[0-9A-Za-z+/=]+(?=\s*\Z)|[ \t]+[0-9A-Za-z+/=]{{40,}}(?:[ \t]+[0-9A-Za-z+/=]{{16,}})*)?"
)
#: What is scanned for: RULES, as their SQL states them, with whole key blocks.
SCANNED = RULES | {"private_key": _KEY_BLOCK}

#: Strings of one regex part that are kept apart; beyond, its trigrams are taken and its ends kept.
SETS = 64

# A query: True, a trigram (bytes of three), ("and", frozenset) or ("or", frozenset).
Query = bool | bytes | tuple[str, frozenset]


def conj(*parts: Query) -> Query:
    flat: set = set()
    for p in parts:
        flat |= p[1] if isinstance(p, tuple) and p[0] == "and" else set() if p is True else {p}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def disj(*parts: Query) -> Query:
    flat: set = set()
    for p in parts:
        if p is True:
            return True
        flat |= p[1] if isinstance(p, tuple) and p[0] == "or" else {p}
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def _trigrams(strings: frozenset[bytes]) -> Query:
    """What each match holds if it holds one of the strings."""
    return disj(*(conj(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings))


class Part:
    """What is known of the matches of a part of a regex: the whole strings if they are
    few, else what they may begin and end with, and a query."""

    def __init__(self, exact: frozenset[bytes] | None, begin: frozenset[bytes], end: frozenset[bytes], query: Query):
        if exact is not None and (len(exact) > SETS or max(map(len, exact)) > 64):
            begin, end, query, exact = exact, exact, conj(query, _trigrams(exact)), None
        if exact is None:
            begin, end = frozenset(s[:2] for s in begin), frozenset(s[-2:] for s in end)
            if max(len(begin), len(end)) > SETS:
                begin, end = (frozenset([b""]) if len(x) > SETS else x for x in (begin, end))
        self.exact, self.begin, self.end, self.query = exact, begin, end, query

    def finished(self) -> Query:
        return conj(self.query, _trigrams(self.exact)) if self.exact is not None else self.query

    def then(self, other: Part) -> Part:
        if self.exact is not None and other.exact is not None:
            both = frozenset(a + b for a in self.exact for b in other.exact)
            return Part(both, both, both, conj(self.query, other.query))
        left = self.exact if self.exact is not None else self.end
        right = other.exact if other.exact is not None else other.begin
        query = conj(self.finished(), other.finished(), _trigrams(frozenset(a + b for a in left for b in right)))
        begin = frozenset(a + b for a in self.exact for b in other.begin) if self.exact is not None else self.begin
        end = frozenset(a + b for a in self.end for b in other.exact) if other.exact is not None else other.end
        return Part(None, begin, end, query)

    def otherwise(self, other: Part) -> Part:
        if self.exact is not None and other.exact is not None:
            both = self.exact | other.exact
            return Part(both, both, both, disj(self.query, other.query) if True not in (self.query, other.query) else True)
        begin = (self.exact or self.begin) | (other.exact or other.begin)
        end = (self.exact or self.end) | (other.exact or other.end)
        return Part(None, begin, end, disj(self.finished(), other.finished()))


def _strings(*strings: bytes) -> Part:
    return Part(frozenset(strings), frozenset(strings), frozenset(strings), True)


EMPTY, ANY = _strings(b""), Part(None, frozenset([b""]), frozenset([b""]), True)


def _analyse(nodes) -> Part:
    out = EMPTY
    for op, arg in nodes:
        if op is C.LITERAL:
            step = _strings(chr(arg).lower().encode() if arg < 128 else chr(arg).encode())
            if arg >= 128:  # may stand for its other case as well
                step = ANY
        elif op is C.IN:
            chars: set[int] = set()
            for kind, what in arg:
                chars |= {what} if kind is C.LITERAL else set(range(what[0], what[1] + 1)) if kind is C.RANGE and what[1] - what[0] < SETS else {1 << 20}
            step = _strings(*{chr(c).lower().encode() for c in chars}) if max(chars) < 128 and len(chars) <= SETS else ANY
        elif op is C.BRANCH:
            step = None
            for branch in arg[1]:
                step = _analyse(branch) if step is None else step.otherwise(_analyse(branch))
        elif op is C.SUBPATTERN:
            step = _analyse(arg[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            inner = _analyse(inner)
            if (low, high) == (0, 1):
                step = EMPTY.otherwise(inner)
            elif not low:
                step = ANY
            else:
                step = inner
                for _ in range(min(low, 3) - 1):
                    step = step.then(inner)
                if high > min(low, 3):
                    step = Part(None, step.exact or step.begin, step.exact or step.end, step.finished())
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            continue
        elif op is C.ATOMIC_GROUP:
            step = _analyse(arg)
        else:
            step = ANY
        out = out.then(step)
    return out


def query_of(pattern: str) -> Query:
    """Boolean query over folded trigrams that every text with a match satisfies."""
    return _analyse(parser.parse(pattern, re.ASCII)).finished()


def terms(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set().union(*map(terms, query[1])) if isinstance(query, tuple) else set()


class Scanner:
    def __init__(self, rules: dict[str, str]):
        self.rules = {name: re.compile(p, re.ASCII) for name, p in rules.items()}
        self.queries = {name: query_of(p) for name, p in rules.items()}
        self.terms = sorted(set().union(*map(terms, self.queries.values())))
        self.number = {t: i for i, t in enumerate(self.terms)}
        self.slot: np.ndarray | None = None

    def index(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Postings: for each trigram asked for, a bitmap of the texts that hold it."""
        if self.slot is None:
            self.slot = np.zeros(1 << 24, np.uint16)
            for t, i in self.number.items():
                self.slot[int.from_bytes(t, "big")] = i + 1
        n = len(offsets) - 1
        postings = np.zeros((len(self.terms), n), bool)
        if len(data) < 3:
            return postings
        folded = _FOLD[data].astype(np.uint32)
        term = self.slot[folded[:-2] << np.uint32(16) | folded[1:-1] << np.uint32(8) | folded[2:]]
        at = np.flatnonzero(term)
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[text + 1]
        postings[term[at[inside]] - 1, text[inside]] = True
        return postings

    def candidates(self, query: Query, postings: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, bytes):
            return postings[self.number[query]]
        parts = [self.candidates(q, postings) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, str, str]]]]:
        """(text, its [(start, end, rule, secret)] in order), for texts with secrets; places are in characters."""
        postings = self.index(*utf8(texts))
        asked = {name: self.candidates(query, postings) for name, query in self.queries.items()}
        null = texts.is_null().to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(np.logical_or.reduce(list(asked.values())) & ~null):
            text = texts[int(i)].as_py()
            found = [(m.start(), m.end(), name, m.group()) for name, rule in self.rules.items() if asked[name][i] for m in rule.finditer(text)]
            if found:
                yield int(i), sorted(found)


def findings(docs: DataFrame, rules: dict[str, str] = SCANNED) -> DataFrame:
    """(doc_id, rule, start_char, end_char, sha256), one row a match of a rule; the secret
    itself is only given by its hash.

    Null and empty texts have no row; a null doc_id has rows with a null doc_id, and
    repeated rows have theirs each. Matches of different rules may overlap. Other columns
    are not looked at. Rules are regexes that don't match the empty string."""
    arrow_batches(docs.sparkSession)
    scanner = Scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                rows = [(i, name, start, end, hashlib.sha256(secret.encode()).hexdigest()) for i, found in scanner.scan(piece.column(1)) for start, end, name, secret in found]
                text, name, start, end, digest = zip(*rows) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(text, pa.int64())), pa.array(name, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.string())], ["doc_id", "rule", "start_char", "end_char", "sha256"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, rule string, start_char int, end_char int, sha256 string")


def redacted(text: str, found: list[tuple[int, int, str, str]]) -> str:
    """The text with a mark in place of each secret; overlapping ones are one."""
    out, done = [], 0
    for start, end, name, _ in found:
        if start >= done:
            out += [text[done:start], f"[{name}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, rules: dict[str, str] = SCANNED) -> DataFrame:
    """docs with ``[rule]`` in place of every secret. All rows stay, texts without secrets as
    they are, null texts too. A column n_chars gets the new length where the text has
    changed; other columns are left alone."""
    arrow_batches(docs.sparkSession)
    scanner = Scanner(rules)
    place = docs.columns.index("text")
    count = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, batch.schema.names[place]):
                texts = piece.column(place)
                new = {i: redacted(texts[i].as_py(), found) for i, found in scanner.scan(texts)}
                if new:
                    columns = list(piece.columns)
                    changed = np.zeros(len(texts), bool)
                    changed[list(new)] = True
                    columns[place] = pa.compute.replace_with_mask(texts, pa.array(changed), pa.array([new[i] for i in sorted(new)], texts.type))
                    if count is not None:
                        columns[count] = pa.compute.replace_with_mask(columns[count], pa.array(changed), pa.array([len(new[i]) for i in sorted(new)], columns[count].type))
                    piece = pa.RecordBatch.from_arrays(columns, schema=piece.schema)
                yield piece

    return docs.mapInArrow(run, docs.schema)
