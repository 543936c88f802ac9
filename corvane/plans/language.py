"""Parser and rewriter of the full-text query language.

Bare words are prefix searches, "quotes" and +words exact, ~words synonyms (which find
nothing), [a TO b] numeric ranges, field:x restricts the next word, phrase or range.
AND, OR and NOT (also -) have no precedence and bind to the left; without a keyword AND
is meant. A field is lost before a group, and a NOT before a group replaces the one in it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

PREFIX, LITERAL, SYNONYM, RANGE = "prefix", "literal", "synonym", "range"
AND, OR = "And", "Or"
PUNCTUATION = "~'\"`!@#%^&()-+=[]{}\\|;:,.<>/"
_WORD = re.compile(r"\S[^\s" + re.escape("".join(c for c in PUNCTUATION if c not in "[]")) + "]*")
_SOLID = re.compile(r"\S+")
_RENDER = {PREFIX: "{}", LITERAL: '"{}"', SYNONYM: "~{}", RANGE: "[{}]"}


@dataclass
class Leaf:
    form: str
    field: str
    value: str
    exclude: bool = False

    def __str__(self) -> str:
        own = (f"{self.field}:" if self.field else "") + _RENDER[self.form].format(self.value)
        return f"Not({own})" if self.exclude else own

    def terms(self) -> set[str]:
        return {self.value}

    def bounds(self) -> tuple[str | None, str | None] | None:
        """Ends of a range, None for an open one; None if it is not well formed."""
        ends = [x.strip() for x in self.value.split(" TO ") if x.strip()]
        if len(ends) != 2 or ends == ["*", "*"]:
            return None
        return tuple(None if x == "*" else x for x in ends)


@dataclass
class Branch:
    op: str
    left: Node | None
    right: Node | None
    exclude: bool = False

    def __str__(self) -> str:
        own = f"({self.left} {self.op} {self.right})"
        return f"Not{own}" if self.exclude else own

    def terms(self) -> set[str]:
        return set().union(*(x.terms() for x in (self.left, self.right) if x))


Node = Leaf | Branch


def _quote_end(text: str, at: int) -> int:
    end = text.find('"', at + 1)
    return len(text) if end < 0 else end


def _block_end(text: str, at: int) -> int:
    """Place of the bracket that closes the one at ``at``; brackets in quotes don't count."""
    opening, closing = text[at], {"(": ")", "[": "]"}[text[at]]
    depth, i = 1, at + 1
    while i < len(text):
        if text[i] == opening:
            depth += 1
        elif text[i] == closing:
            depth -= 1
            if not depth:
                return i
        elif text[i] == '"':
            i = _quote_end(text, i)
        i += 1
    return len(text)


class Parser:
    def __init__(self, stop_words: frozenset[str] = frozenset(), keep_punctuation: bool = False):
        self.stop_words, self.keep = stop_words, keep_punctuation

    def _reset(self) -> None:
        self.field, self.form, self.exclude, self.op = "", PREFIX, False, AND

    def _add(self, root: Node | None, node: Node) -> Node:
        joined = Branch(self.op, root, node) if root else node
        self._reset()
        return joined

    def _leaf(self, root: Node | None, value: str) -> Node | None:
        if value and value not in self.stop_words:
            return self._add(root, Leaf(self.form, self.field, value, self.exclude))
        self._reset()
        return root

    def parse(self, text: str) -> Node | None:
        root: Node | None = None
        self._reset()
        i = 0
        while i < len(text):
            c = text[i]
            if c.isspace():
                i += 1
            elif self.keep or c not in PUNCTUATION:
                root, i = self._word(root, text, i)
            elif c == '"':
                end = _quote_end(text, i)
                self.form = LITERAL
                root, i = self._leaf(root, text[i + 1 : end].strip()), end + 1
            elif c == "(":
                end = _block_end(text, i)
                inner = Parser(self.stop_words, self.keep).parse(text[i + 1 : end])
                if inner:
                    inner.exclude = self.exclude
                    root = self._add(root, inner)
                else:
                    self._reset()
                i = end + 1
            elif c == "[":
                end = _block_end(text, i)
                leaf = Leaf(RANGE, self.field, text[i + 1 : end].strip(), self.exclude)
                if " TO " in text[i + 1 : end] and leaf.bounds():
                    root = self._add(root, leaf)
                else:
                    self._reset()
                i = end + 1
            else:
                self.exclude |= c == "-"
                self.form = {"+": LITERAL, "~": SYNONYM}.get(c, self.form)
                i += 1
        return root

    def _word(self, root: Node | None, text: str, i: int) -> tuple[Node | None, int]:
        word = (_SOLID if self.keep else _WORD).match(text, i)[0]
        bracket = re.search(r"[\[\]]", word[1:])
        if bracket and text[i + len(word) : i + len(word) + 1] != ":":
            # brackets belong to a field only
            word = word[: 1 + bracket.start()]
        end = i + len(word)
        after = text[end : end + 1]
        key = word.lower()
        if key in ("and", "or"):
            self.op = AND if key == "and" else OR
        elif key == "not":
            self.exclude = True
        elif after == ":":
            self.field = word
        elif after == "[":
            self._reset()
        else:
            root = self._leaf(root, word)
        return root, end


def _flip(node: Branch) -> None:
    """De Morgan: the negation of a branch moves into or out of it."""
    node.op = AND if node.op == OR else OR
    node.exclude = not node.exclude
    for child in (node.left, node.right):
        child.exclude = not child.exclude


def rewrite(node: Node | None, root: bool = True) -> Node | None:
    """Negations stand as deep as they can, but as one outside two negated children; the negated
    child comes second; what is only negated is None at the root."""
    if isinstance(node, Branch):
        if node.exclude and node.left and node.right:
            _flip(node)
        node.left, node.right = rewrite(node.left, False), rewrite(node.right, False)
        if node.left and node.right:
            if not node.exclude and node.left.exclude and node.right.exclude:
                _flip(node)
            if node.left.exclude and not node.right.exclude:
                node.left, node.right = node.right, node.left
        else:
            node = node.left or node.right
    return None if node is None or root and node.exclude else node


def build(query: str, keep_punctuation: bool = False, stop_words: frozenset[str] = frozenset()) -> Node | None:
    """The rewritten tree of a query; None if it can't be answered."""
    if query is None:
        raise TypeError("a query is needed")
    return rewrite(Parser(stop_words, keep_punctuation).parse(query))
