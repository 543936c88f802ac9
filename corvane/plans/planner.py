"""From query trees to DataFrames of document ids, and to estimates.

Lowering runs no job. A tree is one pass over postings: rows that some leaf matches are grouped by document, with a
flag for each leaf, and the tree is a condition on the flags. Postings are (dataset, way, doc_id, field, term_type, term,
term_rev, term_num, labels, n), see ``tables``, or without dataset, way, term_rev and labels. Ids are distinct.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.security import narrow, visible
from corvane.plans.language import AND, LITERAL, OR, PREFIX, RANGE, Branch, Leaf, Node

log = logging.getLogger(__name__)


@dataclass
class Planner:
    """Looks up one dataset's postings and counts for somebody's authorisations."""

    postings: DataFrame
    counts: DataFrame | None = None
    dataset: str | None = None
    auths: set[str] | None = None
    tokenizer: Callable[[str], list[str]] | None = None
    secure: bool = field(default=True)

    def _base(self, table: DataFrame) -> DataFrame:
        out = table
        if self.dataset is not None:
            out = out.where(F.col("dataset") == self.dataset)
            if self.secure:
                out = out.where(visible(F.col("labels"), narrow(self.auths, self.dataset)))
        elif self.secure and "labels" in table.columns:
            out = out.where(visible(F.col("labels"), self.auths))
        return out

    def _conditions(self, leaf: Leaf, table: DataFrame) -> list[Column]:
        """Conditions on rows of a leaf: one for a range or each word; none if it can't be answered."""
        in_field = T.any_wildcard(F.col("field"), [leaf.field]) if leaf.field else F.lit(True)
        if leaf.form == RANGE:
            inside = self._range(leaf)
            if inside is None:
                return []
            return [in_field & inside & (F.col("way") == "f") if "way" in table.columns else in_field & inside]
        if leaf.form not in (PREFIX, LITERAL):
            return []
        words = self.tokens(leaf)
        if leaf.form == PREFIX:
            words = [w if T.has_wildcards(w) else w + "*" for w in words]
        return [in_field & self._term(w, table) for w in words]

    def tokens(self, leaf: Leaf) -> list[str]:
        """Words of a leaf; those with a wildcard at either end are dropped."""
        words = [leaf.value] if self.tokenizer is None or T.has_wildcards(leaf.value) else self.tokenizer(leaf.value)
        wild = "*?"
        return [w for w in map(T.compact, words) if not (w[:1] in wild and w[-1:] in wild and w)]

    def _term(self, word: str, table: DataFrame) -> Column:
        if "way" in table.columns:
            return T.way_predicate(word)
        return T.term_predicate(F.col("term"), F.col("term_type"), F.reverse("term"), word)

    @staticmethod
    def _range(leaf: Leaf) -> Column | None:
        ends = leaf.bounds()
        if ends is None or any(e is not None and not T.is_number(e) for e in ends):
            return None
        out = F.col("term_type") == T.NUMBER
        for end, low in zip(ends, (True, False)):
            if end is not None:
                bound = F.lit(end).cast("decimal(38,18)")
                out = out & ((F.col("term_num") >= bound) if low else (F.col("term_num") < bound))
        return out

    def none(self) -> DataFrame:
        return self.postings.select("doc_id").where(F.lit(False))

    def ids(self, node: Node | None, among: DataFrame | None = None) -> DataFrame:
        """Distinct doc_id of a tree, of those in ``among`` if given."""
        flags: list[Column] = []

        def lower(node: Node) -> Column:
            if isinstance(node, Leaf):
                first = len(flags)
                flags.extend(self._conditions(node, self.postings))
                own = [F.col(f"_{i}") for i in range(first, len(flags))]
                if not own:
                    return F.lit(False)
                out = own[0]
                for other in own[1:]:
                    out = (out | other) if node.form == PREFIX else (out & other)
                return out
            if node.left is None or node.right is None:
                only = node.left or node.right
                return lower(only) if node.op == OR and only and not only.exclude else F.lit(False)
            if node.left.exclude and node.right.exclude or node.op == OR and (node.left.exclude or node.right.exclude):
                log.warning("can't be answered: %s", node)
                return F.lit(False)
            left, right = lower(node.left), lower(node.right)
            if node.op == OR:
                return left | right
            return (~left if node.left.exclude else left) & (~right if node.right.exclude else right)

        found = lower(node) if node is not None else None
        if found is None or not flags:
            return self.none()
        any_ = flags[0]
        for other in flags[1:]:
            any_ = any_ | other
        base = self._base(self.postings).where(any_)
        if among is not None:
            base = base.join(among.select("doc_id"), "doc_id", "left_semi")
        held = [F.coalesce(F.bool_or(c), F.lit(False)).alias(f"_{i}") for i, c in enumerate(flags)]
        return base.groupBy("doc_id").agg(*held).where(found).select("doc_id")

    def sorted_ids(self, node: Node | None, among: DataFrame | None = None) -> DataFrame:
        return self.ids(node, among).orderBy("doc_id")

    def estimate_frame(self, node: Node | None) -> DataFrame:
        """(estimate) from term counts, one pass for all leaves: sums for words as written, the largest for phrases, sums for
        OR, the smaller for AND, the positive side where one is negated."""
        sums: list[Column] = []
        none = F.lit(0).cast("bigint")

        def lower(node: Node | None) -> Column:
            if node is None:
                return none
            if isinstance(node, Branch):
                sides = [x for x in (node.left, node.right) if x is not None and not x.exclude]
                if not sides or node.op == AND and None in (node.left, node.right):
                    return none
                values = [lower(x) for x in sides]
                return values[0] if len(values) == 1 else F.least(*values) if node.op == AND else values[0] + values[1]
            first = len(sums)
            # an estimate counts words as they are written
            exact = Leaf(LITERAL if node.form == PREFIX else node.form, node.field, node.value)
            sums.extend(F.coalesce(F.sum(F.when(c, F.col("n_docs"))), none).alias(f"_{first + i}") for i, c in enumerate(self._conditions(exact, self.counts)))
            own = [F.col(f"_{i}") for i in range(first, len(sums))]
            if not own:
                return none
            if node.form != PREFIX:
                return F.greatest(*own) if len(own) > 1 else own[0]
            out = own[0]
            for other in own[1:]:
                out = out + other
            return out

        out = lower(node)
        base = self._base(self.counts)
        return base.agg(*(sums or [none.alias("_none")])).select(out.alias("estimate"))

    def estimate(self, node: Node | None) -> int:
        """The same as a number; runs one job."""
        return int(self.estimate_frame(node).first()[0])
