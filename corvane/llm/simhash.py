"""SimHash near-duplicates, found through a Gray-order hierarchical index.

A text's 128-bit fingerprint is the sign of a weighted sum over its distinct words
(folded case; longer words weigh more, as they are rarer). Two texts are near copies
if their fingerprints differ in at most ``k`` bits and their summed word weights by
less than three tenths of the larger; groups are the connected components of that
relation, and each group is named after its smallest doc_id.

Search is exact. The code is a ring of 16 bytes, each with a share of the ``k`` bits. If
two codes differ in at most ``k`` bits, one of the 16 rotations of the ring has this: from
its first byte on, the differences accumulated over any number of bytes stay within the
shares accumulated so far (a walk whose total is negative has a start from which it stays
negative). So each rotation is searched with bounds for every prefix, and a pair has to
survive them all in one rotation only.

The first bits of a rotated code are its head; a cell of the join is a pair of heads that
the bounds allow. In a cell the rotated codes are sorted by Gray rank, so that neighbours
share masked bit patterns; the patterns of the first 8, 12, ... 64 bits are the nodes of a
hierarchy that is joined with itself from the top: differences accumulate level by
level, and a pair of nodes beyond the bound is dropped with all codes below it, as is
one whose codes are all known to be connected. What is left is compared over all 128
bits. Cells report a spanning forest, not all pairs, so a group of thousands of copies
costs as many rows as it has members. Heads are counted first: the codes of one that has
more than a task should hold are dealt out to parts, and a cell is a pair of parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrowtext import U64, Words, arrow_batches, fold, mix, pieces, utf8
from corvane.llm.spread import cut, fresh_names

K = 20
#: Near copies also have summed word weights that differ by less than three tenths.
LEAST_TENTHS = 7
BYTES = 16
HEAD_BITS, MOST_HEAD_BITS = 3, 16
#: Codes per head from which on heads get longer, and codes of one head have parts.
CELL_CODES = 1 << 18
#: Rows of 8 bytes that may be broadcast.
BROADCAST_ROWS = 1_000_000
LEVELS = (8, 12, 16, 20, 24, 28, 32, 36, 40, 48, 56, 64)

_LANES = np.array([int.from_bytes(bytes((b >> (7 - i)) & 1 for i in range(8)), "little") for b in range(256)], np.uint64)
_RUN = 60


def _weights(length: np.ndarray) -> np.ndarray:
    return np.clip((length + 1) // 3, 1, 4).astype(np.uint64)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes as n x 16 bytes, summed weight of the distinct words of each text)."""
    n = len(offsets) - 1
    data = fold(data)
    words = Words(data, offsets)
    code = np.zeros((n, 16), np.uint8)
    if not len(words):
        return code, np.zeros(n, np.int64)
    hashes, text = words.hashes(data), words.text_of()
    own = hashes + mix(text.astype(np.uint64) + U64(1))
    order = np.argsort(own, kind="stable")
    first = np.ones(len(own), bool)
    first[1:] = own[order][1:] != own[order][:-1]
    keep = np.sort(order[first])
    hashes, text, weight = hashes[keep], text[keep], _weights(words.end[keep] - words.start[keep])
    bounds = np.searchsorted(text, np.arange(n + 1))
    some = np.flatnonzero(np.diff(bounds))
    # runs of at most _RUN words of one text: a byte lane then never overflows
    length = np.diff(bounds)[some]
    runs = -(-length // _RUN)
    run_text = np.repeat(np.arange(len(some)), runs)
    run_first = np.cumsum(runs) - runs
    run_start = bounds[some][run_text] + (np.arange(len(run_text)) - run_first[run_text]) * _RUN
    total = np.add.reduceat(weight, bounds[some]).astype(np.int64)
    both = np.stack([hashes, mix(hashes + U64(77))], axis=1)
    parts = both.view(np.uint8).reshape(-1, 16)
    for byte in range(16):
        lanes = np.add.reduceat(_LANES[parts[:, byte]] * weight, run_start)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), run_first, axis=0)
        code[some, byte] = np.packbits(2 * ones > total[:, None], axis=1)[:, 0]
    size = np.zeros(n, np.int64)
    size[some] = total
    return code, size


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo, size): one row a text that has words. ``size`` is the summed
    weight of its distinct words.

    Rows with a null doc_id, and null, empty or wordless texts have no row."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                code, size = fingerprints(*utf8(piece.column(1)))
                both, some = code.view(np.int64).reshape(-1, 2), size > 0
                yield pa.RecordBatch.from_arrays([piece.column(0).filter(pa.array(some)), pa.array(both[some, 0]), pa.array(both[some, 1]), pa.array(size[some])], ["doc_id", "hi", "lo", "size"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).where("doc_id is not null").mapInArrow(run, "doc_id long, hi long, lo long, size long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each 64-bit value in the Gray sequence (inverse Gray code)."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> U64(shift)
    return out


def rotated(codes: np.ndarray, start: int) -> np.ndarray:
    """The first 64 bits of each code (n x 2 words) from byte ``start`` of the ring on."""
    first, second = codes[:, start // 8], codes[:, 1 - start // 8]
    by = U64(start % 8 * 8)
    return first << by | second >> (U64(64) - by) if by else first.copy()


def _product(lo_a, hi_a, lo_b, hi_b):
    """Pairs (i, j) of all members of each pair of ranges, and the pair each is from."""
    size = (hi_a - lo_a) * (hi_b - lo_b)
    which = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    wide = (hi_b - lo_b)[which]
    return lo_a[which] + within // wide, lo_b[which] + within % wide, which


class GrayIndex:
    """Hierarchy over the first 64 bits of rotated codes in Gray order.

    ``levels[d]`` are the patterns that the top ``LEVELS[d]`` bits take, each with the
    range of its children in the next level; the last level's children are codes. Levels
    end where every pattern is one code."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(gray_rank(values), kind="stable")
        ordered = values[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for bits in LEVELS:
            pattern = ordered >> U64(64 - bits)
            start = np.flatnonzero(np.concatenate(([True], pattern[1:] != pattern[:-1])))
            self.levels.append((pattern[start], np.append(start, len(ordered))))
            if len(start) == len(ordered):
                break
        self.ordered = ordered
        self.roots: list[np.ndarray] = []

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Range of children of each node of ``level`` in the next one."""
        start = self.levels[level][1]
        if level + 1 == len(self.levels):
            return start[:-1], start[1:]
        below = self.levels[level + 1][1]
        at = np.searchsorted(below, start)
        return at[:-1], at[1:]

    def connect(self, root: np.ndarray) -> None:
        """Note for each node which root its codes have, or -1 if they have several."""
        own = root[self.order]
        self.roots = []
        for _, start in self.levels:
            low = np.minimum.reduceat(own, start[:-1])
            self.roots.append(np.where(np.maximum.reduceat(own, start[:-1]) == low, low, -1))

    def deepen(self, depth: int) -> None:
        """Repeat the last level, so that two hierarchies are joined level by level."""
        while len(self.levels) < depth:
            pattern = self.values_at(LEVELS[len(self.levels)])
            self.levels.append((pattern, np.arange(len(pattern) + 1)))

    def values_at(self, bits: int) -> np.ndarray:
        return self.ordered >> U64(64 - bits)


CHUNK = 1 << 19


def _cut(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of at most about CHUNK in total."""
    ends = np.cumsum(sizes)
    out, first = [], 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHUNK, "right")))
        out.append((first, last))
        first = last
    return out


def join(a: GrayIndex, b: GrayIndex, limits: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of codes whose accumulated differences stay within the limits of each level, in
    parts, without those that both sides know to be connected."""
    depth = max(len(a.levels), len(b.levels))
    a.deepen(depth)
    b.deepen(depth)

    def near(level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        good = np.bitwise_count(a.levels[level][0][x] ^ b.levels[level][0][y]) <= limits[level]
        if a is b:
            good &= x <= y
        if a.roots and b.roots:
            own = a.roots[level][x]
            good &= (own < 0) | (own != b.roots[level][y])
        return good

    def down(level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lo_a, hi_a = (x[i] for x in a.children(level))
        lo_b, hi_b = (x[j] for x in b.children(level))
        for first, last in _cut((hi_a - lo_a) * (hi_b - lo_b)):
            s = slice(first, last)
            # one pair of large ranges is cut along its longer side's members
            step = max(1, CHUNK // max(1, int((hi_b - lo_b)[s].max())))
            spans = [(lo_a[s], hi_a[s])] if last - first > 1 else [(np.array([x]), np.array([min(x + step, hi_a[first])])) for x in range(lo_a[first], hi_a[first], step)]
            for from_a, to_a in spans:
                x, y, _ = _product(from_a, to_a, lo_b[s], hi_b[s])
                if level + 1 == depth:
                    yield a.order[x], b.order[y]
                    continue
                some = near(level + 1, x, y)
                if some.any():
                    yield from down(level + 1, x[some], y[some])

    x, y, _ = _product(np.array([0]), np.array([len(a.levels[0][0])]), np.array([0]), np.array([len(b.levels[0][0])]))
    some = near(0, x, y)
    yield from down(0, x[some], y[some])


class Forest:
    """Union-find over 0..n-1; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.roots(i), self.roots(j)
            low, high = np.minimum(i, j), np.maximum(i, j)
            apart = low < high
            low, high = low[apart], high[apart]
            np.minimum.at(self.up, high, low)
            i, j = low, high
        self.flat()

    def roots(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.up[i]
            if (up == i).all():
                return up
            i = up

    def flat(self) -> None:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return
            self.up = up


def shares(k: int) -> np.ndarray:
    """Share of each byte of the ring in k + 1 bits, spread evenly."""
    return np.diff(np.arange(BYTES + 1) * (k + 1) // BYTES)


def limit(k: int, start: int, bits: int) -> int:
    """Differences allowed in the first ``bits`` bits of codes rotated to byte ``start``."""
    return int(np.roll(shares(k), -start)[: -(-bits // 8)].sum()) - 1


def masks(k: int, start: int, head_bits: int) -> np.ndarray:
    """Differences of two heads that the limits allow, nothing first."""
    all_ = np.arange(1 << head_bits, dtype=np.int64)
    good = np.bitwise_count(all_) <= limit(k, start, head_bits)
    if head_bits > 8:
        good &= np.bitwise_count(all_ >> (head_bits - 8)) <= limit(k, start, 8)
    return all_[good]


def cell_edges(codes: np.ndarray, size: np.ndarray, side: np.ndarray, start: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (i, root) of the near pairs that one cell finds.

    ``side`` 0 and 1 are the cell's two heads, 2 stands for both when they are the same."""
    forest = Forest(len(codes))
    hi, lo = np.ascontiguousarray(codes[:, 0]), np.ascontiguousarray(codes[:, 1])

    def link(x: np.ndarray, y: np.ndarray) -> bool:
        apart = np.bitwise_count(hi[x] ^ hi[y])
        some = apart <= k
        x, y, apart = x[some], y[some], apart[some]
        some = (apart + np.bitwise_count(lo[x] ^ lo[y]) <= k) & (np.minimum(size[x], size[y]) * 10 >= np.maximum(size[x], size[y]) * LEAST_TENTHS)
        some &= forest.up[x] != forest.up[y]
        if some.any():
            forest.add(x[some], y[some])
        return bool(some.any())

    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if len(left) and len(right):
        values = rotated(codes, start)
        a = GrayIndex(values[left])
        b = a if (side == 2).all() else GrayIndex(values[right])
        depth = [limit(k, start, bits) for bits in LEVELS]
        # neighbours in Gray order first: what they connect is not compared any more
        every = np.argsort(gray_rank(values), kind="stable")
        for step in (1, 2, 3):
            link(every[:-step], every[step:])

        def connect() -> None:
            for index, own in ((a, left), (b, right))[: 1 if a is b else 2]:
                index.connect(forest.up[own])

        for index in {id(a): a, id(b): b}.values():
            index.deepen(max(len(a.levels), len(b.levels)))
        connect()
        due = False
        for n, (x, y) in enumerate(join(a, b, depth)):
            due |= link(left[x], right[y])
            if due and (n < 8 or n % 16 == 0):
                connect()
                due = False
    child = np.flatnonzero(forest.up != np.arange(len(codes)))
    return child, forest.up[child]


_CELLS = "cell long, tile long, side byte, node long, hi long, lo long, size long"


def head_counts(nodes: DataFrame, head_bits: int) -> np.ndarray:
    """Number of nodes of each head of each rotation: 16 x 2 ** head_bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((BYTES, 1 << head_bits), np.int64)
        for batch in batches:
            codes = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1).view(np.uint64)
            for start in range(BYTES):
                out[start] += np.bincount((rotated(codes, start) >> U64(64 - head_bits)).astype(np.int64), minlength=1 << head_bits)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.reshape(-1)[at])], ["at", "n"])

    found = nodes.select("hi", "lo").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BYTES << head_bits, np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(BYTES, -1)


def near_edges(nodes: DataFrame, k: int = K, head_bits: int = HEAD_BITS, cell_codes: int | None = None) -> DataFrame:
    """(src, dst): edges between the ``node`` ids of (node, hi, lo, size), enough of
    them to connect whatever near pairs connect. Runs a job that counts heads."""
    if not 0 <= k < 128:
        raise ValueError("k has to be from 0 to 127")
    if not 1 <= head_bits <= MOST_HEAD_BITS:
        raise ValueError(f"head_bits has to be from 1 to {MOST_HEAD_BITS}")
    # a rotation whose first byte has no share has no pair
    allowed = [(start, masks(k, start, head_bits)) for start in range(BYTES) if limit(k, start, 8) >= 0]
    parts = np.maximum(1, -(-head_counts(nodes, head_bits) // (cell_codes or CELL_CODES)))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2000):
                batch = whole.slice(first, 2000)
                codes = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1).view(np.uint64)
                chance = mix(batch.column(0).to_numpy().view(np.uint64) + U64(5))
                for start, mask in allowed:
                    head = (rotated(codes, start) >> U64(64 - head_bits)).astype(np.int64)
                    part = (chance % parts[start][head].astype(np.uint64)).astype(np.int64)
                    # a row for each mask, and for each part of the other head
                    row, which = (x.reshape(-1) for x in np.indices((len(head), len(mask))))
                    others = parts[start][head[row] ^ mask[which]]
                    row, which, other = np.repeat(row, others), np.repeat(which, others), np.arange(others.sum()) - np.repeat(np.cumsum(others) - others, others)
                    mine, theirs, own = head[row], head[row] ^ mask[which], part[row]
                    least = np.minimum(mine, theirs)
                    same = mask[which] == 0
                    left = np.where(same, own <= other, mine == least)
                    tile = np.where(left, own << 32 | other, other << 32 | own)
                    side = np.where(same & (own == other), 2, ~left).astype(np.int8)
                    cell = np.int64(start) << 32 | least << 16 | mask[which]
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(tile), pa.array(side), *[c.take(at) for c in batch.columns]], ["cell", "tile", "side", "node", "hi", "lo", "size"])

    def search(key: tuple, table: pa.Table) -> pa.Table:
        codes = np.stack([table.column("hi").to_numpy(), table.column("lo").to_numpy()], axis=1).view(np.uint64)
        node = table.column("node").to_numpy()
        # by node id, so that the root of a tree is its smallest one
        order = np.argsort(node, kind="stable")
        child, root = cell_edges(codes[order], table.column("size").to_numpy()[order], table.column("side").to_numpy()[order], key[0].as_py() >> 32, k)
        return pa.table({"src": node[order][child], "dst": node[order][root]})

    return nodes.select("node", "hi", "lo", "size").mapInArrow(to_cells, _CELLS).groupBy("cell", "tile").applyInArrow(search, "src long, dst long")


def heads(codes: int) -> int:
    """Bits of a head, from the number of distinct codes."""
    return min(MOST_HEAD_BITS, max(HEAD_BITS, math.ceil(math.log2(max(1, codes) / CELL_CODES))))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest id of each connected component, for nodes with edges.

    Alternates the large-star and small-star steps until the edges stay the same. Each
    round is written out, so that lost executors cost one round at most."""
    pairs, before = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()), None
    while (now := pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()) != before:
        both = pairs.select("u", "v").union(pairs.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down)
        pairs, before = cut(small.distinct()), now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def groups(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, group_id, n_group) of every text that has words; a text without near
    copies is a group of its own. group_id is the group's smallest doc_id and n_group
    its number of doc_ids.

    Null ids and null, empty or wordless texts have no row. Repeated rows are one; a
    doc_id with several texts has a row for each group that one of them is in. Other
    columns are not looked at. Runs the jobs that find the groups when it is called."""
    prints = cut(with_fingerprint(docs))
    nodes = cut(prints.groupBy("hi", "lo", "size").agg(F.min("doc_id").alias("least")))
    # ids by place in what was just written: the same whenever it is read again
    nodes = nodes.withColumn("node", F.monotonically_increasing_id())
    roots = components(near_edges(nodes, k, heads(nodes.count())))
    named = cut(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    smallest = named.groupBy("root").agg(F.min("least").alias("group_id"))
    members = prints.join(named.join(smallest, "root").select("hi", "lo", "size", "group_id"), ["hi", "lo", "size"]).select("group_id", "doc_id").distinct()
    sizes = members.groupBy("group_id").agg(F.count("*").alias("n_group"))
    return members.join(sizes, "group_id").select("doc_id", "group_id", "n_group")


def keep_one(docs: DataFrame, k: int = K) -> DataFrame:
    """The rows of docs without those whose doc_id is in a group (see ``groups``) with a
    smaller one. Texts without words and null ids stay; rows of one doc_id stand or
    fall together. The columns are those of docs, whatever their names."""
    name = fresh_names(docs, "dropped")[0]
    extra = cut(groups(docs, k).where("doc_id <> group_id").select(F.col("doc_id").alias(name)).distinct())
    if extra.count() <= BROADCAST_ROWS:
        extra = F.broadcast(extra)
    return docs.join(extra, F.col("doc_id").cast("long") == F.col(name), "left_anti")
