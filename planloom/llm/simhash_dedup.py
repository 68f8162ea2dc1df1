"""SimHash near-duplicates: a self-join of binary tries.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of
a text's 3-word shingles.  Two fingerprints link at ``radius`` or fewer differing
bits.  The join walks pairs of trie nodes from the root, adds a bit to a pair's
error whenever it takes different branches, and prunes the pair once the error
exceeds the budget for its depth.

*Budgets.*  Cut the ring of 64 bits into m blocks.  If two fingerprints differ in at
most R bits, one rotation has at most l * R / m errors in its first l blocks, for
every l.  So the tries of all m rotations are walked with these budgets, and together
the walks find every link.  ``CLOSE`` (R = 3, two blocks) gives 1 error in the first
32 bits and 3 in all; ``WIDE`` (R = 15, sixteen blocks) none in the first 4 bits, 1 in
8, 2 in 12 and so on.

*Similar texts.*  ``keep_first`` groups texts whose sets of 5-word shingles have a
similarity of 0.8 or more.  At that similarity two fingerprints differ in 9.4 bits
with a deviation of 2.8, so ``WIDE`` misses 16 of 1000 such pairs; ``FINGERPRINTS`` (2)
independent fingerprints are joined, and both miss 3 of 10,000.  The links only say
which texts are compared: all those that they connect meet with their whole sets, and
only pairs that have the similarity connect anything (``similar_texts``).

*Distribution.*  The upper trie is cut into nodes of bounded count (a node with too
many fingerprints is replaced by its children 4 bits further down).  A fingerprint
belongs to its own node and visits the nodes that the budgets allow it to reach, from the
lower to the higher of each pair, so every pair of fingerprints meets in one task,
which holds one node at a time.  The counts that place the cut are the only thing
the driver sees, at most ``PARTS`` per level and rotation.

*Hot groups.*  Equal fingerprints are one fingerprint.  Within a task, pairs of
nodes whose leaves are all known to be connected are skipped, and only a spanning
forest leaves the task, so a group of near copies costs neither all its pairs in
output nor in time.  Where links must be verified, the forest has the same connected
groups as all links, so no two texts that link are parted; the pairs of a group are
compared within a task, and again only a spanning forest of those that pass leaves it.

Defined cases: a text without words (null, empty or blanks only) has fingerprint
0 and links like any other; repeated rows are linked; rows without an id get a
fingerprint, and the component of that fingerprint, but are no members; ids must cast
to a long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm import similar_texts
from planloom.llm.components import components
from planloom.llm.tables import settled, whole_text

SHINGLE, SEED = 3, 42
#: The cut aims at PARTS nodes of LEAST fingerprints or more.
PARTS, LEAST = 4096, 256
#: Fingerprints of one text that are joined where links are verified.
FINGERPRINTS = 2


@dataclass(frozen=True)
class Shape:
    """Radius, blocks of the ring, depths at which the trie may be cut and the least count to cut at."""

    radius: int
    blocks: int
    depths: tuple[int, ...]
    least: int = LEAST

    def budget(self, depth: int) -> int:
        """Errors that a pair may have after the bit at this depth."""
        return (depth * self.blocks // 64 + 1) * self.radius // self.blocks

    def turned(self, fps: np.ndarray, turn: int) -> np.ndarray:
        """Rotated to the left by so many blocks."""
        left = np.uint64(turn % self.blocks * (64 // self.blocks))
        return (fps << left) | (fps >> (np.uint64(64) - left)) if left else fps

    def masks(self, depth: int) -> list[tuple[int, int]]:
        """(errors, place of the last) of all errors that a pair may have in the first bits, as masks of 64 bits."""
        found = [(0, -1, 0)]
        for bit in range(depth):
            found += [(mask | 1 << (63 - bit), bit, n + 1) for mask, _, n in found if n < self.budget(bit)]
        return [(mask, last) for mask, last, n in found if n]


CLOSE = Shape(3, 2, (8, 12, 16, 20, 24, 28, 32))
WIDE = Shape(15, 16, (4, 8, 12), 1 << 20)
#: Pairs of nodes with so few pairs of leaves are compared leaf by leaf; node pairs walked at once; leaf pairs compared at once; rows of whole nodes held at once.
FEW_LEAVES, WALKED, COMPARED, HELD = 64, 1 << 18, 1 << 20, 1 << 18
#: Near leaf pairs that are tested and linked at once, of a hot group only the first are still apart; edges that leave a task at once.
TESTED, EDGES = 1 << 15, 1 << 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The hashes of all runs of ``size`` words, of the whole sequence if it is shorter."""
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths)
    size = min(size, len(words))
    hashes = xxhash.xxh64_intdigest
    first, last = (ends - lengths)[: len(words) - size + 1].tolist(), (ends - 1)[size - 1 :].tolist()
    return np.fromiter([hashes(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], dtype=np.uint64, count=len(first))


def majority(h: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big")


def fingerprint(text: bytes) -> int:
    """The SimHash of one text in UTF-8."""
    words = text.translate(_LOWER).split()
    return majority(shingle_hashes(words)) if words else 0


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp), fp as a signed long."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")).mapInArrow(hashed, "id bigint, fp bigint")


# --- the cut of the upper trie ---


class Cut:
    """Which nodes of the trie are divided further: sorted prefixes by (turn, depth)."""

    def __init__(self, heavy: dict[tuple[int, int], np.ndarray], shape: Shape = CLOSE):
        self.heavy, self.shape = heavy, shape

    def depth(self, fps: np.ndarray, turn: int) -> np.ndarray:
        depths = self.shape.depths
        out = np.full(len(fps), depths[0], dtype=np.int64)
        for depth, further in zip(depths, depths[1:], strict=False):
            heavy = self.heavy.get((turn, depth))
            if heavy is None or not len(heavy):
                break
            out[(out == depth) & np.isin(fps >> np.uint64(64 - depth), heavy)] = further
        return out

    def deepest(self, turn: int) -> int:
        depths = self.shape.depths
        return max([depths[0], *(further for depth, further in zip(depths, depths[1:], strict=False) if len(self.heavy.get((turn, depth), ())))])

    def node(self, fps: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        depth = self.depth(fps, turn)
        prefix = (fps >> (np.uint64(64) - depth.astype(np.uint64))).astype(np.int64)
        return (np.int64(turn) << np.int64(44)) + (depth << 36) + prefix, depth


def place_cut(distinct: DataFrame, shape: Shape = CLOSE, columns: tuple[str, ...] = ("fp",)) -> Cut:
    """Count downwards from the top, following only the nodes that hold too many."""
    n = distinct.count()
    most = max(shape.least, n // PARTS)
    step = 64 // shape.blocks
    rotations = []
    for t in range(shape.blocks * len(columns)):
        fp, left = F.col(columns[t // shape.blocks]), t % shape.blocks * step
        rotations.append(F.struct(F.lit(t).alias("turn"), (F.shiftleft(fp, left).bitwiseOR(F.shiftrightunsigned(fp, 64 - left)) if left else fp).alias("fp")))
    rows = distinct.select(F.explode(F.array(*rotations)).alias("x")).select("x.*")
    heavy: dict[tuple[int, int], np.ndarray] = {}
    for depth in shape.depths[:-1]:
        counts = rows.groupBy("turn", F.shiftrightunsigned("fp", 64 - depth).alias("prefix")).count().where(F.col("count") > most)
        found = counts.select("turn", "prefix").collect()  # at most PARTS rows for each rotation
        if not found:
            break
        for turn in range(len(rotations)):
            heavy[turn, depth] = np.array(sorted(r["prefix"] for r in found if r["turn"] == turn), dtype=np.uint64)
        kept = distinct.sparkSession.createDataFrame([(r["turn"], r["prefix"]) for r in found], "t int, p bigint")
        rows = rows.join(F.broadcast(kept), (F.col("turn") == F.col("t")) & (F.shiftrightunsigned("fp", 64 - depth) == F.col("p")), "left_semi")
    return Cut(heavy, shape)


def dealt(fps: np.ndarray, cut: Cut, nth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(node, rotated fingerprint, place, at home) for the own node and the higher nodes within the budgets, of the nth fingerprint."""
    for turn in range(nth * cut.shape.blocks, (nth + 1) * cut.shape.blocks):
        own = cut.shape.turned(fps, turn)
        home, _ = cut.node(own, turn)
        yield home, own, np.arange(len(own)), np.ones(len(own), dtype=bool)
        for mask, last in cut.shape.masks(cut.deepest(turn)):
            near, depth = cut.node(own ^ np.uint64(mask), turn)
            goes = np.flatnonzero((last < depth) & (near > home))
            if len(goes):
                yield near[goes], own[goes], goes, np.zeros(len(goes), dtype=bool)


# --- the walk ---


class Forest:
    """Union-find over 0 .. n-1 whose roots are the least members."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Join the pairs; places of the pairs that joined two trees, one for each joining."""
        used = []
        while True:
            x, y = self.parent[a], self.parent[b]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                return np.concatenate(used) if used else apart
            high, pair = np.unique(np.maximum(x, y)[apart], return_index=True)
            self.parent[high] = np.minimum(x, y)[apart][pair]
            used.append(apart[pair])
            while True:
                up = self.parent[self.parent]
                if np.array_equal(up, self.parent):
                    break
                self.parent = up


#: Of places of pairs, which may link: what is known beyond the fingerprints.
Test = Callable[[np.ndarray, np.ndarray], np.ndarray]


def walk(node: np.ndarray, fps: np.ndarray, home: np.ndarray, owner: np.ndarray, shape: Shape = CLOSE, *, known: np.ndarray | None = None, test: Test | None = None, thin: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links of one task, as places of linked pairs.

    ``owner`` says which places are one fingerprint (in several nodes) and ``known`` which
    component an owner is already in.  Thinned, a spanning forest of the links; else all
    links between different components.
    """
    order = np.lexsort((fps, ~home, node))
    node, fps, home = node[order], fps[order], home[order]
    n = len(fps)
    which = np.unique(owner[order], return_inverse=True)[1]
    forest = Forest(int(which.max(initial=-1)) + 1)
    if known is not None:
        _, first, same = np.unique(known[order], return_index=True, return_inverse=True)
        forest.link(which, which[first][same])
    starts = np.flatnonzero(np.r_[n > 0, np.diff(node) != 0]) if n else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], n].astype(np.int64) if n else starts
    homes = np.r_[0, np.cumsum(home)]
    middle = starts + homes[ends] - homes[starts]
    some = middle > starts
    own, guests = some, some & (ends > middle)
    a = np.r_[np.stack([starts, middle], 1)[guests], np.stack([starts, middle], 1)[own]]
    b = np.r_[np.stack([middle, ends], 1)[guests], np.stack([starts, middle], 1)[own]]
    ones: dict[int, np.ndarray] = {}
    changes = None
    stack = [(0, a, b, np.zeros(len(a), dtype=np.int64))]
    while stack:
        depth, a, b, errors = stack.pop()
        if len(a) > WALKED:
            half = len(a) // 2
            stack += [(depth, a[:half], b[:half], errors[:half]), (depth, a[half:], b[half:], errors[half:])]
            continue
        if changes is None:
            label = forest.parent[which]
            changes = np.r_[0, np.cumsum(label[1:] != label[:-1])] if n else np.zeros(0, np.int64)
        if len(a):
            joined = (changes[a[:, 0]] == changes[a[:, 1] - 1]) & (changes[b[:, 0]] == changes[b[:, 1] - 1]) & (label[a[:, 0]] == label[b[:, 0]])
            a, b, errors = a[~joined], b[~joined], errors[~joined]
        few = (a[:, 1] - a[:, 0]) * (b[:, 1] - b[:, 0]) <= FEW_LEAVES if depth < 64 else np.ones(len(a), dtype=bool)
        for x, y in _near_leaves(fps, a[few], b[few], shape.radius):
            apart = forest.parent[which[x]] != forest.parent[which[y]]
            x, y = x[apart], y[apart]
            if test is not None and len(x):
                passed = test(order[x], order[y])
                x, y = x[passed], y[passed]
            if thin:
                used = forest.link(which[x], which[y])
                x, y = x[used], y[used]
                changes = None if len(used) else changes
            if len(x):
                yield order[x], order[y]
        a, b, errors = a[~few], b[~few], errors[~few]
        if not len(a):
            continue
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((fps >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)]
        count = ones[depth]
        cut_a, cut_b = a[:, 1] - count[a[:, 1]] + count[a[:, 0]], b[:, 1] - count[b[:, 1]] + count[b[:, 0]]
        zero_a, one_a = np.stack([a[:, 0], cut_a], 1), np.stack([cut_a, a[:, 1]], 1)
        zero_b, one_b = np.stack([b[:, 0], cut_b], 1), np.stack([cut_b, b[:, 1]], 1)
        other, same = errors + 1 <= shape.budget(depth), a[:, 0] == b[:, 0]
        back = other & ~same  # of a node with itself, one order is enough
        far = (np.r_[zero_a[other], one_a[back]], np.r_[one_b[other], zero_b[back]], np.r_[errors[other], errors[back]] + 1)
        near = (np.r_[zero_a, one_a], np.r_[zero_b, one_b], np.r_[errors, errors])
        for x, y, e in (far, near):  # the nearer pairs are walked first
            full = (x[:, 1] > x[:, 0]) & (y[:, 1] > y[:, 0])
            if full.any():
                stack.append((depth + 1, x[full], y[full], e[full]))


def _near_leaves(fps: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of leaves within the radius, at most ``TESTED`` at a time."""
    for x, y in _leaf_pairs(a, b):
        near = np.flatnonzero(np.bitwise_count(fps[x] ^ fps[y]) <= radius)
        for at in range(0, len(near), TESTED):
            yield x[near[at : at + TESTED]], y[near[at : at + TESTED]]


def _leaf_pairs(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of leaves under these pairs of nodes, of a node with itself once; about ``COMPARED`` at a time."""
    wide = b[:, 1] - b[:, 0]
    long = np.flatnonzero((a[:, 1] - a[:, 0]) * wide > COMPARED)
    for i in long:
        step = max(1, COMPARED // int(wide[i]))
        for at in range(int(a[i, 0]), int(a[i, 1]), step):
            yield from _pairs(np.array([[at, min(at + step, a[i, 1])]]), b[i : i + 1])
    a, b = np.delete(a, long, axis=0), np.delete(b, long, axis=0)
    made = np.cumsum((a[:, 1] - a[:, 0]) * (b[:, 1] - b[:, 0]))
    cuts = np.searchsorted(made, np.arange(0, made[-1] if len(made) else 0, COMPARED), side="right")
    for start, end in zip(cuts, np.r_[cuts[1:], len(a)].astype(np.int64), strict=False):
        if end > start:
            yield from _pairs(a[start:end], b[start:end])


def _pairs(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    wide = b[:, 1] - b[:, 0]
    pairs = (a[:, 1] - a[:, 0]) * wide
    which = np.repeat(np.arange(len(a)), pairs)
    at = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    x, y = a[which, 0] + at // wide[which], b[which, 0] + at % wide[which]
    once = x < y
    yield x[once], y[once]


def whole_nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a partition that is sorted by ``node``, about ``HELD`` at a time, never a part of a node."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0)
        if held and rows >= HELD:
            last = held[-1].column(0)[-1]
            same = int(np.searchsorted(node.to_numpy(), last.as_py(), side="right"))
            if same < batch.num_rows:
                yield pa.Table.from_batches([*held, batch.slice(0, same)])
                held, rows, batch = [], 0, batch.slice(same)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def links(distinct: DataFrame, shape: Shape = CLOSE) -> DataFrame:
    """Spanning edges (u, v) between ids of ``distinct`` (fp, id) whose fingerprints link."""
    cut = place_cut(distinct, shape)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, fp, place, home in dealt(batch.column(0).to_numpy().view(np.uint64), cut):
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(fp.view(np.int64)), batch.column(1).take(pa.array(place)), pa.array(home)], names=["node", "fp", "id", "home"])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in whole_nodes(batches):
            node, fps, ids, home = (met.column(i).to_numpy() for i in range(4))
            for u, v in walk(node, fps.view(np.uint64), home.astype(bool), ids, shape):
                yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"])

    rows = distinct.select("fp", "id").mapInArrow(deal, "node bigint, fp bigint, id bigint, home boolean")
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(join, "u bigint, v bigint")


def near_duplicates(df: DataFrame, shape: Shape = CLOSE, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp, component): every row, its fingerprint and the least id it can reach."""
    rows = settled(fingerprints(df, id_col=id_col, text_col=text_col))
    distinct = settled(rows.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("id")))
    labels = components(links(distinct, shape))
    known = distinct.join(labels, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component"))
    return rows.join(settled(known), "fp", "left").select("id", "fp", "component").withColumnRenamed("id", id_col)


# --- groups of similar texts ---


def similar_links(nodes: DataFrame, cut: Cut) -> DataFrame:
    """Pairs (u, v) of ``nodes`` (node, n, sketch, fp0, fp1 ...): a spanning forest, in every task, of those that may reach the similarity.

    Some fingerprint of the two links, and sizes and sketches allow it.
    """
    shape = cut.shape
    names = [f"fp{i}" for i in range(FINGERPRINTS)]
    carried = ["at", "fp", "home", "node", "n", "sketch"]

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nth in range(FINGERPRINTS):
                for at, fp, place, home in dealt(batch.column(nth).to_numpy().view(np.uint64), cut, nth):
                    own = [batch.column(FINGERPRINTS + i).take(pa.array(place)) for i in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(fp.view(np.int64)), pa.array(home), *own], names=carried)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in whole_nodes(batches):
            at, fps, home, node, n = (met.column(c).to_numpy() for c in ("at", "fp", "home", "node", "n"))
            test = similar_texts.may_reach(n.astype(np.int64), similar_texts.sketches(met.column("sketch")))
            for u, v in walk(at, fps.view(np.uint64), home.astype(bool), node, shape, test=test):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[u], node[v])), pa.array(np.maximum(node[u], node[v]))], names=["u", "v"])

    rows = nodes.select(*names, "node", "n", "sketch").mapInArrow(deal, "at bigint, fp bigint, home boolean, node bigint, n int, sketch binary")
    return rows.repartition("at").sortWithinPartitions("at").mapInArrow(join, "u bigint, v bigint").distinct()


def similar_edges(groups: DataFrame, texts: DataFrame, owners: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes that have the similarity: they connect what all such pairs within the groups (node, component) connect."""

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for nodes, sets in similar_texts.whole_groups(batches):
            forest = Forest(len(nodes))
            for x, y in similar_texts.similar_pairs(sets):
                used = forest.link(x, y)
                found.append((nodes[x[used]], nodes[y[used]]))
                rows += len(used)
            if rows >= EDGES:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*found, strict=True)], names=["u", "v"])
                found, rows = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*found, strict=True)], names=["u", "v"])

    return similar_texts.together(groups, texts, owners).mapInArrow(join, "u bigint, v bigint")


def first_of_groups(texts: DataFrame, shape: Shape = WIDE) -> DataFrame:
    """Of texts (id, mark, text), mark a hash of the text: (id, mark) of the first of each group of similar texts."""
    names = [f"fp{i}" for i in range(FINGERPRINTS)]

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sizes, sketches, fps = [], [], [], []
            for data in batch.column(2).cast(pa.binary()).to_pylist():
                words = similar_texts.word_hashes(data)
                found = similar_texts.shingle_set(words)
                h = similar_texts.distinct(similar_texts.runs(words, SHINGLE))
                node.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                sketches.append(similar_texts.sketch(found))
                own = [majority(x) for x in similar_texts.further_hashes(h, FINGERPRINTS + similar_texts.SIGNS)]
                fps.append(own[:FINGERPRINTS])
                sketches[-1] += np.array(own[FINGERPRINTS:], dtype=np.uint64).tobytes()
            fps = np.array(fps, dtype=np.uint64).reshape(-1, FINGERPRINTS).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), *(pa.array(fps[:, i].copy()) for i in range(FINGERPRINTS))], names=["id", "mark", "node", "n", "sketch", *names])

    found = texts.select("id", "mark", "text").mapInArrow(parse, "id bigint, mark bigint, node bigint, n int, sketch binary, " + ", ".join(f"{x} bigint" for x in names))
    unique = settled(found.groupBy("node").agg(F.min(F.struct("id", "mark", "n", "sketch", *names)).alias("m")).select("node", "m.*"))
    owners = unique.select("node", "id", "mark", "n")
    pairs = settled(similar_links(unique, place_cut(unique, shape, tuple(names))))
    if pairs.isEmpty():
        return owners.select("id", "mark")
    linked = components(pairs)
    linked = linked.unionByName(linked.select(F.col("component").alias("node"), "component").distinct())
    labels = components(similar_edges(linked, texts, owners))
    groups = owners.join(labels, "node", "left").groupBy(F.coalesce("component", "node").alias("component"))
    return groups.agg(F.min(F.struct("id", "mark")).alias("m")).select("m.*")


def keep_first(df: DataFrame, shape: Shape | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts: that with the least id.

    Rows without an id stay; of different texts with one id each stands for itself.
    With a shape the groups are those of ``near_duplicates``, by fingerprints alone.
    """
    if shape is not None:
        found = near_duplicates(df, shape, id_col=id_col, text_col=text_col)
        kept = found.where(F.col(id_col) == F.col("component")).select(id_col).distinct()
        return df.join(kept, id_col, "left_semi").dropDuplicates([id_col]).unionByName(df.where(F.col(id_col).isNull()))
    mark = F.xxhash64(whole_text(text_col))
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), mark.alias("mark"), whole_text(text_col).alias("text"))
    first = settled(first_of_groups(texts)).withColumnsRenamed({"id": "first_id", "mark": "first_mark"})
    rows = df.withColumn("row_mark", mark)
    kept = rows.join(first, (F.col(id_col).cast("long") == F.col("first_id")) & (F.col("row_mark") == F.col("first_mark")), "left_semi")
    return kept.dropDuplicates([id_col, "row_mark"]).drop("row_mark").unionByName(df.where(F.col(id_col).isNull()))
