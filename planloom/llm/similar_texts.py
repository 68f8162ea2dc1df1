"""Similarity of texts by their sets of 5-word shingles, shared over united: 0.8 or more.

``sketch`` is a small summary that can only rule a pair out, ``similar_pairs`` compares whole
sets.  Which sets are compared is the matter of ``simhash_dedup``; ``together`` brings them
into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.tables import settled

WORDS, SEED = 5, 42
#: The similarity as a fraction.
SHARED, OF = 4, 5
#: Bits of a sketch; bytes of a text that are hashed at once.
SKETCH, PIECE = 256, 1 << 20
#: Further fingerprints of a sketch, and the bits in which all of them may differ: at the similarity
#: 128 bits differ in 18.9 with a deviation of 4, unrelated texts in 64 with a deviation of 5.7.
SIGNS, FAR = 2, 45
#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 100_000
#: Shingles of a group that are compared in one task, a larger group is cut into blocks of half as many; texts cut into shingles at once.
TOGETHER, CUT = 1 << 20, 256
#: So few sets are compared pair by pair; pairs counted at once.
FEW_SETS, COUNTED = 8, 1 << 18

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.array([b in b" \t\n\v\f\r" for b in range(256)])
_BYTE = np.random.default_rng(SEED).integers(0, 2**64, 256, dtype=np.uint64)
#: Odd, with its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(PIECE - 1, base, dtype=np.uint64)])


_POWERS: list[np.ndarray] = []


def _piece(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of a piece: polynomials of their bytes, from one running sum."""
    blank = _BLANK[data]
    edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    if not _POWERS:
        _POWERS.extend((_powers(_BASE), _powers(_BACK)))
    up, down = _POWERS
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of every lower-cased word of a text in UTF-8, in order."""
    low = data.translate(_LOWER) if data.isascii() else data.decode("utf-8", "surrogateescape").lower().encode("utf-8", "surrogateescape")
    whole = np.frombuffer(low, dtype=np.uint8)
    if len(whole) <= PIECE:
        return _piece(whole)
    parts, at = [], 0
    while at < len(whole):
        end = min(at + PIECE, len(whole))
        blanks = np.flatnonzero(_BLANK[whole[at:end]]) if end < len(whole) else ()
        if len(blanks):
            end = at + int(blanks[-1]) + 1
        elif end < len(whole):  # a word longer than a piece
            later = np.flatnonzero(_BLANK[whole[end:]])
            end = end + int(later[0]) if len(later) else len(whole)
            word = low[at:end].split()[0]
            parts.append(np.array([xxhash.xxh64_intdigest(word, SEED)], dtype=np.uint64))
            at = end
            continue
        parts.append(_piece(whole[at:end]))
        at = end
    return np.concatenate(parts)


def distinct(h: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) > 1 else h


_TURNS = np.random.default_rng(SEED + 1).integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` (at most ``WORDS``) words from the hashes of the words; of all words if they are fewer."""
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    h = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        h += hashes[i : i + n] * _TURNS[i]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted hashes of the 5-word shingles, of all words if they are fewer (one shingle)."""
    return distinct(runs(hashes, WORDS))


def sketch(found: np.ndarray) -> bytes:
    """For each bit, whether an odd number of shingles falls on it."""
    return np.packbits((np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def further_hashes(h: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The hashes themselves and n - 1 further hashes of each."""
    yield h
    for i in range(1, n):
        x = h * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64))
        x ^= x >> np.uint64(29)
        yield x * np.uint64(0xBF58476D1CE4E5B9)


def sketches(column: pa.ChunkedArray) -> np.ndarray:
    """A column of sketches as rows of 64-bit words."""
    parts = []
    for chunk in column.chunks:
        ends = np.frombuffer(chunk.buffers()[1], dtype=np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        parts.append(np.frombuffer(chunk.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(parts).view(np.uint64).reshape(-1, SKETCH // 64 + SIGNS)


def may_reach(sizes: np.ndarray, bits: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A test of pairs that rules out none that reaches the similarity.

    Sets differ in at least as many shingles as their sketches in bits, and the
    similarity allows a ninth of both sizes.  Further fingerprints rule out unrelated long
    texts; that they should differ in more than ``FAR`` bits at the similarity is
    over six deviations away.
    """

    def test(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = sizes[x], sizes[y]
        passed = np.minimum(a, b) * OF >= np.maximum(a, b) * SHARED
        some = np.flatnonzero(passed)
        differ = np.bitwise_count(bits[x[some]] ^ bits[y[some]])
        odd, signs = differ[:, : SKETCH // 64].sum(axis=1, dtype=np.int64), differ[:, SKETCH // 64 :].sum(axis=1, dtype=np.int64)
        passed[some] = ((OF + SHARED) * odd <= (OF - SHARED) * (a[some] + b[some])) & (signs <= FAR)
        return passed

    return test


def reaches(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes that share so many shingles have the similarity."""
    return (OF + SHARED) * shared >= SHARED * (a + b)


def similar_pairs(sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places, the lower first, of sets that have the similarity; some pairs at a time.

    Every pair of sets is counted: shingles that many sets hold by a product of matrices,
    others by the list of their sets.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets], dtype=np.int64)
    if n <= FEW_SETS:
        for y in range(1, n):
            shared = np.array([len(sets[x]) + len(sets[y]) - len(distinct(np.concatenate([sets[x], sets[y]]))) for x in range(y)])
            x = np.flatnonzero(reaches(shared, sizes[:y], sizes[y]))
            yield x, np.full(len(x), y)
        return
    _, column, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, holders = np.repeat(np.arange(n), sizes), holders[column]
    many = 8 * holders > n
    names, place = np.unique(column[many & (holders > 1)], return_inverse=True)
    matrix = np.zeros((n, len(names)), dtype=np.float32)
    matrix[row[many & (holders > 1)], place] = 1
    few = np.flatnonzero(~many & (holders > 1))
    row, column, holders = row[few], column[few], holders[few]
    order = np.argsort(column, kind="stable")
    listed = row[order]  # the sets of each shingle, one shingle after another
    start = np.searchsorted(column[order], column)
    step = max(1, COUNTED // n)
    for at in range(0, n, step):
        end = min(at + step, n)
        counts = (matrix[at:end] @ matrix.T).astype(np.int64).reshape(-1)
        i, last = np.searchsorted(row, [at, end])
        made = np.cumsum(holders[i:last])
        while i < last:
            k = len(made) - (last - i)
            j = max(i + 1, i + int(np.searchsorted(made[k:], COUNTED + (made[k - 1] if k else 0), side="right")))
            wide = holders[i:j]
            own = np.repeat(np.arange(i, j), wide)
            near = listed[start[own] + np.arange(len(own)) - np.repeat(np.cumsum(wide) - wide, wide)]
            counts += np.bincount((row[own] - at) * n + near, minlength=len(counts))
            i = j
        x, y = np.nonzero(reaches(counts.reshape(-1, n), sizes[at:end, None], sizes))
        x += at
        yield x[x < y], y[x < y]


def together(groups: DataFrame, texts: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows (at, node, s) in tasks sorted by ``at``: the sets of all nodes of groups (node, component).

    A group of at most ``TOGETHER`` shingles has one ``at``.  A larger one is cut into blocks,
    and every two blocks have one, so that every two sets of a group meet.  Only texts of
    these nodes are cut into shingles; ``owners`` has their (node, id, mark, n).
    """
    asked = settled(groups.join(owners, "node"))
    large = settled(asked.groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") > TOGETHER).select("component", F.ceil(F.col("n") * 2 / TOGETHER).cast("int").alias("blocks")))
    asked = asked.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "component", "left").select("id", "mark", "node", "component", "blocks")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked.hint("merge")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CUT):
                batch = whole.slice(at, CUT)
                found = [shingle_set(word_hashes(data)).view(np.int64) for data in batch.column(3).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["node", "component", "blocks", "s"])

    found = texts.join(asked, ["id", "mark"]).select("node", "component", "blocks", "text")
    sets = found.mapInArrow(cut, "node bigint, component bigint, blocks int, s array<bigint>").dropDuplicates(["node"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != own)
    meets = F.transform(others, lambda j: F.xxhash64("component", F.least(own, j), F.greatest(own, j)))
    at = F.explode(F.when(F.col("blocks").isNull(), F.array(F.xxhash64("component"))).otherwise(meets))
    return sets.select(at.alias("at"), "node", "s").repartition("at").sortWithinPartitions("at")


def whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(nodes, sets) of one ``at`` after another, of rows (at, node, s) sorted by it."""
    nodes: list[np.ndarray] = []
    sets: list[np.ndarray] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at, node = (batch.column(i).to_numpy() for i in range(2))
        values, ends = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]).tolist()
        for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
            if sets and at[a] != last:
                yield np.concatenate(nodes), sets
                nodes, sets = [], []
            last = at[a]
            nodes.append(node[a:b])
            sets += [values[ends[i] : ends[i + 1]] for i in range(a, b)]
    if sets:
        yield np.concatenate(nodes), sets
