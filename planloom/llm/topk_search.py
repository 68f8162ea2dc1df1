"""Exact top-k search over an impact-ordered, score-at-a-time index.

Every component x becomes the integer floor(1024 * x).  A first
pass scores the heads of the strongest posting segments exactly: the rows whose strongest
component has the same dimension and sign are dealt into ``HEAD_PARTS`` parts, and of each
part the ``HEAD`` rows of the highest impact are taken.  Each query's k-th best score there, its bar, is a lower bound of the k-th best
score over all rows, and every block starts with it.  The heads decide nothing else.

In the second pass all candidates are dealt into blocks of about ``BLOCK`` rows and the
queries into blocks of the same size; each (candidate block, query block) pair meets in
one task, so memory per task is fixed and no all-pairs join exists.  In a task:

1. The block is indexed: for every quantised impact (sign and level of a
   component) and dimension, a posting segment lists the rows that have it.
2. Segments are processed by descending impact; a segment adds one vector, the
   impact times the queries' components, to the accumulators of its rows.
3. After a level, the part of each row that is unprocessed or lost by quantising
   has a known norm; times the query's norm it bounds what the score can still
   change by.  A row whose upper bound is under the query's bar, or under the k-th best
   lower bound of the block, cannot be a member.  A query stops when that proof leaves
   few rows, or at the end.
4. All possible members are scored exactly in integers.

The blocks' winners (k for each query and block) are merged by rank.

Defined cases: vectors that are null, or hold a null or non-finite component,
take no part, neither as query nor as candidate; vectors of unequal length are
padded with zeros; a query never meets rows of its own id, so repeated ids
do not find each other; ties go to the smaller id; an empty table gives
an empty result; other columns are ignored.  Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate block, rows of a query block, queries scored at once.
BLOCK, QUERY_BLOCK, BATCH = 4096, 4096, 128
#: Levels of quantised impact.
LEVELS = 32
#: Shares of the squared norms still unprocessed at which a proof is tried.
TRY_AT = (0.06, 0.04, 0.03, 0.02, 0.012)
#: A proof that leaves at most this share of a block possible stops a query.
FEW = 0.05
#: Parts of a posting segment, and rows of a part's head in the first pass, which makes lower bounds only.
HEAD_PARTS, HEAD = 8, 8
#: Under any score: no bar is known.
NO_BAR = -(1 << 62)


class ImpactIndex:
    """Posting segments of one candidate block, in descending order of impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        size = np.abs(self.vectors)
        self.step = int(size.max(initial=0)) // levels + 1
        level = size // self.step
        self.squares = (self.vectors.astype(np.float64) ** 2).sum(axis=1)
        self.segments: list[tuple[list[tuple[int, float, np.ndarray]], np.ndarray]] = []
        for at in range(int(level.max(initial=0)), -1, -1):
            impact = (at + 0.5) * self.step
            posted, gone = [], np.zeros(len(self.ids))
            rows, dims = np.nonzero(level == at)
            if at == 0:
                some = self.vectors[rows, dims] != 0
                rows, dims = rows[some], dims[some]
            values = self.vectors[rows, dims].astype(np.float64)
            np.add.at(gone, rows, values**2 - (np.abs(values) - impact) ** 2)
            key = dims * 2 + (values < 0)
            by = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(key[by]) > 0][: len(by)])
            for start, end in zip(starts, np.r_[starts[1:], len(by)][: len(starts)], strict=True):
                k = int(key[by[start]])
                posted.append((k >> 1, -impact if k & 1 else impact, rows[by[start:end]]))
            self.segments.append((posted, gone))

        #: Postings of the block times queries, and those of them that were added to a score.
        self.offered = self.processed = 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, bars: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query: its place, and the ids and scores of the block's rows that can be
        among its k best: at most k, and none that is under its bar by proof."""
        for first in range(0, len(query_ids), BATCH):
            part = slice(first, first + BATCH)
            for j, (ids, scores) in enumerate(self._batch(query_ids[part], queries[part], bars[part], k)):
                yield first + j, ids, scores

    def _batch(self, query_ids: np.ndarray, queries: np.ndarray, bars: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        q = queries.astype(np.float64)
        lengths = np.sqrt((q**2).sum(axis=1))
        starts, ends = np.searchsorted(self.ids, query_ids, "left"), np.searchsorted(self.ids, query_ids, "right")
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
        going, acc = np.arange(len(q)), np.zeros((len(self.ids), len(q)))
        left, whole = self.squares.copy(), max(self.squares.sum(), 1.0)
        tries = [t * whole for t in TRY_AT]
        self.offered += len(q) * sum(len(rows) for posted, _ in self.segments for _, _, rows in posted)
        for at, (posted, gone) in enumerate(self.segments):
            weights = q[going]
            for dim, impact, rows in posted:
                acc[rows] += impact * weights[:, dim]
                self.processed += len(rows) * len(going)
            left -= gone
            last = at == len(self.segments) - 1
            if not last and not (tries and left.sum() <= tries[0]):
                continue
            while tries and left.sum() <= tries[0]:
                tries.pop(0)
            slack = np.sqrt(np.maximum(left, 0))[:, None] * lengths[going][None, :] * (1 + 1e-9) + 1e-6 * (1 + np.abs(acc))
            lower = acc - slack
            for j, mine in enumerate(going):
                lower[starts[mine] : ends[mine], j] = -np.inf
            bar = bars[going].astype(np.float64)
            if len(lower) > k:
                bar = np.maximum(bar, np.partition(lower, len(lower) - k, axis=0)[len(lower) - k])
            possible = acc + slack >= bar[None, :]
            for j, mine in enumerate(going):
                possible[starts[mine] : ends[mine], j] = False
            settled = (possible.mean(axis=0) <= FEW) | last
            for j in np.flatnonzero(settled):
                rows = np.flatnonzero(possible[:, j])
                scores = self.vectors[rows] @ queries[going[j]]
                best = np.lexsort((self.ids[rows], -scores))[:k]
                found[going[j]] = self.ids[rows[best]], scores[best]
            going, acc = going[~settled], acc[:, ~settled]
            if not len(going):
                break
        return found


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    at = 0
    for chunk in column.chunks:
        flat = chunk.flatten().to_numpy(zero_copy_only=False)
        lengths = np.diff(chunk.offsets.to_numpy())
        rows = np.repeat(np.arange(at, at + len(chunk)), lengths)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        at += len(chunk)
    return out


def top_k(df: DataFrame, is_query: Column, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k highest scores over all other rows."""
    sound = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & sound)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * 1024).cast("long")))
    n, n_queries, width = rows.agg(F.count(F.lit(1)), F.count_if("q"), F.max(F.size("v"))).first()
    parts = max(1, -(-n_queries // QUERY_BLOCK))

    def dealt(column: str, count: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def search(met: pa.Table) -> pa.Table:
        asks = met.column("asks").to_numpy()
        ids = met.column("id").to_numpy()
        bars = met.column("bar").to_numpy()
        widths = [int(np.diff(c.offsets.to_numpy()).max(initial=0)) for c in met.column("v").chunks]
        vectors = _matrix(met.column("v"), max([0, *widths]))
        out: list[list] = [[], [], []]
        if asks.any() and not asks.all():
            index = ImpactIndex(ids[~asks], vectors[~asks])
            query_ids = ids[asks]
            for j, found, scores in index.search(query_ids, vectors[asks], bars[asks], k):
                out[0].append(np.full(len(found), query_ids[j]))
                out[1].append(found)
                out[2].append(scores)
        flat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]
        return pa.table({"query_id": flat[0], "vec_id": flat[1], "score": flat[2]})

    def best(candidates: DataFrame, count: int, queries: DataFrame) -> DataFrame:
        """The rows of rank k or better over all blocks."""
        blocks = max(1, -(-count // BLOCK))
        known = candidates.select(dealt("id", blocks, 1).alias("block"), every(parts).alias("part"), F.lit(False).alias("asks"), "id", "v", F.lit(NO_BAR).alias("bar"))
        asking = queries.select(dealt("id", parts, 2).alias("part"), every(blocks).alias("block"), F.lit(True).alias("asks"), "id", "v", "bar")
        met = known.unionByName(asking).groupBy("block", "part").applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    strongest = F.array_max(F.transform("v", lambda x, i: F.struct(F.abs(x).alias("impact"), i.alias("dim"), (x < 0).alias("minus"))))
    segment = Window.partitionBy("s.dim", "s.minus", dealt("id", HEAD_PARTS, 3)).orderBy(F.desc("s.impact"), "id")
    heads = rows.withColumn("s", strongest).withColumn("at", F.row_number().over(segment)).where(F.col("at") <= HEAD)
    queries = rows.where("q").select("id", "v")
    first = best(heads, min(n, 2 * (width or 0) * HEAD_PARTS * HEAD), queries.withColumn("bar", F.lit(NO_BAR)))
    bars = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("known"))
    barred = queries.join(bars, "id", "left").select("id", "v", F.coalesce("known", F.lit(NO_BAR)).alias("bar"))
    return best(rows, n, barred).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
