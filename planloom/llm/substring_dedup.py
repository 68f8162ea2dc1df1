"""Exact substring deduplication over all documents, by external induced suffix sorting.

A byte is removed if a string of ``LENGTH`` (100) bytes that covers it also starts
earlier: in a document with a smaller id, or earlier in the same one.

All equal strings must meet, without shipping every suffix:

1. *Anchors.*  Every window of LENGTH bytes has an anchor, the first smallest hash
   among its runs of ``GRAM`` bytes.  Equal windows have equal anchors at equal
   places; neighbouring windows mostly share theirs and form a run, in which no
   window occurs twice.  One row per run, with a hash of its bytes, goes through a
   shuffle by anchor.  Of equal runs all but the first are repeats as a whole.
2. *Segments.*  Only the first runs of anchors that have several contents need
   their text: they return to their documents and become segments of at most
   ``2 * LENGTH`` bytes or so.
3. *Shards.*  Segments are dealt by anchor and joined into texts, whose suffixes
   are sorted by induction (``induced_sort``); neighbours in that order with a
   common prefix of LENGTH or more are equal windows, and all but the first of
   them are repeats.
4. The repeated windows of a document are united and its remaining bytes hashed.

*Hot groups.*  Before the shuffle by anchor, a task combines its rows: of equal runs
in a batch of documents one represents the batch, and the others go on directly,
dealt evenly.  So a passage in a third of all documents gives one row per batch,
not per document.

Defined cases: a null text is empty; documents under LENGTH bytes lose nothing;
documents with equal ids are ordered by a hash of their texts, and rows equal
in both are one document listed more than once; a null id comes first; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.induced_sort import same_prefix_as_before, suffix_order
from planloom.llm.tables import whole_text

LENGTH, GRAM = 100, 32
#: Windows that one place can anchor.
LONGEST_RUN = LENGTH - GRAM + 1
#: Bytes of segments whose suffixes are sorted at once, more if one anchor has more.
SORTED_BYTES = 4 << 20
NO_ID = -(1 << 63)

_MIX = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def anchor_runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of each run of windows with one anchor."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    h = _MIX[np.frombuffer(data, dtype=np.uint8)]
    width, power = 1, _BASE
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = h[: len(h) - width] * power + h[width:]
            width, power = width * 2, power * power
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    # hash and place in one number: the least is the first place of the smallest hash
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span < LONGEST_RUN:
        step = min(span, LONGEST_RUN - span)
        least = np.minimum(least[step:], least[: len(least) - step])
        span += step
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    sizes = np.diff(np.r_[starts, n])
    return h[place[starts]].view(np.int64), starts, sizes


def text_mark(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) >> 33


def _occurrences(anchor: np.ndarray, content: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by anchor, content and place; which rows are the first of their content; which
    repeat that very place, as documents do that are listed more than once."""
    order = np.lexsort((places, ids, content, anchor))
    group = (anchor[order][1:] != anchor[order][:-1]) | (content[order][1:] != content[order][:-1])
    begins = np.flatnonzero(np.r_[True, group][: len(order)])
    leader = order[np.repeat(begins, np.diff(np.r_[begins, len(order)]))]
    first, again = np.zeros((2, len(order)), dtype=bool)
    first[order[begins]] = True
    again[order] = (ids[order] == ids[leader]) & (places[order] == places[leader])
    return order, first, again & ~first


def _spread(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """An even key for rows that need not meet others."""
    with np.errstate(over="ignore"):
        x = (ids.view(np.uint64) ^ (starts.astype(np.uint64) << np.uint64(40))) * _BASE
    return (x ^ (x >> np.uint64(31))).view(np.int64)


#: ``place`` is the document's mark and the start of the run; n < 0: windows known to be repeats.
_RUN = "key bigint, content bigint, id bigint, place bigint, n int"


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of windows, equal runs of one batch but once."""
    for batch in batches:
        parts, content = [], []
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            anchors, starts, sizes = anchor_runs(data)
            if len(anchors):
                parts.append((anchors, np.full(len(anchors), i), (text_mark(data) << 32) + starts, sizes))
                content += [xxhash.xxh64_intdigest(data[s:e]) - (1 << 63) for s, e in zip(starts.tolist(), (starts + sizes + LENGTH - 1).tolist(), strict=True)]
        if not parts:
            continue
        anchors, ids, places, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        contents = np.array(content, dtype=np.int64)
        _, first, again = _occurrences(anchors, contents, ids, places)
        key, n = np.where(first, anchors, _spread(ids, places)), np.where(first, sizes, -sizes)
        # rows stay in the order of their documents: they compress well
        yield pa.RecordBatch.from_arrays([*(pa.array(x[~again]) for x in (key, np.where(first, contents, 0), ids, places)), pa.array(n[~again].astype(np.int32))], names=["key", "content", "id", "place", "n"])


_CLASSIFIED = "id bigint, mark int, anchor bigint, start int, n int"


def _classify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that are repeats as a whole (n < 0), and the first run of each content of the anchors
    that have several contents; all others hold no repeat."""
    batches = list(batches)
    if not batches:
        return
    met = pa.Table.from_batches(batches)
    key, content, ids, places, n = (met.column(c).to_numpy() for c in ("key", "content", "id", "place", "n"))
    asks = np.flatnonzero(n > 0)
    order, first, again = _occurrences(key[asks], content[asks], ids[asks], places[asks])
    firsts = asks[order[first[order]]]
    differs = key[firsts][1:] != key[firsts][:-1]
    several = firsts[~(np.r_[True, differs] & np.r_[differs, True])] if len(firsts) else firsts
    whole = np.r_[asks[~first & ~again], np.flatnonzero(n < 0)]
    kept = np.r_[several, whole]
    sizes = np.r_[n[several], -np.abs(n[whole])].astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array((places[kept] >> 32).astype(np.int32)), pa.array(np.where(sizes > 0, key[kept], 0)), pa.array((places[kept] & 0xFFFFFFFF).astype(np.int32)), pa.array(sizes)], names=["id", "mark", "anchor", "start", "n"])


_SEGMENT = "key bigint, id bigint, mark int, start int, n int, segment binary"


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of the runs that need it; runs that are repeats as a whole, united, without text."""
    for batch in batches:
        rows: list[tuple] = []
        for i, mark, data, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
            united: list[list[int]] = []
            for run in sorted(runs, key=lambda r: r["start"]):
                at, n = run["start"], run["n"]
                if n > 0:
                    rows.append((run["anchor"], i, mark, at, n, data[at : at + n + LENGTH - 1]))
                elif united and at <= united[-1][1]:
                    united[-1][1] = max(united[-1][1], at - n)
                else:
                    united.append([at, at - n])
            rows += [(i ^ (start << 20), i, mark, start, end - start, None) for start, end in united]
        if rows:
            key, ids, marks, starts, sizes, texts = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ids, pa.int64()), pa.array(marks, pa.int32()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(texts, pa.binary())], names=["key", "id", "mark", "start", "n", "segment"])


def _later_windows(segments: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """Of segments in order of their owners: (segment, offsets of windows that also start earlier)."""
    sizes = np.array([len(s) for s in segments])
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    ends = np.cumsum(sizes + 1)
    data = b"\0".join(segments) + b"\0"
    text = np.frombuffer(data, dtype=np.uint8).astype(np.uint16) + 1
    text[ends - 1] = 0
    order = suffix_order(text, 257)
    which = owner[order]
    usable = ends[which] - 1 - order >= LENGTH
    order, which = order[usable], which[usable]
    # equal windows are neighbours now: all suffixes are in order
    group = np.cumsum(~same_prefix_as_before(data, order, LENGTH))
    by = np.lexsort((order, group))
    order, which, group = order[by], which[by], group[by]
    later = np.r_[False, group[1:] == group[:-1]] if len(group) else np.zeros(0, dtype=bool)
    order, which = order[later], which[later]
    by = np.argsort(which, kind="stable")
    order, which = order[by], which[by]
    cuts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else []
    return [(int(which[s]), order[s:e] - (ends[which[s]] - 1 - sizes[which[s]])) for s, e in zip(cuts, np.r_[cuts[1:], len(which)].astype(int) if len(cuts) else [], strict=True)]


_RANGE = "id bigint, mark int, start int, n int"


def _shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows as ranges of starts."""
    batches = list(batches)
    if not batches:
        return
    met = pa.Table.from_batches(batches)
    a, ids, marks, starts, sizes = (met.column(x).to_numpy().astype(np.int64) for x in ("key", "id", "mark", "start", "n"))
    texts = met.column("segment").combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    whole = np.asarray(texts.is_null())
    yield _ranges(ids[whole], marks[whole], starts[whole], sizes[whole])
    rows = np.flatnonzero(~whole)
    firsts = rows[np.lexsort((starts[rows], marks[rows], ids[rows], a[rows]))]
    repeats = np.logical_and.reduce([x[firsts][1:] == x[firsts][:-1] for x in (a, ids, marks, starts)])
    firsts = firsts[np.r_[True, ~repeats][: len(firsts)]]  # of documents that are listed more than once
    if not len(firsts):
        return
    groups = np.flatnonzero(np.r_[True, a[firsts][1:] != a[firsts][:-1]])
    lengths = sizes[firsts] + LENGTH
    part: list[np.ndarray] = []
    held = 0
    for start, end in zip(groups, np.r_[groups[1:], len(firsts)], strict=True):
        part.append(firsts[start:end])
        held += int(lengths[start:end].sum())
        if held >= SORTED_BYTES or end == len(firsts):
            own = np.concatenate(part)
            own = own[np.lexsort((starts[own], marks[own], ids[own]))]
            for k, offsets in _later_windows([texts[int(r)].as_py() for r in own]):
                first = np.flatnonzero(np.r_[True, np.diff(np.sort(offsets)) > 1])
                at = np.sort(offsets)
                size = np.diff(np.r_[first, len(at)])
                r = own[k]
                yield _ranges(np.full(len(first), ids[r]), np.full(len(first), marks[r]), starts[r] + at[first], size)
            part, held = [], 0


def _ranges(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks.astype(np.int32)), pa.array(starts.astype(np.int32)), pa.array(sizes.astype(np.int32))], names=["id", "mark", "start", "n"])


def removed_spans(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes, from ranges of starts of repeated windows."""
    spans: list[tuple[int, int]] = []
    for start, n in sorted((r["start"], r["n"]) for r in ranges or ()):
        end = start + n - 1 + LENGTH
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((start, end))
    return spans


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for start, end in spans:
        parts.append(data[at:start])
        at = end
    return b"".join([*parts, data[at:]])


def repeated_windows(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, mark, windows): for each document with repeats, ranges of starts of repeated windows."""
    rows = _rows(df, id_col, text_col)
    return _repeated_windows(rows, _marked(rows))


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), whole_text(text_col).alias("text"))


def _repeated_windows(rows: DataFrame, marked: DataFrame) -> DataFrame:
    runs = rows.mapInArrow(_runs, _RUN).repartition("key").mapInArrow(_classify, _CLASSIFIED)
    by_document = runs.groupBy("id", "mark").agg(F.collect_set(F.struct("anchor", "start", "n")).alias("runs"))
    met = marked.join(by_document, ["id", "mark"]).select("id", "mark", "text", "runs")
    segments = met.mapInArrow(_segments, _SEGMENT)
    ranges = segments.repartition("key").mapInArrow(_shard, _RANGE)
    return ranges.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "n")).alias("windows"))


def _marked(rows: DataFrame) -> DataFrame:
    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [text_mark(d) for d in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int32()), batch.column(1)], names=["id", "mark", "text"])

    # never null, but said so: both joins then have one plan below them and share one shuffle of the texts
    return rows.mapInArrow(mark, "id bigint, mark int, text string").where("id IS NOT NULL AND mark IS NOT NULL")


def deduplicate(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256, spans), one per row of ``df``.

    ``spans`` are the removed runs of bytes, (start, end) with the end exclusive.
    """
    rows = _rows(df, id_col, text_col)
    marked = _marked(rows)
    met = marked.join(_repeated_windows(rows, marked), ["id", "mark"], "left").select("id", "text", "windows")
    item = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            spans = [removed_spans(w) for w in batch.column(2).to_pylist()]
            kept = [hashlib.sha256(_kept(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)]
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(kept), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], item)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    out = met.mapInArrow(finish, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:int,end:int>>")
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_col)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), w AS (
  SELECT doc_id, p, hash(substr(x, CAST(2 * p + 1 AS BIGINT), 200)) AS s FROM (SELECT doc_id, x, unnest(range(0, greatest(n - 99, 0))) AS p FROM d)
), f AS (
  SELECT s, min(doc_id * 1000000000 + p) AS first FROM w GROUP BY s HAVING count(*) > 1
), r AS (
  SELECT w.doc_id, w.p, lag(w.p) OVER (PARTITION BY w.doc_id ORDER BY w.p) AS before
  FROM w JOIN f ON w.s = f.s WHERE w.doc_id * 1000000000 + w.p <> f.first
), g AS (
  SELECT *, sum(CASE WHEN before IS NULL OR p > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM r
), spans AS (
  SELECT doc_id, span, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY ALL
), pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT d.doc_id, coalesce(max(s.b), 0), any_value(d.n) FROM d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id
), kept AS (
  SELECT p.doc_id, string_agg(substr(d.x, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS x
  FROM pieces p JOIN d USING (doc_id) GROUP BY p.doc_id
), sums AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k.x)) AS kept_sha256
FROM d JOIN kept k USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
