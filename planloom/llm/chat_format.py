"""Multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation (each distinct role other than null and
``system``) the dialogue is rendered with that speaker as the assistant and all
others as named users.  The rendering is kept as its segments, one row per turn,
each with its place in the whole: concatenated by ``position`` they are the text,
and ``mask_start`` to ``mask_end`` are the characters to train on (the content of
the assistant's turns; empty, at the segment's start, elsewhere).

Markers can't be forged: ``<|`` within a text or a name becomes ``<\\|``, and ``|>`` within
a name ``|\\>`` and a line break a blank, so every ``<|`` of a rendering is the engine's own.
Masks and offsets count the text as rendered.  ``render`` joins the segments to whole texts.

A conversation may hold a large part of all rows, so no conversation is gathered.
Turns are sorted by range partitions; positions and offsets are running sums of lengths
within a partition's share of a conversation plus the totals of the shares before.
Only lengths and names go through windows; texts join their places once.

Order: by turn (null last), then role, then text; turns equal in all three are alike.  Defined cases: a null text is an
empty one; a null role speaks as the user ``unknown`` and is no participant; a
conversation without participants has no rendering; repeated rows are repeated
turns; a null conv_id is a conversation of its own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.tables import settled, whole_text

SYSTEM = "system"
END = "<|end|>\n"


def safe_text(column: Column) -> Column:
    return F.replace(column, F.lit("<|"), F.lit("<\\|"))


def safe_name(column: Column) -> Column:
    return F.regexp_replace(F.replace(safe_text(column), F.lit("|>"), F.lit("|\\>")), r"[\r\n]", " ")


def _head(speaker: Column, role: Column) -> Column:
    named = F.concat(F.lit("<|user name="), safe_name(F.coalesce(role, F.lit("unknown"))), F.lit("|>\n"))
    return F.when(role == SYSTEM, F.lit("<|system|>\n")).when(role == speaker, F.lit("<|assistant|>\n")).otherwise(named)


def rotate(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, speaker, position, turn, role, segment, start, end, mask_start, mask_end)."""
    turns = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("said_by"), safe_text(whole_text(text_col)).alias("content"))
    order = [F.asc("conv"), F.asc_nulls_last("turn"), F.asc("said_by"), F.asc("content")]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    # the order itself, once and for all: by partition and by row within it
    ranged = settled(ranged.withColumn("share", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    speakers = settled(ranged.where(F.col("said_by").isNotNull() & (F.col("said_by") != SYSTEM)).select(F.col("conv").alias("in"), F.col("said_by").alias("speaker")).distinct())
    narrow = ranged.select("conv", "said_by", "share", "row", F.length("content").alias("n"))
    rows = narrow.join(speakers, F.col("conv").eqNullSafe(F.col("in"))).drop("in")
    rows = rows.withColumn("head_size", F.length(_head(F.col("speaker"), F.col("said_by"))))
    within = Window.partitionBy("conv", "speaker", "share").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("size", (F.col("head_size") + F.col("n") + len(END)).cast("long")).withColumn("to", F.sum("size").over(within)).withColumn("nth", F.count(F.lit(1)).over(within))

    totals = rows.groupBy("conv", "speaker", "share").agg(F.sum("size").alias("all_size"), F.count(F.lit(1)).alias("all_turns"))
    before = Window.partitionBy("conv", "speaker").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("conv").alias("b_conv"), F.col("speaker").alias("b_speaker"), F.col("share").alias("b_share"), F.coalesce(F.sum("all_size").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("all_turns").over(before), F.lit(0)).alias("base_turns"))
    same = F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("speaker") == F.col("b_speaker")) & (F.col("share") == F.col("b_share"))
    placed = rows.join(bases, same).select("row", "speaker", "head_size", "size", (F.col("base") + F.col("to")).alias("end"), (F.col("base_turns") + F.col("nth")).alias("position"))
    placed = placed.join(ranged.drop("share"), "row")
    start = F.col("end") - F.col("size")
    own = F.col("said_by") == F.col("speaker")
    role = F.when(F.col("said_by") == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    return placed.select(
        "conv", "speaker", "position", "turn", role.alias("role"), F.concat(_head(F.col("speaker"), F.col("said_by")), "content", F.lit(END)).alias("segment"), start.alias("start"), "end",
        F.when(own, start + F.col("head_size")).otherwise(start).alias("mask_start"), F.when(own, F.col("end") - len(END)).otherwise(start).alias("mask_end"),
    )


def render(segments: DataFrame, part_size: int = 1 << 20) -> DataFrame:
    """Rows (conv, speaker, part, start, text, masks): the renderings of ``rotate`` as whole texts.

    A rendering of ``part_size`` characters or more is told in parts, so that no task holds more
    of a hot conversation; a segment is never divided.  ``masks`` are (start, end) in the part's text.
    """
    parts = segments.withColumn("part", F.floor(F.col("start") / part_size).cast("int"))
    piece = F.struct("position", "segment", "start", "mask_start", "mask_end", "role")
    parts = parts.groupBy("conv", "speaker", "part").agg(F.array_sort(F.collect_list(piece)).alias("pieces")).withColumn("start", F.expr("pieces[0].start"))
    text = F.concat_ws("", F.transform("pieces", lambda p: p["segment"]))
    masks = F.expr("transform(filter(pieces, p -> p.role = 'assistant'), p -> struct(p.mask_start - start AS start, p.mask_end - start AS end))")
    return parts.select("conv", "speaker", "part", "start", text.alias("text"), masks.alias("masks"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role AS said_by, replace(coalesce(text, ''), '<|', '<\|') AS content,
         regexp_replace(replace(replace(coalesce(role, 'unknown'), '<|', '<\|'), '|>', '|\>'), '[\r\n]', ' ', 'g') AS named,
         row_number() OVER (ORDER BY conv_id, turn NULLS LAST, role NULLS FIRST, replace(coalesce(text, ''), '<|', '<\|')) AS nth
  FROM conversations
), p AS (
  SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role IS NOT NULL AND role <> 'system'
), r AS (
  SELECT t.*, p.speaker,
         CASE WHEN said_by = 'system' THEN '<|system|>' || chr(10) WHEN said_by = speaker THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || named || '|>' || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), s AS (
  SELECT *, head || content || '<|end|>' || chr(10) AS segment FROM r
), o AS (
  SELECT *, sum(length(segment)) OVER w AS "end", row_number() OVER w AS position FROM s
  WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, speaker, CAST(position AS BIGINT) AS position, turn,
       CASE WHEN said_by = 'system' THEN 'system' WHEN said_by = speaker THEN 'assistant' ELSE 'user' END AS role,
       segment, CAST("end" - length(segment) AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end",
       CAST(CASE WHEN said_by = speaker THEN "end" - length(segment) + length(head) ELSE "end" - length(segment) END AS BIGINT) AS mask_start,
       CAST(CASE WHEN said_by = speaker THEN "end" - 8 ELSE "end" - length(segment) END AS BIGINT) AS mask_end
FROM o
"""
