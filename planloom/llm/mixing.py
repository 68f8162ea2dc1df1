"""Mixing sources to target weights, with DataFrame functions only.

1. *Targets.*  Sources in code point order (null last) get weights in turn.  They
   share all words by weight; a target stops at ``most`` times its source's
   words and the excess is reshared among the others by weight (water filling,
   solved in closed form with running sums over the sources in the order in
   which they hit their limit).
2. *Blocks.*  A source's documents, in a fixed order, form one sequence of words
   that is cut into blocks of ``block`` words.  Offsets come from a two-level
   running sum (documents within a hash bucket, buckets within the source),
   so that no task has to hold a whole source.
3. *Draws.*  The mix is cut into shards of ``shard_slots`` slots.  A source's share of a
   shard is its target in blocks over that of all sources, times the slots: the shard takes the whole part
   of every share, and the slots left over are one multinomial draw of the shard's
   own, with the fractional parts as probabilities.  A source's blocks in the
   whole mix are therefore random, with a deviation of at most half the root of the shards,
   and its expectation is its target exactly.
4. *Slots to blocks.*  The j-th slot that the shards drew of a source takes block
   ``perm[epoch](j mod blocks)`` where each epoch ``j div blocks`` has its own
   pseudorandom permutation of the source's block indexes; slots and blocks meet
   in a join by block index.  A slot with a j of ``most`` times the blocks or more stays empty, so no
   document is taken more often than that.

The permutations are swap-or-not networks keyed by the seed: pure expressions on
a domain of any size, so reruns and recomputed tasks agree.

Defined cases: a null or empty text has size 0 and is never taken; a null source
is a source of its own, the last; repeated rows are separate documents; rows
with equal id and size are interchangeable; an empty
table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.tables import WORD, settled, whole_text

#: Sources up to this number are broadcast to the documents; beyond it the join is shuffled.
BROADCAST_SOURCES = 10_000
#: Slots that a task makes, and the most tasks.
TASK_SLOTS, MOST_TASKS = 65_536, 100_000
#: Shards whose draws of one source are counted in one group.
GROUP = 1024
ROUNDS = 16


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0 .. n-1, chosen by the key, at x (swap-or-not)."""

    def step(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        swap = F.xxhash64(*key, r, F.greatest(at, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), step)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per source: source_no, source, source_size, weight, target.  ``sizes`` has source and size."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    position = F.row_number().over(everything.orderBy(F.asc_nulls_last("source")))
    rows = totals.withColumn("source_no", position)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("limit_at", F.lit(most) * F.col("source_size") / F.col("weight"))
    by_limit = everything.orderBy("limit_at", "source_no")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0))
    rows = rows.withColumn("share", left / F.sum("weight").over(onwards)).withColumn("fits", F.col("share") <= F.col("limit_at"))
    # the first source under its limit, in that order, fixes the share of one unit of weight
    share = F.min(F.when(F.col("fits"), F.struct("limit_at", "source_no", "share"))).over(everything)["share"]
    target = F.least((F.lit(most) * F.col("source_size")).cast("double"), share * F.col("weight"))
    return rows.withColumn("target", F.coalesce(target, F.lit(0.0))).select("source_no", "source", "source_size", "weight", "target")


@dataclass(frozen=True)
class Mix:
    """documents: one row per input row with offsets; sources: targets and shares; counts: slots of each shard and source; slots: the drawn mix; pieces: parts of documents by block."""

    documents: DataFrame
    sources: DataFrame
    counts: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """Per document: id, size, source, source_size, target and taken."""
        drawn = self.slots.groupBy("source_no", "block_no").agg(F.count(F.lit(1)).alias("times"))
        # the planner takes exploded rows for few; both sides grow with the input and must be shuffled
        counted = self.pieces.join(drawn.hint("merge"), ["source_no", "block_no"], "left")
        row = ["id", "source_no", "source", "size", "source_size", "target"]
        full = counted.groupBy(*row, "start").agg(F.sum(F.col("n_words") * F.coalesce("times", F.lit(0))).alias("taken")).drop("start")
        none = self.documents.where("size = 0").select(*row, F.lit(0).cast("long").alias("taken"))
        return full.unionByName(none)

    def contents(self) -> DataFrame:
        """The mix itself: shard, slot, document and the words of it that the slot holds."""
        # within a shard, of bounded size, the slots stand in pseudorandom order
        slot = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("shard", "source_no", "j"), "source_no", "j"))
        met = self.slots.withColumn("slot", slot).join(self.pieces.hint("merge"), ["source_no", "block_no"])
        return met.select("shard", "slot", "source", "epoch", "block_no", "id", (F.greatest("start", "block_start") - F.col("start")).alias("first_word"), "n_words")


def shard_counts(sources: DataFrame, shard_slots: int, seed: int) -> tuple[DataFrame, int]:
    """Rows (shard, source_no, blocks, limit, whole, drawn, first_whole, first_drawn) and the number of shards.

    ``sources`` has source_no, blocks, limit (the most slots) and share (expected slots).  ``first_whole`` and
    ``first_drawn`` say which slots of the source the shard's are.
    """
    total = sources.agg(F.sum("share")).first()[0] or 0.0
    n = round(total)
    shards = -(-n // shard_slots)
    last = n - (shards - 1) * shard_slots
    everything = Window.partitionBy("kind")
    # shards are of two kinds, full ones and the last; a row for each source and kind
    kinds = sources.withColumn("slots", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(x).cast("long").alias("n")) for k, x in ((0, shard_slots), (1, max(last, 0)))]))).select("*", "slots.*").drop("slots")
    kinds = kinds.withColumn("x", F.col("share") * F.col("n") / F.lit(max(total, 1e-300))).withColumn("whole", F.floor("x").cast("long")).withColumn("part", F.col("x") - F.col("whole"))
    kinds = kinds.withColumn("rest", F.col("n") - F.sum("whole").over(everything))
    to = F.sum("part").over(everything.orderBy("source_no"))
    whole_part = F.sum("part").over(everything)
    kinds = kinds.withColumn("to", F.when(F.col("source_no") == F.max("source_no").over(everything), F.lit(1.0)).otherwise(F.least(F.lit(1.0), to / whole_part)))
    kinds = kinds.withColumn("from", F.coalesce(F.lag("to").over(everything.orderBy("source_no")), F.lit(0.0)))
    kinds = settled(kinds.withColumn("whole_full", F.max(F.when(F.col("kind") == 0, F.col("whole"))).over(Window.partitionBy("source_no"))))
    n_sources = kinds.count() // 2

    def with_kinds(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
        return rows.join(F.broadcast(other) if n_sources <= BROADCAST_SOURCES else other, on)

    tasks = max(1, min(MOST_TASKS, n // TASK_SLOTS))
    rows = sources.sparkSession.range(0, max(shards, 0), 1, tasks).select(F.col("id").alias("shard"), (F.col("id") == shards - 1).cast("int").alias("kind"))
    # the draw: every number falls into one source's interval, found by way of a guide of equal steps
    steps = 4 * max(1, n_sources)
    guide = kinds.where("to > `from`").select("kind", "source_no", "from", "to", F.explode(F.sequence(F.floor(F.col("from") * steps), F.least(F.lit(steps - 1), F.floor(F.col("to") * steps)))).alias("step"))
    left = kinds.select("kind", "rest").distinct().where("rest > 0")
    draws = with_kinds(rows, left, ["kind"]).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rest"))))
    draws = draws.withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "shard", "nth"), 11) * F.lit(2.0**-53)).withColumn("step", F.floor(F.col("u") * steps))
    met = with_kinds(draws, guide, ["kind", "step"]).where((F.col("u") >= F.col("from")) & (F.col("u") < F.col("to")))
    drawn = met.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("drawn"))
    # which of the source's draws they are: running counts within groups of shards, and of groups
    group = F.floor(F.col("shard") / GROUP)
    drawn = settled(drawn.withColumn("group", group))
    of_groups = drawn.groupBy("source_no", "group").agg(F.sum("drawn").alias("in_group"))
    of_groups = of_groups.select("source_no", "group", (F.sum("in_group").over(Window.partitionBy("source_no").orderBy("group")) - F.col("in_group")).alias("before"))
    within = F.sum("drawn").over(Window.partitionBy("source_no", "group").orderBy("shard")) - F.col("drawn")
    drawn = drawn.withColumn("within", within).join(of_groups, ["source_no", "group"]).select("shard", "source_no", "drawn", (F.col("before") + F.col("within")).alias("nth_drawn"))
    fixed = with_kinds(rows, kinds.select("kind", "source_no", "blocks", "limit", "whole", "whole_full"), ["kind"])
    # the source's whole parts come first, then its draws
    ends = kinds.groupBy("source_no").agg(F.max(F.when(F.col("kind") == 1, F.col("whole"))).alias("whole_last"))
    fixed = with_kinds(fixed, ends, ["source_no"])
    all_whole = F.col("whole_full") * max(shards - 1, 0) + F.col("whole_last")
    counts = fixed.join(drawn, ["shard", "source_no"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))
    return counts.select("shard", "source_no", "blocks", "limit", "whole", "drawn", (F.col("shard") * F.col("whole_full")).alias("first_whole"), (all_whole + F.coalesce("nth_drawn", F.lit(0))).alias("first_drawn")), tasks


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 32, shard_slots: int = 4096, seed: int = 42) -> Mix:
    size = F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")
    sized = settled(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")))
    sources = settled(source_targets(sized, weights, most))
    n, n_sources = sized.count(), sources.count()
    buckets = max(256, min(65_536, n // 20_000))

    blocks = F.ceil(F.col("source_size") / block).cast("long")
    share = F.when(F.col("source_size") > 0, F.least((F.lit(most) * F.col("blocks")).cast("double"), F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(F.lit(0.0))
    sources = sources.withColumn("blocks", blocks).withColumn("limit", F.lit(most) * F.col("blocks")).withColumn("share", share)

    known = sources.select(F.col("source").alias("of"), "source_no", "source_size", "target")
    rows = sized.join(F.broadcast(known) if n_sources <= BROADCAST_SOURCES else known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "size"), F.lit(buckets)))
    within = F.sum("size").over(Window.partitionBy("source_no", "bucket").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    bucket_sizes = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_size"))
    base = F.sum("bucket_size").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("bucket_size")
    bases = bucket_sizes.select("source_no", "bucket", base.alias("base"))
    documents = rows.withColumn("within", within).join(bases, ["source_no", "bucket"]).withColumn("start", F.col("base") + F.col("within")).drop("base", "within", "bucket")

    def div(column: Column) -> Column:
        return F.floor(column / block).cast("long")

    end = F.col("start") + F.col("size")
    pieces = documents.where("size > 0").withColumn("block_no", F.explode(F.sequence(div(F.col("start")), div(end - 1))))
    pieces = pieces.withColumn("block_start", F.col("block_no") * block).withColumn("n_words", F.least(end, F.col("block_start") + block) - F.greatest("start", "block_start"))

    counts, tasks = shard_counts(sources.select("source_no", "blocks", "limit", "share"), shard_slots, seed)
    counts = settled(counts)
    # a fixed number of tasks: the rows to be made, not the few rows that they are made from, are the work
    spread = counts.repartition(tasks, F.xxhash64("shard"))
    own = "concat(if(whole > 0, sequence(first_whole, first_whole + whole - 1), array()), if(drawn > 0, sequence(first_drawn, first_drawn + drawn - 1), array()))"
    each = spread.select("shard", "source_no", "blocks", "limit", F.explode(F.expr(own)).alias("j")).where("j < limit")
    each = each.withColumn("epoch", F.floor(F.col("j") / F.col("blocks")).cast("int"))
    block_no = permuted(F.pmod("j", "blocks"), F.col("blocks"), F.lit(seed), F.col("source_no"), F.col("epoch"))
    drawn = each.select("shard", "source_no", "j", "epoch", block_no.alias("block_no"))
    return Mix(documents, sources, counts, drawn, pieces)
