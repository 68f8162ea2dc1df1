"""Splits, quotas, samples and mixes of exact size, deterministic for a seed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom.operators.ranking import largest_remainder, shuffle_key, shuffled_rank, totals
from planloom.plans.errors import Rejected


def split_groups(df: DataFrame, group: str, seed: int, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), names: tuple[str, str, str] = ("train", "validation", "test")) -> DataFrame:
    """``df`` plus ``split``: whole groups go to one split, by seeded rank.

    Three or more groups leave at least one for each later split.
    """
    groups = df.select(F.col(group).alias("__own_g")).distinct()
    n = groups.count()
    floor = 1 if n >= 3 else 0
    late = max(floor, int(n * shares[2]))
    middle = max(floor, int(n * shares[1]))
    ranked = shuffled_rank(groups, [], ["__own_g"], seed, "__own_r") if n else groups.withColumn("__own_r", F.lit(0))
    split = F.when(F.col("__own_r") <= n - middle - late, names[0]).when(F.col("__own_r") <= n - late, names[1]).otherwise(names[2])
    return df.join(ranked.select("__own_g", split.alias("split")), F.col(group).eqNullSafe(F.col("__own_g"))).drop("__own_g")


def quotas(df: DataFrame, family: str, total: int) -> DataFrame:
    """Families with their counts and largest-remainder quotas of an equal split."""
    counts = totals(df, [family]).withColumn("__own_one", F.lit(1))
    return largest_remainder(counts, "__own_one", total, [family]).drop("__own_one")


def exact_sample(df: DataFrame, n: int, ids: list[str], seed: int, tolerant: bool = False) -> DataFrame:
    """n rows without replacement; an error if there are fewer."""
    available = df.count()
    if available < n and not tolerant:
        raise Rejected("sample_larger_than_source", f"{n} of {available}")
    return shuffled_rank(df, [], ids, seed, "__own_rank").where(F.col("__own_rank") <= n).drop("__own_rank")


def cycle_sample(df: DataFrame, n: int, ids: list[str], seed: int) -> DataFrame:
    """n rows: the whole source as often as it fits, each time in a new order, then a part.  Adds ``cycle``."""
    size = df.count()
    if not size:
        if n:
            raise Rejected("sample_larger_than_source", f"{n} of 0")
        return df.withColumn("cycle", F.lit(0))
    full, rest = divmod(n, size)
    whole = df.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(full - 1)))) if full else df.withColumn("cycle", F.lit(0)).limit(0)
    part = exact_sample(df, rest, ids, seed + full).withColumn("cycle", F.lit(full)) if rest else df.withColumn("cycle", F.lit(0)).limit(0)
    return whole.unionByName(part)


def balanced_take(df: DataFrame, family: str, group: str, ids: list[str], total: int, seed: int, strict: bool = False) -> DataFrame:
    """``total`` rows with equal quotas by family and at most one row per group.

    A group stands for the family of its first row in seeded order, so no family waits
    for another.  Missing rows are filled from groups that are left over; the strict
    form raises instead.
    """
    single = shuffled_rank(df, [group], ids, seed, "__own_one").where(F.col("__own_one") == 1).drop("__own_one")
    ranked = shuffled_rank(single, [family], ids, seed, "__own_nth")
    wanted = quotas(single, family, total).select(F.col(family).alias("__own_f"), "quota")
    ranked = ranked.join(wanted, F.col(family).eqNullSafe(F.col("__own_f"))).drop("__own_f")
    chosen = ranked.where(F.col("__own_nth") <= F.col("quota")).drop("quota", "__own_nth")
    left = ranked.where(F.col("__own_nth") > F.col("quota")).drop("quota", "__own_nth")
    short = total - chosen.count()
    if short and strict:
        raise Rejected("quota_not_reached", str(short))
    if short:
        chosen = chosen.unionByName(exact_sample(left, short, ids, seed + 1, tolerant=True))
    return chosen


def round_robin(df: DataFrame, outer: str, inner: str, ids: list[str], total: int, seed: int) -> DataFrame:
    """``total`` rows that take turns: every outer value once per round, its inner values in turn.

    Rows are ranked within (outer, inner); a row's turn is its rank, shifted by the place
    of its inner value so that outer values start with different ones.  The last turn
    follows from the strata's sizes, so only that turn's rows (one per stratum) are cut by a limit.
    """
    ranked = shuffled_rank(df, [outer, inner], ids, seed, "__own_nth")
    places = shuffled_rank(df.select(outer, inner).distinct(), [outer], [inner], seed, "__own_place").select(F.col(outer).alias("__own_o"), F.col(inner).alias("__own_i"), "__own_place")
    placed = ranked.join(places, F.col(outer).eqNullSafe(F.col("__own_o")) & F.col(inner).eqNullSafe(F.col("__own_i")))
    order = [F.asc("__own_nth"), F.asc("__own_place"), F.asc_nulls_first(outer), *[F.asc(i) for i in ids]]
    # strata by size: how many rows there are up to the turn that empties each
    upward = Window.orderBy("n", "__own_o", "__own_i")
    sizes = totals(df, [outer, inner]).select("n", F.col(outer).alias("__own_o"), F.col(inner).alias("__own_i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("m"))
    sizes = sizes.select("n", "m", F.row_number().over(upward).alias("at"), F.sum("n").over(upward.rowsBetween(Window.unboundedPreceding, -1)).alias("under"))
    sizes = sizes.select("n", F.coalesce("under", F.lit(0)).alias("under"), (F.col("m") - F.col("at") + 1).alias("open"))
    cut = sizes.where(F.col("under") + F.col("n") * F.col("open") >= total).agg(F.max_by(F.struct("under", "open"), "open").alias("x")).select("x.*").first()
    if cut["open"] is None:
        return placed.orderBy(*order).drop("__own_nth", "__own_place", "__own_o", "__own_i")
    turn = -(-(total - cut["under"]) // cut["open"])
    rest = total - cut["under"] - (turn - 1) * cut["open"]
    last = placed.where(F.col("__own_nth") == turn).orderBy(*order).limit(rest)
    return placed.where(F.col("__own_nth") < turn).unionByName(last).orderBy(*order).drop("__own_nth", "__own_place", "__own_o", "__own_i")


def weighted_resample(df: DataFrame, family: str, weights: dict[str, float], ids: list[str], total: int, seed: int) -> DataFrame:
    """``total`` rows with quotas in proportion to count times weight; a quota above its
    family's size goes round again.  Adds ``cycle``."""
    counts = totals(df, [family])
    weight = F.coalesce(*[F.when(F.col(family) == k, F.lit(float(w))) for k, w in weights.items()], F.lit(1.0)) if weights else F.lit(1.0)
    wanted = largest_remainder(counts.withColumn("__own_w", F.col("n") * weight), "__own_w", total, [family]).select(F.col(family).alias("__own_f"), F.col("n").alias("__own_n"), "quota")
    ranked = shuffled_rank(df, [family], ids, seed, "__own_nth").join(wanted, F.col(family).eqNullSafe(F.col("__own_f")))
    times = F.floor((F.col("quota") - F.col("__own_nth")) / F.col("__own_n"))
    again = ranked.where(F.col("__own_nth") <= F.col("quota")).withColumn("cycle", F.explode(F.sequence(F.lit(0), times.cast("int"))))
    return again.drop("__own_f", "__own_n", "quota", "__own_nth")


def mix_fraction(own: DataFrame, external: DataFrame, fraction: float, ids: list[str], seed: int, total: int | None = None) -> DataFrame:
    """External rows at a fraction of the result; without a total, all own rows stay.  Adds ``mix_source``."""
    if not 0 <= fraction < 1:
        raise Rejected("bad_fraction", str(fraction))
    n_own = own.count() if total is None else total - round(total * fraction)
    n_external = round(n_own * fraction / (1 - fraction)) if total is None else total - n_own
    a = own if total is None else exact_sample(own, n_own, ids, seed)
    b = exact_sample(external, n_external, ids, seed + 1)
    return a.withColumn("mix_source", F.lit("own")).unionByName(b.withColumn("mix_source", F.lit("external")))


def mix_sources(sources: dict[str, DataFrame], weights: dict[str, int], total: int, ids: list[str], seed: int, id_col: str) -> DataFrame:
    """Whole quotas by integer weight; rows carry their source and an id with its name before it."""
    names = list(weights)
    whole = sum(weights.values())
    floors = {n: total * weights[n] // whole for n in names}
    by_fraction = sorted(names, key=lambda n: (-(total * weights[n] % whole), names.index(n)))
    for n in by_fraction[: total - sum(floors.values())]:
        floors[n] += 1
    parts = []
    for i, n in enumerate(names):
        part = exact_sample(sources[n], floors[n], ids, seed + i).withColumn("mix_source", F.lit(n))
        parts.append(tagged(part, n, [id_col]))
    return reduce(DataFrame.unionByName, parts)


def tagged(df: DataFrame, source: str, id_cols: list[str]) -> DataFrame:
    """Ids with the name of their source before them."""
    return df.withColumns({c: F.concat_ws(":", F.lit(source), F.col(c).cast("string")) for c in id_cols})


def shuffled(df: DataFrame, ids: list[str], seed: int) -> DataFrame:
    """All rows in seeded order."""
    return df.orderBy(shuffle_key(seed, *ids), *ids)


def interleaved(df: DataFrame, family: str, weights: dict[str, float], ids: list[str], seed: int) -> DataFrame:
    """All rows ordered so that every start has the families in about their weights."""
    weight = F.coalesce(*[F.when(F.col(family) == k, F.lit(float(w))) for k, w in weights.items()], F.lit(1.0)) if weights else F.lit(1.0)
    ranked = shuffled_rank(df, [family], ids, seed, "__own_nth")
    return ranked.orderBy((F.col("__own_nth") - 0.5) / weight, F.asc_nulls_first(family), *ids).drop("__own_nth")
