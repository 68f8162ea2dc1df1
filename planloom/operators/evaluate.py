"""Result-equivalence evaluation: scoring, grouped metrics, pairs and oracles.

Scoring runs where the records are: each task replays a record's small database in
SQLite memory and compares both results, so millions of records need no Spark job
of their own.  Metrics are grouped aggregates over the scored rows.
"""

from __future__ import annotations

import sqlite3
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planloom.plans.errors import Rejected
from planloom.plans.logical import PLAN_STRUCT, LogicalQuery, from_struct, to_struct
from planloom.plans.sqlform import is_read_only, is_safe_context, lower, normalize, recover_literals, render

METRICS = ("syntactically_valid", "executable", "exact_match", "execution_accuracy")
FAILURES = ("unsafe_or_incomplete_output", "execution_error", "wrong_result", "correct_execution")
COMPONENTS = ("tables", "projection", "aggregate", "distinct", "join", "filters", "group_by", "order_limit")
OPERATIONS = (
    "selection_arity", "aggregate_function", "aggregate_position", "distinct", "filter_count", "filter_operators_and_values", "filter_values", "filter_connector", "group_arity", "order_presence",
    "sort_direction", "limit",
)
ROW_LIMIT, STEPS = 1000, 5_000_000


# --- one record ---


def execute(script: str | None, sql: str, path: str | None = None, row_limit: int = ROW_LIMIT) -> list[tuple] | None:
    """Rows of one read-only statement over a script or a database file; None if it fails."""
    if not is_read_only(sql):
        return None
    connection = None
    try:
        if path:
            connection = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        else:
            if not is_safe_context(script or ""):
                return None
            connection = sqlite3.connect(":memory:")
            connection.executescript(script or "")
        connection.execute("PRAGMA query_only = ON")
        left = [STEPS // 10_000]

        def tick() -> int:
            left[0] -= 1
            return left[0] < 0

        connection.set_progress_handler(tick, 10_000)
        return connection.execute(sql).fetchmany(row_limit)
    except (sqlite3.Error, sqlite3.Warning, ValueError):
        return None
    finally:
        if connection is not None:
            connection.close()


def validate(sql: str, script: str | None, path: str | None = None, require_rows: bool = True) -> tuple[bool, list[tuple]]:
    """Whether a statement is one read-only SELECT that runs (and has rows), and its rows."""
    rows = execute(script, sql, path)
    return rows is not None and (bool(rows) or not require_rows), rows or []


def equivalent(left: list[tuple] | None, right: list[tuple] | None, ordered: bool) -> bool:
    """Equal as lists, or as bags; 1 equals 1.0.  A failed side equals nothing."""
    if left is None or right is None:
        return False
    return left == right if ordered else Counter(left) == Counter(right)


def _fold(value):
    return value.casefold() if isinstance(value, str) else value


def component_match(predicted: LogicalQuery | None, gold: LogicalQuery) -> dict[str, int]:
    """1 for every part of the plan that agrees.  Predicate values keep their type: 1, 1.0 and '1' differ."""
    if predicted is None:
        return {c: 0 for c in (*COMPONENTS, "plan_match")}

    def names(values) -> tuple:
        return tuple(map(_fold, values))

    def filters(plan: LogicalQuery):
        return Counter((_fold(p.column), p.operator, type(p.value).__name__, p.value) for p in plan.predicates), plan.connector.casefold()

    def parts(plan: LogicalQuery) -> tuple:
        return (
            {_fold(t) for t in plan.tables()}, names(plan.columns), (plan.aggregate, _fold(plan.aggregate_column), plan.aggregate_position), plan.distinct,
            frozenset(names(plan.join_on)) if plan.join_on else None, filters(plan), names(plan.group_by), (_fold(plan.order_by), plan.descending, plan.limit),
        )

    found = {c: int(a == b) for c, a, b in zip(COMPONENTS, parts(predicted), parts(gold), strict=True)}
    return found | {"plan_match": int(all(found.values()))}


def operations_of(predicted: LogicalQuery, gold: LogicalQuery) -> dict[str, int]:
    """1 for every operation that agrees, whatever the names; values keep their type, text its letters only."""
    def shape(plan: LogicalQuery) -> tuple:
        values = [(type(p.value).__name__, p.value.lower() if isinstance(p.value, str) else p.value) for p in plan.predicates]
        return (
            len(plan.columns), plan.aggregate, plan.aggregate_position, plan.distinct, len(values), Counter(zip([p.operator for p in plan.predicates], values, strict=True)), Counter(values), plan.connector,
            len(plan.group_by), plan.order_by is None, plan.descending, plan.limit,
        )

    found = {c: int(a == b) for c, a, b in zip(OPERATIONS, shape(predicted), shape(gold), strict=True)}
    return found | {"all_operations": int(all(found.values()))}


def score_one(gold_sql: str, predicted_sql: str, script: str | None, path: str | None = None, plan: dict | None = None) -> dict:
    valid = is_read_only(predicted_sql)
    predicted = execute(script, predicted_sql, path)
    gold = execute(script, gold_sql, path)
    correct = equivalent(predicted, gold, "ORDER BY" in gold_sql.upper())
    failure = FAILURES[0] if not valid else FAILURES[1] if predicted is None else FAILURES[3] if correct else FAILURES[2]
    out = {"syntactically_valid": int(valid), "executable": int(predicted is not None), "exact_match": int(normalize(predicted_sql) == normalize(gold_sql)), "execution_accuracy": int(correct), "failure": failure}
    if plan is not None:
        try:
            lowered = lower(predicted_sql)
        except Rejected:
            lowered = None
        out["components"] = component_match(lowered, from_struct(plan))
    return out


def convert_one(sql: str, script: str | None, path: str | None = None, names: Iterable[str] = ()) -> dict:
    """An outside statement as a plan: ``plan``, ``converted`` SQL, ``rewritten`` literals and ``reason``, null if it is accepted.

    The plan's own SQL must return what the statement returns; rows are required.
    """
    out = {"plan": None, "converted": None, "rewritten": 0, "reason": None}
    recovered, out["rewritten"] = recover_literals(sql, names)
    try:
        plan = lower(recovered)
    except Rejected as rejected:
        return out | {"reason": rejected.reason}
    converted = render(plan)
    gold, own = execute(script, sql, path), execute(script, converted, path)
    if gold is None:
        return out | {"reason": "original_execution_error"}
    if own is None:
        return out | {"reason": "converted_execution_error"}
    if not equivalent(own, gold, "ORDER BY" in sql.upper()):
        return out | {"reason": "execution_mismatch"}
    if not gold:
        return out | {"reason": "empty_result"}
    return out | {"plan": to_struct(plan), "converted": converted}


# --- many records ---

_COMPONENT_STRUCT = "struct<" + ",".join(f"{c}:int" for c in (*COMPONENTS, "plan_match")) + ">"


def zip_predictions(records: DataFrame, predictions: DataFrame, pos: str = "pos") -> DataFrame:
    """Records joined with predictions by position; positions must be the same on both sides."""
    own = records.select(pos, F.lit(1).alias("_n")).unionByName(predictions.select(pos, F.lit(-1).alias("_n")))
    sides = own.groupBy(pos).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    odd = sides.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("surplus"), F.count_if((F.col("_n") != 0) | (F.col("_rows") != 2)).alias("odd")).first()
    if odd["surplus"]:
        raise Rejected("predictions_differ_in_number", str(odd["surplus"]))
    if odd["odd"]:
        raise Rejected("predictions_differ_in_position", str(odd["odd"]))
    return records.join(predictions.select(pos, F.col("prediction")), pos)


def convert(df: DataFrame, *, sql: str = "sql", script: str = "database_sql", names: str | None = None) -> DataFrame:
    """``df`` plus ``plan``, ``converted``, ``rewritten`` and ``reason`` (``convert_one``).  ``names`` is an array of table and column names."""
    added = T.StructType.fromDDL(f"plan {PLAN_STRUCT}, converted string, rewritten int, reason string")

    def one(statement: str | None, database: str | None, known: list[str] | None) -> dict:
        return convert_one(statement or "", database, names=known or ())

    # replaying a database takes far longer than handing a row over
    found = F.udf(one, added)(F.col(sql), F.col(script), F.col(names) if names else F.array().cast("array<string>"))
    return df.withColumn("__converted", found).select(*df.columns, "__converted.*")


def score(df: DataFrame, *, gold: str = "sql", prediction: str = "prediction", has_plan: bool = False) -> DataFrame:
    """``df`` plus the four metrics, ``failure`` and, with plans, ``components``.

    The database is ``database_path``, else ``database_sql``, else ``schema_sql``, of the
    columns that are there.  A null prediction is an empty one.
    """
    def known(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    added = "syntactically_valid int, executable int, exact_match int, execution_accuracy int, failure string" + (f", components {_COMPONENT_STRUCT}" if has_plan else "")
    inputs = df.withColumns({"_script": F.coalesce(known("database_sql"), known("schema_sql")), "_path": known("database_path")})
    width, names = len(df.columns), df.columns
    plan_at = names.index("query_plan") if has_plan else None
    gold_at, prediction_at = names.index(gold), names.index(prediction)
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])
    components = pa.struct([(c, pa.int32()) for c in (*COMPONENTS, "plan_match")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            golds, guesses, scripts, paths = (batch.column(i).to_pylist() for i in (gold_at, prediction_at, width, width + 1))
            plans = batch.column(plan_at).to_pylist() if has_plan else [None] * len(golds)
            scored = [score_one(g or "", p or "", s, path, plan) for g, p, s, path, plan in zip(golds, guesses, scripts, paths, plans, strict=True)]
            columns = [*batch.columns[:width], *(pa.array([x[m] for x in scored], pa.int32()) for m in METRICS), pa.array([x["failure"] for x in scored], pa.string())]
            fields = [*names, *METRICS, "failure"]
            if has_plan:
                columns.append(pa.array([x.get("components") for x in scored], components))
                fields.append("components")
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    return inputs.mapInArrow(run, schema)


def _means() -> list[Column]:
    return [F.avg(m).alias(m) for m in METRICS]


def overall(scored: DataFrame) -> DataFrame:
    """Records, the four means, and accuracy given a valid prediction."""
    valid = F.greatest(F.sum("syntactically_valid"), F.lit(1))
    return scored.agg(F.count(F.lit(1)).alias("records"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS], F.coalesce(F.sum("execution_accuracy") / valid, F.lit(0.0)).alias("execution_accuracy_given_valid"))


def by_fields(scored: DataFrame, fields: list[str]) -> DataFrame:
    """Means and examples for every value of every field where it is present: (field, value, ...)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    long = scored.select(F.explode(pairs).alias("x"), *METRICS).where("x.value IS NOT NULL")
    return long.groupBy(F.col("x.field").alias("field"), F.col("x.value").alias("value")).agg(F.count(F.lit(1)).alias("examples"), *_means())


def difficulty_family(difficulty: str, family: str) -> Column:
    return F.concat(F.lit("difficulty_"), F.col(difficulty).cast("string"), F.lit(":"), F.col(family))


def schema_complexity(ddl: str) -> Column:
    n = F.regexp_count(F.upper(ddl), F.lit(r"\bCREATE\s+TABLE\b"))
    return F.when(n < 5, F.concat(n.cast("string"), F.lit("_tables"))).otherwise("5_plus_tables")


def track_slice(track: str, novelty: str) -> Column:
    return F.concat(F.col(track), F.lit(":"), F.col(novelty))


def failure_counts(scored: DataFrame) -> DataFrame:
    """Every failure class with its count and rate, also those that do not occur."""
    spark = scored.sparkSession
    classes = spark.createDataFrame([(f,) for f in FAILURES], "failure string")
    found = scored.groupBy("failure").agg(F.count(F.lit(1)).alias("n"))
    total = scored.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("_all"))
    return classes.join(found, "failure", "left").crossJoin(F.broadcast(total)).select("failure", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("_all")).alias("rate"))


def counterfactual(scored: DataFrame, group: str, change: str, expected_size: int = 2) -> DataFrame:
    """Per change: groups and the share that is complete.  A group is complete if it has the
    expected number of members and all are right.  Groups of any size can be asked for."""
    present = scored.where(F.col(group).isNotNull())
    groups = present.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min("execution_accuracy").alias("_all"), F.max(F.coalesce(change, F.lit("unknown"))).alias("change"))
    complete = ((F.col("_n") == expected_size) & (F.col("_all") == 1)).cast("int")
    return groups.groupBy("change").agg(F.count(F.lit(1)).alias("groups"), F.avg(complete).alias("accuracy"))


def paired_tracks(scored: DataFrame, pair: str, track: str, tracks: tuple[str, str] = ("direct_identifier", "semantic_paraphrase"), measures: tuple[str, ...] = ("exact_match",)) -> DataFrame:
    """One row over pairs that have both tracks: accuracies, both right, retention and rescue."""
    names = ("direct", "paraphrase")
    values = []
    for name, t in zip(names, tracks, strict=True):
        values += [F.max(F.when(F.col(track) == t, F.col(m))).alias(f"_{name}_{m}") for m in ("execution_accuracy", *measures)]
    pairs = scored.where(F.col(pair).isNotNull()).groupBy(pair).agg(*values).where("_direct_execution_accuracy IS NOT NULL AND _paraphrase_execution_accuracy IS NOT NULL")
    d, p = F.col("_direct_execution_accuracy"), F.col("_paraphrase_execution_accuracy")
    n, right = F.greatest(F.count(F.lit(1)), F.lit(1)), F.coalesce(F.sum(d), F.lit(0))
    both, rescued = F.coalesce(F.sum(d * p), F.lit(0)), F.coalesce(F.sum((1 - d) * p), F.lit(0))
    out = [
        F.count(F.lit(1)).alias("pairs"), (right / n).alias("direct_accuracy"), (F.coalesce(F.sum(p), F.lit(0)) / n).alias("paraphrase_accuracy"), (both / n).alias("both_accuracy"),
        (both / F.greatest(right, F.lit(1))).alias("retention"), (rescued / F.greatest(F.count(F.lit(1)) - right, F.lit(1))).alias("rescue"),
    ]
    for m in measures:
        a, b = F.col(f"_direct_{m}"), F.col(f"_paraphrase_{m}")
        out += [(F.coalesce(F.sum(a), F.lit(0)) / n).alias(f"direct_{m}"), (F.coalesce(F.sum(b), F.lit(0)) / n).alias(f"paraphrase_{m}"), (F.coalesce(F.sum(a * b), F.lit(0)) / n).alias(f"both_{m}")]
    return pairs.agg(*out)


def component_means(scored: DataFrame) -> DataFrame:
    """Means over the records that have components."""
    return scored.where("components IS NOT NULL").agg(F.count(F.lit(1)).alias("records"), *[F.avg(f"components.{c}").alias(c) for c in (*COMPONENTS, "plan_match")])


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often: the columns, ``side`` and ``n``.  Empty if the bags are equal.

    One grouped sum for both sides; integers compare as doubles if the other side has doubles.
    """
    if len(left.columns) != len(right.columns):
        raise Rejected("columns_differ_in_number")
    names = left.columns
    both = left.withColumn("_n", F.lit(1)).union(right.toDF(*names).withColumn("_n", F.lit(-1)))
    sums = both.groupBy(*names).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return sums.withColumn("side", F.when(F.col("_n") > 0, "left").otherwise("right")).withColumn("n", F.abs("_n")).drop("_n")


def same_bag(left: DataFrame, right: DataFrame) -> bool:
    return bag_difference(left, right).isEmpty()


def head_accuracy(df: DataFrame, record: str, role: str, correct: str, active: str) -> DataFrame:
    """Per role: right among active; plus ``all``, the share of records right in every active role."""
    live = df.where(F.coalesce(F.col(active).cast("int"), F.lit(0)) == 1).withColumn("_c", F.col(correct).cast("int"))
    roles = live.groupBy(F.col(role).alias("role")).agg(F.avg("_c").alias("accuracy"), F.count(F.lit(1)).alias("n"))
    whole = live.groupBy(record).agg(F.min("_c").alias("_m")).agg(F.avg("_m").alias("accuracy"), F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("role"), "accuracy", "n")
    return roles.unionByName(whole)


# --- oracles: a predicted plan with parts from the gold plan ---

#: Variants: which parts of the predicted plan are replaced.
VARIANTS = {
    "none": (), "tables": ("tables",), "projection": ("projection",), "filters": ("filters",), "group_order": ("group_order",), "all_but_tables": ("projection", "filters", "group_order"),
    "all_but_projection": ("tables", "filters", "group_order"), "all_but_filters": ("tables", "projection", "group_order"), "all_but_group_order": ("tables", "projection", "filters"), "all": ("tables", "projection", "filters", "group_order"),
}


def _roles(own: tuple[str, ...], gold: tuple[str, ...]) -> tuple[str, ...]:
    """Gold names in the own plan's places; its arity stays."""
    return tuple(gold[i] if i < len(gold) else x for i, x in enumerate(own))


def with_schema_links(plan: LogicalQuery, gold: LogicalQuery, variant: str) -> LogicalQuery:
    parts = VARIANTS[variant]
    if "tables" in parts:
        plan = plan.replace(table=gold.table, join_table=gold.join_table if plan.join_table else None, join_on=gold.join_on if plan.join_table and gold.join_on else plan.join_on if plan.join_table and gold.join_table else None)
        if plan.join_table is None:
            plan = plan.replace(join_on=None)
    if "projection" in parts:
        target = gold.aggregate_column if plan.aggregate_column and gold.aggregate_column else plan.aggregate_column
        plan = plan.replace(columns=_roles(plan.columns, gold.columns), aggregate_column=target)
    if "filters" in parts:
        names = _roles(tuple(p.column for p in plan.predicates), tuple(p.column for p in gold.predicates))
        plan = plan.replace(predicates=tuple(type(p)(c, p.operator, p.value) for p, c in zip(plan.predicates, names, strict=True)))
    if "group_order" in parts:
        plan = plan.replace(group_by=_roles(plan.group_by, gold.group_by), order_by=gold.order_by if plan.order_by and gold.order_by else plan.order_by)
    return plan


def with_operations(plan: LogicalQuery, gold: LogicalQuery) -> LogicalQuery:
    """Gold operations, predicted names as far as they go."""

    def fill(wanted: tuple[str, ...], own: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(own[i] if i < len(own) else x for i, x in enumerate(wanted))

    columns = tuple(p.column for p in plan.predicates)
    values = tuple(p.value for p in plan.predicates)
    predicates = tuple(type(g)(columns[i] if i < len(columns) else g.column, g.operator, values[i] if i < len(values) else g.value) for i, g in enumerate(gold.predicates))
    return gold.replace(
        table=plan.table, columns=fill(gold.columns, plan.columns), aggregate_column=gold.aggregate_column and (plan.aggregate_column or gold.aggregate_column), predicates=predicates,
        group_by=fill(gold.group_by, plan.group_by), order_by=gold.order_by and (plan.order_by or gold.order_by), join_table=gold.join_table and (plan.join_table or gold.join_table), join_on=gold.join_on and (plan.join_on or gold.join_on),
    )


def with_literals(plan: LogicalQuery, gold: LogicalQuery) -> LogicalQuery:
    values = tuple(p.value for p in gold.predicates)
    return plan.replace(predicates=tuple(type(p)(p.column, p.operator, values[i] if i < len(values) else p.value) for i, p in enumerate(plan.predicates)))


def operation_match(predicted: str, gold: str) -> Column:
    """The parts of ``operations_of`` as a struct of integers, from two plan columns; null if either plan is."""
    a, b = F.col(predicted), F.col(gold)

    def value(f: Column) -> list[Column]:
        return [f["value_kind"].alias("kind"), F.coalesce(F.lower(f["value_str"]), F.lit("")).alias("str"), F.coalesce(f["value_int"], F.lit(0)).alias("int"), F.coalesce(f["value_num"], F.lit(0.0)).alias("num")]

    def sizes(part: str) -> Column:
        return F.size(F.coalesce(a[part], F.array())) == F.size(F.coalesce(b[part], F.array()))

    def bags(of) -> Column:
        return F.array_sort(F.transform(a["filters"], of)) == F.array_sort(F.transform(b["filters"], of))

    same = [
        sizes("columns"), a["aggregate"].eqNullSafe(b["aggregate"]), a["aggregate_position"].eqNullSafe(b["aggregate_position"]), a["distinct"].eqNullSafe(b["distinct"]), F.size(a["filters"]) == F.size(b["filters"]),
        bags(lambda f: F.struct(f["operator"].alias("operator"), *value(f))), bags(lambda f: F.struct(*value(f))), a["filter_connector"].eqNullSafe(b["filter_connector"]), sizes("group_by"),
        a["order_by"].isNull() == b["order_by"].isNull(), a["descending"].eqNullSafe(b["descending"]), a["limit"].eqNullSafe(b["limit"]),
    ]
    ones = [F.coalesce(x, F.lit(False)).cast("int").alias(c) for c, x in zip(OPERATIONS, same, strict=True)]
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(*ones, F.least(*ones).alias("all_operations")))


#: Oracles of one row each, and those that a report adds.
ORACLES = (*VARIANTS, "operations", "literals")
COMBINED = ("schema_and_operations", "schema_and_literals", "gold_plan")
#: Corrections whose ceiling a report gives: kept only where they make a result right.
RESCUES = ("all", "operations", "literals")


def patched_plan(variant: str, plan: LogicalQuery, gold: LogicalQuery) -> LogicalQuery:
    if variant == "operations":
        return with_operations(plan, gold)
    if variant == "literals":
        return with_literals(plan, gold)
    if variant == "schema_and_operations":
        return with_schema_links(with_operations(plan, gold), gold, "all")
    if variant == "schema_and_literals":
        return with_schema_links(with_literals(plan, gold), gold, "all")
    return with_schema_links(plan, gold, variant)


def oracle_predictions(df: DataFrame, *, predicted: str = "predicted_plan", gold: str = "query_plan", variants: tuple[str, ...] = ORACLES) -> DataFrame:
    """Every row once per variant: (variant, prediction) as SQL; null where there is no sound plan."""
    spread = df.withColumn("variant", F.explode(F.array(*map(F.lit, variants))))

    at = [spread.columns.index(c) for c in ("variant", predicted, gold)]

    def patched(variant: str, own: dict | None, right: dict | None) -> str | None:
        if right is None or (own is None and variant != "gold_plan"):
            return None
        try:
            want = from_struct(right)
            return render((want if variant == "gold_plan" else patched_plan(variant, from_struct(own), want)).checked())
        except (Rejected, TypeError, KeyError):
            return None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sql = [patched(*x) for x in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sql, pa.string())], names=[*batch.schema.names, "prediction"])

    return spread.mapInArrow(run, T.StructType([*spread.schema.fields, T.StructField("prediction", T.StringType())]))


def oracle_report(df: DataFrame, record: str, *, sql: str = "sql", production: str = "production", predicted: str = "predicted_plan", gold: str = "query_plan") -> DataFrame:
    """Metrics per variant: (variant, records, the four means, accuracy given a valid prediction).

    Baselines are ``production`` (the statement as it was made) and ``none`` (the predicted
    plan as it is); ``gold_plan`` is the upper end.  ``rescue_x`` takes variant x where it
    returns the right rows, else the plan as it is.  ``record`` tells rows apart; a null
    plan or statement counts as a wrong prediction.  Every statement is executed once.
    """
    kept = [c for c in (record, sql, "database_sql", "schema_sql", "database_path", predicted, gold) if c in df.columns]
    made = oracle_predictions(df.select(*kept), predicted=predicted, gold=gold, variants=(*ORACLES, *COMBINED)).drop(predicted, gold)
    own = df.select(*[c for c in kept if c not in (predicted, gold)], F.lit("production").alias("variant"), F.col(production).alias("prediction"))
    scored = score(made.unionByName(own), gold=sql)
    names = ("production", *ORACLES, *COMBINED)
    wide = scored.groupBy(record).agg(*[F.max(F.when(F.col("variant") == v, F.struct(*METRICS))).alias(f"of_{v}") for v in names])
    rescued = [(f"rescue_{v}", F.when(F.col(f"of_{v}")["execution_accuracy"] == 1, F.col(f"of_{v}")).otherwise(F.col("of_none"))) for v in RESCUES]
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), m.alias("m")) for v, m in [*((v, F.col(f"of_{v}")) for v in names), *rescued]])
    long = wide.select(F.explode(rows).alias("x")).select("x.variant", *[F.col(f"x.m.{m}").alias(m) for m in METRICS])
    given = (F.sum("execution_accuracy") / F.greatest(F.sum("syntactically_valid"), F.lit(1))).alias("execution_accuracy_given_valid")
    return long.groupBy("variant").agg(F.count(F.lit(1)).alias("records"), *_means(), given)


def oracle_availability(df: DataFrame, *, predicted: str = "predicted_plan", gold: str = "query_plan") -> DataFrame:
    """One row: records, plans there are, their share, means of the operations over them, and the share
    of records whose predicted plan has a value for every filter of the gold plan."""
    o = df.select(operation_match(predicted, gold).alias("o"), (F.size(F.col(predicted)["filters"]) >= F.size(F.col(gold)["filters"])).alias("fits"))
    n, parsed = F.count(F.lit(1)), F.count("o")
    means = [F.coalesce(F.avg(F.col("o")[c]), F.lit(0.0)).alias(c) for c in (*OPERATIONS, "all_operations")]
    eligible = F.count_if(F.col("o").isNotNull() & F.col("fits"))
    return o.agg(n.alias("records"), parsed.alias("parsed"), (parsed / F.greatest(n, F.lit(1))).alias("parse_rate"), *means, (eligible / F.greatest(n, F.lit(1))).alias("operations_eligible"))


def rescue_ceiling(df: DataFrame, own: str, corrected: str) -> DataFrame:
    """Accuracy if a correction is kept only where it makes a wrong result right."""
    best = F.greatest(own, corrected)
    return df.agg(F.avg(own).alias("own_accuracy"), F.avg(best).alias("ceiling"), F.count_if(best > F.col(own)).alias("rescued"))
