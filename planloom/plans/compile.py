"""An analysed plan as DataFrame calls; Catalyst does the rest.

Order: scan, join, filter, then group and aggregate or sort and project, distinct,
limit.  Only the columns that the plan needs leave the scans.
"""

from __future__ import annotations

import datetime
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planloom.plans.analyze import analyze
from planloom.plans.catalog import Catalog
from planloom.plans.errors import AnalysisError
from planloom.plans.logical import LogicalQuery, Predicate, Slot
from planloom.plans.sqlform import lower
from planloom.plans.textform import decode, literal

_COMPARE = {"=": operator.eq, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def _field(name: str) -> str:
    """The internal name of a qualified column: unique, without a dot."""
    return name.replace(".", "__")


def predicate(p: Predicate, kind: T.DataType) -> Column:
    """A typed comparison.  Text columns compare as text; a number column and a text that is
    no number compare by rank of type: numbers are less than any text."""
    column, compare = F.col(_field(p.column)), _COMPARE[p.operator]
    value = p.value
    if isinstance(value, Slot):
        raise AnalysisError("unbound_slot", value.name)
    if isinstance(kind, T.StringType):
        return compare(column, F.lit(value if isinstance(value, str) else literal(value)))
    if isinstance(kind, T.NumericType):
        if isinstance(value, str):
            try:
                value = int(value) if value.strip().lstrip("+-").isdigit() else float(value)
            except ValueError:
                return column.isNotNull() if p.operator in ("<", "<=") else column.isNotNull() & F.lit(False)
        if isinstance(value, int) and not -(2**63) <= value < 2**63:
            value = float(value)
        return compare(column, F.lit(value))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        if not isinstance(value, str):
            raise AnalysisError("incomparable", p.column)
        try:
            when = datetime.datetime.fromisoformat(value)
        except ValueError as e:
            raise AnalysisError("incomparable", f"{p.column}: {value}") from e
        return compare(column, F.lit(when).cast(kind))
    if isinstance(kind, T.BooleanType) and not isinstance(value, str):
        return compare(column.cast("int"), F.lit(value))
    raise AnalysisError("incomparable", p.column)


def expanded(catalog: Catalog, plan: LogicalQuery) -> tuple[str, ...]:
    """The selection with stars written out."""
    out: list[str] = []
    for name in plan.columns:
        if name.endswith("*"):
            tables = plan.tables() if name == "*" else (name.split(".")[0],)
            out += [f"{t}.{c.name}" for t in tables for c in catalog.table(t).columns]
        else:
            out.append(name)
    return tuple(out)


def output_names(catalog: Catalog, plan: LogicalQuery) -> list[str]:
    """Distinct names: the column's own, with its table if that is taken; aggregates as op_column."""
    items = list(expanded(catalog, plan))
    if plan.aggregate:
        items.insert(plan.position, f"#{plan.aggregate.lower()}_{(plan.aggregate_column or '.all').rpartition('.')[2]}")
    used: dict[str, int] = {}
    out = []
    for item in items:
        table, _, name = item.lstrip("#").rpartition(".")
        if name in used and table:
            name = f"{table}_{name}"
        used[name] = used.get(name, 0) + 1
        out.append(name if used[name] == 1 else f"{name}_{used[name]}")
    return out


def compile_plan(catalog: Catalog, plan: LogicalQuery) -> DataFrame:
    """Analyse and compile."""
    plan = analyze(catalog, plan)
    columns, names = expanded(catalog, plan), output_names(catalog, plan)
    wanted = {*columns, *(p.column for p in plan.predicates), *plan.group_by, *(plan.join_on or ()), *filter(None, (plan.order_by, plan.aggregate_column))}
    kinds: dict[str, T.DataType] = {}

    def scan(table: str) -> DataFrame:
        frame = catalog.frame(table)
        own = [c.name for c in catalog.table(table).columns if f"{table}.{c.name}" in wanted]
        kinds.update({f"{table}.{c}": frame.schema[c].dataType for c in own})
        return frame.select(*[F.col(f"`{c}`").alias(f"{table}__{c}") for c in own])

    rows = scan(plan.table)
    if plan.join_table:
        a, b = plan.join_on
        rows = rows.join(scan(plan.join_table), F.col(_field(a)) == F.col(_field(b)), "inner")
    if plan.predicates:
        rows = rows.where(reduce(operator.and_ if plan.connector == "AND" else operator.or_, [predicate(p, kinds[p.column]) for p in plan.predicates]))
    order = None
    if plan.order_by:
        key = F.col(_field(plan.order_by))
        order = key.desc_nulls_last() if plan.descending else key.asc_nulls_first()
    if plan.aggregate:
        target = F.lit(1) if plan.aggregate_column is None else F.col(_field(plan.aggregate_column))
        call = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[plan.aggregate](target).alias("#agg")
        rows = rows.groupBy(*map(_field, plan.group_by)).agg(call) if plan.group_by else rows.agg(call)
        fields = list(map(_field, columns))
        fields.insert(plan.position, "#agg")
    else:
        fields = list(map(_field, columns))
    if plan.distinct:
        rows = rows.select(*dict.fromkeys(fields)).distinct()
    if order is not None:
        rows = rows.orderBy(order)
    rows = rows.select(*[F.col(f"`{f}`").alias(n) for f, n in zip(fields, names, strict=True)])
    return rows.limit(plan.limit) if plan.limit is not None else rows


def run_sql(catalog: Catalog, sql: str) -> DataFrame:
    return compile_plan(catalog, lower(sql))


def run_text(catalog: Catalog, text: str, values: dict | None = None) -> DataFrame:
    plan = decode(text)
    return compile_plan(catalog, plan.bind(values) if values else plan)


def bounded(df: DataFrame, rows: int = 1000, seconds: float | None = None) -> list[tuple]:
    """At most ``rows`` rows on the driver; the job is cancelled after ``seconds``."""
    spark: SparkSession = df.sparkSession
    if seconds is None:
        return [tuple(r) for r in df.limit(rows).collect()]
    import threading
    import uuid

    tag = f"bounded-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, lambda: spark.interruptTag(tag))
    spark.addTag(tag)
    timer.start()
    try:
        return [tuple(r) for r in df.limit(rows).collect()]
    finally:
        timer.cancel()
        spark.removeTag(tag)


def oracle_sql(catalog: Catalog, plan: LogicalQuery, digits: int | None = None) -> str:
    """The plan as SQL for another engine: names spelled out, nulls placed, widened sums cast back."""
    plan = analyze(catalog, plan)
    columns, names = list(expanded(catalog, plan)), output_names(catalog, plan)
    items = columns
    if plan.aggregate:
        call = f"{plan.aggregate}({plan.aggregate_column or '*'})"
        whole = plan.aggregate_column and "INT" in catalog.table(plan.aggregate_column.split(".")[0]).column(plan.aggregate_column.split(".")[1]).type.upper()
        if plan.aggregate == "SUM" and whole:
            call = f"CAST({call} AS BIGINT)"
        elif digits is not None and plan.aggregate in ("SUM", "AVG"):
            call = f"ROUND({call}, {digits})"
        items = [*columns[: plan.position], call, *columns[plan.position :]]
    chosen = ", ".join(f"{i} AS {n}" for i, n in zip(items, names, strict=True))
    sql = f"SELECT {'DISTINCT ' if plan.distinct else ''}{chosen} FROM {plan.table}"
    if plan.join_table:
        sql += f" INNER JOIN {plan.join_table} ON {plan.join_on[0]} = {plan.join_on[1]}"
    if plan.predicates:
        sql += " WHERE " + f" {plan.connector} ".join(f"{p.column} {p.operator} {literal(p.value)}" for p in plan.predicates)
    if plan.group_by:
        sql += " GROUP BY " + ", ".join(plan.group_by)
    if plan.order_by:
        sql += f" ORDER BY {plan.order_by} " + ("DESC NULLS LAST" if plan.descending else "ASC NULLS FIRST")
    return sql + (f" LIMIT {plan.limit}" if plan.limit is not None else "")
