"""Synthetic corpora: schemas, FK-safe rows, plans, questions and contrast sets.

Everything is a function of a seed and a schema's number, so a corpus is made by the
executors from ``spark.range``: one row per schema number, many records each.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.functions.text import humanized, plural, singular
from planloom.operators.evaluate import equivalent, execute
from planloom.plans.catalog import Catalog, Column, ForeignKey, Table, fingerprint
from planloom.plans.errors import Rejected
from planloom.plans.logical import AGGREGATES, PLAN_STRUCT, LogicalQuery, Predicate, difficulty, family, signature, tier, to_struct
from planloom.plans.sqlform import render

# Our own vocabulary: (parent noun, child noun, child amount) by domain.
DOMAINS = (
    ("library", "member", "loan", "fee"), ("harbour", "vessel", "voyage", "cargo_weight"), ("orchard", "grower", "harvest", "crate_total"), ("museum", "donor", "gift", "gift_price"), ("bakery", "patron", "basket", "basket_cost"),
    ("observatory", "team", "session", "exposure"), ("railway", "station", "delivery", "load_tons"), ("clinic", "practice", "visit", "charge"), ("theatre", "company", "booking", "ticket_sum"), ("quarry", "contractor", "haul", "tonnage"),
)
EXTRAS = ("contact", "segment", "channel", "grade", "remark", "origin")
PLACES = ("Arden", "Belmora", "Corvale", "Dunmere", "Eastholt", "Farrow", "Glenby", "Harwick")
STATUSES = ("open", "closed", "pending", "held")
STYLES: dict[str, Callable[[str], str]] = {
    "snake": lambda n: n, "camel": lambda n: n.split("_")[0] + "".join(w.title() for w in n.split("_")[1:]), "pascal": lambda n: "".join(w.title() for w in n.split("_")), "prefixed": lambda n: f"col_{n}",
}
PARENTS = 12


def make_schema(seed: int, number: int, style: str | None = None) -> tuple[Catalog, dict[str, str]]:
    """A parent and a child table with shuffled columns, and the names by role."""
    rng = random.Random(f"{seed}:{number}")
    _, parent, child, amount = DOMAINS[number % len(DOMAINS)]
    style = style or rng.choice(sorted(STYLES))
    name = STYLES[style]
    suffix = f"_{number // len(DOMAINS)}" if number >= len(DOMAINS) else ""
    tables = {"parent": name(plural(parent) + suffix), "child": name(plural(child) + suffix)}
    roles = tables | {"parent_id": name(f"{parent}_id"), "parent_name": name(f"{parent}_name"), "place": name("town"), "child_id": name(f"{child}_id"), "parent_key": name(f"{parent}_ref"), "amount": name(amount), "status": name("status")}
    extras = [name(e) for e in rng.sample(EXTRAS, rng.randint(2, 4))]
    cut = rng.randint(1, len(extras) - 1)
    own = [Column(roles["parent_id"], "INTEGER", True), Column(roles["parent_name"]), Column(roles["place"]), *(Column(e) for e in extras[:cut])]
    many = [Column(roles["child_id"], "INTEGER", True), Column(roles["parent_key"], "INTEGER"), Column(roles["amount"], "REAL"), Column(roles["status"]), *(Column(e) for e in extras[cut:])]
    rng.shuffle(own)
    rng.shuffle(many)
    key = ForeignKey(tables["child"], roles["parent_key"], tables["parent"], roles["parent_id"])
    return Catalog((Table(tables["parent"], tuple(own)), Table(tables["child"], tuple(many))), (key,)), roles


def opaque_schema(seed: int, number: int) -> tuple[Catalog, dict[str, str]]:
    """The same shape with names that mean nothing."""
    catalog, roles = make_schema(seed, number, "snake")
    rng = random.Random(f"opaque:{seed}:{number}")
    fresh: dict[str, str] = {}

    def renamed(name: str) -> str:
        while name not in fresh:
            candidate = "x_" + "".join(rng.choices("bcdfghjklmnpqrstvwz", k=6))
            if candidate not in fresh.values():
                fresh[name] = candidate
        return fresh[name]

    tables = tuple(Table(renamed(t.name), tuple(Column(renamed(c.name), c.type, c.primary_key) for c in t.columns)) for t in catalog.tables)
    keys = tuple(ForeignKey(*map(renamed, (k.child, k.child_column, k.parent, k.parent_column))) for k in catalog.foreign_keys)
    return Catalog(tables, keys), {role: renamed(name) for role, name in roles.items()}


def populate(catalog: Catalog, roles: dict[str, str], seed: int) -> dict[str, list[dict]]:
    """12 parents over 8 places and one child per place and status, so no combination is empty.

    Extra child columns are null in the last quarter of the rows.
    """
    rng = random.Random(f"rows:{seed}:{roles['parent']}")
    parent, child = catalog.table(roles["parent"]), catalog.table(roles["child"])
    known = set(roles.values())
    parents, children = [], []
    for i in range(1, PARENTS + 1):
        row = {c.name: f"{humanized(c.name)} {rng.randint(1, 5)}" for c in parent.columns if c.name not in known}
        parents.append(row | {roles["parent_id"]: i, roles["parent_name"]: f"{humanized(singular(roles['parent'])).title()} {i}", roles["place"]: PLACES[(i - 1) % len(PLACES)]})
    by_place: dict[str, list[int]] = {}
    for p in parents:
        by_place.setdefault(p[roles["place"]], []).append(p[roles["parent_id"]])
    pairs = list(itertools.product(PLACES, STATUSES))
    for i, (place, status) in enumerate(pairs, 1):
        row = {c.name: (f"{humanized(c.name)} {rng.randint(1, 5)}" if i <= len(pairs) * 3 // 4 else None) for c in child.columns if c.name not in known}
        amount = round(rng.uniform(10, 100) * (1 + i % 4), 2)
        children.append(row | {roles["child_id"]: i, roles["parent_key"]: rng.choice(by_place[place]), roles["amount"]: amount, roles["status"]: status})
    return {roles["parent"]: parents, roles["child"]: children}


def script(catalog: Catalog, rows: dict[str, list[dict]]) -> str:
    def shown(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    out = [catalog.ddl()]
    for table in catalog.tables:
        for row in rows.get(table.name, ()):
            out.append(f"INSERT INTO {table.name} VALUES ({', '.join(shown(row[c.name]) for c in table.columns)});")
    return "\n".join(out)


# --- plans ---


def base_plans(roles: dict[str, str], rows: dict[str, list[dict]], variant: int = 0) -> dict[str, LogicalQuery]:
    """One plan per family; the variant turns thresholds, values and limits."""
    p, c = roles["parent"], roles["child"]
    amounts = sorted(r[roles["amount"]] for r in rows[c])
    middle = amounts[(len(amounts) // 2 + variant) % (len(amounts) - 4) + 1]
    place, status, limit = PLACES[variant % 8], STATUSES[variant % 4], 3 + variant % 5
    q, amount, state = LogicalQuery, roles["amount"], roles["status"]
    joined = {"join_table": p, "join_on": (f"{c}.{roles['parent_key']}", f"{p}.{roles['parent_id']}")}
    at_place = Predicate(f"{p}.{roles['place']}", "=", place)
    plans = {
        "select_one": q(p, (roles["parent_name"],)), "select_many": q(c, (roles["child_id"], amount)), "distinct": q(c, (state,), distinct=True),
        "filter_text": q(c, (roles["child_id"],), predicates=(Predicate(state, "=", status),)), "filter_above": q(c, (roles["child_id"], amount), predicates=(Predicate(amount, ">", middle),)),
        "filter_below": q(c, (roles["child_id"],), predicates=(Predicate(amount, "<=", middle),)), "filter_both": q(c, (roles["child_id"],), predicates=(Predicate(state, "=", status), Predicate(amount, ">", amounts[1]))),
        "filter_either": q(c, (roles["child_id"],), predicates=(Predicate(state, "=", status), Predicate(amount, ">", middle)), connector="OR"), "order_limit": q(c, (roles["child_id"], amount), order_by=amount, descending=bool(variant % 2), limit=limit),
        "count": q(c, aggregate="COUNT"), "sum": q(c, aggregate="SUM", aggregate_column=amount), "average": q(c, aggregate="AVG", aggregate_column=amount), "least": q(c, aggregate="MIN", aggregate_column=amount), "most": q(c, aggregate="MAX", aggregate_column=amount),
        "group_count": q(c, (state,), aggregate="COUNT", aggregate_position=1, group_by=(state,)), "group_sum": q(c, (state,), aggregate="SUM", aggregate_column=amount, aggregate_position=1, group_by=(state,)),
        "join": q(c, (f"{c}.{roles['child_id']}", f"{p}.{roles['parent_name']}"), **joined), "join_filter": q(c, (f"{c}.{roles['child_id']}",), predicates=(at_place,), **joined),
        "join_group": q(c, (f"{p}.{roles['place']}",), aggregate="AVG", aggregate_column=f"{c}.{amount}", aggregate_position=1, group_by=(f"{p}.{roles['place']}",), **joined),
    }
    return {name: plan.replace(family=name) for name, plan in plans.items()}


def held_out(plan: LogicalQuery) -> str | None:
    """The name of the combination that is reserved for evaluation, if the plan is one: training corpora leave them out."""
    several = len(plan.predicates) > 1 and plan.connector == "AND"
    reserved = {
        "join_count_multi_filter": plan.join_table and plan.aggregate == "COUNT" and several,
        "join_aggregate_multi_filter": plan.join_table and plan.aggregate in ("SUM", "AVG", "MIN", "MAX") and several,
        "distinct_filter_limit": plan.distinct and plan.predicates and plan.limit is not None,
        "group_filter": plan.group_by and plan.predicates,
    }
    return next((name for name, found in reserved.items() if found), None)


def plan_key(plan: LogicalQuery) -> tuple:
    return tuple(sorted((k, str(v)) for k, v in to_struct(plan).items() if k != "family"))


def compose(roles: dict[str, str], rows: dict[str, list[dict]], count: int, seed: int, shares: tuple[float, float, float] = (0.25, 0.35, 0.40), reserved: bool = False) -> list[LogicalQuery]:
    """``count`` different plans by tier (atomic, pair, multi); reserved combinations only if asked for."""
    rng = random.Random(f"compose:{seed}")
    wanted = {t: round(count * s) for t, s in zip(("atomic", "pair", "multi"), shares, strict=True)}
    wanted["multi"] += count - sum(wanted.values())
    if reserved:
        wanted = {"atomic": 0, "pair": 0, "multi": count}
    found: dict[tuple, LogicalQuery] = {}
    for _ in range(count * 400):
        plan = _random_plan(roles, rows, rng)
        if wanted[tier(plan)] and bool(held_out(plan)) == reserved and plan_key(plan) not in found:
            found[plan_key(plan)] = plan.replace(family=signature(plan))
            wanted[tier(plan)] -= 1
            if len(found) == count:
                return list(found.values())
    raise Rejected("too_few_plans", f"{len(found)} of {count}")


def _random_plan(roles: dict[str, str], rows: dict[str, list[dict]], rng: random.Random) -> LogicalQuery:
    p, c = roles["parent"], roles["child"]
    join = rng.random() < 0.5
    own = rng.random() < 0.5 and not join

    def name(table: str, role: str) -> str:
        return f"{table}.{roles[role]}" if join else roles[role]

    text, numbers = ([(p, "place"), (p, "parent_name")], []) if own else ([(c, "status")], [(c, "amount"), (c, "child_id")])
    if join:
        text = [*text, (p, "place")]
    table = p if own else c
    shape = rng.choice(("project", "distinct", "aggregate", "group"))
    predicates = []
    for t, role in rng.sample([*text, *numbers], min(rng.choice((0, 1, 1, 2)), len(text) + len(numbers))):
        value = rng.choice([r[roles[role]] for r in rows[t]])
        predicates.append(Predicate(name(t, role), "=" if isinstance(value, str) else rng.choice((">", "<", ">=", "<=")), value))
    plan: dict = {"predicates": tuple(predicates), "connector": rng.choice(("AND", "OR")) if len(predicates) > 1 else "AND"}
    if join:
        plan |= {"join_table": p, "join_on": (f"{c}.{roles['parent_key']}", f"{p}.{roles['parent_id']}")}
    if shape in ("aggregate", "group"):
        operation = rng.choice(AGGREGATES if numbers else ("COUNT",))
        plan |= {"aggregate": operation, "aggregate_column": None if operation == "COUNT" else name(c, "amount")}
        if shape == "group":
            key = name(*rng.choice(text))
            plan |= {"columns": (key,), "group_by": (key,), "aggregate_position": 1}
            if rng.random() < 0.4:
                plan |= {"order_by": key, "descending": rng.random() < 0.5, "limit": rng.choice((None, 2, 3))}
    else:
        chosen = [name(*x) for x in rng.sample([*text, *numbers], rng.choice((1, 2)) if len(text) + len(numbers) > 1 else 1)]
        plan |= {"columns": tuple(chosen), "distinct": shape == "distinct"}
        if rng.random() < 0.4:
            plan |= {"order_by": chosen[0], "descending": rng.random() < 0.5, "limit": rng.choice((None, 3, 5))}
    return LogicalQuery(table, **plan)


def cross_product(roles: dict[str, str], threshold: float, status: str) -> list[LogicalQuery]:
    """48 plans: 2 projections or 4 aggregates, times joined or not, times operators and connectors."""
    p, c = roles["parent"], roles["child"]
    out = []
    for join in (False, True):
        def name(table: str, role: str, join=join) -> str:
            return f"{table}.{roles[role]}" if join else roles[role]

        extra = {"join_table": p, "join_on": (f"{c}.{roles['parent_key']}", f"{p}.{roles['parent_id']}")} if join else {}
        heads = [{"columns": (name(c, "child_id"),)}, {"columns": (name(c, "child_id"), name(c, "amount"))}]
        heads += [{"aggregate": a, "aggregate_column": None if a == "COUNT" else name(c, "amount")} for a in ("COUNT", "SUM", "AVG", "MAX")]
        amount, state = name(c, "amount"), Predicate(name(c, "status"), "=", status)
        tails = [((Predicate(amount, ">", threshold),), "AND"), ((Predicate(amount, "<=", threshold),), "AND"), ((Predicate(amount, ">", threshold), state), "AND"), ((Predicate(amount, ">", threshold), state), "OR")]
        out += [LogicalQuery(c, predicates=ps, connector=k, **head, **extra) for head in heads for ps, k in tails]
    return [q.replace(family=signature(q)) for q in out]


# --- contrast ---


def minimal_pairs(plans: dict[str, LogicalQuery], roles: dict[str, str]) -> list[tuple[str, LogicalQuery, LogicalQuery]]:
    """Five pairs that differ in one decision."""
    above, grouped, ordered = plans["filter_above"], plans["group_sum"], plans["order_limit"]
    other = STATUSES[(STATUSES.index(plans["filter_text"].predicates[0].value) + 1) % 4]
    return [
        ("operator", above, above.replace(predicates=(Predicate(above.predicates[0].column, "<", above.predicates[0].value),))),
        ("aggregate", grouped, grouped.replace(aggregate="COUNT", aggregate_column=None)),
        ("direction", ordered, ordered.replace(descending=not ordered.descending)),
        ("value", plans["filter_text"], plans["filter_text"].replace(predicates=(Predicate(roles["status"], "=", other),))),
        ("connector", plans["filter_both"], plans["filter_both"].replace(connector="OR")),
    ]


def distinguishable(database: str, plans: Iterable[LogicalQuery]) -> bool:
    """Whether no two plans of a group have the same result."""
    results = [execute(database, render(p)) for p in plans]
    return all(r is not None for r in results) and not any(equivalent(a, b, False) for a, b in itertools.combinations(results, 2))


def plant_marker(rows: list[dict], column: str, marker, at: int) -> list[dict]:
    """The rows with one value replaced, so that a predicate on it picks one row."""
    return [r | {column: marker} if i == at else r for i, r in enumerate(rows)]


def novel_marker(rows: list[dict], candidates: Iterable) -> object:
    """The first candidate that no column holds."""
    held = {v for r in rows for v in r.values()}
    for c in candidates:
        if c not in held:
            return c
    raise Rejected("no_novel_marker")


def threshold(values: Iterable[float]) -> float:
    """The middle one of the distinct values."""
    distinct = sorted(set(values))
    if len(distinct) < 3:
        raise Rejected("too_few_values")
    return distinct[len(distinct) // 2]


# --- wording ---

_SIGN = {"=": "is", ">": "is above", "<": "is below", ">=": "is at least", "<=": "is at most"}
_AGG = {"COUNT": "the number of", "SUM": "the total", "AVG": "the average", "MIN": "the lowest", "MAX": "the highest"}
_OPEN = {"plain": ("Show", "List", "Give"), "casual": ("can you pull", "i need", "grab me"), "held_out": ("Produce", "Report", "Look up")}


def verbalize(plan: LogicalQuery, seed: int = 0, tone: str = "plain", explicit: bool = False) -> str:
    """A question for a plan.  ``explicit`` writes raw names instead of readable ones."""
    rng = random.Random(f"{seed}:{tone}:{plan_key(plan)}")

    def label(ref: str) -> str:
        name = ref.rpartition(".")[2]
        return name if explicit else humanized(name)

    def noun(table: str) -> str:
        return table if explicit else humanized(table)

    of = noun(plan.table) + (f" with their {noun(plan.join_table)}" if plan.join_table else "")
    if plan.aggregate:
        what = f"{_AGG[plan.aggregate]} {label(plan.aggregate_column) + ' of ' if plan.aggregate_column else ''}{of}"
    elif plan.columns == ("*",):
        what = f"all {of}"
    else:
        what = f"the {'distinct ' if plan.distinct else ''}{' and '.join(map(label, plan.columns))} of {of}"
    text = f"{rng.choice(_OPEN[tone])} {what}"
    if plan.predicates:
        shown = [f"{label(p.column)} {_SIGN[p.operator]} " + (f"'{p.value}'" if isinstance(p.value, str) else str(p.value)) for p in plan.predicates]
        text += " where " + f" {plan.connector.lower()} ".join(shown)
    if plan.group_by:
        text += " for each " + " and ".join(map(label, plan.group_by))
    if plan.order_by:
        text += f" sorted by {label(plan.order_by)}{' descending' if plan.descending else ''}"
    if plan.limit is not None:
        text += f", only {plan.limit}"
    return text + ("" if tone == "casual" else ".")


def explicit_rate(question: str, plan: LogicalQuery) -> float:
    """Share of the plan's columns that the question names."""
    roles = [r.rpartition(".")[2] for r in (*plan.columns, plan.aggregate_column, *(p.column for p in plan.predicates), plan.order_by) if r and r != "*"]
    low = question.lower()
    return sum(r.lower() in low or humanized(r) in low for r in roles) / max(len(roles), 1)


# --- corpora ---

_RECORD = f"id string, schema_id string, schema_sql string, database_sql string, question string, sql string, difficulty int, seed bigint, query_plan {PLAN_STRUCT}"


def records_for(seed: int, number: int, per_schema: int, mode: str = "families", tone: str = "plain", opaque: bool = False) -> list[dict]:
    """Checked records of one schema: every query runs and returns rows; questions differ."""
    catalog, roles = (opaque_schema if opaque else make_schema)(seed, number)
    rows = populate(catalog, roles, seed)
    database = script(catalog, rows)
    if mode == "families":
        plans = [p for v in range(1 + per_schema // 12) for p in base_plans(roles, rows, v + number).values()]
    elif mode == "composed":
        plans = compose(roles, rows, per_schema * 2, seed * 7919 + number)
    elif mode == "cross":
        plans = cross_product(roles, threshold(r[roles["amount"]] for r in rows[roles["child"]]), STATUSES[number % 4])
    else:
        raise Rejected("unknown_mode", mode)
    ddl, out, asked = catalog.ddl(), [], set()
    mark = fingerprint(ddl)[:16]
    for plan in plans:
        sql = render(plan)
        if len(out) == per_schema or not execute(database, sql):
            continue
        question = verbalize(plan, seed, tone, explicit=opaque)
        if question.casefold() in asked:
            continue
        asked.add(question.casefold())
        out.append({"id": f"{mark}-{len(out):04d}", "schema_id": mark, "schema_sql": ddl, "database_sql": database, "question": question, "sql": sql, "difficulty": difficulty(plan), "seed": seed, "query_plan": to_struct(plan)})
    return out


def corpus(spark: SparkSession, schemas: int, per_schema: int, seed: int, mode: str = "families", tone: str = "plain", opaque: bool = False) -> DataFrame:
    """Records of many schemas, made by the executors; equal schemas appear once."""
    import pandas as pd

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for n in batch.column(0).to_pylist() for r in records_for(seed, n, per_schema, mode, tone, opaque)]
            if rows:
                yield pd.DataFrame(rows)

    def frames(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from make(pa.RecordBatch.from_pandas(p, preserve_index=False) for p in parts)

    return spark.range(schemas).mapInPandas(frames, _RECORD).dropDuplicates(["schema_id", "id"])


def contrast_corpus(seed: int, number: int) -> list[dict]:
    """Minimal pairs of one schema whose results differ, with group and change."""
    catalog, roles = make_schema(seed, number)
    rows = populate(catalog, roles, seed)
    database = script(catalog, rows)
    out = []
    for change, a, b in minimal_pairs(base_plans(roles, rows, number), roles):
        if distinguishable(database, (a, b)):
            for i, plan in enumerate((a, b)):
                out.append({"id": f"{seed}-{number}-{change}-{i}", "counterfactual_group": f"{seed}-{number}-{change}", "counterfactual_change": change, "database_sql": database, "schema_sql": catalog.ddl(), "sql": render(plan), "question": verbalize(plan, seed), "query_plan": to_struct(plan)})
    return out


def schema_contexts(records: DataFrame) -> DataFrame:
    """Per schema: one example plan of each family, where the families give the tables and roles."""
    return records.groupBy("schema_id").agg(F.first("schema_sql", ignorenulls=True).alias("schema_sql"), *[F.max(F.when(F.col("query_plan.family") == f, F.col("sql"))).alias(f) for f in ("join", "count", "filter_text", "order_limit")])


def add_family(plan: LogicalQuery) -> LogicalQuery:
    return plan.replace(family=family(plan))
