"""A deterministic English front end.

``ground`` finds mentions in a question (tables and columns by name or alias,
literals by form or by the words before them), ``question_plan`` turns the sequence
of mentions and cue words into a plan, and the analyzer checks it.  Whatever is
ambiguous is an error, not a guess.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from planloom.functions.text import aliases, identifier_words, mentions
from planloom.plans.analyze import analyze, qualify
from planloom.plans.catalog import Catalog, slots
from planloom.plans.errors import AnalysisError, Rejected
from planloom.plans.logical import LogicalQuery, Predicate, Slot

# Our cue lexicon.  Longer phrases are tried first.
COMPARISONS = {
    "at least": ">=", "no less than": ">=", "at most": "<=", "no more than": "<=", "greater than": ">", "more than": ">", "larger than": ">", "less than": "<", "fewer than": "<", "smaller than": "<",
    "above": ">", "over": ">", "exceeds": ">", "exceeding": ">", "after": ">", "below": "<", "under": "<", "before": "<", "equal to": "=", "equals": "=", "set to": "=", "marked as": "=", "matches": "=", "is": "=", "named": "=", "called": "=", "=": "=", ">": ">", "<": "<", ">=": ">=", "<=": "<=",
}
AGGREGATE_CUES = {
    "how many": "COUNT", "number of": "COUNT", "count of": "COUNT", "count": "COUNT", "total": "SUM", "sum of": "SUM", "sum": "SUM", "average": "AVG", "mean": "AVG", "minimum": "MIN", "lowest": "MIN",
    "smallest": "MIN", "least": "MIN", "earliest": "MIN", "maximum": "MAX", "highest": "MAX", "largest": "MAX", "greatest": "MAX", "latest": "MAX",
}
GROUP_CUES = ("grouped by", "for each", "for every", "in each", "per", "by each")
ORDER_CUES = ("sorted by", "ordered by", "sort by", "order by", "ranked by")
DISTINCT_CUES = ("distinct", "unique", "different")
LOCATIVES = ("located in", "based in", "from", "in", "near", "around")
LOCATION_WORDS = frozenset("city town location country state region county province place address".split())
KEY_WORDS = frozenset(("id", "key", "identifier"))
NOT_VALUES = frozenset("a all an and any as by each every for from in is our or record records row rows the there total where whose with of to on at more less least most than their its".split())


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str  # table, column or value
    target: object  # a table name, a column name or a literal


@dataclass
class Grounded:
    question: str
    mentions: list[Mention]
    catalog: Catalog
    permuted: bool = False
    values: list = field(default_factory=list)

    def __post_init__(self):
        seen = {}
        for m in self.mentions:
            if m.kind == "value":
                seen.setdefault((type(m.target), str(m.target).casefold()), m.target)
        self.values = list(seen.values())

    def slot_of(self, m: Mention) -> str:
        tables, columns = slots(self.catalog, self.permuted)
        if m.kind == "table":
            return tables[m.target]
        if m.kind == "column":
            return columns[m.target]
        return next(f"value{i}" for i, v in enumerate(self.values, 1) if type(v) is type(m.target) and str(v).casefold() == str(m.target).casefold())

    def hint_of(self, m: Mention) -> str | None:
        """The table whose noun stands inside the mention of a key column; of several, the one whose key it is."""
        if m.kind != "column" or identifier_words(m.target)[-1] not in KEY_WORDS:
            return None
        phrase = " ".join(identifier_words(self.question[m.start : m.end]))
        named = [(not c.primary_key, at, t.name) for at, t in enumerate(self.catalog.tables) for c in t.columns if c.name == m.target and any(_occurrences(phrase, a) for a in aliases(t.name))]
        return min(named)[2] if named else None

    def canonical(self) -> str:
        """The question with slots for tables, columns and values; a key's table hint stays before it."""
        tables, _ = slots(self.catalog, self.permuted)
        out, at = [], 0
        for m in self.mentions:
            hint = self.hint_of(m)
            out += [self.question[at : m.start], f"{tables[hint]} " if hint else "", self.slot_of(m)]
            at = m.end
        return "".join(out) + self.question[at:]

    def bindings(self) -> dict[str, str | int | float]:
        return {f"value{i}": v for i, v in enumerate(self.values, 1)}


def _occurrences(text: str, phrase: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(rf"(?<![\w']){re.escape(phrase)}(?![\w'])", text, re.I)]


def ground(catalog: Catalog, question: str, permuted: bool = False) -> Grounded:
    found: list[Mention] = []

    def free(start: int, end: int) -> bool:
        return all(end <= m.start or m.end <= start for m in found)

    for m in re.finditer(r"'((?:''|[^'])*)'(?!\w)|\"([^\"]*)\"", question):
        if m.start() and question[m.start() - 1].isalnum() and m[1] is not None:
            continue
        found.append(Mention(*m.span(), "value", m[1].replace("''", "'") if m[1] is not None else m[2]))
    names: dict[str, set[tuple[str, str]]] = {}
    for table in catalog.tables:
        for alias in aliases(table.name):
            names.setdefault(alias, set()).add(("table", table.name))
        for column in table.columns:
            for alias in aliases(column.name):
                names.setdefault(alias, set()).add(("column", column.name))
    exact = {n for t in catalog.tables for n in (t.name.lower(), *(c.name.lower() for c in t.columns))}
    for alias in sorted(names, key=lambda a: (-len(a), a)):
        targets = names[alias]
        if len(targets) > 1:
            same = {(k, n) for k, n in targets if n.lower() == alias}
            targets = same if len(same) == 1 and alias in exact else set()
        for kind, target in targets:
            found += [Mention(s, e, kind, target) for s, e in _occurrences(question, alias) if free(s, e)]
    found += [Mention(*m.span(), "value", float(m[0]) if "." in m[0] else int(m[0])) for m in re.finditer(r"(?<![\w.])-?\d+(?:\.\d+)?(?![\w]|\.\d)", question) if free(*m.span())]

    # bare words become values after a comparison, a name or a place word
    cues = sorted([c for c in COMPARISONS if c[0].isalpha()], key=len, reverse=True)
    column_ends = [m.end for m in found if m.kind == "column"]
    noun_ends = [m.end for m in found if m.kind in ("column", "table")]
    for end in column_ends:
        m = re.match(rf"\s+(?:{'|'.join(map(re.escape, cues))})\s+(?:the\s+)?([A-Za-z][\w-]*)", question[end:], re.I)
        if m and m[1].lower() not in NOT_VALUES and free(end + m.start(1), end + m.end(1)):
            found.append(Mention(end + m.start(1), end + m.end(1), "value", m[1]))
    for end in noun_ends:
        m = re.match(r"\s+(?:named|called)\s+([A-Za-z][\w-]*)", question[end:], re.I)
        if m and m[1].lower() not in NOT_VALUES and free(end + m.start(1), end + m.end(1)):
            found.append(Mention(end + m.start(1), end + m.end(1), "value", m[1]))
    for end, start in [(m.end, m.start) for m in found if m.kind == "column"]:
        m = re.match(r"\s+([A-Za-z][\w-]*)", question[end:])
        if m and re.search(r"\bwith\s+(?:the\s+|a\s+)?$", question[:start], re.I) and m[1].lower() not in NOT_VALUES and m[1].lower() not in COMPARISONS and free(end + m.start(1), end + m.end(1)):
            found.append(Mention(end + m.start(1), end + m.end(1), "value", m[1]))
    for m in re.finditer(rf"\b(?:{'|'.join(LOCATIVES)})\s+([A-Za-z][\w-]*)(?=\s*(?:[?.!,]|$))", question, re.I):
        if m[1].lower() not in NOT_VALUES and free(m.start(1), m.end(1)):
            found.append(Mention(m.start(1), m.end(1), "value", m[1]))
    for value in [m for m in found if m.kind == "value" and isinstance(m.target, str)]:
        end = value.end
        while m := re.match(r"\s*(?:,\s*or|or|,|and)\s+([A-Z][\w-]*)", question[end:]):
            if not free(end + m.start(1), end + m.end(1)):
                break
            found.append(Mention(end + m.start(1), end + m.end(1), "value", m[1]))
            end += m.end(1)
    return Grounded(question, sorted(found, key=lambda m: m.start), catalog, permuted)


def location_column(catalog: Catalog, tables: tuple[str, ...]) -> str | None:
    """The only column of these tables whose name says a place; None if there are none or more."""
    found = {f"{t}.{c.name}" for t in tables for c in catalog.table(t).columns if LOCATION_WORDS & set(identifier_words(c.name))}
    return next(iter(found)) if len(found) == 1 else None


def _cue_before(text: str, cues) -> str | None:
    """The longest cue that ends the text."""
    tail = text.rstrip().lower()
    return next((c for c in sorted(cues, key=len, reverse=True) if tail.endswith(c) and not tail[: -len(c)][-1:].isalnum()), None)


def question_plan(catalog: Catalog, question: str) -> LogicalQuery:
    """The analysed plan of a question, or an error with a reason."""
    g = ground(catalog, question)
    tables = list(dict.fromkeys(m.target for m in g.mentions if m.kind == "table"))
    lower = question.lower()
    used: set[Mention] = set()

    def gap(i: int) -> str:
        """The words between the mention before and this one."""
        return question[g.mentions[i - 1].end if i else 0 : g.mentions[i].start]

    predicates: list[Predicate] = []
    order_by, descending, limit = None, False, None
    group_by: list[str] = []
    for i, m in enumerate(g.mentions):
        if m.kind == "value" and isinstance(m.target, int) and re.search(r"\b(?:top|first|limit|only)\s+$", gap(i).lower()[-12:]) and m.target > 0:
            limit, used = m.target, used | {m}
            descending |= re.search(r"\btop\s+$", gap(i).lower()) is not None
    for i, m in enumerate(g.mentions):
        if m.kind != "column":
            continue
        before = gap(i)
        if _cue_before(before, ORDER_CUES) or (limit is not None and re.search(r"\bby\s+(?:the\s+)?$", before.lower())):
            order_by, used = m.target, used | {m}
            after = question[m.end : m.end + 14].lower()
            descending = "desc" in after or "high" in after or (descending and "asc" not in after)
        elif _cue_before(before, GROUP_CUES) or (re.search(r"\bby\s+(?:the\s+)?$", before.lower()) and any(all(e <= x.start or x.end <= s for x in g.mentions) for c in AGGREGATE_CUES for s, e in _occurrences(lower, c))) or (i and g.mentions[i - 1] in used and g.mentions[i - 1].target in group_by and before.strip().lower() in ("and", ",")):
            group_by.append(m.target)
            used.add(m)
    column = None
    for i, m in enumerate(g.mentions):
        if m.kind == "column" and m not in used:
            column = m
        if m.kind != "value" or m in used:
            continue
        previous = g.mentions[i - 1] if i else None
        cue = _cue_before(gap(i), COMPARISONS)
        operator = COMPARISONS[cue] if cue else "="
        if previous is not None and previous.kind == "column" and previous not in used and (cue or not gap(i).strip() or re.fullmatch(r"\s*(?:of|for)?\s*", gap(i))):
            target = previous.target
            used.add(previous)
        elif previous is not None and previous.kind == "value" and predicates and re.fullmatch(r"\s*(?:,|and|or|,?\s*or)\s*", gap(i), re.I):
            target, operator = predicates[-1].column, predicates[-1].operator
        elif i + 1 < len(g.mentions) and g.mentions[i + 1].kind == "column" and re.fullmatch(r"\s*(?:by)?\s*", gap(i + 1)):
            target = g.mentions[i + 1].target
            used.add(g.mentions[i + 1])
        elif previous is not None and previous.kind == "table" and cue in ("named", "called"):
            target = _name_column(catalog, previous.target)
        elif re.search(rf"\b(?:{'|'.join(LOCATIVES)})\s+$", gap(i), re.I) and location_column(catalog, tuple(tables)):
            target = location_column(catalog, tuple(tables))
        elif column is not None and cue:
            target = column.target
            used.add(column)
        else:
            raise AnalysisError("unbound_value", str(m.target))
        predicates.append(Predicate(target, operator, m.target))
        used.add(m)
    def said(cue: str) -> bool:
        """Whether a cue occurs apart from the mentions: a column may be called total."""
        return any(all(e <= m.start or m.end <= s for m in g.mentions) for s, e in _occurrences(lower, cue))

    aggregate = next((AGGREGATE_CUES[c] for c in sorted(AGGREGATE_CUES, key=len, reverse=True) if said(c)), None)
    asked = list(dict.fromkeys(m.target for m in g.mentions if m.kind == "column" and m not in used))
    connector = "OR" if len(predicates) > 1 and re.search(r"\bor\b", lower) else "AND"
    if connector == "OR" and re.search(r"\band\b", question[min(m.end for m in g.mentions if m.kind == "value") :].lower()) and len(predicates) > 2:
        raise AnalysisError("mixed_filter_connectors")
    names = [*asked, *group_by, *(p.column for p in predicates), *([order_by] if order_by else [])]
    if not tables:
        owners = [set(catalog.owners(n.rpartition(".")[2])) for n in names]
        common = set.intersection(*owners) if owners else set()
        if len(common) != 1:
            raise AnalysisError("no_table_mentioned")
        tables = list(common)
    plan = {"table": _base_table(g, tables), "predicates": tuple(predicates), "connector": connector, "order_by": order_by, "descending": descending, "limit": limit}
    if aggregate:
        target = asked[0] if asked and not (aggregate == "COUNT" and not re.search(r"\bcolumn\b", lower)) else None
        if aggregate != "COUNT" and target is None:
            raise AnalysisError("aggregate_without_column", aggregate)
        plan |= {"aggregate": aggregate, "aggregate_column": target, "columns": tuple(group_by), "group_by": tuple(group_by), "aggregate_position": len(group_by)}
    else:
        plan |= {"columns": tuple(asked) or ("*" if len(tables) == 1 else f"{_base_table(g, tables)}.*",), "distinct": any(map(said, DISTINCT_CUES))}
        if group_by:
            raise AnalysisError("group_without_aggregate")
    return analyze(catalog, _joined(catalog, LogicalQuery(**plan), tables))


def _base_table(g: Grounded, tables: list[str]) -> str:
    """The second of two adjacent table nouns, else the first mentioned."""
    for a, b in zip(g.mentions, g.mentions[1:], strict=False):
        if a.kind == b.kind == "table" and a.target != b.target and not g.question[a.end : b.start].strip():
            return b.target
    return tables[0]


def _joined(catalog: Catalog, plan: LogicalQuery, tables: list[str]) -> LogicalQuery:
    if len(tables) > 2:
        raise AnalysisError("too_many_tables", ", ".join(tables))
    if len(tables) == 2:
        other = next(t for t in tables if t != plan.table)
        keys = catalog.joins(plan.table, other)
        if len(keys) != 1:
            raise AnalysisError("ambiguous_join" if keys else "disconnected_tables", ", ".join(tables))
        k = keys[0]
        return plan.replace(join_table=other, join_on=(f"{k.child}.{k.child_column}", f"{k.parent}.{k.parent_column}"))
    return plan


def _name_column(catalog: Catalog, table: str) -> str:
    found = [c.name for c in catalog.table(table).columns if identifier_words(c.name)[-1] == "name"]
    if len(found) != 1:
        raise AnalysisError("ambiguous_name_column", table)
    return f"{table}.{found[0]}"


# --- rules for plans from elsewhere ---


def drop_unmentioned(plan: LogicalQuery, question: str) -> LogicalQuery:
    """Without predicates whose value the question does not mention."""
    return plan.replace(predicates=tuple(p for p in plan.predicates if isinstance(p.value, Slot) or mentions(question, p.value)))


def repair_location(catalog: Catalog, plan: LogicalQuery, question: str) -> LogicalQuery:
    """Move the one predicate of a single-table plan to the table's only place column, if its own
    column is not the table's and the question names its value as a place."""
    if plan.join_table or len(plan.predicates) != 1 or plan.predicates[0].operator != "=":
        return plan
    p = plan.predicates[0]
    if catalog.table(plan.table).column(p.column.rpartition(".")[2]):
        return plan
    place = location_column(catalog, (plan.table,))
    named = re.search(rf"\b(?:{'|'.join(LOCATIVES)}|for)\s+'?{re.escape(str(p.value))}\b", question, re.I)
    return plan.replace(predicates=(Predicate(place, p.operator, p.value),)) if place and named else plan


MODES = ("fallback", "replace", "prefer", "confidence", "disabled")


def combine(mode: str, own: LogicalQuery | None, other: LogicalQuery | None, confidence: float = 1.0, threshold: float = 0.5) -> LogicalQuery | None:
    """Which of two candidate plans to use.

    fallback: own, else other; prefer: other, else own; replace: other only; confidence: other if it
    is confident enough, else own; disabled: own only.
    """
    if mode not in MODES:
        raise Rejected("unknown_mode", mode)
    if mode == "disabled":
        return own
    if mode == "replace":
        return other
    if mode == "confidence":
        return other if other is not None and confidence >= threshold else own
    first, second = (own, other) if mode == "fallback" else (other, own)
    return first if first is not None else second


def substitute_roles(catalog: Catalog, plan: LogicalQuery, roles: dict[str, str], confidence: dict[str, float] | None = None, threshold: float = 0.0) -> LogicalQuery:
    """Replace roles (table, join_table, column0.., filter0.., group0.., order) by given names, if confident.

    The result is analysed, so a substitution that doesn't fit is an error.
    """
    sure = {k: v for k, v in roles.items() if (confidence or {}).get(k, 1.0) >= threshold}

    def pick(prefix: str, values: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(sure.get(f"{prefix}{i}", v) for i, v in enumerate(values))

    names = pick("filter", tuple(p.column for p in plan.predicates))
    join_table = sure.get("join_table", plan.join_table) if plan.join_table else None
    moved = join_table != plan.join_table or sure.get("table", plan.table) != plan.table
    new = plan.replace(
        table=sure.get("table", plan.table), join_table=join_table, join_on=None if moved else plan.join_on, columns=pick("column", plan.columns), group_by=pick("group", plan.group_by),
        order_by=sure.get("order", plan.order_by) if plan.order_by else None, aggregate_column=sure.get("aggregate", plan.aggregate_column) if plan.aggregate_column else None,
        predicates=tuple(Predicate(n, p.operator, p.value) for n, p in zip(names, plan.predicates, strict=True)),
    )
    if join_table and new.join_on is None:
        new = _joined(catalog, new.replace(join_table=None), [new.table, join_table])
    return analyze(catalog, new)


def assemble(catalog: Catalog, operations: dict, links: dict[str, list[str]], literals: list[str]) -> LogicalQuery | None:
    """A plan from operation labels, linked names and copied literals; None if they don't make one.

    A literal becomes an integer or a real number if it is written as one.
    """
    def typed(text: str):
        if re.fullmatch(r"-?\d+", text):
            return int(text)
        return float(text) if re.fullmatch(r"-?\d+\.\d+", text) else text

    signs = operations.get("operators", [])
    columns = links.get("filters", [])
    if not len(signs) == len(columns) == len(literals):
        return None
    try:
        plan = LogicalQuery(
            table=links["table"][0], columns=tuple(links.get("columns", ())), aggregate=operations.get("aggregate"), aggregate_column=(links.get("aggregate") or [None])[0],
            aggregate_position=operations.get("position", 0), distinct=bool(operations.get("distinct")), predicates=tuple(Predicate(c, s, typed(v)) for c, s, v in zip(columns, signs, literals, strict=True)),
            connector=operations.get("connector", "AND"), group_by=tuple(links.get("group", ())), order_by=(links.get("order") or [None])[0], descending=bool(operations.get("descending")), limit=operations.get("limit"),
        )
        joined = links.get("join_table")
        return analyze(catalog, _joined(catalog, plan, [plan.table, joined[0]]) if joined else plan)
    except (Rejected, KeyError, IndexError):
        return None


def schema_of_slots(catalog: Catalog, permuted: bool = False) -> str:
    """The DDL with slots for names."""
    tables, columns = slots(catalog, permuted)
    out = []
    for t in catalog.tables:
        lines = []
        for c in t.columns:
            key = next((k for k in catalog.foreign_keys if (k.child, k.child_column) == (t.name, c.name)), None)
            lines.append(f"{columns[c.name]} {c.type}" + " PRIMARY KEY" * c.primary_key + (f" REFERENCES {tables[key.parent]}({columns[key.parent_column]})" if key else ""))
        out.append(f"CREATE TABLE {tables[t.name]} ({', '.join(lines)});")
    return "\n".join(out)


def plan_to_slots(catalog: Catalog, plan: LogicalQuery, values: list, permuted: bool = False) -> LogicalQuery:
    """Names and values of a plan as slots; ``plan_from_slots`` is the inverse."""
    tables, columns = slots(catalog, permuted)
    number = {(type(v), str(v).casefold()): Slot(f"value{i}") for i, v in enumerate(values, 1)}
    return _renamed(plan, {k.casefold(): v for k, v in tables.items()}, {k.casefold(): v for k, v in columns.items()}, lambda v: number.get((type(v), str(v).casefold()), v))


def plan_from_slots(catalog: Catalog, plan: LogicalQuery, values: dict, permuted: bool = False) -> LogicalQuery:
    tables, columns = slots(catalog, permuted)
    return _renamed(plan, {v: k for k, v in tables.items()}, {v: k for k, v in columns.items()}, lambda v: values.get(v.name, v) if isinstance(v, Slot) else v)


def _renamed(plan: LogicalQuery, tables: dict[str, str], columns: dict[str, str], value) -> LogicalQuery:
    def name(ref: str | None) -> str | None:
        if ref is None or ref == "*":
            return ref
        table, _, column = ref.rpartition(".")
        new = "*" if column == "*" else columns[column.casefold()]
        return f"{tables[table.casefold()]}.{new}" if table else new

    return plan.replace(
        table=tables[plan.table.casefold()], join_table=plan.join_table and tables[plan.join_table.casefold()], join_on=tuple(map(name, plan.join_on)) if plan.join_on else None, columns=tuple(map(name, plan.columns)),
        aggregate_column=name(plan.aggregate_column), group_by=tuple(map(name, plan.group_by)), order_by=name(plan.order_by), predicates=tuple(Predicate(name(p.column), p.operator, value(p.value)) for p in plan.predicates),
    )


def only_known_names(catalog: Catalog, sql: str) -> bool:
    """Whether every word of a statement, outside literals, is a keyword or a name of the catalog."""
    from planloom.plans.sqlform import RESERVED, tokenize

    known = {n.casefold() for t in catalog.tables for n in (t.name, *(c.name for c in t.columns))} | {"count", "sum", "avg", "min", "max"}
    return all(t.kind != "word" or t.upper in RESERVED or t.text.casefold() in known for t in tokenize(sql))


def legend(catalog: Catalog, question: str, most_tables: int = 5, most_columns: int = 8) -> str:
    """Readable labels of the slots, the ones that share words with the question first."""
    tables, columns = slots(catalog)
    asked = set(re.findall(r"[a-z0-9]+", question.lower()))

    def ranked(names: dict[str, str], most: int) -> list[str]:
        order = sorted(names, key=lambda n: (-len(asked & set(identifier_words(n))), list(names).index(n)))
        return [f"{names[n]}={' '.join(identifier_words(n))}" for n in order[:most]]

    return "; ".join([*ranked(tables, most_tables), *ranked(columns, most_columns)])


__all__ = ["ground", "question_plan", "qualify"]
