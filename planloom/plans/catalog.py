"""Tables, keys and their DataFrames; DDL parsing; fingerprints."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from planloom.plans.errors import AnalysisError, Rejected
from planloom.plans.logical import IDENTIFIER

_NAME = re.compile(IDENTIFIER)


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "TEXT"
    primary_key: bool = False

    @property
    def affinity(self) -> str:
        """``text``, ``numeric`` or ``other``, from the declared type."""
        t = self.type.upper()
        if any(k in t for k in ("CHAR", "CLOB", "TEXT", "STRING")):
            return "text"
        return "numeric" if any(k in t for k in ("INT", "REAL", "FLOA", "DOUB", "NUM", "DEC", "LONG")) else "other"


@dataclass(frozen=True)
class ForeignKey:
    child: str
    child_column: str
    parent: str
    parent_column: str

    def edge(self) -> frozenset[str]:
        return frozenset({f"{self.child}.{self.child_column}".casefold(), f"{self.parent}.{self.parent_column}".casefold()})


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.casefold() == name.casefold()), None)


@dataclass
class Catalog:
    tables: tuple[Table, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()
    frames: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def table(self, name: str) -> Table:
        found = next((t for t in self.tables if t.name.casefold() == name.casefold()), None)
        if found is None:
            raise AnalysisError("unknown_table", name)
        return found

    def frame(self, name: str) -> DataFrame:
        return self.frames[self.table(name).name]()

    def owners(self, column: str, among: Iterable[str] | None = None) -> tuple[str, ...]:
        """Tables that have a column of this name."""
        chosen = [self.table(n) for n in among] if among is not None else self.tables
        return tuple(t.name for t in chosen if t.column(column))

    def joins(self, left: str, right: str) -> tuple[ForeignKey, ...]:
        """Declared keys between two tables, either way round."""
        pair = {left.casefold(), right.casefold()}
        return tuple(k for k in self.foreign_keys if {k.child.casefold(), k.parent.casefold()} == pair and len(pair) == 2)

    def edges(self) -> frozenset[frozenset[str]]:
        return frozenset(k.edge() for k in self.foreign_keys)

    def ddl(self) -> str:
        """CREATE TABLE statements in table order, with single-column keys inline."""
        out = []
        for t in self.tables:
            lines = []
            for c in t.columns:
                key = next((k for k in self.foreign_keys if (k.child, k.child_column) == (t.name, c.name)), None)
                lines.append(f"{c.name} {c.type}" + " PRIMARY KEY" * c.primary_key + (f" REFERENCES {key.parent}({key.parent_column})" if key else ""))
            out.append(f"CREATE TABLE {t.name} ({', '.join(lines)});")
        return "\n".join(out)

    @classmethod
    def of_frames(cls, frames: dict[str, DataFrame], foreign_keys: Iterable[ForeignKey] = (), primary_keys: dict[str, str] | None = None) -> Catalog:
        keys = primary_keys or {}
        tables = tuple(Table(n, tuple(Column(f.name, f.dataType.simpleString().upper(), keys.get(n) == f.name) for f in df.schema)) for n, df in frames.items())
        return cls(tables, tuple(foreign_keys), {n: (lambda df=df: df) for n, df in frames.items()})


def split_fields(body: str) -> list[str]:
    """Parts between commas outside quotes and parentheses."""
    parts, part, depth, quote = [], [], 0, ""
    for c in body:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        else:
            depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and not depth and not quote:
            parts.append("".join(part).strip())
            part = []
        else:
            part.append(c)
    return [p for p in [*parts, "".join(part).strip()] if p]


def parse_ddl(script: str) -> Catalog:
    """CREATE TABLE statements to a catalog without frames.

    Takes column-level and table-level keys; names must be plain identifiers.
    """
    tables: list[Table] = []
    keys: list[ForeignKey] = []
    for match in re.finditer(r"\bCREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\S+?)\s*\(", script, re.I):
        name, depth, at = match[1], 1, match.end()
        while at < len(script) and depth:
            depth += {"(": 1, ")": -1}.get(script[at], 0)
            at += 1
        if depth:
            raise Rejected("unclosed_table", name)
        if not _NAME.fullmatch(name):
            raise Rejected("unsupported_schema_identifier", name)
        columns: list[Column] = []
        primary: set[str] = set()
        for part in split_fields(script[match.end() : at - 1]):
            words = part.split(None, 1)
            head = words[0].upper().split("(")[0]
            if head == "CONSTRAINT":
                part = part.split(None, 2)[2]
                head = part.split(None, 1)[0].upper()
            if head == "PRIMARY" or head.startswith("PRIMARY"):
                primary |= {x.strip().casefold() for x in part[part.index("(") + 1 : part.rindex(")")].split(",")}
                continue
            if head.startswith("FOREIGN"):
                k = re.search(r"\(\s*([^,)]+?)\s*\)\s*REFERENCES\s+(\w+)\s*\(\s*([^,)]+?)\s*\)", part, re.I)
                if k:
                    keys.append(ForeignKey(name, k[1], k[2], k[3]))
                continue
            if head.split("(")[0] in ("UNIQUE", "CHECK"):
                continue
            if not _NAME.fullmatch(words[0]):
                raise Rejected("unsupported_schema_identifier", words[0])
            rest = words[1] if len(words) > 1 else ""
            k = re.search(r"\bREFERENCES\s+(\w+)\s*(?:\(\s*(\w+)\s*\))?", rest, re.I)
            if k:
                keys.append(ForeignKey(name, words[0], k[1], k[2] or words[0]))
            kind = re.split(r"\b(?:PRIMARY|REFERENCES|NOT|NULL|DEFAULT|UNIQUE|CHECK|COLLATE)\b", rest, maxsplit=1, flags=re.I)[0].strip()
            columns.append(Column(words[0], kind or "TEXT", bool(re.search(r"\bPRIMARY\s+KEY\b", rest, re.I))))
        names = [c.name.casefold() for c in columns]
        if not columns or len(set(names)) < len(names):
            raise Rejected("duplicate_or_missing_columns", name)
        tables.append(Table(name, tuple(Column(c.name, c.type, c.primary_key or c.name.casefold() in primary) for c in columns)))
    if len({t.name.casefold() for t in tables}) < len(tables):
        raise Rejected("case_colliding_table_identifiers")
    return Catalog(tuple(tables), tuple(keys))


def from_metadata(meta: dict) -> Catalog:
    """Index-based metadata (table and column names, types, keys) to a catalog.

    Types: time and text are TEXT, number is REAL, boolean is INTEGER, others TEXT.
    """
    kinds = {"text": "TEXT", "time": "TEXT", "number": "REAL", "boolean": "INTEGER"}
    try:
        names, columns, types = meta["table_names_original"], meta["column_names_original"], meta["column_types"]
        primary, foreign = set(meta.get("primary_keys", ())), meta.get("foreign_keys", ())
    except KeyError as e:
        raise Rejected("invalid_schema_metadata", str(e)) from e
    if len(columns) != len(types):
        raise Rejected("invalid_schema_metadata", "columns and types differ")
    if not all(_NAME.fullmatch(n) for n in names):
        raise Rejected("unsupported_schema_identifier")
    if len({n.casefold() for n in names}) < len(names):
        raise Rejected("case_colliding_table_identifiers")
    tables = []
    for i, name in enumerate(names):
        own = [(c, types[j], j in primary) for j, (t, c) in enumerate(columns) if t == i]
        if not all(_NAME.fullmatch(c) for c, _, _ in own):
            raise Rejected("unsupported_schema_identifier", name)
        if not own:
            raise Rejected("duplicate_or_missing_columns", name)
        if len({c.casefold() for c, _, _ in own}) < len(own):
            raise Rejected("case_colliding_column_identifiers", name)
        if {c.casefold() for c, _, _ in own} & {n.casefold() for n in names}:
            raise Rejected("table_column_identifier_overlap", name)
        tables.append(Table(name, tuple(Column(c, kinds.get(t, "TEXT"), p) for c, t, p in own)))
    keys = []
    for pair in foreign:
        if len(pair) != 2 or not all(isinstance(x, int) and 0 <= x < len(columns) for x in pair):
            raise Rejected("invalid_foreign_key_metadata", repr(pair))
        (a, x), (b, y) = columns[pair[0]], columns[pair[1]]
        if a < 0 or b < 0:
            raise Rejected("unsupported_foreign_key_metadata", repr(pair))
        keys.append(ForeignKey(names[a], x, names[b], y))
    return Catalog(tuple(tables), tuple(keys))


def fingerprint(ddl: str) -> str:
    """Equal for scripts that differ in white space only."""
    text = re.sub(r"\s*([(),;])\s*", r"\1", re.sub(r"\s+", " ", ddl.strip()))
    return hashlib.sha256(text.encode()).hexdigest()


def slots(catalog: Catalog, permuted: bool = False) -> tuple[dict[str, str], dict[str, str]]:
    """(tables, columns) to tableN and columnN: by appearance, or by a hash of fingerprint and name.

    One column slot stands for a name, whichever tables own it.
    """
    tables = [t.name for t in catalog.tables]
    columns = list(dict.fromkeys(c.name for t in catalog.tables for c in t.columns))
    if permuted:
        mark = fingerprint(catalog.ddl())

        def key(space: str) -> Callable[[str], str]:
            return lambda name: hashlib.sha256("\0".join((mark, space, name)).encode()).hexdigest()

        tables, columns = sorted(tables, key=key("table")), sorted(columns, key=key("column"))
    return {n: f"table{i}" for i, n in enumerate(tables, 1)}, {n: f"column{i}" for i, n in enumerate(columns, 1)}


#: The star schema of the test tables.
STAR_DDL = """
CREATE TABLE region (r_regionkey INT PRIMARY KEY, r_name STRING);
CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name STRING, n_regionkey INT REFERENCES region(r_regionkey));
CREATE TABLE customer (c_custkey BIGINT PRIMARY KEY, c_name STRING, c_nationkey INT REFERENCES nation(n_nationkey), c_acctbal DOUBLE, c_mktsegment STRING);
CREATE TABLE supplier (s_suppkey BIGINT PRIMARY KEY, s_name STRING, s_nationkey INT REFERENCES nation(n_nationkey), s_acctbal DOUBLE);
CREATE TABLE part (p_partkey BIGINT PRIMARY KEY, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE);
CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT REFERENCES customer(c_custkey), o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority STRING);
CREATE TABLE lineitem (l_orderkey BIGINT REFERENCES orders(o_orderkey), l_partkey BIGINT REFERENCES part(p_partkey), l_suppkey BIGINT REFERENCES supplier(s_suppkey), l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP);
CREATE TABLE events (event_id BIGINT PRIMARY KEY, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING);
CREATE TABLE documents (doc_id BIGINT PRIMARY KEY, text STRING, lang STRING, source STRING, n_chars BIGINT);
CREATE TABLE labels (doc_id BIGINT REFERENCES documents(doc_id), quality INT, toxic INT);
"""


def star_catalog(spark: SparkSession | None = None, sf_dir: str = "") -> Catalog:
    """The star schema; with a session, its frames read Parquet when first used."""
    catalog = parse_ddl(STAR_DDL)
    if spark is not None:
        catalog.frames = {t.name: (lambda n=t.name: spark.read.parquet(f"{sf_dir}/{n}.parquet")) for t in catalog.tables}
    return catalog
