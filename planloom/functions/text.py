"""Text functions: normal forms, identifiers, numbers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planloom.plans.errors import Rejected

# Words that are keywords in a DDL script.
DDL_WORDS = ("create", "table", "integer", "real", "text", "primary", "key", "references")
RESERVED_HEADERS = frozenset(
    "alter analyze and as attach by case create delete detach distinct drop exists from group having in index insert join limit not null on or order pragma references "
    "returning select table trigger union update vacuum values view where with".split()
)


def folded(column: Column | str) -> Column:
    """Lower case, white space collapsed and trimmed, by native functions."""
    return F.lower(F.trim(F.regexp_replace(column, r"\s+", " ")))


def nfkc_folded(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(T.StringType())
def nfkc_fold(texts: pd.Series) -> pd.Series:
    """NFKC and case folding, for which Spark has no function.  Null stays null."""
    return texts.map(nfkc_folded, na_action="ignore")


def normalized_sql(column: Column | str) -> Column:
    """For exact match: blanks collapsed, final ';' dropped, lower case, literals too."""
    return F.trim(F.regexp_replace(folded(column), r"[;\s]+$", ""))


def identifiers(column: Column | str) -> Column:
    """Distinct identifiers of a DDL text, lower case, without keywords."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, DDL_WORDS)))


def words(column: Column | str) -> Column:
    """Distinct words of letters and digits, lower case; underscores separate."""
    return F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r"[a-z0-9]+"), F.lit(0)))


def token_overlap(left: Column, right: Column) -> Column:
    """Share of the right array's words that are in the left; null if it has none."""
    return F.when(F.size(right) > 0, F.size(F.array_intersect(left, right)) / F.size(right))


def singular(word: str) -> str:
    """By ending only."""
    for ending, instead in (("ies", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("zes", "z")):
        if word.endswith(ending) and len(word) > len(ending):
            return word[: -len(ending)] + instead
    return word[:-1] if word.endswith("s") and not word.endswith(("ss", "us")) and len(word) > 1 else word


def plural(word: str) -> str:
    if word.endswith("y") and len(word) > 1 and word[-2] not in "aeiou":
        return word[:-1] + "ies"
    return word + "es" if word.endswith(("s", "sh", "ch", "x", "z")) else word + "s"


def identifier_words(name: str) -> tuple[str, ...]:
    """The words of a styled identifier: camel case and underscores divided, markers dropped."""
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()
    parts = [p for p in text.split("_") if p]
    if len(parts) > 1 and parts[0] in ("tbl", "col"):
        parts = parts[1:]
    if len(parts) > 1 and parts[-1] in ("data", "value"):
        parts = parts[:-1]
    return tuple(parts)


def humanized(name: str) -> str:
    return " ".join(identifier_words(name))


def aliases(name: str) -> tuple[str, ...]:
    """Ways in which a question may write an identifier, likeliest first."""
    parts = identifier_words(name)
    last = parts[-1]
    variants = [parts, (*parts[:-1], singular(last)), (*parts[:-1], plural(singular(last)))]
    found = [name.lower()]
    for v in variants:
        found += [" ".join(v), "_".join(v), "-".join(v), "/".join(v)]
    if len(parts) > 1 and last in ("id", "key", "identifier"):
        # the entity is often made plural instead of the key, or both are
        for entity, key in product(*({singular(w): 0, plural(singular(w)): 0} for w in parts[-2:])):
            found += [" ".join((*parts[:-2], entity, key)), "_".join((*parts[:-2], entity, key))]
    if len(parts) > 1 and last == "id":
        found += [f"{' '.join(parts[:-1])} ids", f"{' '.join(parts[:-1])} number", f"{' '.join(parts[:-1])} key"]
    return tuple(dict.fromkeys(found))


def mentions(text: str, value: str | int | float) -> bool:
    """Whether a value stands in a text as a whole token, whatever its case."""
    token = str(value)
    return bool(token) and re.search(rf"(?<!\w){re.escape(token)}(?!\w)", text, re.I) is not None


def header_identifier(header: str) -> str:
    """A safe column name from any header."""
    ascii_ = unicodedata.normalize("NFKD", header).encode("ascii", "ignore").decode().lower()
    name = re.sub(r"[^a-z0-9]+", "_", ascii_).strip("_") or "column"
    if name[0].isdigit():
        name = f"c_{name}"
    return f"field_{name}" if name in RESERVED_HEADERS else name


def header_identifiers(headers: Iterable[str]) -> list[str]:
    """Safe names that also differ: later ones get a number."""
    used: set[str] = set()
    out = []
    for header in headers:
        base = name = header_identifier(header)
        n = 2
        while name in used:
            name, n = f"{base}_{n}", n + 1
        used.add(name)
        out.append(name)
    return out


def number(value) -> int | float | None:
    """The first number in a cell, commas dropped; an integer if it is one and fits 64 bits."""
    if value is None or isinstance(value, bool):
        return None
    match = re.search(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", str(value).replace(",", ""))
    if not match:
        return None
    found = float(match[0])
    if found.is_integer() and abs(found) < 2**63:
        return int(match[0]) if re.fullmatch(r"[-+]?\d+", match[0]) else int(found)
    return found


def required_number(value) -> int | float:
    """As ``number``, but a cell without a number is rejected with a reason."""
    found = number(value)
    if found is None:
        raise Rejected("numeric_conversion_error", str(value))
    return found


def number_column(column: Column | str) -> Column:
    """The same as a double, by native functions."""
    found = F.regexp_extract(F.regexp_replace(column, ",", ""), r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return F.nullif(found, F.lit("")).try_cast("double")
