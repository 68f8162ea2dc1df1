"""Secret scans over a trigram inverted index.

Each rule is a regular expression.  From its syntax tree a Boolean query over
trigrams is derived: literal runs that must occur give conjunctions, branches and
optional parts give disjunctions.  Texts are indexed slice by slice (postings of
the trigrams that any rule asks for, over ASCII-lower-cased UTF-8 bytes); a
rule's postings are intersected and united by its query, and only the texts that
remain are verified by the rule itself, over the whole text.  A rule without a
mandatory trigram scans every text.  Lower-casing and the query only ever widen
the candidates, so nothing is missed.

Defined cases: a null text is empty and has no spans; spans are in code points,
end exclusive; per rule they are leftmost and do not overlap; repeated rows give
repeated results; empty tables give empty results; other columns are ignored (or,
by ``redact``, returned as they were).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one index covers, more if a single text is longer.
SLICE_BYTES = 4 << 20
#: Strings that a literal part may stand for before its trigrams are taken.
MOST_STRINGS = 24


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = re.ASCII


# The three base kinds and public formats of issued credentials.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
ISSUED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + ISSUED

# --- Boolean trigram queries: True, a trigram, ("and", parts) or ("or", parts) ---


def _both(a, b):
    if a is True or b is True:
        return b if a is True else a
    return ("and", (a, b))


def _either(parts: list):
    if any(p is True for p in parts):
        return True
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: frozenset[str]):
    def one(s: str):
        data = s.encode("utf-8").lower()
        query = True
        for i in range(len(data) - 2):
            query = _both(query, data[i : i + 3])
        return query

    return _either([one(s) for s in sorted(strings)]) if strings else True


def _analyse(items) -> tuple[frozenset[str] | None, object]:
    """All strings that the part can be, if few; else a query that every match meets."""
    strings, query, whole = frozenset([""]), True, True
    for op, arg in items:
        found, needs = None, True
        if op is sre.LITERAL:
            found = frozenset([chr(arg)])
        elif op is sre.AT:
            found = frozenset([""])
        elif op is sre.IN and len(arg) <= 4 and all(o is sre.LITERAL for o, _ in arg):
            found = frozenset(chr(a) for _, a in arg)
        elif op is sre.SUBPATTERN:
            found, needs = _analyse(arg[3])
        elif op is sre.BRANCH:
            parts = [_analyse(p) for p in arg[1]]
            if all(s is not None for s, _ in parts):
                found = frozenset().union(*(s for s, _ in parts))
            else:
                needs = _either([q if s is None else _of_strings(s) for s, q in parts])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, part = arg
            inner, inner_needs = _analyse(part)
            if (least, most) == (0, 1) and inner is not None:
                found = inner | {""}
            elif least >= 1:
                needs = inner_needs if inner is None else _of_strings(inner)
        if found is not None and len(strings) * len(found) <= MOST_STRINGS:
            strings = frozenset(a + b for a in strings for b in found)
            continue
        query = _both(query, _of_strings(strings))
        whole = False
        strings = frozenset([""]) if found is None else found
        query = _both(query, needs)
    return (strings, True) if whole else (None, _both(query, _of_strings(strings)))


def trigram_query(pattern: str, flags: int = 0):
    strings, query = _analyse(_parser.parse(pattern, flags))
    return query if strings is None else _of_strings(strings)


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class TrigramIndex:
    """Postings of the asked trigrams over one slice of texts."""

    def __init__(self, texts: list[bytes], numbers: dict[bytes, int], lookup: np.ndarray):
        self.numbers = numbers
        self.postings = np.zeros((len(numbers) + 1, len(texts)), dtype=bool)
        data = np.frombuffer(b"\0".join(texts).lower(), dtype=np.uint8)
        if len(data) >= 3 and numbers:
            wide = data.astype(np.int32)
            found = lookup[(wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]]
            at = np.flatnonzero(found)
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])
            self.postings[found[at], np.searchsorted(starts, at, "right") - 1] = True

    def candidates(self, query) -> np.ndarray:
        if query is True:
            return np.ones(self.postings.shape[1], dtype=bool)
        if isinstance(query, bytes):
            return self.postings[self.numbers[query]]
        parts = [self.candidates(p) for p in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, _compiled(r), trigram_query(r.pattern, r.flags)) for r in rules]
        asked = sorted(set().union(*(trigrams_of(q) for _, _, q in self.rules)))
        self.numbers = {t: i + 1 for i, t in enumerate(asked)}
        self.lookup = np.zeros(1 << 24, dtype=np.uint8 if len(asked) < 255 else np.uint16)
        for t, i in self.numbers.items():
            self.lookup[int.from_bytes(t, "big")] = i

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Per text: (start, rule number, end) in order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for first, last in slices(texts):
            part = texts[first:last]
            index = TrigramIndex(part, self.numbers, self.lookup)
            chosen = [index.candidates(q) for _, _, q in self.rules]
            for i, data in enumerate(part):
                own = [n for n, c in enumerate(chosen) if c[i]]
                if not own or not data:
                    continue
                text = data.decode("utf-8")
                for n in own:
                    rule, pattern, _ = self.rules[n]
                    out[first + i] += [(m.start(), n, m.end()) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
                out[first + i].sort()
        return out


def _compiled(rule: Rule) -> re.Pattern:
    """A lone repeated class may as well demand its least length while it matches: runs are maximal."""
    parsed = list(_parser.parse(rule.pattern, rule.flags))
    lone = len(parsed) == 1 and parsed[0][0] is sre.MAX_REPEAT and parsed[0][1][0] == 1 and parsed[0][1][1] is sre.MAXREPEAT and [o for o, _ in parsed[0][1][2]] == [sre.IN]
    return re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}" if lone and rule.group == 0 and rule.least > 1 and rule.pattern.endswith("]+") else rule.pattern, rule.flags)


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    first = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def scan_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``found``, an array of (kind, start, end) by start, then rule."""
    names = [r.kind for r in rules]
    kind = df.schema[id_col].dataType.simpleString()
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in batches:
            spans = scanner.spans(batch.column(1).cast(pa.binary()).to_pylist())
            found = pa.array([[{"kind": names[n], "start": s, "end": e} for s, n, e in x] for x in spans], item)
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["id", "found"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(scan, f"id {kind}, found array<struct<kind:string,start:int,end:int>>").withColumnRenamed("id", id_col)


def redact(df: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every found span replaced by ``mark``."""
    at = df.columns.index(text_col)

    def scrub(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = scanner.spans([(t or "").encode("utf-8") for t in texts])
            new = [t if not s else _without(t, s, mark) for t, s in zip(texts, spans, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(scrub, df.schema)


def _without(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_<base kind>, base_sha256 and spans of ``scan_secrets``' result, by native functions."""
    def joined(column):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("found", lambda x: x["kind"].isin([r.kind for r in BASE]))
    kinds = F.transform("found", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
