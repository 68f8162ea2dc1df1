"""Sinks: JSONL with sorted fields, reports, atomic folders, table dumps, manifests."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.utils import AnalysisException

from planloom.plans.catalog import Catalog
from planloom.plans.errors import Rejected


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line, fields in order of their names; the folder has a _SUCCESS mark once complete."""
    try:
        df.select(*sorted(df.columns)).write.mode(mode).json(path)
    except AnalysisException as e:
        raise Rejected("output_exists", path) from e


def report_json(report: dict[str, DataFrame], path: str | None = None, most: int = 100_000) -> str:
    """Aggregates as one JSON object with sorted keys; a part with too many rows is an error."""
    out = {}
    for name, df in report.items():
        rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
        if len(rows) > most:
            raise Rejected("report_part_too_large", name)
        out[name] = sorted(rows, key=lambda r: json.dumps(r, sort_keys=True, default=str))
    text = json.dumps(out, sort_keys=True, indent=1, default=str)
    if path:
        Path(path).write_text(text)
    return text


def publish(target: str, build: Callable[[str], None]) -> str:
    """Build a local folder beside its place and rename it there; never over an existing one."""
    place = Path(target)
    if place.exists():
        raise Rejected("output_exists", target)
    place.parent.mkdir(parents=True, exist_ok=True)
    temporary = tempfile.mkdtemp(prefix=f".{place.name}-", dir=place.parent)
    try:
        build(temporary)
        os.rename(temporary, place)
    except BaseException:
        shutil.rmtree(temporary, ignore_errors=True)
        raise
    return target


def dump_catalog(catalog: Catalog, path: str, mode: str = "errorifexists") -> None:
    """Every table as Parquet under a folder."""
    for table in catalog.tables:
        catalog.frame(table.name).write.mode(mode).parquet(f"{path}/{table.name}.parquet")


def sample_table(df: DataFrame, rows: int = 8) -> str:
    """The first rows as a Markdown table."""
    names = df.columns
    body = [[str(v).replace("|", "\\|").replace("\n", " ") for v in r] for r in df.limit(rows).collect()]
    return "\n".join("| " + " | ".join(line) + " |" for line in [names, ["-"] * len(names), *body])
