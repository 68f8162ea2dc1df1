"""Sources: JSONL, Parquet splits, archives, SQLite, prediction files, metadata, table rows."""

from __future__ import annotations

import bz2
import hashlib
import io
import json
import sqlite3
import tarfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planloom.functions.text import header_identifiers, number
from planloom.plans.catalog import Catalog, parse_ddl
from planloom.plans.errors import Rejected
from planloom.plans.logical import PLAN_STRUCT

#: The row type of a corpus.  ``pos`` is the stable input position.
RECORD_SCHEMA = (
    "id string, schema_id string, schema_sql string, database_sql string, database_path string, question string, sql string, difficulty int, seed bigint, pos bigint, "
    f"query_plan {PLAN_STRUCT}, source struct<dataset:string,revision:string,split:string,db_id:string,original_sql:string,training_use_allowed:boolean>, "
    "counterfactual_group string, counterfactual_change string, anti_memorization_pair string, anti_memorization_track string, composition_novelty string, semantic_linking_track string, evaluation_track string"
)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str = RECORD_SCHEMA, tag: str | None = None) -> DataFrame:
    """Records by an explicit schema; blank lines are skipped, a line that is no record is an error.

    ``tag`` adds the folder that relative database paths start from.
    """
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.withColumn("database_base_dir", F.lit(tag)) if tag is not None else df


def read_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Parquet files by split, with a ``split`` column."""
    parts = [spark.read.parquet(path).withColumn("split", F.lit(split)) for split, path in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def discover_training(spark: SparkSession, root: str, schema: str = RECORD_SCHEMA, excluding: str | None = None) -> DataFrame:
    """All records of files named train, mixed_train or *_train (.jsonl) under a folder."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*train.jsonl").json(root)
    df = df.withColumn("file", F.input_file_name())
    df = df.where(F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).rlike(r"^(train|mixed_train|.*_train)$"))
    return df.where(~F.contains(F.col("file"), F.lit(excluding))) if excluding else df


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(pos, prediction): each line is SQL or an object with ``sql``; order is the line number.

    Files may be split: lines are ranked within a split and shifted by the counts of the
    splits before; several files follow each other by path.  Blank lines have no position.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    bases = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n")).select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    sql = F.when(F.ltrim("value").startswith("{"), F.get_json_object("value", "$.sql")).otherwise(F.trim("value"))
    ranked = lines.withColumn("nth", F.row_number().over(Window.partitionBy("file", "start").orderBy("at"))).join(bases, ["file", "start"])
    return ranked.select((F.col("base") + F.col("nth") - 1).cast("long").alias("pos"), sql.alias("prediction"))


def file_hash(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file, on the executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def checked(path: str, sha256: str | None) -> str:
    if sha256 is not None and file_hash(path) != sha256:
        raise Rejected("checksum_mismatch", path)
    return path


def read_tar_jsonl(spark: SparkSession, path: str, member: str, schema: str, sha256: str | None = None) -> DataFrame:
    """One JSONL member of a tar.bz2, checked first."""
    with tarfile.open(checked(path, sha256), "r:bz2") as archive:
        data = archive.extractfile(member)
        if data is None:
            raise Rejected("missing_member", member)
        rows = [json.loads(line) for line in io.TextIOWrapper(data, "utf-8") if line.strip()]
    return spark.createDataFrame(rows, schema)


def read_bz2_lines(path: str) -> list[dict]:
    with bz2.open(path, "rt", encoding="utf-8") as f:
        return [json.loads(line) for line in f if line.strip()]


def extract_zip(path: str, target: str, suffix: str = ".sqlite", sha256: str | None = None) -> list[str]:
    """Members with a suffix, to a folder; a member that would leave it is an error."""
    root = Path(target).resolve()
    out = []
    with zipfile.ZipFile(checked(path, sha256)) as archive:
        for info in archive.infolist():
            if not info.filename.endswith(suffix):
                continue
            place = (root / info.filename).resolve()
            if root not in place.parents:
                raise Rejected("unsafe_member", info.filename)
            place.parent.mkdir(parents=True, exist_ok=True)
            place.write_bytes(archive.read(info))
            out.append(str(place))
    return sorted(out)


def zip_json(path: str, member: str):
    with zipfile.ZipFile(path) as archive:
        return json.loads(archive.read(member))


def _spark_type(declared: str) -> T.DataType:
    upper = declared.upper()
    if "INT" in upper:
        return T.LongType()
    return T.DoubleType() if any(k in upper for k in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else T.StringType()


def _typed(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else str(value)
    found = number(value)
    if found is None:
        return None
    return int(found) if isinstance(kind, T.LongType) and float(found).is_integer() else float(found) if isinstance(kind, T.DoubleType) else None


def sqlite_catalog(spark: SparkSession, path: str | None = None, script: str | None = None) -> Catalog:
    """A small SQLite database, from a file opened read-only or a script, as frames."""
    connection = sqlite3.connect(f"file:{path}?mode=ro", uri=True) if path else sqlite3.connect(":memory:")
    try:
        if script:
            connection.executescript(script)
        ddl = [r[0] for r in connection.execute("SELECT sql FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        catalog = parse_ddl(";\n".join(ddl) + ";")
        for table in catalog.tables:
            kinds = [_spark_type(c.type) for c in table.columns]
            names = ", ".join(c.name for c in table.columns)
            rows = [tuple(_typed(v, k) for v, k in zip(r, kinds, strict=True)) for r in connection.execute(f"SELECT {names} FROM {table.name}")]
            schema = T.StructType([T.StructField(c.name, k) for c, k in zip(table.columns, kinds, strict=True)])
            frame = spark.createDataFrame(rows, schema)
            catalog.frames[table.name] = lambda frame=frame: frame
        return catalog
    finally:
        connection.close()


def record_catalog(spark: SparkSession, record: dict, base_dir: str | None = None) -> Catalog:
    """The database of a record: its file, else its database script, else its schema script."""
    if record.get("database_path"):
        path = Path(record["database_path"])
        return sqlite_catalog(spark, str(path if path.is_absolute() else Path(base_dir or record.get("database_base_dir") or ".") / path))
    return sqlite_catalog(spark, script=record.get("database_sql") or record["schema_sql"])


def table_from_rows(spark: SparkSession, header: list[str], kinds: list[str], rows: list[list], name: str = "source_table") -> Catalog:
    """A free-form table with safe column names and coerced cells: kind ``real`` to a number, else text."""
    if not header or len(header) != len(kinds):
        raise Rejected("invalid_table_schema")
    names = header_identifiers(header)
    types = [T.DoubleType() if k == "real" else T.StringType() for k in kinds]
    out = []
    for row in rows:
        if len(row) != len(names):
            raise Rejected("invalid_table_row")
        out.append(tuple(None if v is None else (None if number(v) is None else float(number(v))) if isinstance(t, T.DoubleType) else str(v) for v, t in zip(row, types, strict=True)))
    frame = spark.createDataFrame(out, T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)]))
    return Catalog.of_frames({name: frame})


def stored_casing(frame: DataFrame, column: str, value: str) -> str | None:
    """The first stored spelling, by order, of a value whatever its case."""
    row = frame.where(F.lower(column) == value.lower()).agg(F.min(column)).first()
    return row[0] if row else None
