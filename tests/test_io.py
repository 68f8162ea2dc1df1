import io
import json
import sqlite3
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from planloom.plans.compile import run_sql
from planloom.plans.errors import Rejected
from planloom.sources import files, sinks
from planloom.streaming import curate as streaming


def test_jsonl_and_predictions(spark, tmp_path):
    rows = [{"id": "a", "question": "q", "query_plan": {"family": "f", "filters": [{"column": "c", "operator": "=", "value_kind": "int", "value_int": 3}]}}, {"id": "b"}]
    (tmp_path / "x").mkdir()
    path = tmp_path / "x" / "mixed_train.jsonl"
    path.write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    df = files.read_jsonl(spark, str(path), tag="/base")
    assert df.count() == 2 and df.where("id = 'a'").first()["query_plan"]["filters"][0]["value_int"] == 3
    (tmp_path / "x" / "untrain.jsonl").write_text(json.dumps(rows[0]))
    assert files.discover_training(spark, str(tmp_path)).count() == 2 and files.discover_training(spark, str(tmp_path), excluding="/x/").count() == 0
    (tmp_path / "p.txt").write_text('SELECT 1\n\n{"sql": "SELECT 2"}\n')
    assert [tuple(r) for r in files.read_predictions(spark, str(tmp_path / "p.txt")).orderBy("pos").collect()] == [(0, "SELECT 1"), (1, "SELECT 2")]
    (tmp_path / "many.txt").write_text("\n".join(f"SELECT {i}" + "\n" * (i % 3) for i in range(300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        many = files.read_predictions(spark, str(tmp_path / "many.txt"))
        assert [tuple(r) for r in many.orderBy("pos").collect()] == [(i, f"SELECT {i}") for i in range(300)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    sinks.write_jsonl(df.select("question", "id"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "_SUCCESS").exists()
    with pytest.raises(Rejected, match="output_exists"):
        sinks.write_jsonl(df, str(tmp_path / "out"))
    assert files.file_hashes(spark, str(path)).first()["sha256"] == files.file_hash(str(path))


def test_archives(spark, tmp_path):
    data = b'{"a": 1}\n\n{"a": 2}\n'
    with tarfile.open(tmp_path / "t.tar.bz2", "w:bz2") as t:
        info = tarfile.TarInfo("d/x.jsonl")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    assert files.read_tar_jsonl(spark, str(tmp_path / "t.tar.bz2"), "d/x.jsonl", "a long").count() == 2
    with pytest.raises(Rejected, match="checksum"):
        files.read_tar_jsonl(spark, str(tmp_path / "t.tar.bz2"), "d/x.jsonl", "a long", sha256="0")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("db/a.sqlite", b"x")
        z.writestr("db/b.txt", b"y")
    assert [p.rsplit("/", 1)[1] for p in files.extract_zip(str(tmp_path / "z.zip"), str(tmp_path / "o"))] == ["a.sqlite"]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../a.sqlite", b"x")
    with pytest.raises(Rejected, match="unsafe_member"):
        files.extract_zip(str(tmp_path / "bad.zip"), str(tmp_path / "o"))


def test_sqlite_and_rows(spark, tmp_path):
    script = "CREATE TABLE a (id INTEGER PRIMARY KEY, v REAL, t TEXT); INSERT INTO a VALUES (1, 2.5, 'x'), (2, NULL, 7);"
    con = sqlite3.connect(tmp_path / "d.sqlite")
    con.executescript(script)
    con.close()
    for catalog in (files.record_catalog(spark, {"database_path": "d.sqlite", "schema_sql": ""}, str(tmp_path)), files.record_catalog(spark, {"schema_sql": script})):
        assert sorted(map(tuple, run_sql(catalog, "SELECT t, v FROM a WHERE id > 0").collect()), key=str) == [("7", None), ("x", 2.5)]
    table = files.table_from_rows(spark, ["Name", "Score (%)"], ["text", "real"], [["Ann", "1,200"], ["Bo", "n/a"]], "t")
    assert sorted(map(tuple, run_sql(table, "SELECT name, score FROM t").collect())) == [("Ann", 1200.0), ("Bo", None)]
    assert files.stored_casing(table.frame("t"), "name", "ANN") == "Ann"
    with pytest.raises(Rejected, match="invalid_table_row"):
        files.table_from_rows(spark, ["a"], ["text"], [["x", "y"]])
    sinks.dump_catalog(table, str(tmp_path / "dump"))
    assert files.read_splits(spark, {"s": str(tmp_path / "dump/t.parquet")}).where("split = 's'").count() == 2
    assert sinks.sample_table(table.frame("t").orderBy("name")).startswith("| name | score |")


def test_publish_is_all_or_nothing(tmp_path, spark):
    sinks.publish(str(tmp_path / "p"), lambda d: open(f"{d}/f", "w").close())
    with pytest.raises(Rejected):
        sinks.publish(str(tmp_path / "p"), lambda d: None)
    with pytest.raises(ZeroDivisionError):
        sinks.publish(str(tmp_path / "q"), lambda d: 1 / 0)
    assert not (tmp_path / "q").exists() and [x.name for x in tmp_path.iterdir()] == ["p"]
    assert json.loads(sinks.report_json({"n": spark.range(2)})) == {"n": [{"id": 0}, {"id": 1}]}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 10), (3, "b", 20), (4, None, 700)], "id long, k string, s int").withColumn("at", F.timestamp_seconds(F.col("s")))
    rows.write.parquet(str(tmp_path / "in"))
    stream = streaming.stream_parquet(spark, str(tmp_path / "in"), "id long, k string, s int, at timestamp")
    assert stream.isStreaming
    query = streaming.keep_first(stream, ["k"], "at").writeStream.format("memory").queryName("firsts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("firsts").count() == 3
    query = streaming.windowed_counts(stream, "at", ["k"]).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [1, 1, 2]
    query = streaming.reject_matching(stream, rows.where("k = 'b'"), ["k"]).writeStream.format("memory").queryName("kept").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["id"] for r in spark.table("kept").collect()) == [1, 2, 4]
