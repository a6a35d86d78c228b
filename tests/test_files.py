"""File and database sources: marks, missing files, broken entries, arrays of JSON, decomposed names, ranges of a table."""

import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from sori.sources import files


def test_streams_without_file_or_ids(spark, tmp_path):
    (tmp_path / "o.csv").write_text('﻿order_date,n\n2024-01-02,"a ""b"",\nc"\n,2\n', encoding="utf-8")
    rows = files.event_streams(spark, {"orders": (f"{tmp_path}/o.csv", None, "order_date", "ORD-"), "none": (f"{tmp_path}/x.csv", "id", "at", "X-")}).collect()
    assert [(r.stream, str(r.occurred_at)) for r in rows] == [("orders", "2024-01-02 00:00:00"), ("orders", "None")]
    assert len({r.event_id for r in rows}) == 2 and 'a \\"b\\",\\nc' in rows[0].payload
    assert files.event_streams(spark, {}).count() == 0


def test_state_drops_single_entries(spark, tmp_path):
    schema = StructType([StructField("alert_id", StringType()), StructField("at", StringType()), StructField("attempts", IntegerType())])
    (tmp_path / "s.json").write_text('{"alert_id":"a","at":"2024-02-01","attempts":-1}\n{"alert_id":"b","at"\n[]\n{"at":"2024-03-01"}\n{"alert_id":"c","at":"2023-01-01"}\n{"alert_id":"d","at":"2024-02-01","attempts":"x"}\n"text"\n\n{"alert_id":"e","at":"2024-02-01","more":1}\n')
    rows = files.state(spark, f"{tmp_path}/s.json", schema, "at", "2024-01-01", required=("alert_id",)).collect()
    assert sorted((r.alert_id, r.attempts) for r in rows) == [("a", 0), ("e", 0)]
    assert files.state(spark, f"{tmp_path}/none.json", schema, "at", "2024-01-01").count() == 0


def test_corpus_of_arrays(spark, tmp_path):
    """A file over many lines, an empty one, a broken one, names in decomposed form with odd characters, nested folders."""
    name = unicodedata.normalize("NFD", "검증 a+b%")
    (tmp_path / "c" / name).mkdir(parents=True)
    (tmp_path / "c" / "학습").mkdir()
    (tmp_path / "c" / name / "é 1.json").write_text("[\n" + ",\n".join(f'  {{"text": "t{i}", "n": {i}}}' for i in range(50)) + "\n]")
    (tmp_path / "c" / "학습" / "y.json").write_text("[]")
    (tmp_path / "c" / "학습" / "z.json").write_text('{"text": "alone"}')
    (tmp_path / "c" / "학습" / "note.txt").write_text("no JSON")
    rows = sorted(files.json_corpus(spark, f"{tmp_path}/c", "struct<text:string,n:int>").collect(), key=lambda r: (r.split, r.n or 0))
    assert [(r.uid, r.split, r.text) for r in rows] == [(f"é 1.json#{i}", unicodedata.normalize("NFC", name), f"t{i}") for i in range(50)] + [("z.json#0", "학습", "alone")]


def test_missing_sources_are_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="2024-05"):
        files.monthly_inputs(spark, str(tmp_path), "2024-05", "product string")
    with pytest.raises(FileNotFoundError, match="no table cs"):
        files.relation(spark, "cs", folder=str(tmp_path))
    assert not (tmp_path / "cs.parquet").exists()
    spark.range(3).write.parquet(str(tmp_path / "cs.parquet"))
    assert files.relation(spark, "cs", folder=str(tmp_path)).count() == 3


def test_database_source(spark, tmp_path):
    """An embedded database: ranges read side by side, filters and columns pushed down, a missing table named, nothing created."""
    url, driver = f"jdbc:derby:{tmp_path}/db", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    try:
        spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("k")).write.jdbc(f"{url};create=true", "docs", properties=driver)
    except Exception as error:  # noqa: BLE001
        if "No suitable driver" in str(error) or "ClassNotFound" in str(error):
            pytest.skip("no embedded database on the class path")
        raise
    rows = files.relation(spark, "docs", url=url, properties=driver, partition=("id", 0, 100, 4))
    assert rows.rdd.getNumPartitions() == 4 and rows.where("k = 1").count() == 33
    assert "PushedFilters: [*IsNotNull(K), *EqualTo(K,1)]" in rows.where("k = 1").select("id")._jdf.queryExecution().toString().replace("(k", "(K").replace("k)", "K)")
    with pytest.raises(Exception, match="(?i)no table other|does not exist"):
        files.relation(spark, "other", url=url, properties=driver).count()
