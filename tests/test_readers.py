"""JSON arrays read in many splits, whatever a split begins in."""

import json
import random

import pytest
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from postmill.sources import readers
from postmill.sources.json_arrays import _walk, read_json_array

SCHEMA = StructType([
    StructField("text", StringType()), StructField("label", StringType()), StructField("labels", ArrayType(StringType())),
    StructField("inner", StructType([StructField("k", IntegerType()), StructField("s", StringType())])),
])
SIGNS = ["a", "{", "}", '"', "\\", "é", "\n", " ", "]", "[", ","]


def objects(n=400):
    rng = random.Random(1)
    return [{
        "text": "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 300 if i % 50 else 20_000))), "label": rng.choice(["x", "y", None]),
        "labels": ["a}", "{b"][: rng.randint(0, 2)], "inner": {"k": i, "s": "}{"},
    } for i in range(n)]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_array_in_many_splits(spark, tmp_path, small_splits, indent):
    rows = objects()
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    df = read_json_array(spark, str(tmp_path / "a.json"), SCHEMA)
    assert df.rdd.getNumPartitions() > 30
    got = [r.asDict(True) for r in df.orderBy("file", "block", "number").collect()]
    assert [{k: r[k] for k in SCHEMA.fieldNames()} for r in got] == rows


def test_several_files_lines_and_no_objects(spark, tmp_path, small_splits):
    rows = objects(60)
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "c.json").write_text("[]\n")
    (tmp_path / "d.json").write_text("")
    got = read_json_array(spark, str(tmp_path), SCHEMA)
    assert sorted(r.inner.k for r in got.collect()) == sorted([*range(60)] * 2)
    assert read_json_array(spark, str(tmp_path / "c.json"), SCHEMA).count() == 0


def test_walk():
    assert _walk('[{"a": "x', False) == (True, 1)  # the brace that ends the piece is in a string
    assert _walk('y", "b": 1', True) == (False, -1)
    assert _walk('{"a": "\\\\"', False) == (False, 0) and _walk('{"a": "\\"', False) == (True, 1)


def test_labelled_files(spark, tmp_path, small_splits):
    rows = [{"text": f"text {i} " * 20, "label": "ab"[i % 2]} for i in range(300)]
    (tmp_path / "l.json").write_text(json.dumps(rows, indent=1))
    got = readers.read_labelled(spark, str(tmp_path / "l.json"))
    assert sorted(map(tuple, got.collect())) == sorted((r["text"], r["label"]) for r in rows)
