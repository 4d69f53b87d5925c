import datetime as dt
import json
import re
import struct

import pytest
from pyspark.sql import types as T

from siltstone.catalog import Manifest
from siltstone.errors import BadFile
from siltstone.functions import stats
from siltstone.session import Session
from siltstone.sources import avro, csv, external, mixed

CASES = [
    (["1", "22", "-3"], T.LongType, False),
    (["1", "2.5", "1e3"], T.DoubleType, False),
    (["true", "false"], T.BooleanType, False),
    (["true", "1"], T.StringType, False),
    (["1", "", "N/A"], T.LongType, True),
    (["", "na", "NULL"], T.StringType, True),
    (["a", "1"], T.StringType, False),
    (["99999999999999999999", "1"], T.DoubleType, False),
    (["2024-01-01"], T.StringType, False),
    ([".5", "-2."], T.DoubleType, False),
]


@pytest.mark.parametrize(("values", "kind", "nullable"), CASES)
def test_inference(spark, values, kind, nullable):
    f = csv.infer(spark.createDataFrame([(v,) for v in values], "x string"))["x"]
    assert isinstance(f.dataType, kind) and f.nullable is nullable


def test_csv_read(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id,score,ok,note\n1,2.5,true,x\n2,N/A,false,nan\n3,,true,\"a,b\"\n")
    rows = [tuple(r) for r in csv.read(spark, str(p)).collect()]
    assert rows == [(1, 2.5, True, "x"), (2, None, False, None), (3, None, True, "a,b")]


def test_a_value_beyond_the_sample_that_does_not_fit_is_an_error(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id\n" + "1\n" * 5 + "x\n")
    schema = csv.infer_file(spark, str(p), 5)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        csv.read(spark, str(p), schema).collect()


def test_mixed_formats_and_partition_values(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    df.write.csv(str(tmp_path / "c"), header=True)
    df.write.parquet(str(tmp_path / "p"))
    df.drop("v").write.parquet(str(tmp_path / "d"))
    files = [Manifest(str(tmp_path / "c"), "csv"), Manifest(str(tmp_path / "p"), ""), Manifest(str(tmp_path / "d"), "delta", {"v": "z"})]
    got = sorted((r.k, r.v) for r in mixed.read(spark, df.schema, files).collect())
    assert got == [(1, "a"), (1, "a"), (1, "z"), (2, "b"), (2, "b"), (2, "z")]
    with pytest.raises(BadFile, match="unknown format"):
        mixed.read(spark, df.schema, [Manifest("x", "xls")])
    with pytest.raises(BadFile, match="lacks the column 'v'"):
        mixed.read(spark, df.schema, [Manifest(str(tmp_path / "d"), "parquet")]).collect()
    assert mixed.read(spark, df.schema, []).count() == 0


def _delta(spark, tmp_path, parts):
    schema = T.StructType([T.StructField("hospital", T.StringType()), T.StructField("age", T.LongType()), T.StructField("cost", T.DoubleType())])
    (tmp_path / "_delta_log").mkdir()
    lines = [json.dumps({"metaData": {"schemaString": schema.json(), "partitionColumns": ["hospital"]}})]
    for name, rows in parts.items():
        at = tmp_path / f"raw-{name}"
        spark.createDataFrame(rows, "age long, cost double").coalesce(1).write.parquet(str(at))
        file = next(at.glob("*.parquet"))
        ages, costs = zip(*rows)
        stats = {"numRecords": len(rows), "minValues": {"age": min(ages), "cost": min(costs)}, "maxValues": {"age": max(ages), "cost": max(costs)}, "nullCount": {"age": 0, "cost": 0}}
        lines.append(json.dumps({"add": {"path": str(file.relative_to(tmp_path)), "partitionValues": {"hospital": name}, "size": file.stat().st_size, "stats": json.dumps(stats)}}))
    (tmp_path / "_delta_log" / f"{0:020d}.json").write_text("\n".join(lines))
    return schema


def test_delta(spark, tmp_path):
    schema = _delta(spark, tmp_path, {"mercy": [(34, 80.0), (51, 120.5)], "north": [(20, 1.0), (70, 2.0), (44, 3.0)]})
    found = external.delta(spark, str(tmp_path))
    assert found.schema == schema and len(found.files) == 2
    mercy = next(m for m in found.files if m.partition["hospital"] == "mercy")
    assert mercy.rows == 2 and mercy.stats["age"]["min"] == 34 and mercy.stats["cost"]["max"] == 120.5
    rows = sorted(tuple(r) for r in mixed.read(spark, found.schema, found.files).collect())
    assert rows[0] == ("mercy", 34, 80.0) and len(rows) == 5
    gone = next(m for m in found.files if m.partition["hospital"] == "north")
    path = gone.path.removeprefix(f"{tmp_path}/")
    (tmp_path / "_delta_log" / f"{1:020d}.json").write_text(json.dumps({"remove": {"path": path}}) + "\n")
    assert [m.partition["hospital"] for m in external.delta(spark, str(tmp_path)).files] == ["mercy"]


def _one_file(spark, at, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(at))
    return str(next(at.glob("*.parquet")))


@pytest.mark.parametrize("n", [2, 5, 40])
def test_files_with_and_without_partition_values(spark, tmp_path, n):
    """However many values there are: files that hold their columns keep them, a log's values count for the files that they are of, and no row is lost."""
    schema = T.StructType([T.StructField("v", T.LongType()), T.StructField("k", T.LongType()), T.StructField("r", T.StringType())])
    files = [Manifest(_one_file(spark, tmp_path / f"k={k}", [(k, f"r{k}")], "v long, r string"), "delta", {"k": k * 10}) for k in range(n)]
    files += [Manifest(_one_file(spark, tmp_path / "all", [(100, 1, "own")], schema), "delta"), Manifest(_one_file(spark, tmp_path / "r", [(101, 2)], "v long, k long"), "delta", {"r": "log"})]
    files += [Manifest(_one_file(spark, tmp_path / "none", [(102, "x")], "v long, r string"), "delta", {"k": None})]
    got = sorted(map(tuple, mixed.read(spark, schema, files).collect()))
    assert got == [(k, k * 10, f"r{k}") for k in range(n)] + [(100, 1, "own"), (101, 2, "log"), (102, None, "x")]


def test_many_partitions_are_one_scan(spark, tmp_path):
    schema = _delta(spark, tmp_path, {f"h{k}": [(k, 1.0)] for k in range(35)})
    found = external.delta(spark, str(tmp_path))
    df = mixed.read(spark, schema, found.files)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert sorted((r.hospital, r.age) for r in df.collect()) == sorted((f"h{k}", k) for k in range(35))


def test_delta_without_its_beginning(spark, tmp_path):
    (tmp_path / "_delta_log").mkdir()
    (tmp_path / "_delta_log" / f"{7:020d}.json").write_text("{}")
    with pytest.raises(BadFile, match="checkpoints"):
        external.delta(spark, str(tmp_path))


def test_statistics_from_footers(spark, tmp_path):
    """Those of the rows, without the distinct counts."""
    rows = [(k, None if k % 3 == 0 else f"n{k:03}", k / 2, k % 2 == 0, dt.date(2024, 1, 1 + k % 28), None) for k in range(100)]
    schema = "a long, b string, c double, d boolean, e date, f int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/x")
    spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{tmp_path}/none")
    paths = [str(p) for d in ("x", "none") for p in (tmp_path / d).glob("*.parquet")]
    want = {re.sub("^file:/+", "/", p): s for p, s in stats.file_stats(spark.read.parquet(f"{tmp_path}/x")).items()}
    got = stats.footer_stats(spark, [*paths, f"{tmp_path}/missing.parquet"])
    assert set(got) == set(paths) and sum(s["rows"] for s in got.values()) == 100
    for p, w in want.items():
        assert got[p]["rows"] == w["rows"] and got[p]["stats"]["c"].pop("has_nan")
        assert got[p]["stats"] == {c: {k: v for k, v in s.items() if k != "distinct"} for c, s in w["stats"].items()}
    session = Session(spark, str(tmp_path / "root"))
    session.ingest("t", spark.read.parquet(f"{tmp_path}/x"), distinct=False)
    session.register_files("u", paths, "parquet")
    spark.createDataFrame([(1,)], "a long").coalesce(1).write.parquet(f"{tmp_path}/less")
    with pytest.raises(BadFile, match="lacks the column 'b'"):
        session.register_files("u", [str(next((tmp_path / "less").glob("*.parquet")))], "parquet")
    for name in ("t", "u"):
        assert session.query(name, f"SELECT COUNT(*) AS n FROM {name} WHERE a > 90").rows() == [{"n": 9}]
        assert session.explain(name, f"SELECT a FROM {name} WHERE a > 1000").files_after == 0


# --- Avro and Iceberg ---


def _record(name, **fields):
    return {"type": "record", "name": name, "fields": [{"name": k, "type": v} for k, v in fields.items()]}


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro(codec):
    schema = _record("r", a="long", b=["null", "string"], c={"type": "array", "items": _record("p", key="int", value="bytes")}, d="double", e="boolean")
    rows = [{"a": -(1 << 40), "b": None, "c": [], "d": 1.5, "e": True}, {"a": 63, "b": "é", "c": [{"key": 1, "value": b"x"}, {"key": -64, "value": b""}], "d": -2.0, "e": False}]
    assert avro.read(avro.write(schema, rows, codec)) == rows
    with pytest.raises(BadFile):
        avro.read(b"nope")
    with pytest.raises(BadFile):
        avro.read(avro.write(schema, rows, codec)[:-20])


def _iceberg(spark, root, moved_from=None, file_format="PARQUET"):
    bounds = ["null", {"type": "array", "items": _record("bound", key="int", value="bytes")}]
    counts = ["null", {"type": "array", "items": _record("count", key="int", value="long")}]
    data_file = _record("data_file", file_path="string", file_format="string", partition=_record("part", hospital=["null", "string"]), record_count="long", file_size_in_bytes="long", lower_bounds=bounds, upper_bounds=bounds, null_value_counts=counts, nan_value_counts=counts)
    entry = _record("entry", status="int", data_file=data_file)
    listed = _record("manifest", manifest_path="string", content="int", partition_spec_id="int")
    (root / "metadata").mkdir(parents=True)
    old = moved_from or str(root)
    entries = []
    for name, rows, status in (("mercy", [(34, 120.5), (40, 10.0)], 1), ("north", [(20, 1.0), (30, 2.0), (90, 9.5)], 1), ("gone", [(1, 1.0)], 2)):
        at = root / f"data/hospital={name}"
        spark.createDataFrame([(name, a, c) for a, c in rows], "hospital string, age long, cost double").coalesce(1).write.parquet(str(at))
        file = next(at.glob("*.parquet"))
        ages, costs = zip(*rows)
        low = [{"key": 1, "value": name.encode()}, {"key": 2, "value": struct.pack("<q", min(ages))}, {"key": 3, "value": struct.pack("<d", min(costs))}]
        high = [{"key": 1, "value": name.encode()}, {"key": 2, "value": struct.pack("<q", max(ages))}, {"key": 3, "value": struct.pack("<d", max(costs))}]
        none = [{"key": k, "value": 0} for k in (1, 2, 3)]
        entries.append({"status": status, "data_file": {"file_path": f"{old}/{file.relative_to(root)}", "file_format": file_format, "partition": {"hospital": name}, "record_count": len(rows), "file_size_in_bytes": 1, "lower_bounds": low, "upper_bounds": high, "null_value_counts": none, "nan_value_counts": none}})
    (root / "metadata/m.avro").write_bytes(avro.write(entry, entries, "deflate"))
    (root / "metadata/list.avro").write_bytes(avro.write(listed, [{"manifest_path": f"{old}/metadata/m.avro", "content": 0, "partition_spec_id": 0}, {"manifest_path": "deletes.avro", "content": 1, "partition_spec_id": 0}]))
    fields = [{"id": 1, "name": "hospital", "type": "string", "required": False}, {"id": 2, "name": "age", "type": "long", "required": False}, {"id": 3, "name": "cost", "type": "double", "required": False}]
    meta = {"location": old, "current-schema-id": 0, "schemas": [{"schema-id": 0, "fields": fields}], "partition-specs": [{"spec-id": 0, "fields": [{"name": "hospital", "transform": "identity", "source-id": 1, "field-id": 1000}]}], "current-snapshot-id": 5, "snapshots": [{"snapshot-id": 5, "manifest-list": f"{old}/metadata/list.avro"}]}
    (root / "metadata/v1.metadata.json").write_text(json.dumps(meta))
    return str(root / "metadata/v1.metadata.json")


@pytest.mark.parametrize("moved", [None, "s3://elsewhere/table"])
def test_iceberg(spark, tmp_path, moved):
    if moved:
        moved = "/no/such/place/table"
    found = external.iceberg(spark, _iceberg(spark, tmp_path / "t", moved))
    assert found.schema.fieldNames() == ["hospital", "age", "cost"] and isinstance(found.schema["age"].dataType, T.LongType)
    by = {m.partition["hospital"]: m for m in found.files}
    assert set(by) == {"mercy", "north"} and by["mercy"].rows == 2 and by["north"].rows == 3
    assert by["mercy"].stats["age"]["min"] == 34 and by["mercy"].stats["cost"]["max"] == 120.5
    assert mixed.read(spark, found.schema, found.files).count() == 5


def test_iceberg_of_another_file_format(spark, tmp_path):
    with pytest.raises(BadFile, match="ORC"):
        external.iceberg(spark, _iceberg(spark, tmp_path / "t", file_format="ORC"))


def test_text_files(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("one\ntwo")
    (tmp_path / "c.txt").write_text("")
    (tmp_path / "d.md").write_text("no")
    assert sorted((r.doc_id, r.text) for r in mixed.text_files(spark, str(tmp_path)).collect())[0] == ("a b", "one\ntwo")
