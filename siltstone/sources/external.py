"""Tables that other systems keep, registered where they are: their logs say which files are live."""

from __future__ import annotations

import datetime as dt
import json
import struct
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from siltstone.catalog import Manifest
from siltstone.errors import BadFile
from siltstone.fs import Files
from siltstone.functions.stats import json_value
from siltstone.sources import avro


@dataclass(frozen=True)
class ExternalTable:
    schema: T.StructType
    files: list[Manifest]


# --- Iceberg ---

_ICEBERG = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "binary": T.BinaryType(), "uuid": T.StringType()}


def _iceberg_type(t: object, name: str) -> T.DataType:
    if isinstance(t, str) and t in _ICEBERG:
        return _ICEBERG[t]
    if isinstance(t, str) and t.startswith("decimal("):
        p, s = t[8:-1].split(",")
        return T.DecimalType(int(p), int(s))
    if isinstance(t, dict) and t.get("type") == "list":
        return T.ArrayType(_iceberg_type(t["element"], name))
    if isinstance(t, dict) and t.get("type") == "struct":
        return T.StructType([T.StructField(f["name"], _iceberg_type(f["type"], f["name"]), not f["required"]) for f in t["fields"]])
    if isinstance(t, dict) and t.get("type") == "map":
        return T.MapType(_iceberg_type(t["key"], name), _iceberg_type(t["value"], name))
    raise BadFile(f"column {name!r} has the type {t}, which isn't supported")


def _bound(raw: bytes | None, kind: T.DataType) -> object:
    """A bound in its single-value binary form; None where it has another length than the type's."""
    if raw is None:
        return None
    form = {T.IntegerType: "<i", T.LongType: "<q", T.FloatType: "<f", T.DoubleType: "<d", T.DateType: "<i", T.BooleanType: "<?"}.get(type(kind))
    if form:
        if len(raw) == struct.calcsize(form):
            value = struct.unpack(form, raw)[0]
        elif form == "<q" and len(raw) == 4:  # a column that was widened after the file was written
            value = struct.unpack("<i", raw)[0]
        elif form == "<d" and len(raw) == 4:
            value = struct.unpack("<f", raw)[0]
        else:
            return None
        return (dt.date(1970, 1, 1) + dt.timedelta(days=value)).isoformat() if isinstance(kind, T.DateType) else json_value(value)
    if isinstance(kind, T.StringType):
        return raw.decode("utf-8", "ignore")
    return None


def _moved(files: Files, path: str, root: str, old_root: str) -> str:
    """A path as the table's metadata has it, or the same place below where the table is now."""
    if files.exists(path):
        return path
    tail = path.removeprefix(old_root.rstrip("/")).lstrip("/") if path.startswith(old_root.rstrip("/")) else path.split("/metadata/")[-1] if "/metadata/" in path else path.split("/data/")[-1]
    for at in (f"{root}/{tail}", f"{root}/metadata/{tail}", f"{root}/data/{tail}"):
        if files.exists(at):
            return at
    raise BadFile(f"{path} isn't there, nor below {root}")


def iceberg(spark: SparkSession, metadata_json: str) -> ExternalTable:
    """The current snapshot of the table with this metadata file."""
    files = Files(spark)
    meta = json.loads(files.read(metadata_json))
    root, old = metadata_json.rsplit("/metadata/", 1)[0], meta.get("location", "")
    schemas = meta.get("schemas") or [meta["schema"]]
    raw = next((s for s in schemas if s.get("schema-id") == meta.get("current-schema-id")), schemas[-1])
    schema = T.StructType([T.StructField(f["name"], _iceberg_type(f["type"], f["name"]), not f["required"]) for f in raw["fields"]])
    by_id = {f["id"]: f["name"] for f in raw["fields"]}
    specs = {s["spec-id"]: s["fields"] for s in meta.get("partition-specs", [])}
    current = meta.get("current-snapshot-id")
    snapshot = next((s for s in meta.get("snapshots", []) if s["snapshot-id"] == current), None)
    if snapshot is None:
        return ExternalTable(schema, [])
    lists = avro.read(files.read(_moved(files, snapshot["manifest-list"], root, old)))
    out = []
    for entry in lists:
        if entry.get("content", 0) != 0:  # files of deletes
            continue
        spec = specs.get(entry.get("partition_spec_id", 0), [])
        for row in avro.read(files.read(_moved(files, entry["manifest_path"], root, old))):
            if row["status"] == 2:
                continue
            f = row["data_file"]
            if f["file_format"].upper() != "PARQUET":
                raise BadFile(f"{f['file_path']} is {f['file_format']}; only Parquet can be read")
            partition = {}
            for p in spec:
                if p["transform"] == "identity" and p["source-id"] in by_id:
                    value = f["partition"].get(p["name"])
                    kind = schema[by_id[p["source-id"]]].dataType
                    partition[by_id[p["source-id"]]] = (dt.date(1970, 1, 1) + dt.timedelta(days=value)).isoformat() if isinstance(kind, T.DateType) and value is not None else json_value(value)
            pairs = {k: {e["key"]: e["value"] for e in f.get(k) or []} for k in ("lower_bounds", "upper_bounds", "null_value_counts", "nan_value_counts")}
            stats = {}
            for i, name in by_id.items():
                kind = schema[name].dataType
                s = {"min": _bound(pairs["lower_bounds"].get(i), kind), "max": _bound(pairs["upper_bounds"].get(i), kind), "null_count": pairs["null_value_counts"].get(i)}
                if isinstance(kind, T.StringType):
                    s["max_truncated"] = True  # writers may cut text bounds
                if isinstance(kind, (T.FloatType, T.DoubleType)) and pairs["nan_value_counts"].get(i) != 0:
                    s["has_nan"] = True
                stats[name] = s
            out.append(Manifest(_moved(files, f["file_path"], root, old), "iceberg", partition, f["record_count"], f.get("file_size_in_bytes"), stats))
    return ExternalTable(schema, out)


# --- Delta ---


def _partition_value(text: str | None, kind: T.DataType) -> object:
    if text is None or text == "":
        return None
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return int(text)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(text)
    if isinstance(kind, T.BooleanType):
        return text == "true"
    return text


def delta(spark: SparkSession, table: str) -> ExternalTable:
    """The live files after replaying the log's JSON commits in order. Needs the log from its first commit on."""
    files, log = Files(spark), f"{table.rstrip('/')}/_delta_log"
    names = [n for n in files.names(log) if n.endswith(".json") and n[:-5].isdigit()]
    if not names:
        raise BadFile(f"{table} has no log")
    if int(names[0][:-5]) != 0:
        raise BadFile(f"the log of {table} begins at version {int(names[0][:-5])}; checkpoints aren't read")
    meta: dict | None = None
    live: dict[str, dict] = {}
    for name in names:
        for line in files.read(f"{log}/{name}").decode().splitlines():
            if not line.strip():
                continue
            action = json.loads(line)
            if "metaData" in action:
                meta = action["metaData"]
            elif "add" in action:
                if action["add"].get("deletionVector"):
                    raise BadFile(f"{table} has deletion vectors, which aren't supported")
                live[action["add"]["path"]] = action["add"]
            elif "remove" in action:
                live.pop(action["remove"]["path"], None)
    if meta is None:
        raise BadFile(f"the log of {table} has no schema")
    schema = T.StructType.fromJson(json.loads(meta["schemaString"]))
    out = []
    for path, add in live.items():
        s = json.loads(add["stats"]) if add.get("stats") else {}
        stats = {}
        for f in schema:
            if f.name in (meta.get("partitionColumns") or []):
                continue
            own = {"min": s.get("minValues", {}).get(f.name), "max": s.get("maxValues", {}).get(f.name), "null_count": s.get("nullCount", {}).get(f.name)}
            if isinstance(f.dataType, T.StringType):
                own["max_truncated"] = True
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                own["has_nan"] = True  # the log doesn't say, and such values aren't in its bounds
            if any(v is not None for v in own.values()) and isinstance(own["min"], (int, float, str, bool, type(None))):
                stats[f.name] = own
        partition = {c: _partition_value(v, schema[c].dataType) for c, v in (add.get("partitionValues") or {}).items()}
        where = unquote(path)
        out.append(Manifest(where if "://" in where or where.startswith("/") else f"{table.rstrip('/')}/{where}", "delta", partition, s.get("numRecords"), add.get("size"), stats))
    return ExternalTable(schema, out)
