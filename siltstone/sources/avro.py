"""Avro object container files, enough of them to read and write table manifests: there is no Avro data source on a plain Spark."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

from siltstone.errors import BadFile

_MAGIC = b"Obj\x01"


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise BadFile("an Avro file ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def whole(self) -> int:
        """Variable-length zigzag integer."""
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value >> 1 ^ -(value & 1)
            shift += 7

    def blocks(self) -> Iterator[int]:
        """Counts of the blocks of an array or map."""
        while n := self.whole():
            if n < 0:
                self.whole()  # the block's bytes
                n = -n
            yield n


class _Reader:
    def __init__(self) -> None:
        self.named: dict[str, dict] = {}

    def value(self, schema: object, src: _Bytes) -> object:
        if isinstance(schema, list):
            return self.value(schema[src.whole()], src)
        kind = schema["type"] if isinstance(schema, dict) else schema
        if isinstance(kind, (dict, list)):
            return self.value(kind, src)
        if kind in ("record", "fixed", "enum"):
            self.named[schema["name"]] = schema
            if ns := schema.get("namespace"):
                self.named[f"{ns}.{schema['name']}"] = schema
        if kind == "null":
            return None
        if kind == "boolean":
            return src.take(1) == b"\x01"
        if kind in ("int", "long"):
            return src.whole()
        if kind == "float":
            return struct.unpack("<f", src.take(4))[0]
        if kind == "double":
            return struct.unpack("<d", src.take(8))[0]
        if kind == "bytes":
            return src.take(src.whole())
        if kind == "string":
            return src.take(src.whole()).decode()
        if kind == "fixed":
            return src.take(schema["size"])
        if kind == "enum":
            return schema["symbols"][src.whole()]
        if kind == "array":
            return [self.value(schema["items"], src) for n in src.blocks() for _ in range(n)]
        if kind == "map":
            return {src.take(src.whole()).decode(): self.value(schema["values"], src) for n in src.blocks() for _ in range(n)}
        if kind == "record":
            return {f["name"]: self.value(f["type"], src) for f in schema["fields"]}
        if kind in self.named:
            return self.value(self.named[kind], src)
        raise BadFile(f"unknown Avro type {kind!r}")


def read(data: bytes) -> list[dict]:
    """All records."""
    src = _Bytes(data)
    if src.take(4) != _MAGIC:
        raise BadFile("not an Avro container file")
    reader = _Reader()
    meta = reader.value({"type": "map", "values": "bytes"}, src)
    mark, schema, codec = src.take(16), json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode()
    if codec not in ("null", "deflate"):
        raise BadFile(f"Avro codec {codec!r} isn't supported")
    out = []
    while src.at < len(data):
        n, block = src.whole(), src.take(src.whole())
        if codec == "deflate":
            block = zlib.decompress(block, -15)
        part = _Bytes(block)
        out += [reader.value(schema, part) for _ in range(n)]
        if src.take(16) != mark:
            raise BadFile("an Avro block's end mark is wrong")
    return out


def _whole(n: int) -> bytes:
    n, out = n << 1 ^ n >> 63, bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes((*out, n))


def _put(schema: object, v: object) -> bytes:
    if isinstance(schema, list):
        at = schema.index("null") if v is None else next(k for k, s in enumerate(schema) if s != "null")
        return _whole(at) + _put(schema[at], v)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return _put(kind, v)
    match kind:
        case "null":
            return b""
        case "int" | "long":
            return _whole(v)
        case "string" | "bytes":
            raw = v.encode() if kind == "string" else v
            return _whole(len(raw)) + raw
        case "double":
            return struct.pack("<d", v)
        case "boolean":
            return b"\x01" if v else b"\x00"
        case "array":
            return (_whole(len(v)) + b"".join(_put(schema["items"], x) for x in v) if v else b"") + _whole(0)
        case "record":
            return b"".join(_put(f["type"], v[f["name"]]) for f in schema["fields"])
    raise BadFile(f"no Avro writer for {kind!r}")


def write(schema: dict, rows: list[dict], codec: str = "null") -> bytes:
    """A container file of one block."""
    mark, meta = b"0123456789abcdef", {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}
    head = _MAGIC + _whole(len(meta)) + b"".join(_put("string", k) + _put("bytes", v) for k, v in meta.items()) + _whole(0) + mark
    block = b"".join(_put(schema, r) for r in rows)
    if codec == "deflate":
        c = zlib.compressobj(wbits=-15)
        block = c.compress(block) + c.flush()
    return head + _whole(len(rows)) + _put("bytes", block) + mark
