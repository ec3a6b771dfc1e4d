"""Model files as tables of weights. Files are read by ranges; nothing in them is ever executed or unpickled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a tensor that a task reads at once.
RANGE = 8 << 20
#: Bytes that are fetched for a header, at first.
HEAD = 1 << 16
#: Tensor types by their number in the format (fixed values); bfloat16, 16, is widened by hand.
TYPES = {1: "<f4", 2: "u1", 3: "i1", 4: "<u2", 5: "<i2", 6: "<i4", 7: "<i8", 9: "u1", 10: "<f2", 11: "<f8", 12: "<u4", 13: "<u8", 16: "<u2"}
#: Fields of typed values (as against raw bytes) whose items are fixed in width: number -> type (fixed values).
PACKED = {4: "<f4", 10: "<f8"}


@dataclass
class Tensor:
    name: str = ""
    dims: list[int] = field(default_factory=list)
    kind: int = 0
    offset: int = -1
    length: int = 0
    stored: str = ""  # numpy type of what lies at the offset
    problem: str | None = None


class _File:
    """A file on any of pyarrow's file systems, read by ranges."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
        self.handle = system.open_input_file(path)
        self.size = self.handle.size()

    def read(self, offset: int, n: int) -> bytes:
        return self.handle.read_at(max(0, min(n, self.size - offset)), offset)


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if i >= len(b) or shift > 63:
            raise ValueError("the file ends inside a number")
        out |= (b[i] & 127) << shift
        i += 1
        if b[i - 1] < 128:
            return out, i
        shift += 7


def _fields(f: _File, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(number, wire type, offset, length) of a message's fields, values not read; a number's offset is its value."""
    at, head, base = start, b"", start
    while at < end:
        if at - base + 20 > len(head):
            head, base = f.read(at, HEAD), at
        tag, i = _varint(head, at - base)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, i = _varint(head, i)
            yield number, wire, value, 0
            at = base + i
            continue
        if wire == 2:
            n, i = _varint(head, i)
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
        else:
            raise ValueError(f"wire type {wire} isn't one of the format")
        if base + i + n > end:
            raise ValueError("a field runs beyond its message")
        yield number, wire, base + i, n
        at = base + i + n


def _text(f: _File, offset: int, n: int) -> str:
    return f.read(offset, n).decode(errors="replace")


def _tensor(f: _File, start: int, end: int) -> Tensor:
    t = Tensor()
    for number, wire, at, n in _fields(f, start, end):
        if number == 1 and wire == 0:
            t.dims.append(at)
        elif number == 1:
            b, i = f.read(at, n), 0
            while i < len(b):
                v, i = _varint(b, i)
                t.dims.append(v)
        elif number == 2:
            t.kind = at
        elif number == 8:
            t.name = _text(f, at, n)
        elif number == 9:
            t.offset, t.length, t.stored = at, n, TYPES.get(t.kind, "raw")
        elif number in PACKED and wire == 2:
            t.offset, t.length, t.stored = at, n, PACKED[number]
        elif number == 13 or (number == 14 and at == 1):
            t.problem = "its values lie in another file"
        elif number in (5, 6, 7, 11):
            t.problem = "its values are of no fixed width"
    if t.stored == "raw":
        t.stored = TYPES.get(t.kind, "")
    size = int(np.prod(t.dims, dtype=np.int64)) if t.dims else 1
    if t.problem is None and not t.stored:
        t.problem = f"type {t.kind} isn't numeric"
    if t.problem is None and t.offset < 0 and size:
        t.problem = "it has no values"
    if t.problem is None and t.length != size * np.dtype(t.stored).itemsize:
        t.problem = "its length doesn't fit its shape"
    return t


def _shape(f: _File, start: int, end: int) -> list[int]:
    """Dimensions of a described input or output, -1 where they are open."""
    for number, path in ((2, (1, 2)),):
        spans = [(start, end)]
        for n in (number, *path):
            spans = [(at, at + size) for a, b in spans for k, wire, at, size in _fields(f, a, b) if k == n and wire == 2]
        return [next((v for k, wire, v, _ in _fields(f, at, at + n) if k == 1 and wire == 0), -1) for a, b in spans for k, wire, at, n in _fields(f, a, b) if k == 1 and wire == 2]
    return []


def read_header(uri: str) -> dict:
    """{tensors, inputs, outputs, producer} of an ONNX file: only headers are read, however large the tensors are."""
    f, out = _File(uri), {"tensors": [], "inputs": {}, "outputs": {}, "producer": ""}
    for number, wire, at, n in _fields(f, 0, f.size):
        if number == 2 and wire == 2:
            out["producer"] = _text(f, at, n)
        if number != 7 or wire != 2:
            continue
        for k, w, a, m in _fields(f, at, at + n):
            if k == 5 and w == 2:
                out["tensors"].append(_tensor(f, a, a + m))
            elif k in (11, 12) and w == 2:
                name = next((_text(f, x, size) for j, _, x, size in _fields(f, a, a + m) if j == 1), "")
                out["inputs" if k == 11 else "outputs"][name] = _shape(f, a, a + m)
    known = {t.name for t in out["tensors"]}
    out["inputs"] = {k: v for k, v in out["inputs"].items() if k not in known}
    return out


def describe(uri: str) -> dict:
    """What a model file says of itself: access (WHITE_BOX with weights, else UNAVAILABLE), classes, input_shape, layers, limitations.

    Classes are the last dimension of the first output, else the length of the last bias, else the rows of the last matrix; of layers called fc,
    classifier, head or logits, if there are any. The input's shape is that of a described input of four dimensions, else channels of
    the first four-dimensional tensor, with 224 for what is open. Pickled formats are not opened.
    """
    out: dict = {"access": "UNAVAILABLE", "classes": None, "input_shape": None, "layers": {}, "limitations": []}
    if not uri.lower().endswith(".onnx"):
        out["limitations"].append("not an ONNX file: pickled models can run code and are not opened")
        return out
    try:
        head = read_header(uri)
    except (OSError, ValueError) as e:
        out["limitations"].append(f"the file can't be read: {e}")
        return out
    good = [t for t in head["tensors"] if t.problem is None]
    out["limitations"] += [f"{t.name or 'a tensor'}: {t.problem}" for t in head["tensors"] if t.problem]
    out["layers"] = {t.name: t.dims for t in good}
    out["access"] = "WHITE_BOX" if good else "UNAVAILABLE"
    last = next(iter(head["outputs"].values()), [])
    pool = [t for t in good if t.dims and any(k in t.name for k in ("fc", "classifier", "head", "logits"))] or good
    bias = [t.dims[0] for t in pool if len(t.dims) == 1 and 2 <= t.dims[0] <= 100_000 and "bias" in t.name]
    rows = [t.dims[0] for t in pool if len(t.dims) == 2]
    out["classes"] = last[-1] if last and last[-1] > 0 else bias[-1] if bias else rows[-1] if rows else None
    first = next((s for s in head["inputs"].values() if len(s) == 4), None)
    conv = next((t.dims for t in good if len(t.dims) == 4), None)
    if first or conv:
        out["input_shape"] = tuple(v if v > 0 else d for v, d in zip(first[1:], (3, 224, 224))) if first else (conv[1], 224, 224)
    return out


class _Range(InputPartition):
    def __init__(self, uri: str, name: str, kind: int, stored: str, offset: int, length: int, pos: int):
        super().__init__((uri, name, offset))
        self.uri, self.name, self.kind, self.stored, self.offset, self.length, self.pos = uri, name, kind, stored, offset, length, pos


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.step = options["path"], int(options.get("rangebytes", RANGE))

    def partitions(self):
        out = []
        for t in read_header(self.uri)["tensors"]:
            if t.problem is None and t.length:
                width = np.dtype(t.stored).itemsize
                step = max(width, self.step // width * width)
                out += [_Range(self.uri, t.name, t.kind, t.stored, t.offset + a, min(step, t.length - a), a // width) for a in range(0, t.length, step)]
        return out or [_Range(self.uri, "", 1, "<f4", 0, 0, 0)]

    def read(self, part):
        f, width, rows = _File(part.uri), np.dtype(part.stored).itemsize, 1 << 17
        for a in range(0, part.length, rows * width):
            x = np.frombuffer(f.read(part.offset + a, min(rows * width, part.length - a)), part.stored)
            x = (x.astype(np.uint32) << 16).view(np.float32) if part.kind == 16 and part.stored == "<u2" else x
            pos = part.pos + a // width + np.arange(len(x), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([part.name]).take(pa.array(np.zeros(len(x), np.int32))), pa.array(pos), pa.array(x.astype(np.float64))], names=["layer", "pos", "value"])


class OnnxWeights(DataSource):
    """Source `onnx_weights`: (layer, pos, value) of the tensors of the ONNX file at `path`, `rangeBytes` bytes a partition."""

    @classmethod
    def name(cls):
        return "onnx_weights"

    def schema(self):
        return "layer string, pos bigint, value double"

    def reader(self, schema):
        return _Reader(self.options)


def load_weights(spark: SparkSession, uri: str, range_bytes: int = RANGE) -> DataFrame:
    """(layer, pos, value) of an ONNX file's tensors, on any file system that pyarrow opens; what is left out is in describe's limitations."""
    spark.dataSource.register(OnnxWeights)
    return spark.read.format("onnx_weights").option("rangeBytes", str(range_bytes)).load(uri)
