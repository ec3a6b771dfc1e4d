"""Reading ZIP archives by range: end record, ZIP64 records, central directory, stored members. A small stored writer too."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from typing import Protocol

EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
U16, U32 = 0xFFFF, 0xFFFFFFFF


class Source(Protocol):
    def size(self) -> int: ...

    def read_at(self, offset: int, length: int) -> bytes: ...


class Bytes:
    """A source over bytes in memory."""

    def __init__(self, data: bytes):
        self.data = data

    def size(self) -> int:
        return len(self.data)

    def read_at(self, offset: int, length: int) -> bytes:
        return self.data[offset : offset + length]


def open_system(uri: str):
    """(file system, path) of a uri that Spark may spell another way than pyarrow does; one that pyarrow doesn't open is a ValueError."""
    from pyarrow import ArrowInvalid, fs

    scheme, sep, rest = uri.partition("://")
    try:
        return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + sep + rest)
    except (ArrowInvalid, OSError) as e:
        raise ValueError(f"archives go to file systems that pyarrow opens, and {uri} isn't on one: {e}") from e


class Remote:
    """A source over a file of any file system that pyarrow opens; only the ranges asked for are read."""

    def __init__(self, uri: str):
        system, path = open_system(uri)
        self.file = system.open_input_file(path)

    def size(self) -> int:
        return self.file.size()

    def read_at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int  # as stored
    header: int  # offset of the local header


class ZipReader:
    """Members of an archive from its central directory; nothing is unpacked. Damaged directories raise ValueError."""

    def __init__(self, source: Source):
        self.source = source
        total = source.size()
        tail_at = max(0, total - 22 - U16)
        tail = source.read_at(tail_at, total - tail_at)
        at = tail.rfind(EOCD)
        while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(EOCD, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, size, offset = struct.unpack_from("<HII", tail, at + 10)
        end, base = tail_at + at, 0
        if count == U16 or size == U32 or offset == U32:
            loc = source.read_at(max(0, end - 20), 20)
            if loc[:4] != LOCATOR64:
                raise ValueError("ZIP64 fields without a locator")
            (record_at,) = struct.unpack_from("<Q", loc, 8)
            record = source.read_at(record_at, 56)
            if record[:4] != EOCD64:
                raise ValueError("no ZIP64 end record at its offset")
            count, size, offset = struct.unpack_from("<QQQ", record, 32)
            end = record_at
        # bytes put in front of an archive shift all of its offsets
        base = end - size - offset
        if base < 0:
            raise ValueError("central directory overlaps the end record")
        self.base = base
        directory = source.read_at(base + offset, size)
        self.members: dict[str, Member] = {}
        p = 0
        for _ in range(count):
            if directory[p : p + 4] != CENTRAL:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", directory, p + 8)
            packed, plain = struct.unpack_from("<II", directory, p + 20)
            n, x, c = struct.unpack_from("<HHH", directory, p + 28)
            (header,) = struct.unpack_from("<I", directory, p + 42)
            name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            q, stop = p + 46 + n, p + 46 + n + x
            while q + 4 <= stop:
                tag, length = struct.unpack_from("<HH", directory, q)
                if tag == 1:  # 64-bit values stand for the fields that are full, in this order
                    r = q + 4
                    for field in ("plain", "packed", "header"):
                        if {"plain": plain, "packed": packed, "header": header}[field] == U32:
                            (v,) = struct.unpack_from("<Q", directory, r)
                            r += 8
                            plain, packed, header = (v if field == "plain" else plain), (v if field == "packed" else packed), (v if field == "header" else header)
                q += 4 + length
            self.members[name] = Member(name, method, packed, base + header)
            p += 46 + n + x + c

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin in the archive."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is not stored")
        head = self.source.read_at(m.header, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        n, x = struct.unpack_from("<HH", head, 26)
        return m.header + 30 + n + x

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member; the whole by default."""
        size = self.members[name].size
        length = size - offset if length is None else length
        if offset < 0 or length < 0 or offset + length > size:
            raise ValueError(f"range outside {name}")
        return self.source.read_at(self.start(name) + offset, length)


class ZipWriter:
    """Stored members, written in one forward pass. zip64: write ZIP64 records even where 32 bits would do."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.entries = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, wide = name.encode(), zlib.crc32(data), self.zip64 or len(data) >= U32
        self.entries.append((raw, crc, len(data), self.at))
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        n = U32 if wide else len(data)
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 33, crc, n, n, len(raw), len(extra)) + raw + extra)
        self._put(data)

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, header in self.entries:
            wide = self.zip64 or size >= U32 or header >= U32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header) if wide else b""
            n, h = (U32, U32) if wide else (size, header)
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, n, n, len(raw), len(extra), 0, 0, 0, 0, h) + raw + extra)
        size, count = self.at - begin, len(self.entries)
        if self.zip64 or count >= U16 or size >= U32 or begin >= U32:
            record = self.at
            self._put(EOCD64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, begin))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, record, 1))
            count, size, begin = U16, U32, U32
        self._put(EOCD + struct.pack("<HHHHIIH", 0, 0, count, count, size, begin, 0))
