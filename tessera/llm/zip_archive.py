"""ZIP packages with stored members: a streaming writer and a reader that only fetches byte ranges.

The reader takes the end record (or its ZIP64 form), walks the central directory, and returns where each member's
bytes lie; nothing is extracted.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

_END, _END64, _LOCATOR = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_ENTRY, _LOCAL, _DESCRIPTOR = b"PK\x01\x02", b"PK\x03\x04", b"PK\x07\x08"
_FULL = 0xFFFFFFFF
#: 1980-01-01, the earliest date of the format.
_DATE = 0x21


@dataclass(frozen=True)
class Member:
    name: str
    start: int  # of its bytes in the package
    size: int
    method: int
    crc: int


class ZipWriter:
    """Writes stored members one after the other to a stream that need not seek; always in ZIP64 form."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def member(self, name: str, chunks) -> int:
        """Write one member from byte strings; returns its size."""
        raw = name.encode()
        header, crc, size = self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x0808, 0, 0, _DATE, 0, _FULL, _FULL, len(raw), len(extra)) + raw + extra)
        for chunk in chunks:
            crc, size = zlib.crc32(chunk, crc), size + len(chunk)
            self._put(chunk)
        self._put(_DESCRIPTOR + struct.pack("<IQQ", crc, size, size))
        self.entries.append((raw, header, crc, size))
        return size

    def close(self) -> None:
        start = self.at
        for raw, header, crc, size in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header)
            self._put(_ENTRY + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x0808, 0, 0, _DATE, crc, _FULL, _FULL, len(raw), len(extra), 0, 0, 0, 0, _FULL) + raw + extra)
        size, end = self.at - start, self.at
        n = len(self.entries)
        self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(_LOCATOR + struct.pack("<IQI", 0, end, 1))
        self._put(_END + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, _FULL), _FULL, 0))


class ZipReader:
    """The members of a package, by ranges of ``source`` (any object with seek and read)."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size
        self.members = {m.name: m for m in self._directory()}

    def range(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        raw = self.source.read(size)
        if len(raw) != size:
            raise ValueError("package is cut short")
        return raw

    def _directory(self):
        tail_size = min(self.size, 22 + 0xFFFF)
        tail = self.range(self.size - tail_size, tail_size)
        at = tail.rfind(_END)
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != tail_size:
            at = tail.rfind(_END, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        _, _, _, n, length, start, _ = struct.unpack("<HHHHIIH", tail[at + 4 : at + 22])
        if n == 0xFFFF or _FULL in (length, start):
            locator = self.range(self.size - tail_size + at - 20, 20)
            if locator[:4] != _LOCATOR:
                raise ValueError("no ZIP64 locator")
            end = self.range(struct.unpack("<Q", locator[8:16])[0], 56)
            if end[:4] != _END64:
                raise ValueError("no ZIP64 end record")
            n, length, start = struct.unpack("<QQQ", end[32:56])
        listing, at = self.range(start, length), 0
        for _ in range(n):
            if listing[at : at + 4] != _ENTRY:
                raise ValueError("broken central directory")
            flags, method, _, _, crc, packed, size, n_name, n_extra, n_note, _, _, _, header = struct.unpack("<HHHHIIIHHHHHII", listing[at + 8 : at + 46])
            raw = listing[at + 46 : at + 46 + n_name]
            extra = listing[at + 46 + n_name : at + 46 + n_name + n_extra]
            at += 46 + n_name + n_extra + n_note
            while len(extra) >= 4:
                tag, k = struct.unpack("<HH", extra[:4])
                if tag == 1:
                    wide = [x for (x,) in struct.iter_unpack("<Q", extra[4 : 4 + k // 8 * 8])]
                    size = wide.pop(0) if size == _FULL and wide else size
                    packed = wide.pop(0) if packed == _FULL and wide else packed
                    header = wide.pop(0) if header == _FULL and wide else header
                extra = extra[4 + k :]
            local = self.range(header, 30)
            if local[:4] != _LOCAL:
                raise ValueError("broken local header")
            skip = 30 + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little")
            yield Member(raw.decode("utf-8" if flags & 0x800 else "cp437"), header + skip, packed, method, crc)

    def read(self, name: str, offset: int = 0, size: int | None = None) -> bytes:
        """Bytes of a stored member from ``offset`` on."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is not stored")
        size = member.size - offset if size is None else size
        if offset < 0 or offset + size > member.size:
            raise ValueError(f"range outside {name}")
        return self.range(member.start + offset, size)
