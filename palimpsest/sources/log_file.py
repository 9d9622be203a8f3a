"""The binary log: one file of entries, grouped into transactions by commit entries.

Fixed values of the format: a header byte 000kkvvv holds the number of bytes of
the key's and the value's size; both sizes follow, little-endian, then key and
value. An entry without a key is a commit: its value is a time in milliseconds in
6 bytes, followed by the CRC-32 of all entries since the last commit and itself.
A key without a value is a removal. Keys end in a byte that names their slot and
are, like values, MessagePack.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MOST_KEY, MOST_VALUE, TIME_BYTES = 1 << 16, 1 << 24, 6

SCHEMA = "path string, slot int, key binary, value binary, is_removed boolean, commit_ts long, seq long"


class LogError(ValueError):
    """An entry that can't be read or written."""


def _size(n: int, most: int) -> bytes:
    out = n.to_bytes((n.bit_length() + 7) // 8, "little")
    if len(out) > most:
        raise LogError(f"{n} bytes don't fit")
    return out


def entry(key: bytes | None, value: bytes | None) -> bytes:
    k, v = _size(len(key or b""), 3), _size(len(value or b""), 6)
    return bytes([len(k) << 3 | len(v)]) + k + v + (key or b"") + (value or b"")


def write(transactions: list[tuple[int, list[tuple[int, bytes, bytes | None]]]]) -> bytes:
    """A log of transactions (time, [(slot, key, value or None for a removal)])."""
    out = b""
    for ts, rows in transactions:
        body = b"".join(entry(k + bytes([slot]), v) for slot, k, v in rows) + entry(None, ts.to_bytes(TIME_BYTES, "little"))
        out += body + struct.pack("<I", zlib.crc32(body))
    return out


def read(data: bytes) -> Iterator[tuple[int, bytes, bytes | None, int, int]]:
    """(slot, key, value, time, offset) of the transactions before the first that is torn or fails its CRC."""
    at = first = 0
    rows: list[tuple[int, bytes, bytes | None, int]] = []
    while at < len(data):
        k, v = data[at] >> 3 & 3, data[at] & 7
        a = at + 1 + k + v
        n_key, n_value = int.from_bytes(data[at + 1 : at + 1 + k], "little"), int.from_bytes(data[at + 1 + k : a], "little")
        end = a + n_key + n_value
        if v > 6 or n_key > MOST_KEY or n_value > MOST_VALUE or end > len(data):
            return
        if n_key:
            key = data[a : a + n_key]
            rows.append((key[-1], key[:-1], data[a + n_key : end] if n_value else None, at))
            at = end
            continue
        if data[end : end + 4] != struct.pack("<I", zlib.crc32(data[first:end])):
            return
        ts = int.from_bytes(data[a:end], "little")
        for slot, key, value, offset in rows:
            yield slot, key, value, ts, offset
        rows, at = [], end + 4
        first = at


def unpack(data: bytes):
    """The first MessagePack value of some bytes, as Python data."""
    return _unpack(data, 0)[0]


def _unpack(d: bytes, i: int):
    c = d[i]
    i += 1
    if c < 0x80:
        return c, i
    if c >= 0xE0:
        return c - 256, i
    if c < 0x90:
        return _pairs(d, i, c & 15)
    if c < 0xA0:
        return _items(d, i, c & 15)
    if c < 0xC0:
        return d[i : i + (c & 31)].decode(), i + (c & 31)
    simple = {0xC0: None, 0xC2: False, 0xC3: True}
    if c in simple:
        return simple[c], i
    number = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    if c in number:
        n = struct.calcsize(number[c])
        return struct.unpack(number[c], d[i : i + n])[0], i + n
    width = {0xC4: 1, 0xC5: 2, 0xC6: 4, 0xD9: 1, 0xDA: 2, 0xDB: 4, 0xDC: 2, 0xDD: 4, 0xDE: 2, 0xDF: 4}.get(c)
    if width is None:
        raise LogError(f"MessagePack type {c:#x}")
    n, i = int.from_bytes(d[i : i + width], "big"), i + width
    if c in (0xDC, 0xDD):
        return _items(d, i, n)
    if c in (0xDE, 0xDF):
        return _pairs(d, i, n)
    raw = d[i : i + n]
    return (raw.decode() if c >= 0xD9 else raw), i + n


def _items(d: bytes, i: int, n: int):
    out = []
    for _ in range(n):
        x, i = _unpack(d, i)
        out.append(x)
    return out, i


def _pairs(d: bytes, i: int, n: int):
    flat, i = _items(d, i, 2 * n)
    return dict(zip(flat[::2], flat[1::2], strict=True)), i


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Log files as rows of the change log; keys and values stay MessagePack. A file is one task's work, as commits chain through it."""

    def work(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(name, s, k, v, v is None, ts, at) for s, k, v, ts, at in read(data)]
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                types = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["path", "slot", "key", "value", "is_removed", "commit_ts", "seq"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, SCHEMA)
