"""Binary caption packets: protocol-buffer wire format, perhaps gzipped, decoded in Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_INFLATED = 1 << 20
GZIP = b"\x1f\x8b\x08"


def inflate(packet: bytes) -> bytes | None:
    """The packet's content: gzip may begin three bytes late; null if it is broken or longer than MAX_INFLATED."""
    start = next((k for k in (0, 3) if packet[k : k + 3] == GZIP), None)
    if start is None:
        return packet
    try:
        d = zlib.decompressobj(31)
        out = d.decompress(packet[start:], MAX_INFLATED + 1)
        return out if len(out) <= MAX_INFLATED and d.eof else None
    except zlib.error:
        return None


def _varints(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("cut off")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> dict[tuple[int, int], list] | None:
    """(field, wire type) -> values; null if the bytes are no whole message."""
    out: dict[tuple[int, int], list] = {}
    at = 0
    try:
        while at < len(data):
            tag, at = _varints(data, at)
            number, wire = tag >> 3, tag & 7
            if not number:
                return None
            if wire == 0:
                value, at = _varints(data, at)
            else:
                size = 8 if wire == 1 else 4 if wire == 5 else None
                if wire == 2:
                    size, at = _varints(data, at)
                if size is None or at + size > len(data):
                    return None
                value, at = data[at : at + size], at + size
            out.setdefault((number, wire), []).append(value)
    except ValueError:
        return None
    return out


def _text(value: bytes) -> str:
    try:
        return value.decode().strip()
    except UnicodeDecodeError:
        return ""


def caption(data: bytes) -> tuple | None:
    """(device_id, message_id, version, language, text) of a message with fields 1, 2, 3, 6 and 8; it may be wrapped in field 1."""
    f = fields(data)
    if f is None:
        return None
    if (2, 2) in f:
        # a string in field 2 of a wrapper marks another kind of packet; a bare message has a number there
        return None
    if (1, 2) in f and (inner := fields(f[1, 2][0])) and (found := _message(inner)):
        return found
    return _message(f)


def _message(f: dict) -> tuple | None:
    if not all(k in f for k in ((1, 2), (2, 0), (3, 0), (6, 2), (8, 0))):
        return None
    device, text = _text(f[1, 2][0]), _text(f[6, 2][0])
    bare = device.removeprefix("@")
    return (f"@{bare}", f"{f[2, 0][0]}/@{bare}", f[3, 0][0], f[8, 0][0], text) if device and text else None


def _into(data: bytes | None, *path: int) -> dict | None:
    f = fields(data) if data else None
    for number in path:
        f = fields(f[number, 2][0]) if f and (number, 2) in f else None
    return f


def _device(record: bytes) -> tuple[str, str] | None:
    f = fields(record)
    if not f or (1, 2) not in f or (2, 2) not in f:
        return None
    who, name = _text(f[1, 2][0]), _text(f[2, 2][0])
    return (who, name) if who and name else None


def devices(data: bytes) -> list[tuple[str, str]]:
    """(device id, name) pairs of a directory packet: one record at 1.2.13.1.2, or a collection at 2.2.2."""
    one, many = _into(data, 1, 2, 13, 1), _into(data, 2, 2)
    records = [*(one or {}).get((2, 2), [])[:1], *(many or {}).get((2, 2), [])]
    return [d for d in map(_device, records) if d]


def shape(data: bytes, depth: int = 5, most: int = 48) -> list[str]:
    """Field numbers, wire types and sizes of a packet down to `depth`, no content."""
    out: list[str] = []

    def walk(part: bytes, at: str, left: int) -> None:
        for (number, wire), values in sorted((fields(part) or {}).items()) if left else ():
            for v in values:
                if len(out) < most:
                    out.append(f"{at}{number}:{wire}:{len(v) if isinstance(v, bytes) else 'n'}")
                    if wire == 2 and len(v) > 1:
                        walk(v, f"{at}{number}.", left - 1)

    walk(data, "", depth)
    return out


CAPTION = T.StructType([T.StructField("device_id", T.StringType()), T.StructField("message_id", T.StringType()), T.StructField("version", T.LongType()), T.StructField("language", T.LongType()), T.StructField("text", T.StringType())])
DEVICES = T.ArrayType(T.StructType([T.StructField("device_id", T.StringType()), T.StructField("name", T.StringType())]))


@F.pandas_udf(CAPTION)
def decode_captions(packets: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Captions of a column of packets; all null where a packet holds none."""
    for s in packets:
        rows = [caption(d) if p and (d := inflate(bytes(p))) else None for p in s]
        yield pd.DataFrame([r or (None,) * 5 for r in rows], columns=["device_id", "message_id", "version", "language", "text"]).astype({"version": "Int64", "language": "Int64"})


@F.pandas_udf(DEVICES)
def decode_devices(packets: pd.Series) -> pd.Series:
    return packets.map(lambda p: [{"device_id": a, "name": b} for a, b in devices(d)] if p and (d := inflate(bytes(p))) else [])


def encode(*parts: tuple[int, int | bytes | str]) -> bytes:
    """A message of (field, value) pairs, for tests and replays."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    out = b""
    for number, value in parts:
        raw = value.encode() if isinstance(value, str) else value
        out += varint(number << 3) + varint(raw) if isinstance(raw, int) else varint(number << 3 | 2) + varint(len(raw)) + raw
    return out


def pcm_levels(samples: bytes, width: int = 2) -> tuple[float, float]:
    """(RMS, peak) of signed little-endian samples, as shares of full scale."""
    n = len(samples) // width
    values = struct.unpack(f"<{n}{'h' if width == 2 else 'i'}", samples[: n * width])
    full = float(1 << (8 * width - 1))
    return ((sum(v * v for v in values) / n) ** 0.5 / full, max(map(abs, values)) / full) if n else (0.0, 0.0)
