"""Just enough of Thrift's compact protocol to read and rewrite Parquet footers.

A struct becomes a list of [field id, type, value]; nothing is interpreted, so
whatever a writer put into a footer survives the round trip.
"""

from __future__ import annotations

import struct

TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def signed(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def raw(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, kind: int, inside: bool = False):
        if kind in (TRUE, FALSE):
            return self.byte() == TRUE if inside else kind == TRUE
        if kind == BYTE:
            return self.byte()
        if kind in (I16, I32, I64):
            return self.signed()
        if kind == DOUBLE:
            return struct.unpack("<d", self.raw(8))[0]
        if kind == BINARY:
            return self.raw(self.varint())
        if kind in (LIST, SET):
            head = self.byte()
            n, of = (head >> 4 if head >> 4 != 15 else self.varint()), head & 15
            return [of, [self.value(of, True) for _ in range(n)]]
        if kind == MAP:
            n = self.varint()
            kinds = self.byte() if n else 0
            return [kinds, [(self.value(kinds >> 4, True), self.value(kinds & 15, True)) for _ in range(n)]]
        if kind == STRUCT:
            return self.struct()
        raise ValueError(f"unknown Thrift type {kind}")

    def struct(self) -> list:
        fields, last = [], 0
        while head := self.byte():
            kind = head & 15
            last = last + (head >> 4) if head >> 4 else self.signed()
            fields.append([last, kind, self.value(kind)])
        return fields


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _signed(n: int) -> bytes:
    return _varint((n << 1) ^ (n >> 63))


def _write(kind: int, value, inside: bool = False) -> bytes:
    if kind in (TRUE, FALSE):
        return bytes([TRUE if value else FALSE]) if inside else b""
    if kind == BYTE:
        return bytes([value])
    if kind in (I16, I32, I64):
        return _signed(value)
    if kind == DOUBLE:
        return struct.pack("<d", value)
    if kind == BINARY:
        return _varint(len(value)) + value
    if kind in (LIST, SET):
        of, items = value
        head = bytes([len(items) << 4 | of]) if len(items) < 15 else bytes([0xF0 | of]) + _varint(len(items))
        return head + b"".join(_write(of, x, True) for x in items)
    if kind == MAP:
        kinds, items = value
        return _varint(len(items)) + (bytes([kinds]) if items else b"") + b"".join(_write(kinds >> 4, k, True) + _write(kinds & 15, v, True) for k, v in items)
    return write_struct(value)


def write_struct(fields: list) -> bytes:
    out, last = [], 0
    for number, kind, value in fields:
        if kind in (TRUE, FALSE):
            kind = TRUE if value else FALSE
        step = number - last
        out.append(bytes([step << 4 | kind]) if 0 < step < 16 else bytes([kind]) + _signed(number))
        out.append(_write(kind, value))
        last = number
    return b"".join(out) + b"\0"


def get(fields: list, number: int, default=None):
    return next((f[2] for f in fields if f[0] == number), default)


def put(fields: list, number: int, value) -> None:
    """Changes a field that is there."""
    for f in fields:
        if f[0] == number:
            f[2] = value
