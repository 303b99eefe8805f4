"""Small walks over bytes that only a sequential read can divide: they give pieces, column expressions read them."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"moof", b"traf", b"mvex"}

#: Bytes of a file in one row to a worker: a batch has 10,000 rows at most, so about 10 MB of files, however large or many they are.
PART = 1024
#: Rows and bytes of pieces that a worker gives at once.
ROWS, BYTES = 4096, 1 << 20


def walked(files: DataFrame, walk: Callable[[bytes], Iterator[tuple]], fields: str) -> DataFrame:
    """path, idx and walk's fields of each piece of (path, content); null contents have none.

    Files go to the workers in parts, since a batch of whole ones has up to 64 MB;
    a worker holds a batch of parts and one file.
    """
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([("path", pa.string()), ("idx", pa.int64()), *((n, kinds[k]) for n, k in (f.split() for f in fields.split(", ")))])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Path and bytes of each file; its parts stand side by side, in order."""
        path, held = None, []
        for batch in batches:
            for nth, own, part in zip(*(batch.column(c).to_pylist() for c in ("nth", "path", "part"))):
                if nth == 0:
                    if held:
                        yield path, b"".join(held)
                    path, held = own, []
                held.append(part)
        if held:
            yield path, b"".join(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, data in whole(batches):
            for n, piece in enumerate(walk(data)):
                rows.append((path, n, *piece))
                size += sum(len(x) for x in piece if isinstance(x, bytes))
                if len(rows) >= ROWS or size >= BYTES:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    some = files.select("path", "content").where(F.octet_length("content") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("content") - 1) / PART).cast("int"))
    parts = some.select("path", F.posexplode(F.transform(starts, lambda i: F.substring("content", i * PART + 1, F.lit(PART)))).alias("nth", "part"))
    # The path goes with the first part alone.
    return parts.select(F.when(F.col("nth") == 0, F.col("path")).alias("path"), "nth", "part").mapInArrow(run, f"path string, idx bigint, {fields}")


def program_stream(data: bytes) -> Iterator[tuple]:
    """(stream id, bytes after the length) of each packet; pack headers have a length of their own."""
    at = data.find(b"\0\0\1")
    while 0 <= at and at + 6 <= len(data):
        kind = data[at + 3]
        if kind == 0xBA:
            size = 14 + (data[at + 13] & 7) if at + 14 <= len(data) else len(data)
        else:
            size = 6 + int.from_bytes(data[at + 4 : at + 6], "big")
            if at + size <= len(data):
                yield kind, data[at + 6 : at + size]
        at = data.find(b"\0\0\1", at + size)


def transport_packets(data: bytes, size: int = 188) -> Iterator[tuple]:
    """Each packet. A start is sought where the next packet, if there is one, begins with a sync byte too; it is sought again when sync is lost.

    A packet that the next start cuts short is dropped, one that junk follows is kept.
    """
    def sync(at: int) -> int:
        while 0 <= (at := data.find(b"\x47", at)) and at + size <= len(data):
            if data[at + size : at + size + 1] in (b"", b"\x47"):
                return at
            at += 1
        return -1

    at = sync(0)
    while 0 <= at and at + size <= len(data):
        after = at + size
        if data[after : after + 1] not in (b"", b"\x47"):
            after = sync(at + 1)
        if not at < after < at + size:
            yield (data[at : at + size],)
        at = after


def boxes(data: bytes, begin: int = 0, end: int | None = None, trail: str = "", moof: list | None = None) -> Iterator[tuple]:
    """(trail, moof start, number of the traf or trak, offset of the body, body) of every box that holds no others; mdat without its body."""
    moof = moof if moof is not None else [0, 0]
    at, end = begin, len(data) if end is None else end
    while at + 8 <= end:
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        head = 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = size or end - at
        if size < head or at + size > end:
            return
        if kind == b"moof":
            moof[0] = at
        if kind in (b"traf", b"trak"):
            moof[1] += 1
        name = f"{trail}/{kind.decode('latin-1')}".lstrip("/")
        if kind in CONTAINERS:
            yield from boxes(data, at + head, at + size, name, moof)
        else:
            yield name, moof[0], moof[1], at + head, b"" if kind == b"mdat" else data[at + head : at + size]
        at += size


def rtmp_messages(data: bytes) -> Iterator[tuple]:
    """(chunk stream, type, message stream, time, body) of a capture of one direction. A set-chunk-size message takes effect.

    Header forms 1 and 2 add a time difference, form 3 none; an extended time is read with forms 0 to 2 only.
    """
    chunk, state, at = 128, {}, 0
    try:
        while at < len(data):
            form, cs = data[at] >> 6, data[at] & 63
            at += 1
            if cs < 2:
                cs, at = (data[at] + 64, at + 1) if cs == 0 else (data[at] + 64 + 256 * data[at + 1], at + 2)
            s = state.setdefault(cs, {"time": 0, "size": 0, "kind": 0, "stream": 0, "body": b""})
            if form < 3:
                t = int.from_bytes(data[at : at + 3], "big")
                at += 3
                if form < 2:
                    s["size"], s["kind"] = int.from_bytes(data[at : at + 3], "big"), data[at + 3]
                    at += 4
                if form == 0:
                    s["stream"] = int.from_bytes(data[at : at + 4], "little")
                    at += 4
                if t == 0xFFFFFF:
                    t, at = int.from_bytes(data[at : at + 4], "big"), at + 4
                s["time"] = t if form == 0 else s["time"] + t
            take = min(chunk, s["size"] - len(s["body"]))
            if at + take > len(data):
                return
            s["body"] += data[at : at + take]
            at += take
            if len(s["body"]) == s["size"]:
                if s["kind"] == 1:
                    chunk = int.from_bytes(s["body"][:4], "big") or 128
                yield cs, s["kind"], s["stream"], s["time"], s["body"]
                s["body"] = b""
    except IndexError:
        return


def interleaved(data: bytes) -> Iterator[tuple]:
    """(channel, bytes) of $-framed RTSP data."""
    at = 0
    while at + 4 <= len(data) and data[at] == 0x24:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if at + 4 + size > len(data):
            return
        yield data[at + 1], data[at + 4 : at + 4 + size]
        at += 4 + size


def amf0(data: bytes) -> list:
    """Values of AMF0 bytes: numbers, booleans, texts, objects, null, arrays. Other kinds end the list."""
    def text(at: int) -> tuple[str, int]:
        n = int.from_bytes(data[at : at + 2], "big")
        return data[at + 2 : at + 2 + n].decode("utf-8", "replace"), at + 2 + n

    def members(at: int) -> tuple[dict, int]:
        out = {}
        while data[at : at + 3] != b"\0\0\t":
            if at + 3 > len(data):
                raise ValueError("an object has no end")
            name, at = text(at)
            out[name], at = value(at)
        return out, at + 3

    def value(at: int):
        kind = data[at]
        if kind == 0:
            return struct.unpack(">d", data[at + 1 : at + 9])[0], at + 9
        if kind == 1:
            return data[at + 1] != 0, at + 2
        if kind == 2:
            return text(at + 1)
        if kind == 3:
            return members(at + 1)
        if kind in (5, 6):
            return None, at + 1
        if kind == 8:
            return members(at + 5)
        if kind == 10:
            out, n, at = [], int.from_bytes(data[at + 1 : at + 5], "big"), at + 5
            for _ in range(n):
                v, at = value(at)
                out.append(v)
            return out, at
        raise ValueError(f"kind {kind}")

    out, at = [], 0
    while at < len(data):
        try:
            v, at = value(at)
        except (ValueError, IndexError, struct.error):
            break
        out.append(v)
    return out


def to_amf0(*values) -> bytes:
    """AMF0 bytes of numbers, booleans, texts, None, dicts and lists."""
    short = lambda s: len(s.encode()).to_bytes(2, "big") + s.encode()
    out = b""
    for v in values:
        if v is None:
            out += b"\5"
        elif isinstance(v, bool):
            out += b"\1" + bytes([v])
        elif isinstance(v, (int, float)):
            out += b"\0" + struct.pack(">d", v)
        elif isinstance(v, str):
            out += b"\2" + short(v)
        elif isinstance(v, dict):
            out += b"\3" + b"".join(short(k) + to_amf0(x) for k, x in v.items()) + b"\0\0\t"
        else:
            out += b"\x0a" + len(v).to_bytes(4, "big") + to_amf0(*v)
    return out
