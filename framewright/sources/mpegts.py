"""MPEG transport streams: packets, tables, PES and frames by column expressions; writing as an ordered fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import bits as B, codecs
from ..operators.fold import Machine, fold
from . import walk

PACKET = 188
# Stream type -> codec, media. Other types have no codec here and are dropped.
STREAM_TYPES = {0x1B: ("H264", "video"), 0x24: ("H265", "video"), 0x0F: ("AAC", "audio"), 0x03: ("MP3", "audio"), 0x04: ("MP3", "audio")}


def packets(files: DataFrame) -> DataFrame:
    """path, idx, pid, start (payload unit start) and payload of every packet of (path, content); sync is sought again where it is lost."""
    rows = walk.walked(files, walk.transport_packets, "p binary")
    head, control = B.u16(F.col("p"), 1), B.field(B.u8(F.col("p"), 3), 4, 2)
    skip = F.when(control.bitwiseAND(F.lit(2)) != 0, 5 + B.u8(F.col("p"), 4)).otherwise(F.lit(4))
    return rows.where(control.bitwiseAND(F.lit(1)) != 0).select("path", "idx", B.field(head, 0, 13).alias("pid"), (B.field(head, 14, 1) == 1).alias("start"), B.after(F.col("p"), skip).alias("payload"))


def _sections(pkts: DataFrame, table_id: int) -> DataFrame:
    """path, pid, s: the first whole section of that kind of each pid, joined over its packets; its end may lie before the next one's start."""
    by = Window.partitionBy("path", "pid").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = pkts.select("path", "pid", "idx", "start", "payload", F.sum(F.when(F.col("start"), 1).otherwise(0)).over(by).alias("n"))
    pointer = B.u8(F.col("payload"), 0)
    own = rows.where("n > 0").select("path", "pid", "n", "idx", F.when(F.col("start"), B.after(F.col("payload"), 1 + pointer)).otherwise(F.col("payload")).alias("part"))
    before = rows.where("start AND n > 1").select("path", "pid", (F.col("n") - 1).alias("n"), "idx", B.piece(F.col("payload"), F.lit(1), pointer.cast("int")).alias("part"))
    whole = own.unionByName(before).groupBy("path", "pid", "n").agg(F.expr("listagg(part) WITHIN GROUP (ORDER BY idx)").alias("s"))
    s = F.col("s")
    return whole.where((B.u8(s, 0) == table_id) & (F.octet_length(s) >= 3 + B.u16(s, 1).bitwiseAND(F.lit(0xFFF)))).groupBy("path", "pid").agg(F.min_by("s", "n").alias("s"))


def streams(pkts: DataFrame) -> DataFrame:
    """path, pid, stream_type of the elementary streams that each file's first tables name."""
    pat = _sections(pkts.where("pid = 0"), 0)
    programs = F.floor((B.u16(F.col("s"), 1).bitwiseAND(F.lit(0xFFF)) - 9) / 4).cast("int")
    pmts = pat.where(programs > 0).select("path", "s", F.explode(F.sequence(F.lit(0), programs - 1)).alias("i")).where(B.u16(F.col("s"), 8 + 4 * F.col("i")) != 0).select("path", B.u16(F.col("s"), 10 + 4 * F.col("i")).bitwiseAND(F.lit(0x1FFF)).alias("pid"))
    tables = _sections(pkts.join(pmts.distinct(), ["path", "pid"]), 2)
    s = F.col("s")
    end = 3 + B.u16(s, 1).bitwiseAND(F.lit(0xFFF)) - 4
    first = 12 + B.u16(s, 10).bitwiseAND(F.lit(0xFFF))
    # Entries have lengths of their own, of 5 bytes or more.
    entries = F.aggregate(F.sequence(F.lit(0), F.greatest(F.floor((end - first) / 5), F.lit(0)).cast("int")), F.struct(first.cast("bigint").alias("at"), F.array().cast("array<struct<stream_type:bigint,pid:bigint>>").alias("out")), lambda a, _: F.when(
        a["at"] + 5 <= end, F.struct((a["at"] + 5 + B.u16(s, a["at"] + 3).bitwiseAND(F.lit(0xFFF))).alias("at"), F.concat(a["out"], F.array(F.struct(B.u8(s, a["at"]).alias("stream_type"), B.u16(s, a["at"] + 1).bitwiseAND(F.lit(0x1FFF)).alias("pid")))).alias("out"))).otherwise(a))
    return tables.select("path", F.explode(entries["out"]).alias("e")).select("path", "e.pid", "e.stream_type")


def pes(pkts: DataFrame, pids: DataFrame) -> DataFrame:
    """Each PES packet of the given pids: path, pid, stream_type, idx (of its first packet), pts_ms, dts_ms, payload. The last is closed by the end."""
    by = Window.partitionBy("path", "pid").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = pkts.join(pids, ["path", "pid"]).withColumn("n", F.sum(F.when(F.col("start"), 1).otherwise(0)).over(by)).where("n > 0")
    whole = rows.groupBy("path", "pid", "stream_type", "n").agg(F.min("idx").alias("idx"), F.expr("listagg(payload) WITHIN GROUP (ORDER BY idx)").alias("b"))
    b, flags = F.col("b"), B.field(B.u8(F.col("b"), 7), 6, 2)
    ms = lambda at: F.expr("bigint(0)") + F.floor(B.pts(b, F.lit(at)) / 90).cast("bigint")
    return whole.where((B.u24(b, 0) == 1) & (flags >= 2)).select("path", "pid", "stream_type", "idx", ms(9).alias("pts_ms"), F.when(flags == 3, ms(14)).otherwise(ms(9)).alias("dts_ms"), B.after(b, 9 + B.u8(b, 8)).alias("payload"))


def frames(files: DataFrame) -> DataFrame:
    """path, idx, media, codec, frame_type, dts_ms, pts_ms, size, payload of (path, content) rows, such as binaryFile gives."""
    pkts = packets(files)
    known = streams(pkts).where(F.col("stream_type").isin(*STREAM_TYPES))
    label = lambda n: F.element_at(F.create_map(*(x for k, v in STREAM_TYPES.items() for x in (F.lit(k).cast("bigint"), F.lit(v[n])))), F.col("stream_type"))
    out = pes(pkts, known).select("path", "idx", label(1).alias("media"), label(0).alias("codec"), "dts_ms", "pts_ms", F.octet_length("payload").cast("bigint").alias("size"), "payload")
    nals = codecs.nal_units(F.col("payload"))
    kind = F.when(F.col("codec") == "H264", codecs.h264_frame_type(F.col("_n"))).when(F.col("codec") == "H265", codecs.h265_frame_type(F.col("_n"))).otherwise("inter")
    return out.withColumn("_n", F.when(F.col("media") == "video", nals)).withColumn("frame_type", kind).drop("_n")


def _crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c ^= x << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
    return c


class Writer(Machine):
    """Tables before every video key; the program clock on the video pid when 40 ms have passed; headers give nothing."""

    VIDEO, AUDIO, PMT = 0x100, 0x101, 0x1000

    def __init__(self, video_type: int, audio_type: int):
        self.types, self.counters, self.clock = (video_type, audio_type), {}, None

    def _packet(self, pid: int, start: bool, data: bytes, pcr: int | None = None) -> tuple[bytes, bytes]:
        extra = b""
        if pcr is not None:
            extra = b"\x10" + (pcr << 15 | 0x7E00).to_bytes(6, "big")
        room = PACKET - 4 - (len(extra) + 1 if extra else 0)
        take, rest = data[:room], data[room:]
        gap = room - len(take)
        if extra or gap:
            extra = (extra or (b"\0" if gap > 1 else b"")) + b"\xff" * (gap - (0 if extra else min(2, gap)))
            field = bytes([len(extra)]) + extra
        else:
            field = b""
        count = self.counters[pid] = (self.counters.get(pid, -1) + 1) % 16
        return bytes([0x47, start << 6 | pid >> 8, pid & 255, (0x30 if field else 0x10) | count]) + field + take, rest

    def _section(self, pid: int, body: bytes) -> bytes:
        data = body + _crc(body).to_bytes(4, "big")
        return self._packet(pid, True, (b"\0" + data).ljust(PACKET - 4, b"\xff"))[0]

    def _tables(self) -> bytes:
        pat = b"\x00\xb0\x0d\x00\x01\xc1\x00\x00\x00\x01" + (0xE000 | self.PMT).to_bytes(2, "big")
        entries = b"".join(bytes([t]) + (0xE000 | p).to_bytes(2, "big") + b"\xf0\x00" for t, p in zip(self.types, (self.VIDEO, self.AUDIO)))
        pmt = b"\x02" + (0xB000 | 13 + len(entries)).to_bytes(2, "big") + b"\x00\x01\xc1\x00\x00" + (0xE000 | self.VIDEO).to_bytes(2, "big") + b"\xf0\x00" + entries
        return self._section(0, pat) + self._section(self.PMT, pmt)

    def step(self, row: tuple) -> list[tuple]:
        seq, media, kind, dts, pts, payload = row
        if kind == "seqhdr":
            return []
        video = media == "video"
        out = [self._tables()] if video and kind == "key" else []
        stamp = lambda tag, ms: (lambda t: bytes([tag << 4 | t >> 29 & 14 | 1]) + (t >> 14 & 0xFFFE | 1).to_bytes(2, "big") + (t << 1 & 0xFFFE | 1).to_bytes(2, "big"))(ms * 90 & (1 << 33) - 1)
        both = video and dts != pts
        head = (b"\x80\xc0\x0a" + stamp(3, pts) + stamp(1, dts)) if both else b"\x80\x80\x05" + stamp(2, pts)
        size = 0 if video else len(head) + len(payload)
        data = b"\0\0\1" + (b"\xe0" if video else b"\xc0") + (size if size < 65536 else 0).to_bytes(2, "big") + head + bytes(payload)
        pcr = None
        if video and (self.clock is None or dts - self.clock >= 40):
            self.clock, pcr = dts, dts * 90
        start = True
        while data:
            packet, data = self._packet(self.VIDEO if video else self.AUDIO, start, data, pcr)
            out.append(packet)
            start, pcr = False, None
        return [(seq, b"".join(out))]


def mux(frames: DataFrame, video_type: int = 0x1B, audio_type: int = 0x0F) -> DataFrame:
    """stream_key, seq, chunk: transport packets of each frame (columns with `payload`)."""
    return fold(frames, ["stream_key"], ["seq"], ["seq", "media", "frame_type", "dts_ms", "pts_ms", "payload"], lambda: Writer(video_type, audio_type), "seq bigint, chunk binary")


def joined(chunks: DataFrame) -> DataFrame:
    """One (path, content) row a stream."""
    return chunks.groupBy(F.col("stream_key").cast("string").alias("path")).agg(F.expr("listagg(chunk) WITHIN GROUP (ORDER BY seq)").alias("content"))
