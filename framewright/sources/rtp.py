"""RTP and RTCP captures as rows: header fields, access units, payload formats, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import bits as B, codecs
from ..model import CODECS

PAYLOAD_TYPES = {c[1]: c[4] for c in CODECS}
CLOCKS = {c[1]: c[3] for c in CODECS}


def headers(packets: DataFrame) -> DataFrame:
    """stream_key, idx and the header's fields of rows (stream_key, idx, data); no RTP version 2: dropped."""
    d, a, b = F.col("data"), B.u8(F.col("data"), 0), B.u8(F.col("data"), 1)
    fixed = 12 + 4 * B.field(a, 0, 4)
    skip = F.when(B.field(a, 4, 1) == 1, fixed + 4 + 4 * B.u16(d, fixed + 2)).otherwise(fixed)
    pad = F.when(B.field(a, 5, 1) == 1, B.u8(d, F.octet_length(d) - 1)).otherwise(F.lit(0))
    return packets.where((B.field(a, 6, 2) == 2) & (F.octet_length("data") >= 12)).select("stream_key", "idx", (B.field(b, 7, 1) == 1).alias("marker"), B.field(b, 0, 7).alias("payload_type"), B.u16(d, 2).alias("rtp_seq"), B.u32(d, 4).alias("rtp_ts"), B.u32(d, 8).alias("ssrc"), B.piece(d, skip, F.greatest(F.octet_length(d) - skip - pad, F.lit(0))).alias("payload"))


def framed_tcp(captures: DataFrame) -> DataFrame:
    """Packets of (stream_key, content) with two bytes of length before each, of 12 to 65535 bytes; a broken length ends a capture."""
    at = F.aggregate(F.sequence(F.lit(0), F.floor(F.octet_length("content") / 14).cast("int")), F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out")), lambda a, _: F.when((B.u16(F.col("content"), a["at"]) >= 12) & (a["at"] + 2 + B.u16(F.col("content"), a["at"]) <= F.octet_length("content")), F.struct((a["at"] + 2 + B.u16(F.col("content"), a["at"])).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))).otherwise(a))
    return captures.select("stream_key", "content", F.posexplode(at["out"]).alias("idx", "at")).select("stream_key", F.col("idx").cast("bigint").alias("idx"), B.piece(F.col("content"), F.col("at").cast("int") + 2, B.u16(F.col("content"), F.col("at")).cast("int")).alias("data"))


def access_units(rows: DataFrame) -> DataFrame:
    """rows with au_id: a unit ends with its marker."""
    by = Window.partitionBy("stream_key").orderBy("idx")
    return rows.withColumn("_m", F.lag("marker", 1, False).over(by)).withColumn("au_id", F.sum(F.when(F.col("_m"), 1).otherwise(0)).over(by)).drop("_m")


def _joined(rows: DataFrame, piece, key) -> DataFrame:
    rows = rows.select("stream_key", "au_id", "idx", "rtp_ts", piece.alias("piece"), key.alias("key"), "marker")
    return rows.groupBy("stream_key", "au_id").agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY idx)").alias("payload"), F.max("key").alias("key"), F.min("rtp_ts").alias("rtp_ts"), F.max("marker").alias("complete"))


def h264(rows: DataFrame) -> DataFrame:
    """Access units of H.264 payloads as Annex-B: single NAL units, STAP-A aggregates and FU-A fragments. Units without their marker are incomplete and left out."""
    p, head = F.col("payload"), B.u8(F.col("payload"), 0)
    kind, fu = B.field(head, 0, 5), B.u8(F.col("payload"), 1)
    code = F.lit(b"\0\0\0\1")
    first = F.concat(code, F.unhex(F.lpad(F.hex(head.bitwiseAND(F.lit(0xE0)) + B.field(fu, 0, 5)), 2, "0")), B.after(p, 2))
    inner = F.aggregate(F.sequence(F.lit(0), F.floor(F.octet_length(p) / 3).cast("int")), F.struct(F.lit(1).cast("bigint").alias("at"), F.lit(b"").alias("out")), lambda a, _: F.when(a["at"] + 2 < F.octet_length(p), F.struct((a["at"] + 2 + B.u16(p, a["at"])).alias("at"), F.concat(a["out"], code, B.piece(p, a["at"].cast("int") + 2, B.u16(p, a["at"]).cast("int"))).alias("out"))).otherwise(a))["out"]
    piece = F.when(kind == 28, F.when(B.field(fu, 7, 1) == 1, first).otherwise(B.after(p, 2))).when(kind == 24, inner).otherwise(F.concat(code, p))
    key = F.when(kind == 28, B.field(fu, 0, 5) == 5).otherwise(kind == 5)
    out = _joined(access_units(rows), piece, key).where("complete")
    return out.select("stream_key", "au_id", "rtp_ts", F.when(F.col("key"), "key").otherwise("inter").alias("frame_type"), "payload")


def h265(rows: DataFrame) -> DataFrame:
    """As h264, with FU packets (type 49) of H.265; aggregates are not taken."""
    p, head, fu = F.col("payload"), B.u16(F.col("payload"), 0), B.u8(F.col("payload"), 2)
    kind, code = B.field(head, 9, 6), F.lit(b"\0\0\0\1")
    first = F.concat(code, F.unhex(F.lpad(F.hex(head.bitwiseAND(F.lit(0x81FF)) + F.shiftleft(B.field(fu, 0, 6), 9)), 4, "0")), B.after(p, 3))
    piece = F.when(kind == 49, F.when(B.field(fu, 7, 1) == 1, first).otherwise(B.after(p, 3))).otherwise(F.concat(code, p))
    real = F.when(kind == 49, B.field(fu, 0, 6)).otherwise(kind)
    out = _joined(access_units(rows).where(kind != 48), piece, (real >= 16) & (real <= 23)).where("complete")
    return out.select("stream_key", "au_id", "rtp_ts", F.when(F.col("key"), "key").otherwise("inter").alias("frame_type"), "payload")


def has_sequence_header(data: Column) -> Column:
    """Is one of the OBUs a sequence header? They are walked by their sizes (LEB128, of up to four bytes); one without a size is the last."""
    def step(at: Column, _: Column) -> Column:
        head = B.u8(data, at.cast("int"))
        kind, sized = B.field(head, 3, 4), B.field(head, 1, 1) == 1
        begin = (at + 1 + B.field(head, 2, 1)).cast("int")
        size, length, more = F.lit(0).cast("bigint"), F.lit(0), F.lit(True)
        for k in range(4):
            x = F.coalesce(B.u8(data, begin + k), F.lit(0))
            size, length = F.when(more, size + F.shiftleft(x.bitwiseAND(F.lit(127)), 7 * k)).otherwise(size), F.when(more, F.lit(k + 1)).otherwise(length)
            more = more & (x >= 128)
        return F.when((at < 0) | head.isNull(), at).when(kind == 1, F.lit(-1).cast("bigint")).when(sized, begin + length + size).otherwise(F.octet_length(data).cast("bigint"))

    # An OBU has two bytes at least; the walk ends at -1 where a sequence header is.
    units = F.sequence(F.lit(0), F.floor(F.octet_length(data) / 2).cast("int"))
    return F.aggregate(units, F.lit(0).cast("bigint"), step) == -1


def one_byte_descriptor(rows: DataFrame, codec: str) -> DataFrame:
    """VP8, VP9 and AV1 as written with one byte of descriptor: keys by the frame's first bit, the last descriptor, or a sequence header."""
    p = F.col("payload")
    au = _joined(access_units(rows), B.after(p, 1), B.field(B.u8(p, 0), 6, 1) == 0).where("complete")
    data = F.col("payload")
    key = {"VP8": B.field(B.u8(data, 0), 0, 1) == 0, "VP9": F.col("key"), "AV1": has_sequence_header(data)}[codec]
    return au.select("stream_key", "au_id", "rtp_ts", F.when(key, "key").otherwise("inter").alias("frame_type"), "payload")


def one_packet(rows: DataFrame, skip: int = 0) -> DataFrame:
    """Audio of one packet a frame: skip bytes of payload header go (4 for AAC and MP3, 0 for G.711, G.722, G.729, Opus and Speex)."""
    return rows.select("stream_key", F.col("idx").alias("au_id"), "rtp_ts", F.lit("inter").alias("frame_type"), B.after(F.col("payload"), skip).alias("payload"))


def _stamped(rows: DataFrame, order: tuple[str, ...], payload_type: int, clock: int, ssrc: int) -> DataFrame:
    """RTP packets (stream_key, idx, data) of rows (stream_key, dts_ms, marker, body), numbered by order."""
    idx = F.row_number().over(Window.partitionBy("stream_key").orderBy(*order)) - 1
    hexed = lambda c, size: F.unhex(F.lpad(F.hex(c), 2 * size, "0"))
    ticks = F.pmod(F.expr(f"dts_ms * {clock} div 1000"), F.lit(1 << 32))
    head = F.concat(F.lit(b"\x80"), hexed(F.when(F.col("marker"), 128 + payload_type).otherwise(payload_type), 1), hexed(F.pmod(F.col("idx"), F.lit(65536)), 2), hexed(ticks, 4), F.lit(ssrc.to_bytes(4, "big")))
    return rows.withColumn("idx", idx.cast("bigint")).select("stream_key", "idx", F.concat(head, "body").alias("data"))


def packetize(frames: DataFrame, mtu: int = 1200, clock: int = 90_000, ssrc: int = 1) -> DataFrame:
    """RTP packets (stream_key, idx, data) of video frames with a one-byte descriptor: mtu - 1 bytes each, the last marked."""
    n = F.greatest(F.ceil(F.octet_length("payload") / (mtu - 1)), F.lit(1)).cast("int")
    rows = frames.select("stream_key", "seq", "dts_ms", "payload", n.alias("n")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    body = F.concat(F.when(F.col("i") == 0, F.lit(b"\x10")).otherwise(F.lit(b"\x00")), B.piece(F.col("payload"), F.col("i") * (mtu - 1), mtu - 1))
    return _stamped(rows.select("stream_key", "seq", "i", "dts_ms", (F.col("i") == F.col("n") - 1).alias("marker"), body.alias("body")), ("seq", "i"), 96, clock, ssrc)


def packetize_nals(frames: DataFrame, codec: str, mtu: int = 1200, ssrc: int = 1) -> DataFrame:
    """RTP packets of H264 or H265 frames whose payload is Annex-B: a NAL unit of up to mtu bytes is a packet, longer ones are cut to FU-A or FU fragments; a frame's last packet is marked.

    Frames without a NAL unit give no packets.
    """
    head = {"H264": 1, "H265": 2}[codec]  # bytes of a NAL unit's header; a fragment has one more
    chunk = mtu - head - 1
    nal, size = F.col("nal"), F.octet_length("nal")
    count = F.when(size <= mtu, 1).otherwise(F.ceil((size - head) / chunk)).cast("int")
    nals = codecs.nal_units(F.col("payload"))
    rows = frames.select("stream_key", "seq", "dts_ms", nals.alias("nals")).select("stream_key", "seq", "dts_ms", F.size("nals").alias("units"), F.posexplode("nals").alias("n", "nal")).where(size >= head)
    rows = rows.withColumn("parts", count).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    first, last = F.col("i") == 0, F.col("i") == F.col("parts") - 1
    byte = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    ends = F.when(first, 0x80).otherwise(0) + F.when(last, 0x40).otherwise(0)
    a = B.u8(nal, 0)
    if codec == "H264":
        fragment = F.concat(byte(a.bitwiseAND(F.lit(0xE0)) + 28), byte(ends + a.bitwiseAND(F.lit(31))))
    else:
        fragment = F.concat(byte(a.bitwiseAND(F.lit(0x81)) + (49 << 1)), B.piece(nal, 1, 1), byte(ends + B.field(a, 1, 6)))
    body = F.when(F.col("parts") == 1, nal).otherwise(F.concat(fragment, B.piece(nal, F.col("i") * chunk + head, chunk)))
    rows = rows.select("stream_key", "seq", "n", "i", "dts_ms", (last & (F.col("n") == F.col("units") - 1)).alias("marker"), body.alias("body"))
    return _stamped(rows, ("seq", "n", "i"), PAYLOAD_TYPES[codec], 90_000, ssrc)


def packetize_audio(frames: DataFrame, codec: str, ssrc: int = 2) -> DataFrame:
    """RTP packets of audio frames, one each, all marked: AAC behind one AU header, MP3 behind four void bytes, all other audio as it is."""
    size = F.unhex(F.right(F.concat(F.lit("0000"), F.hex(F.octet_length("payload") * 8)), F.lit(4)))
    head = {"AAC": F.concat(F.lit(b"\x00\x10"), size), "MP3": F.lit(b"\0\0\0\0")}.get(codec, F.lit(b""))
    rows = frames.select("stream_key", "seq", "dts_ms", F.lit(True).alias("marker"), F.concat(head, "payload").alias("body"))
    return _stamped(rows, ("seq",), PAYLOAD_TYPES[codec], CLOCKS[codec], ssrc)


def packetized(frames: DataFrame, codec: str, mtu: int = 1200) -> DataFrame:
    """RTP packets of frames of one codec."""
    if codec in ("H264", "H265"):
        return packetize_nals(frames, codec, mtu)
    return packetize(frames, mtu) if codec in ("VP8", "VP9", "AV1") else packetize_audio(frames, codec)


def depacketized(rows: DataFrame, codec: str) -> DataFrame:
    """Frames of RTP headers (`headers`) of one codec."""
    if codec in ("H264", "H265"):
        return (h264 if codec == "H264" else h265)(rows)
    return one_byte_descriptor(rows, codec) if codec in ("VP8", "VP9", "AV1") else one_packet(rows, 4 if codec in ("AAC", "MP3") else 0)


def rtcp(packets: DataFrame) -> DataFrame:
    """Sender and receiver reports, one row a report block (or one without): kind, ssrc, NTP and RTP time, counters, loss, jitter."""
    d = F.col("data")
    count, kind = B.field(B.u8(d, 0), 0, 5), B.u8(d, 1)
    sender = kind == 200
    first = F.when(sender, 28).otherwise(8)
    base = packets.where(kind.isin(200, 201) & (F.octet_length("data") >= 8)).select("stream_key", "idx", "data", F.explode_outer(F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1))).alias("block"))
    at = (first + 24 * F.col("block")).cast("int")
    only = lambda c: F.when(sender, c)
    ntp = F.conv(F.hex(B.piece(d, 8, 8)), 16, 10).cast("decimal(20,0)")
    return base.select("stream_key", "idx", F.when(sender, "SR").otherwise("RR").alias("kind"), B.u32(d, 4).alias("ssrc"), only(ntp).alias("ntp_time"), only(B.u32(d, 16)).alias("rtp_time"), only(B.u32(d, 20)).alias("packets"), only(B.u32(d, 24)).alias("octets"), "block", B.u32(d, at).alias("about"), B.u8(d, at + 4).alias("fraction_lost"), B.u24(d, at + 5).alias("lost"), B.u32(d, at + 8).alias("highest_seq"), B.u32(d, at + 12).alias("jitter"))


def build_rtcp(reports: DataFrame) -> DataFrame:
    """(stream_key, data): RTCP of rows (stream_key, kind, ssrc, ntp_time, rtp_time, packets, octets, about, fraction_lost, lost, highest_seq, jitter).

    SR and RR hold a report block where `about` is not null; BYE holds the ssrc alone.
    """
    u = lambda c, size: F.unhex(F.right(F.concat(F.lit("0" * 2 * size), F.hex(c)), F.lit(2 * size)))
    long = lambda c: u(F.coalesce(F.col(c), F.lit(0)).cast("bigint"), 4)
    one = F.col("about").isNotNull()
    block = F.concat(long("about"), u(F.coalesce("fraction_lost", F.lit(0)), 1), u(F.coalesce("lost", F.lit(0)), 3), long("highest_seq"), long("jitter"), F.lit(b"\0" * 8))
    ntp = F.unhex(F.lpad(F.conv(F.col("ntp_time").cast("string"), 10, 16), 16, "0"))
    sender = F.concat(ntp, long("rtp_time"), long("packets"), long("octets"))
    kind = F.col("kind")
    body = F.concat(long("ssrc"), F.when(kind == "SR", sender).otherwise(F.lit(b"")), F.when(one & (kind != "BYE"), block).otherwise(F.lit(b"")))
    number = F.when(kind == "SR", 200).when(kind == "RR", 201).otherwise(203)
    count = F.when(kind == "BYE", 1).otherwise(one.cast("int"))
    return reports.select("stream_key", F.concat(u(128 + count, 1), u(number, 1), u((F.octet_length(body) / 4).cast("int"), 2), body).alias("data"))


def goodbyes(packets: DataFrame) -> DataFrame:
    """stream_key, ssrc of BYE packets, one row a source."""
    d = F.col("data")
    bye = packets.where((B.u8(d, 1) == 203) & (B.field(B.u8(d, 0), 0, 5) > 0))
    return bye.select("stream_key", "data", F.explode(F.sequence(F.lit(0).cast("bigint"), B.field(B.u8(d, 0), 0, 5) - 1)).alias("i")).select("stream_key", B.u32(d, (4 + 4 * F.col("i")).cast("int")).alias("ssrc"))
