"""Byte formats: round trips and hand-written bytes."""

import pytest
from pyspark.sql import functions as F

from framewright.functions import bits as B, codecs
from framewright.sources import flv, mpegts, rtp

SPS = bytes.fromhex("6764001facd9405005bb011000000300100000030320f1831960")
FRAME = "stream_key bigint, seq bigint, media string, codec string, frame_type string, dts_ms bigint, pts_ms bigint, size bigint, payload binary"


def one(spark, data, *columns):
    return spark.createDataFrame([(bytearray(data),)], "b binary").select(*columns).first()


def test_bits(spark):
    b = F.col("b")
    r = one(spark, bytes([1, 2, 3, 4, 5]), B.u8(b, 0).alias("a"), B.u16(b, 1).alias("c"), B.u24(b, 2).alias("d"), B.u32(b, 1).alias("e"), B.u32(b, 2).alias("f"), B.after(b, 3).alias("g"), B.after(b, 9).alias("h"))
    assert r[:5] == (1, 0x203, 0x30405, 0x2030405, None) and bytes(r.g) == b"\4\5" and bytes(r.h) == b""


def test_codec_headers(spark):
    b = F.col("b")
    assert one(spark, bytes.fromhex("1210"), codecs.aac_config(b).alias("x")).x[:] == (2, 44100, 2)
    assert codecs.build_aac_config(2, 44100, 2) == bytes.fromhex("1210")
    assert one(spark, b"\x12", codecs.aac_config(b).alias("x")).x is None
    assert one(spark, bytes.fromhex("fff15080021ffc"), codecs.adts(b).alias("x")).x[:] == (2, 44100, 2, 16, 7)
    assert one(spark, bytes.fromhex("fffb9064"), codecs.mp3_header(b).alias("x")).x[:] == ("1", 44100, 2, 128)
    assert one(spark, b"OpusHead\x01\x02\x38\x01\x80\xbb\0\0\0\0\0", codecs.opus_head(b).alias("x")).x[:] == (2, 312, 48000)
    assert one(spark, SPS, codecs.h264_sps(b).alias("x")).x[:] == (100, 31, 1280, 720)
    assert one(spark, b"\x67", codecs.h264_sps(b).alias("x")).x[2] is None
    assert one(spark, b"123456789", codecs.crc32_mpeg2(b).alias("x")).x == 0x0376E6E7
    assert one(spark, b"\0", codecs.profile_name(F.lit(100)).alias("p"), codecs.level_name(F.lit(31)).alias("l"))[:] == ("High", "3.1")


def test_nal_units(spark):
    b = F.col("b")
    data = b"\0\0\0\1" + SPS + b"\0\0\1\x68\xee\0\0\0\1\x65\x01\x02"
    nals = codecs.nal_units(b)
    r = one(spark, data, nals.alias("n"), codecs.h264_frame_type(nals).alias("t"), codecs.length_prefixed(nals).alias("l"), codecs.avc_config(F.get(nals, 0), F.get(nals, 1)).alias("c"))
    assert [bytes(x)[0] & 31 for x in r.n] == [7, 8, 5] and r.t == "key"
    assert bytes(r.l)[:4] == len(SPS).to_bytes(4, "big") and len(r.l) == 12 + len(SPS) + 2 + 3
    assert bytes(r.c)[:6] == b"\x01" + SPS[1:4] + b"\xff\xe1"
    assert one(spark, b"\0\0\1\x67\1\0\0\1\x68\1", codecs.h264_frame_type(nals).alias("t")).t == "seqhdr"
    assert one(spark, b"\0\0\1\x41\1", codecs.h264_frame_type(nals).alias("t")).t == "inter"


def frames(spark):
    key = b"\0\0\0\1\x65" + bytes(range(1, 200)) * 3
    inter = b"\0\0\0\1\x41" + b"\7" * 50
    rows = [
        (1, 0, "video", "H264", "seqhdr", 0, 0, b"\1\x64"), (1, 1, "audio", "AAC", "seqhdr", 0, 0, b"\x12\x10"), (1, 2, "video", "H264", "key", 0, 80, key), (1, 3, "audio", "AAC", "inter", 10, 10, b"\xff\xf1" * 20),
        (1, 4, "video", "H264", "inter", 40, 20, inter), (1, 5, "video", "H264", "inter", 80, 40, b"\0\0\0\1\x41" + b"\7" * 400), (1, 6, "audio", "AAC", "inter", 33, 33, b"z" * 183), (1, 7, "video", "H264", "key", 20_000_000, 20_000_000, key),
        (2, 0, "video", "H264", "key", 5, 5, key[:184]), (2, 1, "audio", "AAC", "inter", 7, 7, b"q"),
    ]
    return spark.createDataFrame([(*r[:7], len(r[7]), bytearray(r[7])) for r in rows], FRAME)


def shown(rows, without=()):
    return sorted((str(r[0]), r.media, r.codec, r.frame_type, r.dts_ms, r.pts_ms, bytes(r.payload)) for r in rows if r.frame_type not in without)


def test_flv_round_trip(spark):
    f = frames(spark)
    assert shown(flv.frames(flv.mux(f)).collect()) == shown(f.collect())
    assert flv.frames(spark.createDataFrame([("x", bytearray(b"not flv")), ("y", bytearray(b""))], "path string, content binary")).collect() == []


def test_flv_other_codecs(spark):
    rows = [(1, 0, "video", c, "key", 0, 0, 3, bytearray(b"abc")) for c in ("H265", "AV1", "VP9")] + [(1, 0, "audio", c, "inter", 0, 0, 3, bytearray(b"abc")) for c in ("Opus", "MP3")]
    for i, r in enumerate(rows):
        f = spark.createDataFrame([r], FRAME)
        assert shown(flv.frames(flv.mux(f)).collect()) == shown(f.collect())


def test_ts_round_trip(spark):
    f = frames(spark)
    files = mpegts.joined(mpegts.mux(f))
    assert all(len(r.content) % 188 == 0 for r in files.collect())
    assert shown(mpegts.frames(files).collect()) == shown(f.collect(), ("seqhdr",))


def test_ts_finds_its_first_packet(spark):
    f = frames(spark)
    files = mpegts.joined(mpegts.mux(f)).withColumn("content", F.concat(F.lit(b"\x47garbage"), "content", F.lit(b"\x47tail")))
    assert shown(mpegts.frames(files).collect()) == shown(f.collect(), ("seqhdr",))
    assert mpegts.frames(spark.createDataFrame([("x", bytearray(b"\1" * 400)), ("y", bytearray(b""))], "path string, content binary")).collect() == []


def test_ts_syncs_again(spark):
    """A byte lost or added in mid-file, or much junk in front, costs one packet at most."""
    content = bytes(mpegts.joined(mpegts.mux(frames(spark))).first().content)
    count, at = len(content) // 188, len(content) // 188 // 2 * 188
    cases = {"lost": content[: at + 50] + content[at + 51 :], "added": content[:at] + b"\1" + content[at:], "junk": b"\1" * 1000 + content}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "path string, content binary")
    found = {r.path: r["count"] for r in mpegts.packets(df).groupBy("path").count().collect()}
    assert found == {"lost": count - 1, "added": count, "junk": count}


def test_ts_table_over_packets(spark):
    """A program map of 150 streams takes more than four packets."""
    w = mpegts.Writer(0x1B, 0x0F)
    entries = b"".join(bytes([0x1B]) + (0xE000 | 0x200 + i).to_bytes(2, "big") + b"\xf0\x00" for i in range(150))
    body = b"\x02" + (0xB000 | 13 + len(entries)).to_bytes(2, "big") + b"\x00\x01\xc1\x00\x00\xe2\x00\xf0\x00" + entries
    rest, start, out = b"\0" + body + mpegts._crc(body).to_bytes(4, "big"), True, w._tables()[:188]
    while rest:
        packet, rest = w._packet(w.PMT, start, rest)
        out, start = out + packet, False
    df = spark.createDataFrame([("x", bytearray(out))], "path string, content binary")
    assert sorted(r.pid for r in mpegts.streams(mpegts.packets(df)).collect()) == list(range(0x200, 0x200 + 150))


@pytest.mark.parametrize("codec", ["VP8", "VP9", "AV1"])
def test_rtp_round_trip(spark, codec):
    f = frames(spark).where("media = 'video' AND stream_key = 1")
    packets = rtp.packetize(f, 100)
    h = rtp.headers(packets)
    assert h.agg(F.max(F.octet_length("payload"))).first()[0] == 100
    got = rtp.one_byte_descriptor(h, codec).orderBy("au_id").collect()
    want = f.orderBy("seq").collect()
    assert [bytes(r.payload) for r in got] == [bytes(r.payload) for r in want]
    assert [r.rtp_ts for r in got] == [r.dts_ms * 90 for r in want]


def test_h264_payloads(spark):
    rows = [(0, True, b"\x67\1\2"), (1, False, b"\x7c\x85ab"), (2, False, b"\x7c\x05cd"), (3, True, b"\x7c\x45ef"), (4, True, b"\x78\0\2\x67\1\0\3\x68\2\3"), (5, False, b"\x41lost")]
    df = spark.createDataFrame([(1, i, m, 0, bytearray(p)) for i, m, p in rows], "stream_key int, idx bigint, marker boolean, rtp_ts bigint, payload binary")
    got = rtp.h264(df).orderBy("au_id").collect()
    assert [(r.frame_type, bytes(r.payload)) for r in got] == [("inter", b"\0\0\0\1\x67\1\2"), ("key", b"\0\0\0\1\x65abcdef"), ("inter", b"\0\0\0\1\x67\1\0\0\0\1\x68\2\3")]


def test_tcp_frames_and_rtcp(spark):
    sr = bytes.fromhex("81c8000c00000007" "0000000100000002" "0000000300000004" "00000005" "00000009" "0a00000b" "0000ffff" "0000000c") + b"\0" * 8
    cap = spark.createDataFrame([(1, bytearray(len(sr).to_bytes(2, "big") + sr + b"\0\x0c" + b"\x80\x60" + b"\0" * 10 + b"\0\1x"))], "stream_key int, content binary")
    rows = rtp.framed_tcp(cap).orderBy("idx").collect()
    assert [bytes(r.data) for r in rows] == [sr, b"\x80\x60" + b"\0" * 10]
    r = rtp.rtcp(rtp.framed_tcp(cap)).first()
    assert (r.kind, r.ssrc, int(r.ntp_time), r.rtp_time, r.packets, r.octets, r.about, r.fraction_lost, r.lost, r.highest_seq, r.jitter) == ("SR", 7, (1 << 32) + 2, 3, 4, 5, 9, 10, 11, 65535, 12)


def test_looped(spark):
    f = frames(spark).where("stream_key = 2")
    assert [r.dts_ms for r in flv.looped(f, 3).orderBy("seq").collect()] == [5, 7, 45, 47, 85, 87]
    assert flv.looped(f, 3, until_ms=45).count() == 3


def test_ps_round_trip(spark):
    from framewright.sources import mpegps

    f = frames(spark)
    got = mpegps.frames(mpegps.mux(f, most=100)).collect()
    want = f.where("frame_type <> 'seqhdr'").withColumn("frame_type", F.when(F.col("media") == "audio", "key").otherwise(F.col("frame_type"))).collect()
    assert shown(got) == shown(want)
    assert mpegps.frames(spark.createDataFrame([("x", bytearray(b"\1" * 40)), ("y", None)], "path string, content binary")).collect() == []


def test_fmp4_round_trip(spark):
    from framewright.sources import fmp4

    f = frames(spark).withColumn("segment", F.when(F.col("seq") < 5, 0).otherwise(1))
    got = fmp4.frames(fmp4.mux(f)).collect()
    want = f.where("frame_type <> 'seqhdr'").collect()
    key = lambda r: (r[0] if isinstance(r[0], str) else str(r[0]), r.media, r.frame_type, r.dts_ms, r.pts_ms, bytes(r.payload))
    assert sorted(map(key, got)) == sorted(map(key, want))
    t = fmp4.tracks(fmp4.boxes(fmp4.mux(f))).where("path = '1'").orderBy("track_id").collect()
    assert [(r.track_id, r.media, r.timescale) for r in t] == [(1, "video", 90000), (2, "audio", 48000)]
    assert fmp4.frames(spark.createDataFrame([("x", bytearray(b"\0\0\0\1abcd"))], "path string, content binary")).collect() == []


def test_rtmp_interleaved_amf0(spark):
    from framewright.sources import walk

    first = bytes([0x03]) + b"\0\0\x0a" + b"\0\0\x05" + b"\x14" + (7).to_bytes(4, "little") + b"hello"
    size = bytes([0x02]) + b"\0\0\0" + b"\0\0\4" + b"\1" + b"\0" * 4 + (300).to_bytes(4, "big")
    long = bytes([0x04]) + b"\0\0\x14" + (200).to_bytes(3, "big") + b"\x09" + b"\1\0\0\0" + b"v" * 200
    delta = bytes([0x44]) + b"\0\0\x05" + (2).to_bytes(3, "big") + b"\x09" + b"xy"
    again = bytes([0xC4]) + b"zz"
    rows = walk.walked(spark.createDataFrame([("c", bytearray(first + size + long + delta + again))], "path string, content binary"), walk.rtmp_messages, "cs bigint, kind bigint, stream bigint, time bigint, body binary").orderBy("idx").collect()
    assert [(r.cs, r.kind, r.stream, r.time, len(r.body)) for r in rows] == [(3, 20, 7, 10, 5), (2, 1, 0, 0, 4), (4, 9, 1, 20, 200), (4, 9, 1, 25, 2), (4, 9, 1, 25, 2)]
    assert list(walk.rtmp_messages(b"\x04\0\0\0" + (300).to_bytes(3, "big") + b"\x09\1\0\0\0" + b"v" * 128 + b"\xc4" + b"v" * 128 + b"\xc4" + b"v" * 44))[0][4] == b"v" * 300
    assert list(walk.interleaved(b"$\0\0\2ab$\1\0\1c$\0\0\x09x")) == [(0, b"ab"), (1, b"c")]
    values = ["connect", 1.0, {"app": "live", "n": None, "ok": True}, None, [1.0, "a"]]
    assert walk.amf0(walk.to_amf0(*values)) == values and walk.amf0(b"\2\0\1a\x63") == ["a"]


def test_walk_holds_few_files(spark):
    """Many files of one partition go to a worker in small batches; files of one part and of many come back whole, null and empty ones have no pieces."""
    from framewright.sources import walk

    def held(data):
        if data:
            yield len(data), int(open("/proc/self/statm").read().split()[1]) * 4096, data[:3] + data[-3:]

    def walked(sizes):
        rows = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n int").coalesce(1)
        files = rows.select(F.col("i").cast("string").alias("path"), F.concat(F.repeat(F.lit("v"), F.col("n") - 1), F.lit("z")).cast("binary").alias("content"))
        none = spark.createDataFrame([("null", None), ("empty", bytearray(b""))], "path string, content binary")
        return walk.walked(files.unionByName(none), held, "n bigint, bytes bigint, ends binary").collect()

    sizes = [1, 1023, 1024, 1025, 4096, *[900_000] * 100]
    little, got = walked(sizes[:5]), walked(sizes)
    assert {int(r.path): r.n for r in got} == dict(enumerate(sizes)) and len(got) == len(sizes)
    assert {bytes(r.ends) for r in got if r.n > 4096} == {b"vvvvvz"}
    assert max(r.bytes for r in got) - max(r.bytes for r in little) < 60_000_000
