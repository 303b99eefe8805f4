from pyspark.sql import functions as F

from framewright.operators import tracks
from framewright.sources import mpegps, rtp, texts


def test_annex_b_units(spark):
    data = b"\0\0\0\1\x67S\0\0\1\x68P\0\0\1\x65I" + b"\0\0\1\x41A" + b"\0\0\1\x41B" + b"\0\0\1\x67S\0\0\1\x65J"
    units = tracks.annex_b_units(spark.createDataFrame([("x", bytearray(data))], "path string, content binary"), 25)
    rows = units.orderBy("unit").collect()
    assert [(r.dts_ms, r.frame_type, len(r.nals)) for r in rows] == [(0, "key", 3), (40, "inter", 1), (80, "inter", 1), (120, "key", 2)]
    apart = tracks.headers_apart(units).orderBy("unit", "part").collect()
    assert [(r.frame_type, len(r.nals)) for r in apart] == [("seqhdr", 2), ("key", 1), ("inter", 1), ("inter", 1), ("seqhdr", 1), ("key", 1)]


def test_requests_and_headers(spark):
    text = "SETUP rtsp://h/live/a RTSP/1.0\r\nCSeq: 3\r\nTransport: RTP/AVP/TCP;unicast;interleaved=2-3\r\nCSeq: 9\r\n\r\nbody"
    r = spark.range(1).select(tracks.rtsp_request(F.lit(text)).alias("r")).select("r.*", tracks.transport_header(F.col("r.headers")["transport"]).alias("t")).first()
    assert (r["method"], r.url, r.version, r.headers["cseq"], r.body) == ("SETUP", "rtsp://h/live/a", "RTSP/1.0", "3", "body") and r.t[:] == ("tcp", "unicast", None, 2)
    m = spark.range(1).select(tracks.with_packetization_mode(F.lit("96 a=1")).alias("a"), tracks.claims_match(F.lit(None), F.lit("x")).alias("b"), tracks.relay_target(F.lit("s"), F.lit(None), F.lit("priority")).alias("c"), tracks.available(F.lit(3), F.lit(1), F.lit(3), F.lit(1)).alias("d"), tracks.available(F.lit(3), F.lit(None), F.lit(3), F.lit(1)).alias("e")).first()
    assert m[:] == ("96 a=1;packetization-mode=1", True, "s", True, False)


def test_media_info(spark):
    text = "m=audio 0 RTP/AVP 97\na=rtpmap:97 opus/48000/2\nm=video 0 RTP/AVP 96\na=rtpmap:96 h264/90000\n"
    rows = texts.sdp(spark.createDataFrame([("x", text)], "path string, content string"))
    assert tracks.media_info(rows).first()[1:] == ("H264", "OPUS", 48000, 2)


def test_moves(spark):
    """A player's and a publisher's way, and moves that are refused."""
    good = [("init", "describe", "described"), ("described", "setup", "ready"), ("ready", "play", "playing"), ("playing", "pause", "ready"), ("playing", "teardown", "closed"), ("init", "announce", "announced"), ("announced", "setup", "ready"), ("ready", "record", "recording"), ("recording", "teardown", "closed"), ("init", "teardown", "closed")]
    bad = [("init", "play", None), ("init", "setup", None), ("ready", "setup", None), ("recording", "pause", None), ("closed", "describe", None), ("described", "play", None), ("init", "other", None)]
    df = spark.createDataFrame([(i, s, r) for i, (s, r, _) in enumerate(good + bad)], "session int, state string, request string")
    assert [r.next_state for r in tracks.moves(df).orderBy("session").collect()] == [t for _, _, t in good + bad]


def test_sessions_expire(spark):
    df = spark.createDataFrame([(1, 0, "described"), (1, 39, "ready"), (1, 90, None), (2, 40, "described"), (3, 5, None)], "session int, at_s long, next_state string")
    assert sorted((r.session, r.idle_s, r.expired) for r in tracks.expired(df, F.lit(100)).collect()) == [(1, 61, True), (2, 60, False), (3, None, None)]


def test_media_info_goes_by_place(spark):
    """Ports are often 0; the first of each medium counts, not the least payload type."""
    text = "m=video 0 RTP/AVP 98\na=rtpmap:98 VP9/90000\nm=video 0 RTP/AVP 96\na=rtpmap:96 h264/90000\nm=audio 0 RTP/AVP 111\na=rtpmap:111 opus/48000/2\nm=audio 0 RTP/AVP 0\n"
    rows = texts.sdp(spark.createDataFrame([("x", text)], "path string, content string"))
    assert tracks.media_info(rows).first()[1:] == ("VP9", "OPUS", 48000, 2)


def test_requests_keep_all_headers(spark):
    text = "OPTIONS * RTSP/1.0\r\n" + "".join(f"X-{i}: {i}\r\n" for i in range(1500)) + "\r\n"
    headers = spark.range(1).select(tracks.rtsp_request(F.lit(text))["headers"].alias("h")).first().h
    assert len(headers) == 1500 and headers["x-1499"] == "1499"


def test_program_stream_over_rtp(spark):
    """Packets of one access unit joined to the marker are program-stream bytes."""
    from .test_sources import frames, shown

    f = frames(spark).where("stream_key = 1")
    content = bytes(mpegps.mux(f).first().content)
    parts = [content[i : i + 500] for i in range(0, len(content), 500)]
    rows = spark.createDataFrame([(1, i, i == len(parts) - 1, 0, bytearray(p)) for i, p in enumerate(parts)], "stream_key int, idx bigint, marker boolean, rtp_ts bigint, payload binary")
    joined = rtp.access_units(rows).groupBy(F.col("stream_key").cast("string").alias("path"), "au_id").agg(F.expr("listagg(payload) WITHIN GROUP (ORDER BY idx)").alias("content"))
    assert shown(mpegps.frames(joined.select("path", "content")).collect()) == shown(mpegps.frames(mpegps.mux(f)).collect())


def test_stream_info_counts_all_rows(spark):
    rows = spark.createDataFrame([(1, "view")] * 3 + [(1, "click"), (2, "view")], "user_id int, event_type string")
    other = spark.createDataFrame([(1, "view")] * 5 + [(1, "error"), (3, "error")], "user_id int, event_type string")
    assert sorted(r[:] for r in tracks.stream_info(rows, other).collect()) == [(1, "click", 1), (1, "error", 1), (1, "view", 5), (2, "view", 1), (3, "error", 1)]


def test_reorder_gets_all_packets_and_passes_lost_ones(spark, sf_dir):
    from framewright import queries as Q
    from framewright.operators import flow

    f = Q.frames(spark, sf_dir)
    assert len(Q.QUERIES["reorder_emit"](spark, sf_dir).collect()) == f.count()
    lost = spark.createDataFrame([(1, s, i) for i, s in enumerate((65533, 65535, 65534, 2, 1, 4, 3))], "stream_key long, rtp_seq long, arrival long")
    assert [r.rtp_seq for r in flow.reorder(lost, 3).collect()] == [65533, 65534, 65535, 1, 2, 3, 4]
