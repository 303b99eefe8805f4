import json

from pyspark.sql import functions as F

from framewright.functions import auth, scalars as S
from framewright.operators import flow
from framewright.plans.frames import frames
from framewright.sources import texts
from framewright.streaming import stateful


def files(spark, *contents):
    return spark.createDataFrame([(str(i), c) for i, c in enumerate(contents)], "path string, content string")


def test_m3u8(spark):
    rows = texts.m3u8(files(spark, "#EXTM3U\r\n#EXT-X-MEDIA-SEQUENCE:7\r\n#EXTINF:2.5,\r\n7.ts\r\n#EXTINF:3.000,\r\n8.ts\r\n", "")).collect()
    assert [r[1:] for r in rows] == [(7, "7.ts", 2.5), (8, "8.ts", 3.0)]


def test_llhls(spark):
    text = '#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:10\n#EXT-X-SKIP:SKIPPED-SEGMENTS=3\n#EXT-X-PART:DURATION=0.2,URI="13.0.m4s",INDEPENDENT=YES\n#EXT-X-PART:DURATION=0.2,URI="13.1.m4s"\n#EXTINF:0.4,\n13.m4s\n#EXT-X-PART:DURATION=0.1,URI="14.0.m4s",INDEPENDENT=YES\n'
    rows = texts.llhls(files(spark, text))
    assert [r[1:] for r in rows.orderBy("msn", "part").collect()] == [(13, 0, "13.0.m4s", 0.2, True), (13, 1, "13.1.m4s", 0.2, False), (14, 0, "14.0.m4s", 0.1, True)]
    assert texts.next_blocking_request(rows).first()[1:] == (14, 1)
    assert texts.llhls(files(spark, text), count_skipped=False).agg(F.min("msn")).first()[0] == 10


def test_mpd(spark):
    text = '<MPD type="dynamic"><Period><AdaptationSet contentType="video"><SegmentTemplate timescale="1000" startNumber="5" media="v$Number$.m4s"><SegmentTimeline><S t="100" d="40" r="2"/><S d="50"/></SegmentTimeline></SegmentTemplate></AdaptationSet><AdaptationSet contentType="audio"><SegmentTemplate timescale="1" media="a"><SegmentTimeline><S d="3"/></SegmentTimeline></SegmentTemplate></AdaptationSet></Period></MPD>'
    rows = texts.mpd(files(spark, text)).orderBy(F.desc("content_type"), "number").collect()
    assert [(r.number, r.t, r.d) for r in rows] == [(5, 100, 40), (6, 140, 40), (7, 180, 40), (8, 220, 50), (1, 0, 3)]
    r = spark.range(1).select(texts.iso_seconds(F.lit("PT1H2M3.5S")).alias("a"), texts.iso_seconds(F.lit("PT2S")).alias("b"), texts.iso_seconds(F.lit("2S")).alias("c")).first()
    assert r[:] == (3723.5, 2.0, None)


def test_sdp(spark):
    text = "v=0\r\ns=x\r\nm=video 0 RTP/AVP 96 97\r\na=rtpmap:96 H264/90000\r\na=fmtp:96 packetization-mode=1;sprop-parameter-sets=Z0IAKQ==,aM4=\r\na=control:trackID=0\r\nm=audio 0 RTP/AVP 97\r\na=rtpmap:97 MPEG4-GENERIC/44100/2\r\nm=audio 5 RTP/AVP 8\r\n"
    rows = texts.sdp(files(spark, text)).orderBy("media", "port", F.desc("payload_type")).collect()
    assert [(r.media, r.payload_type, r.codec, r.clock_rate, r.channels) for r in rows] == [("audio", 97, "MPEG4-GENERIC", 44100, 2), ("audio", 8, "PCMA", None, 1), ("video", 96, "H264", 90000, None)]
    v = texts.sdp(files(spark, text)).where("media = 'video'").select(texts.sprop_nals(F.col("fmtp")).alias("n"), texts.track_id(F.col("control")).alias("t")).first()
    assert [bytes(x) for x in v.n] == [bytes.fromhex("67420029"), bytes.fromhex("68ce")] and v.t == 0


def test_xml_messages(spark):
    rows = [(1, "<?xml version='1.0'?><Response><CmdType>Catalog</CmdType><SN>1</SN><DeviceID>d1</DeviceID><DeviceList Num='1'><Item><DeviceID>c0</DeviceID><Name>old</Name></Item></DeviceList></Response>"),
            (2, "<Response><CmdType>Catalog</CmdType><DeviceID>d1</DeviceID><DeviceList><Item><DeviceID>c1</DeviceID><Name>a</Name></Item><Item><DeviceID>c2</DeviceID><Name>b</Name></Item></DeviceList></Response>"),
            (3, "<Notify><CmdType>Keepalive</CmdType><DeviceID>d1</DeviceID><Status>OK</Status></Notify>"), (4, "not xml"), (5, None)]
    m = texts.messages(spark.createDataFrame(rows, "seq int, content string"))
    assert [r.kind for r in m.orderBy("seq").collect()] == ["Catalog", "Catalog", "Keepalive", None, None]
    assert [r.channel_id for r in texts.catalog_state(m).orderBy("channel_id").collect()] == ["c1", "c2"]


def test_dump_and_json_names(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"a": {"DeviceID": "a", "Status": "online", "Channels": {"c": {"ChannelID": "c", "Latitude": 1.5}}}}))
    r = texts.restore_devices(spark, str(tmp_path / "d.json")).first()
    assert (r.id, r.Status, r.Channels["c"].Latitude) == ("a", "offline", 1.5)
    got = spark.createDataFrame([('["a","b"]',), ('[{"key":"k"},{"name":"n"}]',)], "t string").select(texts.names_of(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [["a", "b"], ["k", "n"]]


def test_scalars(spark):
    r = spark.range(1).select(
        S.parse_size(F.lit("2MB")).alias("a"), S.parse_size(F.lit("x")).alias("b"), S.stream_path(F.lit("/live/cam.flv")).alias("c"), S.stream_path(F.lit("/x")).alias("d"),
        S.client_ip(F.lit("1.2.3.4, 5.6.7.8"), F.lit(None).cast("string"), F.lit("9.9.9.9:1")).alias("e"), S.client_ip(F.lit(""), F.lit(""), F.lit("9.9.9.9:1")).alias("f"),
        S.glob_match("live/*", F.lit("live/a")).alias("g"), S.glob_match("live/*", F.lit("live/a/b")).alias("h"), S.glob_match("", F.lit("x")).alias("i"),
        S.ntp_time(F.lit(500_000)).alias("j"), S.ptz(F.lit(1), F.lit(0), F.lit(0)).alias("k"), S.seq_distance(F.lit(1), F.lit(65535)).alias("l"), S.rtp_clock(F.lit(1_700_000_000_123), 90_000).alias("m"),
    ).first()
    assert r[:9] == (2 << 20, None, "live/cam", None, "1.2.3.4", "9.9.9.9", True, False, True)
    assert int(r.j) == (2_208_988_800 << 32) + (1 << 31) and r.k == "A50F01010040" + f"{0:02X}{(0xB5 + 1 + 0x40) % 256:02X}" and r.l == 2 and r.m == 1_700_000_000_123 * 90 % (1 << 32)


def test_auth(spark):
    rows = auth.cases(spark).collect()
    assert len(rows) == 48 and all(r.allowed == (r.name == "valid") for r in rows)
    assert auth.check_token(auth.make_token("s"), "s", "any", "publish", 1) and not auth.check_token("a.b", "s", "", "", 0)
    r = spark.range(1).select(auth.hmac_hex("key", F.lit("data")).alias("h"), auth.session_token("key", F.lit(255)).alias("t"), auth.allowed("token+callback", F.lit(False), F.lit(True)).alias("o")).first()
    assert r.h == "5031fe3d989c6d1537a013fa6e739da23463fdaec3b70137d828e36ace221bd0" and r.t.startswith("ff.") and r.o


def streamed(spark, sf_dir, tmp_path, make, name):
    frames(spark, sf_dir).where("stream_key < 5").repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frames(spark, sf_dir).schema).parquet(str(tmp_path / "in"))
    q = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def test_stream_is_the_batch(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = streamed(spark, sf_dir, tmp_path, lambda s: stateful.streamed(s, ["seq", "dts_ms"], lambda: flow.Bucket(43_200_000, 3), "seq bigint, admitted boolean"), "bucket")
    want = flow.token_bucket(frames(spark, sf_dir).where("stream_key < 5"), 43_200_000, 3)
    assert sorted(got.collect()) == sorted(want.collect())


def test_windowed_stream(spark, sf_dir, tmp_path):
    rows = streamed(spark, sf_dir, tmp_path, lambda s: stateful.windowed_rates(s, "1 day", "2 days"), "rates").collect()
    want = {(r.stream_key, r.bucket): (r.bytes, r.frames) for r in flow.rate_windows(frames(spark, sf_dir), 86_400_000).collect()}
    assert rows and all(want[r.stream_key, int(r.start.timestamp() // 86400)] == (r.bytes, r.frames) for r in rows)


def test_written_playlists_read_back(spark, sf_dir):
    from framewright import queries as Q
    from framewright.operators import segments
    from framewright.sources import playlists

    f = frames(spark, sf_dir)
    parts = segments.llhls_parts(f, Q.PART, Q.SEGMENT)
    back = texts.llhls(playlists.llhls(parts, Q.PART).withColumnsRenamed({"stream_key": "path", "playlist": "content"}))
    kept = segments.newest(parts.groupBy("stream_key", "segment").count(), "stream_key", "segment", 4)
    assert sorted((r.path, r.msn, r.part, r.independent) for r in back.collect()) == sorted((r.stream_key, r.segment, r.part, r.independent) for r in parts.join(kept, ["stream_key", "segment"]).collect())
    timeline = segments.dash_timeline(f, keep=5)
    back = texts.mpd(playlists.mpd(timeline).withColumnsRenamed({"stream_key": "path", "mpd": "content"}))
    assert sorted((r.path, r.number, r.t, r.d) for r in back.collect()) == sorted((r.stream_key, r.segment, r.t, r.d) for r in timeline.collect())
    hls = segments.playlist(f).withColumnsRenamed({"stream_key": "path", "m3u8": "content"})
    assert texts.m3u8(hls).groupBy("path").count().agg(F.max("count")).first()[0] == 5
    assert "fps" in playlists.report_text(Q.quality.report(f)).first().report
