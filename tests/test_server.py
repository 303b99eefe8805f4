"""The server's own view, and the scalars that its paths, sizes and names go through."""

import pytest
from pyspark.sql import functions as F

from framewright.functions import codecs, scalars as S
from framewright.operators import catalog, server
from framewright.server_queries import ASC, SPS


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("path, want", [("/live/stream1.flv", ("live", "stream1", "flv")), ("/live/a/b.m3u8", ("live", "a/b", "m3u8")), ("/live/cam.v1.ts", ("live", "cam.v1", "ts")), ("//live/./x/../cam.flv", ("live", "cam", "flv")), ("/live/cam", None), ("/cam.flv", None), ("/live/.flv", None), ("/live/cam.", None), ("/", None), ("", None)])
def test_stream_parts(spark, path, want):
    found = one(spark, S.stream_parts(F.lit(path)))
    assert (found and tuple(found)) == want
    assert one(spark, S.stream_path(F.lit(path))) == (want and f"{want[0]}/{want[1]}")


@pytest.mark.parametrize("path, want", [("/live/cam/3.ts", ("live", "cam", "3", "ts")), ("/live/cam/init.mp4", ("live", "cam", "init", "mp4")), ("/live/cam/x/y.m4s", ("live", "cam", "x/y", "m4s")), ("/live/3.ts", None), ("/live/cam/3", None)])
def test_segment_parts(spark, path, want):
    found = one(spark, S.segment_parts(F.lit(path)))
    assert (found and tuple(found)) == want


@pytest.mark.parametrize("text, want", [("publish:/live/a", ("publish", "live/a")), ("subscribe:/live/a?x=1", ("subscribe", "live/a")), ("#!::r=/live/a,m=publish", ("publish", "live/a")), ("#!::m=request,r=live/a", ("request", "live/a")), ("#!::r=live/a", ("subscribe", "live/a")), ("#!::r=x,r=y,z", ("subscribe", "y")), ("/live/a", ("subscribe", "live/a")), ("play:live/a", ("subscribe", "play:live/a")), ("", ("subscribe", ""))])
def test_srt_stream_id(spark, text, want):
    assert tuple(one(spark, S.srt_stream_id(F.lit(text)))) == want


@pytest.mark.parametrize("text, want", [("512MB", 512 << 20), ("1GB", 1 << 30), ("100KB", 100 << 10), ("10kb", 10240), (" 2 gb ", 2 << 30), ("7", 7), ("7b", 7), ("1.5MB", 1 << 20), ("", None), ("x", None), ("0MB", None), ("-3KB", None)])
def test_parse_size(spark, text, want):
    assert one(spark, S.parse_size(F.lit(text))) == want


@pytest.mark.parametrize("moves, want", [((0, 0, 0), (0, 0, 0, 0)), ((0, 1, 0), (8, 0, 0, 0x40)), ((0, -1, 0), (4, 0, 0, 0x40)), ((-1, 0, 0), (2, 0, 0x40, 0)), ((1, 0, 0), (1, 0, 0x40, 0)), ((0, 0, 1), (0, 0x10, 0, 0)), ((0, 0, -1), (0, 0x20, 0, 0)), ((-1, 1, 0), (0x0A, 0, 0x40, 0x40))])
def test_ptz(spark, moves, want):
    data = bytes.fromhex(one(spark, S.ptz(*map(F.lit, moves))))
    assert tuple(data[3:7]) == want and data[:3] == b"\xa5\x0f\x01" and data[7] == sum(data[:7]) % 256


def test_profile_names(spark):
    names = [r.x for r in spark.createDataFrame([(p,) for p in (66, 244, 99)], "p int").select(codecs.profile_name(F.col("p")).alias("x")).collect()]
    assert names == ["Baseline", "High 4:4:4 Predictive", "Profile(99)"]


def test_codec_matrix_needs_both(spark):
    rows = {(r.source, r.target): r.possible for r in catalog.codec_matrix(spark).collect()}
    assert not rows["G729", "G729"] and rows["AAC", "AAC"] and rows["G711A", "Opus"] and not rows["G729", "AAC"]


def test_codec_report_keeps_what_was_read(spark):
    """A later header that can't be read changes the codec's name alone."""
    rows = [(1, 0, "video", "H264", SPS), (1, 1, "audio", "AAC", ASC), (1, 2, "video", "H264", b"\x67"), (2, 0, "video", "H265", b""), (3, 0, "audio", "AAC", b"\x12")]
    df = spark.createDataFrame([(*r[:4], bytearray(r[4])) for r in rows], "stream_key int, seq int, media string, codec string, payload binary")
    got = {r.stream_key: r[1:] for r in server.codec_report(df).collect()}
    assert got[1] == ("H264", "High", "3.1", "1280x720", True, "AAC", 44100, 2, True)
    assert got[2] == ("H265", None, None, None, True, None, None, None, False)
    assert got[3] == (None, None, None, None, False, "AAC", None, None, False)


def test_shared_starts_and_ends(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate((-1, 1, 1, -1, -1, -1, 1))], "key string, n int, step int")
    rows = server.shared(df, "key").orderBy("n").collect()
    assert [(r.readers, r.event) for r in rows] == [(0, None), (1, "started"), (2, None), (1, None), (0, "ended"), (0, None), (1, "started")]


def test_details_of_what_is_not_there(spark):
    streams = spark.createDataFrame([(1, "publishing"), (2, "destroying")], "stream_key long, state string")
    asked = spark.createDataFrame([(i, f"/api/v1/streams/{k}") for i, k in enumerate(("1", "2", "3", "", "1/kick"))], "request_id int, path string")
    assert [(r.status, r.stream_key) for r in server.details(streams, asked).orderBy("request_id").collect()] == [(200, 1), (404, None), (404, None), (400, None), (200, 1)]


def test_admission_is_that_of_one_pass(spark, sf_dir, monkeypatch):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    want, open_, refused = {}, {}, {}
    for r in events.orderBy("event_id").collect():
        day = str(r.ts.date())
        if r.event_type in ("signup", "purchase"):
            open_[day] = max(0, open_.get(day, 0) + (1 if r.event_type == "signup" else -1))
            if r.event_type == "signup" and open_[day] > 2:
                refused[day] = refused.get(day, 0) + 1
    for block in (7, 10_000):
        monkeypatch.setattr(catalog, "ADMITTED", block)
        assert {r.day: r.refused for r in catalog.admission(events, 2).collect()} == refused


def test_spark_entry_ships_the_package():
    import zipfile

    import __spark_entry__ as entry

    names = zipfile.ZipFile(entry._archive()).namelist()
    assert "framewright/queries.py" in names and "framewright/operators/server.py" in names
