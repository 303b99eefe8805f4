"""Hand-made frames with hand-computed answers."""

import pytest
from pyspark.sql import functions as F

from framewright.model import FRAME_SCHEMA
from framewright.operators import flow, quality, segments


def make(spark, rows):
    """rows: (media, type, dts[, size[, pts]]), one stream, in order of arrival."""
    return spark.createDataFrame([("s" and 1, i, m, "H264" if m == "video" else "AAC", t, d, r[1] if len(r) > 1 else d, r[0] if r else 100) for i, (m, t, d, *r) in enumerate(rows)], FRAME_SCHEMA)


def test_quality_report(spark):
    video = [("video", "key" if i % 10 == 0 else "inter", 33 * i, 5000) for i in range(30)]
    audio = [("audio", "inter", 23 * i, 200) for i in range(43)]
    rows = sorted([("video", "seqhdr", 0, 50), *video, *audio], key=lambda r: r[2])
    r = quality.report(make(spark, rows)).first()
    assert (r.video_frames, r.video_bytes, r.audio_frames, r.audio_bytes, r.keyframes) == (30, 150_000, 43, 8600, 3)
    assert r.video_fps == pytest.approx(29 / 0.957) and r.keyframe_interval_s == pytest.approx(0.33)
    assert r.video_kbps == pytest.approx(150_000 * 8 / 957) and r.duration_ms == 966 and r.video_monotonic and r.audio_monotonic


def test_bitrate_and_times_that_go_back(spark):
    r = quality.report(make(spark, [("video", "inter", 100 * i, 1000) for i in range(10)])).first()
    assert r.video_kbps == pytest.approx(88.888, abs=0.01)
    r = quality.report(make(spark, [("video", "inter", d) for d in (0, 33, 66, 50, 132)])).first()
    assert not r.video_monotonic and r.video_fps == pytest.approx(4 / 0.132)
    assert quality.report(make(spark, [])).collect() == []


def test_stall_after_steady_frames(spark):
    times = [33 * i for i in range(20)]
    times += [times[-1] + 5000 + 33 * i for i in range(5)]
    rows = quality.stalls(make(spark, [("video", "inter", d) for d in times])).collect()
    assert [(r.gap_ms, r.median_ms) for r in rows] == [(5000, 33)]


def test_drift(spark):
    rows = []
    for i in range(20):
        rows += [("video", "inter", 33 * i), ("audio", "inter", 33 * i + 50 + 5 * i)]
    assert quality.drift(make(spark, rows)).first().max_drift_ms == 145


@pytest.mark.parametrize("text,ok,error", [("video.fps>=29", True, False), ("video.fps < 29", False, False), ("video.dts_monotonic==true", True, False), ("video.dts_monotonic>true", False, True), ("fps>1", False, True), ("video.none==1", False, True), ("video.fps==abc", False, True), ("video.fps", False, True), (">=3", False, True)])
def test_assertions(spark, text, ok, error):
    reports = quality.report(make(spark, [("video", "key", 33 * i) for i in range(30)]))
    r = quality.verdicts(reports, [text]).first()
    assert (r["pass"], r.is_error) == (ok, error)


def test_parts_and_segments(spark):
    rows = [("audio", "inter", -50)] + [("video", "key" if i in (0, 15) else "inter", 40 * i, 10) for i in range(20)]
    parts = segments.llhls_parts(make(spark, rows), 200).orderBy("segment", "part").collect()
    assert [(p.segment, p.part, p.start_ms, p.duration_ms, p.independent, p.frames) for p in parts] == [(0, 0, 0, 200, True, 5), (0, 1, 200, 200, False, 5), (0, 2, 400, 200, False, 5), (1, 0, 600, 200, True, 5)]


def test_late_audio_splits_a_long_segment(spark):
    rows = [("video", "key", 0)] + [("audio", "inter", 1000 * i) for i in range(1, 9)]
    assert {r.segment for r in segments.llhls_parts(make(spark, rows), 200, 6000).collect()} == {0, 1}


def test_parts_add_up_to_their_frames(spark, sf_dir):
    from framewright.plans.frames import frames

    f = frames(spark, sf_dir)
    assert segments.llhls_parts(f, 7_200_000, 1 << 60).agg(F.sum("frames"), F.sum("bytes")).first()[:] == segments.with_gop(f).agg(F.count("*"), F.sum("size")).first()[:]


def test_b_frames(spark):
    rows = [("video", "key", 0, 1, 0), ("video", "inter", 33, 1, 99), ("video", "inter", 66, 1, 33), ("video", "inter", 99, 1, 66), ("video", "inter", 132, 1, 99), ("video", "key", 165, 1, 50)]
    assert [r.seq for r in flow.b_frame_drop(make(spark, rows)).orderBy("seq").collect()] == [2, 3]


def test_token_bucket(spark):
    got = flow.token_bucket(make(spark, [("video", "inter", d) for d in (0, 1, 2, 3, 1000, 1001, 1002)]), 500, 3).orderBy("seq").collect()
    assert [r.admitted for r in got] == [True, True, True, False, True, True, False]


def test_slow_consumer_states(spark):
    rows = make(spark, [("video", t, i) for i, t in enumerate(["inter", "inter", "inter", "key", "inter", "inter"])] + [("audio", "inter", 9), ("video", "inter", 10)])
    lags = [0.1, 0.8, 0.95, 0.95, 0.8, 0.8, 0.8, 0.4]
    rows = rows.withColumn("lag", F.element_at(F.array(*map(F.lit, lags)), (F.col("seq") + 1).cast("int"))).withColumn("slow", F.lit(True))
    got = flow.slow_consumer(rows).orderBy("seq").collect()
    assert [r.state for r in got] == ["NORMAL", "DROP", "SKIP", "DROP", "DROP", "DROP", "DROP", "NORMAL"]
    assert [r.sent for r in got] == [True, False, False, True, False, False, True, True]


def test_ewma_starts_anew_at_zero(spark):
    got = flow.ewma(make(spark, [("video", "inter", i, s) for i, s in enumerate((0, 10, 20))]), 0.5).orderBy("seq").collect()
    assert [r.ewma for r in got] == [0, 10, 15]


def test_reorder(spark):
    def run(seqs, most=50):
        df = spark.createDataFrame([(1, s, i) for i, s in enumerate(seqs)], "stream_key bigint, rtp_seq bigint, arrival bigint")
        return [r.rtp_seq for r in flow.reorder(df, most).collect()]

    assert run([1, 3, 2, 4]) == [1, 2, 3, 4]
    assert run([65534, 0, 65535, 1]) == [65534, 65535, 0, 1]
    assert run([1, *range(3, 8)], most=3) == [1, 3, 4, 5, 6, 7]


def test_feedback_and_retry(spark):
    df = spark.range(1).select(*(flow.feedback_mode(F.lit(n), 3, 20).alias(f"m{n}") for n in (1, 3, 4, 20, 21)), flow.feedback_mode(F.lit(1), 0, 0).alias("none"), flow.retry_delays(F.lit(7)).alias("d"))
    r = df.first()
    assert [r.m1, r.m3, r.m4, r.m20, r.m21, r.none] == ["passthrough", "passthrough", "aggregate", "aggregate", "drop", "drop"]
    assert r.d == [1, 2, 4, 8, 16, 16, 16]


def test_fold_holds_little_of_a_batch(spark):
    """A worker takes a full batch apart step by step, and its keys and their order go on across the steps."""
    from framewright.operators.fold import Machine, fold

    class Count(Machine):
        n = 0

        def step(self, row):
            self.n += 1
            return [(row[0], self.n, bytes(row[1]), int(open("/proc/self/statm").read().split()[1]) * 4096)]

        def end(self):
            return [(-1, self.n, b"", 0)]

    def folded(rows, size):
        df = spark.range(rows).select((F.col("id") % 3).alias("key"), "id", F.repeat(F.lit("v"), F.lit(size)).cast("binary").alias("p")).withColumn("one", F.lit(1))
        return fold(df, ["one", "key"], ["id"], ["id", "p"], Count, "id bigint, n bigint, p binary, bytes bigint").select("key", "id", "n", F.octet_length("p").alias("size"), "bytes").collect()

    little, got = folded(6, 10), folded(20_000, 6_000)
    assert {(r.key, r.id, r.n, r.size) for r in got if r.id >= 0} == {(i % 3, i, i // 3 + 1, 6_000) for i in range(20_000)}
    assert sorted((r.key, r.n) for r in got if r.id < 0) == [(0, 6667), (1, 6667), (2, 6666)]
    assert max(r.bytes for r in got) - max(r.bytes for r in little) < 170_000_000
