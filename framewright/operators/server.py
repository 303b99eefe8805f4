"""The server's own view of its streams: states, listing and details, statistics, metrics, shared readers, relays, reports of codecs and of probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import codecs
from . import flow, segments

# The default bounds of a latency histogram, in seconds.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
#: Audio that goes into FLV and RTMP as it is; all other is made AAC first.
FLV_AUDIO = ("AAC", "MP3")


def streams(frames: DataFrame, timeout_ms: int) -> DataFrame:
    """stream_key, first_ms, last_ms, bytes, video_frames, audio_frames, state: `destroying` where the newest frame of all is later than the last by more than the time-out."""
    newest = frames.agg(F.max("dts_ms")).first()[0]
    rows = frames.groupBy("stream_key").agg(
        F.min("dts_ms").alias("first_ms"), F.max("dts_ms").alias("last_ms"), F.sum("size").alias("bytes"),
        F.count_if(F.col("media") == "video").alias("video_frames"), F.count_if(F.col("media") == "audio").alias("audio_frames"))
    return rows.withColumn("state", F.when(F.lit(newest) - F.col("last_ms") > timeout_ms, "destroying").otherwise("publishing"))


def listed(rows: DataFrame) -> DataFrame:
    """Streams that are shown: all that are not being destroyed."""
    return rows.where("state <> 'destroying'")


def details(rows: DataFrame, requests: DataFrame, prefix: str = "/api/v1/streams/") -> DataFrame:
    """Each request (request_id, path) with an HTTP status and, where it is 200, the stream's fields: 400 without a key, 404 where no listed stream has it."""
    key = F.regexp_replace(F.regexp_replace("path", f"^{prefix}", ""), "/kick$", "")
    found = requests.withColumn("_key", key).join(listed(rows).withColumn("_own", F.col("stream_key").cast("string")), F.col("_key") == F.col("_own"), "left")
    status = F.when(F.col("_key") == "", 400).when(F.col("_own").isNull(), 404).otherwise(200)
    return found.select("request_id", status.alias("status"), *rows.columns)


def totals(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: streams (those being destroyed, too) and open connections."""
    n = rows.agg(F.count("*").alias("streams"))
    open_ = sessions.agg(F.count_if(F.col("state") != "closed").alias("connections"))
    return n.join(F.broadcast(open_))  # one row each


def metrics(frames: DataFrame, subscriptions: DataFrame, sessions: DataFrame, timeout_ms: int, window_ms: int) -> DataFrame:
    """metric, stream_key, protocol, sample: three metrics of the server and eight of each listed stream.

    subscriptions: (stream_key, protocol, n). Rates are those of the stream's newest
    window and the one before it. Uptimes are in seconds.
    """
    all_ = streams(frames, timeout_ms)
    own = listed(all_)
    newest = flow.rate_windows(frames, window_ms).groupBy("stream_key").agg(F.max_by("kbps", "bucket").alias("kbps"), (F.max_by("frames", "bucket") * 1000 / F.lit(float(window_ms))).alias("fps"))
    cached = segments.cache_detail(frames).select("stream_key", F.col("frames").alias("gop"))
    each = own.join(newest, "stream_key", "left").join(cached, "stream_key", "left")
    double = lambda c: c.cast("double")
    wide = each.select(
        "stream_key", double(F.col("bytes")).alias("stream_bytes_in_total"), double(F.col("video_frames")).alias("stream_video_frames_total"), double(F.col("audio_frames")).alias("stream_audio_frames_total"),
        F.col("kbps").alias("stream_bitrate_kbps"), F.col("fps").alias("stream_fps"), ((F.col("last_ms") - F.col("first_ms")) / 1000.0).alias("stream_uptime_seconds"),
        double(F.coalesce("gop", F.lit(0))).alias("stream_gop_cache_frames"))
    of_streams = wide.unpivot("stream_key", wide.columns[1:], "metric", "sample").select("metric", "stream_key", F.lit(None).cast("string").alias("protocol"), "sample")
    of_readers = subscriptions.join(own.select("stream_key"), "stream_key").select(F.lit("stream_subscribers").alias("metric"), "stream_key", "protocol", double(F.col("n")).alias("sample"))
    span = all_.agg(((F.max("last_ms") - F.min("first_ms")) / 1000.0).alias("server_uptime_seconds"))
    server = totals(all_, sessions).join(F.broadcast(span)).select(double(F.col("streams")).alias("server_streams_active"), double(F.col("connections")).alias("server_connections_active"), "server_uptime_seconds")
    none = F.lit(None)
    of_server = server.unpivot([], server.columns, "metric", "sample").select("metric", none.cast("bigint").alias("stream_key"), none.cast("string").alias("protocol"), "sample")
    return of_server.unionByName(of_streams).unionByName(of_readers)


def flv_audio(codec: Column) -> Column:
    """Does audio of this codec pass as it is, or is it made AAC?"""
    return F.when(codec.isin(*FLV_AUDIO), "pass").otherwise("transcode")


def claim(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (n, stream_key), in the order of n, with what it gets: the stream that is there, or a new one where there is none or it is being destroyed."""
    there = listed(rows).select("stream_key", F.lit(True).alias("_there"))
    nth = F.row_number().over(Window.partitionBy("stream_key").orderBy("n"))
    found = requests.withColumn("_nth", nth).join(there, "stream_key", "left")
    return found.select("n", "stream_key", F.when(F.col("_there").isNull() & (F.col("_nth") == 1), "created").otherwise("found").alias("answer"))


def shared(readers: DataFrame, *keys: str) -> DataFrame:
    """Readers that come (step 1) and go (step -1), by n, on something that is made once for all of them (a muxer, a transcoded track): how many there are, and whether this step starts or ends it.

    More go than came: the count stays 0.
    """
    by = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = readers.withColumn("_sum", F.sum("step").over(by))
    rows = rows.withColumn("readers", F.col("_sum") - F.least(F.min("_sum").over(by), F.lit(0)))
    before = F.coalesce(F.lag("readers").over(Window.partitionBy(*keys).orderBy("n")), F.lit(0))
    return rows.select(*keys, "n", "readers", F.when((before == 0) & (F.col("readers") > 0), "started").when((before > 0) & (F.col("readers") == 0), "ended").alias("event"))


def rule_of(action: Column) -> Column:
    """The rule that a hook takes for an action."""
    return F.when(action == "publish", "publish").when(action.isin("subscribe", "play"), "subscribe")


def latency_histogram(latencies: DataFrame) -> DataFrame:
    """protocol, le, n: how many latencies (protocol, seconds) are not above each bound; the last bound is infinite."""
    names = [f"{b:g}" for b in LATENCY_BOUNDS] + ["+Inf"]
    counts = [F.count_if(F.col("seconds") <= b).alias(n) for b, n in zip(LATENCY_BOUNDS, names)] + [F.count("seconds").alias("+Inf")]
    return latencies.groupBy("protocol").agg(*counts).unpivot("protocol", [f"`{n}`" for n in names], "le", "n")


def relay_counters(transfers: DataFrame) -> DataFrame:
    """direction, protocol, transfers, bytes, errors of relayed transfers (direction, protocol, bytes, error); bytes of failed ones don't count."""
    failed = F.col("error").isNotNull()
    return transfers.groupBy("direction", "protocol").agg(F.count("*").alias("transfers"), F.coalesce(F.sum(F.when(~failed, F.col("bytes"))), F.lit(0)).cast("bigint").alias("bytes"), F.count_if(failed).alias("errors"))


def probe_totals(cases: DataFrame) -> DataFrame:
    """One row: cases (allowed, expect_allow, error) that passed and failed; a case with an error fails."""
    ok = F.col("error").isNull() & (F.col("allowed") == F.col("expect_allow"))
    return cases.agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), (F.count("*") - F.count_if(ok)).alias("failed"))


def window_durations(rows: DataFrame, target_ms: int) -> DataFrame:
    """stream_key, max_ms, stable_ms of the segments (stream_key, segment, duration_ms) of a playlist.

    The longest is the target at least; the stable average leaves out the first two
    segments, of fewer than three it is the last one's, and the target where it is not above 0.
    """
    nth = F.row_number().over(Window.partitionBy("stream_key").orderBy("segment"))
    each = rows.withColumn("_n", nth).groupBy("stream_key").agg(F.greatest(F.max("duration_ms"), F.lit(target_ms)).alias("max_ms"), F.avg(F.when(F.col("_n") > 2, F.col("duration_ms"))).alias("_avg"), F.max_by("duration_ms", "segment").alias("_last"))
    stable = F.round(F.coalesce("_avg", "_last")).cast("bigint")
    return each.select("stream_key", "max_ms", F.when(stable > 0, stable).otherwise(F.lit(target_ms)).alias("stable_ms"))


def sessions_of(sessions: DataFrame, column: str, value) -> DataFrame:
    """Sessions by key or device: closed ones, too (by channel, `catalog.open_sessions` leaves them out)."""
    return sessions.where(F.col(column) == value)


def close_of_device(sessions: DataFrame, device_id) -> DataFrame:
    """All sessions, those of the device closed."""
    return sessions.withColumn("state", F.when(F.col("device_id") == device_id, "closed").otherwise(F.col("state")))


def codec_report(headers: DataFrame) -> DataFrame:
    """One row a stream: codec, profile, level and resolution of its video, codec, rate and channels of its audio, by its latest sequence headers that can be read.

    headers: (stream_key, seq, media, codec, payload). H.264 headers hold a parameter
    set, alone or among NAL units; AAC headers an AudioSpecificConfig. Those of other
    codecs match without being read; the codec is the latest header's in any case.
    """
    video, audio = F.col("media") == "video", F.col("media") == "audio"
    units = F.filter(codecs.nal_units(F.col("payload")), lambda n: codecs.B.u8(n, 0).bitwiseAND(F.lit(31)) == 7)
    alone = F.when(codecs.B.u8(F.col("payload"), 0).bitwiseAND(F.lit(31)) == 7, F.col("payload"))
    rows = headers.withColumn("_sps", F.when(video & (F.col("codec") == "H264"), F.coalesce(F.get(units, F.lit(0)), alone)))
    rows = rows.withColumn("_v", codecs.h264_sps(F.col("_sps"))).withColumn("_a", F.when(audio & (F.col("codec") == "AAC"), codecs.aac_config(F.col("payload"))))
    read = F.when(video, (F.col("codec") != "H264") | F.col("_v.profile").isNotNull()).otherwise((F.col("codec") != "AAC") | F.col("_a.sample_rate").isNotNull())
    last = lambda c, where: F.max_by(F.when(where, c), F.when(where, F.col("seq")))
    sps, asc = F.col("_v.profile").isNotNull(), F.col("_a.sample_rate").isNotNull()
    return rows.withColumn("_read", read).groupBy("stream_key").agg(
        last(F.col("codec"), video).alias("video_codec"), last(codecs.profile_name(F.col("_v.profile")), sps).alias("profile"), last(codecs.level_name(F.col("_v.level")), sps).alias("level"),
        last(F.concat_ws("x", F.col("_v.width").cast("string"), F.col("_v.height").cast("string")), sps).alias("resolution"), F.coalesce(F.bool_or(F.col("_read") & video), F.lit(False)).alias("video_match"),
        last(F.col("codec"), audio).alias("audio_codec"), last(F.col("_a.sample_rate"), asc).alias("sample_rate"), last(F.col("_a.channels"), asc).cast("int").alias("channels"), F.coalesce(F.bool_or(F.col("_read") & audio), F.lit(False)).alias("audio_match"))
