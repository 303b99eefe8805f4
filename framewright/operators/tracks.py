"""Tracks and sessions: latest headers, counters, merged stream information, lookups, transition checks, access units of byte streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import bits as B, codecs


def latest_headers(frames: DataFrame) -> DataFrame:
    """The last sequence header of each track."""
    return frames.where("frame_type = 'seqhdr'").groupBy("stream_key", "media").agg(F.max("seq").alias("seq"), F.max_by("size", "seq").alias("size"))


def sender_counters(frames: DataFrame) -> DataFrame:
    """Packets, octets and the last time of each track, as a sender report has them; the highest 16-bit number doesn't know of wraps."""
    n = F.row_number().over(Window.partitionBy("stream_key", "media").orderBy("seq"))
    rows = frames.select("*", F.pmod(n - 1 + 65_500, F.lit(65_536)).alias("s"))
    return rows.groupBy("stream_key", "media").agg(F.count("*").alias("packets"), F.sum("size").alias("octets"), F.max_by("dts_ms", "seq").alias("last_ms"), F.max("s").cast("bigint").alias("highest_seq"))


def feedback_counters(frames: DataFrame) -> DataFrame:
    """Requests for keys, other errors and the last jitter of each track."""
    return frames.groupBy("stream_key", "media").agg(F.count_if(F.col("frame_type") == "key").alias("pli"), F.count_if(F.col("frame_type") == "seqhdr").alias("nack"), F.max_by(F.col("pts_ms") - F.col("dts_ms"), F.col("seq")).alias("jitter"))


def merged(first: Column, over: Column) -> Column:
    """Both maps; where both have a key, the value of over."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(over), k)), over)


def stream_info(muxer: DataFrame, protocol: DataFrame) -> DataFrame:
    """Subscribers by muxer and by protocol, all rows (user_id, event_type) of each counted; the protocol's numbers win."""
    counted = lambda rows: rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    muxer, protocol = counted(muxer).withColumnRenamed("m", "muxer"), counted(protocol).withColumnRenamed("m", "protocol")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    both = muxer.join(protocol, "user_id", "full").select("user_id", merged(F.coalesce("muxer", none), F.coalesce("protocol", none)).alias("m"))
    return both.select("user_id", F.explode("m").alias("name", "subscribers"))


def after_cache(frames: DataFrame, cached_gops: DataFrame) -> DataFrame:
    """Live frames that a reader of the cached groups hasn't had: later than the cache's end."""
    end = cached_gops.groupBy("stream_key").agg(F.max(F.col("start_ms") + F.col("duration_ms")).alias("end_ms"))
    return frames.join(end, "stream_key").where("dts_ms > end_ms").select("stream_key", "seq")


def claims_match(claim: Column, value: Column) -> Column:
    return claim.isNull() | (claim == "") | (claim == value)


# States that an RTSP session may go to from each state, and the state that each request asks for.
NEXT_STATES = {
    "init": ("described", "announced", "closed"),
    "described": ("ready", "closed"),
    "announced": ("ready", "closed"),
    "ready": ("playing", "recording", "closed"),
    "playing": ("ready", "closed"),
    "recording": ("closed",),
}
ASKED = {"describe": "described", "announce": "announced", "setup": "ready", "play": "playing", "record": "recording", "pause": "ready", "teardown": "closed"}
EXPIRY_S = 60


def moves(steps: DataFrame) -> DataFrame:
    """Steps (session, state, request, ...) with the state that follows, null where the move isn't allowed."""
    allowed = steps.sparkSession.createDataFrame([(s, r, t) for s, to in NEXT_STATES.items() for r, t in ASKED.items() if t in to], "state string, request string, next_state string")
    return steps.join(F.broadcast(allowed), ["state", "request"], "left")


def expired(steps: DataFrame, now_s: Column, timeout_s: int = EXPIRY_S) -> DataFrame:
    """session, idle_s, expired: idle since the last move that was allowed, of steps (session, at_s, next_state); longer than the time-out is expired."""
    idle = now_s - F.max(F.when(F.col("next_state").isNotNull(), F.col("at_s")))
    return steps.groupBy("session").agg(idle.alias("idle_s")).withColumn("expired", F.col("idle_s") > timeout_s)


def relay_target(static: Column, dynamic: Column, mode: Column) -> Column:
    """Where a stream is pulled from: the static list, the scheduler's answer, or the better one by mode."""
    return F.when(mode == "static", static).when(mode == "dynamic", dynamic).otherwise(F.coalesce(dynamic, static))


def segment_lookup(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (stream_key, number): found, wait if it is beyond the newest, gone otherwise."""
    ends = segments.groupBy("stream_key").agg(F.max("segment").alias("newest"))
    have = segments.select("stream_key", F.col("segment").alias("number"), F.lit(True).alias("_have"))
    rows = requests.join(ends, "stream_key", "left").join(have, ["stream_key", "number"], "left")
    return rows.select("stream_key", "number", F.when(F.col("_have"), "found").when(F.col("number") > F.coalesce("newest", F.lit(-1)), "wait").otherwise("gone").alias("answer"))


def available(msn: Column, part: Column, newest_msn: Column, newest_part: Column) -> Column:
    """Does a low-latency playlist have the part asked for; without a part, the whole segment."""
    return (msn < newest_msn) | ((msn == newest_msn) & part.isNotNull() & (part <= newest_part))


def annex_b_units(files: DataFrame, fps: int = 25) -> DataFrame:
    """path, unit, dts_ms, frame_type, nals of raw H.264 byte streams (path, content): a unit ends where, after a slice, a new one may begin."""
    nals = files.select("path", F.posexplode(codecs.nal_units(F.col("content"))).alias("n", "nal")).withColumn("kind", B.u8(F.col("nal"), 0).bitwiseAND(F.lit(31)))
    by = Window.partitionBy("path").orderBy("n")
    slice_before = F.lag(F.col("kind").between(1, 5)).over(by)
    rows = nals.withColumn("unit", F.sum(F.when(slice_before & F.col("kind").isin(1, 5, 6, 7, 8, 9), 1).otherwise(0)).over(by))
    out = rows.groupBy("path", "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "nal"))), lambda x: x["nal"]).alias("nals"))
    return out.select("path", "unit", F.floor(F.col("unit") * 1000 / fps).cast("bigint").alias("dts_ms"), codecs.h264_frame_type(F.col("nals")).alias("frame_type"), "nals")


def headers_apart(units: DataFrame) -> DataFrame:
    """Units with their parameter sets as a frame of their own before a key."""
    is_set = lambda n: B.u8(n, 0).bitwiseAND(F.lit(31)).isin(7, 8)
    sets, rest = F.filter("nals", is_set), F.filter("nals", lambda n: ~is_set(n))
    pieces = F.array(F.struct(F.lit(0).alias("part"), F.lit("seqhdr").alias("frame_type"), sets.alias("nals")), F.struct(F.lit(1).alias("part"), F.col("frame_type"), rest.alias("nals")))
    return units.select("path", "unit", "dts_ms", F.explode(F.filter(pieces, lambda p: F.size(p["nals"]) > 0)).alias("p")).select("path", "unit", "dts_ms", "p.*")


def media_info(sdp_rows: DataFrame) -> DataFrame:
    """First video and first audio of each description, by their places `m` in it."""
    pick = lambda m, c: F.min_by(F.when(F.col("media") == m, F.col(c)), F.when(F.col("media") == m, F.col("m")))
    return sdp_rows.groupBy("path").agg(pick("video", "codec").alias("video_codec"), pick("audio", "codec").alias("audio_codec"), pick("audio", "clock_rate").alias("sample_rate"), pick("audio", "channels").alias("channels"))


def with_packetization_mode(fmtp: Column) -> Column:
    """An H.264 format line that names its packetization mode."""
    return F.when(F.contains(fmtp, F.lit("packetization-mode=")), fmtp).otherwise(F.concat(fmtp, F.lit(";packetization-mode=1")))


def rtsp_request(text: Column) -> Column:
    """struct(method, url, version, headers, body) of a request; of equal headers the first counts."""
    head, body = F.substring_index(text, "\r\n\r\n", 1), F.regexp_replace(text, r"(?s)^.*?\r\n\r\n", "")
    lines = F.split(head, "\r\n")
    first = F.split(F.get(lines, 0), " ")
    pairs = F.transform(F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    names = F.transform(pairs, lambda p: p["k"])
    kept = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: F.array_position(names, p["k"]) == p["i"] + 1)
    return F.struct(F.get(first, 0).alias("method"), F.get(first, 1).alias("url"), F.get(first, 2).alias("version"), F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"], p["v"]))).alias("headers"), F.when(F.contains(text, F.lit("\r\n\r\n")), body).otherwise("").alias("body"))


def transport_header(text: Column) -> Column:
    """struct(protocol, mode, client_port, interleaved) of a Transport header."""
    pick = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("int")
    return F.struct(F.when(F.contains(text, F.lit("/TCP")), "tcp").otherwise("udp").alias("protocol"), F.when(F.contains(text, F.lit("multicast")), "multicast").otherwise("unicast").alias("mode"), pick(r"client_port=(\d+)").alias("client_port"), pick(r"interleaved=(\d+)").alias("interleaved"))
