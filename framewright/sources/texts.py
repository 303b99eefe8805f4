"""Text formats as tables: playlists, manifests, session descriptions, XML messages, device dumps, JSON lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split(F.regexp_replace("content", "\r", ""), "\n")).alias("n", "line")).where("line <> ''")


def attribute(line: Column, name: str) -> Column:
    """A value of a tag's attribute list, without its quotes; null if absent."""
    found = F.regexp_extract(line, rf'[:,]{name}=("[^"]*"|[^,]*)', 1)
    return F.when(line.rlike(rf"[:,]{name}="), F.replace(found, F.lit('"'), F.lit("")))


def m3u8(files: DataFrame) -> DataFrame:
    """path, seq, uri, duration_s of every segment of (path, content) playlists."""
    by = Window.partitionBy("path").orderBy("n")
    rows = _lines(files).withColumn("inf", F.last(F.when(F.startswith("line", F.lit("#EXTINF:")), F.regexp_extract("line", r"^#EXTINF:([0-9.]+)", 1).cast("double")), ignorenulls=True).over(by))
    rows = rows.withColumn("first", F.max(F.when(F.startswith("line", F.lit("#EXT-X-MEDIA-SEQUENCE:")), F.regexp_extract("line", r":(\d+)", 1).cast("bigint"))).over(Window.partitionBy("path")))
    rows = rows.where(~F.startswith("line", F.lit("#")))
    return rows.select("path", (F.coalesce("first", F.lit(0)) + F.row_number().over(by) - 1).alias("seq"), F.col("line").alias("uri"), F.col("inf").alias("duration_s"))


def llhls(files: DataFrame, count_skipped: bool = True) -> DataFrame:
    """path, msn, part, uri, duration_s, independent of every part. With count_skipped, the segments that a delta playlist leaves out count."""
    by = Window.partitionBy("path").orderBy("n")
    up = by.rowsBetween(Window.unboundedPreceding, -1)
    number = lambda tag: F.max(F.when(F.startswith("line", F.lit(tag)), F.regexp_extract("line", r"(\d+)", 1).cast("bigint"))).over(Window.partitionBy("path"))
    rows = _lines(files).withColumns({"first": F.coalesce(number("#EXT-X-MEDIA-SEQUENCE:"), F.lit(0)), "skipped": F.coalesce(number("#EXT-X-SKIP:"), F.lit(0)) if count_skipped else F.lit(0).cast("bigint")})
    rows = rows.withColumn("done", F.coalesce(F.count_if(~F.startswith("line", F.lit("#"))).over(up), F.lit(0)))
    parts = rows.where(F.startswith("line", F.lit("#EXT-X-PART:")))
    line = F.col("line")
    return parts.select("path", (F.col("first") + F.col("skipped") + F.col("done")).alias("msn"), (F.row_number().over(Window.partitionBy("path", "done").orderBy("n")) - 1).cast("bigint").alias("part"), attribute(line, "URI").alias("uri"), attribute(line, "DURATION").cast("double").alias("duration_s"), F.coalesce(attribute(line, "INDEPENDENT") == "YES", F.lit(False)).alias("independent"))


def next_blocking_request(parts: DataFrame) -> DataFrame:
    """msn and part that a player asks for next: the one after the newest part."""
    return parts.groupBy("path").agg(F.max(F.struct("msn", "part")).alias("m")).select("path", F.col("m.msn").alias("msn"), (F.col("m.part") + 1).alias("part"))


def next_request_of(parts: DataFrame, players: DataFrame) -> DataFrame:
    """player, msn, part that each player (player, path, last_msn, last_part) asks for next.

    A player that has not had all parts asks for the one after its last; one that has,
    for the one after the newest; where there are no parts, for the next segment's first.
    """
    newest = parts.groupBy("path").agg(F.max(F.struct("msn", "part")).alias("m"))
    rows = players.join(newest, "path", "left")
    last = F.struct(F.col("last_msn").alias("msn"), F.col("last_part").alias("part"))
    none, behind = F.col("m").isNull(), last < F.col("m")
    return rows.select("player", F.when(none, F.col("last_msn") + 1).when(behind, F.col("last_msn")).otherwise(F.col("m.msn")).alias("msn"), F.when(none, F.lit(0)).when(behind, F.col("last_part") + 1).otherwise(F.col("m.part") + 1).cast("bigint").alias("part"))


def iso_seconds(text: Column) -> Column:
    """Seconds of PT1H2M3.5S; null for anything else."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"([0-9.]+){unit}", 1), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(text.rlike(r"^PT(\d+H)?(\d+M)?([0-9.]+S)?$"), part("H") * 3600 + part("M") * 60 + part("S"))


MPD_SCHEMA = "_type string, _minimumUpdatePeriod string, _timeShiftBufferDepth string, Period struct<AdaptationSet: array<struct<_contentType: string, SegmentTemplate: struct<_timescale: bigint, _startNumber: bigint, _media: string, SegmentTimeline: struct<S: array<struct<_t: bigint, _d: bigint, _r: bigint>>>>>>>"


def mpd(files: DataFrame) -> DataFrame:
    """path, content_type, number, t, d, timescale of every segment; @r repeats, @t restarts the running time."""
    doc = F.from_xml(F.col("content"), MPD_SCHEMA, {"rowTag": "MPD"})
    sets = files.select("path", F.explode(doc["Period"]["AdaptationSet"]).alias("a")).select("path", F.col("a._contentType").alias("content_type"), F.col("a.SegmentTemplate").alias("s"))
    runs = sets.select("path", "content_type", F.coalesce("s._timescale", F.lit(1)).alias("timescale"), F.coalesce("s._startNumber", F.lit(1)).alias("start"), F.posexplode("s.SegmentTimeline.S").alias("i", "e"))
    each = runs.select("path", "content_type", "timescale", "start", "i", F.col("e._d").alias("d"), F.col("e._t").alias("t0"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("e._r", F.lit(0)))).alias("r"))
    by = Window.partitionBy("path", "content_type").orderBy("i", "r")
    before = F.coalesce(F.sum("d").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    anchored = each.withColumn("_b", before).withColumn("_a", F.last(F.when((F.col("r") == 0) & F.col("t0").isNotNull(), F.col("t0") - F.col("_b")), ignorenulls=True).over(by))
    return anchored.select("path", "content_type", (F.col("start") + F.row_number().over(by) - 1).alias("number"), (F.col("_b") + F.coalesce("_a", F.lit(0))).alias("t"), "d", "timescale")


def sdp(files: DataFrame) -> DataFrame:
    """path, m (place, from 1), media, port, payload_type, codec, clock_rate, channels, fmtp, control of the first format of each media of (path, content)."""
    rows = _lines(files).withColumn("m", F.count_if(F.startswith("line", F.lit("m="))).over(Window.partitionBy("path").orderBy("n")))
    value = lambda tag: F.max(F.when(F.startswith("line", F.lit(tag)), F.substring_index("line", tag, -1)))
    attrs = F.collect_list(F.when(F.col("line").rlike("^a=(rtpmap|fmtp):"), F.col("line")))
    media = rows.where("m > 0").groupBy("path", "m").agg(value("m=").alias("d"), value("a=control:").alias("control"), attrs.alias("a"))
    w, pt = F.split("d", " "), F.get(F.split("d", " "), 3)
    find = lambda kind: F.get(F.filter("a", lambda x: F.startswith(x, F.concat(F.lit(f"a={kind}:"), pt, F.lit(" ")))), 0)
    spec = F.split(F.substring_index(find("rtpmap"), " ", -1), "/")
    static = F.element_at(F.create_map(*(F.lit(x) for x in ("0", "PCMU", "8", "PCMA", "9", "G722", "14", "MPA", "18", "G729"))), pt)
    return media.select("path", "m", F.get(w, 0).alias("media"), F.get(w, 1).cast("int").alias("port"), pt.cast("int").alias("payload_type"), F.upper(F.coalesce(F.get(spec, 0), static)).alias("codec"), F.get(spec, 1).cast("int").alias("clock_rate"), F.when(F.get(w, 0) == "audio", F.coalesce(F.get(spec, 2).cast("int"), F.lit(1))).alias("channels"), F.regexp_replace(find("fmtp"), r"^a=fmtp:\d+ ", "").alias("fmtp"), "control")


def build_sdp(tracks: DataFrame, name: str = "stream") -> DataFrame:
    """(path, content): a description of the tracks (path, m, media, payload_type, codec, clock_rate, channels, fmtp), in the order of m.

    Audio of more than one channel names their number; an empty or null fmtp is left out; tracks are controlled by their place.
    """
    pt = F.col("payload_type").cast("string")
    spec = F.concat_ws("/", "codec", F.col("clock_rate").cast("string"), F.when(F.col("channels") > 1, F.col("channels").cast("string")))
    lines = F.concat_ws("\r\n", F.concat(F.lit("m="), "media", F.lit(" 0 RTP/AVP "), pt), F.concat(F.lit("a=rtpmap:"), pt, F.lit(" "), spec), F.when(F.coalesce("fmtp", F.lit("")) != "", F.concat(F.lit("a=fmtp:"), pt, F.lit(" "), "fmtp")), F.concat(F.lit("a=control:trackID="), (F.col("m") - 1).cast("string")))
    body = F.transform(F.array_sort(F.collect_list(F.struct("m", lines.alias("lines")))), lambda x: x["lines"])
    return tracks.groupBy("path").agg(F.concat(F.lit(f"v=0\r\no=- 0 0 IN IP4 0.0.0.0\r\ns={name}\r\nc=IN IP4 0.0.0.0\r\nt=0 0\r\n"), F.array_join(body, "\r\n"), F.lit("\r\n")).alias("content"))


def track_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"trackID=(\d+)", 1), F.lit("")).cast("int")


def sprop_nals(fmtp: Column) -> Column:
    """The parameter sets of sprop-parameter-sets as binary."""
    value = F.regexp_extract(fmtp, r"sprop-parameter-sets=([^; ]*)", 1)
    return F.transform(F.filter(F.split(value, ","), lambda x: x != ""), lambda x: F.unbase64(x))


MESSAGE_SCHEMA = "CmdType string, SN bigint, DeviceID string, Status string, SumNum bigint, AlarmPriority string, AlarmMethod string, AlarmTime string, DeviceList struct<Item: array<struct<DeviceID: string, Name: string, Manufacturer: string, Status: string, PTZType: int, Longitude: double, Latitude: double>>>"


def messages(texts: DataFrame) -> DataFrame:
    """seq and the fields of XML messages (seq, content) by CmdType; what is no XML has a null kind."""
    root = F.regexp_extract("content", r"<(Notify|Response|Query|Control)[\s>]", 1)
    return texts.select("seq", F.when(root != "", root).alias("root"), F.from_xml(F.col("content"), MESSAGE_SCHEMA, {"mode": "PERMISSIVE"}).alias("m")).select("seq", "root", F.when(F.col("root").isNotNull(), F.col("m.CmdType")).alias("kind"), F.col("m.DeviceID").alias("device_id"), F.col("m.Status").alias("status"), F.col("m.AlarmPriority").alias("alarm_priority"), F.col("m.DeviceList.Item").alias("items"))


def catalog_state(rows: DataFrame) -> DataFrame:
    """Channels of each device by its latest catalog, which replaces those before."""
    last = rows.where("kind = 'Catalog' AND root = 'Response'").groupBy("device_id").agg(F.max_by("items", "seq").alias("items"))
    return last.select("device_id", F.explode("items").alias("i")).select("device_id", F.col("i.DeviceID").alias("channel_id"), F.col("i.Name").alias("name"), F.col("i.Status").alias("status"))


DUMP_SCHEMA = "map<string, struct<DeviceID: string, RemoteAddr: string, Transport: string, RegisteredAt: string, LastKeepalive: string, Status: string, Channels: map<string, struct<ChannelID: string, Name: string, Manufacturer: string, Status: string, PTZType: int, Latitude: double, Longitude: double>>>>"


def restore_devices(spark: SparkSession, path: str) -> DataFrame:
    """Devices of a JSON dump (a map by id); all come back offline."""
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", DUMP_SCHEMA)).alias("id", "d"))
    return docs.select("id", "d.*").withColumn("Status", F.lit("offline"))


def dump_devices(devices: DataFrame, path: str) -> None:
    devices.write.mode("overwrite").json(path)


def names_of(text: Column) -> Column:
    """Stream names of a JSON list of texts, or of objects with key or name."""
    plain = F.from_json(text, "array<string>")
    objects = F.from_json(text, "array<struct<key: string, name: string>>")
    return F.when(F.ltrim(text).rlike(r"^\[\s*\{"), F.transform(objects, lambda o: F.coalesce(o["key"], o["name"]))).otherwise(plain)


def propagated(seen: Column, key: Column) -> Column:
    """Has a stream arrived: by its own name, below a path, or within a longer name."""
    return (seen == key) | F.endswith(seen, F.concat(F.lit("/"), key)) | F.contains(seen, key)
