"""Fragmented MP4: boxes from a walk, sample tables by explode and running sums; segments written in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import bits as B
from . import walk
from .flv import _bytes

VIDEO_SCALE = 90_000


def boxes(files: DataFrame) -> DataFrame:
    return walk.walked(files, walk.boxes, "trail string, moof bigint, track_no bigint, at bigint, body binary")


def tracks(rows: DataFrame) -> DataFrame:
    """path, track_id, media, timescale of the initialisation's tracks."""
    b = F.col("body")
    long = B.u8(b, 0) == 1
    pick = lambda trail, c: F.max(F.when(F.col("trail") == trail, c))
    out = rows.where(F.startswith("trail", F.lit("moov/trak"))).groupBy("path", "track_no").agg(pick("moov/trak/tkhd", B.u32(b, F.when(long, 20).otherwise(12))).alias("track_id"), pick("moov/trak/mdia/mdhd", B.u32(b, F.when(long, 20).otherwise(12))).alias("timescale"), pick("moov/trak/mdia/hdlr", B.piece(b, 8, 4).cast("string")).alias("handler"))
    return out.where("handler IN ('vide', 'soun')").select("path", "track_id", F.when(F.col("handler") == "vide", "video").otherwise("audio").alias("media"), "timescale")


def samples(rows: DataFrame) -> DataFrame:
    """Every sample of every run: path, moof, track_id, run, i, duration, size, flags, cts, start (decode time), at (place in the file)."""
    b, flags = F.col("body"), B.u24(F.col("body"), 1)
    has = lambda f, bit: B.field(f, bit.bit_length() - 1, 1) == 1
    part = rows.where(F.startswith("trail", F.lit("moof/traf/")))
    place = lambda bits_: F.lit(8) + sum((F.when(has(flags, x), n).otherwise(0) for x, n in bits_), F.lit(0))
    opt = lambda bit, prior: F.when(has(flags, bit), B.u32(b, place(prior)))
    prior = [(1, 8), (2, 4), (8, 4), (16, 4)]
    info = part.groupBy("path", "moof", "track_no").agg(
        *(F.max(F.when(F.col("trail") == "moof/traf/tfhd", c)).alias(n) for n, c in (("track_id", B.u32(b, 4)), ("d0", opt(8, prior[:2])), ("s0", opt(16, prior[:3])), ("f0", opt(32, prior)))),
        F.max(F.when(F.col("trail") == "moof/traf/tfdt", F.when(B.u8(b, 0) == 1, F.conv(F.hex(B.piece(b, 4, 8)), 16, 10).cast("bigint")).otherwise(B.u32(b, 4)))).alias("base"))
    runs = part.where("trail = 'moof/traf/trun'").join(info, ["path", "moof", "track_no"])
    each = sum((F.when(has(flags, x), 4).otherwise(0) for x in (0x100, 0x200, 0x400, 0x800)), F.lit(0))
    head = F.lit(8) + F.when(has(flags, 1), 4).otherwise(0) + F.when(has(flags, 4), 4).otherwise(0)
    runs = runs.where(B.u32(b, 4) > 0).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), B.u32(b, 4) - 1)).alias("i"))
    row = (head + F.col("i") * each).cast("int")
    at = lambda bit, before: F.when(has(flags, bit), B.u32(b, row + sum((F.when(has(flags, x), 4).otherwise(0) for x in before), F.lit(0))))
    cts = at(0x800, (0x100, 0x200, 0x400))
    first = F.when((F.col("i") == 0) & has(flags, 4), B.u32(b, F.lit(8) + F.when(has(flags, 1), 4).otherwise(0)))
    out = runs.select("path", "moof", "track_no", "track_id", F.col("idx").alias("run"), "i", "base", F.coalesce(at(0x100, ()), "d0", F.lit(0)).alias("duration"), F.coalesce(at(0x200, (0x100,)), "s0", F.lit(0)).alias("size"), F.coalesce(first, at(0x400, (0x100, 0x200)), "f0", F.lit(0)).alias("flags"), F.coalesce(F.when((B.u8(b, 0) == 1) & (cts >= 1 << 31), cts - (1 << 32)).otherwise(cts), F.lit(0)).alias("cts"), F.when(has(flags, 1), B.u32(b, 8)).alias("offset"))
    by = Window.partitionBy("path", "moof", "track_no").orderBy("run", "i").rowsBetween(Window.unboundedPreceding, -1)
    in_run = Window.partitionBy("path", "moof", "track_no", "run").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    return out.select("*", (F.coalesce("base", F.lit(0)) + before("duration", by)).alias("start"), (F.col("moof") + F.coalesce("offset", F.lit(0)) + before("size", in_run)).alias("at"))


def frames(files: DataFrame) -> DataFrame:
    """Frames of (path, content), each with its initialisation and segments. A sample is a key if it depends on none, or if nothing is said and it is a sync sample."""
    rows = boxes(files)
    known = samples(rows).join(tracks(rows), ["path", "track_id"])
    depends, not_sync = B.field(F.col("flags"), 24, 2), B.field(F.col("flags"), 16, 1)
    key = (depends == 2) | ((depends == 0) & (not_sync == 0))
    ms = lambda c: F.floor(c * 1000 / F.col("timescale")).cast("bigint")
    whole = known.join(files.select("path", "content"), "path")
    return whole.select("path", "at", "media", F.when((F.col("media") == "video") & key, "key").otherwise("inter").alias("frame_type"), ms(F.col("start")).alias("dts_ms"), ms(F.col("start") + F.col("cts")).alias("pts_ms"), "size", B.piece(F.col("content"), F.col("at").cast("int"), F.col("size").cast("int")).alias("payload"))


def _joined(parts: tuple) -> Column | bytes:
    """Parts on end; bytes where all are."""
    if all(isinstance(p, bytes) for p in parts):
        return b"".join(parts)
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _once(value: Column, f) -> Column:
    """f of a value that f names several times; as a lambda's variable it is written and made once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _box(kind: bytes, *parts: Column | bytes) -> Column | bytes:
    body = _joined(parts)
    if isinstance(body, bytes):
        return (len(body) + 8).to_bytes(4, "big") + kind + body
    return _once(body, lambda b: F.concat(_bytes(F.octet_length(b) + 8, 4), F.lit(kind), b))


def _full(kind: bytes, flags: int, *parts: Column | bytes) -> Column | bytes:
    return _box(kind, flags.to_bytes(4, "big"), *parts)


# Sample entries and configuration boxes of the codecs; the identity matrix.
VIDEO_ENTRIES = {"H264": (b"avc1", b"avcC"), "H265": (b"hev1", b"hvcC"), "AV1": (b"av01", b"av1C"), "VP8": (b"vp08", b"vpcC"), "VP9": (b"vp09", b"vpcC")}
AUDIO_ENTRIES = {"AAC": b"mp4a", "MP3": b".mp3", "Opus": b"Opus"}
MATRIX = b"".join(x.to_bytes(4, "big") for x in (0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000))
BITRATE = 128_000


def _descriptor(tag: int, *parts: Column | bytes) -> Column:
    """An MPEG-4 descriptor with its length in four bytes of seven bits."""
    seven = lambda x, shift: F.shiftright(F.octet_length(x), shift).bitwiseAND(F.lit(127))
    body = _joined(parts)
    return _once(body if isinstance(body, Column) else F.lit(body), lambda b: F.concat(F.lit(bytes([tag])), *(_bytes(seven(b, s) + 128, 1) for s in (21, 14, 7)), _bytes(seven(b, 0), 1), b))


def esds(config: Column) -> Column:
    """The box of an AAC decoder: its AudioSpecificConfig within stream, decoder and sync descriptors."""
    decoder = _descriptor(4, b"\x40\x15\0\0\0", BITRATE.to_bytes(4, "big") * 2, _descriptor(5, config))
    return _full(b"esds", 0, _descriptor(3, b"\0\1\0", decoder, _descriptor(6, b"\2")))


def video_entry(codec: str, width: Column, height: Column, config: Column | None = None) -> Column:
    """The sample description of a video track; without a configuration, its box is left out."""
    kind, box = VIDEO_ENTRIES[codec]
    head = [b"\0" * 6 + b"\0\1" + b"\0" * 16, _bytes(width, 2), _bytes(height, 2), b"\0\x48\0\0\0\x48\0\0" + b"\0" * 4 + b"\0\1" + b"\0" * 32 + b"\0\x18\xff\xff"]
    return _box(kind, *head, *([_box(box, config)] if config is not None else []))


def audio_entry(codec: str, rate: Column, channels: Column, config: Column | None = None) -> Column:
    """The sample description of an audio track of 16 bits."""
    head = [b"\0" * 6 + b"\0\1" + b"\0" * 8, _bytes(channels, 2), b"\0\x10" + b"\0" * 4, _bytes(rate, 2), b"\0\0"]
    boxes_ = [] if config is None or codec == "MP3" else [esds(config) if codec == "AAC" else _box(b"dOps", config)]
    return _box(AUDIO_ENTRIES[codec], *head, *boxes_)


def init_segment(video_scale: int = VIDEO_SCALE, audio_scale: int = 48_000, video: Column | None = None, audio: Column | None = None, width: Column | None = None, height: Column | None = None) -> Column:
    """ftyp and moov of a video track 1 and an audio track 2, with the sample descriptions given (`video_entry`, `audio_entry`)."""
    def trak(number: int, handler: bytes, scale: int, entry: Column | None) -> Column:
        sides = [_bytes(c, 2) if c is not None and number == 1 else b"\0\0" for c in (width, height)]
        tkhd = _full(b"tkhd", 3, b"\0" * 8 + number.to_bytes(4, "big") + b"\0" * 20, b"\0\0" if number == 1 else b"\1\0", b"\0\0" + MATRIX, sides[0], b"\0\0", sides[1], b"\0\0")
        media = _full(b"vmhd", 1, b"\0" * 8) if number == 1 else _full(b"smhd", 0, b"\0" * 4)
        tables = [_full(k, 0, b"\0" * n) for k, n in ((b"stts", 4), (b"stsc", 4), (b"stsz", 8), (b"stco", 4))]
        stsd = _full(b"stsd", 0, b"\0\0\0\1", entry) if entry is not None else _full(b"stsd", 0, b"\0\0\0\0")
        dinf = _box(b"dinf", _full(b"dref", 0, b"\0\0\0\1", _full(b"url ", 1)))
        minf = _box(b"minf", media, dinf, _box(b"stbl", stsd, *tables))
        mdia = _box(b"mdia", _full(b"mdhd", 0, b"\0" * 8 + scale.to_bytes(4, "big") + b"\0" * 8), _full(b"hdlr", 0, b"\0" * 4 + handler + b"\0" * 13), minf)
        return _box(b"trak", tkhd, mdia)

    mvhd = _full(b"mvhd", 0, b"\0" * 8 + VIDEO_SCALE.to_bytes(4, "big") + b"\0" * 4 + b"\0\1\0\0\1\0" + b"\0" * 10 + MATRIX + b"\0" * 24 + b"\0\0\0\3")
    trex = [_full(b"trex", 0, n.to_bytes(4, "big") + b"\0\0\0\1" + b"\0" * 12) for n in (1, 2)]
    out = _joined((_box(b"ftyp", b"isom\0\0\2\0isomiso6mp41"), _box(b"moov", mvhd, trak(1, b"vide", video_scale, video), trak(2, b"soun", audio_scale, audio), _box(b"mvex", *trex))))
    return F.lit(out) if isinstance(out, bytes) else out


def descriptions(rows: DataFrame) -> DataFrame:
    """path, track_no, entry, width, height, channels, sample_rate, config of the first sample description of each track of `boxes`.

    config: an AVC or HEVC record, the AudioSpecificConfig of an esds box, or another configuration box's body.
    """
    b = F.col("body")
    first = rows.where("trail = 'moov/trak/mdia/minf/stbl/stsd'").where(B.u32(b, 4) > 0).select("path", "track_no", B.piece(b, 12, 4).cast("string").alias("entry"), B.after(b, 16).alias("e"), (B.u32(b, 8) - 8).cast("int").alias("n"))
    e, video = F.col("e"), F.col("entry").isin(*(k.decode() for k, _ in VIDEO_ENTRIES.values()))
    at = F.when(video, 78).otherwise(28)
    kind, body = B.piece(e, at + 4, 4).cast("string"), B.piece(e, at + 8, (B.u32(e, at) - 8).cast("int"))
    # Behind version and flags: descriptors 3 (3 bytes), 4 (13 bytes) and 5, each with a tag and four bytes of length.
    specific = B.piece(body, 4 + 5 + 3 + 5 + 13 + 5, B.u8(body, 4 + 5 + 3 + 5 + 13 + 4).cast("int"))
    config = F.when(F.col("n") > at, F.when(kind == "esds", specific).otherwise(body))
    return first.select("path", "track_no", "entry", F.when(video, B.u16(e, 24)).alias("width"), F.when(video, B.u16(e, 26)).alias("height"), F.when(~video, B.u16(e, 16)).alias("channels"), F.when(~video, B.u16(e, 24)).alias("sample_rate"), config.alias("config"))


def sample_table(frames: DataFrame, video_scale: int = VIDEO_SCALE, audio_scale: int = 48_000) -> DataFrame:
    """Frames with ticks: the duration reaches to the next frame of the medium, the last has 3000 or 1024 ticks."""
    scale = F.when(F.col("media") == "video", video_scale).otherwise(audio_scale)
    by = Window.partitionBy("stream_key", "media").orderBy("seq")
    ticks = lambda c: F.floor(c * scale / 1000).cast("bigint")
    rows = frames.where("frame_type <> 'seqhdr'")
    return rows.select("*", ticks(F.col("dts_ms")).alias("start"), F.coalesce(ticks(F.lead("dts_ms").over(by)) - ticks(F.col("dts_ms")), F.when(F.col("media") == "video", 3000).otherwise(1024)).alias("duration"), (ticks(F.col("pts_ms")) - ticks(F.col("dts_ms"))).alias("cts"))


def mux(frames: DataFrame, segment: str = "segment") -> DataFrame:
    """(path, content) of each stream: initialisation, then one moof and mdat for each medium of a segment (a column of frames)."""
    rows = sample_table(frames)
    flags = F.when((F.col("media") == "audio") | (F.col("frame_type") == "key"), F.lit(0x02000000)).otherwise(F.lit(0x01010000))
    entry = F.concat(_bytes(F.col("duration"), 4), _bytes(F.octet_length("payload"), 4), _bytes(flags, 4), _bytes(F.col("cts"), 4))
    rows = rows.withColumn("_e", entry)
    each = rows.groupBy("stream_key", segment, "media").agg(F.count("*").alias("n"), F.min_by("start", "seq").alias("start"), F.expr("listagg(_e) WITHIN GROUP (ORDER BY seq)").alias("entries"), F.expr("listagg(payload) WITHIN GROUP (ORDER BY seq)").alias("data"))
    track = F.when(F.col("media") == "video", F.lit(b"\0\0\0\1")).otherwise(F.lit(b"\0\0\0\2"))
    moof_size = F.lit(8 + 16 + 8 + 16 + 20 + 20) + 16 * F.col("n")
    traf = _box(b"traf", _box(b"tfhd", F.lit(b"\0\2\0\0"), track), _box(b"tfdt", F.lit(b"\1\0\0\0"), _bytes(F.col("start"), 8)), _box(b"trun", F.lit(b"\1\0\x0f\1"), _bytes(F.col("n"), 4), _bytes(moof_size + 8, 4), F.col("entries")))
    moof = _box(b"moof", _box(b"mfhd", F.lit(b"\0\0\0\0"), _bytes(F.col(segment), 4)), traf)
    each = each.select(F.col("stream_key").cast("string").alias("path"), F.concat(F.lpad(F.col(segment).cast("string"), 20, "0"), F.when(F.col("media") == "video", "0").otherwise("1")).alias("o"), F.concat(moof, _box(b"mdat", F.col("data"))).alias("chunk"))
    return each.groupBy("path").agg(F.concat(init_segment(), F.expr("listagg(chunk) WITHIN GROUP (ORDER BY o)")).alias("content"))
