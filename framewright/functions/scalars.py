"""Scalar functions as column expressions: paths, URLs, stream ids, sizes, PTZ commands, timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def scheme(url: Column) -> Column:
    """What stands before ://, lower-cased; empty without it."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)


def port(url: Column, default: int | None = None) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/:?#]+:(\d+)", 1)
    return F.when(found != "", found.cast("int")).otherwise(F.lit(default).cast("int"))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def query_map(text: Column) -> Column:
    """Parameters as a map; the first of equal names wins, empty names are dropped."""
    pairs = F.filter(F.transform(F.split(text, "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("v"))), lambda p: p["k"] != "")
    first = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == p["i"] + 1)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], p["v"])))


def clean_path(p: Column) -> Column:
    """A path without empty and `.` steps; `..` takes away the step before it."""
    steps = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(steps, "/"))


def stream_parts(p: Column) -> Column:
    """struct(app, key, format) of /app/key.format, null unless all three are there. The key may have steps; the format follows the last dot."""
    bare = clean_path(p)
    pick = lambda n: F.regexp_extract(bare, r"^/([^/]+)/(.+)\.([^.]+)$", n)
    return F.when(pick(1) != "", F.struct(pick(1).alias("app"), pick(2).alias("key"), pick(3).alias("format")))


def stream_path(p: Column) -> Column:
    """app/key of /app/key.format; null unless all three are there."""
    found = stream_parts(p)
    return F.when(found.isNotNull(), F.concat_ws("/", found["app"], found["key"]))


def segment_parts(p: Column) -> Column:
    """struct(app, key, name, ext) of /app/key/name.ext, null unless all four are there."""
    bare = clean_path(p)
    pick = lambda n: F.regexp_extract(bare, r"^/([^/]+)/([^/]+)/(.+)\.([^.]+)$", n)
    return F.when(pick(1) != "", F.struct(pick(1).alias("app"), pick(2).alias("key"), pick(3).alias("name"), pick(4).alias("ext")))


def segment_number(p: Column) -> Column:
    """Number of /app/name/N.ts and /app/name/segN.m4s, else null."""
    found = F.regexp_extract(p, r"/(?:seg)?(\d+)\.(?:ts|m4s|mp4)$", 1)
    return F.when(found != "", found.cast("bigint"))


def srt_stream_id(text: Column) -> Column:
    """struct(mode, key) of the forms publish:key, subscribe:key, #!::r=key,m=mode (any mode; of repeated fields the last counts) and a plain key, which subscribes.

    A key's query and its first slash are cut off; a list without mode subscribes.
    """
    fields = F.filter(F.split(F.substring(text, 5, 1 << 30), ","), lambda x: F.contains(x, F.lit("=")))
    last = lambda name: F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(fields, lambda x: F.startswith(x, F.lit(f"{name}="))), lambda x: F.substring(x, len(name) + 2, 1 << 30))), -1)
    listed = F.startswith(text, F.lit("#!::"))
    prefix = F.regexp_extract(text, "^(publish|subscribe):", 1)
    mode = F.when(listed, F.when(last("m") == "", "subscribe").otherwise(last("m"))).when(prefix == "publish", "publish").otherwise("subscribe")
    key = F.when(listed, last("r")).otherwise(F.regexp_replace(text, "^(publish|subscribe):", ""))
    return F.struct(mode.alias("mode"), F.regexp_replace(F.regexp_replace(key, r"[?#].*$", ""), "^/", "").alias("key"))


def parse_size(text: Column) -> Column:
    """Bytes of 10, 10KB, 10 mb, 2GB by powers of 1024, in either case; of 1.5MB the whole number before the dot counts. Null where there is no number above 0."""
    t = F.upper(F.trim(text))
    unit = F.regexp_extract(t, r"([KMG]?B)$", 1)
    n = F.regexp_extract(t, r"^([+]?\d{1,18})", 1)
    scale = F.when(unit == "KB", 1 << 10).when(unit == "MB", 1 << 20).when(unit == "GB", 1 << 30).otherwise(1).cast("bigint")
    return F.when(n != "", F.nullif(n.cast("bigint") * scale, F.lit(0)))


def recording_path(template: str, key: Column, at: Column) -> Column:
    """{stream_key}, {date} and {time} filled in."""
    out = F.replace(F.lit(template), F.lit("{stream_key}"), key)
    return F.replace(F.replace(out, F.lit("{date}"), F.date_format(at, "yyyy-MM-dd")), F.lit("{time}"), F.date_format(at, "HHmmss"))


def glob_match(glob: str, key: Column) -> Column:
    """* and ? stay within a path's step; an empty glob or a lone * matches all."""
    if glob in ("", "*"):
        return F.lit(True)
    special = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() and c not in "/_-" else c for c in glob)
    return key.rlike(f"^{special}$")


def ptz(pan: Column, tilt: Column, zoom: Column, speed: int = 0x40) -> Column:
    """The 8-byte PTZ command in hex: A5 0F 01, direction bits, zoom bits, speeds across and up, checksum. Right, up and in are above 0."""
    direction = F.when(pan > 0, 1).when(pan < 0, 2).otherwise(0) + F.when(tilt > 0, 8).when(tilt < 0, 4).otherwise(0)
    zooming = F.when(zoom > 0, 0x10).when(zoom < 0, 0x20).otherwise(0)
    h, v = F.when(pan != 0, speed).otherwise(0), F.when(tilt != 0, speed).otherwise(0)
    total = F.pmod(F.lit(0xA5 + 0x0F + 0x01) + direction + zooming + h + v, F.lit(256))
    return F.format_string("A50F01%02X%02X%02X%02X%02X", direction, zooming, h, v, total)


def ntp_time(micros: Column) -> Column:
    """The 64-bit NTP timestamp of microseconds since 1970, as a decimal."""
    s = F.floor(micros / 1_000_000).cast("decimal(20,0)") + F.lit(2_208_988_800).cast("decimal(20,0)")
    frac = F.floor(F.pmod(micros, F.lit(1_000_000)).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(20,0)")
    return (s * F.lit(1 << 32).cast("decimal(20,0)") + frac).cast("decimal(20,0)")


def client_ip(forwarded: Column, real: Column, remote: Column) -> Column:
    """First of X-Forwarded-For, else X-Real-IP, else the host of the peer's address."""
    first = F.trim(F.substring_index(forwarded, ",", 1))
    return F.when(F.coalesce(first, F.lit("")) != "", first).when(F.coalesce(real, F.lit("")) != "", F.trim(real)).otherwise(F.regexp_replace(remote, r":\d+$", ""))


def codec_string(profile_hex: Column) -> Column:
    """avc1.PPCCLL of the three profile bytes."""
    return F.concat(F.lit("avc1."), F.lower(profile_hex))


def video_codec_string(codec: Column, config: Column) -> Column:
    """The codecs attribute of a video track: H.264 by its decoder configuration record, where there is one; defaults of level 4.0 else."""
    by_record = F.concat(F.lit("avc1."), F.lower(F.hex(F.substring(config, 2, 3))))
    return F.when((codec == "H264") & (F.octet_length(config) >= 4), by_record).when(codec == "H265", "hvc1.1.6.L120.B0").otherwise("avc1.640028")


def audio_codec_string(codec: Column, config: Column) -> Column:
    """The codecs attribute of an audio track: AAC by the object type of its AudioSpecificConfig, LC without one."""
    kind = F.shiftright(F.conv(F.hex(F.substring(config, 1, 1)), 16, 10).cast("int"), 3)
    aac = F.concat(F.lit("mp4a.40."), F.when(F.octet_length(config) >= 2, kind).otherwise(2).cast("string"))
    return F.when(codec == "AAC", aac).when(codec == "Opus", "opus").when(codec == "MP3", "mp4a.40.34").otherwise("mp4a.40.2")


def rtp_clock(dts_ms: Column, rate: int) -> Column:
    ticks = dts_ms.cast("bigint") * rate
    return F.pmod((ticks - F.pmod(ticks, F.lit(1000))).cast("decimal(20,0)") / 1000, F.lit(1 << 32)).cast("bigint")


def seq_distance(a: Column, b: Column) -> Column:
    """How far a 16-bit sequence number lies ahead of another."""
    return F.pmod(a - b, F.lit(65536))
