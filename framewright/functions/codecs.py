"""Codec headers as column expressions; the Exp-Golomb walk of a sequence parameter set is a small vectorised helper."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

from . import bits as B

# Fixed values of the formats.
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
MP3_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
MP3_KBPS_V1_L3 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
MP3_KBPS_V2_L3 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
H264_PROFILES = {66: "Baseline", 77: "Main", 88: "Extended", 100: "High", 110: "High 10", 122: "High 4:2:2", 244: "High 4:4:4 Predictive"}


def _pick(values, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def aac_config(data: Column) -> Column:
    """struct(object_type, sample_rate, channels) of an AudioSpecificConfig; null if too short. An escaped rate index has no rate."""
    v = B.u16(data, 0)
    return F.when(v.isNotNull(), F.struct(B.field(v, 11, 5).alias("object_type"), _pick(AAC_RATES, B.field(v, 7, 4)).alias("sample_rate"), B.field(v, 3, 4).alias("channels")))


def build_aac_config(object_type: int, sample_rate: int, channels: int) -> bytes:
    return (object_type << 11 | AAC_RATES.index(sample_rate) << 7 | channels << 3).to_bytes(2, "big")


def adts(data: Column) -> Column:
    """struct(object_type, sample_rate, channels, frame_length, header_length) of an ADTS header; null without its sync word."""
    head, rest = B.u32(data, 0), B.u24(data, 3)
    return F.when(B.field(head, 20, 12) == 0xFFF, F.struct(
        (B.field(head, 14, 2) + 1).alias("object_type"), _pick(AAC_RATES, B.field(head, 10, 4)).alias("sample_rate"), B.field(head, 6, 3).alias("channels"),
        B.field(rest, 5, 13).alias("frame_length"), F.when(B.field(head, 16, 1) == 1, 7).otherwise(9).alias("header_length")))


def mp3_header(data: Column) -> Column:
    """struct(version, sample_rate, channels, kbps) of an MPEG audio layer III header; null if it is none."""
    v = B.u32(data, 0)
    version, rate, kbps = B.field(v, 19, 2), B.field(v, 10, 2), B.field(v, 12, 4)
    rates = F.when(version == 3, _pick(MP3_RATES[3], rate)).when(version == 2, _pick(MP3_RATES[2], rate)).when(version == 0, _pick(MP3_RATES[0], rate))
    ok = (B.field(v, 21, 11) == 0x7FF) & (version != 1) & (B.field(v, 17, 2) == 1) & (rate != 3) & (kbps != 15)
    return F.when(ok, F.struct(F.when(version == 3, "1").when(version == 2, "2").otherwise("2.5").alias("version"), rates.alias("sample_rate"), F.when(B.field(v, 6, 2) == 3, 1).otherwise(2).alias("channels"), F.when(version == 3, _pick(MP3_KBPS_V1_L3, kbps)).otherwise(_pick(MP3_KBPS_V2_L3, kbps)).alias("kbps")))


def opus_head(data: Column) -> Column:
    """struct(channels, pre_skip, sample_rate) of an OpusHead; its numbers are little-endian."""
    swap = lambda at, n: F.conv(F.concat(*(F.hex(B.piece(data, at + i, 1)) for i in reversed(range(n)))), 16, 10).cast("bigint")
    return F.when((F.hex(B.piece(data, 0, 8)) == "4F70757348656164") & (F.octet_length(data) >= 19), F.struct(B.u8(data, 9).alias("channels"), swap(10, 2).alias("pre_skip"), swap(12, 4).alias("sample_rate")))


def nal_units(data: Column) -> Column:
    """The NAL units of Annex-B bytes (start codes of three or four bytes), empty ones left out."""

    @F.pandas_udf("array<binary>")
    def of(chunks: pd.Series) -> pd.Series:
        return chunks.map(lambda b: [x for x in (y.rstrip(b"\0") for y in re.split(rb"\x00\x00\x01", bytes(b))[1:]) if x] if b is not None else None)

    return of(data)


def length_prefixed(nals: Column) -> Column:
    """NAL units as AVCC: four bytes of length before each, in built-in functions."""
    return F.aggregate(nals, F.lit(b""), lambda a, n: F.concat(a, F.unhex(F.lpad(F.hex(F.octet_length(n)), 8, "0")), n))


def annex_b(nals: Column) -> Column:
    return F.aggregate(nals, F.lit(b""), lambda a, n: F.concat(a, F.lit(b"\0\0\0\1"), n))


def h264_types(nals: Column) -> Column:
    return F.transform(nals, lambda n: B.u8(n, 0).bitwiseAND(F.lit(31)))


def h264_frame_type(nals: Column) -> Column:
    """seqhdr where only parameter sets, key with an IDR slice, else inter."""
    types = h264_types(nals)
    return F.when(F.exists(types, lambda t: t == 5), "key").when(F.exists(types, lambda t: (t == 7) | (t == 8)) & ~F.exists(types, lambda t: (t >= 1) & (t <= 4)), "seqhdr").otherwise("inter")


def h265_frame_type(nals: Column) -> Column:
    types = F.transform(nals, lambda n: F.shiftright(B.u8(n, 0), 1).bitwiseAND(F.lit(63)))
    return F.when(F.exists(types, lambda t: (t >= 16) & (t <= 23)), "key").when(F.exists(types, lambda t: (t >= 32) & (t <= 34)) & ~F.exists(types, lambda t: t < 32), "seqhdr").otherwise("inter")


def avc_config(sps: Column, pps: Column) -> Column:
    """The AVC decoder configuration record of one SPS and one PPS."""
    size = lambda c: F.unhex(F.lpad(F.hex(F.octet_length(c)), 4, "0"))
    return F.concat(F.lit(b"\x01"), B.piece(sps, 1, 3), F.lit(b"\xff\xe1"), size(sps), sps, F.lit(b"\x01"), size(pps), pps)


def profile_name(profile: Column) -> Column:
    out = F
    for k, v in H264_PROFILES.items():
        out = out.when(profile == k, v)
    return out.otherwise(F.format_string("Profile(%d)", profile))


def level_name(level: Column) -> Column:
    return F.format_string("%.1f", level / F.lit(10.0))


class _Reader:
    """Bits of an SPS without its emulation prevention bytes."""

    def __init__(self, data: bytes):
        data = re.sub(rb"\x00\x00\x03", b"\0\0", data)
        self.bits, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def u(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("past the end")
        return self.bits >> self.left & (1 << n) - 1

    def ue(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        v = self.ue()
        return (v + 1) // 2 if v % 2 else -(v // 2)


def sps_size(sps: bytes) -> tuple[int, int, int, int] | None:
    """profile, level, width, height; None where the bytes are no H.264 SPS."""
    try:
        r = _Reader(sps[1:])
        profile, _, level = r.u(8), r.u(8), r.u(8)
        r.ue()
        chroma = 1
        if profile in (100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135):
            chroma = r.ue()
            if chroma == 3:
                r.u(1)
            r.ue(), r.ue(), r.u(1)
            if r.u(1):
                for i in range(12 if chroma == 3 else 8):
                    if r.u(1):
                        last = scale = 8
                        for _ in range(16 if i < 6 else 64):
                            if scale:
                                scale = (last + r.se()) % 256
                            last = scale or last
        r.ue()
        kind = r.ue()
        if kind == 0:
            r.ue()
        elif kind == 1:
            r.u(1), r.se(), r.se()
            for _ in range(r.ue()):
                r.se()
        r.ue(), r.u(1)
        wide, high, whole = r.ue() + 1, r.ue() + 1, r.u(1)
        if not whole:
            r.u(1)
        r.u(1)
        crop = [r.ue() for _ in range(4)] if r.u(1) else [0] * 4
        ux, uy = (2 if chroma in (1, 2) else 1), (2 if chroma == 1 else 1) * (2 - whole)
        return profile, level, 16 * wide - ux * (crop[0] + crop[1]), 16 * high * (2 - whole) - uy * (crop[2] + crop[3])
    except (ValueError, IndexError):
        return None


def h264_sps(data: Column) -> Column:
    """struct(profile, level, width, height) of an SPS NAL unit, null where it can't be read."""

    @F.pandas_udf("profile int, level int, width int, height int")
    def of(nals: pd.Series) -> pd.DataFrame:
        found = [sps_size(bytes(n)) if n is not None else None for n in nals]
        return pd.DataFrame([x or (None,) * 4 for x in found], columns=["profile", "level", "width", "height"]).astype("Int32")

    return F.when(data.isNotNull(), of(data))


def crc32_mpeg2(data: Column) -> Column:
    """CRC-32 as MPEG tables use it: not reflected, no final inversion."""
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        table.append(c)

    @F.pandas_udf("bigint")
    def of(chunks: pd.Series) -> pd.Series:
        def crc(b: bytes) -> int:
            c = 0xFFFFFFFF
            for x in b:
                c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ x]
            return c

        return chunks.map(lambda b: crc(bytes(b)), na_action="ignore").astype("Int64")

    return of(data)
