"""Flow control: windows over recent frames, gates and drops, and per-key state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .fold import Machine, fold
from .quality import by_arrival, media_frames
from .segments import is_key


def _recent(window_ms: int):
    return Window.partitionBy("stream_key").orderBy("dts_ms").rangeBetween(-window_ms, 0)


def audio_cache(frames: DataFrame, window_ms: int = 1000) -> DataFrame:
    """Audio frames and bytes held at each audio frame: those of the last window_ms, both ends included."""
    audio = media_frames(frames).where("media = 'audio'")
    w = _recent(window_ms)
    return audio.select("stream_key", "seq", F.count("*").over(w).alias("cached"), F.sum("size").over(w).alias("cached_bytes"))


def skip_tracker(frames: DataFrame, window_ms: int, most: int) -> DataFrame:
    """Error frames (skips) at which more than `most` lie in the window; most <= 0 turns it off."""
    skips = frames.where("frame_type = 'key'")
    out = skips.select("stream_key", "seq", F.count("*").over(_recent(window_ms)).alias("skips"))
    return out.where((F.col("skips") > most) & F.lit(most > 0))


def rate_windows(frames: DataFrame, window_ms: int = 2000) -> DataFrame:
    """Tumbling windows with the previous one's bytes: kbit/s and frames/s over both."""
    rows = frames.groupBy("stream_key", F.floor(F.col("dts_ms") / window_ms).cast("bigint").alias("bucket")).agg(F.sum("size").alias("bytes"), F.count("*").alias("frames"))
    by = Window.partitionBy("stream_key").orderBy("bucket")
    near = F.lag("bucket").over(by) == F.col("bucket") - 1
    before = lambda c: F.when(near, F.lag(c).over(by)).otherwise(F.lit(0).cast("bigint"))
    return rows.select("stream_key", "bucket", "bytes", "frames", before("bytes").alias("bytes_before"), ((F.col("bytes") + before("bytes")) * 8 / F.lit(2.0 * window_ms)).alias("kbps"))


def ring(frames: DataFrame, size: int = 1024) -> DataFrame:
    """Cursor, oldest readable place and lag of a reader that stands at half of each stream."""
    rows = frames.groupBy("stream_key").agg(F.count("*").alias("written"))
    read = F.floor(F.col("written") / 2).cast("bigint")
    oldest = F.greatest(F.col("written") - size, F.lit(0).cast("bigint"))
    lag = F.least(F.col("written") - read, F.lit(size).cast("bigint"))
    return rows.select("stream_key", "written", oldest.alias("oldest"), F.greatest(oldest - read, F.lit(0).cast("bigint")).alias("skipped"), (lag / F.lit(float(size))).alias("lag_ratio"))


def ring_retention(frames: DataFrame, size: int) -> DataFrame:
    rows = frames.withColumn("_n", F.row_number().over(Window.partitionBy("stream_key").orderBy(F.desc("seq")))).where(F.col("_n") <= size)
    return rows.groupBy("stream_key").agg(F.count("*").alias("held"), F.min("seq").alias("first_seq"), F.sum("size").alias("bytes"))


def b_frame_drop(frames: DataFrame) -> DataFrame:
    """Video frames that would go back in pts: no keys, and below the largest pts before (0 at first)."""
    video = media_frames(frames).where("media = 'video'")
    top = F.coalesce(F.max("pts_ms").over(by_arrival().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return video.select("stream_key", "seq", "pts_ms", top.alias("top_ms"), is_key().alias("is_key")).where("NOT is_key AND pts_ms < top_ms").drop("is_key")


def keyframe_gate(frames: DataFrame) -> DataFrame:
    """Frames from the first video keyframe on."""
    open_ = F.max(F.when(is_key(), 1).otherwise(0)).over(by_arrival().rowsBetween(Window.unboundedPreceding, 0))
    return media_frames(frames).withColumn("_open", open_).where("_open = 1").groupBy("stream_key").agg(F.count("*").alias("passed"), F.min("seq").alias("first_seq"))


def sample_durations(frames: DataFrame) -> DataFrame:
    """Time since the frame sent before, of the same media; 40 ms for a first video frame, 20 for audio."""
    by = Window.partitionBy("stream_key", "media").orderBy("seq")
    d = F.col("dts_ms") - F.lag("dts_ms").over(by)
    return media_frames(frames).select("stream_key", "seq", "media", F.coalesce(d, F.when(F.col("media") == "video", 40).otherwise(20)).alias("duration_ms"))


def pacing(frames: DataFrame, reset_ms: int = 1000) -> DataFrame:
    """What a pacer does at each frame: reset on a jump ahead of reset_ms or more or back of more, else wait or deliver."""
    d = F.col("dts_ms") - F.lag("dts_ms").over(by_arrival())
    action = F.when(d.isNull() | (d >= reset_ms) | (d < -reset_ms), "reset").when(d > 0, "sleep").otherwise("deliver")
    return media_frames(frames).select("stream_key", action.alias("action")).groupBy("stream_key", "action").agg(F.count("*").alias("frames"))


def replay_pacing(frames: DataFrame, most_ms: int) -> DataFrame:
    """A tenth of the interval, where that is below most_ms."""
    d = F.col("dts_ms") - F.lag("dts_ms").over(by_arrival())
    tenth = F.floor(d / 10).cast("bigint")
    return media_frames(frames).select("stream_key", F.when((d > 0) & (tenth < most_ms), tenth).otherwise(F.lit(0).cast("bigint")).alias("wait")).groupBy("stream_key").agg(F.sum("wait").alias("wait_ms"), F.count_if(F.col("wait") > 0).alias("waits"))


def reclock(frames: DataFrame, rate: int = 48_000, block: int = 1024, samples_a_byte: int = 1) -> DataFrame:
    """Audio regrouped to blocks of equal samples: dts is the stream's first plus whole samples in ms."""
    audio = media_frames(frames).where("media = 'audio'").groupBy("stream_key").agg(F.min_by("dts_ms", "seq").alias("base_ms"), F.sum(F.col("size") * samples_a_byte).alias("samples"))
    blocks = F.floor(F.col("samples") / block).cast("bigint")
    rows = audio.withColumn("blocks", blocks).where("blocks > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    return rows.select("stream_key", "block", (F.col("base_ms") + F.floor(F.col("block") * block * 1000 / rate).cast("bigint")).alias("dts_ms"))


def fragments(frames: DataFrame, mtu: int = 1200) -> DataFrame:
    """RTP fragments of VP8, VP9 and AV1: mtu - 1 bytes each, the last one marked."""
    chunk = mtu - 1
    count = F.greatest(F.ceil(F.col("size") / chunk), F.lit(1)).cast("bigint")
    rows = media_frames(frames).where("media = 'video'").select("stream_key", "seq", "size", count.alias("n")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    return rows.select("stream_key", "seq", "i", F.least(F.lit(chunk).cast("bigint"), F.col("size") - F.col("i") * chunk).alias("bytes"), (F.col("i") == F.col("n") - 1).alias("marker"))


def stamps(frames: DataFrame, clock: int = 90_000) -> DataFrame:
    """RTP sequence numbers (16 bits) and timestamps (32 bits) of video frames."""
    n = F.row_number().over(by_arrival()) - 1
    return media_frames(frames).where("media = 'video'").select("stream_key", "seq", F.pmod(n, F.lit(65536)).cast("bigint").alias("rtp_seq"), F.pmod(F.expr(f"dts_ms * {clock} div 1000"), F.lit(1 << 32)).alias("rtp_ts"))


class Ewma(Machine):
    def __init__(self, alpha: float):
        self.alpha, self.value = alpha, 0.0

    def step(self, row: tuple) -> list[tuple]:
        seq, x = row
        self.value = float(x) if self.value == 0 else self.alpha * x + (1 - self.alpha) * self.value
        return [(seq, self.value)]


def ewma(frames: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Moving average of sizes; it starts anew whenever it is 0."""
    return fold(frames, ["stream_key"], ["seq"], ["seq", "size"], lambda: Ewma(alpha), "seq bigint, ewma double")


class Coalesce(Machine):
    def __init__(self, window_ms: int):
        self.window_ms, self.last = window_ms, None

    def step(self, row: tuple) -> list[tuple]:
        seq, dts = row
        if self.last is not None and dts - self.last < self.window_ms:
            return []
        self.last = dts
        return [(seq, dts)]


def pli_coalesce(frames: DataFrame, window_ms: int = 500) -> DataFrame:
    """Keyframe requests (here error frames) that are forwarded: window_ms or more after the last forwarded one."""
    return fold(frames.where("frame_type = 'key'"), ["stream_key"], ["seq"], ["seq", "dts_ms"], lambda: Coalesce(window_ms), "seq bigint, dts_ms bigint")


class Bucket(Machine):
    """Milli-tokens, so that sums are exact."""

    def __init__(self, refill_ms: int, burst: int):
        self.refill_ms, self.burst, self.left, self.last = refill_ms, burst, None, 0

    def step(self, row: tuple) -> list[tuple]:
        seq, dts = row
        full = self.burst * self.refill_ms
        self.left = full if self.left is None else min(full, self.left + max(0, dts - self.last))
        self.last = dts
        ok = self.left >= self.refill_ms
        self.left -= self.refill_ms if ok else 0
        return [(seq, ok)]


def token_bucket(frames: DataFrame, refill_ms: int, burst: int) -> DataFrame:
    """Admission of each frame: a token every refill_ms, burst at most; what is denied also moves the clock."""
    return fold(frames, ["stream_key"], ["seq"], ["seq", "dts_ms"], lambda: Bucket(refill_ms, burst), "seq bigint, admitted boolean")


class SlowConsumer(Machine):
    def __init__(self, drop: float, skip: float, recover: float):
        self.drop, self.skip, self.recover, self.state = drop, skip, recover, "NORMAL"

    def step(self, row: tuple) -> list[tuple]:
        seq, media, kind, lag, slow = row
        key = media == "video" and kind == "key"
        if self.state != "NORMAL" and lag < self.recover:
            self.state = "NORMAL"
        elif self.state == "NORMAL" and lag > self.drop and slow:
            self.state = "DROP"
        elif self.state == "DROP" and lag > self.skip:
            self.state = "SKIP"
        if media != "video" or kind == "seqhdr" or self.state == "NORMAL":
            sent = True
        elif self.state == "DROP":
            sent = key
        else:
            sent = key
            if key:
                self.state = "DROP"
        return [(seq, self.state, sent)]


def slow_consumer(rows: DataFrame, drop: float = 0.75, skip: float = 0.9, recover: float = 0.5) -> DataFrame:
    """State and delivery at each frame, given the reader's lag ratio and whether its sends are slow (columns lag, slow)."""
    return fold(rows, ["stream_key"], ["seq"], ["seq", "media", "frame_type", "lag", "slow"], lambda: SlowConsumer(drop, skip, recover), "seq bigint, state string, sent boolean")


class Admission(Machine):
    def __init__(self, window_ms: int, most: int):
        self.window_ms, self.most, self.bucket, self.bytes = window_ms, most, None, 0

    def step(self, row: tuple) -> list[tuple]:
        seq, kind, dts, size = row
        if dts // self.window_ms != self.bucket:
            self.bucket, self.bytes = dts // self.window_ms, 0
        ok = kind == "seqhdr" or self.bytes <= self.most
        self.bytes += size if ok else 0
        return [(seq, ok)]


def bitrate_admission(frames: DataFrame, window_ms: int, most_bytes: int) -> DataFrame:
    """Frames taken while the window's bytes taken so far are not above most_bytes; headers always; what is refused doesn't count."""
    return fold(frames, ["stream_key"], ["seq"], ["seq", "frame_type", "dts_ms", "size"], lambda: Admission(window_ms, most_bytes), "seq bigint, admitted boolean")


class Reorder(Machine):
    def __init__(self, most: int):
        self.most, self.next, self.held, self.place = most, None, {}, 0

    def _run(self) -> list[tuple]:
        out = []
        while self.next in self.held:
            out.append((self.next, self.held.pop(self.next), self.place))
            self.next, self.place = (self.next + 1) % 65536, self.place + 1
        return out

    def step(self, row: tuple) -> list[tuple]:
        seq16, ref = row
        if self.next is None:
            self.next = seq16
        self.held[seq16] = ref
        out = self._run()
        if len(self.held) > self.most:
            self.next = min(self.held, key=lambda s: (s - self.next) % 65536)
            out += self._run()
        return out

    def end(self) -> list[tuple]:
        out = []
        while self.held:
            self.next = min(self.held, key=lambda s: (s - self.next) % 65536)
            out += self._run()
        return out


def reorder(rows: DataFrame, most: int = 50) -> DataFrame:
    """Packets in sequence order (16 bits, wrapping): what is next goes out; beyond `most` held, the gap is given up. place: when a packet goes out, from 0."""
    return fold(rows, ["stream_key"], ["arrival"], ["rtp_seq", "arrival"], lambda: Reorder(most), "rtp_seq bigint, arrival bigint, place bigint")


def feedback_mode(subscribers: Column, passthrough: int = 3, aggregate: int = 20) -> Column:
    """How keyframe requests of so many subscribers are treated; thresholds of 0 or less are passed over."""
    out = F
    if passthrough > 0:
        out = out.when(subscribers <= passthrough, "passthrough")
    if aggregate > 0:
        out = out.when(subscribers <= aggregate, "aggregate")
    return out.otherwise("drop") if out is not F else F.lit("drop")


def retry_delays(attempts: Column, base_s: int = 1, most_s: int = 30) -> Column:
    """Seconds before each attempt: base * 2^min(n-1, 4), at most most_s."""
    return F.transform(F.sequence(F.lit(1), attempts), lambda n: F.least(F.lit(base_s).cast("double") * F.pow(F.lit(2.0), F.least(n - 1, F.lit(4))), F.lit(float(most_s))).cast("bigint"))
