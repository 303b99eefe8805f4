"""Catalogs: devices, channels, sessions, alarms, topology, relay plans. supplier = device, customer = channel, orders = session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..model import DECODERS, ENCODERS, codecs


def devices(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    """Devices with the number of channels of their nation."""
    n = customer.groupBy("c_nationkey").agg(F.count("*").alias("channel_count"))
    return supplier.join(n, F.col("s_nationkey") == F.col("c_nationkey"), "left").select(F.col("s_suppkey").alias("device_id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") >= 0, "online").otherwise("offline").alias("status"), F.coalesce("channel_count", F.lit(0).cast("bigint")).alias("channel_count"))


def channels(supplier: DataFrame, customer: DataFrame, device_id: int | None = None) -> DataFrame:
    """Channels with their device; of one device if asked for."""
    d = supplier if device_id is None else supplier.where(F.col("s_suppkey") == device_id)
    return customer.join(d, F.col("c_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("device_id"), F.col("c_custkey").alias("channel_id"), F.col("c_name").alias("name"))


def last_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max("ts").alias("last_ts"))


def offline_devices(supplier: DataFrame, events: DataFrame, hours: int) -> DataFrame:
    """Devices whose last event lies more than so many hours before the table's newest."""
    now = events.agg(F.max("ts").alias("now_ts"))
    seen = last_seen(events).join(F.broadcast(now))  # one row
    late = F.expr("timestampdiff(SECOND, last_ts, now_ts)")
    return supplier.join(seen, F.col("s_suppkey") == F.col("user_id")).where(late > hours * 3600).select(F.col("s_suppkey").alias("device_id"), late.alias("silent_s"))


def alarms(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'error'").select(F.col("user_id").alias("device_id"), "event_id")


def known_alarms(supplier: DataFrame, events: DataFrame) -> DataFrame:
    return alarms(events).join(supplier, F.col("device_id") == F.col("s_suppkey")).groupBy("device_id", F.col("s_name").alias("name")).agg(F.count("*").alias("alarms"))


def orphan_alarms(supplier: DataFrame, events: DataFrame) -> DataFrame:
    return alarms(events).join(supplier, F.col("device_id") == F.col("s_suppkey"), "left_anti")


def sessions(orders: DataFrame) -> DataFrame:
    """Sessions with their state decoded; F is closed, O playing, P inviting."""
    state = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "playing").otherwise("inviting")
    return orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("channel_id"), state.alias("state"), F.when(F.col("o_orderkey") % 2 == 0, "inbound").otherwise("outbound").alias("direction"))


def open_sessions(orders: DataFrame) -> DataFrame:
    return sessions(orders).where("state <> 'closed'").groupBy("channel_id").agg(F.count("*").alias("open_sessions"), F.max("session_id").alias("latest_session"))


def playback(orders: DataFrame, start: str, end: str) -> DataFrame:
    """Sessions whose time lies in the range; both ends count."""
    lit = lambda s: F.expr(f"TIMESTAMP_NTZ'{s}'")
    return orders.where((F.col("o_orderdate") >= lit(start)) & (F.col("o_orderdate") <= lit(end))).select(F.col("o_orderkey").alias("session_id"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").alias("start_s"))


def codec_matrix(spark) -> DataFrame:
    """Which audio codec can be made of which: a decoder for one and an encoder for the other."""
    audio = codecs(spark).where("media = 'audio'")
    a, b = audio.select(F.col("codec").alias("source")), audio.select(F.col("codec").alias("target"))
    can = F.col("source").isin(*DECODERS) & F.col("target").isin(*ENCODERS)
    return a.join(F.broadcast(b), F.lit(True)).select("source", "target", can.alias("possible"))  # eight rows each


def topology_paths(region: DataFrame, nation: DataFrame) -> DataFrame:
    """Origin, edge and path of every node of the relay tree."""
    root = region.select(F.col("r_name").alias("origin"), F.lit(None).cast("string").alias("edge"), F.col("r_name").alias("path"), F.lit(0).alias("hops"))
    edge = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("origin"), F.col("n_name").alias("edge"), F.concat_ws("/", "r_name", "n_name").alias("path"), F.lit(1).alias("hops"))
    return root.unionByName(edge)


#: Relay schemes that a forwarder has.
SCHEMES = ("rtmp", "rtsp", "srt", "rtp")


def forward_plan(supplier: DataFrame, region: DataFrame) -> DataFrame:
    """Each device's stream to each region's target, where the target's scheme is known."""
    scheme = F.element_at(F.array(*map(F.lit, (*SCHEMES, "webrtc"))), (F.col("r_regionkey") % 5 + 1).cast("int"))
    targets = region.select("r_name", scheme.alias("scheme")).where(F.col("scheme").isin(*SCHEMES))
    return supplier.join(F.broadcast(targets), F.lit(True)).select(F.col("s_suppkey").alias("stream_key"), F.concat(F.col("scheme"), F.lit("://"), F.lower("r_name"), F.lit("/live/"), F.col("s_suppkey").cast("string")).alias("target"))


def intervals(events: DataFrame, start: str, end: str) -> DataFrame:
    """From each start event of a user to the next end event before another start, else to the next start or open."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    rows = events.where(F.col("event_type").isin(start, end)).select("user_id", "event_id", "event_type", "ts").withColumn("end_ts", F.lead("ts").over(by)).withColumn("next_type", F.lead("event_type").over(by))
    return rows.where(F.col("event_type") == start).select("user_id", F.col("event_id").alias("start_id"), F.col("ts").alias("start_ts"), "end_ts", F.coalesce(F.col("next_type") == end, F.lit(False)).alias("closed"))


def origin_pull(events: DataFrame) -> DataFrame:
    """Subscriptions (view) at which no publication (signup until the next purchase) is under way."""
    by = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    live = F.last(F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 0), ignorenulls=True).over(by)
    return events.withColumn("live", F.coalesce(live, F.lit(0))).where("event_type = 'view' AND live = 0").select("user_id", "event_id")


def lifecycle(events: DataFrame, timeout_h: int = 15) -> DataFrame:
    """State of each stream after every publish (signup) or unpublish (purchase), and how long it lasts up to the time limit."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    rows = events.where(F.col("event_type").isin("signup", "purchase")).withColumn("next_ts", F.lead("ts").over(by))
    gap = F.expr("timestampdiff(SECOND, ts, next_ts)")
    limit = timeout_h * 3600
    state = F.when(F.col("event_type") == "signup", "publishing").when(gap.isNull() | (gap > limit), "destroying").otherwise("no_publisher")
    return rows.select("user_id", "event_id", state.alias("state"), F.when(state == "destroying", F.lit(limit).cast("bigint")).otherwise(gap).alias("lasts_s"))


def heartbeats(events: DataFrame, seconds: int = 10) -> DataFrame:
    """Events and value a window of so many seconds, of each stream that is alive in it."""
    at = F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / seconds).cast("bigint")
    return events.groupBy("user_id", (at * seconds).alias("window_s")).agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


#: Endpoints and the events that each wants; none: all.
ENDPOINTS = {"audit": [], "billing": ["purchase"], "growth": ["signup", "purchase"], "ops": ["error"]}


def fanout(events: DataFrame) -> DataFrame:
    """Deliveries of each endpoint."""
    spark = events.sparkSession
    ends = spark.createDataFrame(list(ENDPOINTS.items()), "endpoint string, wanted array<string>")
    wants = (F.size("wanted") == 0) | F.array_contains("wanted", F.col("event_type"))
    return events.join(F.broadcast(ends), wants).groupBy("endpoint", "event_type").agg(F.count("*").alias("deliveries"), F.max("event_id").alias("last_event"))


#: (priority, rule, what fails): the first failing rule of an event, by priority, refuses it.
RULES = [(10, "no_negative_value", "value < 0"), (20, "known_type", "event_type NOT IN ('view', 'click', 'signup', 'purchase', 'error')"), (30, "value_limit", "value > 90"), (40, "not_an_error", "event_type = 'error'")]


def validation(events: DataFrame) -> DataFrame:
    """Events by the rule that refuses them, none where they pass."""
    first = F
    for _, name, fails in sorted(RULES):
        first = first.when(F.expr(fails), name)
    return events.select(first.otherwise("passed").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("events"))


def subscribers(events: DataFrame) -> DataFrame:
    """Subscriber totals by protocol (here event type) of a map of each stream, merged and exploded again."""
    n = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("subscribers"), F.size("m").cast("bigint").alias("protocols"))


def prometheus(events: DataFrame) -> DataFrame:
    """Metrics in long form: one row a stream and metric."""
    rows = events.groupBy("user_id").agg(F.count("*").alias("events_total"), F.count_if(F.col("event_type") == "error").alias("errors_total"), F.max("event_id").alias("last_event"))
    return rows.unpivot("user_id", ["events_total", "errors_total", "last_event"], "metric", "sample")


#: Numbers of events that a block of `admission` spans.
ADMITTED = 10_000


def admission(events: DataFrame, most: int) -> DataFrame:
    """Signups beyond the limit of streams that are open (signup +1, purchase -1, never below 0) are refused, per day.

    Each block of event numbers is summed by itself; a day's blocks, few rows, then
    give what each begins with.
    """
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1)
    within = Window.partitionBy("day", "block").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.where("event_type IN ('signup', 'purchase')").select(F.to_date("ts").alias("day"), F.floor(F.col("event_id") / ADMITTED).alias("block"), "event_id", step.alias("step"))
    rows = rows.withColumn("sum", F.sum("step").over(within)).withColumn("low", F.min("sum").over(within))
    before = Window.partitionBy("day").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("day", "block").agg(F.sum("step").alias("total"), F.min("sum").alias("least"))
    blocks = blocks.withColumn("begin", F.coalesce(F.sum("total").over(before), F.lit(0))).withColumn("floor", F.least(F.coalesce(F.min(F.col("begin") + F.col("least")).over(before), F.lit(0)), F.lit(0)))
    found = rows.join(blocks.select("day", "block", "begin", "floor"), ["day", "block"])
    # Never below 0: what is open stands above the least sum so far.
    opened = F.col("begin") + F.col("sum") - F.least(F.col("floor"), F.col("begin") + F.col("low"))
    return found.where((F.col("step") == 1) & (opened > most)).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("refused"))


def free_ports(orders: DataFrame, low: int = 30_000, high: int = 30_400) -> DataFrame:
    """The first free even port, where sessions hold pairs from low on by their number."""
    spark = orders.sparkSession
    used = orders.where("o_orderstatus = 'F'").select((F.lit(low) + 2 * F.pmod("o_orderkey", F.lit((high - low) // 2))).cast("bigint").alias("port")).distinct()
    ports = spark.range(low, high, 2).withColumnRenamed("id", "port")
    return ports.join(used, "port", "left_anti").agg(F.min("port").alias("port"), F.count("*").alias("free"))


def stats_rollup(frames: DataFrame) -> DataFrame:
    """Extension: bytes and frames by stream and media, with subtotals."""
    return frames.rollup("stream_key", "media").agg(F.count("*").alias("frames"), F.sum("size").alias("bytes"))
