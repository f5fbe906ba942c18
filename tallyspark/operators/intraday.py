"""Dense intraday grids: buckets up to now, of the local calendar day, or of the active block; with the period before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timefns as T
from .events import TOKENS

MINUTE_MS = 60_000
#: Window of each span, its own bucket, and the steps of the day's line.
WINDOWS = {"15m": 15 * MINUTE_MS, "1h": T.HOUR_MS, "block": 5 * T.HOUR_MS, "today": T.DAY_MS, "7d": 7 * T.DAY_MS, "30d": 30 * T.DAY_MS}
BUCKETS = {"15m": MINUTE_MS, "1h": MINUTE_MS, "today": T.HOUR_MS}
LINE_MS, LADDER, LINE_BUCKETS = 15 * MINUTE_MS, (MINUTE_MS, 2 * MINUTE_MS, 5 * MINUTE_MS, 10 * MINUTE_MS, 15 * MINUTE_MS), 300
MOST_BUCKETS = 5_000


def checked(window: int, bucket: int) -> int:
    """The number of buckets; ValueError if they don't tile the window or are too many."""
    if bucket <= 0 or window % bucket:
        raise ValueError(f"bucket {bucket} does not divide window {window}")
    if window // bucket > MOST_BUCKETS:
        raise ValueError(f"{window // bucket} buckets exceed {MOST_BUCKETS}")
    return window // bucket


def gridded(placed: DataFrame, starts: DataFrame, axes: tuple[str, ...] = ()) -> DataFrame:
    """placed: events with frame and idx; starts: frame, idx, bucket_start. Every bucket of every axis value, zeros where
    there is no event. Sums come before the spine, so the spine joins one row a bucket."""
    sums = placed.groupBy("frame", *axes, "idx").agg(F.count(F.lit(1)).alias("n_events"), *(F.sum(c).alias(c) for c in [*TOKENS, "cost"]))
    spine = starts
    if axes:
        spine = starts.join(sums.select("frame", *axes).distinct(), "frame")
    return spine.join(sums, ["frame", *axes, "idx"], "left").na.fill(0, ["n_events", *TOKENS, "cost"])


#: Levels of an assembled grid, by which axes they have.
LEVELS = {"total": (), "project": ("project_slug",), "machine": ("machine_id",), "machine-project": ("machine_id", "project_slug")}


def levels(by_project: bool, by_machine: bool) -> list[str]:
    """What a request asks for. Projects by themselves are left out where machines are asked for: they lie within these."""
    return ["total", *(["project"] if by_project and not by_machine else []), *(["machine"] if by_machine else []), *(["machine-project"] if by_project and by_machine else [])]


def assembled(placed: DataFrame, starts: DataFrame, wanted: list[str]) -> DataFrame:
    """placed: events with frame and idx; starts: frame, idx, bucket_start. All wanted levels in one pass over the events:
    level, machine_id and project_slug (null where the level has none), frame, idx, bucket_start and sums. Each level is dense:
    every bucket of both frames for each value that is in either, so one of the frame before alone has zeros now."""
    keys = ["machine_id", "project_slug"]
    own = placed.groupingSets([["frame", "idx", *LEVELS[x]] for x in wanted], "frame", "idx", *keys)
    level = F.when(F.grouping("machine_id") + F.grouping("project_slug") == 2, "total").when(F.grouping("machine_id") == 1, "project").when(F.grouping("project_slug") == 1, "machine").otherwise("machine-project")
    sums = own.agg(level.alias("level"), F.count(F.lit(1)).alias("n_events"), *(F.sum(c).alias(c) for c in [*TOKENS, "cost"]))
    none = placed.sparkSession.createDataFrame([("total", None, None)], "level string, machine_id string, project_slug string")
    values = sums.select("level", *keys).unionByName(none).distinct() if "total" in wanted else sums.select("level", *keys).distinct()
    grid = values.crossJoin(starts).alias("g")  # the dense grid is this product: the buckets are MOST_BUCKETS a frame at most
    at = ["level", "frame", "idx"]
    met = grid.join(sums.alias("s"), [F.col(f"g.{c}") == F.col(f"s.{c}") for c in at] + [F.col(f"g.{c}").eqNullSafe(F.col(f"s.{c}")) for c in keys], "left")
    return met.select("g.*", "s.n_events", *(f"s.{c}" for c in [*TOKENS, "cost"])).na.fill(0, ["n_events", *TOKENS, "cost"])


def frames(events: DataFrame, start: Column, before: Column | None, bucket: int, count: int) -> DataFrame:
    """events (with ms) of the current frame and, if asked for, of the one before."""
    own = events.select("*", F.lit("current").alias("frame"), F.floor((F.col("ms") - start) / bucket).cast("int").alias("idx"))
    if before is not None:
        own = own.unionByName(events.select("*", F.lit("previous").alias("frame"), F.floor((F.col("ms") - before) / bucket).cast("int").alias("idx")))
    return own.filter((F.col("idx") >= 0) & (F.col("idx") < count))


def spine(spark, count: int, current: Column, previous: Column | None) -> DataFrame:
    """frame, idx and bucket_start (ms); current and previous are functions of column idx."""
    idx = spark.range(count).select(F.col("id").cast("int").alias("idx"))
    out = idx.select(F.lit("current").alias("frame"), "idx", current.cast("long").alias("bucket_start"))
    return out if previous is None else out.unionByName(idx.select(F.lit("previous").alias("frame"), "idx", previous.cast("long").alias("bucket_start")))


def rolling(events: DataFrame, span: str, now: int, bucket: int | None = None, previous: bool = True, axes: tuple[str, ...] = (), wanted: list[str] | None = None) -> DataFrame:
    """Buckets that end exactly at now (an event at now is out), and the same before them; with wanted, the levels of
    assembled()."""
    bucket = bucket or BUCKETS.get(span, LINE_MS)
    count = checked(WINDOWS[span], bucket)
    start, before = now - count * bucket, now - 2 * count * bucket
    events = events.filter((F.col("ts") >= T.from_ms(F.lit(before if previous else start))) & (F.col("ts") < T.from_ms(F.lit(now)))).withColumn("ms", T.epoch_ms(F.col("ts")))
    placed = frames(events, F.lit(start), F.lit(before) if previous else None, bucket, count)
    at = lambda s: F.lit(s) + F.col("idx") * bucket
    starts = spine(events.sparkSession, count, at(start), at(before) if previous else None)
    return assembled(placed, starts, wanted) if wanted else gridded(placed, starts, axes)


def today(events: DataFrame, now: int, tz: str, bucket: int = T.HOUR_MS, previous: bool = True, axes: tuple[str, ...] = ()) -> DataFrame:
    """Buckets of the local day up to now, by the local clock; later events of today count in the last one. The frame
    before is yesterday's same hours."""
    import datetime as dt
    from zoneinfo import ZoneInfo

    local = dt.datetime.fromtimestamp(now // 1000, ZoneInfo(tz))
    day, last = local.date(), local.date() - dt.timedelta(1)
    past = (local.hour * 3600 + local.minute * 60 + local.second) * 1000
    count = past // bucket + 1
    checked(count * bucket, bucket)
    first = F.lit((last if previous else day).isoformat()).cast("date")
    events = events.filter(F.col("ts") >= T.from_ms(T.zoned_instant(first, F.lit(0), tz)))
    own = events.withColumns({"_day": T.local_date(F.col("ts"), tz), "_idx": F.floor(T.ms_since_midnight(F.col("ts"), tz) / bucket).cast("int")})
    frame = F.when(F.col("_day") == day.isoformat(), "current").when((F.col("_day") == last.isoformat()) & (F.col("_idx") < count) & F.lit(previous), "previous")
    placed = own.withColumn("frame", frame).filter("frame IS NOT NULL").withColumn("idx", F.when(F.col("frame") == "current", F.least("_idx", F.lit(count - 1))).otherwise(F.col("_idx")))
    at = lambda d: T.zoned_instant(F.lit(d.isoformat()).cast("date"), F.col("idx") * bucket, tz)
    return gridded(placed, spine(events.sparkSession, count, at(day), at(last) if previous else None), axes)


def block_frame(events: DataFrame, start: int, end: int, now: int, before: tuple[int, int] | None = None, bucket: int = MINUTE_MS, axes: tuple[str, ...] = (), exclusions: DataFrame | None = None) -> DataFrame:
    """Buckets from a block's start to now; later events of the block count in the last one. The frame before is the
    previous block's (start, end), aligned at their starts. Events inside exclusions (start, end, source) are out."""
    count = max(1, min(-(-(now - start) // bucket), -(-(end - start) // bucket)))
    checked(count * bucket, bucket)
    events = events.withColumn("ms", T.epoch_ms(F.col("ts"))).filter(F.col("ms") < end)
    if exclusions is not None:
        from .blocks import in_window

        events = in_window(events, exclusions, "left_anti")
    own = events.filter(F.col("ms") >= start).select("*", F.lit("current").alias("frame"), F.least(F.floor((F.col("ms") - start) / bucket), F.lit(count - 1)).cast("int").alias("idx"))
    if before:
        prev = events.filter((F.col("ms") >= before[0]) & (F.col("ms") < before[1])).select("*", F.lit("previous").alias("frame"), F.floor((F.col("ms") - before[0]) / bucket).cast("int").alias("idx"))
        own = own.unionByName(prev.filter(F.col("idx") < count))
    at = lambda s: F.lit(s) + F.col("idx") * bucket
    return gridded(own, spine(events.sparkSession, count, at(start), at(before[0]) if before else None), axes)


def line_bucket(span: str) -> int:
    """A line's bucket: the span's own if it is finer than LINE_MS."""
    return min(BUCKETS.get(span, LINE_MS), LINE_MS)


def today_line_bucket(past: int) -> int:
    """The coarsest step that gives the day so far LINE_BUCKETS buckets, else the finest."""
    return max((b for b in LADDER if max(0, past) // b + 1 >= LINE_BUCKETS), default=LADDER[0])
