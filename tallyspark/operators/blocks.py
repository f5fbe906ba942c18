"""Five-hour blocks: real windows from limit samples, heuristic blocks for the rest, gaps, burn rate and projection.

The heuristic walk depends on order, but only hours matter to it: a block starts at a full hour, and within an hour
it can change only right after the full hour itself. So events are first reduced to one row an hour (first, last and
first-after-the-hour instants, a partial aggregate). A block that began over five hours before an hour doesn't matter to
it, so a stretch of CHUNK_HOURS can be entered in six ways only: in none of the blocks of the last five hours, or in one
of them. Each stretch is walked from all six, the stretches of a key are then joined by where each is really entered, and
its hours are walked once more from there. No list is longer than a stretch or the number of a key's stretches, and the
result joins back to hourly sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timefns as T
from .events import TOKENS, any_model, member, total

SPAN = 5 * T.HOUR_MS


def timed(events: DataFrame) -> DataFrame:
    """events with ms, the epoch milliseconds of their timestamp; those without a readable one go."""
    return events.filter(F.col("ts").isNotNull()).withColumn("ms", T.epoch_ms(F.col("ts")))


def observed_windows(samples: DataFrame) -> DataFrame:
    """Distinct real windows (start, end): minute-rounded resets of samples (captured_at ms, util, reset_at ms) in use."""
    end = T.round_minute(F.col("reset_at"))
    return samples.filter("util > 0").select((end - SPAN).alias("start"), end.alias("end")).distinct()


def resolved_windows(samples: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Disjoint windows (start, end, source): one that overlaps its successor ends where that starts. The latest
    sample's window, in use or not, joins with what earlier ones leave uncovered, if an event (ms) lies there."""
    real = observed_windows(samples)
    by_end = Window.orderBy("end")  # a few windows a day
    nxt = F.lead("start").over(by_end)
    cut = nxt.isNotNull() & (nxt < F.col("end"))
    out = real.withColumn("n", nxt).select("start", F.when(cut, nxt).otherwise(F.col("end")).alias("end"), F.when(cut, "annulled").otherwise("observed").alias("source"))
    if events is None:
        return out
    end = T.round_minute(F.col("l.reset_at"))
    live = samples.agg(F.max(F.struct("captured_at", "reset_at")).alias("l")).select((end - SPAN).alias("s"), end.alias("e"))
    last = real.agg(F.max("end").alias("last"))
    live = live.crossJoin(last).filter("last IS NULL OR e > last").select(F.greatest("s", F.coalesce("last", "s")).alias("start"), F.col("e").alias("end"))  # one row
    live = live.join(events.select("ms"), (F.col("ms") >= F.col("start")) & (F.col("ms") < F.col("end")), "left_semi")
    return out.unionByName(live.withColumn("source", F.lit("observed")))


def in_window(events: DataFrame, windows: DataFrame, how: str = "left") -> DataFrame:
    """events with the window that contains them (half-open), null columns where none does. Windows are disjoint, so an
    event meets at most one; they are bucketed by hour to make the range join an equality join."""
    hours = F.explode(F.sequence(T.floor_hour(F.col("start")), T.floor_hour(F.col("end") - 1), F.lit(T.HOUR_MS)))
    w = windows.select(F.col("start").alias("w_start"), F.col("end").alias("w_end"), F.col("source").alias("w_source"), hours.alias("hour"))
    events = events.withColumn("hour", T.floor_hour(F.col("ms")))
    on = (events["hour"] == w["hour"]) & (F.col("ms") >= F.col("w_start")) & (F.col("ms") < F.col("w_end"))
    return events.join(w, on, how).drop(w["hour"]).drop("hour") if how != "left_anti" else events.join(w, on, how).drop("hour")


def window_peaks(windows: DataFrame, samples: DataFrame) -> DataFrame:
    """windows with peak: the largest utilisation sampled in [start, end], null if none was."""
    w = windows.withColumn("_h", F.explode(F.sequence(T.floor_hour(F.col("start")), T.floor_hour(F.col("end")), F.lit(T.HOUR_MS))))
    s = samples.select("captured_at", "util", T.floor_hour(F.col("captured_at")).alias("_hour"))
    met = w.join(s, (F.col("_h") == F.col("_hour")) & (F.col("captured_at") >= F.col("start")) & (F.col("captured_at") <= F.col("end")), "left")
    return met.groupBy(*windows.columns).agg(F.max("util").alias("peak"))


def hours_of(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hour, first, last and inner (first after the full hour) of events with ms."""
    return events.groupBy(*keys, T.floor_hour(F.col("ms")).alias("hour")).agg(
        F.min("ms").alias("first"), F.max("ms").alias("last"), F.min(F.when(F.pmod("ms", F.lit(T.HOUR_MS)) > 0, F.col("ms"))).alias("inner")
    )


#: Hours of a stretch of the walk.
CHUNK_HOURS = 168


def walked(hours: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hour, at_hour (block start of an event at the full hour) and after (of all others of that hour)."""
    long = lambda c: c.cast("long")

    def at_hour(start: Column, h: Column) -> Column:
        # a block may still hold an event at its very end, a full hour; what follows opens the next
        return F.when(~h["full"] | (h["hour"] - start <= SPAN), start).otherwise(h["hour"])

    def after(at: Column, h: Column) -> Column:
        return F.when(~h["inner"] | (h["hour"] - at < SPAN), at).otherwise(h["hour"])

    size = CHUNK_HOURS * T.HOUR_MS
    hour = F.struct("hour", (F.col("first") == F.col("hour")).alias("full"), F.col("inner").isNotNull().alias("inner"))
    chunks = hours.groupBy(*keys, long(F.floor(F.col("hour") / size)).alias("_c")).agg(F.array_sort(F.collect_list(hour)).alias("hs"))
    ways = F.sequence(F.lit(0), F.lit(SPAN // T.HOUR_MS))
    entered = lambda k: F.when(k > 0, F.col("_c") * size - k * T.HOUR_MS)
    exits = F.transform(ways, lambda k: F.aggregate("hs", long(entered(k)), lambda s, h: after(at_hour(s, h), h)))
    lists = chunks.withColumn("exits", exits).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_c", "exits", "hs"))).alias("cs"))

    def through(acc: Column, c: Column) -> Column:
        back = (c["_c"] * size - acc["start"]) / T.HOUR_MS
        way = F.when(back <= SPAN // T.HOUR_MS, back).otherwise(0).cast("int")
        return F.struct(F.get(c["exits"], F.coalesce(way, F.lit(0))).alias("start"), F.concat(acc["out"], F.array(acc["start"])).alias("out"))

    def step(acc: Column, h: Column) -> Column:
        at = at_hour(acc["start"], h)
        end = after(at, h)
        return F.struct(end.alias("start"), F.concat(acc["out"], F.array(F.struct(h["hour"].alias("hour"), at.alias("at_hour"), end.alias("after")))).alias("out"))

    begun = lists.withColumn("starts", F.aggregate("cs", F.from_json(F.lit('{"out":[]}'), "struct<start:bigint,out:array<bigint>>"), through)["out"])
    parts = begun.select(*keys, F.inline(F.transform("cs", lambda c, i: F.struct(c["hs"].alias("hs"), F.get("starts", i).alias("start")))))
    none = F.from_json(F.lit("[]"), "array<struct<hour:bigint,at_hour:bigint,after:bigint>>")
    return parts.select(*keys, F.inline(F.aggregate("hs", F.struct("start", none.alias("out")), step)["out"]))


def block_starts(events: DataFrame, keys: list[str]) -> DataFrame:
    """events (with ms) and block, the start of their heuristic block."""
    walk = walked(hours_of(events, keys), keys)
    events = events.withColumn("hour", T.floor_hour(F.col("ms")))
    found = events.join(walk, [*keys, "hour"])
    return found.withColumn("block", F.when(F.col("ms") == F.col("hour"), F.col("at_hour")).otherwise(F.col("after"))).drop("hour", "at_hour", "after")


def blocks(events: DataFrame, keys: list[str] | None = None, samples: DataFrame | None = None, now: int | None = None, models: list[str] | None = None, machines: list[str] | None = None, with_models: bool = False) -> DataFrame:
    """One row a block of each key: start, end (ms), source, first and last instants, sums of the events that match
    models and machines (n_events, TOKENS, cost), sums of all events (all_tokens, all_io, all_cost), with with_models the
    models of all events, sorted, and, with now, active."""
    keys = keys or []
    events = timed(events)
    if samples is not None:
        windows = resolved_windows(samples, events)
        placed = in_window(events, windows)
        rest = block_starts(placed.filter("w_start IS NULL").drop("w_start", "w_end", "w_source"), keys)
        rest = rest.withColumns({"start": F.col("block"), "end": F.col("block") + SPAN, "source": F.lit("heuristic")}).drop("block")
        real = placed.filter("w_start IS NOT NULL").withColumnsRenamed({"w_start": "start", "w_end": "end", "w_source": "source"})
        events = real.unionByName(rest)
    else:
        events = block_starts(events, keys)
        events = events.withColumns({"start": F.col("block"), "end": F.col("block") + SPAN, "source": F.lit("heuristic")}).drop("block")
    match = any_model(models or []) & member("machine_id", machines or [])
    out = events.groupBy(*keys, "start", "end", "source").agg(
        F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count_if(match).alias("n_events"),
        *(F.coalesce(F.sum(F.when(match, F.col(c))), F.lit(0)).alias(c) for c in [*TOKENS, "cost"]),
        F.sum(total()).alias("all_tokens"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("all_io"), F.sum("cost").alias("all_cost"),
        *([F.array_sort(F.collect_set("model")).alias("models")] if with_models else []),
    )
    if now is None:
        return out
    per = Window.partitionBy(*keys)
    live_real = F.max(((F.col("source") != "heuristic") & (F.lit(now) < F.col("end"))).cast("int")).over(per)
    can = F.when(F.col("source") != "heuristic", F.lit(now) < F.col("end")).otherwise((live_real == 0) & (now - F.col("last_ms") < SPAN) & (F.lit(now) < F.col("end")))
    out = out.withColumn("_can", can)
    best = F.row_number().over(per.orderBy(F.col("_can").desc(), F.col("end").desc(), "start"))
    return out.withColumn("active", F.col("_can") & (best == 1)).drop("_can")


def gaps(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Gap rows (keys, start, end) between neighbouring blocks whose events are over five hours apart."""
    over = Window.partitionBy(*(keys or [])).orderBy("start")
    prev = F.lag("last_ms").over(over)
    return found.withColumn("_prev", prev).filter(F.col("first_ms") - F.col("_prev") > SPAN).select(*(keys or []), (F.col("_prev") + SPAN).alias("start"), F.col("first_ms").alias("end"))


def with_rates(found: DataFrame, now: int) -> DataFrame:
    """Burn rate over the minutes between first and last event, and what it comes to by the block's end; null where
    those are none, or the block isn't active (all are, if the column is missing)."""
    minutes = (F.col("last_ms") - F.col("first_ms")) / 60_000
    ok = (minutes > 0) & (F.col("active") if "active" in found.columns else F.lit(True))
    left = F.greatest(F.lit(0.0), (F.col("end") - now) / 60_000)
    found = found.withColumns({"tokens_per_minute": F.when(ok, F.col("all_tokens") / minutes), "io_per_minute": F.when(ok, F.col("all_io") / minutes), "cost_per_hour": F.when(ok, F.col("all_cost") / minutes * 60)})
    return found.withColumns({
        "projected_tokens": F.when(ok, T.half_up(F.col("all_tokens") + F.col("tokens_per_minute") * left)), "remaining_minutes": F.when(ok, T.half_up(left)),
        "projected_cost": F.when(ok, T.half_up((F.col("all_cost") + F.col("cost_per_hour") / 60 * left) * 100) / 100),
    })


def with_limit(found: DataFrame, samples: DataFrame) -> DataFrame:
    """limit_pct: of the active real block the latest utilisation, of finished real ones the peak; else null."""
    real = found.filter("source != 'heuristic'").select("start", "end").distinct()
    peaks = window_peaks(real, samples)
    latest = samples.agg(F.max(F.struct("captured_at", "util"))["util"].alias("_latest"))  # one row
    out = found.join(peaks, ["start", "end"], "left").crossJoin(F.broadcast(latest))
    pct = F.when(F.col("source") == "heuristic", None).when(F.col("active"), F.col("_latest")).otherwise(F.col("peak"))
    return out.withColumn("limit_pct", pct).drop("peak", "_latest")


def active_frame(found: DataFrame, keys: list[str] | None = None, windows: DataFrame | None = None) -> DataFrame:
    """Of each key the active block (start, end) and the block before it (prev_start, prev_end, null if there is none):
    what an intraday frame of the running block compares. found: blocks with active. With windows (start, end, source), also
    exclusions and prev_exclusions: the real windows that overlap a heuristic block, whose events are none of the block's."""
    keys = keys or []
    over = Window.partitionBy(*keys).orderBy("start")
    before = {"prev_start": F.lag("start").over(over), "prev_end": F.lag("end").over(over), "prev_source": F.lag("source").over(over)}
    out = found.withColumns(before).filter("active").select(*keys, "start", "end", "source", *before)
    if windows is None:
        return out.drop("prev_source")
    hours = lambda a, b: F.explode(F.sequence(T.floor_hour(a), T.floor_hour(b - 1), F.lit(T.HOUR_MS)))
    w = windows.select(F.col("start").alias("_s"), F.col("end").alias("_e")).withColumn("_h", hours(F.col("_s"), F.col("_e")))
    for source, a, b, name in (("source", "start", "end", "exclusions"), ("prev_source", "prev_start", "prev_end", "prev_exclusions")):
        own = out.filter((F.col(source) == "heuristic") & F.col(a).isNotNull()).select(*keys, a, b).withColumn("_h", hours(F.col(a), F.col(b)))
        met = own.join(w, "_h").filter((F.col("_s") < F.col(b)) & (F.col("_e") > F.col(a))).groupBy(*keys, a).agg(F.array_sort(F.collect_set(F.struct(F.col("_s").alias("start"), F.col("_e").alias("end")))).alias(name))
        out = out.join(met, [*keys, a], "left").withColumn(name, F.coalesce(name, F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint>>")))
    return out.drop("prev_source")


def starting_within(found: DataFrame, tz: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Blocks or gaps whose start's local date (YYYY-MM-DD) is within the bounds."""
    day = T.local_date(T.from_ms(F.col("start")), tz)
    found = found.filter(day >= since) if since else found
    return found.filter(day <= until) if until else found


def summary(found: DataFrame) -> DataFrame:
    """Count, sums and the exact median of all tokens over finished blocks (0 if there is none); where blocks have models,
    their union too."""
    done = F.when(~F.col("active"), F.col("all_tokens")) if "active" in found.columns else F.col("all_tokens")
    more = [F.array_sort(F.array_distinct(F.flatten(F.collect_set("models")))).alias("models")] if "models" in found.columns else []
    return found.agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("all_tokens").alias("all_tokens"), F.sum("all_cost").alias("all_cost"), F.coalesce(F.median(done), F.lit(0.0)).alias("typical_tokens"), *more)
