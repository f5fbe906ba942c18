"""Composed series: a cross product of axes over labels, running and moving figures, peaks and scales."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import parent_slug
from ..functions.pricing import FAMILIES, family
from ..functions.timefns import half_up
from .events import TOKENS

AXES = ("machine", "model", "project", "tokenType")


def normalised(axes: list[str]) -> list[str]:
    """Known axes, once each, in their fixed order."""
    return [a for a in AXES if a in axes]


def series(events: DataFrame, axes: list[str], labels: DataFrame, label: str = "date", metric: str = "tokens") -> DataFrame:
    """One row for every series (a combination of axis values that occur) and label: value, 0 where nothing is. The
    Unknown model family is in no series. metric: tokens or cost; the token axis always counts tokens."""
    axes = normalised(axes)
    keys = {"machine": F.col("machine_id"), "model": family(F.col("model")), "project": F.col("project_slug")}
    named = [keys[a].alias(a) for a in axes if a != "tokenType"]
    if "tokenType" in axes:
        long = events.select(label, *named, *TOKENS).unpivot([label, *(a for a in axes if a != "tokenType")], TOKENS, "tokenType", "value")
    else:
        long = events.select(label, *named, (F.col("cost") if metric == "cost" else sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0]))).alias("value"))
    if "model" in axes:
        long = long.filter(F.col("model") != "Unknown")
    cube = long.groupBy(label, *axes).agg(F.sum("value").alias("value"))
    grid = labels.select(label)
    for a in axes:  # the dense series are the product of labels and axis values, by definition
        grid = grid.crossJoin(cube.select(a).distinct())
    return grid.join(cube, [label, *axes], "left").na.fill(0, ["value"])


#: Name of the series of what isn't among the first projects.
OTHER = "__other__"


def top_count(axes: list[str]) -> int:
    """Projects that have a series of their own."""
    return 3 if len(normalised(axes)) > 1 else 5


@dataclass(frozen=True)
class Source:
    """Where a chart's days come from: the window now and the one before it (first and last local date, inclusive, YYYY-MM-DD),
    maps of projects to groups (project_slug, group_key) and of machines to their targets (machine_id, target), both
    optional, and the values of axes to keep."""

    now: tuple[str, str]
    before: tuple[str, str] | None = None
    groups: DataFrame | None = None
    machines: DataFrame | None = None
    kept: dict[str, list[str]] = field(default_factory=dict)

    def labels(self) -> tuple[list[str], list[str] | None]:
        """The days of both windows; the one before only where it is as long."""
        days = lambda w: [(dt.date.fromisoformat(w[0]) + dt.timedelta(i)).isoformat() for i in range((dt.date.fromisoformat(w[1]) - dt.date.fromisoformat(w[0])).days + 1)]
        now, before = days(self.now), days(self.before) if self.before else None
        return now, before if before and len(before) == len(now) else None

    def framed(self, events: DataFrame) -> DataFrame:
        """events (with date) of both windows: frame, idx, and machine, model, project folded as the maps say. Worktrees are in
        their repository before anything is ranked."""
        now, before = self.labels()
        day = lambda first: F.datediff(F.to_date("date"), F.lit(first).cast("date"))
        inside = lambda days: F.col("date").between(days[0], days[-1])
        frame = F.when(inside(now), "current")
        idx = day(now[0])
        if before:
            frame, idx = frame.when(inside(before), "previous"), F.when(inside(now), idx).otherwise(day(before[0]))
        rows = events.withColumns({"frame": frame, "idx": idx, "project": parent_slug(F.col("project_slug")), "model": family(F.col("model"))}).filter("frame IS NOT NULL")
        if self.groups is not None:
            rows = rows.join(self.groups.select(F.col("project_slug").alias("project"), "group_key"), "project", "left").withColumn("project", F.coalesce("group_key", "project")).drop("group_key")
        if self.machines is not None:
            rows = rows.join(self.machines.select("machine_id", "target"), "machine_id", "left").withColumn("machine_id", F.coalesce("target", "machine_id")).drop("target")
        return rows.withColumn("machine", F.col("machine_id"))


def amount(metric: str) -> Column:
    return F.col("cost") if metric == "cost" else sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0]))


def ranked_projects(rows: DataFrame, n: int, metric: str) -> DataFrame:
    """Of framed rows project, total (of the current frame) and place, from 1, of the first n + 1 projects; the last of these
    only tells that there are others. Ties go by name in locale order."""
    per = rows.groupBy("project").agg(F.coalesce(F.sum(F.when(F.col("frame") == "current", amount(metric))), F.lit(0)).alias("total"))
    best = per.orderBy(F.col("total").desc(), F.collate("project", "UNICODE"), "project").limit(n + 1)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("total").desc(), F.collate("project", "UNICODE"), "project")))  # n + 1 rows


def assembled(events: DataFrame, source: Source, axes: list[str], metric: str = "tokens") -> DataFrame:
    """events (with date) -> a row for each series and day of the window: idx, label, the axes, value, and as ghosts
    prev_label and prev_value of the day with the same number in the window before (null where there is no such window).

    What a chart can show is cut before series are laid out, so the dense grid is bounded by the selection: the first projects
    by the current window's total and one series for all others, the known model families, the four kinds of tokens, and the
    machines that are in either window; of each, what source.kept names. metric: tokens or cost; token kinds count tokens."""
    axes = normalised(axes)
    rows = source.framed(events)
    if "project" in axes:
        n = top_count(axes)
        top = F.broadcast(ranked_projects(rows, n, metric))  # n + 1 rows
        rows = rows.join(top.filter(F.col("place") <= n).select("project", F.lit(True).alias("_top")), "project", "left").withColumn("project", F.when(F.col("_top"), F.col("project")).otherwise(OTHER)).drop("_top")
    if "model" in axes:
        rows = rows.filter(F.col("model") != "Unknown")
    plain = [a for a in axes if a != "tokenType"]
    if "tokenType" in axes:
        rows = rows.select("frame", "idx", *plain, *TOKENS).unpivot(["frame", "idx", *plain], TOKENS, "tokenType", "_v")
    else:
        rows = rows.withColumn("_v", amount(metric))
    for axis, values in source.kept.items():
        rows = rows.filter(F.col(axis).isin(values)) if axis in axes else rows
    value = lambda frame: F.sum(F.when(F.col("frame") == frame, F.col("_v")))
    cube = rows.groupBy("idx", *axes).agg(value("current").alias("value"), value("previous").alias("prev_value"))
    now, before = source.labels()
    spark = events.sparkSession
    grid = spark.createDataFrame([(i, x, before[i] if before else None) for i, x in enumerate(now)], "idx int, label string, prev_label string")
    fixed = {"model": [x.capitalize() for x in FAMILIES], "tokenType": TOKENS}
    for a in axes:
        if a in fixed:
            grid = grid.withColumn(a, F.explode(F.array(*(F.lit(x) for x in fixed[a] if x in source.kept.get(a, fixed[a])))))
        elif a == "project":
            shown = top.select(F.when(F.col("place") <= n, F.col("project")).otherwise(OTHER).alias(a))
            grid = grid.crossJoin(F.broadcast(shown.filter(F.col(a).isin(source.kept[a])) if a in source.kept else shown))  # n + 1 rows
        else:
            grid = grid.crossJoin(cube.select(a).distinct())  # by definition: days times machines
    out = grid.join(cube, ["idx", *axes], "left").na.fill(0, ["value", "prev_value"])
    return out if before else out.withColumn("prev_value", F.lit(None).cast(out.schema["prev_value"].dataType))


def chart_totals(events: DataFrame, source: Source, metric: str = "tokens") -> DataFrame:
    """A row for each day of the window: idx, label, total and prev_total over all events, whatever family, delta, pct (null
    where there was nothing before) and cache_pct, the part of tokens that were written to or read from the cache (in whole
    percent, .5 up; null without tokens)."""
    rows = source.framed(events)
    frame = lambda name, c: F.coalesce(F.sum(F.when(F.col("frame") == name, c)), F.lit(0))
    cache = F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    sums = rows.groupBy("idx").agg(frame("current", amount(metric)).alias("total"), frame("previous", amount(metric)).alias("prev_total"), frame("current", cache).alias("_c"), frame("current", amount("tokens")).alias("_t"))
    now, before = source.labels()
    days = events.sparkSession.createDataFrame([(i, x) for i, x in enumerate(now)], "idx int, label string")
    out = days.join(sums, "idx", "left").na.fill(0)
    out = out.withColumn("delta", F.col("total") - F.col("prev_total")).withColumn("pct", 100 * F.col("delta") / F.nullif("prev_total", F.lit(0)))
    out = out.withColumn("cache_pct", F.when(F.col("_t") > 0, half_up(100 * F.col("_c") / F.col("_t")))).drop("_c", "_t")
    return out if before else out.withColumns({c: F.lit(None).cast(out.schema[c].dataType) for c in ("prev_total", "delta", "pct")})


def muted(rows: DataFrame, total: DataFrame, part: str, values: list[str], label: str = "date") -> tuple[DataFrame, DataFrame]:
    """Series without the muted ones, and totals (label, value) less what they had, 0 at least."""
    gone = rows.filter(F.col(part).isin(values)).groupBy(label).agg(F.sum("value").alias("_gone"))
    left = total.join(gone, label, "left").withColumn("value", F.greatest(F.lit(0), F.col("value") - F.coalesce("_gone", F.lit(0)))).drop("_gone")
    return rows.filter(~F.col(part).isin(values)), left


def cumulative(rows: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    over = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cumulative", F.sum(value).over(over))


def moving_average(rows: DataFrame, keys: list[str], order: str, width: int, value: str = "value") -> DataFrame:
    """Trailing mean over width rows, fewer at the start."""
    over = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(max(1, width) - 1), 0)
    return rows.withColumn("moving_avg", F.avg(value).over(over))


def trend_width(n: int) -> int:
    return max(3, min(n, math.floor(n / 3 + 0.5)))


def peaks(rows: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """The first largest positive row of each series."""
    over = Window.partitionBy(*keys).orderBy(F.col(value).desc(), order)
    return rows.filter(F.col(value) > 0).withColumn("_rn", F.row_number().over(over)).filter("_rn = 1").drop("_rn")


def linear_threshold(rows: DataFrame, value: str = "value", decades: int = 6) -> DataFrame:
    """One row: where a symmetric log scale turns linear, at most so many decades under the peak."""
    low, high = F.floor(F.log10(F.min(F.when(F.col(value) > 0, F.col(value))))), F.floor(F.log10(F.max(value)))
    return rows.agg(F.pow(F.lit(10.0), F.greatest(low, high - decades)).alias("threshold"))


def symlog(x: Column, threshold: float) -> Column:
    return F.signum(x) * F.when(F.abs(x) <= threshold, F.abs(x) / threshold).otherwise(1 + F.log10(F.abs(x) / threshold))


def symlog_inverse(y: Column, threshold: float) -> Column:
    return F.signum(y) * F.when(F.abs(y) <= 1, F.abs(y) * threshold).otherwise(threshold * F.pow(F.lit(10.0), F.abs(y) - 1))


def sampled_labels(n: int, days: bool) -> list[int]:
    """Indices of the labels to show: every k-th and the last."""
    k = (1 if n <= 10 else -(-n // 7)) if days else max(1, -(-n // 6))
    return sorted({*range(0, n, k), *([n - 1] if n else [])})
