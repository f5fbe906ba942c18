"""Grouped reports over priced events: days, projects, machines, sessions, with what models each row used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import timefns as T
from .events import TOKENS

SUMS = [*TOKENS, "cost", "cost_input", "cost_output", "cost_cache"]


def dated(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """events with their local date; those without a readable timestamp go."""
    return events.filter(F.col("ts").isNotNull()).withColumn("date", T.local_date(F.col("ts"), tz))


def rank() -> Column:
    """Order of events: the raw timestamp text, then the insertion rank."""
    return F.struct("timestamp", "ord")


def rollup(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_events, sums of SUMS, models (first seen first) and breakdown: per model in that order. Two levels of
    hash aggregation: (keys, model), then keys, so that a hot key is a row for each model before it meets."""
    per_model = events.groupBy(*keys, "model").agg(*(F.sum(c).alias(c) for c in SUMS), F.count(F.lit(1)).alias("n_events"), F.min(rank()).alias("first"))
    row = F.struct("first", "model", *SUMS)
    out = per_model.groupBy(*keys).agg(F.sum("n_events").alias("n_events"), *(F.sum(c).alias(c) for c in SUMS), F.array_sort(F.collect_list(row)).alias("_m"))
    out = out.withColumn("models", F.transform("_m", lambda m: m["model"]))
    return out.withColumn("breakdown", F.transform("_m", lambda m: F.struct(m["model"].alias("model"), *(m[c].alias(c) for c in SUMS)))).drop("_m")


def daily(events: DataFrame, tz: str = "UTC") -> DataFrame:
    return rollup(dated(events, tz), ["date"])


def totals(report: DataFrame) -> DataFrame:
    """One row: the sums over a report."""
    return report.agg(F.sum("n_events").alias("n_events"), *(F.sum(c).alias(c) for c in SUMS))


def daily_by_project(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """Days of each project, with the project's path, which events without a date also tell."""
    report = rollup(dated(events, tz), ["project_slug", "date"])
    return report.join(project_paths(events), "project_slug", "left") if "cwd" in events.columns else report


def daily_by_machine(events: DataFrame, tz: str = "UTC", by_project: bool = False) -> DataFrame:
    return rollup(dated(events, tz), ["machine_id", "project_slug", "date"] if by_project else ["machine_id", "date"])


def project_paths(events: DataFrame) -> DataFrame:
    """The path of each slug: the first working directory that encodes to it, else the first one, else the slug decoded."""
    cwd, slug = F.col("cwd"), F.col("project_slug")
    exact = F.min(F.when(paths.slug_of(cwd) == slug, F.struct("timestamp", "ord", "cwd")))
    any_one = F.min(F.when(cwd != "", F.struct("timestamp", "ord", "cwd")))
    found = events.groupBy("project_slug").agg(exact.alias("e"), any_one.alias("a"))
    return found.select("project_slug", F.coalesce("e.cwd", "a.cwd", paths.path_of(slug)).alias("path"))


def sessions(events: DataFrame, tz: str = "UTC", since: str | None = None, until: str | None = None) -> DataFrame:
    """One row a session id, over all its events; bounds (YYYY-MM-DD) are on its last active day. The slug is that of
    its first event, the machine that of its last."""
    events = dated(events, tz)
    report = rollup(events, ["session_id"])
    more = events.groupBy("session_id").agg(
        F.min(F.struct("timestamp", "ord", "project_slug"))["project_slug"].alias("project_slug"), F.max(F.struct("timestamp", "ord", "machine_id"))["machine_id"].alias("machine_id"),
        F.max("date").alias("last_activity"),
    )
    out = report.join(more, "session_id")
    for bound, ok in ((since, F.col("last_activity") >= since), (until, F.col("last_activity") <= until)):
        out = out.filter(ok) if bound else out
    return out


def locale(column: str) -> list[Column]:
    """The order of names as people expect it (the root locale: case matters last, signs weigh as they are), and of equal ones
    by their bytes."""
    return [F.collate(column, "UNICODE"), F.col(column)]


def session_order() -> list[Column]:
    return [F.col("cost").desc(), *locale("project_slug"), *locale("session_id")]


def projects(events: DataFrame, tz: str = "UTC", since: str | None = None, until: str | None = None) -> DataFrame:
    """One row a project that is active in the window: sums, sessions and machines within it, first activity of all time."""
    events = dated(events, tz)
    inside = F.lit(True)
    inside = inside & (F.col("date") >= since) if since else inside
    inside = inside & (F.col("date") <= until) if until else inside
    when = lambda c: F.when(inside, F.col(c))
    out = events.groupBy("project_slug").agg(
        F.min("date").alias("first_activity"), F.max(when("date")).alias("last_activity"), F.min(when("date")).alias("first_in_window"),
        F.count_if(inside).alias("n_events"), F.count_distinct(when("session_id")).alias("n_sessions"), F.count_distinct(when("machine_id")).alias("n_machines"),
        *(F.coalesce(F.sum(when(c)), F.lit(0)).alias(c) for c in SUMS),
    )
    return out.filter("n_events > 0")


def session_events(events: DataFrame, session_id: str) -> tuple[DataFrame, DataFrame]:
    """(summary, events in order) of one session."""
    own = events.filter(F.col("session_id") == session_id)
    return rollup(own, ["session_id"]), own.orderBy("timestamp", "ord")


def merged_breakdowns(report: DataFrame) -> DataFrame:
    """All rows' breakdowns by model, dearest first."""
    return report.select(F.explode("breakdown").alias("b")).groupBy("b.model").agg(*(F.sum(f"b.{c}").alias(c) for c in SUMS)).orderBy(F.col("cost").desc(), "model")


def merged_rows(*reports: DataFrame, key: str = "date") -> DataFrame:
    """Several daily reports added by date; models of earlier reports first."""
    cols = [key, "n_events", *SUMS]
    flat = None
    for i, r in enumerate(reports):
        own = r.select(*cols, F.struct(F.lit(i).alias("i"), F.col("models").alias("models")).alias("m"))
        flat = own if flat is None else flat.unionByName(own)
    out = flat.groupBy(key).agg(*(F.sum(c).alias(c) for c in cols[1:]), F.array_sort(F.collect_list("m")).alias("m"))
    return out.withColumn("models", F.array_distinct(F.flatten(F.transform("m", lambda x: x["models"])))).drop("m")


def densified(report: DataFrame, first: str, last: str) -> DataFrame:
    """A row for every day from first to last, zeros where there is none."""
    days = report.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("date"))
    return days.join(report, "date", "left").na.fill(0, ["n_events", *SUMS])


def top_and_other(events: DataFrame, key: str = "project_slug", metric: str = "cost", n: int = 5, other: str = "__other__") -> DataFrame:
    """Sums of the n largest keys by metric (ties by key), the rest folded into one row."""
    report = events.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"), *(F.sum(c).alias(c) for c in SUMS))
    best = report.orderBy(F.col(metric).desc(), key).limit(n).select(key).withColumn("_top", F.lit(True))
    named = report.join(F.broadcast(best), key, "left").withColumn(key, F.when(F.col("_top"), F.col(key)).otherwise(other)).drop("_top")
    return named.groupBy(key).agg(F.sum("n_events").alias("n_events"), *(F.sum(c).alias(c) for c in SUMS))


# --- summaries ---------------------------------------------------------------------------------------------------


def session_summary(report: DataFrame) -> DataFrame:
    """Count, sums, mean cost and cache-hit share of a session report."""
    reads, feeds = F.sum("cache_read_tokens"), F.sum(F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens"))
    return report.agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("cost").alias("cost"), F.avg("cost").alias("avg_cost"), F.when(feeds > 0, 100 * reads / feeds).otherwise(0.0).alias("cache_hit_pct"))


def project_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("n_projects"), F.sum("cost").alias("cost"), F.sum("n_sessions").alias("n_sessions"))


def by_family(events: DataFrame, metric: str = "cost") -> DataFrame:
    """Families with a positive sum, and their share of the whole in percent."""
    from ..functions.pricing import family

    per = events.groupBy(family(F.col("model")).alias("family")).agg(F.sum(metric).alias("value"))
    return per.withColumn("pct", 100 * F.col("value") / F.sum("value").over(Window.partitionBy())).filter("value > 0")


def top_family(events: DataFrame, keys: list[str]) -> DataFrame:
    """The dearest family of each key; null if nothing has a cost."""
    from ..functions.pricing import family

    per = events.groupBy(*keys, family(F.col("model")).alias("family")).agg(F.sum("cost").alias("cost"))
    return per.groupBy(*keys).agg(F.max(F.when(F.col("cost") > 0, F.struct("cost", "family")))["family"].alias("top_family"))


def shares(report: DataFrame, value: str = "cost") -> DataFrame:
    """report with share, each row's part of the sum over these rows in whole percent (.5 up), null where that is 0."""
    whole = F.broadcast(report.agg(F.sum(value).alias("_whole")))  # one row
    return report.crossJoin(whole).withColumn("share", F.when(F.col("_whole") > 0, T.half_up(100 * F.col(value) / F.col("_whole")))).drop("_whole")


def series_summary(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Total, largest and mean value of each series; null for one without values."""
    return rows.groupBy(*keys).agg(F.sum(value).alias("total"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def bar_scaled(report: DataFrame, value: str = "cost") -> DataFrame:
    """report with bar, each value's part of the largest one in these rows, 0 at least."""
    most = F.broadcast(report.agg(F.greatest(F.max(value), F.lit(0.0)).alias("_most")))  # one row
    return report.crossJoin(most).withColumn("bar", F.when(F.col("_most") > 0, F.greatest(F.col(value), F.lit(0.0)) / F.col("_most")).otherwise(0.0)).drop("_most")


def token_bands(report: DataFrame) -> DataFrame:
    """Each row's tokens by band, long: key columns, band, value."""
    keys = [c for c in report.columns if c not in (*SUMS, "n_events", "models", "breakdown")]
    return report.unpivot(keys, TOKENS, "band", "value")


def family_bands(report: DataFrame) -> DataFrame:
    """A report's breakdowns by model family: key columns, family, tokens, cost, TOKENS, and the cost of output, of the cache,
    and of input as what is left of the cost, 0 at least."""
    keys = [c for c in report.columns if c not in (*SUMS, "n_events", "models", "breakdown")]
    from ..functions.pricing import family

    rows = report.select(*keys, F.inline("breakdown"))
    rest = F.greatest(F.lit(0.0), F.col("cost") - F.col("cost_output") - F.col("cost_cache"))
    sums = rows.groupBy(*keys, family(F.col("model")).alias("family")).agg(*(F.sum(c).alias(c) for c in (*TOKENS, "cost", "cost_output", "cost_cache")), F.sum(rest).alias("cost_input"))
    return sums.withColumn("tokens", sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0])))


def corpus_extent(events: DataFrame, tz: str, today: str) -> DataFrame:
    """First day, and the last one or today if that is later; null for no events."""
    return dated(events, tz).agg(F.min("date").alias("first"), F.max("date").alias("last")).select("first", F.when(F.col("first").isNotNull(), F.greatest("last", F.lit(today))).alias("last"))


def deltas(now: DataFrame, before: DataFrame, on: str, value: str = "cost") -> DataFrame:
    """now and before by key, their difference and percentage (null where before is 0)."""
    a, b = now.select(on, F.col(value).alias("now")), before.select(on, F.col(value).alias("before"))
    both = a.join(b, on, "left").na.fill(0.0, ["before"])
    return both.withColumn("delta", F.col("now") - F.col("before")).withColumn("pct", 100 * F.col("delta") / F.nullif("before", F.lit(0.0)))
