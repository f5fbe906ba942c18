"""The event table: replacement dedup, filters, set operations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timefns as T
from ..functions.paths import MARKER

TOKENS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"]
KEY = ["message_id", "request_id"]


def total(prefix: str = "") -> Column:
    return sum((F.col(prefix + c) for c in TOKENS[1:]), F.col(prefix + TOKENS[0]))


def deduplicated(events: DataFrame) -> DataFrame:
    """One row for each (message_id, request_id), nulls being a key of their own: the one with the most tokens, the
    first seen of equals; it takes the rank (ord) of the first seen. One shuffle, on the key."""
    over = Window.partitionBy(*KEY)
    ranked = events.withColumn("_rn", F.row_number().over(over.orderBy(total().desc(), "ord"))).withColumn("_ord", F.min("ord").over(over))
    return ranked.filter("_rn = 1").withColumn("ord", F.col("_ord")).drop("_rn", "_ord")


def last_of_batch(events: DataFrame) -> DataFrame:
    """Of a batch the last row of each key."""
    over = Window.partitionBy(*KEY).orderBy(F.col("ord").desc())
    return events.withColumn("_rn", F.row_number().over(over)).filter("_rn = 1").drop("_rn")


def united(*feeds: DataFrame) -> DataFrame:
    """Several feeds of events as one deduplicated table; earlier feeds rank first."""
    out = None
    for i, feed in enumerate(feeds):
        feed = feed.withColumn("ord", F.struct(F.lit(i).alias("feed"), F.col("ord").alias("at")))
        out = feed if out is None else out.unionByName(feed, allowMissingColumns=True)
    return deduplicated(out)


def unseen(events: DataFrame, held: DataFrame) -> DataFrame:
    """events of which held has no row of the key with as many tokens."""
    held = held.groupBy(*KEY).agg(F.max(total()).alias("_held")).select(*(F.col(k).alias(f"_{k}") for k in KEY), "_held")
    on = [events[k].eqNullSafe(held[f"_{k}"]) for k in KEY]
    return events.join(held, on, "left").filter(F.coalesce("_held", F.lit(-1)) < total()).drop("_held", *(f"_{k}" for k in KEY))


@dataclass(frozen=True)
class Query:
    """What a report is asked for. Dates are YYYYMMDD of the local calendar, inclusive; empty lists don't filter."""

    since: str | None = None
    until: str | None = None
    tz: str = "UTC"
    projects: list[str] = field(default_factory=list)
    sessions: list[str] = field(default_factory=list)
    models: list[str] = field(default_factory=list)
    machines: list[str] = field(default_factory=list)

    def predicate(self) -> Column:
        """The axes, ANDed."""
        out = F.lit(True)
        if self.projects:
            slug = F.col("project_slug")
            out &= slug.isin(self.projects)
            for p in self.projects:
                out |= slug.startswith(p + MARKER)
        return out & any_model(self.models) & member("session_id", self.sessions) & member("machine_id", self.machines)

    def apply(self, events: DataFrame) -> DataFrame:
        """Events that match; those without a readable timestamp only where no date bounds are given."""
        out = events.filter(self.predicate())
        day = T.local_ymd(F.col("ts"), self.tz)
        if self.since:
            out = out.filter(F.col("ts") >= F.date_sub(F.to_date(F.lit(self.since), "yyyyMMdd"), 1).cast("timestamp")).filter(day >= self.since)
        if self.until:
            out = out.filter(F.col("ts") < F.date_add(F.to_date(F.lit(self.until), "yyyyMMdd"), 2).cast("timestamp")).filter(day <= self.until)
        return out


def member(column: str, values: list[str]) -> Column:
    return F.col(column).isin(values) if values else F.lit(True)


def any_model(needles: list[str], column: str = "model") -> Column:
    """Any of the needles is in the model's name, whatever the case."""
    if not needles:
        return F.lit(True)
    out = F.lit(False)
    for n in needles:
        out |= F.lower(column).contains(n.lower())
    return out


def searched(rows: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows where any column contains the trimmed, lower-cased needle; all rows for an empty one."""
    n = needle.strip().lower()
    return rows.filter(F.exists(F.array(*(F.coalesce(F.lower(c), F.lit("")) for c in columns)), lambda x: x.contains(n))) if n else rows


def tree_filtered(parents: DataFrame, children: DataFrame, key: str, needle: str, columns: list[str]) -> DataFrame:
    """Parents that match or have a child that does, with by_child where only a child does."""
    hits = searched(children, needle, columns).select(key).distinct().withColumn("_child", F.lit(True))
    own = searched(parents, needle, columns).select(key).distinct().withColumn("_own", F.lit(True))
    both = parents.join(hits, key, "left").join(own, key, "left").filter("_child OR _own")
    return both.withColumn("by_child", F.col("_own").isNull()).drop("_child", "_own")
