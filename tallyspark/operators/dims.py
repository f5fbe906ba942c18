"""Machines, project identities and merge assertions. Facts join them as Spark sees fit: by broadcast while they are small; nodes
of chains join each other by shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.shared import stored


def sorted_in(few: DataFrame) -> DataFrame:
    """A side of a join that is as large as the other one, or nearly: both are shuffled and sorted. By its size on disk Spark would
    broadcast it up to some million rows, in each of the rounds anew, and every broadcast passes through the driver."""
    return few.hint("merge")


def jumped(edges: DataFrame) -> DataFrame:
    """edges (node, to; one row a node) -> node, end, low, last: where a node's path leads after at least as many steps as
    there are nodes, a node without an edge being its own end, and the least node and newest edge (order) of those steps. Steps
    double: each round joins the table with itself, and is stored. Rounds are the logarithm of the longest path, or of the
    number of nodes where there is a cycle."""
    nodes = edges.select("node").unionByName(edges.select(F.col("to").alias("node"))).filter("node IS NOT NULL").distinct()
    own = F.coalesce("to", "node")
    at = stored(nodes.join(sorted_in(edges), "node", "left").select("node", own.alias("end"), F.least("node", own).alias("low"), F.col("order").alias("last")), "jumps")
    steps, n = 1, at.count()
    while steps < n:
        onward = at.select(F.col("node").alias("end"), F.col("end").alias("_end"), F.col("low").alias("_low"), F.col("last").alias("_last"))
        then = stored(at.join(sorted_in(onward), "end").select("node", F.col("_end").alias("end"), F.least("low", "_low").alias("low"), F.greatest("last", "_last").alias("last"), (F.col("_end") != F.col("end")).alias("_moved")), "jumps")
        steps *= 2
        at, still = then.drop("_moved"), then.filter("_moved").isEmpty()
        if still:
            break
    return at


def in_cycles(edges: DataFrame) -> DataFrame:
    """The nodes of edges (node, to, order) that lie on a cycle, with low, the cycle's least node, and last, its newest edge's
    order. A path that has gone on for as many steps as there are nodes is in a cycle or at its end, and every node of a cycle
    is where some path is then."""
    far = jumped(edges)
    met = far.select(F.col("end").alias("node")).distinct().join(sorted_in(edges.select("node")), "node", "left_semi")
    return far.join(sorted_in(met), "node").select("node", "low", "last")


def closed(edges: DataFrame) -> DataFrame:
    """edges (node, to) -> node, target for all nodes, those without an edge too: the end of each one's path. A node on a cycle
    is its own target, and one that leads to a cycle has the node where it gets there. No bound on nodes or lengths."""
    edges = stored(edges.select("node", "to").filter("to IS NOT NULL AND to != node").withColumn("order", F.struct(F.lit(0))), "edges")
    if edges.isEmpty():
        return edges.select("node", F.col("to").alias("target"))
    ring = in_cycles(edges).select("node", F.lit(True).alias("_ring"))
    cut = edges.join(sorted_in(ring), "node", "left").withColumn("to", F.when(F.col("_ring").isNull(), F.col("to"))).drop("_ring")
    return jumped(stored(cut, "edges")).select("node", F.col("end").alias("target"))


def alias_targets(machines: DataFrame) -> DataFrame:
    """machines (machine_id, merged_into) -> machine_id, target: the end of each alias chain; cycles end where they are
    entered, and an id that is no machine may be an end."""
    known = closed(machines.select(F.col("machine_id").alias("node"), F.col("merged_into").alias("to")))
    own = machines.select("machine_id").distinct()
    return own.join(sorted_in(known.withColumnRenamed("node", "machine_id")), "machine_id", "left").select("machine_id", F.coalesce("target", "machine_id").alias("target"))


def folded(rows: DataFrame, key: str, mapping: DataFrame, sums: list[str], others: list[str] = []) -> DataFrame:  # noqa: B006
    """rows summed by the target of their key; keys without one stand for themselves."""
    own = rows.join(mapping.withColumnsRenamed({mapping.columns[0]: key, mapping.columns[1]: "_to"}), key, "left")
    own = own.withColumn(key, F.coalesce("_to", key)).drop("_to")
    return own.groupBy(key, *others).agg(*(F.sum(c).alias(c) for c in sums))


def expanded(selected: list[str], mapping: DataFrame) -> list[str]:
    """The selection and every other key of the same targets, sorted."""
    key, to = mapping.columns
    hit = mapping.filter(F.col(key).isin(selected)).select(to).distinct()
    more = mapping.join(hit, to, "left_semi").select(key).collect()
    return sorted({*selected, *(r[0] for r in more)})


def newest_identity(rows: DataFrame) -> DataFrame:
    """identity rows (machine_id, project_slug, repo_id, probed_at) -> project_slug, group_key by the newest probe of
    each slug (ties: the smaller slug and machine); worktrees don't speak for their parent."""
    own = rows.filter(~paths.is_worktree(F.col("project_slug")))
    over = Window.partitionBy("project_slug").orderBy(F.col("probed_at").desc(), "machine_id")
    best = own.withColumn("_rn", F.row_number().over(over)).filter("_rn = 1")
    return best.select("project_slug", F.coalesce("repo_id", "project_slug").alias("group_key"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns."""
    over = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_rn", F.row_number().over(over)).filter("_rn = 1").drop("_rn")


def adopted(own: DataFrame, hub: DataFrame, author: str, me: str, keys: list[str], order: list[str]) -> DataFrame:
    """My rows, newest first over both sides, and the hub's for everybody else."""
    mine = own.filter(F.col(author) == me).unionByName(hub.filter(F.col(author) == me))
    return latest(mine, keys, order).unionByName(hub.filter(F.col(author) != me))


#: Order of merge assertions.
NEWER = ["updated_at", "author", "source"]


def resolved_merges(assertions: DataFrame, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """assertions (author, source, target or null, updated_at, and columns of any other kind) and groups (anchor, group_key,
    the automatic fold; anchors that it lacks are their own) -> entries, targets, representatives.

    entries: the assertion that counts of each source group, with source_key, target_key and status: the newest statement of
    each author and source, then of each source, then of each source group; 'unmerged' without a target, 'redundant' within a
    group, 'conflict' where it closes a cycle of older ones, else 'active'. As a group has one edge, a cycle's newest edge is
    the one that closes it. targets: group, target for each group that an active edge touches. representatives: of each target
    the newest active entry that names it directly, as target_key and that entry's columns."""
    newest = assertions
    for keys in (["author", "source"], ["source"]):
        newest = latest(newest, keys, NEWER)
    if groups is None:
        keyed = newest.withColumns({"source_key": F.col("source"), "target_key": F.col("target")})
    else:
        of = lambda c: groups.select(F.col("anchor").alias(c), F.col("group_key").alias(f"{c}_key"))
        keyed = newest.join(of("source"), "source", "left").join(of("target"), "target", "left")
        keyed = keyed.withColumns({f"{c}_key": F.coalesce(f"{c}_key", c) for c in ("source", "target")})
    keyed = stored(latest(keyed, ["source_key"], NEWER), "merges")
    edges = stored(keyed.filter("target_key IS NOT NULL AND target_key != source_key").select(F.col("source_key").alias("node"), F.col("target_key").alias("to"), F.struct(*NEWER).alias("order")), "edges")
    cycles = in_cycles(edges) if not edges.isEmpty() else edges.select("node", F.col("to").alias("low"), F.col("order").alias("last"))
    closing = cycles.select(F.col("node").alias("source_key"), F.col("last").alias("_last"))
    status = F.when(F.col("target_key").isNull(), "unmerged").when(F.col("target_key") == F.col("source_key"), "redundant").when(F.col("_last") == F.struct(*NEWER), "conflict").otherwise("active")
    entries = stored(keyed.join(closing, "source_key", "left").withColumn("status", status).drop("_last"), "merges")
    active = entries.filter("status = 'active'")
    targets = closed(active.select(F.col("source_key").alias("node"), F.col("target_key").alias("to"))).withColumnRenamed("node", "group")
    ends = targets.filter(F.col("group") == F.col("target")).select(F.col("group").alias("target_key"))
    return entries, targets, latest(active.join(ends, "target_key", "left_semi"), ["target_key"], NEWER)


def worktree_fold(report: DataFrame, sums: list[str], others: list[str] = [], groups: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """A project report with worktrees in their parents and, with groups (project_slug, group_key), projects in groups;
    keeps the smallest member slug and the number of members."""
    own = report.withColumn("_slug", paths.parent_slug(F.col("project_slug")))
    key = F.col("_slug")
    if groups is not None:
        own = own.join(groups.select(F.col("project_slug").alias("_slug"), "group_key"), "_slug", "left")
        key = F.coalesce("group_key", "_slug")
    return own.groupBy(key.alias("group"), *others).agg(F.min("_slug").alias("representative"), F.count_distinct("project_slug").alias("n_members"), *(F.sum(c).alias(c) for c in sums))


def machine_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("machine_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("timestamp").alias("last_event"))


def roster(machines: DataFrame, clients: DataFrame, events: DataFrame, pushes: DataFrame) -> DataFrame:
    """Every machine with its client, event counts and last push; live ones first, then by last seen and name."""
    out = machines.join(machine_stats(events), "machine_id", "left").join(clients, "machine_id", "left").join(pushes, "machine_id", "left")
    return out.orderBy(F.col("live").desc_nulls_last(), F.col("last_seen").desc_nulls_last(), "name")


def merge_candidates(catalog: DataFrame, anchor: str) -> DataFrame:
    """What a project may be merged into: catalog (anchor, identity, label, path) by anchor, without those of its own
    identity; best first by rank: 100 less the number of path parts that both end with, 10,000 if not even the last is
    the same; then by label."""
    over = Window.partitionBy("anchor").orderBy("label", "path")
    once = catalog.withColumn("_rn", F.row_number().over(over)).filter("_rn = 1").drop("_rn")
    own = once.filter(F.col("anchor") == anchor).select(F.col("identity").alias("_identity"), F.col("path").alias("_path"))  # one row
    both = once.filter(F.col("anchor") != anchor).crossJoin(F.broadcast(own)).filter("identity != _identity")
    parts = lambda c: F.reverse(F.filter(F.split(c, r"[/\\\\]"), lambda s: s != ""))
    same = F.aggregate(F.arrays_zip(parts(F.col("path")).alias("a"), parts(F.col("_path")).alias("b")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, x: F.struct((acc["n"] + (acc["on"] & F.coalesce(x["a"] == x["b"], F.lit(False))).cast("int")).alias("n"), (acc["on"] & F.coalesce(x["a"] == x["b"], F.lit(False))).alias("on")))["n"]
    return both.withColumn("rank", F.when(same == 0, 10_000).otherwise(100 - same)).select("anchor", "label", "rank").orderBy("rank", "label")


def options(report: DataFrame) -> DataFrame:
    """Project options by slug; ambiguous names carry their path."""
    same = F.count(F.lit(1)).over(Window.partitionBy("name")) > 1
    return report.select("project_slug", F.when(same, F.concat("name", F.lit(" ("), "path", F.lit(")"))).otherwise(F.col("name")).alias("label")).orderBy("project_slug")
