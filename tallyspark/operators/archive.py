"""The replicated event log: numbering, paging, forgetting, compaction, and what no transcript backs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import new_dir
from .events import KEY, TOKENS, total

MOST_PAGE, MOST_PAIRS = 5_000, 5_000
PAIR = ["project_slug", "session_id"]


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place in the order, from 0, without a gap: sorted by ranges and stored, each range counted, and a
    row's place is that of its range's first row plus its own in the range. Only a count a range meets in one task. The order
    should tell all rows apart; then the same rows get the same places whatever the partitions."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the id counts the rows of a partition in its low 33 bits
    dealt = dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_own"))
    path = new_dir(spark, "ranked")
    dealt.write.parquet(path)
    held = spark.read.schema(dealt.schema).parquet(path)
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range
    return held.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def numbered(batch: DataFrame, after: int) -> DataFrame:
    """A batch with seq, from after + 1 in order of ord (ties: by key). The same batch gets the same numbers again."""
    return ranked(batch, ["ord", *KEY], "seq").withColumn("seq", F.col("seq") + F.lit(after + 1))


def appended(spark: SparkSession, path: str, batch: DataFrame, token: str) -> int:
    """Append to a log of folders push=<token> what of a batch (one row a key) is new there or fuller than what it has, with
    numbers after its last; returns how many rows. A token's folder is whole or not read, as its _SUCCESS says, so a push that
    failed is done again and one that was done isn't. One writer at a time, as a log has one hub."""
    from .events import unseen

    held = log(spark, path)
    if held is not None and not held.filter(F.col("push") == token).isEmpty():
        return 0
    fresh = batch if held is None else unseen(batch, held.select(*batch.columns))
    last = 0 if held is None else held.agg(F.max("seq")).first()[0] or 0
    numbered(fresh, last).write.mode("overwrite").parquet(f"{path}/push={token}")
    return spark.read.parquet(f"{path}/push={token}").count()


def log(spark: SparkSession, path: str) -> DataFrame | None:
    """All finished pushes of a log, with push; None if there is none."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [str(s.getPath()).rpartition("/push=")[2] for s in fs.globStatus(to(f"{path}/push=*")) or [] if fs.exists(to(f"{s.getPath()}/_SUCCESS"))]
    # a push without rows has a schema like all others
    return spark.read.option("basePath", path).schema(spark.read.parquet(f"{path}/push={found[0]}").schema.add("push", "string")).parquet(*(f"{path}/push={x}" for x in found)) if found else None


def stamped(batch: DataFrame, held: DataFrame) -> DataFrame:
    """What a hub answers a push with: of each key of a batch the seq that the log has it under."""
    own = held.groupBy(*KEY).agg(F.max_by("seq", F.struct(total(), -F.col("seq"))).alias("seq")).select(*(F.col(k).alias(f"_{k}") for k in KEY), "seq")
    return batch.select(*KEY).join(own, [batch[k].eqNullSafe(own[f"_{k}"]) for k in KEY]).select(*KEY, "seq")


def push_batches(events: DataFrame, stamps: DataFrame, most: int = 1_000) -> DataFrame:
    """Events that no stamp (a key) covers, with batch: in order of time, `most` at a time."""
    own = stamps.select(*(F.col(k).alias(f"_{k}") for k in KEY)).distinct()
    left = events.join(own, [events[k].eqNullSafe(own[f"_{k}"]) for k in KEY], "left_anti")
    return ranked(left, ["timestamp", "ord", *KEY], "_at").withColumn("batch", F.floor(F.col("_at") / most)).drop("_at")


def page(log: DataFrame, since: int, limit: int, watermark: int | None = None) -> DataFrame:
    """Up to limit rows after seq since, none beyond the durable watermark."""
    rows = log.filter(F.col("seq") > since)
    rows = rows.filter(F.col("seq") <= watermark) if watermark is not None else rows
    return rows.orderBy("seq").limit(min(limit, MOST_PAGE))


def compacted(log: DataFrame) -> DataFrame:
    """Of each key the row with the most tokens, the earliest of equals, under its own seq."""
    over = Window.partitionBy(*KEY).orderBy(total().desc(), "seq")
    return log.withColumn("_rn", F.row_number().over(over)).filter("_rn = 1").drop("_rn")


def forgotten(log: DataFrame, pairs: DataFrame, machine_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go): those of the named (project_slug, session_id) pairs, of one machine if given."""
    pairs = pairs.select(*PAIR).distinct().withColumn("_hit", F.lit(True))
    both = log.join(pairs, PAIR, "left")
    hit = F.col("_hit").isNotNull()
    hit = hit & (F.col("machine_id") == machine_id) if machine_id is not None else hit
    hit = F.coalesce(hit, F.lit(False))
    return both.filter(~hit).drop("_hit"), both.filter(hit).drop("_hit")


def forgotten_in_batches(log: DataFrame, pairs: DataFrame, machine_id: str | None = None, most: int = MOST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Forget any number of pairs in requests of at most `most` pairs: (rows that stay, a row for each batch: batch,
    n_pairs, n_removed). Batches go by rank of the pairs; all are dealt with in one join."""
    pairs = pairs.select(*PAIR).distinct()
    dealt = ranked(pairs, PAIR, "_at").withColumn("batch", F.floor(F.col("_at") / most)).drop("_at")
    rows = log.filter(F.col("machine_id") == machine_id) if machine_id is not None else log
    hits = rows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    told = dealt.join(hits, PAIR, "left").groupBy("batch").agg(F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_removed"))
    return forgotten(log, pairs, machine_id)[0], told


def applied(replica: DataFrame, rows: DataFrame, epoch: str, of: str) -> tuple[DataFrame, str, int]:
    """A pulled page on a replica: (replica, epoch, cursor). A page of another epoch replaces it. Of rows with one key the
    fuller stays, the one that is held of equals; the cursor is the page's last seq even if no row of it won."""
    cursor = rows.agg(F.max("seq")).first()[0] or 0
    if epoch != of:
        return compacted(rows), epoch, cursor
    held = replica.withColumn("_feed", F.lit(0)).unionByName(rows.withColumn("_feed", F.lit(1)))
    over = Window.partitionBy(*KEY).orderBy(total().desc(), "_feed", "seq")
    return held.withColumn("_rn", F.row_number().over(over)).filter("_rn = 1").drop("_rn", "_feed"), epoch, max(cursor, replica.agg(F.max("seq")).first()[0] or 0)


def pulled(replica: DataFrame, hub: DataFrame, epoch: str, of: str, most: int = MOST_PAGE) -> tuple[DataFrame, int]:
    """A replica after pulling everything a hub has beyond it, all of it if the epochs differ: (replica, pages). Broken
    rows (no key or negative counts) are left out. Page borders don't change the result, so the pages are one job."""
    since = 0 if epoch != of else replica.agg(F.max("seq")).first()[0] or 0
    fresh = hub.filter(F.col("seq") > since).filter(F.col("message_id").isNotNull() & (F.least(*TOKENS) >= 0))
    pages = -(-hub.filter(F.col("seq") > since).count() // most)
    return applied(replica, fresh, epoch, of)[0], pages


def rebuilt(rescan: DataFrame, archive: DataFrame, replica: DataFrame) -> DataFrame:
    """The store anew: transcripts first, then the archive, then what others have sent."""
    from .events import united

    return united(rescan, archive, replica)


def exchanged(mine: DataFrame, hub: DataFrame, floor: int = 0) -> tuple[DataFrame, DataFrame]:
    """Limit samples of both sides: (mine with the hub's that are newer than my latest, what the hub still lacks: mine
    after its latest or the retained floor, whichever is earlier)."""
    latest = lambda df: df.agg(F.max("captured_at")).first()[0] or 0
    own, theirs = latest(mine), latest(hub)
    push = mine.filter(F.col("captured_at") > min(theirs, floor) if floor else F.col("captured_at") > theirs)
    return merged_samples(mine, hub.filter(F.col("captured_at") > own)), push.join(hub.select("captured_at"), "captured_at", "left_anti")


def storage_totals(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """segment, n_files and n_bytes of each root; a root that isn't there has none. Listing only, no file is opened."""
    out = spark.createDataFrame([(k,) for k in sorted(roots)], "segment string")
    found = None
    for name, root in roots.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            continue
        part = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.lit(name).alias("segment"), "length")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return out.withColumns({"n_files": F.lit(0).cast("long"), "n_bytes": F.lit(0).cast("long")})
    sums = found.groupBy("segment").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
    return out.join(sums, "segment", "left").na.fill(0, ["n_files", "n_bytes"])


def unbacked(log: DataFrame, transcripts: DataFrame, me: str) -> DataFrame:
    """Sessions of mine in the log that no transcript has any more: rows, by rows, slug and session."""
    mine = log.filter(F.col("machine_id") == me)
    gone = mine.join(transcripts.select(*PAIR).distinct(), PAIR, "left_anti")
    return gone.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.col("n_rows").desc(), *PAIR)


def own_new(events: DataFrame, me: str, dropped: DataFrame, held: DataFrame) -> DataFrame:
    """My rows that are neither forgotten nor held already."""
    from .events import unseen

    mine = events.filter(F.col("machine_id") == me).join(dropped.select(*PAIR).distinct(), PAIR, "left_anti")
    return unseen(mine, held)


def merged_samples(*feeds: DataFrame) -> DataFrame:
    """Limit samples with the first row of each captured_at, earlier feeds first."""
    out = None
    for i, feed in enumerate(feeds):
        feed = feed.withColumn("_feed", F.lit(i))
        out = feed if out is None else out.unionByName(feed)
    over = Window.partitionBy("captured_at").orderBy("_feed", "ord")
    return out.withColumn("_rn", F.row_number().over(over)).filter("_rn = 1").drop("_rn", "_feed")
