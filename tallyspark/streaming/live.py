"""Streams: transcripts to a deduplicated event table, its change feed, and reports refreshed where the feed touched them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, StructField, StructType

from ..operators.events import KEY, deduplicated, total
from ..sources import tail, transcripts

#: Buckets of keys that share a state, and segments that a bucket's state may have.
BUCKETS, SEGMENTS = 1 << 16, 16
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def transcript_stream(spark: SparkSession, root: str, machine_id: str) -> DataFrame:
    """Usage events of transcripts below a root as they grow: each complete line once."""
    return transcripts.usage(transcripts.parsed(tail.read_stream(spark, root)), root, machine_id)


def changes(held: DataFrame, batch: DataFrame) -> DataFrame:
    """What a batch changes: each winning event whose key is new or has more tokens than the held row, with before, the
    held row (null if new). It takes the rank of the held row. Late fuller rows win at any age, so there is no watermark."""
    new = deduplicated(batch)
    old = held.select(*(F.col(k).alias(f"_{k}") for k in KEY), F.struct(*held.columns).alias("before"))
    both = new.join(old, [new[k].eqNullSafe(old[f"_{k}"]) for k in KEY], "left").drop(*(f"_{k}" for k in KEY))
    before = sum((F.col(f"before.{c}") for c in ("output_tokens", "cache_creation_tokens", "cache_read_tokens")), F.col("before.input_tokens"))
    won = both.filter(F.col("before").isNull() | (total() > before))
    return won.withColumn("ord", F.coalesce("before.ord", "ord"))


def applied(held: DataFrame, changed: DataFrame) -> DataFrame:
    """held with the changes in it."""
    gone = changed.filter("before IS NOT NULL").select(*(F.col(f"before.{k}").alias(f"_{k}") for k in KEY))
    kept = held.join(gone, [held[k].eqNullSafe(gone[f"_{k}"]) for k in KEY], "left_anti")
    return kept.unionByName(changed.drop("before").select(*held.columns))


def refreshed(report: DataFrame, held: DataFrame, changed: DataFrame, keys: list[str], fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A report by keys after a change: only the keys that changed rows are in, before or after, are folded anew."""
    touched = changed.select(*keys).unionByName(changed.filter("before IS NOT NULL").select(*(F.col(f"before.{k}").alias(k) for k in keys))).distinct()
    anew = fold(held.join(touched, keys, "left_semi"))
    return report.join(touched, keys, "left_anti").unionByName(anew.select(*report.columns))


# --- keyed state -------------------------------------------------------------------------------------------------


class Winner(StatefulProcessor):
    """Of each key the event that counts; a batch's fuller row replaces it, under the rank of the first one. Events and ranks
    travel as JSON; size and place are what Python compares. Keys share the state of their bucket, so that Python asks the
    state store once a bucket and not once a key: a list of segments, each the rows that won in one batch, later ones first
    to count. At SEGMENTS the list is written anew as one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "won string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timers: Any) -> Iterator[Row]:
        best: dict[str, list] = {}
        for _, k, ord_, event, size, *place in rows:
            rank = (-size, place)
            at = best.get(k)
            if at is None:
                best[k] = [rank, event, place, ord_]
                continue
            if rank < at[0]:
                at[:2] = rank, event
            if place < at[2]:
                at[2:] = place, ord_
        segments = [s for (s,) in self.held.get()]
        held = {k: row for s in segments for k, *row in json.loads(s)}
        won = []
        for k, ((less, _), event, _, first) in best.items():
            size, ord_, before = held.get(k, (None, None, None))
            if size is None or -less > size:
                won.append((k, -less, ord_ or first, event))
                yield Row(ord=won[-1][2], event=event, before=before)
        if won and len(segments) + 1 >= SEGMENTS:
            held.update((k, row) for k, *row in won)
            self.held.put([(json.dumps([(k, *row) for k, row in held.items()]),)])
        elif won:
            self.held.appendValue((json.dumps(won),))


def leaves(name: str, kind: DataType) -> list[Column]:
    """The plain columns of a rank, in order."""
    return [x for f in kind.fields for x in leaves(f"{name}.{f.name}", f.dataType)] if isinstance(kind, StructType) else [F.col(name)]


JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def winners(stream: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The change feed of a stream of events: each event that wins its key, with before, the event that it replaces (null if
    the key is new). State is the winner of each key ever seen, in RocksDB: a late fuller row wins at any age. buckets, by the
    hash of the key, may not change between runs of a query; a batch reads those that its keys are in."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    rest = StructType([f for f in stream.schema.fields if f.name != "ord"])
    rows = stream.select(
        F.pmod(F.xxhash64(*KEY), F.lit(buckets)).alias("_bucket"), F.to_json(F.struct(*KEY), JSON).alias("_key"),  # a null key is a key
        F.to_json(F.struct("ord"), JSON).alias("_ord"), F.to_json(F.struct(*rest.names), JSON).alias("_event"),
        total().alias("_size"), *(c.alias(f"_place{i}") for i, c in enumerate(leaves("ord", kinds["ord"]))),
    )
    out = rows.groupBy("_bucket").transformWithState(Winner(), "ord string, event string, before string", "Update", "None")
    # a generator of one row: each text is parsed once, not once for each of its fields
    parsed = F.struct(F.from_json("event", rest, JSON).alias("e"), F.from_json("before", rest, JSON).alias("b"), F.from_json("ord", StructType([StructField("ord", kinds["ord"])]))["ord"].alias("ord"))
    read = lambda c: F.struct(*(F.col(f"x.{c}.{n}" if n != "ord" else "x.ord").alias(n) for n in stream.columns))
    return out.select(F.explode(F.array(parsed)).alias("x")).select(read("e").alias("e"), F.when(F.col("x.b").isNotNull(), read("b")).alias("before")).select("e.*", "before")


# --- the table and its reports -----------------------------------------------------------------------------------


def merge_stream(stream: DataFrame, path: str, on_change: Callable[[DataFrame, DataFrame, int], None] | None = None, buckets: int = BUCKETS) -> DataStreamWriter:
    """A foreachBatch writer of the change feed below path, a folder a batch, so that a replayed batch replaces its own;
    on_change gets (changes, table after them, batch number)."""
    spark = stream.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        at = f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(at)
        changed = spark.read.schema(batch.schema).parquet(at)
        if on_change and not changed.isEmpty():
            on_change(changed, table(spark, path), batch_id)

    return winners(stream, buckets).writeStream.outputMode("update").foreachBatch(run)


def table(spark: SparkSession, path: str) -> DataFrame:
    """The event table as the change feed leaves it: of each key the last change, which has the most tokens."""
    try:
        feed = spark.read.parquet(path).drop("before", "batch")
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    return feed.groupBy(*KEY).agg(F.max_by(F.struct(*feed.columns), total()).alias("e")).select("e.*")


def compacted(spark: SparkSession, path: str, upto: int) -> None:
    """The feed's batches up to a finished one as one: of each key its last change. The query must not be running."""
    feed = spark.read.parquet(path).filter(F.col("batch") <= upto)
    last = feed.groupBy(*KEY).agg(F.max_by(F.struct(*(c for c in feed.columns if c != "batch")), total()).alias("e")).select("e.*")
    last.write.mode("overwrite").parquet(f"{path}/_compacted")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [r["batch"] for r in feed.select("batch").distinct().collect()]  # a row a batch
    to = spark._jvm.org.apache.hadoop.fs.Path
    for b in old:
        if b != upto:
            fs.delete(to(f"{path}/batch={b}"), True)
    fs.delete(to(f"{path}/batch={upto}"), True)
    fs.rename(to(f"{path}/_compacted"), to(f"{path}/batch={upto}"))


@dataclass(frozen=True)
class Family:
    """A kind of report that is kept as files: part, the partition of an event's rows (a date, a bucket of projects), and
    fold, which gives the report of events that have a column part, and keeps it."""

    name: str
    part: Column
    fold: Callable[[DataFrame], DataFrame]


def refresh_parts(spark: SparkSession, path: str, families: list[Family], changed: DataFrame, events: DataFrame) -> None:
    """Fold those partitions of each report anew that changed events are in, before or after, and overwrite these alone; a
    partition that has no rows any more goes. Running it again for the same changes does no harm."""
    events = events.persist()  # each kind of report reads it
    for family in families:
        of = lambda df, c=family.part: df.select(c.cast("string").alias("part"))
        touched = of(changed).unionByName(of(changed.filter("before IS NOT NULL").select("before.*"))).filter("part IS NOT NULL").distinct().persist()
        rows = family.fold(events.withColumn("part", family.part.cast("string")).join(touched, "part", "left_semi"))
        to = f"{path}/{family.name}"
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(to)
        left = touched.join(events.select(family.part.cast("string").alias("part")).distinct(), "part", "left_anti")
        for r in left.toLocalIterator():
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{to}/part={r['part']}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        touched.unpersist()
    events.unpersist()


def report(spark: SparkSession, path: str, family: Family) -> DataFrame:
    """A kept report, all partitions."""
    return spark.read.parquet(f"{path}/{family.name}").withColumn("part", F.col("part").cast("string"))
