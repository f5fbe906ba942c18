"""The replicated log as NDJSON files: a header line with the epoch, then one event a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = (
    "message_id string, request_id string, session_id string, project_slug string, machine_id string, model string, input_tokens long, output_tokens long, "
    "cache_creation_tokens long, cache_read_tokens long, cost_usd double, cwd string, timestamp string, seq long"
)


def loaded(spark: SparkSession, path: str, strict: bool = True) -> tuple[str, DataFrame]:
    """(epoch, events) of a log file, or a folder of them in order of their names. A torn last line is tolerated; any other
    broken line fails if strict, else it is skipped. Files are read by byte ranges."""
    text = spark.read.text(path, lineSep="\n")
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    rows = text.select(at.alias("at"), "value").filter("value != ''").withColumn("e", F.from_json("value", EVENT + ", epoch string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    head = F.col("e.epoch").isNotNull() & F.col("e.seq").isNull()
    broken = ~head & (F.col("e._corrupt").isNotNull() | F.col("e.seq").isNull() | F.col("e.message_id").isNull())
    told = rows.agg(F.min_by(F.when(head, F.col("e.epoch")), "at").alias("epoch"), F.count_if(head).alias("heads"), F.count_if(broken).alias("n"), (F.max(F.when(broken, F.col("at"))) == F.max("at")).alias("torn")).first()
    if told["epoch"] is None:
        raise ValueError(f"{path}: no header")
    wrong = told["n"] + told["heads"] - 1
    if strict and wrong and not (wrong == 1 and told["n"] == 1 and told["torn"]):
        raise ValueError(f"{path}: {wrong} broken lines")
    return told["epoch"], rows.filter(~head & ~broken).select("e.*").drop("epoch", "_corrupt")


def rewritten(events: DataFrame, path: str, epoch: str) -> None:
    """A log with these events in order of seq, as text files below path, a range of seq each; the first begins with the
    header. Their names are in order."""
    spark = events.sparkSession
    head = spark.createDataFrame([(None, f'{{"epoch":"{epoch}"}}')], "seq long, value string")
    body = events.select("seq", F.to_json(F.struct(*events.columns)).alias("value"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = head.unionByName(body).repartitionByRange(n, F.col("seq").asc_nulls_first()).sortWithinPartitions(F.col("seq").asc_nulls_first())
    both.select("value").write.mode("overwrite").text(path)
