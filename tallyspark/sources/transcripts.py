"""JSONL transcripts to usage events: scan, parse, project. Batch and stream share the expressions.

Files are read by byte ranges, a row a line, so a large file is many tasks and no file is ever in one row. A line's rank is
(path, first byte of its range, place in that range): the order of the lines, without their number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timefns as T

SCHEMA = (
    "type string, timestamp string, requestId string, cwd string, costUSD double, isApiErrorMessage boolean, message struct<id:string, model:string, role:string, usage:struct<"
    "input_tokens:double, output_tokens:double, cache_creation_input_tokens:double, cache_read_input_tokens:double, "
    "cache_creation:struct<ephemeral_5m_input_tokens:double, ephemeral_1h_input_tokens:double>>>, _corrupt string"
)
#: Fixed values of the data format: what records that count say, and the model name of made-up ones.
MARKER, WORD, SYNTHETIC = r'"type"\s*:\s*"assistant"', '"assistant"', "<synthetic>"
#: Fields that may be absent but not null.
OPTIONAL = (
    "costUSD", "requestId", "cwd", "isApiErrorMessage", "message.role", "message.usage", "message.usage.cache_creation_input_tokens", "message.usage.cache_read_input_tokens", "message.usage.cache_creation",
)
JSONL = dict(pathGlobFilter="*.jsonl", recursiveFileLookup=True)


def read(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Lines of all *.jsonl files below a root (or of a list of files): path, line (their rank in it) and value. A root that
    isn't there yet has none."""
    if isinstance(root, str) and not there(spark, root):
        return spark.createDataFrame([], "path string, line struct<block:bigint,place:bigint>, value string")
    return lines(spark.read.text(root, lineSep="\n", **JSONL))


def there(spark: SparkSession, path: str) -> bool:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    return to.getFileSystem(spark._jsc.hadoopConfiguration()).exists(to)


def lines(text: DataFrame) -> DataFrame:
    """Rows of a text source -> path, line and value. Carriage returns at line ends and lines of white space go."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return trimmed(text.select(F.col("_metadata.file_path").alias("path"), at.alias("line"), "value"))


def trimmed(rows: DataFrame) -> DataFrame:
    value = F.col("value")
    return rows.withColumn("value", F.when(value.endswith("\r"), F.left(value, F.length(value) - 1)).otherwise(value)).filter(F.trim("value") != "")


def may_count(value: Column) -> Column:
    """False only for whole lines that certainly hold no usage: checked before any JSON is parsed, the plain search first."""
    return ~value.endswith("}") | (value.contains(WORD) & value.rlike(MARKER))


def parsed(rows: DataFrame) -> DataFrame:
    """rows with r, the record, and problem: null, 'invalid-json' or 'schema-mismatch'. Each line is parsed once; a second
    look is taken only at what didn't fit the schema and at lines that hold a null."""
    value = F.col("value")
    # a generator of one row: filters on r stay above it, so that the parser doesn't run once for them and once for r
    record = F.explode(F.array(F.from_json(value, SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})))
    out = rows.filter(may_count(value)).select("*", record.alias("r"))
    message, usage, split = F.col("r.message"), F.col("r.message.usage"), F.col("r.message.usage.cache_creation")
    counts = [usage[c] for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")]
    wrong = F.col("r._corrupt").isNotNull() | F.col("r.timestamp").isNull() | message["id"].isNull() | message["model"].isNull()
    wrong = wrong | (usage.isNotNull() & (counts[0].isNull() | counts[1].isNull())) | (F.coalesce(message["role"], F.lit("assistant")) != "assistant")
    wrong = wrong | (split.isNotNull() & (split["ephemeral_5m_input_tokens"].isNull() | split["ephemeral_1h_input_tokens"].isNull()))
    for c in (*counts, F.col("r.costUSD")):
        wrong = wrong | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    # the rare branch is evaluated apart, which keeps the code of the others small enough to be compiled
    null = lambda v, path: F.coalesce(F.is_variant_null(F.try_variant_get(F.try_parse_json(v), f"$.{path}", "variant")), F.lit(False))
    nulls = F.exists(F.array(value), lambda v: F.greatest(*(null(v, path) for path in OPTIONAL)))
    nulls = F.when(value.contains("null") & value.rlike(r":\s*null"), nulls).otherwise(False)
    invalid = F.when(F.col("r._corrupt").isNotNull(), F.try_parse_json(value).isNull()).otherwise(False)
    return out.withColumn("problem", F.when(invalid, "invalid-json").when((F.col("r.type") == "assistant") & (wrong | nulls), "schema-mismatch"))


def identity(path: Column, root: str) -> tuple[Column, Column]:
    """Project slug and session of a file below a root: its first folder, and the next part without its ending, so that
    files of nested agents belong to their parent session; a file at the root itself has the slug ''."""
    root = root.rstrip("/").removeprefix("file://") + "/"
    at = F.instr(path, F.lit(root))
    below = F.when(at > 0, F.substring(path, at + len(root), F.length(path))).otherwise(path)
    slug = F.when(F.contains(below, F.lit("/")), F.substring_index(below, "/", 1)).otherwise("")
    return slug, F.regexp_replace(F.substring_index(F.substring_index(below, "/", 2), "/", -1), r"\.jsonl$", "")


def usage(rows: DataFrame, root: str, machine_id: str) -> DataFrame:
    """Usage events of parsed rows: real assistant messages with usage that are no API errors. ord ranks them."""
    keep = F.col("problem").isNull() & (F.col("r.type") == "assistant") & ~F.coalesce("r.isApiErrorMessage", F.lit(False)) & (F.col("r.message.model") != SYNTHETIC) & F.col("r.message.usage").isNotNull()
    slug, session = identity(F.col("path"), root)
    u = "r.message.usage."
    return rows.filter(keep).select(
        F.col("r.message.id").alias("message_id"), F.col("r.requestId").alias("request_id"), session.alias("session_id"), slug.alias("project_slug"), F.lit(machine_id).alias("machine_id"),
        F.col("r.message.model").alias("model"), F.col(u + "input_tokens").cast("long").alias("input_tokens"), F.col(u + "output_tokens").cast("long").alias("output_tokens"),
        F.coalesce(F.col(u + "cache_creation_input_tokens"), F.lit(0)).cast("long").alias("cache_creation_tokens"), F.coalesce(F.col(u + "cache_read_input_tokens"), F.lit(0)).cast("long").alias("cache_read_tokens"),
        F.col("r.costUSD").alias("cost_usd"), F.col("r.cwd").alias("cwd"), F.col("r.timestamp").alias("timestamp"), T.instant(F.col("r.timestamp")).alias("ts"), F.struct("path", "line").alias("ord"),
    )


def scanned(spark: SparkSession, roots: list[tuple[str, str]]) -> DataFrame:
    """Events of (root, machine) pairs, ranked by root, path and line."""
    out = None
    for i, (root, machine) in enumerate(roots):
        part = usage(parsed(read(spark, root)), root, machine).withColumn("ord", F.struct(F.lit(i).alias("root"), "ord.path", "ord.line"))
        out = part if out is None else out.unionByName(part)
    return out


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path, size and modified of all *.jsonl files below a root. Their content isn't read."""
    if not there(spark, root):
        return spark.createDataFrame([], "path string, size long, modified timestamp")
    now = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).load(root)
    about = F.col("_metadata")
    return now.select(about["file_path"].alias("path"), about["file_size"].alias("size"), about["file_modification_time"].alias("modified"))


def stale(spark: SparkSession, root: str, known: DataFrame) -> DataFrame:
    """Files whose path, size or time is not in known (path, size, modified): what an incremental scan must read."""
    return listed(spark, root).join(known, ["path", "size", "modified"], "left_anti")


#: Version of what is kept; raise it when parsing changes, and all files are parsed anew.
CACHE_VERSION = 1
STAMP = ["path", "size", "modified"]


def cached(spark: SparkSession, root: str, machine_id: str, cache: str, version: int = CACHE_VERSION) -> DataFrame:
    """scanned() of one root, with what earlier calls parsed kept below cache: events of each run, and then the files that it
    parsed by path, size and time. Only files that are new or differ are parsed; files that are gone, or were replaced, are in
    no result. A run that broke off before its files were written left events that nothing refers to."""
    at = f"{cache}/version={version}"
    now = listed(spark, root)
    known = kept(spark, f"{at}/files", ", ".join(("path string", "size long", "modified timestamp", "run string")))
    new = [r["path"] for r in now.join(known, STAMP, "left_anti").select("path").collect()] if known is not None else None  # the paths that Spark is to read
    run = "r" + uuid.uuid4().hex
    if known is None or new:
        events = usage(parsed(read(spark, root if known is None else new)), root, machine_id).withColumn("path", F.col("ord.path"))
        events.write.parquet(f"{at}/events/run={run}")
        stale_ = now if known is None else now.join(known, STAMP, "left_anti")
        stale_.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{at}/files")
        known = kept(spark, f"{at}/files", None)
    live = known.join(now, STAMP, "left_semi").select("path", "run")
    events = spark.read.parquet(f"{at}/events")
    return events.join(live, ["path", "run"], "left_semi").drop("path", "run")


def kept(spark: SparkSession, path: str, schema: str | None) -> DataFrame | None:
    """A table that may not be there yet."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path) if there(spark, path) else None


def forget_cache(spark: SparkSession, cache: str) -> None:
    """Drop everything that is kept; the next call parses all files."""
    to = spark._jvm.org.apache.hadoop.fs.Path(cache)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


def session_frames(summary: DataFrame, events: DataFrame) -> DataFrame:
    """NDJSON lines of a session: its summary, then its events, each tagged."""
    tagged = lambda df, tag, n: df.select(F.lit(n).alias("n"), F.col("rank") if "rank" in df.columns else F.lit(0).alias("rank"), F.to_json(F.struct(F.lit(tag).alias("type"), *[c for c in df.columns if c != "rank"])).alias("value"))
    return tagged(summary, "summary", 0).unionByName(tagged(events, "event", 1)).orderBy("n", "rank").select("value")
