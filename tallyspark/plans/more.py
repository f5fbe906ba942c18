"""More registered queries: transcript files, replication, merges, dimensions and small figures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, pricing
from ..functions import timefns as T
from ..operators import archive, blocks, compose, dims, reports
from ..operators.events import TOKENS, last_of_batch, searched, total, tree_filtered, united
from ..sources import logs, transcripts
from ..sources.shared import new_dir
from . import fixtures
from .catalog import FAMILY, H1, H5, NOW, PARENT, SAMPLES, SESSIONS, TOT, TZ, base, key_blocks, money, priced, query, walk_sql

PLAIN = "WITH " + base().split("WITH RECURSIVE ")[1]

# --- transcripts -------------------------------------------------------------------------------------------------

#: Transcript lines by event: most are assistant messages; some are errors, made-up models, torn, of users, or lack a field.
KIND = "CASE WHEN event_id % 50 = 7 THEN 'error' WHEN event_id % 50 = 9 THEN 'synthetic' WHEN event_id % 50 = 11 THEN 'torn' WHEN event_id % 50 = 13 THEN 'lacking' WHEN event_id % 10 = 3 THEN 'user' ELSE 'good' END"
LINES = f"""SELECT event_id, {KIND} AS kind, concat('proj-', CAST(user_id % 5 AS {{S}})) AS slug, concat('s-', CAST(user_id % 64 AS {{S}})) AS session, concat('m-', CAST(event_id - event_id % 2 AS {{S}})) AS message_id,
  CAST(round(value * 100) AS BIGINT) AS input_tokens, CAST(event_id % 89 AS BIGINT) AS output_tokens, ts FROM {{events}}"""


def files_written(folder: str):
    """mapInArrow over slug, session and line (with its end) -> rows written, a file for each run of equal slug and session. Lines
    go out as batches come, so that a task holds a batch however long its files are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = pafs.FileSystem.from_uri(folder)
        own, out, n = None, None, 0
        try:
            for b in batches:
                keys = list(zip(*(b.column(i).to_pylist() for i in range(2)), strict=True))
                text = b.column(2).cast(pa.large_string())
                at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
                for i, j in pairwise(edges):
                    if keys[i] != own:
                        if out:
                            out.close()
                        own = keys[i]
                        fs.create_dir(f"{place}/{own[0]}", recursive=True)
                        out = fs.open_output_stream(f"{place}/{own[0]}/{own[1]}.jsonl")
                    out.write(text.buffers()[2].slice(at[i], at[j] - at[i]))
                n += len(keys)
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return run


def transcript_files(spark: SparkSession, sf_dir: str) -> str:
    """JSONL files, one a project and session, with the lines of LINES in order; returns their root."""
    root = new_dir(spark, "transcripts")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = spark.sql(LINES.format(S="string", events="{events}"), events=events)
    usage = F.struct("input_tokens", F.when(F.col("kind") != "lacking", F.col("output_tokens")).alias("output_tokens"))
    message = F.struct(F.col("message_id").alias("id"), F.when(F.col("kind") == "synthetic", transcripts.SYNTHETIC).otherwise("claude-haiku-4-5").alias("model"), usage.alias("usage"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    record = F.to_json(F.struct(F.when(F.col("kind") == "user", "user").otherwise("assistant").alias("type"), at.alias("timestamp"), (F.col("kind") == "error").alias("isApiErrorMessage"), message.alias("message")))
    line = F.when(F.col("kind") == "torn", F.substring(record, 1, 60)).otherwise(record)
    ended = rows.select("slug", "session", "event_id", F.concat(line, F.lit("\n")).alias("line"))
    dealt = ended.repartition("slug", "session").sortWithinPartitions("slug", "session", "event_id", "line").select("slug", "session", "line")
    dealt.mapInArrow(files_written(root), "n long").agg(F.sum("n")).first()
    return root


@query(f"WITH l AS ({LINES.format(S='VARCHAR', events='events')}) SELECT message_id, session AS session_id, slug AS project_slug, input_tokens, output_tokens, epoch_us(ts) // 1000 AS ms FROM l WHERE kind = 'good'")
def scan_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transcripts.scanned(spark, [(transcript_files(spark, sf_dir), "me")])
    return found.select("message_id", "session_id", "project_slug", "input_tokens", "output_tokens", T.epoch_ms(F.col("ts")).alias("ms"))


@query(f"WITH l AS ({LINES.format(S='VARCHAR', events='events')}) SELECT CASE kind WHEN 'torn' THEN 'invalid-json' ELSE 'schema-mismatch' END AS problem, count(*) AS n_lines FROM l WHERE kind IN ('torn', 'lacking') GROUP BY 1")
def scan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts.parsed(transcripts.read(spark, transcript_files(spark, sf_dir)))
    return rows.filter("problem IS NOT NULL").groupBy("problem").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"WITH l AS ({LINES.format(S='VARCHAR', events='events')}) SELECT count(*) AS n_lines, count(*) FILTER (kind != 'user') AS n_parsed FROM l")
def scan_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts.read(spark, transcript_files(spark, sf_dir))
    return rows.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(transcripts.may_count(F.col("value"))).alias("n_parsed"))


@query(f"WITH l AS ({LINES.format(S='VARCHAR', events='events')}) SELECT slug AS project_slug, session AS session_id, count(*) AS n_lines FROM l GROUP BY 1, 2")
def scan_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = transcript_files(spark, sf_dir)
    slug, session = transcripts.identity(F.col("path"), root)
    return transcripts.read(spark, root).groupBy(slug.alias("project_slug"), session.alias("session_id")).agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"WITH l AS ({LINES.format(S='VARCHAR', events='events')}) SELECT DISTINCT slug AS project_slug, session AS session_id FROM l WHERE slug != 'proj-1'")
def scan_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = transcript_files(spark, sf_dir)
    nothing = spark.createDataFrame([], "path string, size long, modified timestamp")
    known = transcripts.stale(spark, root, nothing).filter(F.col("path").contains("/proj-1/"))
    slug, session = transcripts.identity(F.col("path"), root)
    return transcripts.stale(spark, root, known).select(slug.alias("project_slug"), session.alias("session_id"))


@query(f"WITH l AS ({LINES.format(S='VARCHAR', events='events')}), f AS (SELECT DISTINCT slug, session FROM l) SELECT 'here' AS segment, (SELECT count(*) FROM f) AS n_files, true AS has_bytes UNION ALL SELECT 'nowhere', 0, false")
def storage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = transcript_files(spark, sf_dir)
    return archive.storage_totals(spark, {"here": root, "nowhere": root + "-none"}).select("segment", "n_files", (F.col("n_bytes") > 0).alias("has_bytes"))


# --- the replicated log ------------------------------------------------------------------------------------------


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.usage_events(spark, sf_dir).withColumnRenamed("ord", "seq")


@query(f"{PLAIN} SELECT ord AS seq, message_id, {TOT} AS total_tokens FROM ev")
def log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "log")
    events = log_of(spark, sf_dir).drop("ts").withColumn("cwd", F.lit(None).cast("string"))
    logs.rewritten(events, path, "e1")
    return logs.loaded(spark, path)[1].select("seq", "message_id", total().alias("total_tokens"))


@query(f"{PLAIN} SELECT message_id, request_id, ord AS seq, {TOT} AS total_tokens FROM (SELECT *, row_number() OVER (PARTITION BY message_id, request_id ORDER BY {TOT} DESC, ord) AS n FROM raw) WHERE n = 1")
def log_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.raw_events(spark, sf_dir).withColumnRenamed("ord", "seq")
    return archive.compacted(rows).select("message_id", "request_id", "seq", total().alias("total_tokens"))


@query(f"{PLAIN} SELECT message_id, row_number() OVER (ORDER BY ord) + 700 AS seq FROM ev WHERE session_id = 's-7'")
def log_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = fixtures.usage_events(spark, sf_dir).filter("session_id = 's-7'")
    return archive.numbered(batch, 700).select("message_id", F.col("seq").cast("long").alias("seq"))


@query(f"""{PLAIN}, held AS (SELECT *, 0 AS feed FROM ev WHERE ord % 3 != 0 UNION ALL SELECT * REPLACE (input_tokens + 5 AS input_tokens), 1 FROM ev WHERE ord % 4 = 0)
SELECT message_id, request_id, ord AS seq, {TOT} AS total_tokens FROM (SELECT *, row_number() OVER (PARTITION BY message_id, request_id ORDER BY {TOT} DESC, feed, ord) AS n FROM held) WHERE n = 1""")
def replica_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_of(spark, sf_dir)
    page = log.filter("seq % 4 = 0").withColumn("input_tokens", F.col("input_tokens") + 5)
    return archive.applied(log.filter("seq % 3 != 0"), page, "e", "e")[0].select("message_id", "request_id", "seq", total().alias("total_tokens"))


@query(f"{PLAIN}, top AS (SELECT max(ord) AS m FROM ev WHERE ord < 3000) SELECT ord AS seq, message_id FROM ev WHERE ord < 3000 OR ord > (SELECT m FROM top)")
def replica_pulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_of(spark, sf_dir)
    broken = log.limit(3).withColumns({"message_id": F.lit(None).cast("string"), "seq": F.col("seq") + 100_000_000})
    return archive.pulled(log.filter("seq < 3000"), log.unionByName(broken), "e", "e")[0].select("seq", "message_id")


@query(f"{PLAIN} SELECT ord AS seq, message_id FROM ev WHERE ord > 0 AND (ord % 2 = 0 OR ord > 100)")
def replica_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_of(spark, sf_dir)
    return archive.pulled(log.filter("seq < 50"), log.filter("seq % 2 = 0 OR seq > 100"), "new", "old")[0].select("seq", "message_id")


@query(f"{PLAIN} SELECT message_id, request_id, {TOT} AS total_tokens FROM ev")
def store_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.raw_events(spark, sf_dir)
    feeds = (raw.filter("ord % 3 = 0"), raw.filter("ord % 3 = 1"), raw.filter("ord % 3 = 2"))
    return archive.rebuilt(*feeds).select("message_id", "request_id", total().alias("total_tokens"))


@query(f"{PLAIN}{SAMPLES}, m AS (SELECT * FROM samples WHERE captured_at % 5 != 0), h AS (SELECT * FROM samples WHERE captured_at % 3 = 0) SELECT captured_at, util FROM m UNION ALL SELECT captured_at, util FROM h WHERE captured_at > (SELECT max(captured_at) FROM m)")
def samples_pulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.limit_samples(spark, sf_dir)
    return archive.exchanged(s.filter("captured_at % 5 != 0"), s.filter("captured_at % 3 = 0"))[0].select("captured_at", "util")


@query(f"{PLAIN}{SAMPLES}, h AS (SELECT * FROM samples WHERE captured_at < {NOW}) SELECT captured_at, util FROM samples WHERE captured_at > (SELECT max(captured_at) FROM h)")
def samples_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.limit_samples(spark, sf_dir)
    return archive.exchanged(s, s.filter(F.col("captured_at") < NOW))[1].select("captured_at", "util")


@query(f"""{PLAIN}, p AS (SELECT DISTINCT project_slug, session_id FROM ev WHERE ord % 7 = 0), r AS (SELECT *, CAST((row_number() OVER (ORDER BY project_slug, session_id) - 1) // 20 AS BIGINT) AS batch FROM p),
h AS (SELECT project_slug, session_id, count(*) AS n FROM ev WHERE machine_id = 'mach-1' GROUP BY ALL) SELECT batch, count(*) AS n_pairs, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_removed FROM r LEFT JOIN h USING (project_slug, session_id) GROUP BY 1""")
def forget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_of(spark, sf_dir)
    return archive.forgotten_in_batches(log, log.filter("seq % 7 = 0"), "mach-1", 20)[1].select(F.col("batch").cast("long").alias("batch"), "n_pairs", "n_removed")


@query(f"""{PLAIN}, mine AS (SELECT * FROM ev WHERE machine_id = 'mach-1' AND session_id NOT IN ('s-1', 's-4', 's-7')) SELECT ord FROM mine WHERE NOT (ord % 4 = 0)""")
def own_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.usage_events(spark, sf_dir)
    return archive.own_new(events, "mach-1", events.filter(F.col("session_id").isin("s-1", "s-4", "s-7")), events.filter("ord % 4 = 0")).select("ord")


@query(f"{PLAIN} SELECT project_slug, session_id, count(*) AS n_rows FROM ev WHERE machine_id = 'mach-1' AND session_id LIKE '%4' GROUP BY ALL")
def unbacked_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.usage_events(spark, sf_dir)
    return archive.unbacked(events, events.filter(~F.col("session_id").endswith("4")), "mach-1")


# --- merges and dimensions ---------------------------------------------------------------------------------------


@query(f"""{PLAIN}, f AS (SELECT *, 0 AS feed FROM raw WHERE ord % 2 = 0 UNION ALL SELECT *, 1 FROM raw), n AS (SELECT *, row_number() OVER (PARTITION BY message_id, request_id ORDER BY {TOT} DESC, feed, ord) AS k FROM f)
SELECT message_id, request_id, {TOT} AS total_tokens FROM n WHERE k = 1""")
def union_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.raw_events(spark, sf_dir)
    return united(raw.filter("ord % 2 = 0"), raw).select("message_id", "request_id", total().alias("total_tokens"))


@query(f"{PLAIN} SELECT message_id, request_id, ord, {TOT} AS total_tokens FROM (SELECT *, row_number() OVER (PARTITION BY message_id, request_id ORDER BY ord DESC) AS k FROM raw) WHERE k = 1")
def batch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_of_batch(fixtures.raw_events(spark, sf_dir)).select("message_id", "request_id", "ord", total().alias("total_tokens"))


@query(f"""{PLAIN}, a AS (SELECT *, ord % 3 AS v FROM ev), mine AS (SELECT * FROM a WHERE machine_id = 'mach-1' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) = 1)
SELECT machine_id, session_id, ord FROM mine UNION ALL SELECT machine_id, session_id, ord FROM ev WHERE ord % 2 = 0 AND machine_id != 'mach-1'""")
def directory_adopted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.usage_events(spark, sf_dir).select("machine_id", "session_id", "ord")
    return dims.adopted(rows, rows.filter("ord % 2 = 0"), "machine_id", "mach-1", ["session_id"], ["ord"])


MACHINES = "SELECT DISTINCT machine_id, concat('name ', machine_id) AS name FROM {ev}"


@query(f"""{PLAIN}, m AS ({MACHINES.format(ev='ev')}), s AS (SELECT machine_id, count(*) AS n_events FROM ev WHERE session_id != 's-1' GROUP BY 1)
SELECT machine_id, name, n_events, machine_id = 'mach-1' AS live, CASE WHEN machine_id != 'mach-2' THEN 5 END AS last_seq FROM m LEFT JOIN s USING (machine_id)""")
def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.usage_events(spark, sf_dir)
    machines = spark.sql(MACHINES.format(ev="{ev}"), ev=events)
    clients = machines.select("machine_id", (F.col("machine_id") == "mach-1").alias("live"), F.lit("2024-01-01").alias("last_seen"))
    pushes = machines.filter("machine_id != 'mach-2'").select("machine_id", F.lit(5).alias("last_seq"))
    return dims.roster(machines, clients, events.filter("session_id != 's-1'"), pushes).select("machine_id", "name", "n_events", "live", "last_seq")


@query(f"""{PLAIN}, c AS (SELECT DISTINCT project_slug AS anchor, concat('id-', substr(project_slug, 6, 1)) AS identity, substr(project_slug, 1, 6) AS label, concat('/home/', CASE WHEN project_slug LIKE '%-wt%' THEN 'w' ELSE 'p' END, '/', substr(project_slug, length(project_slug), 1)) AS path FROM ev)
SELECT anchor, label, CASE WHEN split_part(path, '/', 4) != '1' THEN 10000 WHEN split_part(path, '/', 3) != 'p' THEN 99 ELSE 97 END AS rank FROM c WHERE anchor != 'proj-1' AND identity != 'id-1'""")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.col("project_slug")
    path = F.concat(F.lit("/home/"), F.when(slug.contains("-wt"), "w").otherwise("p"), F.lit("/"), F.substring(slug, -1, 1))
    rows = fixtures.usage_events(spark, sf_dir).select(slug.alias("anchor"), F.concat(F.lit("id-"), F.substring(slug, 6, 1)).alias("identity"), F.substring(slug, 1, 6).alias("label"), path.alias("path"))
    return dims.merge_candidates(rows.distinct(), "proj-1")


@query(f"{PLAIN}, r AS (SELECT DISTINCT project_slug, substr(project_slug, 1, 6) AS name FROM ev) SELECT project_slug, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN concat(name, ' (/', project_slug, ')') ELSE name END AS label FROM r")
def project_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.col("project_slug")
    return dims.options(fixtures.usage_events(spark, sf_dir).select(slug, F.substring(slug, 1, 6).alias("name"), F.concat(F.lit("/"), slug).alias("path")).distinct())


CWD = "CASE WHEN {o} % 5 = 0 THEN '/tmp/x' WHEN {o} % 3 = 0 THEN replace({p}, '-', '/') ELSE NULL END"


@query(f"""{PLAIN}, c AS (SELECT project_slug, ts, ord, {CWD.format(o='ord', p='project_slug')} AS cwd FROM ev),
g AS (SELECT project_slug, arg_min(cwd, (ts, ord)) FILTER (regexp_replace(cwd, '[^A-Za-z0-9]', '-', 'g') = project_slug) AS e, arg_min(cwd, (ts, ord)) FILTER (cwd != '') AS a FROM c GROUP BY 1)
SELECT project_slug, coalesce(e, a, replace(project_slug, '-', '/')) AS path FROM g""")
def project_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.usage_events(spark, sf_dir)
    return reports.project_paths(events.withColumn("cwd", F.expr(CWD.format(o="ord", p="project_slug"))))


@query(f"{PLAIN} SELECT DISTINCT project_slug, regexp_replace(concat('/home/u/', project_slug), '[^A-Za-z0-9]', '-', 'g') AS slug, replace(project_slug, '-', '/') AS path, concat('~/', project_slug) AS shown, project_slug AS name FROM ev")
def slug_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug, full = F.col("project_slug"), F.concat(F.lit("/home/u/"), F.col("project_slug"))
    rows = fixtures.usage_events(spark, sf_dir).select(slug).distinct()
    return rows.select(slug, paths.slug_of(full).alias("slug"), paths.path_of(slug).alias("path"), paths.display_path(full).alias("shown"), paths.display_name(full).alias("name"))


@query("""WITH r AS (SELECT n_nationkey, lower(replace(n_name, ' ', '-')) AS n FROM nation) SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN concat('host.org/team/', n) WHEN 1 THEN concat('host.org/team/', n)
  WHEN 2 THEN concat('host.org:8443/team/', n, '#sub/dir') WHEN 3 THEN concat('host.org/team/', n) END AS repo_id FROM r""")
def repo_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.replace(F.col("n_name"), F.lit(" "), F.lit("-")), F.col("n_nationkey") % 5
    remote = (
        F.when(k == 0, F.concat(F.lit("git@Host.org:team/"), n, F.lit(".git"))).when(k == 1, F.concat(F.lit("https://me:pw@host.org:443/team/"), n, F.lit("/")))
        .when(k == 2, F.concat(F.lit("ssh://git@host.org:8443/team/"), n)).when(k == 3, F.concat(F.lit("http://host.org/team/"), n, F.lit(".git?x=1"))).otherwise(F.concat(F.lit("file:///team/"), n))
    )
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nations.select(F.col("n_nationkey"), paths.repo_id(remote, F.when(k == 2, "/Sub\\Dir/")).alias("repo_id"))


@query("SELECT concat('claude-', lower(n_name)) AS model_key, CASE WHEN n_nationkey <= 20 THEN CAST(n_nationkey AS DOUBLE) / 20 END AS input, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 0.5 END AS DOUBLE) AS output FROM nation WHERE n_nationkey <= 20 OR n_nationkey % 2 = 0")
def price_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices over 1 are none, and a model without any goes."""
    k = F.col("n_nationkey")
    price = F.struct((k / 20.0).alias("input_cost_per_token"), F.when(k % 2 == 0, 0.5).otherwise(7.0).alias("output_cost_per_token"))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("claude-"), F.lower("n_name")).alias("m"), price.alias("p"))
    other = rows.select(F.lit("gpt").alias("m"), "p").limit(1)
    text = rows.unionByName(other).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("m", "p")))).alias("value"))
    found = pricing.prices_from_json(text)
    return found.select("model_key", F.when(F.col("input") <= 1, F.col("input")).alias("input"), "output")


@query("SELECT concat('claude-', lower(n_name)) AS model_key FROM nation WHERE n_nationkey < 13")
def price_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new table of 13 replaces one of 25, one of 6 doesn't replace it."""
    table = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.concat(F.lit("claude-"), F.lower("n_name")).alias("model_key"))
    held = pricing.refreshed(table, table.filter("n_nationkey < 13"))
    return pricing.refreshed(held, table.filter("n_nationkey < 6")).select("model_key")


# --- reports and series ------------------------------------------------------------------------------------------


@query(f"{SESSIONS} SELECT session_id FROM s WHERE contains(lower(project_slug), 'j-2') OR contains(lower(session_id), 'j-2')")
def search_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(reports.sessions(priced(spark, sf_dir), TZ), " J-2 ", ["project_slug", "session_id"]).select("session_id")


@query(f"{PLAIN}, p AS (SELECT DISTINCT project_slug FROM ev), c AS (SELECT DISTINCT project_slug FROM ev WHERE contains(session_id, '-1')), o AS (SELECT project_slug, contains(project_slug, '-1') AS own, project_slug IN (SELECT project_slug FROM c) AS child FROM p) SELECT project_slug, NOT own AS by_child FROM o WHERE own OR child")
def tree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.usage_events(spark, sf_dir)
    parents = events.select("project_slug", F.col("project_slug").alias("name")).distinct()
    children = events.select("project_slug", F.col("session_id").alias("name")).distinct()
    return tree_filtered(parents, children, "project_slug", "-1", ["name"]).select("project_slug", "by_child")


@query(f"{base()}, d AS (SELECT day AS date, sum({TOT}) AS t, sum({TOT}) FILTER ({FAMILY} = 'Opus') AS o FROM priced GROUP BY 1) SELECT date, CAST(t - coalesce(o, 0) AS BIGINT) AS value FROM d")
def muted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = reports.dated(priced(spark, sf_dir), TZ)
    rows = compose.series(events, ["model"], events.select("date").distinct())
    whole = events.groupBy("date").agg(F.sum(total()).alias("value"))
    return compose.muted(rows, whole, "model", ["Opus"])[1].select("date", F.col("value").cast("long").alias("value"))


@query(f"{SESSIONS}, p AS (SELECT project_slug, count(DISTINCT session_id) AS n, sum(cost) AS c FROM priced GROUP BY 1) SELECT count(*) AS n_projects, CAST(sum(n) AS BIGINT) AS n_sessions, round(sum(c), 8) AS cost FROM p")
def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.project_summary(reports.projects(priced(spark, sf_dir), TZ)).select("n_projects", "n_sessions", *money("cost"))


@query(f"{base()} SELECT model, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in TOKENS)}, round(sum(cost), 8) AS cost FROM priced GROUP BY 1")
def merged_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.merged_breakdowns(reports.daily(priced(spark, sf_dir), TZ)).select("model", *TOKENS, *money("cost"))


@query(f"{base()}, h AS (SELECT date AS d, * FROM priced WHERE machine_id != 'mach-2' UNION ALL SELECT day, * FROM priced WHERE machine_id = 'mach-2') SELECT d AS date, count(*) AS n_events, round(sum(cost), 8) AS cost FROM h GROUP BY 1")
def merged_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two machines by UTC days and one by local days, added."""
    events = priced(spark, sf_dir)
    parts = reports.daily(events.filter("machine_id != 'mach-2'")), reports.daily(events.filter("machine_id = 'mach-2'"), TZ)
    return reports.merged_rows(*parts).select("date", "n_events", *money("cost"))


@query(f'{base()}, g AS (SELECT *, CASE {PARENT} WHEN \'proj-1\' THEN \'team\' WHEN \'proj-2\' THEN \'team\' ELSE {PARENT} END AS grp FROM priced) SELECT grp AS "group", day AS date, count(DISTINCT project_slug) AS n_members, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, round(sum(cost), 8) AS cost FROM g GROUP BY 1, 2')
def grouped_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spark.createDataFrame([("proj-1", "team"), ("proj-2", "team")], "project_slug string, group_key string")
    report = reports.daily_by_project(priced(spark, sf_dir), TZ)
    return dims.worktree_fold(report, ["input_tokens", "cost"], ["date"], groups).select("group", "date", "n_members", "input_tokens", *money("cost"))


@query(f"{base()} SELECT min(day) AS first, greatest(max(day), '2024-01-20') AS last FROM priced")
def corpus_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.corpus_extent(priced(spark, sf_dir), TZ, "2024-01-20")


@query(f"{base()}, p AS (SELECT project_slug, sum(cost) AS c FROM priced GROUP BY 1) SELECT project_slug, CAST(floor(100 * c / (SELECT sum(c) FROM p) + 0.5) AS BIGINT) AS share, round(greatest(c, 0) / (SELECT max(c) FROM p), 6) AS bar FROM p")
def project_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = priced(spark, sf_dir).groupBy("project_slug").agg(F.sum("cost").alias("cost"))
    return reports.bar_scaled(reports.shares(rows)).select("project_slug", F.col("share").cast("long").alias("share"), F.round("bar", 6).alias("bar"))


@query(f"{base()}, d AS (SELECT project_slug, day, sum(cost) AS c FROM priced GROUP BY ALL) SELECT project_slug, round(sum(c), 8) AS total, round(max(c), 8) AS most, round(avg(c), 8) AS mean FROM d GROUP BY 1")
def series_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = reports.dated(priced(spark, sf_dir), TZ).groupBy("project_slug", "date").agg(F.sum("cost").alias("value"))
    return reports.series_summary(days, ["project_slug"]).select("project_slug", *money("total", "most", "mean"))


@query(f"{base()}, s AS (SELECT session_id, max(day) AS day FROM priced GROUP BY 1) SELECT session_id, CAST(greatest(0, DATE '2024-01-25' - CAST(day AS DATE)) AS BIGINT) AS days FROM s")
def session_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.sessions(priced(spark, sf_dir), TZ)
    return rows.select("session_id", T.days_since(F.col("last_activity"), "2024-01-25").cast("long").alias("days"))


@query(f"{base()} SELECT session_id, count(*) AS n_events, round(sum(cost), 8) AS cost FROM priced WHERE session_id IN ('s-1', 's-2', 's-3') GROUP BY 1")
def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as NDJSON lines, a summary and its events, read back and counted."""
    out = None
    for s in ("s-1", "s-2", "s-3"):
        report, events = reports.session_events(priced(spark, sf_dir), s)
        lines = transcripts.session_frames(report.select("session_id", "n_events"), events.select("session_id", "cost", F.col("ord").alias("rank")))
        own = lines.select(F.from_json("value", "type string, session_id string, n_events long, cost double").alias("x"))
        own = own.groupBy("x.session_id").agg(F.count_if(F.col("x.type") == "event").alias("n_events"), F.round(F.sum("x.cost"), 8).alias("cost"))
        out = own if out is None else out.unionByName(own)
    return out


# --- blocks and windows ------------------------------------------------------------------------------------------


@query(f"{base()}{SAMPLES} SELECT ord FROM ev WHERE NOT EXISTS (SELECT 1 FROM win WHERE ms >= s AND ms < e)")
def outside_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = blocks.resolved_windows(fixtures.limit_samples(spark, sf_dir))
    return blocks.in_window(blocks.timed(fixtures.usage_events(spark, sf_dir)), windows, "left_anti").select("ord")


ACTIVE = f"""{walk_sql("session_id")}, a AS (SELECT k, block, last_ms, lag(block) OVER (PARTITION BY k ORDER BY block) AS p, row_number() OVER (PARTITION BY k ORDER BY block DESC) AS n FROM blk)"""


@query(f'{ACTIVE} SELECT k AS session_id, block AS start, block + {H5} AS "end", p AS prev_start, p + {H5} AS prev_end FROM a WHERE n = 1 AND {NOW} < block + {H5} AND {NOW} - last_ms < {H5}')
def active_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.active_frame(key_blocks(spark, sf_dir, now=NOW), ["session_id"])
    return found.select("session_id", "start", "end", "prev_start", "prev_end")


@query(f"{walk_sql('session_id')} SELECT k AS session_id, block AS start, n_events FROM blk WHERE strftime(timezone('{TZ}', timezone('UTC', make_timestamp(block * 1000))), '%Y-%m-%d') BETWEEN '2024-01-10' AND '2024-01-12'")
def blocks_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.starting_within(key_blocks(spark, sf_dir), TZ, "2024-01-10", "2024-01-12").select("session_id", "start", "n_events")


@query(f"""{base()}{SAMPLES}, r AS (SELECT s, e, source FROM win WHERE EXISTS (SELECT 1 FROM ev WHERE ms >= s AND ms < e)) SELECT s AS start, e AS "end", max(util) AS limit_pct FROM r LEFT JOIN samples ON captured_at BETWEEN s AND e GROUP BY ALL""")
def block_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of finished real blocks; at this late hour none is active."""
    samples = fixtures.limit_samples(spark, sf_dir)
    found = blocks.blocks(priced(spark, sf_dir), samples=samples, now=NOW + 400 * 24 * H1)
    return blocks.with_limit(found, samples).filter("source != 'heuristic'").select("start", "end", "limit_pct")


@query(f"{base()}{SAMPLES}, m AS (SELECT * FROM samples WHERE captured_at > {NOW}) SELECT captured_at, util FROM m")
def sample_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.unix_millis(F.to_timestamp(F.lit("2024-01-20T12:34:56Z")))
    return fixtures.limit_samples(spark, sf_dir).filter(F.col("captured_at") > since).select("captured_at", "util")

