"""Registered queries over streams, kept files, logs, merges and composed charts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import parent_slug
from ..operators import archive, blocks, compose, dims, intraday, reports
from ..operators.events import TOKENS, total
from ..sources import transcripts
from ..sources.shared import new_dir
from ..streaming import live
from . import fixtures, params
from .catalog import DAY, FAMILY, H1, H5, LOCAL, MIDNIGHT, NOW, PARENT, SAMPLES, SUM_TOKENS, TOT, TZ, base, daily_cost, grid, grid_sql, key_blocks, money, priced, query, report_sql, told, walk_sql
from .more import LINES, PLAIN, transcript_files

DAILY = base() + ", d AS (SELECT day AS date, sum(cost) AS cost FROM priced GROUP BY 1)"

# --- streams and kept files --------------------------------------------------------------------------------------

WON = f"""WITH l AS ({LINES.format(S='VARCHAR', events='events')}), w AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY input_tokens + output_tokens DESC, concat(slug, '/', session, '.jsonl'), event_id) AS n FROM l WHERE kind = 'good')"""


def streamed(spark: SparkSession, sf_dir: str, **more) -> str:
    """Transcripts through the stream until nothing is left; returns where the change feed is."""
    root, out = transcript_files(spark, sf_dir), new_dir(spark, "stream")
    run = live.merge_stream(live.transcript_stream(spark, root, "me"), f"{out}/feed", **more)
    run.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{out}/feed"


@query(f"{WON} SELECT message_id, session AS session_id, slug AS project_slug, input_tokens, output_tokens FROM w WHERE n = 1")
def stream_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.table(spark, streamed(spark, sf_dir)).select("message_id", "session_id", "project_slug", "input_tokens", "output_tokens")


@query(f"{WON} SELECT 'daily' AS report, strftime(ts, '%Y-%m-%d') AS key, count(*) AS n_events, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM w WHERE n = 1 GROUP BY 2 UNION ALL SELECT 'sessions', session, count(*), CAST(sum(input_tokens) AS BIGINT) FROM w WHERE n = 1 GROUP BY 2")
def stream_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of reports that the change feed keeps up."""
    day = F.date_format("ts", "yyyy-MM-dd")
    fold = lambda key: lambda e: e.groupBy("part", key.alias("key")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("input_tokens").alias("input_tokens"))
    families = [live.Family("daily", day, fold(day)), live.Family("sessions", F.pmod(F.xxhash64("session_id"), F.lit(16)), fold(F.col("session_id")))]
    kept = new_dir(spark, "kept")
    streamed(spark, sf_dir, on_change=lambda changed, table, n: live.refresh_parts(spark, kept, families, changed, table))
    daily, sessions = (live.report(spark, kept, f).select(F.lit(f.name).alias("report"), "key", "n_events", "input_tokens") for f in families)
    return daily.unionByName(sessions)


@query(f"WITH l AS ({LINES.format(S='VARCHAR', events='events')}) SELECT message_id, session AS session_id, slug AS project_slug, input_tokens FROM l WHERE kind = 'good' AND slug != 'proj-1'")
def scan_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that is kept, and then one after a project's files have gone, which parses nothing."""
    root, cache = transcript_files(spark, sf_dir), new_dir(spark, "cache")
    transcripts.cached(spark, root, "me", cache)
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/proj-1")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return transcripts.cached(spark, root, "me", cache).select("message_id", "session_id", "project_slug", "input_tokens")


# --- the log -----------------------------------------------------------------------------------------------------


def pushed(spark: SparkSession, events: DataFrame, parts: list[str]) -> str:
    """A log after a push of each part of the events, the last one twice."""
    path = new_dir(spark, "pushes")
    for i, part in enumerate([*parts, parts[-1]]):
        archive.appended(spark, path, events.filter(part), f"t{min(i, len(parts) - 1)}")
    return path


@query(f"{PLAIN} SELECT message_id, request_id, row_number() OVER (ORDER BY ord % 3, ord) AS seq FROM ev")
def log_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = pushed(spark, fixtures.usage_events(spark, sf_dir), ["ord % 3 = 0", "ord % 3 = 1", "ord % 3 = 2"])
    return archive.log(spark, path).select("message_id", "request_id", "seq")


@query(f"{PLAIN}, l AS (SELECT *, row_number() OVER (ORDER BY ord) AS seq FROM ev WHERE ord % 3 = 0) SELECT message_id, request_id, seq FROM l WHERE ord % 2 = 0")
def push_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.usage_events(spark, sf_dir)
    return archive.stamped(events.filter("ord % 2 = 0"), archive.log(spark, pushed(spark, events, ["ord % 3 = 0"])))


@query(f"{PLAIN}, r AS (SELECT CAST((row_number() OVER (ORDER BY ts, ord) - 1) // 1000 AS BIGINT) AS batch, ord, {TOT} AS t FROM ev WHERE ord % 3 != 0) SELECT batch, count(*) AS n_rows, min(ord) AS first, CAST(sum(t) AS BIGINT) AS total_tokens FROM r GROUP BY 1")
def push_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.usage_events(spark, sf_dir)
    rows = archive.push_batches(events, events.filter("ord % 3 = 0"))
    return rows.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("ord").alias("first"), F.sum(total()).alias("total_tokens"))


# --- aliases and merges ------------------------------------------------------------------------------------------

CHAIN = "SELECT CAST(c_custkey AS {S}) AS machine_id, CASE WHEN c_custkey % 11 != 0 THEN CAST((c_custkey * 7 + 3) % (c_custkey + 40) AS {S}) END AS merged_into FROM {t}"


@query(f"""WITH RECURSIVE m AS ({CHAIN.format(S='VARCHAR', t='customer')}), w AS (SELECT machine_id, machine_id AS cur, [machine_id] AS seen, false AS done FROM m
  UNION ALL SELECT w.machine_id, coalesce(n.merged_into, w.cur), list_append(w.seen, coalesce(n.merged_into, w.cur)), n.merged_into IS NULL OR list_contains(w.seen, n.merged_into) FROM w LEFT JOIN m n ON n.machine_id = w.cur WHERE NOT w.done)
SELECT machine_id, cur AS target FROM w WHERE done""")
def alias_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains, cycles and unknown targets among as many machines as there are customers."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return dims.alias_targets(spark.sql(CHAIN.format(S="string", t="{t}"), t=customers))


MERGES = """SELECT concat('m-', CAST(event_id % 3 AS {S})) AS author, concat('p-', CAST(user_id % 60 AS {S})) AS source,
  CASE WHEN event_id % 9 != 0 THEN concat('p-', CAST(event_id * 7 % 60 AS {S})) END AS target, lpad(CAST(event_id AS {S}), 12, '0') AS updated_at FROM {t}"""
#: Newest statements n, edges e, cycles ring, entries s, and where active edges lead.
MERGED = f"""WITH RECURSIVE a AS ({MERGES.format(S='VARCHAR', t='events')}), n AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY source ORDER BY updated_at DESC, author DESC) = 1),
e AS (SELECT source AS node, target AS t, updated_at AS o FROM n WHERE target IS NOT NULL AND target != source),
walk AS (SELECT node, t AS cur, o AS last, 1 AS step FROM e UNION ALL SELECT w.node, e.t, greatest(w.last, e.o), w.step + 1 FROM walk w JOIN e ON e.node = w.cur WHERE w.cur != w.node AND w.step < 70),
ring AS (SELECT node, max(last) AS last FROM walk WHERE cur = node GROUP BY 1),
s AS (SELECT n.*, CASE WHEN target IS NULL THEN 'unmerged' WHEN target = source THEN 'redundant' WHEN ring.last = updated_at THEN 'conflict' ELSE 'active' END AS status FROM n LEFT JOIN ring ON ring.node = n.source),
act AS (SELECT * FROM s WHERE status = 'active'),
way AS (SELECT source, target AS cur FROM act UNION ALL SELECT w.source, x.target FROM way w JOIN act x ON x.source = w.cur), ends AS (SELECT source, cur FROM way WHERE cur NOT IN (SELECT source FROM act))"""


@query(f"{MERGED} SELECT s.source, s.target, status, coalesce(cur, s.source) AS final FROM s LEFT JOIN ends USING (source)")
def project_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    entries, targets, _ = dims.resolved_merges(spark.sql(MERGES.format(S="string", t="{t}"), t=events))
    both = entries.join(targets.withColumnRenamed("group", "source_key").withColumnRenamed("target", "_final"), "source_key", "left")
    return both.select("source", "target", "status", F.coalesce("_final", "source").alias("final"))


@query(f"{MERGED} SELECT target, source, updated_at FROM act WHERE target NOT IN (SELECT source FROM act) QUALIFY row_number() OVER (PARTITION BY target ORDER BY updated_at DESC) = 1")
def merge_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return dims.resolved_merges(spark.sql(MERGES.format(S="string", t="{t}"), t=events))[2].select("target", "source", "updated_at")


@query(report_sql("day AS date", "project_slug LIKE 'proj-0%'", models=False))
def filter_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selected project with all that is folded into it."""
    events = priced(spark, sf_dir)
    slugs = events.select("project_slug").distinct().select("project_slug", parent_slug(F.col("project_slug")).alias("target"))
    _, q = params.common(tz=TZ, projects=dims.expanded(["proj-0"], slugs))
    return told(reports.daily(q.apply(events), TZ), ["date"], models=False)


@query(report_sql("day AS date", "day BETWEEN '2024-01-14' AND '2024-01-20' AND lower(model) LIKE '%opus%'", mode="calculate", models=False))
def filter_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    since, until = params.preset("7d", dt.date(2024, 1, 20))
    mode, q = params.common("calculate", TZ, since, until, models=["opus"])
    return told(reports.daily(q.apply(priced(spark, sf_dir, mode)), TZ), ["date"], models=False)


# --- names -------------------------------------------------------------------------------------------------------

NAMES = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(p_name) WHEN 1 THEN upper(p_name) WHEN 2 THEN concat('-', p_name) ELSE replace(p_name, ' ', '-') END AS name FROM {t}"


@query(f"WITH n AS ({NAMES.format(t='part')}) SELECT p_partkey, name, row_number() OVER (ORDER BY name COLLATE en, name, p_partkey) - 1 AS place FROM n")
def locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in locale order, which isn't that of their bytes."""
    rows = spark.sql(NAMES.format(t="{t}"), t=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return archive.ranked(rows.withColumn("_k", F.collate("name", "UNICODE")), ["_k", "name", "p_partkey"], "place").select("p_partkey", "name", "place")


# --- charts ------------------------------------------------------------------------------------------------------

WINDOW, BEFORE = params.chart_windows(dt.date(2024, 1, 15), dt.date(2024, 1, 20))
DAYS = tuple(x.isoformat() for x in WINDOW), tuple(x.isoformat() for x in BEFORE)


def framed_sql(metric: str) -> str:
    """f: events of both windows with frame, idx and folded axes; days; rk: projects by the current window."""
    amount = "cost" if metric == "cost" else TOT
    (a, b), (c, d) = DAYS
    return f"""{base()}, f AS (SELECT *, CASE WHEN day BETWEEN '{a}' AND '{b}' THEN 'current' ELSE 'previous' END AS frame, CASE WHEN day BETWEEN '{a}' AND '{b}' THEN CAST(day AS DATE) - DATE '{a}' ELSE CAST(day AS DATE) - DATE '{c}' END AS idx,
  machine_id AS machine, {FAMILY} AS fam, {PARENT} AS proj, {amount} AS amount FROM priced WHERE day BETWEEN '{c}' AND '{b}'),
days AS (SELECT CAST(range AS INT) AS idx, strftime(DATE '{a}' + CAST(range AS INT), '%Y-%m-%d') AS label, strftime(DATE '{c}' + CAST(range AS INT), '%Y-%m-%d') AS prev_label FROM range(DATE '{b}' - DATE '{a}' + 1)),
rk AS (SELECT proj, row_number() OVER (ORDER BY coalesce(sum(amount) FILTER (frame = 'current'), 0) DESC, proj COLLATE en, proj) AS k FROM f GROUP BY 1)"""


@query(f"""{framed_sql('tokens')}, g AS (SELECT f.* EXCLUDE (proj), CASE WHEN k <= 3 THEN f.proj ELSE '__other__' END AS project FROM f JOIN rk USING (proj)),
u AS (UNPIVOT (SELECT frame, idx, machine, project, {", ".join(TOKENS)} FROM g) ON {", ".join(TOKENS)} INTO NAME "tokenType" VALUE v),
s AS (SELECT * FROM days, (SELECT DISTINCT machine FROM f), (SELECT DISTINCT project FROM g), (SELECT DISTINCT "tokenType" FROM u))
SELECT s.idx, label, prev_label, s.machine, s.project, s."tokenType", CAST(coalesce(sum(v) FILTER (frame = 'current'), 0) AS BIGINT) AS value, CAST(coalesce(sum(v) FILTER (frame = 'previous'), 0) AS BIGINT) AS prev_value
FROM s LEFT JOIN u ON u.idx = s.idx AND u.machine = s.machine AND u.project = s.project AND u."tokenType" = s."tokenType" GROUP BY ALL""")
def chart_machine_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines, the first three projects and the kinds of tokens, with the window before as ghosts."""
    return compose.assembled(reports.dated(priced(spark, sf_dir), TZ), compose.Source(*DAYS), ["tokenType", "project", "machine"])


@query(f"""{framed_sql('cost')}, m AS (SELECT unnest(['Opus', 'Haiku']) AS model), s AS (SELECT * FROM days, m, (SELECT proj AS project FROM rk WHERE k <= 3 UNION ALL SELECT '__other__' WHERE (SELECT count(*) FROM rk) > 3)),
g AS (SELECT f.*, CASE WHEN k <= 3 THEN proj ELSE '__other__' END AS project FROM f JOIN rk USING (proj))
SELECT s.idx, label, prev_label, s.model, s.project, round(coalesce(sum(amount) FILTER (frame = 'current'), 0), 8) AS value, round(coalesce(sum(amount) FILTER (frame = 'previous'), 0), 8) AS prev_value
FROM s LEFT JOIN g ON g.idx = s.idx AND g.fam = s.model AND g.project = s.project GROUP BY ALL""")
def chart_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the model families by project, in costs."""
    source = compose.Source(*DAYS, kept={"model": ["Haiku", "Opus"]})
    rows = compose.assembled(reports.dated(priced(spark, sf_dir), TZ), source, ["model", "project"], "cost")
    return rows.select("idx", "label", "prev_label", "model", "project", *money("value", "prev_value"))


@query(f"""{framed_sql('tokens')}, t AS (SELECT idx, label, coalesce(sum(amount) FILTER (frame = 'current'), 0) AS now, coalesce(sum(amount) FILTER (frame = 'previous'), 0) AS bef,
  sum(cache_creation_tokens + cache_read_tokens) FILTER (frame = 'current') AS c FROM days LEFT JOIN f USING (idx) GROUP BY ALL)
SELECT idx, label, CAST(now AS BIGINT) AS total, CAST(bef AS BIGINT) AS prev_total, CAST(now - bef AS BIGINT) AS delta, round(100.0 * (now - bef) / nullif(bef, 0), 4) AS pct, CAST(CASE WHEN now > 0 THEN floor(100.0 * c / now + 0.5) END AS BIGINT) AS cache_pct FROM t""")
def chart_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compose.chart_totals(reports.dated(priced(spark, sf_dir), TZ), compose.Source(*DAYS))
    return rows.select("idx", "label", *(F.col(c).cast("long").alias(c) for c in ("total", "prev_total", "delta")), F.round("pct", 4).alias("pct"), F.col("cache_pct").cast("long").alias("cache_pct"))


@query(f"""{base()} SELECT day AS date, {FAMILY} AS family, {SUM_TOKENS}, CAST(sum({TOT}) AS BIGINT) AS tokens, round(sum(cost), 8) AS cost, round(sum(cost_output), 8) AS cost_output, round(sum(cost_cache), 8) AS cost_cache FROM priced GROUP BY 1, 2""")
def family_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.family_bands(reports.daily(priced(spark, sf_dir), TZ))
    return rows.select("date", "family", *TOKENS, "tokens", *money("cost", "cost_output", "cost_cache"))


@query(f"""{DAILY}, n AS (SELECT *, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM d), w AS (SELECT *, greatest(3, least(n, floor(n / 3 + 0.5))) AS k FROM n),
t AS (SELECT pow(10.0, greatest(floor(log10(min(cost) FILTER (cost > 0))), floor(log10(max(cost))) - 6)) AS th FROM d)
SELECT a.date, round((SELECT avg(b.cost) FROM w b WHERE b.i BETWEEN a.i - a.k + 1 AND a.i), 10) AS trend, round(CASE WHEN a.cost <= th THEN a.cost / th ELSE 1 + log10(a.cost / th) END, 6) AS scaled FROM w a, t""")
def trend_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with their trend, as wide as their number asks for, and on a symmetric log scale."""
    days = daily_cost(spark, sf_dir)
    width, threshold = compose.trend_width(days.count()), compose.linear_threshold(days, "cost").first()[0]
    return compose.moving_average(days, [], "date", width, "cost").select("date", F.round("moving_avg", 10).alias("trend"), F.round(compose.symlog(F.col("cost"), threshold), 6).alias("scaled"))


# --- grids and blocks --------------------------------------------------------------------------------------------

HALF_DAY = 12 * H1
AXES = {"total": ("NULL", "NULL"), "project": ("NULL", "project_slug"), "machine": ("machine_id", "NULL"), "machine-project": ("machine_id", "project_slug")}


def levels_sql() -> str:
    start, before = NOW - 14 * HALF_DAY, NOW - 28 * HALF_DAY
    v = " UNION ALL ".join(f"SELECT '{k}' AS level, {m} AS machine_id, {p} AS project_slug, frame, idx, * EXCLUDE (machine_id, project_slug, frame, idx) FROM placed" for k, (m, p) in AXES.items())
    return f"""{base()}, placed AS (SELECT CASE WHEN ms >= {start} THEN 'current' ELSE 'previous' END AS frame, CAST(CASE WHEN ms >= {start} THEN (ms - {start}) // {HALF_DAY} ELSE (ms - {before}) // {HALF_DAY} END AS INT) AS idx, * FROM priced WHERE ms >= {before} AND ms < {NOW}),
v AS ({v}), keys AS (SELECT DISTINCT level, machine_id, project_slug FROM v), s AS (SELECT * FROM keys, (VALUES ('current'), ('previous')) t(frame), (SELECT CAST(range AS INT) AS idx FROM range(14)))
SELECT s.level, s.machine_id, s.project_slug, s.frame, s.idx, CASE s.frame WHEN 'current' THEN {start} ELSE {before} END + s.idx * {HALF_DAY} AS bucket_start, count(v.ord) AS n_events, CAST(coalesce(sum(v.input_tokens), 0) AS BIGINT) AS input_tokens, round(coalesce(sum(v.cost), 0), 8) AS cost
FROM s LEFT JOIN v ON v.level = s.level AND v.frame = s.frame AND v.idx = s.idx AND v.machine_id IS NOT DISTINCT FROM s.machine_id AND v.project_slug IS NOT DISTINCT FROM s.project_slug GROUP BY ALL"""


@query(levels_sql())
def intraday_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, projects, machines and projects within machines in one pass."""
    rows = intraday.rolling(priced(spark, sf_dir), "7d", NOW, HALF_DAY, wanted=list(intraday.LEVELS))
    return rows.select("level", "machine_id", "project_slug", "frame", "idx", "bucket_start", "n_events", "input_tokens", *money("cost"))


PAST = NOW - NOW % 1000 - MIDNIGHT
STEP = intraday.today_line_bucket(PAST)
LINE = PAST // STEP + 1
CLOCK = f"(hour({LOCAL}) * 3600000 + minute({LOCAL}) * 60000 + second({LOCAL}) * 1000) // {STEP}"


@query(grid_sql(LINE, f"{MIDNIGHT} + idx * {STEP} - CASE frame WHEN 'previous' THEN 86400000 ELSE 0 END", f"""SELECT CASE day WHEN '{DAY}' THEN 'current' ELSE 'previous' END AS frame,
  CAST(CASE day WHEN '{DAY}' THEN least({CLOCK}, {LINE - 1}) ELSE {CLOCK} END AS INT) AS idx, * FROM priced WHERE day = '{DAY}' OR (day = '2024-01-19' AND {CLOCK} < {LINE})"""))
def today_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day so far at the step that a line wants."""
    return grid(intraday.today(priced(spark, sf_dir), NOW, TZ, STEP))


@query(f"{walk_sql('session_id')} SELECT (SELECT count(*) FROM blk) AS n_blocks, (SELECT string_agg(DISTINCT model, ',' ORDER BY model) FROM b) AS models")
def block_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.summary(key_blocks(spark, sf_dir, with_models=True)).select("n_blocks", F.array_join("models", ",").alias("models"))


@query(f"""{base()}{SAMPLES}, real AS (SELECT s, e FROM win WHERE EXISTS (SELECT 1 FROM ev WHERE ms >= s AND ms < e)), n AS (SELECT *, row_number() OVER (ORDER BY {NOW} < e DESC, e DESC, s) AS k FROM real)
SELECT s AS start, e AS "end", k = 1 AND {NOW} < e AS active, CASE WHEN k = 1 AND {NOW} < e THEN (SELECT arg_max(util, captured_at) FROM samples) ELSE max(util) END AS limit_pct FROM n LEFT JOIN samples ON captured_at BETWEEN s AND e GROUP BY s, e, k""")
def block_limits_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At an hour when a real block is active: its limit is the latest sample's, that of others their peak."""
    samples = fixtures.limit_samples(spark, sf_dir)
    found = blocks.with_limit(blocks.blocks(priced(spark, sf_dir), samples=samples, now=NOW), samples)
    return found.filter("source != 'heuristic'").select("start", "end", "active", "limit_pct")


ACTIVE = f"""{walk_sql("session_id")}{SAMPLES}, a AS (SELECT k, block, last_ms, lag(block) OVER (PARTITION BY k ORDER BY block) AS p, row_number() OVER (PARTITION BY k ORDER BY block DESC) AS n FROM blk), f AS (SELECT * FROM a WHERE n = 1 AND {NOW} < block + {H5} AND {NOW} - last_ms < {H5})"""


@query(f"""{ACTIVE}, x AS (SELECT k, 'current' AS frame, block AS b FROM f UNION ALL SELECT k, 'previous', p FROM f WHERE p IS NOT NULL) SELECT k AS session_id, frame, s AS start, e AS "end" FROM x JOIN win ON s < b + {H5} AND e > b""")
def active_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The real windows that the running heuristic blocks, and those before them, leave out."""
    windows = blocks.resolved_windows(fixtures.limit_samples(spark, sf_dir))
    found = blocks.active_frame(key_blocks(spark, sf_dir, now=NOW), ["session_id"], windows)
    part = lambda frame, c: found.select("session_id", F.lit(frame).alias("frame"), F.inline(c))
    return part("current", "exclusions").unionByName(part("previous", "prev_exclusions"))
