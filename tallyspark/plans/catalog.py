"""The registered queries and the DuckDB SQL that says the same. Parameters are pinned inside the range of the events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pricing

from ..operators import archive, blocks, compose, dims, intraday, reports
from ..operators.events import TOKENS, Query, total, unseen
from . import fixtures

TZ, NOW, DAY = "America/Chicago", 1_705_754_096_000, "2024-01-20"
SINCE, UNTIL = "2024-01-08", "2024-01-19"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Q = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def priced(spark: SparkSession, sf_dir: str, mode: str = "auto") -> DataFrame:
    return pricing.with_cost(fixtures.usage_events(spark, sf_dir), fixtures.prices(spark), mode)


def money(*names: str) -> list[Column]:
    return [F.round(n, 8).alias(n) for n in names]


COSTS = ["cost", "cost_input", "cost_output", "cost_cache"]

# --- the common tables of the SQL --------------------------------------------------------------------------------

VALUES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" for x in row) + ")" for row in fixtures.PRICES)
TOT = "(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens)"
MATCH = "(SELECT {c} FROM prices WHERE model_key = {k})"


def base(mode: str = "auto") -> str:
    """raw, ev (deduplicated, ms added), prices and priced."""
    keys = ["model", "tail", "regexp_replace(model, '-[0-9]{8}$', '')", "regexp_replace(tail, '-[0-9]{8}$', '')"]
    key = "coalesce(" + ", ".join(MATCH.format(c="model_key", k=k) for k in keys) + ")"
    cost = {"auto": "coalesce(cost_usd, computed)", "calculate": "computed", "display": "coalesce(cost_usd, 0)"}[mode]
    return f"""WITH RECURSIVE raw AS ({fixtures.RAW.format(S="VARCHAR", events="events")}),
ev AS (SELECT * EXCLUDE (rn, ord, o), o AS ord, (epoch_us(ts) // 1000) AS ms FROM (SELECT *, row_number() OVER (PARTITION BY message_id, request_id ORDER BY {TOT} DESC, ord) AS rn,
  min(ord) OVER (PARTITION BY message_id, request_id) AS o FROM raw) WHERE rn = 1),
prices(model_key, input, output, cache_create, cache_read) AS (VALUES {VALUES}),
names AS (SELECT model, {key} AS price_key FROM (SELECT DISTINCT model, regexp_extract(model, '[^/]*$') AS tail FROM ev)),
parts AS (SELECT e.*, n.price_key, input_tokens * coalesce(p.input, 0) AS c0, output_tokens * coalesce(p.output, 0) AS c1,
  cache_creation_tokens * coalesce(p.cache_create, 0) + cache_read_tokens * coalesce(p.cache_read, 0) AS c2 FROM ev e JOIN names n USING (model) LEFT JOIN prices p ON p.model_key = n.price_key),
totals AS (SELECT *, c0 + c1 + c2 AS computed FROM parts), costs AS (SELECT *, {cost} AS cost FROM totals),
scaled AS (SELECT *, CASE WHEN computed > 0 THEN cost / computed ELSE 0 END AS sc FROM costs),
priced AS (SELECT *, c0 * sc AS cost_input, c1 * sc AS cost_output, c2 * sc AS cost_cache, strftime(ts, '%Y-%m-%d') AS date,
  strftime(timezone('{TZ}', timezone('UTC', ts)), '%Y-%m-%d') AS day FROM scaled)"""


SUM_TOKENS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in TOKENS)
SUM_COSTS = ", ".join(f"round(sum({c}), 8) AS {c}" for c in COSTS)
SUMS = f"count(*) AS n_events, {SUM_TOKENS}, {SUM_COSTS}"


def report_sql(keys: str, where: str = "true", mode: str = "auto", models: bool = True) -> str:
    names = [k.split(" AS ")[-1] for k in keys.split(", ")]
    by = ", ".join(k.split(" AS ")[0] for k in keys.split(", "))
    out = f"{base(mode)}, rep AS (SELECT {keys}, {SUMS} FROM priced WHERE {where} GROUP BY {by})"
    if not models:
        return out + " SELECT * FROM rep"
    on = ", ".join(names)
    return f"""{out}, seen AS (SELECT {keys}, model, min(ts) AS f, arg_min(ord, ts) AS o FROM priced WHERE {where} GROUP BY {by}, model),
listed AS (SELECT {on}, string_agg(model, ',' ORDER BY f, o) AS models FROM seen GROUP BY {on}) SELECT rep.*, models FROM rep JOIN listed USING ({on})"""


def told(report: DataFrame, keys: list[str], models: bool = True) -> DataFrame:
    return report.select(*keys, "n_events", *TOKENS, *money(*COSTS), *([F.array_join("models", ",").alias("models")] if models else []))


# --- events, prices ----------------------------------------------------------------------------------------------


@query(base() + f" SELECT message_id, request_id, session_id, model, {TOT} AS total_tokens, ord FROM ev")
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.usage_events(spark, sf_dir).select("message_id", "request_id", "session_id", "model", total().alias("total_tokens"), "ord")


@query(base() + " SELECT ord, model, price_key, round(cost, 9) AS cost, round(computed, 9) AS computed, round(cost_input, 9) AS cost_input FROM priced")
def priced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).select("ord", "model", "price_key", *(F.round(c, 9).alias(c) for c in ("cost", "computed", "cost_input")))


@query(base() + " SELECT model, price_key FROM names")
def model_key_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = fixtures.usage_events(spark, sf_dir).select("model").distinct()
    return pricing.with_price(models, fixtures.prices(spark)).select("model", "price_key")


@query("SELECT concat('claude-', lower(n_name)) AS model_key, CAST(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey ELSE -n_nationkey END AS DOUBLE) / 1000 AS input FROM nation")
def price_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that lacks two models of three, filled up from another one, which has all at other prices."""
    k = F.col("n_nationkey")
    table = spark.read.parquet(f"{sf_dir}/nation.parquet").select(k, F.concat(F.lit("claude-"), F.lower("n_name")).alias("model_key"))
    made = lambda rows, price: rows.select("model_key", (price / 1000).alias("input"), *(F.lit(None).cast("double").alias(c) for c in ("output", "cache_create", "cache_read")))
    return pricing.gap_filled(made(table.filter(k % 3 == 0), k), made(table, -k)).select("model_key", "input")


# --- days --------------------------------------------------------------------------------------------------------


@query(report_sql("date"))
def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(reports.daily(priced(spark, sf_dir)), ["date"])


@query(report_sql("day AS date"))
def daily_tz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(reports.daily(priced(spark, sf_dir), TZ), ["date"])


@query(report_sql("day AS date", mode="display", models=False))
def daily_mode_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(reports.daily(priced(spark, sf_dir, "display"), TZ), ["date"], models=False)


@query(report_sql("day AS date", mode="calculate", models=False))
def daily_mode_calculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(reports.daily(priced(spark, sf_dir, "calculate"), TZ), ["date"], models=False)


@query(base() + f" SELECT {SUMS} FROM priced")
def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(reports.daily(priced(spark, sf_dir), TZ)).select("n_events", *TOKENS, *money(*COSTS))


@query(report_sql("project_slug, day AS date"))
def daily_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(reports.daily_by_project(priced(spark, sf_dir), TZ), ["project_slug", "date"])


@query(report_sql("machine_id, day AS date"))
def daily_by_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(reports.daily_by_machine(priced(spark, sf_dir), TZ), ["machine_id", "date"])


@query(report_sql("machine_id, project_slug, day AS date", models=False))
def daily_by_machine_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(reports.daily_by_machine(priced(spark, sf_dir), TZ, by_project=True), ["machine_id", "project_slug", "date"], models=False)


@query(base() + f" SELECT day AS date, model, {SUM_TOKENS}, round(sum(cost), 8) AS cost FROM priced GROUP BY day, model")
def model_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.daily(priced(spark, sf_dir), TZ).select("date", F.inline("breakdown"))
    return rows.select("date", "model", *TOKENS, *money("cost"))


@query(base() + ", f AS (SELECT project_slug, model, min(ts) AS t FROM priced GROUP BY ALL) SELECT project_slug, string_agg(model, ',' ORDER BY t) AS models, count(*) AS n_models FROM f GROUP BY 1")
def models_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.rollup(priced(spark, sf_dir), ["project_slug"])
    return report.select("project_slug", F.array_join("models", ",").alias("models"), F.size("models").cast("long").alias("n_models"))


@query(f"""{base()}, d AS (SELECT strftime(x, '%Y-%m-%d') AS date FROM generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY) t(x)),
r AS (SELECT day, count(*) AS n, sum(cost) AS c FROM priced GROUP BY day) SELECT date, coalesce(n, 0) AS n_events, round(coalesce(c, 0), 8) AS cost FROM d LEFT JOIN r ON r.day = d.date""")
def densify_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.densified(reports.daily(priced(spark, sf_dir), TZ), "2023-12-28", "2024-02-03").select("date", "n_events", *money("cost"))


@query(base() + f" SELECT day AS date, band, CAST(sum(value) AS BIGINT) AS value FROM (UNPIVOT (SELECT day, {', '.join(TOKENS)} FROM priced) ON {', '.join(TOKENS)} INTO NAME band VALUE value) GROUP BY ALL")
def token_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.token_bands(reports.daily(priced(spark, sf_dir), TZ).drop("models", "breakdown"))


@query(f"{base()} SELECT day AS date, 2 * count(*) AS n_events, round(2 * sum(cost), 8) AS cost FROM priced GROUP BY day")
def merged_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.daily(priced(spark, sf_dir), TZ)
    return reports.merged_rows(report, report).select("date", "n_events", *money("cost"))


# --- filters -----------------------------------------------------------------------------------------------------


def filtered(spark: SparkSession, sf_dir: str, **axes) -> DataFrame:
    return told(reports.daily(Query(tz=TZ, **axes).apply(priced(spark, sf_dir)), TZ), ["date"], models=False)


@query(report_sql("day AS date", "lower(model) LIKE '%opus%' OR lower(model) LIKE '%sonnet%'", models=False))
def filter_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, models=["OPUS", "sonnet"])


@query(report_sql("day AS date", "project_slug = 'proj-2' OR project_slug LIKE 'proj-2--claude-worktrees-%'", models=False))
def filter_project_worktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, projects=["proj-2"])


@query(report_sql("day AS date", "machine_id IN ('mach-1', 'mach-2') AND session_id = 's-7'", models=False))
def filter_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, machines=["mach-1", "mach-2"], sessions=["s-7"])


@query(report_sql("day AS date", f"day BETWEEN '{SINCE}' AND '{UNTIL}'", models=False))
def filter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, since=SINCE.replace("-", ""), until=UNTIL.replace("-", ""))


# --- sessions, projects ------------------------------------------------------------------------------------------

SESSIONS = f"""{base()}, s AS (SELECT session_id, arg_min(project_slug, ts) AS project_slug, arg_max(machine_id, ts) AS machine_id, max(day) AS last_activity, {SUMS} FROM priced GROUP BY session_id)"""
SESSION_COLUMNS = ["session_id", "project_slug", "machine_id", "last_activity"]


@query(SESSIONS + " SELECT * FROM s")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(reports.sessions(priced(spark, sf_dir), TZ), SESSION_COLUMNS, models=False)


@query(f"{SESSIONS} SELECT * FROM s WHERE last_activity BETWEEN '2024-01-24' AND '2024-01-28'")
def sessions_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(reports.sessions(priced(spark, sf_dir), TZ, "2024-01-24", "2024-01-28"), SESSION_COLUMNS, models=False)


@query(f"{SESSIONS} SELECT session_id, project_slug, cost FROM (SELECT session_id, project_slug, cost, row_number() OVER (ORDER BY cost DESC, project_slug, session_id) AS n FROM s) WHERE n <= 5")
def top5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = reports.sessions(priced(spark, sf_dir), TZ).orderBy(*reports.session_order()).limit(5)
    return best.select("session_id", "project_slug", *money("cost"))


@query(base() + " SELECT ord, model, round(cost, 9) AS cost FROM priced WHERE session_id = 's-7'")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.session_events(priced(spark, sf_dir), "s-7")[1].select("ord", "model", F.round("cost", 9).alias("cost"))


@query(f"""{base()}, w AS (SELECT *, day BETWEEN '{SINCE}' AND '{UNTIL}' AS i FROM priced)
SELECT project_slug, min(day) AS first_activity, max(day) FILTER (i) AS last_activity, count(*) FILTER (i) AS n_events, count(DISTINCT session_id) FILTER (i) AS n_sessions,
  count(DISTINCT machine_id) FILTER (i) AS n_machines, CAST(sum(input_tokens) FILTER (i) AS BIGINT) AS input_tokens, round(sum(cost) FILTER (i), 8) AS cost FROM w GROUP BY 1 HAVING count(*) FILTER (i) > 0""")
def projects_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.projects(priced(spark, sf_dir), TZ, SINCE, UNTIL)
    return out.select("project_slug", "first_activity", "last_activity", "n_events", "n_sessions", "n_machines", "input_tokens", *money("cost"))


@query(f"""{base()}, p AS (SELECT project_slug, sum(cost) AS c, count(*) AS n FROM priced GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY c DESC, project_slug) AS k FROM p)
SELECT CASE WHEN k <= 5 THEN project_slug ELSE '__other__' END AS project_slug, CAST(sum(n) AS BIGINT) AS n_events, round(sum(c), 8) AS cost FROM r GROUP BY 1""")
def topn_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_and_other(priced(spark, sf_dir)).select("project_slug", "n_events", *money("cost"))


@query(f"{SESSIONS} SELECT count(*) AS n_sessions, round(sum(cost), 4) AS cost, round(100.0 * sum(cache_read_tokens) / sum(input_tokens + cache_creation_tokens + cache_read_tokens), 8) AS cache_hit_pct FROM s")
def cache_hit_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.session_summary(reports.sessions(priced(spark, sf_dir), TZ))
    return out.select("n_sessions", F.round("cost", 4).alias("cost"), *money("cache_hit_pct"))


FAMILY = "CASE " + " ".join(f"WHEN lower(model) LIKE '%{n}%' THEN '{n.capitalize()}'" for n in pricing.FAMILIES) + " ELSE 'Unknown' END"


@query(f"{base()}, f AS (SELECT project_slug, {FAMILY} AS family, sum(cost) AS c FROM priced GROUP BY ALL) SELECT project_slug, arg_max(family, c) AS top_family FROM f GROUP BY 1")
def top_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_family(priced(spark, sf_dir), ["project_slug"])


@query(f"{base()}, f AS (SELECT {FAMILY} AS family, sum(cost) AS c FROM priced GROUP BY 1) SELECT family, round(c, 8) AS value, round(100 * c / (SELECT sum(c) FROM f), 8) AS pct FROM f WHERE c > 0")
def family_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_family(priced(spark, sf_dir)).select("family", *money("value", "pct"))


# --- blocks ------------------------------------------------------------------------------------------------------

H5, H1 = 18_000_000, 3_600_000


def walk_sql(key: str) -> str:
    """The heuristic walk, event by event, as a recursion over each key's numbered events: b has block for each event."""
    return f"""{base()}, e AS (SELECT *, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY ms, ord) AS rn FROM priced),
walk AS (SELECT k, rn, ms, ms - ms % {H1} AS block FROM e WHERE rn = 1 UNION ALL
  SELECT e.k, e.rn, e.ms, CASE WHEN e.ms - w.block > {H5} OR e.ms - w.ms > {H5} THEN e.ms - e.ms % {H1} ELSE w.block END FROM walk w JOIN e ON e.k = w.k AND e.rn = w.rn + 1),
b AS (SELECT e.*, w.block FROM e JOIN walk w ON w.k = e.k AND w.rn = e.rn),
blk AS (SELECT k, block, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n_events, CAST(sum({TOT}) AS BIGINT) AS all_tokens, sum(cost) AS all_cost FROM b GROUP BY k, block)"""


def key_blocks(spark: SparkSession, sf_dir: str, key: str = "session_id", **more) -> DataFrame:
    return blocks.blocks(priced(spark, sf_dir), [key], **more)


BLOCK = "first_ms, last_ms, n_events, all_tokens, round(all_cost, 8) AS all_cost"
BLOCK_COLUMNS = ["first_ms", "last_ms", "n_events", "all_tokens"]


@query(f"{walk_sql('session_id')} SELECT k AS session_id, block AS start, {BLOCK} FROM blk")
def blocks_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_blocks(spark, sf_dir).select("session_id", "start", *BLOCK_COLUMNS, *money("all_cost"))


@query(f"{walk_sql('1')} SELECT block AS start, {BLOCK} FROM blk")
def blocks_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.blocks(priced(spark, sf_dir)).select("start", *BLOCK_COLUMNS, *money("all_cost"))


@query(f'{walk_sql("session_id")}, g AS (SELECT k, lag(last_ms) OVER (PARTITION BY k ORDER BY block) AS p, first_ms FROM blk) SELECT k AS session_id, p + {H5} AS start, first_ms AS "end" FROM g WHERE first_ms - p > {H5}')
def block_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.gaps(key_blocks(spark, sf_dir), ["session_id"])


@query(f"""{walk_sql("session_id")} SELECT k AS session_id, block AS start, round(all_tokens / ((last_ms - first_ms) / 60000), 8) AS tokens_per_minute,
  round(all_cost / ((last_ms - first_ms) / 60000) * 60, 8) AS cost_per_hour FROM blk WHERE last_ms > first_ms""")
def block_burn_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = blocks.with_rates(key_blocks(spark, sf_dir), NOW).filter("tokens_per_minute IS NOT NULL")
    return rated.select("session_id", "start", *money("tokens_per_minute", "cost_per_hour"))


@query(f"""{walk_sql("session_id")}, a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY block DESC) AS n FROM blk WHERE {NOW} < block + {H5} AND {NOW} - last_ms < {H5}),
m AS (SELECT *, (last_ms - first_ms) / 60000 AS mi, greatest(0, (block + {H5} - {NOW}) / 60000) AS le FROM a WHERE n = 1)
SELECT k AS session_id, block AS start, CAST(CASE WHEN mi > 0 THEN floor(all_tokens + all_tokens / mi * le + 0.5) END AS BIGINT) AS projected_tokens,
  CAST(CASE WHEN mi > 0 THEN floor(le + 0.5) END AS BIGINT) AS remaining_minutes FROM m""")
def block_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = blocks.with_rates(key_blocks(spark, sf_dir, now=NOW), NOW).filter("active")
    return rated.select("session_id", "start", F.col("projected_tokens").cast("long"), F.col("remaining_minutes").cast("long"))


@query(f"""{walk_sql("session_id")} SELECT k AS session_id, block AS start, CAST(sum({TOT}) AS BIGINT) AS all_tokens, count(*) FILTER (lower(model) LIKE '%opus%' AND machine_id = 'mach-1') AS n_events,
  CAST(coalesce(sum(input_tokens) FILTER (lower(model) LIKE '%opus%' AND machine_id = 'mach-1'), 0) AS BIGINT) AS input_tokens FROM b GROUP BY k, block""")
def blocks_filtered_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_blocks(spark, sf_dir, models=["opus"], machines=["mach-1"]).select("session_id", "start", "all_tokens", "n_events", "input_tokens")


@query(f"{walk_sql('session_id')} SELECT count(*) AS n_blocks, median(all_tokens) AS typical_tokens FROM blk")
def median_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.summary(key_blocks(spark, sf_dir)).select("n_blocks", "typical_tokens")


SAMPLES = f""", samples AS (SELECT (epoch_us(ts) // 1000) AS captured_at, CAST(event_id % 101 AS DOUBLE) AS util,
  (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % {H5} + {H5} + (event_id % 7 - 3) * 1000 - CASE WHEN event_id % 400 = 0 THEN {H1} ELSE 0 END AS reset_at FROM events WHERE event_id % 40 = 0),
obs AS (SELECT DISTINCT CAST(floor(reset_at / 60000 + 0.5) * 60000 AS BIGINT) - {H5} AS s, CAST(floor(reset_at / 60000 + 0.5) * 60000 AS BIGINT) AS e FROM samples WHERE util > 0),
nxt AS (SELECT *, lead(s) OVER (ORDER BY e) AS n FROM obs), win AS (SELECT s, CASE WHEN n < e THEN n ELSE e END AS e, CASE WHEN n < e THEN 'annulled' ELSE 'observed' END AS source FROM nxt)"""


@query(base() + SAMPLES + ' SELECT s AS start, e AS "end" FROM obs')
def observed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.observed_windows(fixtures.limit_samples(spark, sf_dir))


@query(base() + SAMPLES + ' SELECT s AS start, e AS "end", source FROM win')
def resolved_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.resolved_windows(fixtures.limit_samples(spark, sf_dir))


@query(base() + SAMPLES + " SELECT ord, s AS w_start, source AS w_source FROM ev LEFT JOIN win ON ms >= s AND ms < e")
def event_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = blocks.resolved_windows(fixtures.limit_samples(spark, sf_dir))
    return blocks.in_window(blocks.timed(fixtures.usage_events(spark, sf_dir)), windows).select("ord", "w_start", "w_source")


@query(base() + SAMPLES + ' SELECT s AS start, e AS "end", source, max(util) AS peak FROM win LEFT JOIN samples ON captured_at BETWEEN s AND e GROUP BY ALL')
def window_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = fixtures.limit_samples(spark, sf_dir)
    return blocks.window_peaks(blocks.resolved_windows(samples), samples)


@query(base() + SAMPLES + f""", placed AS (SELECT p.*, s, e, source FROM priced p LEFT JOIN win ON ms >= s AND ms < e),
r AS (SELECT *, row_number() OVER (ORDER BY ms, ord) AS rn FROM placed WHERE s IS NULL),
walk AS (SELECT rn, ms, ms - ms % {H1} AS block FROM r WHERE rn = 1 UNION ALL
  SELECT r.rn, r.ms, CASE WHEN r.ms - w.block > {H5} OR r.ms - w.ms > {H5} THEN r.ms - r.ms % {H1} ELSE w.block END FROM walk w JOIN r ON r.rn = w.rn + 1)
SELECT block AS start, block + {H5} AS "end", 'heuristic' AS source, count(*) AS n_events, round(sum(cost), 8) AS cost FROM r JOIN walk USING (rn) GROUP BY block
UNION ALL SELECT s, e, source, count(*), round(sum(cost), 8) FROM placed WHERE s IS NOT NULL GROUP BY s, e, source""")
def blocks_with_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, samples = priced(spark, sf_dir), fixtures.limit_samples(spark, sf_dir)
    return blocks.blocks(events, samples=samples).select("start", "end", "source", "n_events", *money("cost"))


# --- intraday ----------------------------------------------------------------------------------------------------

M15 = 900_000


def grid_sql(count: int, start: str, placed: str, axis: str = "") -> str:
    """Buckets of frames from placed (frame, idx, cost and, with an axis, its column)."""
    more = f"{axis}, " if axis else ""
    spine = f"SELECT frame, {more}idx FROM (SELECT DISTINCT frame{', ' + axis if axis else ''} FROM placed), (SELECT CAST(range AS INT) AS idx FROM range({count}))" if axis else f"SELECT frame, CAST(range AS INT) AS idx FROM (VALUES ('current'), ('previous')) t(frame), range({count})"
    return f"""{base()}, placed AS ({placed}), spine AS ({spine}), g AS (SELECT frame, {more}idx, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS t, sum(cost) AS c FROM placed GROUP BY ALL)
SELECT frame, {more}idx, {start} AS bucket_start, coalesce(n, 0) AS n_events, coalesce(t, 0) AS input_tokens, round(coalesce(c, 0), 8) AS cost FROM spine LEFT JOIN g USING (frame, {more}idx)"""


def rolling_sql(count: int, ms: int, axis: str = "") -> str:
    start, before = NOW - count * ms, NOW - 2 * count * ms
    placed = f"""SELECT 'current' AS frame, CAST(floor((ms - {start}) / {ms}) AS INT) AS idx, * FROM priced WHERE ms >= {start} AND ms < {NOW}
    UNION ALL SELECT 'previous', CAST(floor((ms - {before}) / {ms}) AS INT), * FROM priced WHERE ms >= {before} AND ms < {start}"""
    return grid_sql(count, f"CASE frame WHEN 'current' THEN {start} ELSE {before} END + idx * {ms}", placed, axis)


def grid(df: DataFrame, *axes: str) -> DataFrame:
    return df.select("frame", *axes, "idx", "bucket_start", "n_events", "input_tokens", *money("cost"))


@query(rolling_sql(60, 60_000))
def intraday_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(intraday.rolling(priced(spark, sf_dir), "1h", NOW))


@query(rolling_sql(672, M15, "project_slug"))
def intraday_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(intraday.rolling(priced(spark, sf_dir), "7d", NOW, axes=("project_slug",)), "project_slug")


LOCAL = f"timezone('{TZ}', timezone('UTC', ts))"
# 06:34:56 local: seven hourly buckets; midnight is 06:00Z
MIDNIGHT = 1_705_730_400_000


@query(grid_sql(7, f"{MIDNIGHT} + idx * {H1} - CASE frame WHEN 'previous' THEN 86400000 ELSE 0 END", f"""SELECT CASE day WHEN '{DAY}' THEN 'current' ELSE 'previous' END AS frame,
  CASE day WHEN '{DAY}' THEN least(hour({LOCAL}), 6) ELSE hour({LOCAL}) END AS idx, * FROM priced WHERE day = '{DAY}' OR (day = '2024-01-19' AND hour({LOCAL}) < 7)"""))
def today_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(intraday.today(priced(spark, sf_dir), NOW, TZ))


BLOCK_START, BEFORE_START, STEP = NOW - NOW % H1 - 2 * H1, NOW - NOW % H1 - 7 * H1, 600_000


@query(grid_sql(16, f"CASE frame WHEN 'current' THEN {BLOCK_START} ELSE {BEFORE_START} END + idx * {STEP}", f"""SELECT 'current' AS frame, CAST(least(floor((ms - {BLOCK_START}) / {STEP}), 15) AS INT) AS idx, * FROM priced WHERE ms >= {BLOCK_START} AND ms < {BLOCK_START + H5}
  UNION ALL SELECT 'previous', CAST(floor((ms - {BEFORE_START}) / {STEP}) AS INT), * FROM priced WHERE ms >= {BEFORE_START} AND ms < {BEFORE_START + 16 * STEP}"""))
def block_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(intraday.block_frame(priced(spark, sf_dir), BLOCK_START, BLOCK_START + H5, NOW, (BEFORE_START, BEFORE_START + H5), STEP))


# --- series ------------------------------------------------------------------------------------------------------

DAILY = base() + ", d AS (SELECT day AS date, sum(cost) AS cost FROM priced GROUP BY 1)"


def daily_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dated(priced(spark, sf_dir), TZ).groupBy("date").agg(F.sum("cost").alias("cost"))


@query(DAILY + " SELECT date, round(sum(cost) OVER (ORDER BY date), 8) AS cumulative FROM d")
def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.cumulative(daily_cost(spark, sf_dir), [], "date", "cost").select("date", *money("cumulative"))


@query(DAILY + " SELECT date, round(avg(cost) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 8) AS moving_avg FROM d")
def moving_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.moving_average(daily_cost(spark, sf_dir), [], "date", 7, "cost").select("date", *money("moving_avg"))


@query(base() + ", d AS (SELECT project_slug, day AS date, sum(cost) AS c FROM priced GROUP BY ALL) SELECT project_slug, date, round(c, 8) AS cost FROM d WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY project_slug ORDER BY c DESC, date) = 1")
def peak_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.dated(priced(spark, sf_dir), TZ).groupBy("project_slug", "date").agg(F.sum("cost").alias("cost"))
    return compose.peaks(rows, ["project_slug"], "date", "cost").select("project_slug", "date", *money("cost"))


@query(f"""{base()}, d AS (SELECT day, sum(cost) AS c FROM priced GROUP BY 1) SELECT a.day AS date, round(a.c, 8) AS now, round(coalesce(b.c, 0), 8) AS before, round(a.c - coalesce(b.c, 0), 8) AS delta,
  round(100 * (a.c - coalesce(b.c, 0)) / nullif(coalesce(b.c, 0), 0), 4) AS pct FROM d a LEFT JOIN d b ON CAST(b.day AS DATE) = CAST(a.day AS DATE) - 1""")
def delta_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily_cost(spark, sf_dir)
    before = days.select(F.date_format(F.date_add("date", 1), "yyyy-MM-dd").alias("date"), "cost")
    return reports.deltas(days, before, "date").select("date", *money("now", "before", "delta"), F.round("pct", 4).alias("pct"))


@query(f"""{base()}, u AS (UNPIVOT (SELECT day AS date, {FAMILY} AS model, {", ".join(TOKENS)} FROM priced) ON {", ".join(TOKENS)} INTO NAME "tokenType" VALUE v),
s AS (SELECT d.date, m.model, t."tokenType" FROM (SELECT DISTINCT date FROM u) d, (SELECT DISTINCT model FROM u WHERE model != 'Unknown') m, (SELECT DISTINCT "tokenType" FROM u) t)
SELECT s.date, s.model, s."tokenType", CAST(coalesce(sum(v), 0) AS BIGINT) AS value FROM s LEFT JOIN u USING (date, model, "tokenType") GROUP BY ALL""")
def compose_model_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = reports.dated(priced(spark, sf_dir), TZ)
    return compose.series(events, ["tokenType", "model"], events.select("date").distinct())


# --- dimensions, archive -----------------------------------------------------------------------------------------

PARENT = "CASE WHEN instr(project_slug, '--claude-worktrees-') > 1 THEN substr(project_slug, 1, instr(project_slug, '--claude-worktrees-') - 1) ELSE project_slug END"


@query(f'{base()} SELECT {PARENT} AS "group", count(DISTINCT project_slug) AS n_members, {SUM_TOKENS}, round(sum(cost), 8) AS cost FROM priced GROUP BY 1')
def worktree_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = priced(spark, sf_dir).groupBy("project_slug").agg(*(F.sum(c).alias(c) for c in [*TOKENS, "cost"]))
    return dims.worktree_fold(report, [*TOKENS, "cost"]).select("group", "n_members", *TOKENS, *money("cost"))


IDENTITY = "SELECT machine_id, project_slug, CASE WHEN ord % 3 = 0 THEN NULL ELSE concat('host/repo-', CAST(ord % 4 AS {S})) END AS repo_id, ord % 1000 AS probed_at FROM {t}"


@query(f"{base()}, i AS ({IDENTITY.format(S='VARCHAR', t='ev')} WHERE project_slug NOT LIKE '_%--claude-worktrees-%'), g AS (SELECT machine_id, project_slug, probed_at, max(repo_id) AS repo_id FROM i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY project_slug ORDER BY probed_at DESC, machine_id) AS n FROM g) SELECT project_slug, coalesce(repo_id, project_slug) AS group_key FROM r WHERE n = 1")
def identity_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(IDENTITY.format(S="string", t="{ev}"), ev=fixtures.usage_events(spark, sf_dir))
    rows = rows.groupBy("machine_id", "project_slug", "probed_at").agg(F.max("repo_id").alias("repo_id"))
    return dims.newest_identity(rows)


#: Every machine of the events is merged into the one before it, the first into none; two more are merged into each other.
ALIASES = "SELECT DISTINCT machine_id, CASE WHEN machine_id != 'mach-0' THEN concat('mach-', CAST(CAST(substr(machine_id, 6, 9) AS INT) - 1 AS {S})) END AS merged_into FROM {ev}"


@query(f"{base()} SELECT 'mach-0' AS machine_id, {SUM_TOKENS} FROM priced")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.usage_events(spark, sf_dir)
    machines = spark.sql(ALIASES.format(S="string", ev="{ev}"), ev=events)
    return dims.folded(events, "machine_id", dims.alias_targets(machines), TOKENS)


@query(base() + " SELECT machine_id, count(*) AS n_events, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(max(ts)) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS last_event FROM ev GROUP BY 1")
def machine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.machine_stats(fixtures.usage_events(spark, sf_dir))


@query(base() + " SELECT project_slug, session_id, count(*) AS n_rows FROM ev WHERE machine_id = 'mach-1' AND (project_slug, session_id) NOT IN (SELECT (project_slug, session_id) FROM ev WHERE ord % 3 = 0 AND session_id NOT LIKE '%7') GROUP BY ALL")
def unbacked_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.usage_events(spark, sf_dir)
    return archive.unbacked(events, events.filter("ord % 3 = 0 AND session_id NOT LIKE '%7'"), "mach-1")


@query(base() + " SELECT ord, project_slug, session_id FROM ev WHERE machine_id = 'mach-1' AND session_id IN ('s-4', 's-7', 's-10')")
def forget_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.usage_events(spark, sf_dir)
    return archive.forgotten(events, events.filter(F.col("session_id").isin("s-4", "s-7", "s-10")), "mach-1")[1].select("ord", "project_slug", "session_id")


@query(base() + f" SELECT ord FROM ev WHERE NOT (ord % 4 = 0 AND {TOT} % 2 = 0)")
def push_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.usage_events(spark, sf_dir)
    return unseen(events, events.filter((F.col("ord") % 4 == 0) & (total() % 2 == 0))).select("ord")


@query("WITH " + base().split("WITH RECURSIVE ")[1] + " SELECT ord AS seq, message_id FROM ev WHERE ord > 300 AND ord <= 2000 ORDER BY ord LIMIT 500")
def page_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.page(fixtures.usage_events(spark, sf_dir).withColumnRenamed("ord", "seq"), 300, 500, 2000).select("seq", "message_id")


@query(base() + SAMPLES + " SELECT captured_at, util FROM samples")
def sample_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = fixtures.limit_samples(spark, sf_dir)
    return archive.merged_samples(samples, samples.withColumn("util", F.lit(-1.0))).select("captured_at", "util")


@query(base() + " SELECT session_id, model FROM ev QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) = 1")
def lww_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.latest(fixtures.usage_events(spark, sf_dir), ["session_id"], ["ord"]).select("session_id", "model")
