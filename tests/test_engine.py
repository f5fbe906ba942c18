"""Edge cases by hand: ties, missing and empty keys, odd timestamps, time zones, corrupt lines, streams."""

import datetime as dt
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import paths, pricing
from tallyspark.functions import timefns as T
from tallyspark.operators import archive, blocks, compose, dims, intraday, reports
from tallyspark.operators.events import Query, deduplicated, last_of_batch, searched, tree_filtered, united
from tallyspark.plans import fixtures, more, params
from tallyspark.sources import logs, tail, transcripts
from tallyspark.streaming import live

H = 3_600_000
SCHEMA = (
    "message_id string, request_id string, session_id string, project_slug string, machine_id string, model string, input_tokens long, output_tokens long, "
    "cache_creation_tokens long, cache_read_tokens long, cost_usd double, cwd string, timestamp string, ord long"
)


def events(spark, *rows):
    base = dict(message_id="m", request_id="r", session_id="s", project_slug="p", machine_id="x", model="claude-haiku-4-5", input_tokens=1, output_tokens=0, cache_creation_tokens=0, cache_read_tokens=0, cost_usd=None, cwd=None, timestamp="2024-01-01T00:00:00Z")
    full = [{**base, "ord": i, **r} for i, r in enumerate(rows)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], SCHEMA).withColumn("ts", T.instant(F.col("timestamp")))


def at(hours, base="2024-01-01"):
    return (dt.datetime.fromisoformat(base) + dt.timedelta(hours=hours)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def costed(spark, df, mode="auto"):
    return pricing.with_cost(df, fixtures.prices(spark), mode)


def one(df, col):
    return df.first()[col]


def test_dedup_keeps_fullest_first_seen_and_its_rank(spark):
    df = events(spark, dict(input_tokens=1), dict(input_tokens=9, session_id="b"), dict(input_tokens=9, session_id="c"), dict(request_id=None), dict(request_id=""), dict(request_id=None, input_tokens=5))
    got = {r.request_id: (r.input_tokens, r.session_id, r.ord) for r in deduplicated(df).collect()}
    assert got == {"r": (9, "b", 0), None: (5, "s", 3), "": (1, "s", 4)}
    assert {r.request_id: r.ord for r in last_of_batch(df).collect()} == {"r": 2, None: 5, "": 4}


def test_union_ranks_earlier_feeds_first(spark):
    a, b = events(spark, dict(session_id="a")), events(spark, dict(session_id="b"), dict(message_id="n"))
    assert {r.message_id: r.session_id for r in united(a, b).collect()} == {"m": "a", "n": "s"}


def test_order_is_by_timestamp_text(spark):
    df = events(spark, dict(message_id="1", model="late", timestamp="2024-01-01T00:00:00Z"), dict(message_id="2", model="early", timestamp="2024-01-01T00:00:00.5Z"))
    assert one(reports.daily(costed(spark, df)), "models") == ["early", "late"]


def test_unreadable_timestamps_count_only_without_bounds(spark):
    df = events(spark, dict(message_id="1", timestamp="never"), dict(message_id="2"))
    assert Query().apply(df).count() == 2
    assert Query(since="20231231").apply(df).count() == 1
    assert reports.daily(costed(spark, df)).count() == 1


def test_costs(spark):
    df = events(spark, dict(model="x/claude-haiku-4-5-20250101", input_tokens=10, cost_usd=0.0), dict(message_id="2", model="nobody", input_tokens=10))
    assert [r.cost for r in costed(spark, df).orderBy("ord").collect()] == [0.0, 0.0]
    assert [r.cost for r in costed(spark, df, "calculate").orderBy("ord").collect()] == [pytest.approx(1e-5), 0.0]
    assert [r.price_key for r in costed(spark, df).orderBy("ord").collect()] == ["claude-haiku-4-5", None]
    with pytest.raises(ValueError):
        costed(spark, df, "free")


def test_price_sources(spark):
    text = json.dumps({"claude-a": {"input_cost_per_token": 0.1, "output_cost_per_token": 7.0}, "other": {"input_cost_per_token": 0.1}, "claude-b": {"input_cost_per_token": 9.0}})
    got = pricing.prices_from_json(spark.createDataFrame([(text,)], "value string")).collect()
    assert [(r.model_key, r.input, r.output) for r in got] == [("claude-a", 0.1, None)]
    many, few = spark.createDataFrame([(str(i),) for i in range(5)], "k string"), spark.createDataFrame([("a",)], "k string")
    assert pricing.refreshed(many, few) is many and pricing.refreshed(few, many) is many


@pytest.mark.parametrize(("tz", "day", "hours", "want"), [("America/Chicago", "2026-03-08", 2, "2026-03-08T07:00:00.000Z"), ("America/Chicago", "2026-11-01", 1, "2026-11-01T06:00:00.000Z"), ("Europe/Berlin", "2026-10-25", 2, "2026-10-25T01:00:00.000Z")])
def test_zoned_instants_at_clock_changes(spark, tz, day, hours, want):
    ms = T.zoned_instant(F.lit(day).cast("date"), F.lit(hours * H), tz)
    assert one(spark.range(1).select(T.iso(ms).alias("v")), "v") == want


def test_rounding(spark):
    got = spark.range(1).select(T.half_up(F.lit(-2.5)).alias("a"), T.round_minute(F.lit(1_000_000_029_999)).alias("b"), T.floor_hour(F.lit(H * 5 + 7)).alias("c")).first()
    assert (got.a, got.b % 60_000, got.c) == (-2, 0, 5 * H)


def test_paths(spark):
    f = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert f(paths.slug_of(F.lit("/a/b.c_d"))) == "-a-b-c-d"
    assert f(paths.parent_slug(F.lit("p--claude-worktrees-a--claude-worktrees-b"))) == "p"
    assert f(paths.parent_slug(F.lit("--claude-worktrees-a"))) == "--claude-worktrees-a"
    assert f(paths.parent_path(F.lit("/r/.claude/worktrees/x"))) == "/r"
    assert f(paths.display_path(F.lit("/home/u/x"))) == "~/x"
    assert f(paths.display_name(F.lit("C:\\git\\proj\\"))) == "proj"


@pytest.mark.parametrize(
    ("remote", "sub", "want"),
    [
        ("https://Host.org:443/A/B.git", "", "host.org/a/b"), ("ssh://git@host.org:2222/a/b", "X/", "host.org:2222/a/b#x"), ("git@host.org:a/b c.git", "", "host.org/a/b c"),
        ("https://host.org/a/b%20c", "", "host.org/a/b c"), ("file:///a/b", "", None), ("C:/x", "", None), ("/plain/path", "", None), (None, "", None), ("https://h/a%zz", "", "h/a%zz"), ("git@hh:a#b", None, "hh/a%23b"),
    ],
)
def test_repo_ids(spark, remote, sub, want):
    df = spark.createDataFrame([(remote, sub)], "r string, s string")
    assert df.select(paths.repo_id(F.col("r"), F.col("s")).alias("v")).first()["v"] == want


def test_blocks_close_after_five_hours_not_at_them(spark):
    df = costed(spark, events(spark, *(dict(message_id=str(i), timestamp=at(h)) for i, h in enumerate([0, 4, 5, 5.5, 11, 16.0001]))))
    got = blocks.blocks(df).orderBy("start").collect()
    start = 1_704_067_200_000
    assert [((r.start - start) // H, r.n_events) for r in got] == [(0, 3), (5, 1), (11, 1), (16, 1)]
    assert [((r.start - start) / H, (r.end - start) / H) for r in blocks.gaps(blocks.blocks(df)).orderBy("start").collect()] == [(10.5, 11.0), (16.0, pytest.approx(16.0001, abs=1e-6))]


def brute_blocks(ms):
    out = []
    for m in sorted(ms):
        if not out or m - out[-1][0] > 5 * H or m - out[-1][1] > 5 * H:
            out.append([m - m % H, m, 0])
        out[-1][1] = m
        out[-1][2] += 1
    return [(s, n) for s, _, n in out]


def test_blocks_by_brute_force(spark):
    import random

    r = random.Random(5)
    hours = [r.choice([0, 0.25, 1, 2.5, 4, 5, 6]) for _ in range(300)]
    t, rows = 0.0, []
    for i, h in enumerate(hours):
        t += h
        rows.append(dict(message_id=str(i), timestamp=at(t)))
    df = costed(spark, events(spark, *rows))
    got = [(x.start, x.n_events) for x in blocks.blocks(df).orderBy("start").collect()]
    assert got == brute_blocks([x.ms for x in blocks.timed(df).collect()])


def test_blocks_of_long_unbroken_stretches(spark):
    import random
    import time

    r = random.Random(8)
    steps = [r.choice([0, 1, 1, 1, 2, 5, 5, 3, 6, 0.5, 400]) for _ in range(6_000)]
    busy = [float(i) + (i % 3) / 4 for i in range(80_000)]
    for hours in (busy, [sum(steps[:0])] + [float(x) for x in __import__("itertools").accumulate(steps)]):
        ms = [1_704_067_200_000 + int(h * H) for h in hours]
        df = spark.createDataFrame([("k", m) for m in ms], "k string, ms long")
        began = time.time()
        got = {(x.hour, x.at_hour, x.after) for x in blocks.walked(blocks.hours_of(df, ["k"]), ["k"]).collect()}
        assert time.time() - began < 30
        starts, start = {}, None
        for m in ms:
            if start is None or m - start > 5 * H:
                start = m - m % H
            starts[m] = start
        by = {h: (a, b) for h, a, b in got}
        assert all(by[m - m % H][0 if m % H == 0 else 1] == s for m, s in starts.items()) and len(by) == len({m - m % H for m in ms})


def sample(captured, util, reset):
    return (1_704_067_200_000 + int(captured * H), float(util), 1_704_067_200_000 + int(reset * H), 0)


def test_windows_annul_and_grace(spark):
    s = spark.createDataFrame([sample(1, 5, 5), sample(1.5, 5, 5.000001), sample(4, 5, 8), sample(9, 0, 13.5)], "captured_at long, util double, reset_at long, ord long")
    e = blocks.timed(events(spark, dict(timestamp=at(9))))
    got = [((r.start - 1_704_067_200_000) / H, (r.end - 1_704_067_200_000) / H, r.source) for r in blocks.resolved_windows(s, e).orderBy("end").collect()]
    assert got == [(0, 3, "annulled"), (3, 8, "observed"), (8.5, 13.5, "observed")]
    assert blocks.resolved_windows(s, e.limit(0)).count() == 2
    found = blocks.blocks(costed(spark, events(spark, dict(timestamp=at(1)), dict(message_id="2", timestamp=at(9)), dict(message_id="3", timestamp=at(20)))), samples=s, now=1_704_067_200_000 + 10 * H)
    rated = {r.source + str((r.start - 1_704_067_200_000) / H): (r.active, r.limit_pct) for r in blocks.with_limit(found, s).collect()}
    assert rated == {"annulled0.0": (False, 5.0), "observed8.5": (True, 0.0), "heuristic20.0": (False, None)}


def test_intraday_edges(spark):
    now = 1_704_067_200_000 + 24 * H
    df = costed(spark, events(spark, dict(timestamp=at(24)), dict(message_id="2", timestamp=at(23)), dict(message_id="3", timestamp=at(22.999))))
    got = intraday.rolling(df, "1h", now).filter("n_events > 0").collect()
    assert sorted((r.frame, r.idx) for r in got) == [("current", 0), ("previous", 59)]
    grid = intraday.today(df, now - H // 2, "UTC")
    assert grid.filter("frame = 'current'").count() == 24
    with pytest.raises(ValueError):
        intraday.checked(10, 3)
    with pytest.raises(ValueError):
        intraday.checked(10**9, 1)
    assert intraday.today_line_bucket(24 * H) == 2 * 60_000 and intraday.line_bucket("1h") == 60_000


def test_sessions_count_whole_but_window_by_last_day(spark):
    df = costed(spark, events(spark, dict(timestamp=at(0)), dict(message_id="2", timestamp=at(30), machine_id="y", project_slug="q")))
    got = reports.sessions(df, since="2024-01-02").first()
    assert (got.n_events, got.project_slug, got.machine_id) == (2, "p", "y")
    assert reports.sessions(df, until="2024-01-01").count() == 0
    p = {r.project_slug: r.first_activity for r in reports.projects(df, since="2024-01-02").collect()}
    assert p == {"q": "2024-01-02"}


def test_project_paths(spark):
    df = events(spark, dict(project_slug="-a-b", cwd="/x"), dict(message_id="2", project_slug="-a-b", cwd="/a/b"), dict(message_id="3", project_slug="-c", cwd="/z"), dict(message_id="4", project_slug="-d-e"))
    assert {r.project_slug: r.path for r in reports.project_paths(df).collect()} == {"-a-b": "/a/b", "-c": "/z", "-d-e": "/d/e"}


def end_of(parents, node):
    """Along the parents to the end, or to the first node that comes again."""
    seen = set()
    while node not in seen:
        seen.add(node)
        if parents.get(node) in (None, node):
            break
        node = parents[node]
    return node


def plain_merges(assertions, key_of):
    """Statement by statement: entries {source key: (target key, status)}, targets, representatives."""
    order = lambda a: (a[3], a[0], a[1])
    for level in (lambda a: (a[0], a[1]), lambda a: a[1], lambda a: key_of.get(a[1], a[1])):
        best = {}
        for a in sorted(assertions, key=order):
            best[level(a)] = a
        assertions = list(best.values())
    entries, edges, names = {}, {}, {}
    for a in sorted(assertions, key=order):
        source, target = key_of.get(a[1], a[1]), None if a[2] is None else key_of.get(a[2], a[2])
        status = "unmerged" if target is None else "redundant" if target == source else "conflict" if end_of(edges, target) == source else "active"
        entries[source] = (target, status)
        if status == "active":
            edges[source] = target
    for a in sorted(assertions, key=order):
        target = None if a[2] is None else key_of.get(a[2], a[2])
        if edges.get(key_of.get(a[1], a[1])) == target and target is not None and target not in edges:
            names[target] = a[2]
    return entries, {k: end_of(edges, k) for k in {*edges, *edges.values()}}, names


def test_merges_by_plain_rules(spark):
    import random

    r = random.Random(6)
    few = [("m", "a", "b", "1"), ("m", "b", "c", "2"), ("m", "c", "a", "3"), ("n", "d", "a", "1"), ("n", "d", None, "2"), ("m", "e", "e", "1"), ("q", "f", "g", "9"), ("q", "g", "f", "8"), ("q", "h", "f", "1")]
    many = [(r.choice("mn"), f"p{r.randint(0, 30)}", r.choice([None, *(f"p{i}" for i in range(31))]), f"{r.randint(0, 99):02}") for _ in range(90)]
    for rows, key_of in ((few, {}), (many, {}), (many, {f"p{i}": f"p{i - i % 3}" for i in range(31)})):
        rows = list({(a[0], a[1], a[3]): a for a in rows}.values())
        groups = spark.createDataFrame(list(key_of.items()), "anchor string, group_key string") if key_of else None
        entries, targets, names = dims.resolved_merges(spark.createDataFrame(rows, "author string, source string, target string, updated_at string"), groups)
        want = plain_merges(rows, key_of)
        assert {x.source_key: (x.target_key, x.status) for x in entries.collect()} == want[0]
        assert {x.group: x.target for x in targets.collect()} == want[1] and {x.target_key: x.target for x in names.collect()} == want[2]
    none = dims.resolved_merges(spark.createDataFrame([], "author string, source string, target string, updated_at string"))
    assert [x.count() for x in none] == [0, 0, 0]


def test_dimensions(spark):
    chains = {"a": "b", "b": "c", "c": None, "x": "y", "y": "x", "u": "?", "z": "x", "w": "z", "s": "s"} | {f"n{i}": f"n{i + 1}" for i in range(40)}
    got = {r.machine_id: r.target for r in dims.alias_targets(spark.createDataFrame(list(chains.items()), "machine_id string, merged_into string")).collect()}
    assert got == {k: end_of(chains, k) for k in chains} and got["w"] == "x" and got["n0"] == "n40" and got["u"] == "?"
    rows = spark.createDataFrame([("m1", "p", None, 5), ("m2", "p", "r", 5), ("m1", "p--claude-worktrees-x", "w", 9)], "machine_id string, project_slug string, repo_id string, probed_at long")
    assert [(r[0], r[1]) for r in dims.newest_identity(rows).collect()] == [("p", "p")]
    mapping = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "c")], "machine_id string, target string")
    assert dims.expanded(["a"], mapping) == ["a", "b"]


def test_archive(spark):
    df = events(spark, dict(session_id="a"), dict(message_id="2", session_id="b"), dict(message_id="2", session_id="b", input_tokens=5)).withColumnRenamed("ord", "seq")
    assert [r.seq for r in archive.page(df, 0, 10, 1).collect()] == [1]
    assert sorted(r.seq for r in archive.compacted(df).collect()) == [0, 2]
    stay, go = archive.forgotten(df, spark.createDataFrame([("p", "a"), ("p", "a")], "project_slug string, session_id string"))
    assert (stay.count(), go.count()) == (2, 1)
    assert [r.seq for r in archive.numbered(df.withColumnRenamed("seq", "ord"), 7).orderBy("seq").collect()] == [8, 9, 10]


def test_log_files(spark, tmp_path):
    df = events(spark, dict(), dict(message_id="2")).withColumnRenamed("ord", "seq").drop("ts")
    logs.rewritten(df, str(tmp_path / "log"), "e1")
    epoch, back = logs.loaded(spark, str(tmp_path / "log"))
    assert epoch == "e1" and sorted(r.message_id for r in back.collect()) == ["2", "m"]
    parts = sorted((tmp_path / "log").glob("part-*"))
    whole = "".join(x.read_text() for x in parts)
    assert parts[0].read_text().startswith('{"epoch":"e1"}\n')
    (tmp_path / "torn.ndjson").write_text(whole + '{"message_id": "3", "se')
    assert logs.loaded(spark, str(tmp_path / "torn.ndjson"))[1].count() == 2
    lines = whole.splitlines()
    (tmp_path / "bad.ndjson").write_text("\n".join([lines[0], "nonsense", *lines[1:]]))
    with pytest.raises(ValueError):
        logs.loaded(spark, str(tmp_path / "bad.ndjson"))
    assert logs.loaded(spark, str(tmp_path / "bad.ndjson"), strict=False)[1].count() == 2


def test_appends_are_whole_or_not_there(spark, tmp_path):
    log = str(tmp_path / "log")
    first = events(spark, dict(message_id="a"), dict(message_id="b"), dict(message_id="c", request_id=None)).repartition(3)
    assert archive.appended(spark, log, first, "t1") == 3 and archive.appended(spark, log, first, "t1") == 0
    second = events(spark, dict(message_id="b", input_tokens=9), dict(message_id="d"), dict(message_id="c", request_id=None), dict(message_id="c", request_id=""))
    (tmp_path / "log" / "push=t2").mkdir()  # a push that broke off
    (tmp_path / "log" / "push=t2" / "part-0.parquet").write_bytes(b"torn")
    assert archive.log(spark, log).count() == 3
    assert archive.appended(spark, log, second, "t2") == 3
    held = archive.log(spark, log)
    assert sorted((r.seq, r.message_id) for r in held.collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "b"), (5, "d"), (6, "c")]
    assert {(r.message_id, r.request_id): r.seq for r in archive.stamped(second, held).collect()} == {("b", "r"): 4, ("d", "r"): 5, ("c", None): 3, ("c", ""): 6}
    assert archive.appended(spark, log, second, "t3") == 0 and archive.log(spark, log).count() == 6
    left = archive.push_batches(second, held.filter("seq > 3"), 1)
    assert [(r.message_id, r.batch) for r in left.collect()] == [("c", 0)]


def test_ranks_have_no_gap_whatever_the_partitions(spark):
    rows = [(i * 7919 % 1000, i % 3) for i in range(1000)]
    for n in (1, 7):
        got = archive.ranked(spark.createDataFrame(rows, "a int, b int").repartition(n), ["a", "b"], "at").collect()
        assert sorted((r.a, r.at) for r in got) == [(i, i) for i in range(1000)]
    assert archive.ranked(spark.createDataFrame([], "a int"), ["a"], "at").count() == 0


def test_cache_parses_only_what_changed(spark, tmp_path):
    import os

    root, cache = tmp_path / "in", str(tmp_path / "cache")
    root.mkdir()
    transcript_files(root)
    runs = lambda: {d for d in os.listdir(f"{cache}/version=1/events") if d.startswith("run=")}
    scan = lambda **more: sorted((r.message_id, r.input_tokens, r.session_id) for r in transcripts.cached(spark, str(root), "me", cache, **more).collect())
    plain = lambda: sorted((r.message_id, r.input_tokens, r.session_id) for r in transcripts.scanned(spark, [(str(root), "me")]).collect())
    assert scan() == plain() and scan() == plain() and len(runs()) == 1
    (root / "proj" / "more.jsonl").write_text(text_of(id="m8"))
    with (root / "alone.jsonl").open("a") as f:
        f.write("\n" + text_of(id="m9"))
    (root / "proj" / "sess.jsonl").unlink()
    assert scan() == plain() and len(runs()) == 2 and scan() == plain() and len(runs()) == 2
    new = next(d for d in runs() if spark.read.parquet(f"{cache}/version=1/events/{d}").filter("message_id = 'm8'").count())
    assert {r[0].rpartition("/")[2] for r in spark.read.parquet(f"{cache}/version=1/events/{new}").select("path").distinct().collect()} == {"more.jsonl", "alone.jsonl"}
    assert scan(version=2) == plain() and len(os.listdir(f"{cache}/version=2/events")) >= 1
    transcripts.forget_cache(spark, cache)
    assert scan() == plain() and len(runs()) == 1


def line(**more):
    return {"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "message": {"id": "m1", "model": "claude-haiku-4-5", "usage": {"input_tokens": 1, "output_tokens": 2}}, **more}


def transcript_files(root):
    (root / "proj" / "sess" / "subagents").mkdir(parents=True)
    good = json.dumps(line(), separators=(",", ":"))
    rows = [good + "\r", "", '{"type":"user"}', json.dumps(line(costUSD=None)), json.dumps(line(isApiErrorMessage=True)), '{"type":"assistant","mess', json.dumps(line(message={"id": "m2", "model": "<synthetic>", "usage": {"input_tokens": 1, "output_tokens": 2}}))]
    (root / "proj" / "sess.jsonl").write_text("\n".join(rows) + "\n")
    (root / "proj" / "sess" / "subagents" / "agent-1.jsonl").write_text(json.dumps(line(requestId="", costUSD=0.5, message={"id": "m3", "model": "x", "usage": {"input_tokens": 3, "output_tokens": 4, "cache_read_input_tokens": 7}})))
    (root / "alone.jsonl").write_text(json.dumps(line(message={"id": "m4", "model": "x", "usage": {"input_tokens": 3, "output_tokens": 4}})))


def test_transcripts(spark, tmp_path):
    transcript_files(tmp_path)
    rows = transcripts.parsed(transcripts.read(spark, str(tmp_path)))
    assert sorted(r[0] for r in rows.select("problem").filter("problem IS NOT NULL").collect()) == ["invalid-json", "schema-mismatch"]
    got = {r.message_id: (r.project_slug, r.session_id, r.request_id, r.cache_read_tokens, r.cost_usd) for r in transcripts.scanned(spark, [(str(tmp_path), "me")]).collect()}
    assert got == {"m1": ("proj", "sess", None, 0, None), "m3": ("proj", "sess", "", 7, 0.5), "m4": ("", "alone", None, 0, None)}
    known = transcripts.stale(spark, str(tmp_path), spark.createDataFrame([], "path string, size long, modified timestamp"))
    assert known.count() == 3 and transcripts.stale(spark, str(tmp_path), known).count() == 0


def started(stream, out, cp, seen=None, more=None):
    def on_change(changed, table, batch_id):
        if seen is not None:
            seen.append(sorted((r.message_id, r.input_tokens, r.before.input_tokens if r.before else None) for r in changed.collect()))
        if more:
            more(changed, table)

    live.merge_stream(stream, out, on_change).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()


def text_of(**usage):
    name = usage.pop("id", "m1")
    return json.dumps(line(message={"id": name, "model": "x", "usage": {"input_tokens": 1, "output_tokens": 2, **usage}}))


def test_stream_of_growing_files_equals_batch(spark, tmp_path):
    root, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    root.mkdir()
    transcript_files(root)
    seen = []
    run = lambda: started(live.transcript_stream(spark, str(root), "me"), out, cp, seen)
    batch = lambda: sorted((r.message_id, r.session_id, r.input_tokens) for r in deduplicated(transcripts.scanned(spark, [(str(root), "me")])).collect())
    stream = lambda: sorted((r.message_id, r.session_id, r.input_tokens) for r in live.table(spark, out).collect())
    run()
    # files without a last line end wait for it; sess.jsonl has one
    assert seen == [[("m1", 1, None)]]
    for f in ("alone.jsonl", "proj/sess/subagents/agent-1.jsonl"):
        with (root / f).open("a") as g:
            g.write("\n")
    fuller = text_of(input_tokens=100)
    with (root / "proj" / "sess.jsonl").open("a") as g:
        g.write(fuller[:50])  # a line in the middle of being written
    run()
    assert seen[1] == [("m3", 3, None), ("m4", 3, None)]
    with (root / "proj" / "sess.jsonl").open("a") as g:
        g.write(fuller[50:] + "\n" + text_of(id="m5") + "\n")
    (root / "proj" / "late.jsonl").write_text(text_of(input_tokens=7) + "\n" + text_of(id="m6") + "\r\n")
    run()
    assert seen[2] == [("m1", 100, 1), ("m5", 1, None), ("m6", 1, None)] and stream() == batch()
    # cut and written anew: read from its start; a restarted query goes on from its log
    (root / "proj" / "late.jsonl").write_text(text_of(id="m7") + "\n")
    run()
    run()
    assert seen[3:] == [[("m7", 1, None)]]
    (root / "alone.jsonl").unlink()
    run()
    assert len(seen) == 4
    live.compacted(spark, out, 3)
    assert {r[0] for r in stream()} == {"m1", "m3", "m4", "m5", "m6", "m7"}


def test_tail_chunks_own_the_lines_that_begin_in_them(tmp_path, monkeypatch):
    import random

    r = random.Random(4)
    text = b"".join(bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) + b"\n" for _ in range(60))
    (tmp_path / "x.jsonl").write_bytes(text + b"open")
    monkeypatch.setattr(tail, "CHUNK_BYTES", 7)
    monkeypatch.setattr(tail, "STEP", 3)
    reader = tail.TailReader(str(tmp_path))
    end = reader.latestOffset()
    assert end == {str(tmp_path / "x.jsonl"): len(text)}
    got = [x for part in reader.partitions({}, end) for b in reader.read(part) for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
    want = text.decode().split("\n")[:-1]
    assert [v for _, v in got] == want and [s for s, _ in got] == [len("\n".join([*want[:i], ""])) for i in range(len(want))]
    cut = {str(tmp_path / "x.jsonl"): 20}
    assert sum(b.num_rows for part in reader.partitions(end, cut) for b in reader.read(part)) == text[:20].count(b"\n") + (text[19:20] != b"\n")


def test_scan_cuts_large_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "s.jsonl").write_text("".join(text_of(id=f"m{i}", input_tokens=i) + "\n" for i in range(5_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = transcripts.scanned(spark, [(str(tmp_path), "me")])
        assert rows.rdd.getNumPartitions() > 4
        assert [r.input_tokens for r in rows.orderBy("ord").collect()] == list(range(5_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_roots_that_are_not_there_have_nothing(spark, tmp_path):
    (tmp_path / "a" / "p").mkdir(parents=True)
    (tmp_path / "a" / "p" / "s.jsonl").write_text(text_of() + "\n")
    roots = [(str(tmp_path / "none"), "x"), (str(tmp_path / "a"), "me")]
    assert [(r.machine_id, r.ord.root) for r in transcripts.scanned(spark, roots).collect()] == [("me", 1)]
    assert transcripts.scanned(spark, roots[:1]).count() == 0 and transcripts.listed(spark, roots[0][0]).count() == 0
    assert transcripts.cached(spark, roots[0][0], "x", str(tmp_path / "cache")).count() == 0
    assert tail.TailReader(roots[0][0]).latestOffset() == {}


def test_nulls_roles_and_halves_are_mismatches(spark, tmp_path):
    usage = {"input_tokens": 1, "output_tokens": 2}
    bad = [line(requestId=None), line(cwd=None), line(isApiErrorMessage=None), line(message={"id": "m", "model": "x", "role": "user", "usage": usage}), line(message={"id": "m", "model": "x", "usage": None}),
        line(message={"id": "m", "model": "x", "usage": {**usage, "cache_read_input_tokens": None}}), line(message={"id": "m", "model": "x", "usage": {**usage, "cache_creation": {"ephemeral_5m_input_tokens": 1}}}), line(costUSD="5")]
    good = [line(extra=None), line(message={"id": "m", "model": "x", "role": "assistant", "content": [{"cwd": None}], "usage": usage}), {"type": "user", "cwd": None}]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(x) for x in bad + good) + '\n{"type" : "assistant"\n{"no":1}\n[1]\n')
    rows = transcripts.parsed(transcripts.read(spark, str(tmp_path))).groupBy("problem").count().collect()
    assert {r.problem: r["count"] for r in rows}["schema-mismatch"] == len(bad) and {r.problem: r["count"] for r in rows}["invalid-json"] == 1


def test_state_equals_batch_out_of_order(spark, tmp_path):
    import random

    r, root, out, cp = random.Random(9), tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    (root / "p").mkdir(parents=True)
    for k in range(4):
        rows = [json.dumps(line(requestId=r.choice(["", "q", "r"]), timestamp=f"2024-01-0{r.randint(1, 4)}T00:00:00Z", message={"id": f"m{r.randint(0, 9)}", "model": "x", "usage": {"input_tokens": r.randint(0, 5), "output_tokens": 0}})) for _ in range(40)]
        (root / "p" / f"s{k}.jsonl").write_text("\n".join(rows) + "\n")
        started(live.transcript_stream(spark, str(root), "me"), out, cp)
    rows = transcripts.scanned(spark, [(str(root), "me")])
    pick = lambda df: sorted((x.message_id, x.request_id, x.input_tokens, x.session_id, x.timestamp) for x in df.collect())
    assert pick(live.table(spark, out)) == pick(deduplicated(rows))


def test_kept_reports_rewrite_touched_parts_only(spark, tmp_path):
    import os

    root, out, cp, kept = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "kept")
    (root / "p").mkdir(parents=True)
    sums = lambda df, *keys: df.groupBy("part", *keys).agg(F.sum("input_tokens").alias("n"), F.count(F.lit(1)).alias("n_events"))
    families = [
        live.Family("daily", F.date_format("ts", "yyyy-MM-dd"), lambda df: sums(df, F.date_format("ts", "yyyy-MM-dd").alias("date"))),
        live.Family("projects", F.pmod(F.xxhash64("project_slug"), F.lit(8)), lambda df: sums(df, "project_slug")),
        live.Family("sessions", F.pmod(F.xxhash64("session_id"), F.lit(8)), lambda df: sums(df, "session_id", "model")),
    ]
    run = lambda: started(live.transcript_stream(spark, str(root), "me"), out, cp, None, lambda c, t: live.refresh_parts(spark, kept, families, c, t))
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(kept) for f in names if f.endswith(".parquet")}
    at = lambda day, name, n: json.dumps(line(timestamp=f"2024-01-0{day}T00:00:00Z", message={"id": name, "model": "x", "usage": {"input_tokens": n, "output_tokens": 0}})) + "\n"
    (root / "p" / "a.jsonl").write_text("".join(at(d, f"m{d}", 1) for d in (1, 2, 3)))
    run()
    before = files()
    # m3 moves to another day by a fuller row, so that its old day is empty; a new project comes
    (root / "q").mkdir()
    (root / "q" / "b.jsonl").write_text(at(2, "m3", 9) + at(2, "m9", 4))
    run()
    whole = live.table(spark, out)
    for family in families:
        want = family.fold(whole.withColumn("part", family.part.cast("string")))
        assert sorted(map(str, (r.asDict() for r in live.report(spark, kept, family).select(*want.columns).withColumn("part", F.col("part").cast("string")).collect()))) == sorted(map(str, (r.asDict() for r in want.collect())))
    daily = {f for f in before if "/daily/" in f}
    assert len(daily & files()) == 1 and {f.split("part=")[1][:10] for f in daily & files()} == {"2024-01-01"}


def test_refreshed_report_equals_full(spark):
    held = events(spark, dict(), dict(message_id="2", project_slug="q"), dict(message_id="3", project_slug="z"))
    batch = events(spark, dict(input_tokens=50, project_slug="q", ord=9), dict(message_id="9", project_slug="new", ord=10), dict(message_id="3", input_tokens=0, ord=11))
    changed = live.changes(held, batch)
    after = live.applied(held, changed)
    fold = lambda e: e.groupBy("project_slug").agg(F.sum("input_tokens").alias("n"))
    got = live.refreshed(fold(held), after, changed, ["project_slug"], fold)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fold(after).collect())) == [("new", 1), ("q", 51), ("z", 1)]
    assert one(changed.filter("message_id = 'm'"), "ord") == 0


def test_params():
    assert params.valid_ymd("20240229") and not params.valid_ymd("20230229") and not params.valid_ymd("2024-1-1")
    for bad in (dict(mode="x"), dict(tz="Mars/Base"), dict(since="20240230"), dict(since="20240102", until="20240101")):
        with pytest.raises(ValueError):
            params.common(**bad)
    assert params.preset("24h", dt.date(2024, 3, 1)) == ("20240229", "20240301") and params.preset("all", dt.date(2024, 3, 1)) == (None, None)
    assert params.chart_windows(dt.date(2024, 1, 5), dt.date(2024, 1, 6))[1] == (dt.date(2024, 1, 3), dt.date(2024, 1, 4))
    assert params.source("7d", False, ["machine"]) == "daily-machine"


def test_series_helpers(spark):
    assert compose.normalised(["tokenType", "machine", "x"]) == ["machine", "tokenType"]
    assert compose.trend_width(30) == 10 and compose.sampled_labels(20, True) == [0, 3, 6, 9, 12, 15, 18, 19]
    df = spark.createDataFrame([(-50.0,), (0.5,), (3000.0,)], "v double")
    assert [r[0] for r in df.select(compose.symlog_inverse(compose.symlog(F.col("v"), 1.0), 1.0)).collect()] == [pytest.approx(x) for x in (-50.0, 0.5, 3000.0)]
    rows = spark.createDataFrame([("d", "a", 5), ("d", "b", 7)], "date string, part string, value long")
    kept, total = compose.muted(rows, spark.createDataFrame([("d", 10)], "date string, value long"), "part", ["b"])
    assert (kept.count(), total.first()["value"]) == (1, 3)
    parents, children = spark.createDataFrame([("1", "Alpha"), ("2", "Beta")], "id string, name string"), spark.createDataFrame([("2", "alphabet"), ("1", "x")], "id string, name string")
    assert sorted((r.id, r.by_child) for r in tree_filtered(parents, children, "id", " ALPHA ", ["name"]).collect()) == [("1", False), ("2", True)]
    assert searched(parents, "", ["name"]).count() == 2


def test_empty_tables(spark):
    df = costed(spark, events(spark).limit(0))
    assert reports.daily(df).count() == 0 and blocks.blocks(df, ["session_id"]).count() == 0 and reports.sessions(df).count() == 0
    assert one(blocks.summary(blocks.blocks(df)), "typical_tokens") == 0.0


def test_transcript_files_are_written_line_by_line(tmp_path):
    """A file may span batches, and a batch files: no text of a whole file is in one row."""
    lines = [("p", "a", f"{{é{i}}}\n") for i in range(5)] + [("p", "b", "x\n"), ("q", "b", "y\n"), ("q", "b", "z\n")]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*lines)], ["slug", "session", "line"])
    batches = [whole.slice(0, 2), whole.slice(2, 0), whole.slice(2, 5), whole.slice(7)]
    assert [b.to_pylist() for b in more.files_written(f"file://{tmp_path}")(iter(batches))] == [[{"n": 8}]]
    read = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*.jsonl")}
    assert read == {"p/a.jsonl": "".join(x for _, s, x in lines if s == "a"), "p/b.jsonl": "x\n", "q/b.jsonl": "y\nz\n"}


def test_chains_pass_no_nodes_through_the_driver(spark):
    machines = spark.createDataFrame([(str(i), str(i + 1)) for i in range(40)] + [("x", "y"), ("y", "x"), ("z", None)], "machine_id string, merged_into string")
    found = dims.alias_targets(machines)
    assert "Broadcast" not in found._jdf.queryExecution().toString()
    assert {r.machine_id: r.target for r in found.collect()} == {str(i): "40" for i in range(40)} | {"x": "x", "y": "y", "z": "z"}
    edges = machines.filter("merged_into IS NOT NULL").select(F.col("machine_id").alias("node"), F.col("merged_into").alias("to"), F.struct(F.lit(0)).alias("order"))
    assert "Broadcast" not in dims.in_cycles(edges)._jdf.queryExecution().toString()


class Held:
    """A list state that counts how often it is asked."""

    def __init__(self):
        self.rows, self.calls = [], []

    def get(self):
        self.calls.append("get")
        return iter(list(self.rows))

    def put(self, rows):
        self.calls.append("put")
        self.rows = list(rows)

    def appendValue(self, row):  # noqa: N802
        self.calls.append("append")
        self.rows.append(row)


def test_keyed_state_is_asked_once_a_bucket():
    """However many keys a bucket has; what it holds stays the winners through segments and their merges."""
    import random

    r, winner, state = random.Random(3), live.Winner(), Held()
    winner.init(type("Handle", (), {"getListState": lambda self, name, schema: state})())
    held = {}
    for batch in range(40):
        rows = [(0, f"k{r.randint(0, 60)}", f"o{batch}-{i}", f"e{batch}-{i}", r.randint(0, 30), f"p{r.randint(0, 3)}", i) for i in range(100 if batch < 4 else 2)]
        want = []
        for k in dict.fromkeys(x[1] for x in rows):
            mine = [x for x in rows if x[1] == k]
            best, first = min(mine, key=lambda x: (-x[4], x[5:])), min(mine, key=lambda x: x[5:])
            if k not in held or best[4] > held[k][0]:
                before = held[k][2] if k in held else None
                held[k] = (best[4], held[k][1] if k in held else first[2], best[3])
                want.append((held[k][1], best[3], before))
        state.calls.clear()
        got = [(x.ord, x.event, x.before) for x in winner.handleInputRows((0,), iter(rows), None)]
        assert got == want and state.calls.count("get") == 1 and len(state.calls) == (2 if want else 1)
        assert len(state.rows) < live.SEGMENTS
    assert len(held) == 61


def test_feed_parses_each_text_once(spark, tmp_path):
    (tmp_path / "p").mkdir()
    stream = live.winners(live.transcript_stream(spark, str(tmp_path), "me"))
    plan = stream._jdf.queryExecution().analyzed().toString()
    fed = plan[: plan.index("TransformWithState")]  # what is above the state
    assert fed.count("from_json(") == 3


def test_buckets_hold_many_keys(spark, tmp_path):
    """Few buckets give the same table and feed as many."""
    root = tmp_path / "in"
    (root / "p").mkdir(parents=True)
    for batch in range(3):
        (root / "p" / f"s{batch}.jsonl").write_text("".join(text_of(id=f"m{i}", input_tokens=(i * 7 + batch * 5) % 11) + "\n" for i in range(batch, 30)))
        for n in (1, 3, 1 << 16):
            live.merge_stream(live.transcript_stream(spark, str(root), "me"), str(tmp_path / f"out{n}"), buckets=n).option("checkpointLocation", str(tmp_path / f"cp{n}")).trigger(availableNow=True).start().awaitTermination()
    feed = lambda n: sorted(map(str, spark.read.parquet(str(tmp_path / f"out{n}")).select("message_id", "input_tokens", "session_id", "ord", "before", "batch").collect()))
    assert feed(1) == feed(3) == feed(1 << 16) and len(feed(1)) > 30
    rows = transcripts.scanned(spark, [(str(root), "me")])
    pick = lambda df: sorted((x.message_id, x.input_tokens, x.session_id) for x in df.collect())
    assert pick(live.table(spark, str(tmp_path / "out1"))) == pick(deduplicated(rows))


def test_tail_reads_chunks_by_pieces(tmp_path, monkeypatch):
    """No more than a piece is read at once, however long the chunk; lines over several pieces and chunks are whole."""
    import random

    r = random.Random(8)
    lines = [bytes(r.choice(b"ab") for _ in range(r.choice((0, 3, 9, 70)))) for _ in range(90)]
    (tmp_path / "x.jsonl").write_bytes(b"\n".join(lines) + b"\nopen")
    asked = []

    class File:
        def __init__(self):
            self.data = (tmp_path / "x.jsonl").read_bytes()

        def size(self):
            return len(self.data)

        def read_at(self, n, at):
            asked.append(n)
            return self.data[at : at + n]

    monkeypatch.setattr(tail, "PIECE", 8)
    monkeypatch.setattr(tail, "STEP", 5)
    last = len(b"\n".join(lines)) + 1
    for chunk in (50, 10_000):
        got = [list(zip(*piece)) for first in range(0, last, chunk) for piece in tail.lines_of(File(), 0, first, min(last, first + chunk))]
        assert [v for piece in got for _, v in piece] == [x.decode() for x in lines]
        assert [s for piece in got for s, _ in piece] == [len(b"\n".join([*lines[:i], b""])) for i in range(len(lines))]
        assert max(map(len, got)) <= 8
    assert max(asked) <= 8
