"""The table source, state across micro-batches and restarts, counters and events."""

import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tablesmith.operators import flow
from tablesmith.plans import stream_queries
from tablesmith.sources import tables
from tablesmith.streaming import metrics, state, stream

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def follow(spark, tmp_path, rows, by, most, name="q"):
    """A stream of rows in the order of `by`, and its folders for the checkpoint and the results."""
    path = f"{tmp_path}/{name}-in"
    rows.coalesce(1).sortWithinPartitions(by).write.parquet(path)
    return tables.follow(spark, path, f"file://{tmp_path}/{name}-cp/source/progress", most, rows.schema)


def run(rows, tmp_path, name="q", stop=lambda b, n: False):
    made = stream.append_until(rows, f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-cp", stop, processingTime="0 seconds")
    return stream.drained(made)


def out(spark, tmp_path, name="q"):
    return spark.read.parquet(f"{tmp_path}/{name}-out")


def test_partitions_are_pruned_by_pushed_filters(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), F.col("id") % 7).alias("url"), F.rand(1).alias("x"))
    rows.repartitionByRange(5, "page_id").sortWithinPartitions("page_id").write.parquet(f"{tmp_path}/t")
    t = tables.scan(spark, f"{tmp_path}/t")
    assert t.rdd.getNumPartitions() == 5 and t.columns == ["page_id", "url", "x"] and sorted(map(tuple, t.collect())) == sorted(map(tuple, rows.collect()))
    some = t.where("page_id >= 350 and page_id < 420")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert some.rdd.getNumPartitions() < 5 and not re.search(r"\bFilter\b", plan) and [r.page_id for r in some.orderBy("page_id").collect()] == list(range(350, 420))
    assert t.where("page_id = 5000").count() == 0 and t.where("page_id in (1, 999)").count() == 2
    assert t.where("url = 'u3' and x < 2").count() == rows.where("url = 'u3'").count()  # the second stays with Spark
    assert tables.scan(spark, f"{tmp_path}/t", "url string").where("url is not null").columns == ["url"]


def test_pages_of_a_stream_come_in_parts_and_once(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    rows = follow(spark, tmp_path, pages, "page_id", 9)
    run(rows, tmp_path, stop=lambda b, n: n >= 1)  # stops after two parts, then goes on
    assert out(spark, tmp_path).count() == 18
    run(rows, tmp_path)
    made = out(spark, tmp_path)
    assert max(r["count"] for r in made.groupBy("batch").count().collect()) == 9
    assert sorted(map(tuple, made.drop("batch").collect())) == sorted(map(tuple, pages.collect()))


def brute_cache(requests, ttl):
    found, last = {}, {}
    for key, seq, at in sorted(requests, key=lambda r: (r[2], r[1])):
        hit = key in last and at - last[key] < timedelta(seconds=ttl)
        if not hit:
            last[key] = at
        found[seq] = (key, hit, last[key])
    return found


@pytest.mark.parametrize("cut", [None, 0, 2])
def test_cache_entries_expire(spark, tmp_path, cut):
    rng = random.Random(4)
    requests = [(rng.choice("aaaab"), k, START + timedelta(seconds=k * 40 + rng.choice([0, 0, 3000]) * (k > 60))) for k in range(90)]
    requests += [("edge", 90, START), ("edge", 91, START + timedelta(seconds=100)), ("edge", 92, START + timedelta(seconds=99, microseconds=999_999))]
    requests.sort(key=lambda r: r[2])
    df = spark.createDataFrame([(k, s, t.replace(tzinfo=None)) for k, s, t in requests], "key string, seq long, at timestamp")
    rows = state.cached(follow(spark, tmp_path, df, "at", 30), 100)
    if cut is not None:
        run(rows, tmp_path, stop=lambda b, n: n >= cut)  # lost and started anew from its checkpoint
    run(rows, tmp_path)
    got = {r.seq: (r.key, r.hit, r.fetched_at) for r in out(spark, tmp_path).collect()}
    assert got == {s: (k, h, f.replace(tzinfo=None)) for s, (k, h, f) in brute_cache(requests, 100).items()}


@pytest.mark.parametrize("cut", [0, 1, 3])
def test_a_stop_rule_is_the_same_however_the_stream_is_cut(spark, tmp_path, cut):
    limits = {"target_rows": 30, "max_cost_micros": 60_000, "max_seconds": 70, "saturation": 0.05}
    rng = random.Random(9)
    rows = [(k % 4, k, rng.randrange(0, 5), 20, 5000, float(k)) for k in range(80)]
    df = spark.createDataFrame(rows, "run_id long, seq long, new_rows long, total_rows long, cost_micros long, elapsed_s double")
    made = state.stopping(follow(spark, tmp_path, df, "seq", 17), limits)
    run(made, tmp_path, stop=lambda b, n: n >= cut)
    run(made, tmp_path)
    columns = ["run_id", "seq", "rows_so_far", "reason"]
    assert sorted(map(tuple, out(spark, tmp_path).select(*columns).collect())) == sorted(map(tuple, flow.early_stop(df, limits).select(*columns).collect()))


def test_counts_of_a_stream_come_from_its_own_pass(spark, tmp_path):
    told = []
    counters = metrics.Counters(metrics.Events(lambda name, payload: told.append(name) if name != "terminated" else 1 / 0))
    spark.streams.addListener(counters)
    try:
        rows = follow(spark, tmp_path, spark.range(100), "id", 30)
        made = run(metrics.observed(rows, "seen", {"n": F.count(F.lit(1)), "odd": F.count_if(F.col("id") % 2 == 1)}), tmp_path)
        assert counters.of(made.query) == {"n": 100, "odd": 50}
    finally:
        spark.streams.removeListener(counters)
    assert told.count("started") == 1 and told.count("progress") >= 4


def test_sessions_and_late_rows(spark, tmp_path):
    at = lambda m: START.replace(tzinfo=None) + timedelta(minutes=m)
    arrivals = [("a", at(0)), ("a", at(29)), ("b", at(10)), ("a", at(70)), *[("x", at(600 + k)) for k in range(6)], ("a", at(5)), ("b", at(700)), ("x", at(2000))]
    df = spark.createDataFrame([(k, u, t) for k, (u, t) in enumerate(arrivals)], "seq long, user string, at timestamp")
    counters = metrics.Counters()
    spark.streams.addListener(counters)
    try:
        made = run(stream.sessions(follow(spark, tmp_path, df, "seq", 5), "user", "at"), tmp_path)
        counters.of(made.query)
        assert counters.late[str(made.query.id)] == 1  # user a at minute 5, two micro-batches after minute 600
    finally:
        spark.streams.removeListener(counters)
    assert sorted((r.user, r.start, r.last, r.n) for r in out(spark, tmp_path).collect()) == [("a", at(0), at(29), 2), ("a", at(70), at(70), 1), ("b", at(10), at(10), 1), ("b", at(700), at(700), 1), ("x", at(600), at(605), 6)]


def test_files_are_in_turn(spark):
    kept, path = stream_queries.in_turn(spark.range(50).orderBy(F.rand(3)), "id")
    assert [r.id for g in tables.groups(path) for r in spark.read.parquet(g.file).collect()] == list(range(50))


@pytest.mark.parametrize("name", ["ttl_cache", "event_sessions"])
def test_no_request_is_late_where_times_come_again(spark, sf, tmp_path, name):
    """Events of further users at the same times, with later numbers: each copy gives what the first gives."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    m = e.agg(F.max("event_id") + 1, F.max("user_id") + 1).first()
    copies = e.crossJoin(spark.range(3).withColumnRenamed("id", "k")).withColumns({"event_id": F.col("event_id") + F.col("k") * m[0], "user_id": F.col("user_id") + F.col("k") * m[1]}).drop("k")
    copies.write.parquet(f"{tmp_path}/events.parquet")
    whole, once = (getattr(stream_queries, name)(spark, d) for d in (str(tmp_path), sf))
    by = "hit" if name == "ttl_cache" else "n"
    found, expected = ({r[0]: r[1] for r in t.groupBy(by).count().collect()} for t in (whole, once))
    assert found == {k: 3 * n for k, n in expected.items()}


def test_runs_share_states_and_stop_as_before(spark, tmp_path):
    limits = {"target_rows": 30, "max_cost_micros": 60_000, "max_seconds": 70, "saturation": 0.05}
    rows = [(k % 900 or None, k, k % 7, 20, 5000, float(k % 60)) for k in range(6000)]
    df = spark.createDataFrame(rows, "run_id long, seq long, new_rows long, total_rows long, cost_micros long, elapsed_s double")
    made = run(state.stopping(follow(spark, tmp_path, df, "seq", 2500), limits), tmp_path)
    columns = ["run_id", "seq", "rows_so_far", "reason"]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, out(spark, tmp_path).select(*columns).collect()), key=key) == sorted(map(tuple, flow.early_stop(df, limits).select(*columns).collect()), key=key)
    told = [p["stateOperators"][0]["numRowsTotal"] for p in made.query.recentProgress if p["stateOperators"]]
    assert 0 < max(told) <= state.BUCKETS + 1  # before, a state a run


def test_a_task_of_a_stream_reads_little_more_than_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    kept, path = stream_queries.in_turn(spark.range(9000), "id")
    assert kept.count() == 9000 and max(g.rows for g in tables.groups(path)) <= 500
    spark.range(9000).coalesce(1).write.parquet(f"{tmp_path}/one")
    reader = tables.TableStreamReader({"path": f"{tmp_path}/one", "progress": f"file://{tmp_path}/p"}, kept.schema)
    parts = reader.partitions({"rows": 0}, {"rows": 9000})
    assert len(parts) == tables.GROUP_TASKS and sum(b.num_rows for p in parts for b in reader.read(p)) == 9000  # before, 18 tasks that each decode all rows
