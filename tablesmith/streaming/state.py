"""Operators that keep state by key across micro-batches and restarts: a cache whose entries expire, and the stop rule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Groups that keys are dealt to; each keeps the state of its keys, so a micro-batch costs a call a group, not a key.
BUCKETS = 512


def _bucket(key: str) -> Column:
    """A key's group; rows without a key are one of their own."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).cast("int").alias("_bucket")


def _keys(bucket: int, column: pd.Series) -> list:
    return [None] * len(column) if bucket < 0 else column.tolist()


def cached(requests: DataFrame, ttl_s: int = 3600, late: str = "0 seconds") -> DataFrame:
    """A stream of requests (key, seq, at timestamp) -> key, seq, at, hit, fetched_at.

    A key's entry is fetched by the first request and lives ttl_s seconds; a request that comes then or later fetches it
    anew, others are hits and don't lengthen its life. Requests go by (at, seq) within a micro-batch, so batches have to
    come in order of time; those not newer than the watermark are dropped by Spark. A key's state is one time; keys share
    BUCKETS states, of which entries expired by the watermark are left out, and a timer removes what nobody asks for.
    Memory: the rows and live entries of a bucket in one micro-batch.
    """
    keep = ttl_s * 1_000_000

    def serve(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(frames).sort_values(["us", "seq"], ignore_index=True)
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        fetched, hit = [], []
        for key, at in zip(_keys(bucket[0], rows["key"]), rows["us"].tolist(), strict=True):
            last = held.get(key)
            hit.append(last is not None and at - last < keep)
            if not hit[-1]:
                held[key] = last = at
            fetched.append(last)
        now = state.getCurrentWatermarkMs()
        live = {k: t for k, t in held.items() if t + keep > now * 1000}
        if live:
            state.update((list(live), list(live.values())))
            state.setTimeoutTimestamp(max((max(live.values()) + keep) // 1000, now) + 1)
        elif state.exists:
            state.remove()
        yield rows.assign(hit=hit, fetched=fetched)[["key", "seq", "us", "hit", "fetched"]]

    key = next(t for n, t in requests.dtypes if n == "key")
    rows = requests.select("key", "seq", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late).select(_bucket("key"), "key", "seq", "at", F.unix_micros("at").alias("us"))
    served = rows.groupBy("_bucket").applyInPandasWithState(serve, f"key {key}, seq long, us long, hit boolean, fetched long", f"keys array<{key}>, fetched array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return served.select("key", "seq", F.timestamp_micros("us").alias("at"), "hit", F.timestamp_micros("fetched").alias("fetched_at"))


def why(rows: float, cost: float, elapsed: float, new: float, total: float, limits: dict) -> str | None:
    """As flow.stop_reason, of numbers."""
    if rows >= limits["target_rows"]:
        return "target_reached"
    if cost >= limits["max_cost_micros"]:
        return "budget_exhausted"
    if elapsed >= limits["max_seconds"]:
        return "time_limit"
    return "saturated" if total > 0 and new / total < limits["saturation"] and rows > 0 else None


def stopping(batches: DataFrame, limits: dict) -> DataFrame:
    """A stream of batches (run_id, seq, new_rows, total_rows, cost_micros, elapsed_s) -> those up to the one after
    which their run stops, with rows_so_far and reason; as flow.early_stop.

    The state of a run is what its batches have come to and what the last one brought; a batch is looked at by that
    before it is let in. Runs share BUCKETS states. They are kept in the query's checkpoint, so a stream that is cut
    anywhere goes on with the same totals. Batches go by seq within a micro-batch, and micro-batches have to come in
    that order.
    """
    names = ["new_rows", "total_rows", "cost_micros", "elapsed_s"]

    def admit(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {run: told for run, *told in zip(*state.get, strict=True)} if state.exists else {}
        stopped = {}
        out = []
        came = pd.concat(frames).sort_values("seq")
        for run, seq, new, total, more, elapsed in zip(_keys(bucket[0], came["run_id"]), *(came[n].tolist() for n in ("seq", *names)), strict=True):
            if run not in stopped:
                stopped[run] = run in held and why(*held[run], limits) is not None
            if stopped[run]:
                continue
            rows, cost = held[run][:2] if run in held else (0, 0)
            rows, cost = rows + new, cost + more
            reason = why(rows, cost, elapsed, new, total, limits)
            held[run], stopped[run] = [rows, cost, elapsed, new, total], reason is not None
            out.append((run, seq, rows, reason))
        runs = list(held)
        rows, cost, elapsed, new, total = zip(*held.values(), strict=True)
        state.update((runs, *(list(map(int, x)) for x in (rows, cost)), list(map(float, elapsed)), *(list(map(int, x)) for x in (new, total))))
        yield pd.DataFrame(out, columns=["run_id", "seq", "rows_so_far", "reason"])

    run = next(t for n, t in batches.dtypes if n == "run_id")
    rows = batches.select(_bucket("run_id"), "run_id", "seq", *names)
    kept = f"runs array<{run}>, rows array<long>, cost array<long>, elapsed array<double>, new array<long>, total array<long>"
    return rows.groupBy("_bucket").applyInPandasWithState(admit, f"run_id {run}, seq long, rows_so_far long, reason string", kept, "append", GroupStateTimeout.NoTimeout)
