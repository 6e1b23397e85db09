"""Keyed state over requests: rate limits and daily quotas, in batch and as a stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwell.plans.ship import ship


def admitted(times: list[float], held: deque, limit: int, seconds: float) -> list[bool]:
    """Whether each request (in order of time) is accepted: fewer than `limit` accepted ones in the last `seconds`,
    those strictly older left out. `held` has the times of accepted requests and is updated; a refused one leaves no mark."""
    out = []
    for t in times:
        while held and held[0] < t - seconds:
            held.popleft()
        ok = len(held) < limit
        if ok:
            held.append(t)
        out.append(ok)
    return out


def rate_limited(requests: DataFrame, limit: int, seconds: float) -> DataFrame:
    """event_id, client, ts, accepted. Requests of a client stream through one task in order; only accepted times are kept."""
    ship(requests.sparkSession)
    order = requests.repartition("client").sortWithinPartitions("client", "ts", "event_id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, held = object(), deque()
        for part in parts:
            ok = []
            for c, group in part.groupby("client", sort=False, dropna=False):
                if c != client:
                    client, held = c, deque()
                ok += admitted((group["ts"].astype("int64") / 10 ** (9 if "ns" in str(group["ts"].dtype) else 6)).tolist(), held, limit, seconds)
            yield part.assign(accepted=ok)

    kinds = dict(requests.dtypes)
    return order.mapInPandas(run, f"event_id {kinds['event_id']}, client {kinds['client']}, ts {kinds['ts']}, accepted boolean")


def daily_quota(requests: DataFrame, per_client: int, total: int) -> DataFrame:
    """requests with day and verdict: `client` beyond the client's quota of the UTC day (which takes nothing from the
    total), `total` beyond the day's, else `ok`.

    The rank within a day is taken over hours first, so a day's requests do not meet in one task.
    """
    day = requests.withColumn("day", F.to_date("ts"))
    own = day.withColumn("_own", F.row_number().over(Window.partitionBy("day", "client").orderBy("ts", "event_id")))
    fit = F.when(F.col("_own") <= per_client, 1).otherwise(0)
    own = own.withColumn("_fit", fit).withColumn("_slot", F.date_trunc("minute", "ts"))
    before = own.groupBy("day", "_slot").agg(F.sum("_fit").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("day").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = F.sum("_fit").over(Window.partitionBy("day", "_slot").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    out = own.withColumn("_inner", inner).join(before, ["day", "_slot"])
    verdict = F.when(F.col("_fit") == 0, "client").when(F.col("_before") + F.col("_inner") > total, "total").otherwise("ok")
    return out.withColumn("verdict", verdict).drop("_own", "_fit", "_slot", "_before", "_inner")


def rate_limit_stream(requests: DataFrame, limit: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """The streaming form of rate_limited, with state by client that ends when its last accepted request is out of the window."""
    ship(requests.sparkSession)

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        part = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        held = deque(state.get[0] if state.exists else [])
        times = (part["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist()
        ok = admitted(times, held, limit, seconds)
        state.update((list(held),))
        until = int((max([*held, times[-1]]) + seconds) * 1000) + 1
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield part.assign(accepted=ok)[["event_id", "client", "ts", "accepted"]]

    kinds = dict(requests.dtypes)
    return requests.withWatermark("ts", late).groupBy("client").applyInPandasWithState(step, f"event_id {kinds['event_id']}, client {kinds['client']}, ts {kinds['ts']}, accepted boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)
