"""State machines over ordered calls: limiters, token bucket, breaker, cache and the routing simulation.

The limiter and the bucket have closed forms in running sums and running maxima, which add up over days, so they run in the JVM and no
provider is one task. Breaker and cache are sequential by nature: a provider's calls are folded in time order, with
the state carried over from stretch to stretch and day to day. They are streamed over sorted rows: a task holds a stretch and
the state, however long the provider's history is. Only the simulation begins anew each day, as a day is its scenario.
"""

from __future__ import annotations

from collections import OrderedDict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.plans.durable import grouped, running_max, running_start, streamed

ORDER = ["at", "call_id"]


def _timed(calls: DataFrame) -> DataFrame:
    us = F.unix_micros(F.col("called_at").cast("timestamp"))
    rows = calls.filter("called_at is not null and provider is not null")
    return rows.select("call_id", "provider", F.date_format("called_at", "yyyy-MM-dd").alias("day"), (us / 1e6).alias("at"), us.alias("us"), "status", F.coalesce("input_tokens", F.lit(0)).alias("tokens"), F.coalesce("model", F.lit("")).alias("model"), F.coalesce("file_path", F.lit("")).alias("path"))


def slots(times: list[float], limit: int, window: float, before: deque | None = None) -> list[float]:
    """Admission times: slot i is the later of time i and the slot `limit` places before plus the window.

    `before` holds the latest `limit` slots so far, and is brought up to date.
    """
    held: deque = deque(maxlen=limit) if before is None else before
    out: list[float] = []
    for t in times:
        held.append(max(t, held[0] + window) if len(held) == limit else t)
        out.append(held[-1])
    return out


def limiter_slots(calls: DataFrame, limit: int = 30, window: float = 60.0) -> DataFrame:
    """(call_id, provider, day, slot, wait): when a limiter of `limit` calls per window lets each call through.

    Slot i is the later of its time and slot i - limit plus the window (see `slots`). Along the calls i, i + limit, i + 2 limit, ... that is
    k windows plus the running maximum of time - k windows.
    """
    width = round(window * 1e6)
    ranked = running_start(_timed(calls).withColumn("one", F.lit(1)), ["provider"], "day", ["us", "call_id"], "one", "i")
    chained = ranked.withColumn("chain", F.col("i") % limit).withColumn("k", F.floor(F.col("i") / limit)).withColumn("ahead", F.col("us") - F.col("k") * width)
    held = running_max(chained, ["provider", "chain"], "day", ["k"], "ahead", "most").withColumn("slot_us", F.col("most") + F.col("k") * width)
    return held.select("call_id", "provider", "day", (F.col("slot_us") / 1e6).alias("slot"), ((F.col("slot_us") - F.col("us")) / 1e6).alias("wait"))


def token_bucket(calls: DataFrame, capacity: float = 200_000, rate: float = 40_000 / 60) -> DataFrame:
    """(call_id, provider, day, level): the level after each charge; it refills over time, may go into debt, and a charge is at most the capacity.

    What a call finds missing is a waiting time in a queue with one server: the sum of charges before it less the time passed, over the running minimum of that.
    """
    per_token = round(1e6 / rate)  # microseconds in which a token flows back
    rows = _timed(calls).withColumn("charge", F.least(F.lit(capacity), "tokens").cast("long"))
    first = rows.groupBy("provider").agg(F.min("us").alias("first_us"))
    summed = running_start(rows, ["provider"], "day", ["us", "call_id"], "charge", "before").join(first, "provider")
    owed = summed.withColumn("less", F.col("us") - F.col("first_us") - F.col("before") * per_token)  # the negative sum, so that its maximum is wanted
    topped = running_max(owed, ["provider"], "day", ["us", "call_id"], "less", "most")
    level = F.lit(capacity) - (F.col("most") - F.col("less")) / per_token - F.col("charge")
    return topped.select("call_id", "provider", "day", level.cast("double").alias("level"))


class Breaker:
    """Closed, open or half-open: three failures in a row, or one while half-open, open it for 30 s; a rate limit for 2^k s, 60 at most; a used up quota, a refused key and a wrong configuration for an hour.

    The longest pause holds; an answer that comes while it is open is older than the pause and changes nothing.
    """

    THRESHOLD, PAUSE, LONGEST, HOUR = 3, 30.0, 60.0, 3600.0
    LONG = ("quota_exhausted", "auth_failed", "misconfigured")

    def __init__(self) -> None:
        self.failures, self.limits, self.until, self.probing = 0, 0, 0.0, False

    def state(self, at: float) -> str:
        if at < self.until:
            return "open"
        return "half_open" if self.probing else "closed"

    def record(self, at: float, status: str) -> None:
        state = self.state(at)
        if status == "ok":
            if state != "open":
                self.failures, self.limits, self.probing = 0, 0, False
        elif status == "rate_limited":
            self.limits += 1
            self._pause(at + min(2.0 ** min(self.limits, 30), self.LONGEST))  # a long run of limits would overflow
        elif status in self.LONG:
            self._pause(at + self.HOUR)
        elif status == "unavailable":
            self.failures += 1
            if state == "half_open" or self.failures >= self.THRESHOLD:
                self._pause(at + self.PAUSE)

    def _pause(self, until: float) -> None:
        self.until, self.probing = max(self.until, until), True


def breaker_states(calls: DataFrame) -> DataFrame:
    """(call_id, provider, day, state): the breaker's state when each call begins."""

    def run(rows: pd.DataFrame, b: Breaker) -> pd.DataFrame:
        out = []
        for at, status in zip(rows["at"].tolist(), rows["status"].tolist()):
            out.append(b.state(at))
            b.record(at, status)
        rows["state"] = out
        return rows[["call_id", "provider", "day", "state"]]

    return streamed(_timed(calls), "provider", ORDER, Breaker, run, "call_id bigint, provider string, day string, state string")


def lru_hits(calls: DataFrame, entries: int = 512) -> DataFrame:
    """(provider, day, n_calls, n_hits) of a cache of the latest `entries` keys of the provider."""

    def run(rows: pd.DataFrame, cache: OrderedDict) -> pd.DataFrame:
        hits = []
        for key in zip(rows["model"].tolist(), rows["path"].tolist()):
            hits.append(key in cache)
            if hits[-1]:
                cache.move_to_end(key)
            else:
                cache[key] = None
                if len(cache) > entries:
                    cache.popitem(last=False)
        rows["hit"] = hits
        return rows.groupby(["provider", "day"], as_index=False).agg(n_calls=("hit", "size"), n_hits=("hit", "sum"))

    # a day that spans stretches has a row of each
    parts = streamed(_timed(calls), "provider", ORDER, OrderedDict, run, "provider string, day string, n_calls bigint, n_hits bigint")
    return parts.groupBy("provider", "day").agg(F.sum("n_calls").alias("n_calls"), F.sum("n_hits").alias("n_hits"))


def simulate_routing(calls: DataFrame, limit: int = 30, window: float = 60.0) -> DataFrame:
    """(day, strategy, completed, limited, fallback, minutes): a day's requests under three strategies, on a deterministic clock.

    naive: each request goes to its own provider, over the limit it fails. wait: it waits for the next slot.
    fallback: over the limit the provider with the earliest free slot serves it.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "call_id"])
        providers = sorted(rows["provider"].unique())
        out = []
        for strategy in ("naive", "wait", "fallback"):
            used: dict[str, deque] = {p: deque() for p in providers}
            completed = limited = fell = 0
            end = start = float(rows["at"].iloc[0])
            for at, wanted in zip(rows["at"], rows["provider"]):
                def free(p: str, now: float) -> float:
                    q = used[p]
                    while q and q[0] <= now - window:
                        q.popleft()
                    return now if len(q) < limit else q[len(q) - limit] + window

                slot, by = free(wanted, at), wanted
                if slot > at:
                    if strategy == "naive":
                        limited += 1
                        continue
                    if strategy == "fallback":
                        slot, by = min((free(p, at), p) for p in providers)
                        fell += by != wanted
                used[by].append(slot)
                completed += 1
                end = max(end, slot)
            out.append((rows["day"].iloc[0], strategy, completed, limited, fell, (end - start) / 60))
        return pd.DataFrame(out, columns=["day", "strategy", "completed", "limited", "fallback", "minutes"])

    return grouped(_timed(calls), ["day"], run, "day string, strategy string, completed bigint, limited bigint, fallback bigint, minutes double")
