"""Stream-shaped services: an exact sliding-window limiter with state, windowed counts, queue places and latest progress."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import running_total

#: Fixed allowances: (requests, seconds).
RUN_RULES = ((3, 3600), (10, 86400))
FLOW_RULES = ((8, 3600),)


def admit(times: list[float], history: list[float], rules: tuple[tuple[int, int], ...]) -> tuple[list[tuple[bool, int]], list[float]]:
    """(admitted, minutes to wait) of each request, and the history after them. Rejected requests leave no trace."""
    out = []
    longest = max(window for _, window in rules)
    for now in times:
        history = [t for t in history if now - t < longest]
        wait = 0
        for allowed, window in rules:
            inside = [t for t in history if now - t < window]
            if len(inside) >= allowed:
                wait = max(1, math.ceil((window - (now - inside[0])) / 60))
                break
        out.append((wait == 0, wait))
        if not wait:
            history = [*history, now]
    return out, history


def limit_batch(requests: DataFrame, rules: tuple[tuple[int, int], ...] = RUN_RULES) -> DataFrame:
    """Exact admission of a table of requests (id, visitor, at: seconds), a fold per visitor; no visitor is never limited.

    A visitor's requests are split into sessions by gaps longer than every window: history never reaches
    over such a gap. Inside a session each verdict hangs on those before it, so a session is folded by one
    task; a visitor who never pauses for the longest window is one session.
    """
    longest = max(window for _, window in rules)
    w = Window.partitionBy("visitor").orderBy("at", "id")
    starts = (F.col("at") - F.lag("at").over(w) >= longest).cast("int")
    sessions = requests.where("visitor is not null").withColumn("starts", F.coalesce(starts, F.lit(1))).withColumn("session", F.sum("starts").over(w))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "id"])
        verdicts, _ = admit(pdf["at"].tolist(), [], rules)
        return pd.DataFrame({"id": pdf["id"], "visitor": pdf["visitor"], "admitted": [v for v, _ in verdicts], "wait_min": [m for _, m in verdicts]})

    kind = dict(requests.dtypes)["visitor"]
    limited = sessions.groupBy("visitor", "session").applyInPandas(fold, f"id long, visitor {kind}, admitted boolean, wait_min int")
    free = requests.where("visitor is null").select("id", "visitor", F.lit(True).alias("admitted"), F.lit(0).alias("wait_min"))
    return limited.unionByName(free)


def limit_stream(requests: DataFrame, rules: tuple[tuple[int, int], ...] = RUN_RULES) -> DataFrame:
    """The same on a stream (id, visitor, at): state is a visitor's accepted times, gone when the longest window has passed."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    longest = max(window for _, window in rules)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        history = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["at", "id"])
        verdicts, history = admit(pdf["at"].tolist(), history, rules)
        state.update((history,))
        state.setTimeoutDuration(longest * 1000)
        yield pd.DataFrame({"id": pdf["id"].to_numpy(), "visitor": [key[0]] * len(pdf), "admitted": [v for v, _ in verdicts], "wait_min": [m for _, m in verdicts]})

    kind = dict(requests.dtypes)["visitor"]
    return requests.groupBy("visitor").applyInPandasWithState(
        step, f"id long, visitor {kind}, admitted boolean, wait_min int", "accepted array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def window_counts(requests: DataFrame, seconds: int) -> DataFrame:
    """Requests of the same visitor in the window up to each request: the plain count, without admission feedback."""
    w = Window.partitionBy("visitor").orderBy("at").rangeBetween(-seconds + 1, 0)
    return requests.withColumn("n_recent", F.count("*").over(w))


def tumbling_counts(events: DataFrame, time: str, by: str, window: str = "1 day", late: str = "13 days") -> DataFrame:
    """Watermarked counts and means in tumbling windows; works on a stream and on a table."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def queue_places(jobs: DataFrame) -> DataFrame:
    """Unfinished jobs ahead of each: jobs run one at a time, in order of arrival and of id. Counts go over ranges of arrival times."""
    waiting = jobs.where(F.col("state").isin("queued", "running")).select("id", "state", F.col("created").cast("timestamp").cast("double").alias("at"))
    before = running_total(waiting.groupBy("at").agg(F.count("*").alias("n")), "at", "n").select("at", "before")
    place = F.row_number().over(Window.partitionBy("at").orderBy("id")) - 1
    return waiting.join(before, "at").select("id", "state", (F.col("before") + place).cast("long").alias("ahead"))


def latest_progress(log: DataFrame) -> DataFrame:
    """The last message of every job, with progress that never falls."""
    return log.groupBy("job").agg(F.max_by("message", F.struct("at", "seq")).alias("message"), F.max("share").alias("share"), F.count("*").alias("n"))
