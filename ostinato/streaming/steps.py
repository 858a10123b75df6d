"""Staged, resumable work as a stream: a machine of steps for each performance, with retries, a budget and time limits.

Requests come as rows; no manifest is changed in place. The machine's state lives in Spark's state store, so a stream that is
started again from its checkpoint goes on where it was, and what it says is an append-only log of changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Steps in their order.
STEPS = ["analysis", "segmentation", "transcription", "benchmark", "review", "stitch"]
LOG = "perf string, seq long, step string, status string, reason string, attempts int, created_ms long, at_ms long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StepMachine(StatefulProcessor):
    """Requests (begin, force, success, failure) of one performance -> changes of its steps.

    A step begins if none is running, the step before is done, it isn't done itself and it has tries left; ``force`` needs neither
    the last nor the one before it. A running step that isn't answered within ``limit_ms`` has failed then, whether a later row or the
    watermark tells so. Refused requests are rows too, with the reason.
    """

    def __init__(self, tries: int, limit_ms: int):
        self.tries, self.limit_ms = tries, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "step string", "status string, attempts int, created_ms long")
        self.running = handle.getValueState("running", "step string, deadline_ms long")

    def _known(self, step: str) -> tuple:
        return self.steps.getValue((step,)) if self.steps.containsKey((step,)) else (None, 0, None)

    def _put(self, key: tuple, seq: int, step: str, status: str, reason: str | None, at: int, tried: int = 0) -> tuple:
        """Keeps a step's status; the time of its first try stays."""
        _, attempts, created = self._known(step)
        kept = status, attempts + tried, at if created is None else created
        self.steps.updateValue((step,), kept)
        return key[0], seq, step, status, reason, kept[1], kept[2], at

    def _expire(self, key: tuple, now: int) -> list[tuple]:
        if self.running.exists():
            step, deadline = self.running.get()
            if deadline <= now:
                self._stop(deadline)
                return [self._put(key, -1, step, "failed", "time_limit", deadline)]
        return []

    def _stop(self, deadline: int) -> None:
        self.running.clear()
        if deadline in list(self.handle.listTimers()):
            self.handle.deleteTimer(deadline)

    def _refusal(self, step: str, action: str) -> str | None:
        busy = self.running.get()[0] if self.running.exists() else None
        if step not in STEPS or action not in ("begin", "force", "success", "failure"):
            return "unknown_request"
        if action in ("success", "failure"):
            return None if busy == step else "not_running"
        if busy:
            return "busy"
        place, (status, attempts, _) = STEPS.index(step), self._known(step)
        if place and self._known(STEPS[place - 1])[0] != "success":
            return "earlier_step_open"
        if action == "force":
            return None
        return "already_done" if status == "success" else "no_tries_left" if attempts >= self.tries else None

    def _answer(self, key: tuple, seq: int, step: str, action: str, now: int) -> tuple:
        reason = self._refusal(step, action)
        if reason:
            _, attempts, created = self._known(step)
            return key[0], seq, step, "refused", reason, attempts, created, now
        if action in ("success", "failure"):
            self._stop(self.running.get()[1])
            return self._put(key, seq, step, "success" if action == "success" else "failed", None, now)
        self.running.update((step, now + self.limit_ms))
        self.handle.registerTimer(now + self.limit_ms)
        return self._put(key, seq, step, "running", action, now, tried=1)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in LOG.split(", ")])
        return frame.astype({"created_ms": "Int64", "seq": "int64", "attempts": "int32", "at_ms": "int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        said = []
        for r in pd.concat(list(rows)).sort_values(["at_ms", "seq"]).itertuples():
            said += self._expire(key, int(r.at_ms))
            said.append(self._answer(key, int(r.seq), r.step, r.action, int(r.at_ms)))
        yield self._frame(said)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(self._expire(key, expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def step_log(requests: DataFrame, tries: int = 3, limit_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """requests(perf, seq, ts, step, action) as a stream -> LOG, a row for each request and for each time limit passed.

    Rows of a performance should come in order of time, within ``late``; rows behind the watermark are left out by Spark. A null step
    or action is an unknown request; null performances are one key; null times are left out. State is a row a step and one more for each
    performance, and a task holds one performance's requests of one micro-batch: bound these by the source's files or rows a trigger.
    The session must have ``spark.sql.streaming.stateStore.providerClass`` set to STORE.
    """
    timed = requests.where("ts is not null and seq is not null").withWatermark("ts", late).select("perf", "seq", F.coalesce("step", F.lit("")).alias("step"), F.coalesce("action", F.lit("")).alias("action"), F.unix_millis("ts").alias("at_ms"), "ts")
    return timed.groupBy("perf").transformWithStateInPandas(StepMachine(tries, limit_ms), LOG, "append", "EventTime")


def latest_steps(log: DataFrame) -> DataFrame:
    """perf, step -> status, attempts, created_ms, updated_ms as the log's last accepted row of a step has them: a view, no update in place."""
    last = F.max_by(F.struct("status", "reason", "attempts", "created_ms"), F.struct("at_ms", "seq"))
    seen = log.where("status <> 'refused'").groupBy("perf", "step").agg(last.alias("x"), F.max("at_ms").alias("updated_ms"))
    return seen.select("perf", "step", "x.status", "x.reason", "x.attempts", "x.created_ms", "updated_ms")
