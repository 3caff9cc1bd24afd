"""Streams with keyed state and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opslens.functions.exprs import micros
from opslens.streaming.transforms import event_time

#: Timers and several states per key need the state store on disk.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> SparkSession:
    """The session with the state store that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def _ms(us: int) -> int:
    """The first whole millisecond that is not before `us` microseconds; timers count in milliseconds."""
    return -(-us // 1000)


#: Times that wait are held by slots of a day; so many times are gathered before they go to the state.
SLOT_US, GATHERED = 86_400_000_000, 1 << 20


class _Quiet(StatefulProcessor):
    """Alerts of a key wait until the watermark has passed them, and then pass in the order of their times.

    Each call to the state is a round trip, so an entry is a slot with its sorted times, and one timer stands for the first time that waits.
    """

    def __init__(self, period_us: int):
        self.period_us = period_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot bigint", "times binary")
        self.sent = handle.getValueState("sent", "at bigint")

    def _wait(self, times: np.ndarray) -> None:
        slots, starts = np.unique(times // SLOT_US, return_index=True)
        for slot, mine in zip(slots.tolist(), np.split(times, starts[1:]), strict=True):
            held = self.waiting.getValue((slot,))
            both = mine if held is None else np.union1d(np.frombuffer(held[0], "<i8"), mine)
            self.waiting.updateValue((slot,), (both.astype("<i8").tobytes(),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        first, gathered, n = None, [], 0
        for frame in chain(rows, [None]):
            if frame is not None and len(frame):
                gathered.append(frame["at_us"].to_numpy(np.int64))
                n += len(frame)
            if n >= GATHERED or (frame is None and n):
                times = np.unique(np.concatenate(gathered))
                self._wait(times)
                first = int(times[0]) if first is None else min(first, int(times[0]))
                gathered, n = [], 0
        if first is not None:
            self.handle.registerTimer(_ms(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        sent = self.sent.get()
        last = None if sent is None else sent[0]
        passed = []
        for slot in sorted(s for (s,) in self.waiting.keys()):  # noqa: SIM118
            times = np.frombuffer(self.waiting.getValue((slot,))[0], "<i8")
            n = int(np.searchsorted(times, mark, "right"))
            at = 0 if last is None else int(np.searchsorted(times[:n], last + self.period_us))
            while at < n:
                last = int(times[at])
                passed.append(last)
                at = int(np.searchsorted(times[:n], last + self.period_us))
            if n == len(times):
                self.waiting.removeKey((slot,))
                continue
            if n:
                self.waiting.updateValue((slot,), (times[n:].tobytes(),))
            self.handle.registerTimer(_ms(int(times[n])))
            break
        if last is not None and last + self.period_us <= mark:
            # the period is over, and what comes later is behind the watermark or after it
            self.sent.clear()
        elif passed:
            self.sent.update((last,))
            self.handle.registerTimer(_ms(last + self.period_us))
        return iter([pd.DataFrame({"key": [key[0]] * len(passed), "at_us": passed})] if passed else ())

    def close(self) -> None:
        pass


def quiet(alerts: DataFrame, keys: Sequence[str], ts: str, period_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """keys and `ts` of the alerts that pass: the first of a key, and then the next that is `period_seconds` or more after the last one that passed.

    Alerts wait in state until the watermark (`delay` behind the newest) has passed them, so the answer follows from their times and not from the files and
    batches they came in, as long as they come within the delay; later ones are dropped. A key holds the times between the watermark and the newest
    alert, one entry per day, and the last time that passed, which a timer forgets after the period. A null key is a key like any other; null times are
    dropped. Alerts of a key are combined per time before the shuffle.
    """
    with_state(alerts.sparkSession)
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    named = alerts.where(F.col(ts).isNotNull()).select(key.alias("key"), micros(F.col(ts)).alias("at_us"))

    def combine(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch.drop_duplicates()

    combined = named.mapInPandas(combine, "key string, at_us bigint")
    timed = event_time(combined.withColumn("at", F.timestamp_micros("at_us")), "at", delay)
    passed = timed.groupBy("key").transformWithStateInPandas(_Quiet(period_seconds * 1_000_000), "key string, at_us bigint", "append", "eventTime")
    types = ", ".join(f"`{k}` {alerts.schema[k].dataType.simpleString()}" for k in keys)
    back = passed.select(F.from_json("key", types).alias("k"), F.timestamp_micros("at_us").alias(ts))
    return back.select("k.*", ts)


BRANCH_DDL = "branch_id string, created bigint, deleted bigint, resets bigint, is_protected boolean, last bigint"


#: How the states of one branch make one.
FOLD = {"created": "max", "deleted": "max", "resets": "sum", "is_protected": "any", "last": "max"}


def _folded(branches: pd.DataFrame) -> pd.DataFrame:
    return branches.groupby("branch_id", as_index=False).agg(FOLD)


class _Branches(StatefulProcessor):
    """Newest creation, deletion and activity of each branch of a bucket; a branch is gone once the watermark has passed its deletion.

    Each call to the state is a round trip, so a bucket is one value, a column an array, and one timer stands for the first branch to go.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("branches", ", ".join("{0} array<{1}>".format(*c.split()) for c in BRANCH_DDL.split(", ")))

    def _held(self) -> pd.DataFrame | None:
        held = self.state.get()
        return None if held is None else pd.DataFrame(dict(zip(["branch_id", *FOLD], held, strict=True)))

    def _keep(self, branches: pd.DataFrame) -> None:
        self.state.update(tuple(branches[c].tolist() for c in ["branch_id", *FOLD]))
        leaving = branches["last"][_is_deleted(branches)]
        if len(leaving):
            self.handle.registerTimer(_ms(int(leaving.min())))

    def _fold(self, new: pd.DataFrame) -> pd.DataFrame:
        """The state with `new`, which has a row per branch, in it."""
        held = self._held()
        now = new if held is None else _folded(pd.concat([held, new], ignore_index=True))
        self._keep(now)
        return now

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if len(initialState):
            self._fold(_folded(initialState))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        frames = [_folded(f) for f in rows if len(f)]
        if not frames:
            return iter(())
        new = _folded(pd.concat(frames, ignore_index=True))
        now = self._fold(new)
        return iter([now[now["branch_id"].isin(new["branch_id"])]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        held = self._held()
        if held is not None:
            gone = _is_deleted(held) & (held["last"] <= timerValues.getCurrentWatermarkInMs() * 1000)
            if gone.all():
                self.state.clear()
            elif gone.any():
                self._keep(held[~gone])
        return iter(())

    def close(self) -> None:
        pass


def _is_deleted(branches: pd.DataFrame) -> pd.Series:
    return branches["deleted"] >= branches["created"].clip(lower=0)


def live_branches(events: DataFrame, initial: DataFrame | None = None, delay: str = "10 minutes", buckets: int = 256) -> DataFrame:
    """Running state per branch, a row whenever it changes (update mode): BRANCH_DDL, times in microseconds, -1 for never.

    `initial` (BRANCH_DDL) starts the state from a batch. A branch that is deleted leaves the state when the watermark has passed its last event, so state is
    as large as the live branches and those deleted within the delay; the state data source reads it back. Events are combined per branch before the
    shuffle. A null branch counts as the empty name; null times and types are dropped.
    """
    with_state(events.sparkSession)
    at, kind = micros(F.col("event_timestamp")), F.col("event_type")
    marks = events.where(kind.isNotNull() & F.col("event_timestamp").isNotNull()).select(
        F.coalesce("branch_id", F.lit("")).alias("branch_id"), F.when(kind == "created", at).otherwise(-1).alias("created"), F.when(kind == "deleted", at).otherwise(-1).alias("deleted"),
        (kind == "reset").cast("bigint").alias("resets"), (kind == "protected").alias("is_protected"), at.alias("last"),
    )

    def combine(batches: Iterator) -> Iterator:
        for b in batches:
            yield _folded(b)

    bucket = F.pmod(F.xxhash64("branch_id"), F.lit(buckets)).alias("bucket")
    combined = marks.mapInPandas(combine, BRANCH_DDL).select(bucket, "*", F.timestamp_micros("last").alias("at"))
    start = None if initial is None else initial.withColumn("branch_id", F.coalesce("branch_id", F.lit(""))).select(bucket, "branch_id", *FOLD).groupBy("bucket")
    return event_time(combined, "at", delay).groupBy("bucket").transformWithStateInPandas(_Branches(), BRANCH_DDL, "update", "eventTime", initialState=start)


def state_of(spark: SparkSession, folder: str) -> DataFrame:
    """branch_id and the rest of BRANCH_DDL of all branches in the state of a stream with this folder."""
    kept = spark.read.format("statestore").option("stateVarName", "branches").load(f"{folder}/checkpoint")
    return kept.select(F.inline(F.arrays_zip(*[F.col(f"value.{c}") for c in ["branch_id", *FOLD]])))


def commit_lag(commits: DataFrame, arrivals: DataFrame, key: str, bound: str, delay: str = "10 minutes", salts: int = 1) -> DataFrame:
    """One row per commit (key, committed_at), once the bound is over: arrivals, first_arrival, lag_seconds, status (`arrived` or `lost`).

    A left outer join by key and time: a commit that nothing answers within `bound` leaves the join when the watermark has passed the bound, as `lost`. With
    `salts`, the arrivals of a hot key are spread over that many tasks, each of which has a copy of the commit; an aggregate makes one
    row of them, so a commit is lost only if it is in all. Null keys are answered by nothing, and lost; null times are dropped.
    """
    c = event_time(commits.where("committed_at IS NOT NULL"), "committed_at", delay).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("c")
    a = event_time(arrivals.where("arrived_at IS NOT NULL"), "arrived_at", delay).withColumnRenamed(key, "_key")
    a = a.withColumn("_salt", F.pmod(F.xxhash64(*a.columns), F.lit(salts)).cast("int")).alias("a")
    on = F.expr(f"c.{key} = a._key AND c._salt = a._salt AND a.arrived_at >= c.committed_at AND a.arrived_at <= c.committed_at + INTERVAL {bound}")
    per = c.join(a, on, "left_outer").groupBy(key, "committed_at").agg(F.count("arrived_at").alias("arrivals"), F.min("arrived_at").alias("first_arrival"))
    lag = (F.unix_micros("first_arrival") - F.unix_micros("committed_at")) / F.lit(1e6)
    return per.withColumn("lag_seconds", lag).withColumn("status", F.when(F.col("arrivals") > 0, "arrived").otherwise("lost"))
