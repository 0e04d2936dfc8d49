"""Operators with keyed state on streams, in the order of event time: first sights with expiry, drift after learning, windows from the first alert on, and
the coupled limiter.

A key's rows wait until the watermark has passed them; then they are walked by (ts, tie), so rows that come late, but within the
watermark, have their place, and the result is that of the batch operator over all rows that weren't too late. What an operator holds of a key lives in state of its
own and goes by event-time timers: once nothing that may still come could ask for it.

Python gets the keys by BUCKETS of their hash, so a call to the state store is made for a bucket and not for a key or row, and a batch's work and a task's memory
follow the rows and what is held of them, however few or many keys there are.

The streams need a watermark on ``ts`` and the RocksDB state store (``with_rocksdb``). Rows without a time are left out, as the watermark can't
place them; null keys are keys.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import behaviour

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Whether a batch without rows follows where the watermark has moved.
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
#: Buckets of keys, and how many rows or keys are one value of the state store.
BUCKETS, PIECE = 1024, 20_000
NUMBERS = ("bigint", "int", "smallint", "tinyint")


@contextmanager
def with_conf(spark: SparkSession, name: str, value: str):
    """A session's setting while a stream is started; set back afterwards."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_rocksdb(spark: SparkSession):
    """The session's state store while a stream is started; set back afterwards."""
    return with_conf(spark, PROVIDER, ROCKSDB)


class InOrder(StatefulProcessor):
    """Keeps the rows (at, tie, payload, key's texts) of a bucket until the watermark has passed them, then hands each key's to ``walk`` in order, with what is held of the key.

    ``at`` is in microseconds. ``walk`` and ``expire`` return what is held from then on (None: nothing) and the rows told of; ``expire`` is told the watermark (us) and
    also says when it wants to be called again (us)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.held = handle.getListState("waiting", "data binary"), handle.getListState("held", "data binary")
        self.timer = handle.getValueState("timer", "ms bigint")

    def walk(self, state, rows: list[tuple]) -> tuple:
        raise NotImplementedError

    def expire(self, state, watermark: int) -> tuple:
        return state, [], None

    @staticmethod
    def pieces(items: list) -> list[tuple]:
        return [(pickle.dumps(items[i : i + PIECE]),) for i in range(0, len(items), PIECE)]

    @staticmethod
    def read(state) -> list:
        return [x for (data,) in (state.get() if state.exists() else ()) for x in pickle.loads(bytes(data))]

    def write(self, state, items: list) -> None:
        if items:
            state.put(self.pieces(items))
        else:
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = []
        for pdf in rows:
            at, tie, *texts = [pdf.iloc[:, i] for i in range(-3 - self.n_keys, 0)]
            new += zip(at.tolist(), tie.tolist(), *[c.astype(object).where(c.notna(), None).tolist() for c in texts], strict=True)
        if new:
            self.waiting.appendList(self.pieces(new))
            self.wake(min(r[0] for r in new))
        return iter(())

    def wake(self, micros: int) -> None:
        """The bucket's one timer comes at this time at the latest."""
        ms, before = -(-micros // 1000), (self.timer.get() or (None,))[0]
        if before is None or ms < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, held = self.read(self.waiting), dict(self.read(self.held))
        due = sorted((r for r in waiting if r[0] <= mark), key=itemgetter(0, 1))
        left = [r for r in waiting if r[0] > mark]
        if due:
            self.write(self.waiting, left)
        by_key, out, wakes = {}, [], [min(r[0] for r in left)] if left else []
        for r in due:
            by_key.setdefault(r[3:], []).append(r[:3])
        for name, rows in by_key.items():
            held[name], told = self.walk(held.get(name), rows)
            out += [(*name, *x) for x in told]
        kept = []
        for name, state in held.items():
            told, again = (), None
            if state is not None:
                state, told, again = self.expire(state, mark)
            if state is not None:
                kept.append((name, state))
            if again is not None:
                wakes.append(max(again, mark + 1))
            out += [(*name, *x) for x in told]
        self.write(self.held, kept)
        self.timer.clear()
        if wakes:
            self.wake(min(wakes))
        if out:
            yield pd.DataFrame(out, columns=self.columns)


def as_text(c: Column, kind: str) -> Column:
    """A value as text that ``of_text`` makes the value of again; equal values have equal texts."""
    if kind in ("double", "float"):
        c = c + F.lit(0).cast(kind)  # one zero
    if kind.startswith(("array", "struct", "map")):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return {"timestamp": F.unix_micros, "binary": F.base64}.get(kind, lambda x: x)(c).cast("string")


def of_text(c: Column, kind: str) -> Column:
    if kind.startswith(("array", "struct", "map")):
        return F.from_json(c, kind)
    return {"timestamp": lambda x: F.timestamp_micros(x.cast("bigint")), "binary": F.unbase64}.get(kind, lambda x: x.cast(kind))(c)


def tie_text(c: Column, kind: str) -> Column:
    """A tie's text sorts as the value does for numbers of up to 20 digits."""
    number = F.lpad((c.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.coalesce(number if kind in NUMBERS else c.cast("string"), F.lit(""))


def of_tie(c: Column, kind: str) -> Column:
    return (c.try_cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast(kind) if kind in NUMBERS else c.try_cast(kind)


def ordered(events: DataFrame, keys: list[str], tie: str, row: Column) -> DataFrame:
    """The bucket, and what ``InOrder`` takes of a row."""
    kinds = dict(events.dtypes)
    texts = [as_text(F.col(k), kinds[k]).alias(f"__key{i}") for i, k in enumerate(keys)]
    rows = events.where("ts is not null").select("ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("__at"), tie_text(F.col(tie), kinds[tie]).alias("__tie"), row.cast("string").alias("__row"), *texts)
    bucket = F.pmod(F.xxhash64(*[f"__key{i}" for i in range(len(keys))]), F.lit(BUCKETS)).cast("int")
    return rows.select("ts", bucket.alias("__bucket"), *rows.columns[1:])


def run_in_order(events: DataFrame, keys: list[str], tie: str, row: Column, processor: InOrder, added: str) -> DataFrame:
    """The keys and the columns ``added``, as texts and numbers of microseconds."""
    kinds = dict(events.dtypes)
    schema = ", ".join(f"__key{i} string" for i in range(len(keys))) + ", " + added
    processor.n_keys, processor.columns = len(keys), [x.split()[0] for x in schema.split(", ")]
    found = ordered(events, keys, tie, row).groupBy("__bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return found.select(*[of_text(F.col(f"__key{i}"), kinds[k]).alias(k) for i, k in enumerate(keys)], *processor.columns[len(keys) :])


class Sights(InOrder):
    """Which rows show a key that hasn't been shown in the last ``forget_us``; held is when it was last, which goes after that time."""

    def __init__(self, forget_us: int | None):
        self.forget_us = forget_us

    def walk(self, state: int | None, rows: list[tuple]) -> tuple:
        out = []
        for at, tie, _ in rows:
            out.append((at, tie, state is None or (self.forget_us is not None and at - state > self.forget_us)))
            state = at
        return state, out

    def expire(self, state: int, watermark: int) -> tuple:
        if self.forget_us is None:
            return state, [], None
        return (None, [], None) if state + self.forget_us < watermark else (state, [], state + self.forget_us + 1000)


def stream_first_seen(events: DataFrame, workload: list[str], value: str, forget_s: float | None = None, tie: str = "event_id") -> DataFrame:
    """(workload, ts, tie, value, is_new) of every row, as ``behaviour.first_seen`` without a cap. The values of a workload are keys of their own, dealt out over all tasks."""
    forget = None if forget_s is None else int(forget_s * 1e6)
    found = run_in_order(events, [*workload, value], tie, F.lit(None), Sights(forget), "__at bigint, __tie string, is_new boolean")
    return found.select(*workload, F.timestamp_micros("__at").alias("ts"), of_tie(F.col("__tie"), dict(events.dtypes)[tie]).alias(tie), value, "is_new")


class Drift(InOrder):
    """First sights of values after the key's learning window; the whole key goes after ``forget_us`` without a row. Held are the first and last time and the values."""

    def __init__(self, learn_us: int, forget_us: int | None):
        self.learn_us, self.forget_us = learn_us, forget_us

    def walk(self, state: tuple | None, rows: list[tuple]) -> tuple:
        out = []
        first, last, known = state or (rows[0][0], rows[0][0], set())
        for at, _, value in rows:
            if self.forget_us is not None and at - last > self.forget_us:
                known, first = set(), at
            if value not in known:
                known.add(value)
                if at >= first + self.learn_us:
                    out.append((value, at))
            last = at
        return (first, last, known), out

    def expire(self, state: tuple, watermark: int) -> tuple:
        if self.forget_us is None:
            return state, [], None
        end = state[1] + self.forget_us
        return (None, [], None) if end < watermark else (state, [], end + 1000)


def stream_drift(events: DataFrame, key: str, value: str, learn_s: float = 86_400, forget_s: float | None = None, tie: str = "event_id") -> DataFrame:
    """(key, value, first_seen): as ``behaviour.drift``, without the counts; told once for each value. A key that is silent for longer than
    forget_s begins anew."""
    own, kind = Drift(int(learn_s * 1e6), None if forget_s is None else int(forget_s * 1e6)), dict(events.dtypes)[value]
    found = run_in_order(events, [key], tie, as_text(F.col(value), kind), own, "__value string, __at bigint")
    return found.select(key, of_text(F.col("__value"), kind).alias(value), F.timestamp_micros("__at").alias("first_seen"))


class Folding(InOrder):
    """One open window (first, last, n) a key, from its first alert on; closed by the first alert after it or by the watermark."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def walk(self, state: tuple | None, rows: list[tuple]) -> tuple:
        out, window = [], state
        for at, _, _ in rows:
            if window is None or at > window[0] + self.window_us:
                if window:
                    out.append(window)
                window = (at, at, 0)
            window = (window[0], at, window[2] + 1)
        return window, out

    def expire(self, state: tuple, watermark: int) -> tuple:
        end = state[0] + self.window_us
        return (None, [state], None) if end < watermark else (state, [], end + 1000)


def stream_aggregated(alerts: DataFrame, keys: list[str], window_s: float = 60.0, tie: str = "event_id") -> DataFrame:
    """(keys, first_seen, last_seen, n), as ``behaviour.aggregated``: a window is told of when it is over."""
    found = run_in_order(alerts, keys, tie, F.lit(None), Folding(int(window_s * 1e6)), "__first bigint, __last bigint, n bigint")
    return found.select(*keys, F.timestamp_micros("__first").alias("first_seen"), F.timestamp_micros("__last").alias("last_seen"), "n")


class Limiting(InOrder):
    """``behaviour.Limiter`` with its admitted alerts (at in seconds, name) held."""

    def __init__(self, dedup_s: float, rate: int, rate_s: float):
        self.dedup_s, self.rate, self.rate_s = dedup_s, rate, rate_s

    def walk(self, state: list | None, rows: list[tuple]) -> tuple:
        limiter, kept, out = behaviour.Limiter(self.dedup_s, self.rate, self.rate_s), list(state or ()), []
        for at, name in kept:
            limiter.last[name] = at
            limiter.log.append(at)
        for micros, tie, name in rows:
            if limiter.admit(micros / 1e6, name):
                kept.append((micros / 1e6, name))
                out.append((micros, tie))
        since = rows[-1][0] / 1e6 - max(self.dedup_s, self.rate_s)
        return [x for x in kept if x[0] >= since] or None, out

    def expire(self, state: list, watermark: int) -> tuple:
        end = max(x[0] for x in state) + max(self.dedup_s, self.rate_s)
        return (None, [], None) if end * 1e6 < watermark else (state, [], int(end * 1e6) + 1000)


def stream_admitted(alerts: DataFrame, rule: str, keys: list[str], dedup_s: float = behaviour.DEDUP_S, rate: int = behaviour.RATE, rate_s: float = behaviour.RATE_S, tie: str = "event_id") -> DataFrame:
    """(rule, ts, tie) of the alerts that the coupled limiter admits, in event time whatever order they come in, as ``behaviour.limited``."""
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    found = run_in_order(alerts, [rule], tie, name, Limiting(dedup_s, rate, rate_s), "__at bigint, __tie string")
    return found.select(rule, F.timestamp_micros("__at").alias("ts"), of_tie(F.col("__tie"), dict(alerts.dtypes)[tie]).alias(tie))


def replay(source: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, idle: bool = True) -> DataFrame:
    """Runs a stream over all that its source has, into Parquet at ``path``/out with its checkpoint beside; a further call goes on from there. Not ``idle``: what the
    watermark has passed by the last batch's rows is left to the next call."""
    spark = source.sparkSession
    with with_conf(spark, IDLE, str(idle).lower()), with_rocksdb(spark):
        out = operator(source)
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")
