"""Stateful per-key operators in batch: windows where SQL can say it, a walk over sorted partitions where state feeds back into itself."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timejoin import pieces

DEDUP_S, RATE, RATE_S, GAP_S = 5.0, 10, 60.0, 60


def incidents(alerts: DataFrame, keys: list[str], gap: str = "60 seconds") -> DataFrame:
    """Sessions per key: an alert exactly one gap after the last one still joins."""
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    grouped = alerts.groupBy(*keys, F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"), F.max_by("severity", rank).alias("severity"), F.count_distinct("rule_id").alias("n_rules")).drop("w")


def incident_details(alerts: DataFrame, keys: list[str], gap_s: float = GAP_S, as_of: str | None = None, tie: str = "event_id") -> DataFrame:
    """Incidents whole: id, first_seen, last_seen, n, severity (the highest), alert_ids in order, rule_ids in the order of their first alert, and
    status: closed once as_of (the last alert of all, if not given) is more than a gap after the last alert."""
    w = Window.partitionBy(*keys).orderBy("ts", tie)
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = alerts.withColumn("__at", at).withColumn("__new", F.coalesce((F.col("__at") - F.lag("__at").over(w) > gap_s).cast("int"), F.lit(1)))
    rows = rows.withColumn("__s", F.sum("__new").over(w))
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    listed = F.array_sort(F.collect_list(F.struct("ts", F.col(tie).alias("id"), "rule_id")))
    found = rows.groupBy(*keys, "__s").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"), F.max_by("severity", rank).alias("severity"), listed.alias("__x"))
    found = found.withColumns({"alert_ids": F.transform("__x", lambda x: x["id"]), "rule_ids": F.array_distinct(F.transform("__x", lambda x: x["rule_id"]))})
    found = found.withColumn("id", F.concat(F.lit("inc-"), F.left(F.sha2(F.to_json(F.struct(*keys, "first_seen")), 256), F.lit(16))))
    if as_of is None:
        found = found.withColumn("__now", alerts.agg(F.max("ts")).scalar())
    else:
        found = found.withColumn("__now", F.lit(as_of).cast("timestamp"))
    idle = (F.unix_micros(F.col("__now").cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 1e6
    return found.withColumns({"status": F.when(idle > gap_s, "closed").otherwise("open"), "idle_s": idle}).drop("__s", "__x", "__now")


def list_incidents(incidents: DataFrame, namespace: str = "", status: str = "", limit: int = 0) -> DataFrame:
    """Newest first; empty filters let all pass."""
    rows = incidents.where(F.col("namespace") == namespace) if namespace else incidents
    rows = (rows.where(F.col("status") == status) if status else rows).orderBy(F.desc("last_seen"), "id")
    return rows.limit(limit) if limit > 0 else rows


def retained(incidents: DataFrame, gap_s: float = GAP_S, times: int = 5) -> DataFrame:
    """Without closed incidents idle for more than ``times`` gaps."""
    return incidents.where((F.col("status") == "open") | (F.col("idle_s") <= times * gap_s))


def digests(alerts: DataFrame, keys: list[str], idle: str = "5 minutes", samples: int = 5, tie: str = "event_id") -> DataFrame:
    """Alerts of a key folded until it is idle: first_seen, last_seen, n, the ids of the first samples, and a line of text."""
    grouped = alerts.groupBy(*keys, F.session_window("ts", idle).alias("w"))
    found = grouped.agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("ts", F.col(tie).alias("id")))), 1, samples).alias("x"))
    text = F.concat_ws(" ", F.concat(F.col("n").cast("string"), F.lit("x")), *[F.col(k).cast("string") for k in keys])
    return found.withColumns({"samples": F.transform("x", lambda x: x["id"]), "summary": text}).drop("w", "x")


def recent(events: DataFrame, key: str, columns: list[str], n: int = 20, tie: str = "event_id") -> DataFrame:
    """Adds to each event the last n of its key, itself included."""
    w = Window.partitionBy(key).orderBy("ts", tie).rowsBetween(-(n - 1), 0)
    return events.withColumn("recent", F.collect_list(F.struct(*columns) if len(columns) > 1 else F.col(columns[0])).over(w))


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which nulls are equal; the right side's keys go."""
    names = {k: f"__on{i}" for i, k in enumerate(keys)}
    right = right.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in right.columns])
    on = [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right, on, how).drop(*names.values())


def first_seen(events: DataFrame, workload: list[str], value: str, cap: int | None = 256, tie: str = "event_id", forget_s: float | None = None) -> DataFrame:
    """Adds is_new: the workload hasn't shown the value before. Values after the first ``cap`` are never learned, so stay new; without a
    cap no workload's values are gathered. forget_s (without a cap): a value not shown for longer is new again. A null workload or value is one
    like any other, and a row without a time comes first."""
    if forget_s is not None:
        last = F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy(*workload, value).orderBy("ts", tie))
        return events.withColumn("is_new", last.isNull() | (F.unix_micros(F.col("ts").cast("timestamp")) - last > int(forget_s * 1e6)))
    firsts = events.groupBy(*workload, value).agg(F.min(F.struct("ts", tie)).alias("__first"))
    rank = F.lit(0) if cap is None else F.row_number().over(Window.partitionBy(*workload).orderBy("__first"))
    rows, cap = joined(events, firsts.withColumn("__n", rank), [*workload, value]), cap or 0
    return rows.withColumn("is_new", F.struct("ts", tie).eqNullSafe(F.col("__first")) | (F.col("__n") > cap)).drop("__first", "__n")


def drift(events: DataFrame, key: str, value: str, learn: str = "1 day") -> DataFrame:
    """Values that a key shows only after its learning window: first sight of each."""
    start = events.groupBy(key).agg(F.min("ts").alias("__start"))
    seen = events.groupBy(key, value).agg(F.min("ts").alias("first_seen"), F.count(F.lit(1)).alias("n"))
    return joined(seen, start, [key]).where(F.col("first_seen") >= F.col("__start") + F.expr(f"interval {learn}")).drop("__start")


def transitions(events: DataFrame, key: str, state: str, tie: str = "event_id") -> DataFrame:
    """(prev, cur, n, log10p): how often a key's state follows another, with log probabilities by prev."""
    w = Window.partitionBy(key).orderBy("ts", tie)
    pairs = events.select(F.lag(state).over(w).alias("prev"), F.col(state).alias("cur")).where("prev is not null").groupBy("prev", "cur").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("log10p", F.log10(F.col("n") / F.sum("n").over(Window.partitionBy("prev"))))


def markov_scores(events: DataFrame, key: str, state: str, window: int = 64, floor: float = -3.0, tie: str = "event_id") -> DataFrame:
    """Adds ll, the mean log10 probability of the last ``window`` transitions of the key."""
    w = Window.partitionBy(key).orderBy("ts", tie)
    table = transitions(events, key, state, tie).select("prev", "cur", "log10p")
    rows = events.withColumn("prev", F.lag(state).over(w)).withColumn("cur", F.col(state)).join(table, ["prev", "cur"], "left")
    ll = F.when(F.col("prev").isNotNull(), F.greatest(F.coalesce("log10p", F.lit(floor)), F.lit(floor)))
    return rows.withColumn("__ll", ll).withColumn("ll", F.avg("__ll").over(w.rowsBetween(-(window - 1), 0))).drop("prev", "cur", "log10p", "__ll")


def basic_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population variance and deviation, least, most, count."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.stddev_pop(value).alias("stddev"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd == 0, F.when(x == mean, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise((x - mean) / sd)


def same(a: tuple, b: tuple | None) -> bool:
    """Equal keys; nulls are equal."""
    return b is not None and all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b, strict=True))


class Limiter:
    """Dedup and rate limit of one rule's alerts in time order: a key is quiet until dedup_s after its last admitted alert; at most
    ``rate`` are admitted in rate_s; only what both admit counts for either. Holds only what can still matter."""

    def __init__(self, dedup_s: float, rate: int, rate_s: float):
        self.dedup_s, self.rate, self.rate_s = dedup_s, rate, rate_s
        self.last: dict[tuple, float] = {}  # in order of time
        self.log: deque[float] = deque()

    def admit(self, at: float, key: tuple) -> bool:
        while self.log and not self.log[0] >= at - self.rate_s:
            self.log.popleft()
        while self.last and self.last[oldest := next(iter(self.last))] <= at - self.dedup_s:
            del self.last[oldest]
        ok = not (key in self.last and self.last[key] > at - self.dedup_s) and len(self.log) < self.rate
        if ok:
            self.last.pop(key, None)
            self.last[key] = at
            self.log.append(at)
        return ok


def in_order(rows: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Each key's rows in one partition in time order, sorted by Spark (which spills), so that a task can walk them in batches."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, F.col("__s").asc_nulls_last(), tie)


def limited(alerts: DataFrame, rule: str, key: list[str], dedup_s: float = DEDUP_S, rate: int = RATE, rate_s: float = RATE_S, tie: str = "event_id") -> DataFrame:
    """Alerts that the coupled dedup and rate limit admit. Where a rule is silent for longer than both windows its past has no say, so it is cut
    there, and the pieces are walked in parallel. Alerts without a time pass, as in all limits."""
    rows = alerts.withColumn("__s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    timed = pieces(rows.where("__s is not null"), [rule], max(dedup_s, rate_s))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, limiter = None, None
        for pdf in batches:
            out = []
            for r, at, k in zip(zip(pdf[rule], pdf["__piece"], strict=True), pdf["__s"], zip(*[pdf[c] for c in key], strict=True), strict=True):
                if not same(r, current):
                    current, limiter = r, Limiter(dedup_s, rate, rate_s)
                out.append(limiter.admit(at, k))
            yield pdf[out].drop(columns=["__s", "__piece"])

    return in_order(timed, [rule, "__piece"], tie).mapInPandas(run, alerts.schema).union(rows.where("__s is null").select(*alerts.columns))


def aggregated(alerts: DataFrame, keys: list[str], window_s: float = 60.0, tie: str = "event_id") -> DataFrame:
    """Alerts of a key folded into windows from their first one on; an alert exactly at the end still folds. A key is cut where it is silent for
    longer than a window. Its alerts without a time are one window without times."""
    rows = alerts.withColumn("__s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).select(*keys, "__s", "ts", tie)
    rows = pieces(rows, keys, window_s)
    kinds = dict(alerts.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", first_seen timestamp, last_seen timestamp, n long"
    names = [*keys, "first_seen", "last_seen", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, start, window = None, None, None  # one open window, carried from batch to batch
        for pdf in batches:
            out = []
            for k, at, ts in zip(zip(*[pdf[c] for c in (*keys, "__piece")], strict=True), pdf["__s"], pdf["ts"], strict=True):
                if not same(k, current) or at > start + window_s:
                    if window:
                        out.append((*current[:-1], *window))
                    current, start, window = k, at, [ts, ts, 0]
                window[1] = window[1] if pd.isna(ts) else ts
                window[2] += 1
            if out:
                yield pd.DataFrame(out, columns=names)
        if window:
            yield pd.DataFrame([(*current[:-1], *window)], columns=names)

    return in_order(rows, [*keys, "__piece"], tie).mapInPandas(run, schema)


def learned_sets(events: DataFrame, keys: list[str], sets: dict[str, Column], namespace: str = "", container: str = "", comm_prefix: str = "") -> DataFrame:
    """Of each workload its events and the sorted set of each column's values that aren't null, from events that pass the filters."""
    for column, value in (("namespace", namespace), ("container_id", container)):
        events = events.where(F.col(column) == value) if value else events
    events = events.where(F.col("comm").startswith(comm_prefix)) if comm_prefix else events
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items()])


def drift_classes(events: DataFrame, key: str, learn: str = "5 minutes", tie: str = "event_id") -> DataFrame:
    """What a container shows after its learning window and not in it: (event, kind, value) with kind one of syscall, exec, library, directory, ip,
    port; of a path the first of program, library and directory that fits. Events have nr, path, daddr and dport, each may be null."""
    from ..functions.fields import is_library, is_program, profile_directory

    path = F.col("path")
    of_path = F.when(is_program(path), F.struct(F.lit("exec").alias("kind"), path.alias("value"))).when(is_library(path), F.struct(F.lit("library").alias("kind"), path.alias("value"))).when(path.isNotNull(), F.struct(F.lit("directory").alias("kind"), profile_directory(path).alias("value")))
    plain = lambda kind, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")))
    start = events.groupBy(key).agg(F.min("ts").alias("__start"))
    shown = F.filter(F.array(plain("syscall", "nr"), of_path, plain("ip", "daddr"), plain("port", "dport")), lambda x: x.isNotNull())
    seen = events.select(key, "ts", tie, F.explode(shown).alias("x")).select(key, "ts", tie, "x.*")
    seen = joined(seen, start, [key])
    learned = F.col("ts") < F.col("__start") + F.expr(f"interval {learn}")
    known = seen.where(learned).select(key, "kind", "value").distinct()
    return joined(seen.where(~learned), known, [key, "kind", "value"], "left_anti").select(tie, key, "ts", "kind", "value")


def markov_anomalies(events: DataFrame, key: str, state: str, baseline: float, window: int = 64, threshold: float = 0.35, tie: str = "event_id") -> DataFrame:
    """``markov_scores`` with score, how far (0 to 1) ll lies below the baseline mean in units of 3, and is_anomaly."""
    rows = markov_scores(events, key, state, window, tie=tie)
    score = F.least(F.greatest(F.lit(baseline) - F.coalesce("ll", F.lit(baseline)), F.lit(0.0)) / 3, F.lit(1.0))
    return rows.withColumn("score", score).withColumn("is_anomaly", F.col("score") > threshold)


def mean_log10(table: DataFrame) -> DataFrame:
    """The mean log10 probability of a table of transitions, by their counts: the baseline of ``markov_anomalies``."""
    return table.agg((F.sum(F.col("n") * F.col("log10p")) / F.sum("n")).alias("baseline"))


def unique_rate(events: DataFrame, key: str, value: str, window_s: int = 60, per_minute: float = 100) -> DataFrame:
    """Windows in which a key shows more distinct values than per_minute, scaled to the window and rounded up."""
    most = math.ceil(round(per_minute * window_s / 60, 9))
    found = events.groupBy(F.window("ts", f"{window_s} seconds").alias("w"), key).agg(F.count_distinct(value).alias("n"))
    return found.where(F.col("n") > most).select(F.col("w.start").alias("start"), key, "n")


def bounded_counters(rows: DataFrame, labels: list[str], folded: list[str], most: int, tie: str = "event_id") -> DataFrame:
    """Counts by label tuple; of the tuples after the first ``most`` to arrive, the folded labels become "other"."""
    firsts = rows.groupBy(*labels).agg(F.min(F.struct("ts", tie)).alias("__first"), F.count(F.lit(1)).alias("n"))
    admitted = firsts.orderBy("__first").limit(most).select(*labels, F.lit(True).alias("__in"))
    on = [F.col(f"f.{c}").eqNullSafe(F.col(f"a.{c}")) for c in labels]
    both = firsts.alias("f").join(admitted.alias("a"), on, "left")
    named = [F.when(F.col("a.__in").isNull(), "other").otherwise(F.col(f"f.{c}").cast("string")).alias(c) if c in folded else F.col(f"f.{c}").alias(c) for c in labels]
    return both.select(*named, F.col("f.n").alias("n")).groupBy(*labels).agg(F.sum("n").alias("n"))


def learned_profile(events: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """How many distinct values of each column a workload has shown, and its events."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(f"n_{c}") for c in columns])
