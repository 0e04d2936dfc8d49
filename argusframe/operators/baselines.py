"""Learned baselines per workload: what was seen while learning is normal, what comes later and wasn't is reported.

Event time orders everything, as (ts, tie). Where learning ends is a matter of elapsed time and samples, so it is found by window
functions; only the sequence baseline feeds back into itself and is walked, over sorted partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .behaviour import in_order, joined, same
from .timejoin import pieces


def learning(events: DataFrame, keys: list[str], period_s: float, samples: int, deadline_s: float | None = None, tie: str = "event_id") -> DataFrame:
    """Adds __learns: the event is part of its workload's learning. The event that completes it is the last: it comes period_s or more after
    the first with at least ``samples`` events, or deadline_s after it."""
    w = Window.partitionBy(*keys).orderBy("ts", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = events.withColumns({"__age": seconds - F.min(seconds).over(w), "__n": F.count(F.lit(1)).over(w)})
    done = (F.col("__age") >= period_s) & (F.col("__n") >= samples)
    if deadline_s is not None:
        done = done | (F.col("__age") >= deadline_s)
    before = Window.partitionBy(*keys).orderBy("ts", tie).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__done", done).withColumn("__learns", ~F.coalesce(F.max("__done").over(before), F.lit(False))).drop("__age", "__n", "__done")


def novel(events: DataFrame, keys: list[str], signature: list[str], period_s: float = 3600, samples: int = 20, deadline_s: float | None = None, tie: str = "event_id") -> DataFrame:
    """Events after their workload's learning whose signature it didn't show while learning (drift-class alerts)."""
    rows = learning(events, keys, period_s, samples, deadline_s, tie)
    known = rows.where("__learns").select(*keys, *signature).distinct()
    late = rows.where("not __learns").drop("__learns")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"k.{c}")) for c in (*keys, *signature)]
    return late.alias("l").join(known.alias("k"), on, "left_anti")


def allowlist_violations(events: DataFrame, keys: list[str], value: str, allow: list = (), deny: list = (), period_s: float = 3600, samples: int = 100, tie: str = "event_id") -> DataFrame:
    """Events whose value is denied to all (source global_deny), or was not learned for their workload (source unknown); an allowed one never."""
    denied = F.col(value).isin(list(deny)) if deny else F.lit(False)
    rows = learning(events, keys, period_s, samples, None, tie)
    known = rows.where("__learns").select(*keys, value).distinct().withColumn("__known", F.lit(True))
    rows = joined(rows, known, [*keys, value], "left")
    if allow:
        rows = rows.where(~F.col(value).isin(list(allow)))
    source = F.when(denied, "global_deny").when(~F.col("__learns") & F.col("__known").isNull(), "unknown")
    return rows.withColumn("source", source).where("source is not null").select(*events.columns, "source")


def cooldown(alerts: DataFrame, keys: list[str], quiet_s: float = 5.0, tie: str = "event_id") -> DataFrame:
    """Alerts that may act: the first of a key, then any that comes quiet_s or more after the last one that acted. A key's rows are walked in
    batches with only that last time in hand; it is cut where it is silent for longer than quiet_s. Alerts without a time may act."""
    rows = alerts.withColumn("__s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    timed = pieces(rows.where("__s is not null"), keys, quiet_s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for pdf in batches:
            out = []
            for k, at in zip(zip(*[pdf[c] for c in (*keys, "__piece")], strict=True), pdf["__s"], strict=True):
                acts = not same(k, current) or at - last >= quiet_s
                if acts:
                    current, last = k, at
                out.append(acts)
            yield pdf[out].drop(columns=["__s", "__piece"])

    return in_order(timed, [*keys, "__piece"], tie).mapInPandas(run, alerts.schema).union(rows.where("__s is null").select(*alerts.columns))


def global_limit(alerts: DataFrame, per_second: int = 10_000, tie: str = "event_id") -> DataFrame:
    """At most ``per_second`` alerts of each second of event time, the earliest: a budget of each second on its own. ``timejoin.token_bucket``
    is the limit whose tokens carry over."""
    w = Window.partitionBy(F.date_trunc("second", "ts")).orderBy("ts", tie)
    return alerts.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_second).drop("__r")


def sights(events: DataFrame, keys: list[str], value: str, tie: str = "event_id") -> DataFrame:
    """(keys, value, first_seen, last_seen, n): what the events show of each workload, as a state that ``merged_sights`` adds up."""
    return events.groupBy(*keys, value).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"))


def merged_sights(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The state of both together; in any order and grouping the same."""
    return a.unionByName(b).groupBy(*keys, value).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"))


def fold_into(new: DataFrame, path: str, keys: list[str], value: str, source: str = "", batch: int | None = None) -> None:
    """Folds new sights into a stored baseline: only the sights that are there already are read, and only cells that change are written.
    A batch of a source that was folded in before changes nothing, so counts stay right when a batch comes again."""
    from ..sinks import store

    spark = new.sparkSession
    key = F.sha2(F.to_json(F.struct(*keys, value), {"ignoreNullFields": "false"}), 256)
    commit = store.commit_of(spark, path)
    if commit and batch is not None and batch <= commit["batches"].get(source, -1):
        return
    held = store.read(spark, path)
    if held is not None:
        known = joined(held.select(*new.columns), new.select(*keys, value), [*keys, value], "left_semi")
        new = merged_sights(new, known, keys, value)
    rows = new.withColumn("id", key).withColumn("order", F.col("n"))
    store.merge(rows, path, "id", "order", None, source, batch)


def new_against(events: DataFrame, known: DataFrame, keys: list[str], value: str, tie: str = "event_id") -> DataFrame:
    """Adds is_new: neither the stored sights nor an earlier one of the events shows the value; history isn't read."""
    held = known.select(*keys, value, F.lit(True).alias("__held")).distinct()
    first = F.row_number().over(Window.partitionBy(*keys, value).orderBy("ts", tie)) == 1
    rows = joined(events.withColumn("__one", first), held, [*keys, value], "left")
    return rows.withColumn("is_new", F.col("__one") & F.col("__held").isNull()).drop("__one", "__held")


def workload_profile(events: DataFrame, keys: list[str], dimensions: dict[str, Column]) -> DataFrame:
    """(keys, dimension, key, n, total): how often a workload showed each value of each dimension, and that dimension at all."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("key")) for d, c in dimensions.items()])).alias("p")
    counts = events.select(*keys, pairs).select(*keys, "p.*").where("key is not null").groupBy(*keys, "dimension", "key").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(*keys, "dimension")))


def ewma(events: DataFrame, keys: list[str], value: str, weight: float = 0.3, tie: str = "event_id") -> DataFrame:
    """(keys, ewma): the exponentially weighted mean after a key's last value; the first value counts whole. A sum with weights that fall
    with the rank from the end, so no value is walked."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc(tie))
    last = events.select(*keys, F.col(value).cast("double").alias("__x"), F.row_number().over(w).alias("__r"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("__m"))
    share = F.when(F.col("__r") == F.col("__m"), F.pow(F.lit(1 - weight), F.col("__r") - 1)).otherwise(F.lit(weight) * F.pow(F.lit(1 - weight), F.col("__r") - 1))
    return last.groupBy(*keys).agg(F.sum(F.col("__x") * share).alias("ewma"))


def sequence_distance(events: DataFrame, keys: list[str], code: str, window: int = 64, width: int = 512, threshold: float = 0.3, pull: float = 0.1, tie: str = "event_id") -> DataFrame:
    """Adds distance and is_anomaly: the cosine distance of the last ``window`` codes' frequencies from the workload's baseline. The baseline is
    the first full window; each normal window pulls it by ``pull``. Events before it are 0 and normal. Codes outside 0 to width - 1 count for no place.
    One workload is walked by one task, in batches, with a window and a baseline in hand."""
    rows = events.withColumn("__s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    names = [*events.columns, "distance", "is_anomaly"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", distance double, is_anomaly boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ring, counts, base, n = None, None, None, None, 0
        for pdf in batches:
            distance, odd = [], []
            for k, c in zip(zip(*[pdf[x] for x in keys], strict=True), pdf[code], strict=True):
                if not same(k, current):
                    current, ring, counts, base, n = k, [-1] * window, np.zeros(width, np.float32), None, 0
                old, c = ring[n % window], int(c) if not pd.isna(c) else -1
                if n >= window and 0 <= old < width:
                    counts[old] -= 1
                ring[n % window] = c
                if 0 <= c < width:
                    counts[c] += 1
                n += 1
                apart, strange = 0.0, False
                if n >= window:
                    now = counts / np.float32(window)
                    if base is None:
                        base = now
                    else:
                        one, two = now.astype(float), base.astype(float)
                        norm = np.sqrt((one * one).sum()) * np.sqrt((two * two).sum())
                        apart = 1.0 - float(np.clip((one * two).sum() / norm, -1, 1)) if norm else 1.0
                        strange = apart > threshold
                        if not strange:
                            base = base * np.float32(1 - pull) + now * np.float32(pull)
                distance.append(apart)
                odd.append(strange)
            yield pdf.assign(distance=distance, is_anomaly=odd)[names]

    return in_order(rows, keys, tie).mapInPandas(run, schema)
