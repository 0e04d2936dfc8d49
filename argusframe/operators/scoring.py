"""Anomaly scores of events against what their workload has shown, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .behaviour import joined

#: A score from which an event is anomalous, and values a workload learns of a dimension.
ANOMALOUS, CAP = 0.8, 256


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Scaled to 0 to 1; equal bounds give 0.5 at the bound and 1 off it."""
    return F.when(low == high, F.when(x == low, F.lit(0.5)).otherwise(F.lit(1.0))).otherwise((x - low) / (high - low))


def anomaly_scores(events: DataFrame, workload: list[str], parts: list[tuple[str, str, float, int | None]], tie: str = "event_id") -> DataFrame:
    """Adds score, is_anomaly and contributions (field=value of what is new). parts: (field, column, weight, cap of learned values or None): a
    value that its workload hasn't shown before adds the weight; null or empty ones add nothing. The score is at most 1.

    All parts are judged at once: an event's values become rows (part, value), first sights are found once, and what is new comes back as one row an event."""
    shown = F.filter(F.array(*[F.struct(F.lit(i).alias("__part"), F.col(c).cast("string").alias("__value")) for i, (_, c, _, _) in enumerate(parts)]), lambda x: x["__value"] != "")
    shown = events.select(*workload, "ts", tie, F.inline(shown))
    firsts = shown.groupBy(*workload, "__part", "__value").agg(F.min(F.struct("ts", tie)).alias("__first"))
    caps, of = F.lit([c if c is not None else -1 for *_, c in parts]), lambda values: F.get(values, F.col("__part"))
    # values of a part without a cap need no order, so that they are dealt out
    dealt = F.when(of(caps) < 0, F.pmod(F.xxhash64("__value"), F.lit(1024)))
    rank = F.row_number().over(Window.partitionBy(*workload, "__part", dealt).orderBy("__first"))
    firsts = firsts.withColumn("__over", (of(caps) >= 0) & (rank > of(caps)))
    seen = joined(shown, firsts, [*workload, "__part", "__value"]).where(F.struct("ts", tie).eqNullSafe(F.col("__first")) | F.col("__over"))
    text = F.concat(of(F.lit([f for f, *_ in parts])), F.lit("="), F.col("__value"))
    new = seen.groupBy(tie).agg(F.array_sort(F.collect_set(F.struct(F.col("__part").alias("part"), text.alias("text")))).alias("__new"))  # one entry a part
    weights = F.lit([float(w) for _, _, w, _ in parts])
    rows = events.join(new, tie, "left")
    score = F.aggregate("__new", F.lit(0.0), lambda total, x: total + F.get(weights, x["part"]))
    told = F.transform("__new", lambda x: x["text"])
    rows = rows.withColumns({"score": F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0))), "contributions": F.coalesce(told, F.array().cast("array<string>"))})
    return rows.withColumn("is_anomaly", F.col("score") >= ANOMALOUS).drop("__new")


def network_scores(events: DataFrame, workload: list[str], port: str = "dport", address: str = "daddr") -> DataFrame:
    return anomaly_scores(events, workload, [("dport", port, 0.5, None), ("daddr", address, 0.5, CAP)])


def file_scores(events: DataFrame, workload: list[str], directory: str = "directory", extension: str = "extension") -> DataFrame:
    return anomaly_scores(events, workload, [("directory", directory, 0.6, CAP), ("extension", extension, 0.4, CAP)])


def syscall_scores(events: DataFrame, workload: list[str], number: str = "nr") -> DataFrame:
    return anomaly_scores(events, workload, [("syscall_nr", number, 1.0, None)])


def gpu_scores(events: DataFrame, workload: list[str], op: str = "gpu_op", bucket: str = "size_bucket") -> DataFrame:
    """A workload's first use scores 1, whatever its op and size."""
    return anomaly_scores(events, workload, [("gpu_op", op, 0.6, None), ("size_bucket", bucket, 0.4, None)])


def anomaly_message(contributions: Column) -> Column:
    head = F.lit("Anomalous behavior detected")
    return F.when(F.size(contributions) == 0, head).otherwise(F.concat(head, F.lit(": "), F.array_join(contributions, ", ")))


def fused(behaviour: Column, allowlist: Column) -> Column:
    """Of both signals (null: none): the behaviour's score, or the allowlist's; 1 half and half where both speak."""
    both = F.greatest(behaviour, F.lit(1.0)) * 0.5 + 0.5
    return F.when(behaviour.isNotNull() & allowlist.isNotNull(), both).otherwise(F.coalesce(behaviour, allowlist))


def top_scores(scores: DataFrame, keys: list[str], n: int = 10_000, tie: str = "event_id") -> DataFrame:
    """The latest score of each key, the ``n`` highest."""
    rest = [c for c in scores.columns if c not in keys]
    last = scores.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", tie)).alias("x")).select(*keys, "x.*")
    return last.orderBy(F.desc("score"), *keys).limit(n)
