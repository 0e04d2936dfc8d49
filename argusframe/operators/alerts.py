"""Queries over an alert table: filters, paging, counts, summaries, timelines, upserts."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    since: str | None = None
    until: str | None = None
    pids: list = field(default_factory=list)
    severities: list = field(default_factory=list)
    rules: list = field(default_factory=list)
    comm: str | None = None
    namespaces: list = field(default_factory=list)
    pod: str | None = None


def where(alerts: DataFrame, f: Filters) -> DataFrame:
    """Filters are AND-ed; since and until are inclusive; comm is a substring in any case; "*" is every namespace."""
    if f.since:
        alerts = alerts.where(F.col("ts") >= F.lit(f.since).cast("timestamp"))
    if f.until:
        alerts = alerts.where(F.col("ts") <= F.lit(f.until).cast("timestamp"))
    for name, values in (("pid", f.pids), ("severity", f.severities), ("rule_id", f.rules), ("namespace", [] if "*" in f.namespaces else f.namespaces)):
        if values:
            alerts = alerts.where(F.col(name).isin(values))
    alerts = alerts.where(F.col("pod_name") == f.pod) if f.pod else alerts
    return alerts.where(F.contains(F.lower("comm"), F.lit(f.comm.lower()))) if f.comm else alerts


def seconds_of(text: str) -> float:
    """A duration like 1h30m, 90s or 250ms."""
    units = {"h": 3600, "m": 60, "s": 1, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|us|ns|h|m|s)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"no duration: {text}")
    return sum(float(a) * units[b] for a, b in parts)


def parsed(params: Mapping[str, str], now: datetime) -> tuple[Filters, int, int]:
    """(filters, limit, offset) of request parameters: since and until are durations back from now; lists are comma-separated; what can't
    be read, and severities other than warning and critical, are left out."""

    def back(name: str) -> str | None:
        try:
            return (now - timedelta(seconds=seconds_of(params[name]))).isoformat() if params.get(name) else None
        except ValueError:
            return None

    number = lambda name: int(params[name]) if str(params.get(name, "")).isdigit() else 0
    severities = [s for x in params.get("severity", "").split(",") if (s := x.strip().lower()) in ("warning", "critical")]
    names = lambda n: [x for x in params.get(n, "").split(",") if x]
    found = Filters(back("since"), back("until"), [number("pid")] if str(params.get("pid", "")).isdigit() else [], severities, names("rule_id"), params.get("comm") or None, names("namespace"), params.get("pod") or None)
    return found, number("limit"), number("offset")


def scoped(f: Filters, allowed: list[str]) -> Filters:
    """Filters within the namespaces that a token may see; "*" is all of them."""
    if "*" in allowed:
        return f
    inside = [n for n in f.namespaces if n in allowed] if f.namespaces else list(allowed)
    return replace(f, namespaces=inside or ["\0none"])


def by_id(alerts: DataFrame, id: str, key: str = "id") -> DataFrame:
    return alerts.where(F.col(key) == id)


def page(alerts: DataFrame, f: Filters, limit: int = 0, offset: int = 0, tie: str = "event_id") -> DataFrame:
    """Newest first; limit 0 is no limit."""
    rows = where(alerts, f).orderBy(F.desc("ts"), "rule_id", tie)
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit else rows


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def top_rules(alerts: DataFrame, n: int = 10) -> DataFrame:
    return alerts.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").limit(n)


def timeline(alerts: DataFrame, most: int = 500) -> DataFrame:
    """Alerts by UTC hour from the first to the last hour, empty ones too; at most the first ``most`` hours."""
    counts = alerts.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where("a is not null")
    hours = ends.select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("hour"))
    return hours.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n")).orderBy("hour").limit(most)


def upsert(alerts: DataFrame, key: str = "id", order: str = "arrived") -> DataFrame:
    """The last version of each alert; of versions that came at once the greater row."""
    newest = Window.partitionBy(key).orderBy(F.desc(order), *[F.desc(F.col(c).cast("string")) for c in alerts.columns if c not in (key, order)])
    return alerts.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def keep_newest(alerts: DataFrame, n: int, tie: str = "event_id") -> DataFrame:
    return alerts.orderBy(F.desc("ts"), F.desc(tie)).limit(n)


def report(alerts: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each of the columns at once: (dimension, key, n)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("key")) for c in columns])).alias("p")
    return alerts.select(pairs).groupBy("p.dimension", "p.key").agg(F.count(F.lit(1)).alias("n"))


def top_report(alerts: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """``report`` with the n most frequent keys of each column, ties by key; an empty action is alert."""
    rows = alerts.withColumn("action", F.when(F.coalesce("action", F.lit("")) == "", "alert").otherwise(F.col("action"))) if "action" in alerts.columns else alerts
    w = Window.partitionBy("dimension").orderBy(F.desc("n"), "key")
    return report(rows, columns).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def replay_summary(events: DataFrame, alerts: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """(rule_id, name, n, events, matches): the matches of each rule beside all events and all matches; a rule without a name keeps its id."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.lit(None).cast("map<string,string>")
    counts = alerts.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    both = counts.withColumns({"events": events.agg(F.count(F.lit(1))).scalar(), "matches": counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()})
    return both.select("rule_id", F.coalesce(F.try_element_at(known, F.col("rule_id")), F.col("rule_id")).alias("name"), "n", "events", "matches")


def first_samples(alerts: DataFrame, n: int = 20, tie: str = "event_id") -> DataFrame:
    """The first n alerts of a replay."""
    return alerts.orderBy("ts", tie, "rule_id").limit(n)


def technique_coverage(rules: DataFrame, tags: str = "tags") -> DataFrame:
    """(technique, n, rules): which rules tell of each technique, from tags like mitre:T1059."""
    found = rules.select("rule_id", F.explode(tags).alias("tag")).select("rule_id", F.regexp_extract("tag", r"^mitre:(T\d+(?:\.\d+)?)\z", 1).alias("technique")).where("technique <> ''").distinct()
    return found.groupBy("technique").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("rule_id")).alias("rules"))


def technique_alerts(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """(technique, n_rules, n_alerts): how many rules told of each technique and how often; rules: (rule_id, tags). Alerts are counted by rule first."""
    counts = alerts.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    tags = rules.select("rule_id", F.explode("tags").alias("tag")).select("rule_id", F.regexp_extract("tag", r"^mitre:(T\d+(?:\.\d+)?)\z", 1).alias("technique")).where("technique <> ''").distinct()
    return counts.join(tags, "rule_id").groupBy("technique").agg(F.count(F.lit(1)).alias("n_rules"), F.sum("n").alias("n_alerts"))
