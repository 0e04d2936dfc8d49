"""Join-shaped computations: indicators, networks, domains, enrichment, suppression, intervals, ancestry.

Dimension tables are joined without hints: Spark broadcasts them when their measured size allows and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timejoin import live_least, not_seen_elsewhere


def match_indicators(events: DataFrame, key: str, indicators: DataFrame, ts: str = "ts") -> DataFrame:
    """Events whose key is an indicator that hadn't expired; indicators: (value, expires_at)."""
    live = indicators.groupBy(F.col("value").alias("__v")).agg(F.max("expires_at").alias("__e"))
    return events.join(live, (F.col(key) == F.col("__v")) & (F.col(ts) < F.col("__e")), "left_semi")


def merge_indicators(indicators: DataFrame) -> DataFrame:
    """Of each (type, value) the one that expires last."""
    rest = [c for c in indicators.columns if c not in ("type", "value")]
    return indicators.groupBy("type", "value").agg(F.max_by(F.struct(*rest), F.struct("expires_at", *[c for c in rest if c != "expires_at"])).alias("x")).select("type", "value", "x.*")


def suffixes(name: Column) -> Column:
    """A domain and all its parents."""
    labels = F.split(F.lower(name), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def match_domains(events: DataFrame, name: str, listed: DataFrame, key: str) -> DataFrame:
    """Events whose domain is listed or lies below a listed one; an equi join on exploded parents, not a scan of the list."""
    parents = events.select(F.col(key), F.explode(suffixes(F.col(name))).alias("domain"))
    hit = parents.join(listed.select(F.lower("domain").alias("domain")), "domain", "left_semi").select(key).distinct()
    return events.join(hit, key, "left_semi")


def in_ranges(events: DataFrame, value: Column, ranges: DataFrame, bits: int = 8, width: int = 32) -> DataFrame:
    """Events whose number lies in any range (lo, hi): ranges are cut at blocks of 2**(width - bits) numbers, so the join has a key."""
    block = 1 << (width - bits)
    cut = ranges.select("lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))).alias("__b"))
    rows = events.withColumn("__x", value).withColumn("__b", F.floor(F.col("__x") / block))
    return rows.alias("e").join(cut.alias("r"), (F.col("e.__b") == F.col("r.__b")) & F.col("e.__x").between(F.col("r.lo"), F.col("r.hi")), "left_semi").drop("__x", "__b")


def enrich(events: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fills only what is missing, null or an empty text: a column that events have already keeps its value. Of repeated keys the greatest row counts,
    so no event is repeated."""
    side = table.groupBy(key).agg(F.max(F.struct(*columns)).alias("__x")).select(F.col(key), *[F.col("__x")[c].alias(f"__{c}") for c in columns])
    rows, kinds = events.join(side, key, "left"), dict(events.dtypes)
    own = lambda c: F.nullif(F.col(c), F.lit("")) if kinds[c] == "string" else F.col(c)
    filled = [F.coalesce(own(c), F.col(f"__{c}"), F.col(c)).alias(c) if c in events.columns else F.col(f"__{c}").alias(c) for c in columns]
    return rows.select(*[c for c in events.columns if c not in columns], *filled)


def suppress(alerts: DataFrame, feedback: DataFrame, keys: list[str]) -> DataFrame:
    """Alerts that no feedback of their keys silences."""
    return alerts.join(feedback.select(*keys).distinct(), keys, "left_anti")


def silence(alerts: DataFrame, silences: DataFrame) -> DataFrame:
    """Alerts without a silence of their rule and severity that is still on; silences: (rule_id, severity, until)."""
    s = silences.groupBy(F.col("rule_id").alias("__r"), F.col("severity").alias("__s")).agg(F.max("until").alias("__u"))
    return alerts.join(s, (F.col("rule_id") == F.col("__r")) & (F.col("severity") == F.col("__s")) & (F.col("ts") <= F.col("__u")), "left_anti")


def least_multiplier(events: DataFrame, signals: DataFrame, key: str, ts: str = "ts", bucket_s: int = 3600) -> DataFrame:
    """Adds the smallest multiplier of the signals of a namespace that were live at the event, 1.0 without any; signals: (namespace, starts_at,
    expires_at, multiplier). One sweep over starts and events, in pieces of bucket_s."""
    return live_least(events, signals, "namespace", "multiplier", ts, bucket_s, key).withColumn("multiplier", F.coalesce("multiplier", F.lit(1.0)))


def hidden(seen: DataFrame, visible: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Keys that were seen but aren't visible, with their first sight."""
    return seen.join(visible.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.min(ts).alias("first_seen")).orderBy(key)


def ancestry(processes: DataFrame, depth: int = 10) -> DataFrame:
    """(pid, ancestor, level) up to ``depth`` levels above each process; processes: (pid, ppid), one row a pid. Each level is one join onto a row
    that carries the levels below it; they become rows at the end, so no level is computed twice."""
    up = processes.select(F.col("pid").alias("__of"), F.col("ppid").alias("__next")).where("ppid is not null and ppid <> pid")
    rows = processes.select("pid", F.when(F.col("ppid") != F.col("pid"), F.col("ppid")).alias("__1")).where("__1 is not null")
    for n in range(2, depth + 1):
        rows = rows.join(up, F.col(f"__{n - 1}") == F.col("__of"), "left").withColumnRenamed("__next", f"__{n}").drop("__of")
    levels = F.posexplode(F.array(*[F.col(f"__{n}") for n in range(1, depth + 1)]))
    return rows.select("pid", levels.alias("__at", "ancestor")).where("ancestor is not null").select("pid", "ancestor", (F.col("__at") + 1).alias("level"))


def rule_diff(old: DataFrame, new: DataFrame, key: str = "rule_id") -> DataFrame:
    a, b = old.select(key, F.lit(True).alias("__a")).distinct(), new.select(key, F.lit(True).alias("__b")).distinct()
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("common")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def suppress_feedback(alerts: DataFrame, feedback: DataFrame, anomaly_rule: str = "anomaly") -> DataFrame:
    """Alerts that no false-positive feedback (verdict, rule_id, comm) silences: by rule and comm, and alerts of the anomaly rule by comm alone."""
    wrong = feedback.where("verdict = 'false_positive'")
    left = suppress(alerts, wrong, ["rule_id", "comm"])
    known = wrong.where(F.col("rule_id") == anomaly_rule).select(F.col("comm").alias("__c")).distinct()
    return left.join(known, (F.col("rule_id") == anomaly_rule) & (F.col("comm") == F.col("__c")), "left_anti")


def unseen_elsewhere(alerts: DataFrame, seen: DataFrame, ttl_s: int = 300, ts: str = "ts") -> DataFrame:
    """Alerts whose fingerprint no other node told of in the last ttl_s seconds; seen: (fingerprint, node, at). One sort of both, no pairs."""
    return not_seen_elsewhere(alerts, seen, ttl_s, ts)


def extract_indicators(alerts: DataFrame, ttl: str = "24 hours", node: str = "") -> DataFrame:
    """(type, value, source, rule_id, severity, expires_at) of alerts (event_type, daddr, qname, fingerprint): public addresses of network alerts,
    names of DNS alerts, fingerprints of all."""
    from .policy import is_private

    ip, name, print_ = F.col("daddr"), F.col("qname"), F.col("fingerprint")
    valid = ip.rlike(r"^[0-9.]+\z|:") & ~is_private(ip) & ~F.lower(ip).rlike(r"^(::1|fe80:.*|f[cd][0-9a-f]{2}:.*)\z")
    pick = lambda kind, test, v: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(kind).alias("type"), v.alias("value")))
    found = F.filter(F.array(pick("ip", (F.col("event_type") == "network") & valid, ip), pick("dns", (F.col("event_type") == "dns") & (name != ""), name), pick("fingerprint", print_ != "", print_)), lambda x: x.isNotNull())
    rows = alerts.select(F.explode(found).alias("x"), "rule_id", "severity", "ts")
    return rows.select("x.type", "x.value", F.lit(node).alias("source"), "rule_id", "severity", (F.col("ts") + F.expr(f"interval {ttl}")).alias("expires_at"))


def explain(alerts: DataFrame, templates: DataFrame) -> DataFrame:
    """Adds template_id: the template of the rule's id, else the first by id that begins with the id's part before "_"; templates: (template_id).
    Prefixes become join keys."""
    ids = templates.select("template_id").distinct()
    starts = ids.select("template_id", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("template_id")), lambda i: F.left("template_id", i))).alias("__start"))
    firsts = starts.groupBy("__start").agg(F.min("template_id").alias("__first"))
    rules = alerts.select("rule_id").distinct().withColumn("__start", F.substring_index("rule_id", "_", 1))
    own = ids.select(F.col("template_id").alias("rule_id"), F.lit(True).alias("__own"))
    found = rules.join(own, "rule_id", "left").join(firsts, "__start", "left").select("rule_id", F.when(F.col("__own"), F.col("rule_id")).otherwise(F.col("__first")).alias("template_id"))
    return alerts.join(found, "rule_id", "left")


def tampering(events: DataFrame, allowed: DataFrame, commands: tuple = (2, 3, 9)) -> DataFrame:
    """Events of the commands (update, delete, detach) by processes that aren't allowed; allowed: (pid)."""
    return events.where(F.col("cmd").isin(list(commands))).join(allowed.select("pid").distinct(), "pid", "left_anti")


def mining_signs(events: DataFrame, ports: list, names: list[str]) -> DataFrame:
    """Adds on_mining_port and has_mining_name, by owned lists of ports and parts of process names."""
    from .rules import any_of

    return events.withColumns({"on_mining_port": F.coalesce(F.col("dport").isin(ports), F.lit(False)), "has_mining_name": F.coalesce(any_of([F.contains(F.lower("comm"), F.lit(n)) for n in names]), F.lit(False))})


def in_chunks(values: DataFrame, column: str, n: int = 500) -> DataFrame:
    """(chunk, items): the distinct values in order, n to a chunk and numbered from 0, so that only the last chunk is shorter. Values are dealt by
    range and numbered within it; the ranges' counts, added up, say where each begins. No task holds all values, and the chunks don't
    depend on how many ranges there are."""
    from pyspark.sql import Window

    own = values.select(F.col(column).alias("__v")).where("__v is not null").distinct()
    # cut points are values of a sample by hash, so that a task that runs again, or another use of the rows, deals as before
    every = own.count() // 2000 + 1
    sample = sorted(r["__v"] for r in own.where(F.pmod(F.xxhash64("__v"), F.lit(every)) == 0).collect())
    cuts = sample[:: max(1, len(sample) // 64)]
    rows = own.withColumn("__p", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("__v"))) if cuts else F.lit(0))
    counts = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy("__v"))).join(counts, "__p")
    rows = rows.withColumn("chunk", F.floor((F.col("__r") + F.col("__base") - 1) / n))
    return rows.groupBy("chunk").agg(F.array_sort(F.collect_list("__v")).alias("items"))
