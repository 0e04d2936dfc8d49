"""The event-analytics operators bound to the test tables, each with the SQL that it is held against.

Events bind as: ts, user_id as pid, event_type as kind, value, and props.k (0 to 99); severity is critical above 100.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as fn
from ..operators import alerts as al
from ..operators import behaviour as bh
from ..operators import lookups as lk
from ..operators.rules import Condition as C
from ..operators.rules import Group, Rule, evaluate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = [
    Rule("big_purchase", "purchase", C("value", "gt", (100,)), "critical"),
    Rule("odd_click", "click", Group("or", (C("k", "in", ("7", "13", "77")), C("value", "gte", (200,)))), "warning"),
    Rule("error_burst", "error", Group("and", (C("value", "lt", (20,)), C("k", "not_in", ("1", "2", "3")))), "warning", exceptions=(C("user", "prefix", ("1",)),)),
    Rule("signup_pattern", "signup", Group("and", (C("k", "regex", ("^[5-9]0$",)),), (Group("or", (C("user", "suffix", ("7", "9")), C("user", "contains", ("00",)))),)), "info"),
    Rule("quiet_view", "view", Group("and", (C("value", "lte", (5,)), C("k", "not_equals", ("50",)), C("user", "not_prefix", ("9",)), C("user", "not_suffix", ("0",)))), "info"),
    Rule("dropped", "view", C("value", "gt", (0,)), "info", action="drop"),
]
#: The same events and rules in SQL, as common table expressions.
EVENTS_SQL = """e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(user_id AS VARCHAR) AS u FROM events)"""
ALERTS_SQL = f"""WITH {EVENTS_SQL}, alerts AS (
 SELECT event_id, ts, user_id AS pid, event_type AS comm, k, value, 'big_purchase' AS rule_id, 'critical' AS severity FROM e WHERE event_type = 'purchase' AND value > 100
 UNION ALL SELECT event_id, ts, user_id, event_type, k, value, 'odd_click', 'warning' FROM e WHERE event_type = 'click' AND (k IN (7, 13, 77) OR value >= 200)
 UNION ALL SELECT event_id, ts, user_id, event_type, k, value, 'error_burst', 'warning' FROM e WHERE event_type = 'error' AND value < 20 AND k NOT IN (1, 2, 3) AND NOT starts_with(u, '1')
 UNION ALL SELECT event_id, ts, user_id, event_type, k, value, 'signup_pattern', 'info' FROM e WHERE event_type = 'signup' AND k IN (50, 60, 70, 80, 90) AND (u LIKE '%7' OR u LIKE '%9' OR u LIKE '%00%')
 UNION ALL SELECT event_id, ts, user_id, event_type, k, value, 'quiet_view', 'info' FROM e WHERE event_type = 'view' AND value <= 5 AND k <> 50 AND NOT starts_with(u, '9') AND u NOT LIKE '%0')"""


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def fields() -> dict:
    return {"value": F.col("value"), "k": F.col("k"), "user": F.col("user_id"), "kind": F.col("event_type")}


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluate(events(spark, sf), RULES, fields())
    return found.select("event_id", "ts", F.col("user_id").alias("pid"), F.col("event_type").alias("comm"), "k", "value", "rule_id", "severity")


def domains(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", fn.host_of_url(F.col("url")).alias("qname"), fn.path_of_url(F.col("url")).alias("path"))


DOMAINS_SQL = r"""WITH d AS (SELECT page_id, lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/:?#]*)', 1)) AS qname, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)"""


@query(ALERTS_SQL + " SELECT rule_id, severity, count(*) AS n, count(DISTINCT pid) AS n_pids FROM alerts GROUP BY ALL")
def rule_replay(spark, sf):
    return alerts(spark, sf).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pid").alias("n_pids"))


@query(ALERTS_SQL + " SELECT event_id, rule_id, severity, pid, value FROM alerts")
def rule_alerts(spark, sf):
    return alerts(spark, sf).select("event_id", "rule_id", "severity", "pid", "value")


@query(ALERTS_SQL + " SELECT severity, count(*) AS n FROM alerts GROUP BY ALL")
def severity_counts(spark, sf):
    return al.severity_counts(alerts(spark, sf))


@query(ALERTS_SQL + " SELECT rule_id, count(*) AS n FROM alerts GROUP BY ALL ORDER BY n DESC, rule_id LIMIT 3")
def top_rules(spark, sf):
    return al.top_rules(alerts(spark, sf), 3)


@query(ALERTS_SQL + ", b AS (SELECT min(date_trunc('hour', ts)) AS a, max(date_trunc('hour', ts)) AS z FROM alerts), h AS (SELECT unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS hour FROM b), c AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM alerts GROUP BY 1) SELECT hour, coalesce(n, 0) AS n FROM h LEFT JOIN c USING (hour) ORDER BY hour LIMIT 500")
def hourly_timeline(spark, sf):
    return al.timeline(alerts(spark, sf))


@query(ALERTS_SQL + " SELECT event_id, ts, pid, rule_id FROM alerts WHERE ts >= '2024-01-05' AND ts <= '2024-01-20' AND severity IN ('critical', 'warning') AND contains(lower(comm), 'c') ORDER BY ts DESC, rule_id, event_id LIMIT 50 OFFSET 20")
def alert_page(spark, sf):
    f = al.Filters(since="2024-01-05", until="2024-01-20", severities=["critical", "warning"], comm="C")
    return al.page(alerts(spark, sf), f, 50, 20).select("event_id", "ts", "pid", "rule_id")


@query(ALERTS_SQL + " SELECT count(*) AS n FROM alerts WHERE rule_id IN ('odd_click', 'quiet_view') AND pid IN (1, 2, 3, 5, 8, 13, 21)")
def filtered_count(spark, sf):
    return al.where(alerts(spark, sf), al.Filters(rules=["odd_click", "quiet_view"], pids=[1, 2, 3, 5, 8, 13, 21])).agg(F.count(F.lit(1)).alias("n"))


@query(ALERTS_SQL + " SELECT 'rule_id' AS dimension, rule_id AS key, count(*) AS n FROM alerts GROUP BY 2 UNION ALL SELECT 'comm', comm, count(*) FROM alerts GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM alerts GROUP BY 2")
def simulation_report(spark, sf):
    return al.report(alerts(spark, sf), ["rule_id", "comm", "severity"])


@query(ALERTS_SQL + " SELECT pid, rule_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY pid, rule_id ORDER BY event_id DESC) AS r FROM alerts) WHERE r = 1")
def alert_upsert(spark, sf):
    rows = alerts(spark, sf).withColumn("id", F.concat_ws("-", "rule_id", "pid"))
    return al.upsert(rows, "id", "event_id").select("pid", "rule_id", "event_id", "ts")


@query(ALERTS_SQL + " SELECT event_id, ts FROM alerts ORDER BY ts DESC, event_id DESC LIMIT 100")
def keep_newest(spark, sf):
    return al.keep_newest(alerts(spark, sf), 100).select("event_id", "ts")


@query(f"WITH {EVENTS_SQL}, m AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, k % 4 ORDER BY ts, event_id) AS p FROM e), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, k % 4 ORDER BY ts, event_id) AS g FROM m) SELECT user_id, k % 4 AS ns, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, CASE WHEN max(value) > 100 THEN 'critical' ELSE 'warning' END AS severity, count(DISTINCT event_type) AS n_rules FROM s GROUP BY user_id, k % 4, g")
def incidents(spark, sf):
    rows = events(spark, sf).withColumns({"ns": F.col("k") % 4, "severity": F.when(F.col("value") > 100, "critical").otherwise("warning"), "rule_id": F.col("event_type")})
    return bh.incidents(rows, ["user_id", "ns"], "6 hours")


@query("SELECT event_id, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), ',') AS recent FROM events")
def recent_events(spark, sf):
    return bh.recent(events(spark, sf), "user_id", ["event_id"]).select("event_id", F.array_join(F.transform("recent", lambda x: x.cast("string")), ",").alias("recent"))


@query(f"WITH {EVENTS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY event_type, k % 4, user_id ORDER BY ts, event_id) AS r FROM e) SELECT event_id, r = 1 AS is_new FROM f")
def first_seen(spark, sf):
    rows = events(spark, sf).withColumn("ns", F.col("k") % 4)
    return bh.first_seen(rows, ["event_type", "ns"], "user_id", cap=None).select("event_id", "is_new")


@query(f"WITH {EVENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type, k ORDER BY ts, event_id) AS r, min((ts, event_id)) OVER (PARTITION BY event_type, k) AS o FROM e), c AS (SELECT *, dense_rank() OVER (PARTITION BY event_type ORDER BY o) AS d FROM n) SELECT event_id, CASE WHEN r = 1 OR d > 40 THEN 1.0 ELSE 0.0 END AS score FROM c")
def anomaly_score_capped(spark, sf):
    rows = bh.first_seen(events(spark, sf), ["event_type"], "k", cap=40)
    return rows.select("event_id", F.when(F.col("is_new"), F.lit(1.0)).otherwise(0.0).alias("score"))


@query(f"WITH {EVENTS_SQL}, s AS (SELECT user_id, min(ts) AS t0 FROM e GROUP BY 1), v AS (SELECT user_id, k, min(ts) AS first_seen, count(*) AS n FROM e GROUP BY 1, 2) SELECT user_id, k, first_seen, n FROM v JOIN s USING (user_id) WHERE first_seen >= t0 + INTERVAL 7 DAY")
def container_drift(spark, sf):
    return bh.drift(events(spark, sf), "user_id", "k", "7 days")


@query(f"WITH {EVENTS_SQL}, t AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, event_type AS cur FROM e), c AS (SELECT prev, cur, count(*) AS n FROM t WHERE prev IS NOT NULL GROUP BY 1, 2) SELECT prev, cur, n, round(log10(n / sum(n) OVER (PARTITION BY prev)), 6) AS log10p FROM c")
def markov_transitions(spark, sf):
    return bh.transitions(events(spark, sf), "user_id", "event_type").withColumn("log10p", F.round("log10p", 6))


@query(f"WITH {EVENTS_SQL}, t AS (SELECT event_id, user_id, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, event_type AS cur FROM e), c AS (SELECT prev, cur, count(*) AS n FROM t WHERE prev IS NOT NULL GROUP BY 1, 2), p AS (SELECT prev, cur, greatest(log10(n / sum(n) OVER (PARTITION BY prev)), -3.0) AS l FROM c), j AS (SELECT event_id, user_id, ts, l FROM t LEFT JOIN p USING (prev, cur)) SELECT event_id, round(avg(l) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW), 6) AS ll FROM j")
def markov_window_score(spark, sf):
    return bh.markov_scores(events(spark, sf), "user_id", "event_type").select("event_id", F.round("ll", 6).alias("ll"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 6) AS stddev, min(value) AS least, max(value) AS most, count(value) AS n FROM events GROUP BY 1")
def basic_stats(spark, sf):
    found = bh.basic_stats(events(spark, sf), ["event_type"], "value")
    return found.withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 4), "stddev": F.round("stddev", 6)})


@query("WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS d FROM events GROUP BY 1) SELECT event_id, round(CASE WHEN d = 0 THEN 0 ELSE (value - m) / d END, 4) AS z FROM events JOIN s USING (event_type)")
def z_scores(spark, sf):
    rows = events(spark, sf)
    both = rows.join(bh.basic_stats(rows, ["event_type"], "value"), "event_type")
    return both.select("event_id", F.round(bh.z_score(F.col("value"), F.col("mean"), F.col("stddev")), 4).alias("z"))


@query(f"WITH {EVENTS_SQL} SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS n_event_type, count(DISTINCT k) AS n_k FROM e GROUP BY 1")
def learned_profile(spark, sf):
    return bh.learned_profile(events(spark, sf), ["user_id"], ["event_type", "k"])


@query(f"WITH {EVENTS_SQL} SELECT user_id, count(DISTINCT k) AS n_k FROM e GROUP BY 1 HAVING count(DISTINCT k) < 45")
def sparse_profiles(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.count_distinct("k").alias("n_k")).where("n_k < 45")


@query(f"WITH {EVENTS_SQL}, i AS (SELECT user_id AS v, max(ts) AS x FROM e WHERE k = 13 GROUP BY 1) SELECT event_id FROM e JOIN i ON user_id = v AND ts < x")
def indicator_match(spark, sf):
    rows = events(spark, sf)
    iocs = rows.where("k = 13").select(F.col("user_id").alias("value"), F.col("ts").alias("expires_at"))
    return lk.match_indicators(rows, "user_id", iocs).select("event_id")


@query(f"WITH {EVENTS_SQL} SELECT event_type AS type, user_id AS value, max(ts) AS expires_at, max_by(k, (ts, k)) AS k FROM e GROUP BY 1, 2")
def indicator_merge(spark, sf):
    rows = events(spark, sf).select(F.col("event_type").alias("type"), F.col("user_id").alias("value"), F.col("ts").alias("expires_at"), "k")
    return lk.merge_indicators(rows)


@query("WITH n AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS ip FROM events), r AS (SELECT * FROM (VALUES (167772160, 184549375), (3232235520, 3232301055), (2886729728, 2887778303), (50000000, 50000255)) t(lo, hi)) SELECT event_id, ip FROM n WHERE EXISTS (SELECT 1 FROM r WHERE ip BETWEEN lo AND hi)")
def network_ranges(spark, sf):
    rows = events(spark, sf).select("event_id", ((F.col("event_id") * 2654435761) % 4294967296).alias("ip"))
    nets = [fn.cidr_bounds(x) for x in ("10.0.0.0/8", "192.168.0.0/16", "172.16.0.0/12")] + [(50000000, 50000255)]
    return lk.in_ranges(rows, F.col("ip"), spark.createDataFrame(nets, "lo long, hi long"))


@query(DOMAINS_SQL + ", l AS (SELECT DISTINCT qname AS x FROM d WHERE ends_with(qname, '.net') AND starts_with(path, '/de/') UNION SELECT 'example.org') SELECT page_id FROM d WHERE EXISTS (SELECT 1 FROM l WHERE qname = x OR ends_with(qname, '.' || x))")
def domain_suffixes(spark, sf):
    rows = domains(spark, sf)
    listed = rows.where("endswith(qname, '.net') and startswith(path, '/de/')").select(F.col("qname").alias("domain")).union(spark.createDataFrame([("example.org",)], "domain string"))
    return lk.match_domains(rows, "qname", listed, "page_id").select("page_id")


@query("SELECT event_id, c_name, n_name FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def enrichment(spark, sf):
    pods = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("user_id"), "c_name", "n_name")
    return lk.enrich(events(spark, sf), pods, "user_id", ["c_name", "n_name"]).select("event_id", "c_name", "n_name")


@query(ALERTS_SQL + " SELECT event_id, rule_id FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM alerts f WHERE f.k = 7 AND f.rule_id = a.rule_id AND f.pid = a.pid)")
def feedback_suppression(spark, sf):
    found = alerts(spark, sf)
    return lk.suppress(found, found.where("k = 7"), ["rule_id", "pid"]).select("event_id", "rule_id")


@query(ALERTS_SQL + " SELECT event_id, rule_id FROM alerts WHERE NOT (rule_id = 'odd_click' AND severity = 'warning' AND ts <= '2024-01-15') AND NOT (rule_id = 'quiet_view' AND severity = 'info' AND ts <= '2024-01-10')")
def silences(spark, sf):
    s = spark.createDataFrame([("odd_click", "warning", "2024-01-15"), ("quiet_view", "info", "2024-01-10"), ("quiet_view", "warning", "2024-02-10")], "rule_id string, severity string, until string")
    return lk.silence(alerts(spark, sf), s.withColumn("until", F.col("until").cast("timestamp"))).select("event_id", "rule_id")


@query(f"WITH {EVENTS_SQL}, s AS (SELECT k % 4 AS ns, ts AS a, ts + INTERVAL 5 HOUR AS z, 0.5 + (event_id % 4) / 10.0 AS m FROM e WHERE k = 99) SELECT e.event_id, round(coalesce(min(m), 1.0), 3) AS multiplier FROM e LEFT JOIN s ON e.k % 4 = ns AND e.ts >= a AND e.ts < z GROUP BY 1")
def amplification(spark, sf):
    rows = events(spark, sf).withColumn("namespace", F.col("k") % 4)
    signals = rows.where("k = 99").select("namespace", F.col("ts").alias("starts_at"), F.expr("ts + interval 5 hours").alias("expires_at"), (F.lit(0.5) + (F.col("event_id") % 4) / 10.0).alias("multiplier"))
    return lk.least_multiplier(rows, signals, "event_id").select("event_id", F.round("multiplier", 3).alias("multiplier"))


@query("SELECT user_id, min(ts) AS first_seen FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 150) GROUP BY 1")
def hidden_processes(spark, sf):
    rows = events(spark, sf)
    return lk.hidden(rows, rows.where("event_type = 'signup' and value > 150"), "user_id")


@query("WITH RECURSIVE p AS (SELECT c_custkey AS pid, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS ppid FROM customer), t AS (SELECT pid, ppid AS ancestor, 1 AS level FROM p WHERE ppid IS NOT NULL UNION ALL SELECT t.pid, p.ppid, level + 1 FROM t JOIN p ON p.pid = t.ancestor WHERE p.ppid IS NOT NULL AND level < 5) SELECT * FROM t")
def process_ancestry(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("pid"), F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2)).alias("ppid"))
    return lk.ancestry(rows, 5)


@query(ALERTS_SQL + ", a AS (SELECT DISTINCT rule_id FROM alerts WHERE comm <> 'view'), b AS (SELECT DISTINCT rule_id FROM alerts WHERE comm <> 'click') SELECT coalesce(a.rule_id, b.rule_id) AS rule_id, CASE WHEN a.rule_id IS NULL THEN 'added' WHEN b.rule_id IS NULL THEN 'removed' ELSE 'common' END AS change FROM a FULL JOIN b ON a.rule_id = b.rule_id")
def rule_id_diff(spark, sf):
    found = alerts(spark, sf)
    return lk.rule_diff(found.where("comm <> 'view'"), found.where("comm <> 'click'"))


@query(DOMAINS_SQL + r""", l AS (SELECT page_id, qname, string_split(qname, '.') AS x FROM d), b AS (SELECT *, CASE WHEN len(x) <= 2 THEN x[1] ELSE array_to_string(x[1:len(x) - 1], '') END AS base FROM l), c AS (SELECT base, unnest(string_split(base, '')) AS ch FROM (SELECT DISTINCT base FROM b)), f AS (SELECT base, ch, count(*) / strlen(base) AS p FROM c WHERE ch <> '' GROUP BY base, ch), h AS (SELECT base, -sum(p * log2(p)) AS entropy FROM f GROUP BY 1)
 SELECT page_id, strlen(qname) AS qname_length, greatest(len(x) - 2, 0) AS subdomains, round(length(regexp_replace(qname, '[^0-9]', '', 'g')) / strlen(qname), 4) AS digits, round(entropy, 4) AS entropy, strlen(base) >= 10 AND entropy > 3.5 AS generated, strlen(qname) > 50 AS tunneling FROM b JOIN h USING (base)""")
def dns_features(spark, sf):
    q = F.col("qname")
    names = domains(spark, sf)
    scored = names.select("qname").distinct().select("qname", F.octet_length(q).alias("qname_length"), fn.subdomain_count(q).alias("subdomains"), F.round(fn.digit_ratio(q), 4).alias("digits"), F.round(fn.entropy(fn.base_domain(q)), 4).alias("entropy"), fn.is_generated(q).alias("generated"), fn.is_tunneling(q).alias("tunneling"))
    return names.select("page_id", "qname").join(scored, "qname").drop("qname")


@query(DOMAINS_SQL + r""", s AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '')[1:2] AS x FROM d) SELECT page_id, CASE WHEN path = '' THEN '' ELSE '/' || array_to_string(list_transform(x, lambda y: CASE WHEN regexp_full_match(y, '[0-9]+') THEN '*' ELSE y END), '/') END AS prefix, regexp_extract(path, '^(.*/)', 1) AS directory, regexp_extract(path, '(\.[^./]*)$', 1) AS extension FROM s""")
def path_features(spark, sf):
    p = F.col("path")
    return domains(spark, sf).select("page_id", fn.path_prefix(p).alias("prefix"), fn.profile_directory(p).alias("directory"), fn.profile_extension(p).alias("extension"))


@query(ALERTS_SQL + """ SELECT event_id, rule_id, sha256('{"id":"a' || event_id || '","ts":' || (epoch_us(ts) * 1000) || ',"rule_id":"' || rule_id || '","severity":"' || severity || '","pid":' || pid || ',"comm":"' || comm || '","msg":"\\u003ck\\u003e ' || k || '"' || CASE WHEN k % 2 = 0 THEN '' ELSE ',"ns":"n' || k || '"' END || '}') AS fingerprint FROM alerts""")
def alert_fingerprints(spark, sf):
    c, ns = F.col, F.when(F.col("k") % 2 == 0, "").otherwise(F.concat(F.lit("n"), F.col("k").cast("string")))
    text = F.concat(F.lit("<k> "), c("k").cast("string"))
    found = fn.alert_fingerprint(F.concat(F.lit("a"), c("event_id").cast("string")), c("ts"), c("rule_id"), c("severity"), c("pid"), c("comm"), text, F.lit(""), ns)
    return alerts(spark, sf).select("event_id", "rule_id", found.alias("fingerprint"))


@query(ALERTS_SQL + " SELECT 'CEF:0|argusframe|events|1.0|' || rule_id || '|' || comm || '|' || CASE severity WHEN 'critical' THEN '10' WHEN 'warning' THEN '5' ELSE '4' END || '|pid=' || pid AS line FROM alerts")
def cef_lines(spark, sf):
    a = alerts(spark, sf)
    return a.select(fn.cef_line("argusframe", F.col("rule_id"), F.col("comm"), F.col("severity"), F.concat(F.lit("pid="), F.col("pid").cast("string"))).alias("line"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 0 THEN 0 ELSE CAST(floor(log2(CAST(l_quantity AS BIGINT))) AS INTEGER) END AS bucket FROM lineitem")
def size_buckets(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fn.size_bucket(F.col("l_quantity").cast("long")).alias("bucket"))


@query("SELECT doc_id, regexp_matches(text, '(?i)[a-z0-9.]+@[a-z0-9.-]+') AS has_mail, contains(text, '|') AS has_pipe, starts_with(text, 'The') AS has_start FROM documents")
def text_predicates(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", t.rlike("(?i)[a-z0-9.]+@[a-z0-9.-]+").alias("has_mail"), t.contains("|").alias("has_pipe"), t.startswith("The").alias("has_start"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2 HAVING count(DISTINCT user_id) > ceil(0.03 * 86400 / 60)")
def unique_rate(spark, sf):
    return bh.unique_rate(events(spark, sf), "event_type", "user_id", 86400, 0.03)


@query(f"""WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT event_id, event_type, epoch_us(ts) / 1e6 AS s, user_id || '/' || k AS key, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM e),
 r AS (SELECT event_type, n, event_id, TRUE AS ok, [{{'s': s, 'key': key}}] AS log FROM o WHERE n = 1
 UNION ALL SELECT event_type, n, event_id, ok, CASE WHEN ok THEN list_append(log, {{'s': s, 'key': key}}) ELSE log END FROM (SELECT *, len(list_filter(log, lambda x: x.key = key AND x.s > s - 21600)) = 0 AND len(log) < 10 AS ok FROM (SELECT o.*, list_filter(r.log, lambda x: x.s >= o.s - 43200) AS log FROM r JOIN o ON o.event_type = r.event_type AND o.n = r.n + 1)))
 SELECT event_id, event_type FROM r WHERE ok""")
def dedup_rate_limit(spark, sf):
    rows = events(spark, sf)
    return bh.limited(rows, "event_type", ["user_id", "k"], dedup_s=6 * 3600, rate=10, rate_s=12 * 3600).select("event_id", "event_type")


@query(f"""WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM e), j AS (SELECT o.user_id, o.event_type, o.i, o.ts, count(*) AS n, max(x.ts) AS last_seen FROM o JOIN o x ON x.user_id = o.user_id AND x.event_type = o.event_type AND x.i >= o.i AND x.ts <= o.ts + INTERVAL 24 HOUR GROUP BY ALL),
 r AS (SELECT * FROM j WHERE i = 1 UNION ALL SELECT j.* FROM r JOIN j ON j.user_id = r.user_id AND j.event_type = r.event_type AND j.i = r.i + r.n) SELECT user_id, event_type, ts AS first_seen, last_seen, n FROM r""")
def alert_aggregation(spark, sf):
    found = bh.aggregated(events(spark, sf), ["user_id", "event_type"], 24 * 3600)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import along_time, detection, formats  # noqa: F401  they register theirs

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import along_time, detection, formats  # noqa: F401

    return dict(ORACLES)
