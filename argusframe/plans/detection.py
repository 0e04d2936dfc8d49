"""Stateful operators, scores, rule files, sampling, lineage and policies bound to the test tables, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import baselines as bl
from ..operators import behaviour as bh
from ..operators import lineage as ln
from ..operators import lookups as lk
from ..operators import policy as po
from ..operators import rules as ru
from ..operators import scoring as sc
from ..sources import rule_files
from .queries import ALERTS_SQL, EVENTS_SQL, alerts, events, fields, query

SESSIONS_SQL = f"WITH {EVENTS_SQL}, m AS (SELECT *, CASE WHEN value > 100 THEN 'critical' ELSE 'warning' END AS sev, lag(ts) OVER (PARTITION BY user_id, k % 4 ORDER BY ts, event_id) AS p FROM e), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, k % 4 ORDER BY ts, event_id) AS g FROM m)"
DETAILS_SQL = SESSIONS_SQL + """, f AS (SELECT user_id, k % 4 AS ns, g, event_type, min((ts, event_id)) AS o FROM s GROUP BY ALL), q AS (SELECT user_id, ns, g, string_agg(event_type, ',' ORDER BY o) AS rule_ids FROM f GROUP BY ALL),
 a AS (SELECT user_id, k % 4 AS ns, g, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, CASE WHEN max(value) > 100 THEN 'critical' ELSE 'warning' END AS severity, string_agg(event_id, ',' ORDER BY ts, event_id) AS alert_ids FROM s GROUP BY ALL),
 d AS (SELECT user_id, ns, first_seen, last_seen, n, severity, alert_ids, rule_ids, CASE WHEN TIMESTAMP '2024-01-29 12:00:00' - last_seen > INTERVAL 6 HOUR THEN 'closed' ELSE 'open' END AS status, (epoch_us(TIMESTAMP '2024-01-29 12:00:00') - epoch_us(last_seen)) / 1e6 AS idle FROM a JOIN q USING (user_id, ns, g))"""


def details(spark, sf):
    rows = events(spark, sf).withColumns({"ns": F.col("k") % 4, "severity": F.when(F.col("value") > 100, "critical").otherwise("warning"), "rule_id": F.col("event_type")})
    found = bh.incident_details(rows, ["user_id", "ns"], 6 * 3600, as_of="2024-01-29 12:00:00")
    return found.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("alert_ids", "rule_ids")})


@query(DETAILS_SQL + " SELECT user_id, ns, first_seen, last_seen, n, severity, alert_ids, rule_ids, status FROM d")
def incident_details(spark, sf):
    return details(spark, sf).select("user_id", "ns", "first_seen", "last_seen", "n", "severity", "alert_ids", "rule_ids", "status")


@query(DETAILS_SQL + " SELECT user_id, ns, last_seen, alert_ids FROM (SELECT * FROM d WHERE ns = 2 AND status = 'closed' ORDER BY last_seen DESC, alert_ids LIMIT 25)")
def incident_listing(spark, sf):
    found = details(spark, sf).withColumns({"namespace": F.col("ns").cast("string"), "id": F.col("alert_ids")})
    return bh.list_incidents(found, "2", "closed", 25).select("user_id", "ns", "last_seen", "alert_ids")


@query(DETAILS_SQL + " SELECT user_id, ns, first_seen FROM d WHERE status = 'open' OR idle <= 5 * 6 * 3600")
def incident_retention(spark, sf):
    return bh.retained(details(spark, sf), 6 * 3600).select("user_id", "ns", "first_seen")


@query(SESSIONS_SQL.replace("6 HOUR", "12 HOUR") + " SELECT user_id, k % 4 AS ns, min(ts) AS first_seen, count(*) AS n, array_to_string(list(event_id ORDER BY ts, event_id)[1:3], ',') AS samples, count(*) || 'x ' || user_id || ' ' || (k % 4) AS summary FROM s GROUP BY user_id, k % 4, g")
def alert_digests(spark, sf):
    found = bh.digests(events(spark, sf).withColumn("ns", F.col("k") % 4), ["user_id", "ns"], "12 hours", 3)
    return found.select("user_id", "ns", "first_seen", "n", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"), "summary")


def learning_sql(period: str, samples: int, deadline: str | None) -> str:
    late = f" OR ts >= t0 + INTERVAL {deadline}" if deadline else ""
    return f"WITH {EVENTS_SQL}, w AS (SELECT *, min(ts) OVER u AS t0, row_number() OVER u AS n FROM e WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)), x AS (SELECT *, (ts >= t0 + INTERVAL {period} AND n >= {samples}){late} AS done FROM w), l AS (SELECT *, coalesce(NOT max(done) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS learns FROM x)"


@query(learning_sql("5 DAY", 25, "9 DAY") + " SELECT event_id FROM l a WHERE NOT learns AND NOT EXISTS (SELECT 1 FROM l b WHERE b.learns AND b.user_id = a.user_id AND b.event_type = a.event_type AND b.k % 10 = a.k % 10)")
def drift_class_alerts(spark, sf):
    rows = events(spark, sf).withColumn("target", F.col("k") % 10)
    return bl.novel(rows, ["user_id"], ["event_type", "target"], 5 * 86400, 25, 9 * 86400).select("event_id")


@query(learning_sql("8 DAY", 20, None) + " SELECT event_id, CASE WHEN k IN (97, 98) THEN 'global_deny' ELSE 'unknown' END AS source FROM l a WHERE k NOT IN (1, 2, 3) AND (k IN (97, 98) OR (NOT learns AND NOT EXISTS (SELECT 1 FROM l b WHERE b.learns AND b.user_id = a.user_id AND b.k = a.k)))")
def allowlist_violations(spark, sf):
    return bl.allowlist_violations(events(spark, sf), ["user_id"], "k", [1, 2, 3], [97, 98], 8 * 86400, 20).select("event_id", "source")


@query(f"WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM e), j AS (SELECT o.user_id, o.i, o.event_id, min(x.i) AS nxt FROM o LEFT JOIN o x ON x.user_id = o.user_id AND x.i > o.i AND x.ts >= o.ts + INTERVAL 30 HOUR GROUP BY ALL), r AS (SELECT * FROM j WHERE i = 1 UNION ALL SELECT j.* FROM r JOIN j ON j.user_id = r.user_id AND j.i = r.nxt) SELECT event_id FROM r")
def enforcement_cooldown(spark, sf):
    return bl.cooldown(events(spark, sf), ["user_id"], 30 * 3600).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('second', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r <= 1")
def global_limit(spark, sf):
    return bl.global_limit(events(spark, sf), 1).select("event_id")


@query(f"WITH {EVENTS_SQL}, p AS (SELECT user_id, 'kind' AS dimension, event_type AS key FROM e UNION ALL SELECT user_id, 'k', CAST(k AS VARCHAR) FROM e), c AS (SELECT user_id, dimension, key, count(*) AS n FROM p GROUP BY ALL) SELECT *, sum(n) OVER (PARTITION BY user_id, dimension) AS total FROM c")
def workload_profile(spark, sf):
    return bl.workload_profile(events(spark, sf), ["user_id"], {"kind": F.col("event_type"), "k": F.col("k")}).withColumn("total", F.col("total").cast("decimal(38,0)"))


@query("SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: 0.3 * x + 0.7 * a), 6) AS ewma FROM events GROUP BY 1")
def ewma(spark, sf):
    return bl.ewma(events(spark, sf), ["user_id"], "value").withColumn("ewma", F.round("ewma", 6))


@query()
def sequence_distance(spark, sf):
    return bl.sequence_distance(events(spark, sf), ["user_id"], "k", window=16, width=100).select("event_id", F.round("distance", 5).alias("distance"), "is_anomaly")


SCORES_SQL = f"""WITH {EVENTS_SQL}, v AS (SELECT *, CASE WHEN value > 60 THEN event_type END AS kind FROM e), a AS (SELECT user_id, k, min((ts, event_id)) AS o FROM v GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) AS r FROM (SELECT user_id, kind, min((ts, event_id)) AS o FROM v WHERE kind IS NOT NULL GROUP BY 1, 2)),
 s AS (SELECT event_id, ts, v.user_id, a.o = (ts, event_id) AS one, coalesce(b.o = (ts, event_id) OR b.r > 2, FALSE) AS two, v.k, v.kind FROM v JOIN a ON a.user_id = v.user_id AND a.k = v.k LEFT JOIN b ON b.user_id = v.user_id AND b.kind = v.kind),
 z AS (SELECT event_id, ts, user_id, least(1.0, one::INT * 0.5 + two::INT * 0.5) AS score, CASE WHEN NOT one AND NOT two THEN 'Anomalous behavior detected' ELSE 'Anomalous behavior detected: ' || concat_ws(', ', CASE WHEN one THEN 'dport=' || k END, CASE WHEN two THEN 'daddr=' || kind END) END AS message FROM s)"""


def scored(spark, sf):
    rows = events(spark, sf).withColumn("kind", F.when(F.col("value") > 60, F.col("event_type")))
    return sc.anomaly_scores(rows, ["user_id"], [("dport", "k", 0.5, None), ("daddr", "kind", 0.5, 2)])


@query(SCORES_SQL + " SELECT event_id, score, score >= 0.8 AS is_anomaly, message FROM z")
def anomaly_scores(spark, sf):
    return scored(spark, sf).select("event_id", "score", "is_anomaly", sc.anomaly_message(F.col("contributions")).alias("message"))


@query(SCORES_SQL + ", y AS (SELECT user_id, max_by(score, (ts, event_id)) AS score FROM z GROUP BY 1) SELECT * FROM y ORDER BY score DESC, user_id LIMIT 40")
def top_anomaly_scores(spark, sf):
    return sc.top_scores(scored(spark, sf), ["user_id"], 40).select("user_id", "score")


@query(f"WITH {EVENTS_SQL} SELECT event_id, round(CASE WHEN k % 3 = 0 AND k % 5 = 0 THEN greatest(value / 100, 1) * 0.5 + 0.5 WHEN k % 3 = 0 THEN value / 100 WHEN k % 5 = 0 THEN 1.0 END, 6) AS score, round(CASE WHEN value = 0 THEN 0.5 ELSE (value - 0) / 500 END, 6) AS scaled FROM e")
def signal_fusion(spark, sf):
    k, v = F.col("k"), F.col("value")
    fused = sc.fused(F.when(k % 3 == 0, v / 100), F.when(k % 5 == 0, F.lit(1.0)))
    return events(spark, sf).select("event_id", F.round(fused, 6).alias("score"), F.round(F.when(v == 0, 0.5).otherwise(sc.min_max(v, F.lit(0.0), F.lit(500.0))), 6).alias("scaled"))


MARKOV_SQL = f"WITH {EVENTS_SQL}, t AS (SELECT event_id, user_id, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, event_type AS cur FROM e), c AS (SELECT prev, cur, count(*) AS n FROM t WHERE prev IS NOT NULL GROUP BY 1, 2), p AS (SELECT prev, cur, n, log10(n / sum(n) OVER (PARTITION BY prev)) AS l FROM c)"


@query(MARKOV_SQL + ", j AS (SELECT event_id, user_id, ts, CASE WHEN prev IS NOT NULL THEN greatest(l, -3.0) END AS l FROM t LEFT JOIN p USING (prev, cur)), m AS (SELECT event_id, avg(l) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS ll FROM j) SELECT event_id, round(least(greatest(0.5 - coalesce(ll, 0.5), 0) / 3, 1), 6) AS score, least(greatest(0.5 - coalesce(ll, 0.5), 0) / 3, 1) > 0.35 AS is_anomaly FROM m")
def markov_anomalies(spark, sf):
    return bh.markov_anomalies(events(spark, sf), "user_id", "event_type", 0.5).select("event_id", F.round("score", 6).alias("score"), "is_anomaly")


@query(MARKOV_SQL + " SELECT round(sum(n * l) / sum(n), 6) AS baseline FROM p")
def markov_baseline(spark, sf):
    return bh.mean_log10(bh.transitions(events(spark, sf), "user_id", "event_type")).select(F.round("baseline", 6).alias("baseline"))


@query(f"WITH {EVENTS_SQL} SELECT event_type, count(*) AS n, array_to_string(list_sort(list(DISTINCT k)), ',') AS ks FROM e WHERE starts_with(event_type, 'c') OR starts_with(event_type, 'p') GROUP BY 1 HAVING starts_with(event_type, 'p')")
def learned_sets(spark, sf):
    rows = events(spark, sf).withColumn("comm", F.col("event_type"))
    return bh.learned_sets(rows, ["event_type"], {"ks": F.col("k")}, comm_prefix="p").withColumn("ks", F.array_join(F.transform("ks", lambda x: x.cast("string")), ","))


@query(f"""WITH {EVENTS_SQL}, b AS (SELECT *, CASE k % 4 WHEN 0 THEN '/usr/bin/p' || k WHEN 1 THEN '/usr/lib/x' || k || '.so' WHEN 2 THEN '/var/d' || k || '/f' END AS path, min(ts) OVER (PARTITION BY user_id) AS t0 FROM e),
 s AS (SELECT event_id, user_id, ts, t0, 'syscall' AS kind, CAST(k AS VARCHAR) AS value FROM b WHERE value > 50 UNION ALL SELECT event_id, user_id, ts, t0, CASE k % 4 WHEN 0 THEN 'exec' WHEN 1 THEN 'library' ELSE 'directory' END, CASE k % 4 WHEN 2 THEN '/var/d' || k || '/' ELSE path END FROM b WHERE path IS NOT NULL UNION ALL SELECT event_id, user_id, ts, t0, 'port', CAST(k * 10 AS VARCHAR) FROM b WHERE k % 2 = 1)
 SELECT event_id, user_id, ts, kind, value FROM s a WHERE ts >= t0 + INTERVAL 12 DAY AND NOT EXISTS (SELECT 1 FROM s b WHERE b.user_id = a.user_id AND b.kind = a.kind AND b.value = a.value AND b.ts < b.t0 + INTERVAL 12 DAY)""")
def container_drift_classes(spark, sf):
    k, t = F.col("k"), F.col("k").cast("string")
    path = F.when(k % 4 == 0, F.concat(F.lit("/usr/bin/p"), t)).when(k % 4 == 1, F.concat(F.lit("/usr/lib/x"), t, F.lit(".so"))).when(k % 4 == 2, F.concat(F.lit("/var/d"), t, F.lit("/f")))
    rows = events(spark, sf).withColumns({"nr": F.when(F.col("value") > 50, k), "path": path, "daddr": F.lit(None).cast("string"), "dport": F.when(k % 2 == 1, k * 10)})
    return bh.drift_classes(rows, "user_id", "12 days")


@query(f"WITH {EVENTS_SQL}, f AS (SELECT event_type, user_id, min((ts, event_id)) AS o, count(*) AS n FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY o) AS p FROM f) SELECT event_type, CASE WHEN p > 300 THEN 'other' ELSE CAST(user_id AS VARCHAR) END AS user_id, sum(n) AS n FROM r GROUP BY 1, 2")
def bounded_counters(spark, sf):
    return bh.bounded_counters(events(spark, sf), ["event_type", "user_id"], ["user_id"], 300).withColumn("n", F.col("n").cast("decimal(38,0)"))


@query(ALERTS_SQL + " SELECT rule_id, CASE rule_id WHEN 'odd_click' THEN 'Odd click' ELSE rule_id END AS name, count(*) AS n, (SELECT count(*) FROM e) AS events, (SELECT count(*) FROM alerts) AS matches FROM alerts GROUP BY 1")
def replay_summary(spark, sf):
    return al.replay_summary(events(spark, sf), alerts(spark, sf), {"odd_click": "Odd click"}).withColumn("matches", F.col("matches").cast("long"))


@query(ALERTS_SQL + " SELECT event_id, rule_id FROM alerts ORDER BY ts, event_id, rule_id LIMIT 20")
def replay_samples(spark, sf):
    return al.first_samples(alerts(spark, sf)).select("event_id", "rule_id")


@query(ALERTS_SQL + ", p AS (SELECT 'pid' AS dimension, CAST(pid AS VARCHAR) AS key, count(*) AS n FROM alerts GROUP BY 2 UNION ALL SELECT 'action', 'alert', count(*) FROM alerts) SELECT dimension, key, n FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS r FROM p) WHERE r <= 10")
def simulation_top(spark, sf):
    return al.top_report(alerts(spark, sf).withColumn("action", F.lit("")), ["pid", "action"]).select("dimension", "key", "n")


# generated rules, as a rule file and as SQL
def generated(n: int = 500) -> tuple[str, str]:
    """(rule file, SQL condition of each rule by union) of n rules of all shapes."""
    kinds, rules, sql = ["click", "view", "purchase", "signup", "error"], [], []
    for i in range(n):
        kind, k, low = kinds[i % 5], (i * 37) % 100, 20 + (i * 13) % 200
        rule = {"id": f"g{i:03d}", "name": f"generated {i}", "event_type": kind, "severity": "critical" if i % 7 == 0 else "warning", "tags": [f"mitre:T1{i % 9}00"]}
        if i % 3 == 0:
            rule["condition"], test = {"field": "k", "op": "in", "values": [k, (k + 1) % 100]}, f"k IN ({k}, {(k + 1) % 100})"
        elif i % 3 == 1:
            rule["condition_group"], test = {"operator": "and", "conditions": [{"field": "value", "op": "gt", "values": [low]}, {"field": "k", "op": "regex", "values": [f"^{k % 10}[0-4]?$"]}]}, f"value > {low} AND regexp_matches(CAST(k AS VARCHAR), '^{k % 10}[0-4]?$')"
        else:
            rule["condition_group"] = {"operator": "and", "conditions": [{"field": "value", "op": "lte", "values": [low]}], "subgroups": [{"operator": "or", "conditions": [{"field": "user", "op": "suffix", "values": [f"{k:02d}"]}, {"field": "k", "op": "equals", "values": [k]}]}]}
            rule["exceptions"], test = [{"name": "quiet", "condition": {"field": "user", "op": "prefix", "values": ["1"]}}], f"value <= {low} AND (u LIKE '%{k:02d}' OR k = {k}) AND NOT starts_with(u, '1')"
        rules.append(rule)
        sql.append(f"SELECT '{rule['id']}' AS rule_id, event_id, user_id FROM e WHERE event_type = '{kind}' AND {test}")
    return json.dumps({"rules": rules}), " UNION ALL ".join(sql)


@query(f"WITH {EVENTS_SQL}, a AS ({generated()[1]}) SELECT rule_id, count(*) AS n, count(DISTINCT user_id) AS n_pids FROM a GROUP BY 1")
def rule_file_replay(spark, sf):
    rules = rule_files.load_text(generated()[0], check=False)  # test tables have fields of their own
    found = ru.evaluate(events(spark, sf), rules, fields())
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_pids"))


@query(f"SELECT 'T1' || (i % 9) || '00' AS technique, count(*) AS n, string_agg(printf('g%03d', i), ',' ORDER BY i) AS rules FROM range(500) t(i) GROUP BY 1")
def technique_coverage(spark, sf):
    rules = rule_files.load_text(generated()[0], check=False)
    frame = spark.createDataFrame([(r.id, list(r.tags)) for r in rules], "rule_id string, tags array<string>")
    return al.technique_coverage(frame).withColumn("rules", F.array_join("rules", ","))


def fnv_sql() -> str:
    out = "2166136261::BIGINT"
    for x, n in (("user_id", 4), ("((epoch_us(ts) * 1000) >> 30)", 8)):
        for i in range(n):
            out = f"xor((({out}) * 16777619) & 4294967295, ({x} >> {8 * i}) & 255)"
    return out


@query(f"WITH {EVENTS_SQL} SELECT event_id FROM e WHERE event_type = 'view' AND value > 10 AND ({fnv_sql()}) % 1000 < 250")
def sampled_rule(spark, sf):
    rule = ru.Rule("some", "view", ru.Condition("value", "gt", (10,)), rate=0.25)
    return ru.evaluate(events(spark, sf), [rule], fields(), pid="user_id").select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r % 10 = 1")
def one_in_ten(spark, sf):
    return ru.one_in(events(spark, sf), 10, ["event_type"]).select("event_id")


PARENTS, CHILDREN = ["nginx", "bash", "sshd", "node-worker", "node_exporter"], ["sh", "curl", "nmap", "ls", "python3"]
COMMS_SQL = f"c AS (SELECT *, list_extract({PARENTS}, k % 5 + 1) AS parent_comm, list_extract({CHILDREN}, user_id % 5 + 1) AS comm FROM e)"


def processes(spark, sf):
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i % 5 + 1).cast("int"))
    return events(spark, sf).withColumns({"parent_comm": pick(PARENTS, F.col("k")), "comm": pick(CHILDREN, F.col("user_id")), "uid": F.col("k"), "pid": F.col("user_id")})


@query(f"WITH {EVENTS_SQL}, {COMMS_SQL} SELECT event_id, CASE WHEN parent_comm IN ('nginx', 'node-worker') AND comm = 'sh' THEN 'web_shell_spawn' WHEN parent_comm = 'bash' AND comm IN ('curl', 'python3') THEN 'shell_network_tool' ELSE 'shell_recon_tool' END AS pattern FROM c WHERE (parent_comm IN ('nginx', 'node-worker') AND comm = 'sh') OR (parent_comm = 'bash' AND comm IN ('curl', 'python3', 'nmap'))")
def lineage_patterns(spark, sf):
    return ln.match(processes(spark, sf)).select("event_id", "pattern")


@query(f"WITH {EVENTS_SQL}, {COMMS_SQL} SELECT event_id FROM c WHERE comm = 'ls' AND k NOT IN (3, 13)")
def lineage_condition(spark, sf):
    return ln.match(processes(spark, sf), [ln.Pattern("listing", tuple(PARENTS), ("ls",), "info", ("uid", "not_in", (3, 13)))]).select("event_id")


@query(f"WITH {EVENTS_SQL}, p AS (SELECT event_id, user_id, user_id // 2 AS ppid, ts, 'c' || k AS comm, CASE WHEN k % 3 > 0 THEN 'p' || k END AS parent FROM e), u AS (SELECT event_id, user_id AS of, ts, 0 AS asks, comm, NULL AS parent FROM p UNION ALL SELECT event_id, ppid, ts, 1, comm, parent FROM p WHERE parent IS NULL), w AS (SELECT *, last_value(CASE WHEN asks = 0 THEN comm END IGNORE NULLS) OVER (PARTITION BY of ORDER BY ts, asks, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM u) SELECT p.event_id, coalesce(p.parent, w.l) AS parent_comm FROM p LEFT JOIN w ON w.event_id = p.event_id AND w.asks = 1")
def parent_names(spark, sf):
    k = F.col("k").cast("string")
    rows = events(spark, sf).withColumns({"pid": F.col("user_id"), "ppid": F.floor(F.col("user_id") / 2), "comm": F.concat(F.lit("c"), k), "parent_comm": F.when(F.col("k") % 3 > 0, F.concat(F.lit("p"), k))})
    return ln.with_parent(rows).select("event_id", "parent_comm")


PORTS, ADDRESSES = [3333, 9001, 22, 443], ["10.0.0.5", "93.184.1.1", "192.168.3.4"]
NET_SQL = COMMS_SQL + f", n AS (SELECT *, list_extract({PORTS}, k % 4 + 1) AS dport, list_extract({ADDRESSES}, event_id % 3 + 1) AS daddr FROM c), v AS (SELECT *, event_id % 3 <> 1 AS private FROM n)"


@query(f"""WITH {EVENTS_SQL}, {NET_SQL}, d AS (SELECT event_id, CASE WHEN dport = 3333 AND NOT private THEN 'mining_connection' WHEN dport = 9001 THEN 'tor_port' WHEN dport < 1024 AND k <> 0 AND NOT private THEN 'privileged_port_nonroot' WHEN comm = 'sh' AND NOT private THEN 'shell_goes_out' END AS rule_id FROM v) SELECT event_id, rule_id, CASE WHEN rule_id IN ('mining_connection', 'tor_port') THEN 'critical' ELSE 'warning' END AS severity FROM d WHERE rule_id IS NOT NULL""")
def policy_decisions(spark, sf):
    pick = lambda values, i: F.element_at(F.array(*[F.lit(x) for x in values]), i.cast("int"))
    net = F.struct(pick(PORTS, F.col("k") % 4 + 1).alias("dport"), pick(ADDRESSES, F.col("event_id") % 3 + 1).alias("daddr"), F.lit(6).alias("proto"))
    found = po.overridden(po.decide(processes(spark, sf).withColumn("network", net), po.NETWORK))
    return found.where("rule_id is not null").select("event_id", "rule_id", "severity")


ENTRIES_SQL = f"WITH {EVENTS_SQL}, a AS (SELECT event_id, ts, event_type AS action, user_id AS pid, 'r' || (k % 7) AS rule_id, value > 50 AS success FROM e)"


def entries(spark, sf):
    return events(spark, sf).select("event_id", "ts", F.col("event_type").alias("action"), F.col("user_id").alias("pid"), F.concat(F.lit("r"), (F.col("k") % 7).cast("string")).alias("rule_id"), (F.col("value") > 50).alias("success"))


@query(ENTRIES_SQL + " SELECT event_id FROM a WHERE ts >= '2024-01-12' AND action = 'click' AND pid = 7")
def audit_query(spark, sf):
    return po.audit_query(entries(spark, sf), "2024-01-12", "click", 7).select("event_id")


@query(ENTRIES_SQL + ", p AS (SELECT 'all' AS dimension, '' AS key, ts, success FROM a UNION ALL SELECT 'action', action, ts, success FROM a UNION ALL SELECT 'rule_id', rule_id, ts, success FROM a) SELECT dimension, key, count(*) AS n, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY 1, 2")
def audit_stats(spark, sf):
    return po.audit_stats(entries(spark, sf))


@query(ALERTS_SQL + ", d AS (SELECT *, (starts_with(rule_id, 'big') OR starts_with(rule_id, 'odd')) AND comm <> 'view' AND ts >= '2024-01-04' AS want FROM alerts) SELECT event_id, rule_id, want AND row_number() OVER (PARTITION BY date_trunc('minute', ts), want ORDER BY ts, event_id) <= 1 AS would_enforce FROM d")
def escalation_decisions(spark, sf):
    return po.escalations(alerts(spark, sf), ["big", "odd"], ["view"], 1, dry_until="2024-01-04").select("event_id", "rule_id", "would_enforce")


@query(ALERTS_SQL + ", f AS (SELECT rule_id, comm FROM alerts WHERE k = 7), g AS (SELECT comm FROM f WHERE rule_id = 'quiet_view') SELECT event_id, rule_id FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.rule_id = a.rule_id AND f.comm = a.comm) AND NOT (rule_id = 'quiet_view' AND comm IN (SELECT comm FROM g))")
def feedback_by_comm(spark, sf):
    found = alerts(spark, sf)
    return lk.suppress_feedback(found, found.where("k = 7").withColumn("verdict", F.lit("false_positive")), "quiet_view").select("event_id", "rule_id")


@query(ALERTS_SQL + ", f AS (SELECT *, 'f' || k AS fp, 'n' || (event_id % 2) AS node FROM alerts) SELECT event_id FROM f a WHERE NOT EXISTS (SELECT 1 FROM f s WHERE s.k % 3 = 0 AND s.fp = a.fp AND s.node <> a.node AND a.ts >= s.ts AND a.ts <= s.ts + INTERVAL 86400 SECOND)")
def cluster_dedup(spark, sf):
    rows = alerts(spark, sf).withColumns({"fingerprint": F.concat(F.lit("f"), F.col("k").cast("string")), "node": F.concat(F.lit("n"), (F.col("event_id") % 2).cast("string"))})
    return lk.unseen_elsewhere(rows, rows.where("k % 3 = 0").select("fingerprint", "node", F.col("ts").alias("at")), 86400).select("event_id")


@query(ALERTS_SQL + f", x AS (SELECT *, list_extract({ADDRESSES}, event_id % 3 + 1) AS daddr FROM alerts) SELECT 'ip' AS type, daddr AS value, rule_id, ts + INTERVAL 24 HOUR AS expires_at FROM x WHERE k % 2 = 0 AND event_id % 3 = 1 UNION ALL SELECT 'dns', 'q' || k, rule_id, ts + INTERVAL 24 HOUR FROM x WHERE k % 2 = 1 UNION ALL SELECT 'fingerprint', 'f' || k, rule_id, ts + INTERVAL 24 HOUR FROM x WHERE k > 50")
def indicator_extract(spark, sf):
    k = F.col("k").cast("string")
    address = F.element_at(F.array(*[F.lit(x) for x in ADDRESSES]), (F.col("event_id") % 3 + 1).cast("int"))
    rows = alerts(spark, sf).withColumns({"event_type": F.when(F.col("k") % 2 == 0, "network").otherwise("dns"), "daddr": address, "qname": F.concat(F.lit("q"), k), "fingerprint": F.when(F.col("k") > 50, F.concat(F.lit("f"), k)).otherwise("")})
    return lk.extract_indicators(rows).select("type", "value", "rule_id", "expires_at")


@query(ALERTS_SQL + " SELECT event_id, rule_id, CASE rule_id WHEN 'odd_click' THEN 'odd_click' WHEN 'big_purchase' THEN 'big_a' WHEN 'quiet_view' THEN 'quiet' END AS template_id FROM alerts")
def explanations(spark, sf):
    return lk.explain(alerts(spark, sf), spark.createDataFrame([("odd_click",), ("odd_a",), ("big_b",), ("big_a",), ("quiet",)], "template_id string")).select("event_id", "rule_id", "template_id")


@query(f"WITH {EVENTS_SQL} SELECT event_id FROM e WHERE k % 12 IN (2, 3, 9) AND user_id NOT IN (SELECT user_id FROM e WHERE value > 300)")
def tampering(spark, sf):
    rows = events(spark, sf).withColumns({"cmd": F.col("k") % 12, "pid": F.col("user_id")})
    return lk.tampering(rows, rows.where("value > 300").select("pid")).select("event_id")


@query(f"WITH {EVENTS_SQL}, {NET_SQL} SELECT event_id, dport IN (3333, 9001) AS on_mining_port, contains(comm, 'url') AS has_mining_name FROM v")
def mining_signs(spark, sf):
    port = F.element_at(F.array(*[F.lit(x) for x in PORTS]), (F.col("k") % 4 + 1).cast("int"))
    return lk.mining_signs(processes(spark, sf).withColumn("dport", port), [3333, 9001], ["url"]).select("event_id", "on_mining_port", "has_mining_name")
