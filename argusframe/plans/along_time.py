"""Streams with state, the event log source, joins along time, the store and stored baselines bound to the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import baselines as bl
from ..operators import lookups as lk
from ..operators import rules as ru
from ..operators import scoring as sc
from ..operators import timejoin as tj
from ..sinks import store
from ..sinks.folders import scratch
from ..sources import log_source, rule_files
from ..streaming import state as st
from .detection import generated
from .queries import ALERTS_SQL, EVENTS_SQL, alerts, events, fields, query, table

EVENT_COLUMNS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, k bigint"
#: The batches that a stream gets: rows come up to LATE_S later than their time says, and the watermark waits for longer.
BATCHES, LATE_S, WATERMARK = 3, 40_000, "1 day"


def replayed(spark, sf, columns: list[str], operator):
    """What a stream operator tells of the events, which come in BATCHES, out of order, and one last row far behind that moves the watermark past all. A batch is
    judged whole, in however many files it is written: its rows lie further apart than the watermark waits."""
    rows = events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    come = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(LATE_S))
    ends = rows.agg(F.min(F.unix_seconds("ts")).alias("a"), (F.max(F.unix_seconds("ts")) + LATE_S + 1).alias("z"), F.max("ts").alias("last")).first()
    batch = F.least(F.floor((come - F.lit(ends["a"])) * BATCHES / (ends["z"] - ends["a"])), F.lit(BATCHES - 1)) if ends["a"] is not None else F.lit(0)
    kinds, path = dict(rows.dtypes), scratch(spark, "stream")
    end = spark.range(1).select(*[(F.lit(ends["last"]).cast("timestamp") + F.expr("interval 400 days") if c == "ts" else F.lit(-1 if kinds[c] != "string" else "end").cast(kinds[c])).alias(c) for c in columns])
    for i in range(BATCHES + 1):
        (rows.where(batch == i).select(*columns) if i < BATCHES else end).write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(", ".join(f"{c} {kinds[c]}" for c in columns)).parquet(f"{path}/in").withWatermark("ts", WATERMARK)
        found = st.replay(source, operator, path, idle=i == BATCHES)
    return found


@query(f"WITH {EVENTS_SQL}, l AS (SELECT event_id, event_type, user_id, ts, lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS p FROM e) SELECT event_id, p IS NULL OR ts - p > INTERVAL 48 HOUR AS is_new FROM l")
def stream_first_seen(spark, sf):
    found = replayed(spark, sf, ["event_id", "ts", "event_type", "user_id"], lambda x: st.stream_first_seen(x, ["event_type"], "user_id", 48 * 3600))
    return found.where("event_type <> 'end'").select("event_id", "is_new")


@query(f"WITH {EVENTS_SQL}, s AS (SELECT user_id, min(ts) AS t0 FROM e GROUP BY 1), v AS (SELECT user_id, k, min(ts) AS first_seen FROM e GROUP BY 1, 2) SELECT user_id, k, first_seen FROM v JOIN s USING (user_id) WHERE first_seen >= t0 + INTERVAL 7 DAY")
def stream_drift(spark, sf):
    found = replayed(spark, sf, ["event_id", "ts", "user_id", "k"], lambda x: st.stream_drift(x, "user_id", "k", 7 * 86_400)).where("user_id >= 0")
    return found.withColumn("first_seen", F.col("first_seen").cast("timestamp_ntz"))


@query(f"""WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM e), j AS (SELECT o.user_id, o.event_type, o.i, o.ts, count(*) AS n, max(x.ts) AS last_seen FROM o JOIN o x ON x.user_id = o.user_id AND x.event_type = o.event_type AND x.i >= o.i AND x.ts <= o.ts + INTERVAL 30 HOUR GROUP BY ALL),
 r AS (SELECT * FROM j WHERE i = 1 UNION ALL SELECT j.* FROM r JOIN j ON j.user_id = r.user_id AND j.event_type = r.event_type AND j.i = r.i + r.n) SELECT user_id, event_type, ts AS first_seen, last_seen, n FROM r""")
def stream_aggregation(spark, sf):
    found = replayed(spark, sf, ["event_id", "ts", "user_id", "event_type"], lambda x: st.stream_aggregated(x, ["user_id", "event_type"], 30 * 3600)).where("user_id >= 0")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


@query(f"WITH {EVENTS_SQL} SELECT event_id, ts, event_type, 'k' || k AS comm FROM e WHERE ts > '2024-01-10'")
def event_log_source(spark, sf):
    """Events written as a log in two generations, the names as fixed-width byte arrays in one, and read through the data source."""
    path = scratch(spark, "log")
    name = F.concat(F.lit("k"), F.col("k").cast("string"))
    codes = F.concat(F.transform(F.split(name, ""), lambda c: F.ascii(c)), F.array_repeat(F.lit(0), 4))
    rows = events(spark, sf)
    for i, comm in enumerate((name, codes)):
        own = rows.where(F.col("event_id") % 2 == i).select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), "event_type", comm.alias("comm"))
        own.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)
    found = log_source.read_log(spark, path, "2024-01-10", "event_id bigint, ts timestamp, event_type string, comm string", part_bytes=str(1 << 18))
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(ALERTS_SQL + ", c AS (SELECT user_id AS pid, ts AS seen_at, 't' || event_id AS trace_id FROM e WHERE k % 3 = 0), j AS (SELECT a.event_id, a.rule_id, a.ts, c.seen_at, c.trace_id FROM alerts a ASOF LEFT JOIN c ON c.pid = a.pid AND c.seen_at <= a.ts) SELECT event_id, rule_id, CASE WHEN seen_at >= ts - INTERVAL 24 HOUR THEN trace_id END AS trace_id FROM j")
def trace_attachment(spark, sf):
    rows = events(spark, sf).where("k % 3 = 0")
    ids = F.concat(F.lit("t"), F.col("event_id").cast("string"))
    contexts = rows.select(F.col("user_id").alias("pid"), "ts", ids.alias("trace_id"), ids.alias("span_id"))
    return tj.with_trace(alerts(spark, sf), contexts, 24 * 3600).select("event_id", "rule_id", "trace_id")


@query(f"WITH RECURSIVE {EVENTS_SQL}, p AS (SELECT DISTINCT user_id AS pid, ts AS start, user_id // 2 AS ppid FROM e), q AS (SELECT c.pid, c.start, u.pid AS up, u.start AS up_start FROM p c ASOF JOIN p u ON u.pid = c.ppid AND u.start <= c.start WHERE c.ppid <> c.pid), t AS (SELECT pid, start, up AS ancestor, up_start AS ancestor_start, 1 AS level FROM q UNION ALL SELECT t.pid, t.start, q.up, q.up_start, level + 1 FROM t JOIN q ON q.pid = t.ancestor AND q.start = t.ancestor_start WHERE level < 8) SELECT * FROM t")
def ancestry_in_time(spark, sf):
    """Every event is the start of a process whose number is used again and again; parents and theirs are those of the moment."""
    rows = events(spark, sf).select(F.col("user_id").alias("pid"), F.col("ts").alias("start"), F.floor(F.col("user_id") / 2).alias("ppid"))
    return tj.ancestry_in_time(rows, 8)


@query(f"""WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT event_id, event_type, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM e),
 r AS (SELECT event_type, n, event_id, s, TRUE AS ok, 4.0::DOUBLE AS tokens FROM o WHERE n = 1
 UNION ALL SELECT event_type, n, event_id, s, t >= 1, t - (t >= 1)::INT FROM (SELECT o.*, least(5.0, r.tokens + (o.s - r.s) / 1800) AS t FROM r JOIN o ON o.event_type = r.event_type AND o.n = r.n + 1))
 SELECT event_id FROM r WHERE ok""")
def token_bucket(spark, sf):
    return tj.token_bucket(events(spark, sf), 1 / 1800, 5.0, ["event_type"], piece_s=86_400).select("event_id")


@query(ALERTS_SQL + ", v AS (SELECT rule_id || '-' || pid AS id, event_id, ts, severity, event_id % 3 AS batch FROM alerts), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id DESC) AS r FROM v) SELECT id, event_id, ts, severity FROM n WHERE r = 1 AND NOT ends_with(id, '7') AND ts >= '2024-01-05'")
def alert_store(spark, sf):
    """Alerts upserted in three batches, of which one comes twice, then a deletion by key and retention; what the store holds then."""
    path, rows = scratch(spark, "store"), alerts(spark, sf).withColumns({"id": F.concat_ws("-", "rule_id", "pid"), "ts": F.col("ts").cast("timestamp")})
    rows = rows.select("id", "event_id", "ts", "severity")
    for batch in (0, 1, 1, 2):
        store.merge(rows.where(F.col("event_id") % 3 == batch), path, "id", "event_id", "ts", "alerts", batch, cells_a_day=2)
    store.delete(rows.where(F.endswith("id", F.lit("7"))).select("id"), path, "id", "ts")
    store.expire(spark, path, "2024-01-05 00:00:00")
    found = store.read(spark, path)
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"WITH {EVENTS_SQL} SELECT event_type, k, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM e GROUP BY 1, 2")
def stored_baseline(spark, sf):
    """The sights of each half of the events, the later half first, folded into a stored baseline without reading earlier events again."""
    path, rows = scratch(spark, "baseline"), events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    for late in (True, False):
        half = rows.where((F.col("ts") >= F.lit("2024-01-15").cast("timestamp")) == late)
        bl.fold_into(bl.sights(half, ["event_type"], "k"), path, ["event_type"], "k", "halves", 0 if late else 1)
    found = store.read(spark, path).select("event_type", "k", "first_seen", "last_seen", "n")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


# rules and exports, by their content
@query(f"WITH {EVENTS_SQL}, a AS ({generated()[1]}), t AS (SELECT printf('g%03d', i) AS rule_id, 'T1' || (i % 9) || '00' AS technique FROM range(500) t(i)) SELECT technique, count(DISTINCT rule_id) AS n_rules, count(*) AS n_alerts FROM a JOIN t USING (rule_id) GROUP BY 1")
def technique_alerts(spark, sf):
    """What the alerts of a rule file say of each technique."""
    rules = rule_files.load_text(generated()[0], check=False)
    tagged = spark.createDataFrame([(r.id, list(r.tags)) for r in rules], "rule_id string, tags array<string>")
    return al.technique_alerts(ru.evaluate(events(spark, sf), rules, fields()), tagged)


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT event_type, list_sort(list(DISTINCT CAST(k AS VARCHAR))) AS ks FROM e WHERE value > 150 GROUP BY 1) SELECT event_type, '{{"id":"learned_' || event_type || '_ports","name":"Unlearned ports","event_type":"network","severity":"warning","action":"alert","class":"drift","condition":{{"field":"dport","op":"not_in","values":["' || array_to_string(ks, '","') || '"]}}}}' AS rule FROM p""")
def exported_rule_rows(spark, sf):
    profile = events(spark, sf).where("value > 150").groupBy("event_type").agg(F.collect_set("k").alias("ports"))
    return store.rule_rows(profile, ["event_type"], {"ports": ("network", "dport")})


@query("WITH v AS (SELECT DISTINCT user_id AS v FROM events), n AS (SELECT v, (row_number() OVER (ORDER BY v) - 1) // 50 AS chunk FROM v) SELECT chunk, string_agg(v, ',' ORDER BY v) AS items FROM n GROUP BY 1")
def chunk_contents(spark, sf):
    return lk.in_chunks(events(spark, sf), "user_id", 50).select("chunk", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("WITH f AS (SELECT 'f' || doc_id || '.yaml' AS name, coalesce(text, '') AS content FROM documents), l AS (SELECT name, CASE WHEN length(content) % 5 = 0 THEN sha256('other') ELSE sha256(content) END AS digest FROM f WHERE length(content) % 7 <> 0) SELECT f.name, CASE WHEN l.name IS NULL THEN 'unlisted' WHEN l.digest = sha256(content) THEN 'ok' ELSE 'changed' END AS verdict FROM f LEFT JOIN l USING (name)")
def checksum_gate(spark, sf):
    """Texts as files, held against a list of digests of which some are others' and some are missing."""
    files = table(spark, sf, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".yaml")).alias("name"), F.coalesce("text", F.lit("")).alias("content"))
    n = F.char_length("content")
    listed = files.where(n % 7 != 0).select("name", F.sha2(F.when(n % 5 == 0, "other").otherwise(F.col("content")), 256).alias("digest"))
    return rule_files.verified(files, listed)


NETS = ["10.0.0.0/8", "192.168.0.0/16", "172.16.0.0/12", "93.184.216.0/24"]
IP_SQL = "n AS (SELECT event_id, event_type, (event_id * 2654435761) % 4294967296 AS ip FROM events)"


@query(f"WITH {IP_SQL}, m AS (SELECT *, ip BETWEEN 167772160 AND 184549375 OR ip BETWEEN 3232235520 AND 3232301055 OR ip BETWEEN 2886729728 AND 2887778303 OR ip BETWEEN 1572395008 AND 1572395263 AS inside FROM n) SELECT event_id, CASE WHEN inside THEN 'own' ELSE 'foreign' END AS rule_id FROM m WHERE (inside AND event_type <> 'view') OR (NOT inside AND event_type = 'click')")
def network_rules(spark, sf):
    from ..functions.fields import ipv4_text

    rows = events(spark, sf).withColumn("daddr", ipv4_text((F.col("event_id") * 2654435761) % 4294967296))
    own = [ru.Rule("own", kind, ru.Condition("daddr", "in_cidr", tuple(NETS))) for kind in ("click", "purchase", "signup", "error")]
    return ru.evaluate(rows, [*own, ru.Rule("foreign", "click", ru.Condition("daddr", "not_in_cidr", tuple(NETS)))], {"daddr": F.col("daddr")}).select("event_id", "rule_id")


@query(f"WITH {EVENTS_SQL} SELECT event_id, CASE event_type WHEN 'click' THEN 'gained' ELSE 'dropped' END AS rule_id FROM e WHERE (event_type = 'click' AND (user_id & ~k & 34) <> 0) OR (event_type = 'error' AND (k & ~user_id & 5) <> 0)")
def capability_rules(spark, sf):
    rules = [ru.Rule("gained", "click", ru.Condition("caps", "caps_gained", ("CAP_DAC_OVERRIDE", "kill"))), ru.Rule("dropped", "error", ru.Condition("caps", "caps_dropped", ("chown", "dac_read_search", "unknown")))]
    return ru.evaluate(events(spark, sf), rules, {"old_caps": F.col("k"), "new_caps": F.col("user_id")}).select("event_id", "rule_id")


@query(ALERTS_SQL + " SELECT event_id, rule_id FROM alerts WHERE k % 4 IN (1, 2) AND severity = 'warning' UNION ALL SELECT event_id, 'by id' FROM alerts WHERE rule_id || '-' || pid = 'odd_click-7'")
def scoped_alerts(spark, sf):
    rows = alerts(spark, sf).withColumns({"namespace": (F.col("k") % 4).cast("string"), "id": F.concat_ws("-", "rule_id", "pid")})
    seen = al.where(rows, al.scoped(al.Filters(severities=["warning"]), ["1", "2"])).select("event_id", "rule_id")
    return seen.union(al.by_id(rows, "odd_click-7").select("event_id", F.lit("by id").alias("rule_id")))


PARENT_NAMES, CHILD_NAMES = ["nginx", "postgres", "cron", "npm", "init", "systemd"], ["bash", "curl", "xmrig", "python3", "dig"]
PATHS = ["/etc/shadow", "/proc/self/cwd/../x", "/dev/shm/a.so", "/home/u/.ssh/id_rsa.pub", "/var/run/docker.sock"]
NAMES = ["a1b2c3d4e5f6g7.evil", "www1234567890abc.com", "x.duckdns.org", "pool.mine.io", "tor.exit.link"]
FRAME_SQL = f"""f AS (SELECT event_id, user_id AS pid, k, list_extract({PARENT_NAMES}, user_id % 6 + 1) AS parent, list_extract({CHILD_NAMES}, k % 5 + 1) AS comm, CASE event_type WHEN 'click' THEN 'network' WHEN 'view' THEN 'file' WHEN 'error' THEN 'dns' ELSE 'syscall' END AS kind,
  list_extract([22, 3333, 9001, 2379, 443, 2225], k % 6 + 1) AS dport, list_extract(['10.1.2.3', '93.184.1.1', '169.254.169.254'], user_id % 3 + 1) AS daddr, k % 7 AS uid,
  list_extract({PATHS}, k % 5 + 1) AS path, CASE WHEN k % 2 = 0 THEN 'write' ELSE 'open' END AS op, list_extract({NAMES}, k % 5 + 1) AS qname, k % 2 AS direction, CASE WHEN k % 3 = 0 THEN 16 ELSE 1 END AS qtype, CASE WHEN user_id % 2 = 0 THEN 3 ELSE 0 END AS rcode, list_extract([101, 319, 322, 5], user_id % 4 + 1) AS nr FROM e)"""


def frame(spark, sf):
    """The events as an event frame: network, file, DNS and system calls by processes with parents."""
    k, u = F.col("k"), F.col("user_id")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    rows = events(spark, sf).withColumns({
        "pid": u, "uid": k % 7, "parent_comm": pick(PARENT_NAMES, u % 6), "comm": pick(CHILD_NAMES, k % 5), "kind": F.when(F.col("event_type") == "click", "network").when(F.col("event_type") == "view", "file").when(F.col("event_type") == "error", "dns").otherwise("syscall"),
    })
    rows = rows.withColumn("event_type", F.col("kind"))
    of = lambda kind, s: F.when(F.col("kind") == kind, s)
    return rows.withColumns({
        "network": of("network", F.struct(pick([22, 3333, 9001, 2379, 443, 2225], k % 6).alias("dport"), pick(["10.1.2.3", "93.184.1.1", "169.254.169.254"], u % 3).alias("daddr"), F.lit(6).alias("proto"))),
        "file": of("file", F.struct(pick(PATHS, k % 5).alias("filename"), F.when(k % 2 == 0, "write").otherwise("open").alias("op"), F.lit(0).cast("bigint").alias("mode"))),
        "dns": of("dns", F.struct(pick(NAMES, k % 5).alias("qname"), F.when(k % 3 == 0, 16).otherwise(1).alias("qtype"), F.when(u % 2 == 0, 3).otherwise(0).alias("rcode"), (k % 2).cast("int").alias("direction"))),
        "syscall": of("syscall", F.struct(pick([101, 319, 322, 5], u % 4).alias("nr"))),
    })


@query(f"""WITH {EVENTS_SQL}, {FRAME_SQL}, g AS (SELECT *, comm IN ('bash', 'python3') AS shell, NOT starts_with(daddr, '10.') AS outside FROM f),
 d AS (SELECT event_id, pid, comm, CASE
  WHEN kind IN ('network', 'dns', 'syscall') AND parent = 'nginx' AND shell THEN 'reverse_shell_webserver' WHEN parent = 'postgres' AND shell THEN 'shell_from_database'
  WHEN kind = 'file' AND path = '/proc/self/cwd/../x' THEN 'container_escape_proc'
  WHEN kind = 'network' AND dport = 3333 AND outside THEN 'cryptominer_connection' WHEN kind = 'network' AND comm = 'xmrig' THEN 'miner_process_network' WHEN kind = 'network' AND dport = 9001 THEN 'tor_connection'
  WHEN kind = 'file' AND path = '/etc/shadow' THEN 'shadow_access' WHEN kind = 'file' AND path = '/var/run/docker.sock' THEN 'docker_socket_access'
  WHEN kind = 'dns' AND direction = 0 AND qname = 'a1b2c3d4e5f6g7.evil' THEN 'dga_domain' WHEN kind = 'dns' AND direction = 0 AND qname = 'pool.mine.io' THEN 'mining_pool_dns' WHEN kind = 'dns' AND direction = 0 AND qname = 'tor.exit.link' THEN 'tor_dns_query' WHEN kind = 'dns' AND direction = 0 AND comm = 'xmrig' THEN 'miner_dns_query'
  WHEN kind = 'syscall' AND nr = 319 THEN 'memfd_fileless_staging' WHEN kind = 'syscall' AND nr = 322 THEN 'fexecve_fileless_exec' WHEN kind = 'file' AND path = '/dev/shm/a.so' THEN 'devshm_so_staging'
  WHEN kind = 'network' AND dport = 2379 THEN 'k8s_etcd_direct_access' WHEN kind = 'network' AND daddr = '169.254.169.254' THEN 'k8s_imds_access'
  WHEN kind = 'file' AND path LIKE '%.ssh/id_%' THEN 'ssh_key_access' WHEN parent = 'init' AND shell THEN 'init_spawns_shell' WHEN parent = 'cron' AND shell THEN 'cron_spawns_shell' WHEN parent = 'npm' AND shell THEN 'package_manager_shell'
  WHEN kind = 'network' AND dport < 1024 AND uid <> 0 AND outside THEN 'privileged_port_nonroot' WHEN kind = 'network' AND dport = 2225 THEN 'ssh_nonstandard_port' WHEN kind = 'network' AND shell AND outside THEN 'rapid_connections' WHEN kind = 'network' AND dport = 443 AND comm = 'dig' THEN 'dns_over_https'
  WHEN kind = 'dns' AND direction = 0 AND qname LIKE '%.link' THEN 'suspicious_tld' WHEN kind = 'dns' AND direction = 0 AND qtype = 16 AND comm <> 'dig' THEN 'dns_txt_query' WHEN kind = 'dns' AND direction = 0 AND qname = 'x.duckdns.org' THEN 'dynamic_dns_query' WHEN kind = 'dns' AND direction = 1 AND rcode = 3 AND shell THEN 'nxdomain_response'
  WHEN kind = 'syscall' AND nr = 101 THEN 'ptrace_injection' END AS rule_id FROM g)
 SELECT event_id, rule_id, replace(rule_id, '_', ' ') || ': ' || comm || ' (pid=' || pid || ')' AS message FROM d WHERE rule_id IS NOT NULL""")
def policy_pack_decisions(spark, sf):
    """All packs at once."""
    from ..operators import packs

    found = packs.decide(frame(spark, sf), [p for pack in packs.PACKS.values() for p in pack])
    return found.where("decision is not null").select("event_id", "decision.rule_id", "decision.message")


@query(ALERTS_SQL + """ SELECT event_id, rule_id, '{"text":"[' || upper(severity) || '] ' || rule_id || ': ' || comm || ' (pid ' || pid || ')' || CASE WHEN k % 2 = 0 THEN ' in ns/p' || k ELSE '' END || ' - m' || k || '"}' AS slack FROM alerts""")
def chat_payloads(spark, sf):
    from ..sinks import lines

    k = F.col("k").cast("string")
    rows = alerts(spark, sf).withColumns({"message": F.concat(F.lit("m"), k), "pod_name": F.when(F.col("k") % 2 == 0, F.concat(F.lit("p"), k)).otherwise(""), "namespace": F.lit("ns")})
    return rows.select("event_id", "rule_id", lines.chat_json(rows, "slack").alias("slack"))


@query(f"WITH {EVENTS_SQL}, v AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'kube-system' ELSE 'shop' END AS ns FROM e) SELECT event_id, array_to_string(list_filter([CASE WHEN k % 2 = 0 AND ns = 'shop' THEN 'hostPID outside the system''s namespaces' END, CASE WHEN k % 5 = 0 THEN 'container i' || k || ' may escalate' END], lambda x: x IS NOT NULL), '; ') AS deny, array_to_string(list_filter([CASE WHEN k % 7 = 0 THEN 'container c' || k || ' asks for capability NET_ADMIN' END, CASE WHEN user_id % 2 = 0 THEN 'volume v mounts host path /etc' END], lambda x: x IS NOT NULL), '; ') AS warn FROM v")
def admission_reviews(spark, sf):
    from ..operators.policy import review

    k, text = F.col("k"), F.col("k").cast("string")
    box = F.struct(F.concat(F.lit("c"), text).alias("name"), F.lit("x:1").alias("image"), F.struct(F.struct(F.when(k % 7 == 0, F.array(F.lit("NET_ADMIN"), F.lit("CHOWN"))).alias("add")).alias("capabilities")).alias("securityContext"))
    first = F.struct(F.concat(F.lit("i"), text).alias("name"), F.lit("y:1").alias("image"), F.struct((k % 5 == 0).alias("allowPrivilegeEscalation")).alias("securityContext"))
    path = F.struct(F.lit("v").alias("name"), F.struct(F.when(F.col("user_id") % 2 == 0, "/etc").otherwise("/sys/fs/bpf/x").alias("path")).alias("hostPath"))
    spec = F.struct((k % 2 == 0).alias("hostPID"), F.array(box).alias("containers"), F.array(first).alias("initContainers"), F.array(path).alias("volumes"))
    rows = events(spark, sf).select("event_id", F.to_json(F.struct(F.struct(F.when(k % 3 == 0, "kube-system").otherwise("shop").alias("namespace"), F.struct(spec.alias("spec")).alias("object")).alias("request"))).alias("value"))
    return review(rows, "value", "event_id").select("event_id", F.array_join("deny", "; ").alias("deny"), F.array_join("warn", "; ").alias("warn"))


def new_sql(value: str) -> str:
    return f"coalesce((ts, event_id) = min((ts, event_id)) OVER (PARTITION BY user_id, {value}), FALSE)::INT"


@query(f"WITH {EVENTS_SQL} SELECT event_id, round({new_sql('k % 20')} * 0.6 + {new_sql('event_type')} * 0.4, 6)::DOUBLE AS file_score, ({new_sql('k')} * 1.0)::DOUBLE AS syscall_score, round({new_sql('event_type')} * 0.6 + {new_sql('k % 7')} * 0.4, 6)::DOUBLE AS gpu_score, round({new_sql('k % 30')} * 0.5 + {new_sql('k % 11')} * 0.5, 6)::DOUBLE AS network_score FROM e")
def anomaly_forms(spark, sf):
    k = F.col("k")
    rows = events(spark, sf).withColumns({"directory": k % 20, "extension": F.col("event_type"), "nr": k, "gpu_op": F.col("event_type"), "size_bucket": k % 7, "dport": k % 30, "daddr": k % 11})
    own = lambda scored, name: scored.select("event_id", F.round("score", 6).alias(name))
    out = own(sc.file_scores(rows, ["user_id"]), "file_score")
    for scored, name in ((sc.syscall_scores(rows, ["user_id"]), "syscall_score"), (sc.gpu_scores(rows, ["user_id"]), "gpu_score"), (sc.network_scores(rows, ["user_id"]), "network_score")):
        out = out.join(own(scored, name), "event_id")
    return out


@query(f"WITH {EVENTS_SQL} SELECT event_id, 'x' || k AS comm FROM e WHERE ts > '2024-01-20'")
def log_read_since(spark, sf):
    """Events appended to a log by day, read from a moment on; names as arrays of byte numbers."""
    from ..sources import logs

    path = scratch(spark, "days")
    name = F.concat(F.lit("x"), F.col("k").cast("string"))
    rows = events(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.transform(F.split(name, ""), lambda c: F.ascii(c)), F.array(F.lit(0), F.lit(7))).alias("codes"))
    logs.append_log(rows, path)
    found = logs.read_since(spark, path, "2024-01-20", "event_id bigint, ts timestamp, codes array<int>")
    return found.select("event_id", logs.char_array(F.col("codes")).alias("comm"))


def dns_message(name: Column, kind: Column):
    label = lambda x: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(x)), 2, "0")), F.encode(x, "UTF-8"))
    return F.concat(F.unhex(F.lit("000180000001000000000000")), label(name), label(F.lit("example")), F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(kind), 4, "0")), F.unhex(F.lit("0001")))


@query(f"WITH {EVENTS_SQL} SELECT event_id, 'h' || k || '.example' AS qname, (k % 30)::INT AS qtype FROM e")
def dns_packets(spark, sf):
    from ..sources import wire

    rows = events(spark, sf).withColumn("m", wire.parse_dns(dns_message(F.concat(F.lit("h"), F.col("k").cast("string")), F.col("k") % 30)))
    return rows.select("event_id", F.col("m.qname").alias("qname"), F.col("m.qtype").cast("int").alias("qtype"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, 'burst' AS rule_id, 'critical' AS severity FROM e WHERE value > 120 AND k % 2 = 0 UNION ALL SELECT event_id, 'rows', 'info' FROM e WHERE k = 42")
def plugin_alerts(spark, sf):
    import pandas as pd

    from ..operators.policy import Plugins

    plugins = Plugins()
    plugins.register("burst", lambda pdf: pd.DataFrame({"matched": (pdf["value"] > 120) & (pdf["k"] % 2 == 0), "severity": "critical", "message": ""}))
    plugins.handler("rows")(lambda e: ("info", "") if e["k"] == 42 else None)
    return plugins.evaluate(events(spark, sf).select("event_id", "value", "k")).select("event_id", "rule_id", "severity")


@query(f"WITH {EVENTS_SQL} SELECT event_id, CASE WHEN k % 3 = 0 THEN 'container is privileged: c' || k END AS deny, CASE WHEN k % 2 = 0 THEN 'container has no fixed image: c' || k END AS warn FROM e")
def admission_verdicts(spark, sf):
    from ..operators.policy import admission

    k, name = F.col("k"), F.concat(F.lit("c"), F.col("k").cast("string"))
    box = F.struct(name.alias("name"), F.when(k % 2 == 0, "x:latest").otherwise("x:1").alias("image"), F.struct((k % 3 == 0).alias("privileged"), F.lit(True).alias("runAsNonRoot"), F.lit(False).alias("allowPrivilegeEscalation")).alias("securityContext"))
    rows = events(spark, sf).select("event_id", F.to_json(F.struct(F.struct(F.array(box).alias("containers")).alias("spec"))).alias("value"))
    return admission(rows, "value", "event_id").select("event_id", F.get("deny", F.lit(0)).alias("deny"), F.get("warn", F.lit(0)).alias("warn"))
