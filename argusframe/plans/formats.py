"""Field functions, fingerprints, sources and sink formats bound to the test tables, each with its SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import dns, fields as fn, names, tls, trace
from ..sinks import lines, store
from ..sources import cloud, logs
from .queries import ALERTS_SQL, DOMAINS_SQL, EVENTS_SQL, alerts, domains, events, query, table


def case_sql(value: str, known: dict, prefix: str = "") -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in known.items()) + f" ELSE '{prefix}' || {value} END"


CODES = {"file_op": (names.file_op, names.FILE_OPS, ""), "gpu_op": (names.gpu_op, names.GPU_OPS, ""), "bpf_command": (names.bpf_command, names.BPF_COMMANDS, "BPF_CMD_"), "bpf_type": (names.bpf_type, names.BPF_TYPES, "UNKNOWN_"), "dns_type": (names.dns_type, names.DNS_TYPES, "TYPE"), "dns_code": (names.dns_code, names.DNS_CODES, "RCODE")}


@query(f"WITH {EVENTS_SQL} SELECT event_id, {', '.join(f'{case_sql("k", known, prefix)} AS {n}' for n, (_, known, prefix) in CODES.items())}, CASE k WHEN 0 THEN 'setup' ELSE 'enter' END AS io_uring_op, CASE k WHEN 10 THEN 'ipv6' ELSE 'ipv4' END AS family FROM e")
def code_names(spark, sf):
    k = F.col("k")
    return events(spark, sf).select("event_id", *[f(k).alias(n) for n, (f, _, _) in CODES.items()], names.io_uring_op(k).alias("io_uring_op"), names.family(k).alias("family"))


PATHS_SQL = "CASE k % 5 WHEN 0 THEN '/usr/bin/x' WHEN 1 THEN '/lib/y' WHEN 2 THEN '/opt/z.so' WHEN 3 THEN '/opt/z.so.1' ELSE '/usr/libx/' || k END"


@query(f"WITH {EVENTS_SQL}, p AS (SELECT event_id, k, user_id, {PATHS_SQL} AS p FROM e) SELECT event_id, starts_with(p, '/bin/') OR starts_with(p, '/sbin/') OR starts_with(p, '/usr/bin/') OR starts_with(p, '/usr/sbin/') OR starts_with(p, '/usr/local/bin/') AS program, ends_with(p, '.so') OR contains(p, '.so.') OR starts_with(p, '/lib/') OR starts_with(p, '/usr/lib/') AS library, 'a|b' || k AS parts, (event_id * 2654435761 % 4294967296 >> 24) || '.' || ((event_id * 2654435761 % 4294967296 >> 16) & 255) || '.' || ((event_id * 2654435761 % 4294967296 >> 8) & 255) || '.' || (event_id * 2654435761 % 256) AS address, CASE WHEN k > 50 THEN repeat('*', len('s' || k)) ELSE 's' || k END AS masked, k || chr(0) || 'x' <> CAST(k AS VARCHAR) AS cut, CASE WHEN len('name' || k) > 5 THEN left('name' || k, 4) || '…' ELSE 'name' || k END AS short FROM p")
def path_and_text_functions(spark, sf):
    k = F.col("k").cast("string")
    path = F.when(F.col("k") % 5 == 0, "/usr/bin/x").when(F.col("k") % 5 == 1, "/lib/y").when(F.col("k") % 5 == 2, "/opt/z.so").when(F.col("k") % 5 == 3, "/opt/z.so.1").otherwise(F.concat(F.lit("/usr/libx/"), k))
    header = F.when(F.col("k") > 50, "Cookie").otherwise("Accept")
    return events(spark, sf).select(
        "event_id", fn.is_program(path).alias("program"), fn.is_library(path).alias("library"), F.array_join(fn.split_and_trim(F.concat(F.lit(" a, ,b"), k, F.lit(" ,"))), "|").alias("parts"), fn.ipv4_text((F.col("event_id") * 2654435761) % 4294967296).alias("address"),
        fn.masked(header, F.concat(F.lit("s"), k), ["cookie"]).alias("masked"), (fn.c_string(F.concat(k, F.lit("\0x"))) == k).alias("cut"), fn.truncated(F.concat(F.lit("name"), k), 5).alias("short"),
    )


@query(ALERTS_SQL + " SELECT event_id, rule_id, 'a-' || (epoch_us(ts) * 1000) || '-' || pid || '-' || event_id AS alert_id, left(sha256((epoch_us(ts) * 1000) || ':' || rule_id || ':' || pid), 32) AS hashed_id FROM alerts")
def alert_ids(spark, sf):
    return alerts(spark, sf).select("event_id", "rule_id", fn.alert_id(F.lit("a"), F.col("ts"), F.col("pid"), F.col("event_id")).alias("alert_id"), fn.hashed_id(F.col("ts"), F.col("rule_id"), F.col("pid")).alias("hashed_id"))


HELLO_SQL = "h AS (SELECT event_id, CASE k % 3 WHEN 0 THEN 772 WHEN 1 THEN 771 ELSE 7 END AS version, [k * 500, 49199, user_id] AS ciphers, CASE WHEN k % 4 = 0 THEN [] ELSE [13, k, 0] END AS exts, CASE WHEN k % 2 = 0 THEN 'a.example' ELSE '10.0.0.1' END AS sni FROM e)"


@query(f"""WITH {EVENTS_SQL}, {HELLO_SQL}, j AS (SELECT *, array_to_string(ciphers, '-') AS c, CASE WHEN len(exts) = 0 THEN '-' ELSE array_to_string(exts, '-') END AS x, CASE WHEN len(exts) = 0 THEN '-' ELSE array_to_string(list_sort(exts), '-') END AS xs FROM h)
 SELECT event_id, md5(version || ',' || c || ',' || x || ',29-23,-') AS ja3, md5(version || ',' || ciphers[1] || ',' || xs) AS ja3s, 't' || CASE version WHEN 772 THEN '13' WHEN 771 THEN '12' ELSE '00' END || CASE WHEN sni = 'a.example' THEN 'd' ELSE 'i' END || '03' || left(sha256(array_to_string(list_sort(list_transform(ciphers, lambda y: printf('%04x', y))), ',')), 12) || '_' || left(sha256(array_to_string(list_sort(list_transform(exts, lambda y: printf('%04x', y))), ',')), 12) AS ja4 FROM j""")
def tls_fingerprints(spark, sf):
    k = F.col("k")
    rows = events(spark, sf).select(
        "event_id", F.when(k % 3 == 0, 772).when(k % 3 == 1, 771).otherwise(7).alias("v"), F.array(k * 500, F.lit(49199).cast("long"), F.col("user_id")).alias("c"),
        F.when(k % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(13).cast("long"), k, F.lit(0).cast("long"))).alias("x"), F.when(k % 2 == 0, "a.example").otherwise("10.0.0.1").alias("sni"),
    )
    v, c, x = F.col("v"), F.col("c"), F.col("x")
    return rows.select("event_id", tls.ja3(v, c, x, F.array(F.lit(29), F.lit(23)), F.array().cast("array<int>")).alias("ja3"), tls.ja3s(v, F.get(c, F.lit(0)), x).alias("ja3s"), tls.ja4(v, c, x, F.col("sni")).alias("ja4"))


@query(f"WITH {EVENTS_SQL}, t AS (SELECT event_id, k, printf('%032x', event_id + 1) AS t, printf('%016x', user_id) AS s FROM e) SELECT event_id, CASE WHEN k % 10 <> 3 THEN t END AS w3c_trace, CASE WHEN k % 10 <> 3 THEN s END AS w3c_span, t AS jaeger_trace, t AS datadog_trace, CASE WHEN k % 2 = 0 THEN t || '/' || s || '/01/k=' || k END AS header, 'v' || k AS variable FROM t")
def trace_contexts(spark, sf):
    k, hexed = F.col("k").cast("string"), lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    t, s = hexed(F.col("event_id") + 1, 32), hexed(F.col("user_id"), 16)
    value = F.concat(F.when(F.col("k") % 10 == 3, "ff").otherwise("00"), F.lit("-"), t, F.lit("-"), s, F.lit("-01"))
    w3c, jaeger = trace.w3c_context(value), trace.jaeger_context(F.concat(F.lower(F.hex(F.col("event_id") + 1)), F.lit(":"), s, F.lit(":0:1")))
    header = trace.payload_context(F.when(F.col("k") % 2 == 0, F.concat(F.lit("GET / HTTP/1.1\r\nTraceParent : 00-"), t, F.lit("-"), s, F.lit("-01\r\ntracestate: k="), k, F.lit("\r\n\r\n"))).otherwise("GET /"))
    variable = F.try_element_at(trace.environment(F.concat(F.lit("A=1\0=x\0B=0\0B=v"), k, F.lit("\0C"))), F.lit("B"))
    return events(spark, sf).select(
        "event_id", w3c["trace_id"].alias("w3c_trace"), w3c["span_id"].alias("w3c_span"), jaeger["trace_id"].alias("jaeger_trace"), trace.decimal_to_hex((F.col("event_id") + 1).cast("string")).alias("datadog_trace"),
        F.when(header.isNotNull(), F.concat_ws("/", header["trace_id"], header["span_id"], header["flags"], header["state"])).alias("header"), variable.alias("variable"),
    )


#: Words of the bigram model in SQL, and its pairs.
MODEL_SQL = r"""w AS (SELECT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part), g AS (SELECT substr(w, i, 2) AS p FROM w, range(1, 60) r(i) WHERE i < len(w)), n AS (SELECT p, count(*) AS n FROM g WHERE regexp_full_match(p, '[a-z0-9-]{2}') GROUP BY 1),
 a AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz0123456789-', '')) AS c), m AS (SELECT x.c || y.c AS p, ln((coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY x.c)) AS l FROM a x CROSS JOIN a y LEFT JOIN n ON n.p = x.c || y.c),
 q AS (SELECT DISTINCT qname, CASE WHEN len(string_split(qname, '.')) < 2 THEN qname ELSE string_split(qname, '.')[-2] END AS s FROM d), b AS (SELECT qname, avg(l) AS l FROM (SELECT qname, substr(s, i, 2) AS p FROM q, range(1, 80) r(i) WHERE i < len(s)) JOIN m USING (p) GROUP BY 1),
 sc AS (SELECT q.qname, CASE WHEN strlen(s) < 4 OR l IS NULL THEN 0 ELSE 1 / (1 + exp(l + 3.5)) END AS score FROM q LEFT JOIN b USING (qname))"""


def model(spark, sf):
    words = table(spark, sf, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("word"))
    return dns.bigram_model(words)


@query(DOMAINS_SQL + ", " + MODEL_SQL + " SELECT page_id, round(score, 6) AS score, score >= 0.7 AS generated, round(CASE WHEN len(regexp_replace(qname, '[^aeiou]', '', 'g')) = 0 THEN len(regexp_replace(qname, '[^a-z]', '', 'g')) ELSE (len(regexp_replace(qname, '[^a-z]', '', 'g')) - len(regexp_replace(qname, '[^aeiou]', '', 'g'))) / len(regexp_replace(qname, '[^aeiou]', '', 'g')) END, 6) AS consonants FROM d JOIN sc USING (qname)")
def bigram_scores(spark, sf):
    q, rows = F.col("qname"), domains(spark, sf)
    score = dns.bigram_score(q, model(spark, sf))
    scored = rows.select("qname").distinct().select("qname", F.round(score, 6).alias("score"), (score >= dns.GENERATED).alias("generated"), F.round(dns.consonant_ratio(q), 6).alias("consonants"))
    return rows.select("page_id", "qname").join(scored, "qname").drop("qname")


SUFFIXES = [".example.zip", ".example.xyz", ".ddns.net", "-pool-mine.org", ".tor-exit.net", ".example.org"]


@query(DOMAINS_SQL + ", s AS (SELECT page_id, 'a' || (page_id % 90) AS h, page_id % 6 AS i FROM d) SELECT page_id, i <> 5 OR page_id % 8 = 0 OR page_id % 14 = 1 OR page_id % 11 = 0 AS suspicious, i = 0 AS odd_tld FROM s")
def dns_prefilter(spark, sf):
    p = F.col("page_id")
    name = F.concat(F.lit("a"), (p % 90).cast("string"), F.element_at(F.array(*[F.lit(x) for x in SUFFIXES]), (p % 6 + 1).cast("int")))
    found = dns.is_suspicious(name, F.when(p % 8 == 0, 16).otherwise(1), F.when(p % 14 == 1, 3).otherwise(0), p % 7 == 1, F.when(p % 11 == 0, "XMR-rig").otherwise("curl"), F.lit(0.1))
    return domains(spark, sf).select("page_id", found.alias("suspicious"), fn.has_odd_tld(name).alias("odd_tld"))


STAMP_SQL = "regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '0+$', ''), '[.]$', '') || 'Z'"


def named_alerts(spark, sf):
    k = F.col("k").cast("string")
    return alerts(spark, sf).withColumns({"rule_name": F.concat(F.lit("Rule "), F.col("rule_id")), "message": F.concat(F.lit('m"]'), k), "pod_name": F.when(F.col("k") % 2 == 0, F.concat(F.lit("p"), k)).otherwise(""), "namespace": F.when(F.col("k") % 2 == 0, "ns").otherwise(""), "event_type": F.lit("dns"), "trace_id": F.when(F.col("k") % 5 == 0, "t1").otherwise("")})


POD_SQL = "n AS (SELECT *, 'm\"]' || k AS msg, k % 2 = 0 AS pod FROM alerts)"


@query(ALERTS_SQL + ", " + POD_SQL + r""" SELECT event_id, rule_id, '{"time":"' || """ + STAMP_SQL + r""" || '","rule":"Rule ' || rule_id || '","priority":"' || CASE severity WHEN 'critical' THEN 'Critical' ELSE 'Warning' END || '","output":"m\"]' || k || ' (proc=' || comm || ' pid=' || pid || CASE WHEN pod THEN ' pod=p' || k || ' ns=ns' ELSE '' END || ')","source":"argusframe","output_fields":{"proc.name":"' || comm || '","proc.pid":"' || pid || '","evt.type":"dns","fingerprint":""' || CASE WHEN pod THEN ',"k8s.pod.name":"p' || k || '","k8s.ns.name":"ns"' ELSE '' END || ',"rule.id":"' || rule_id || '"}}' AS line FROM n""")
def falco_lines(spark, sf):
    rows = named_alerts(spark, sf)
    return rows.select("event_id", "rule_id", lines.falco_json(rows).alias("line"))


@query(ALERTS_SQL + ", " + POD_SQL + r""" SELECT event_id, rule_id, '<' || CASE severity WHEN 'critical' THEN 34 WHEN 'warning' THEN 36 ELSE 38 END || '>1 ' || """ + STAMP_SQL + r""" || ' host argusframe - - [argusframe@50000 rule="' || rule_id || '" severity="' || severity || '" pid="' || pid || '" comm="' || comm || '" pod="' || CASE WHEN pod THEN 'p' || k ELSE '-' END || '" namespace="' || CASE WHEN pod THEN 'ns' ELSE '-' END || '" fingerprint=""] ' || msg AS line FROM n""")
def syslog_lines(spark, sf):
    rows = named_alerts(spark, sf)
    return rows.select("event_id", "rule_id", lines.rfc5424(rows, "host").alias("line"))


@query(ALERTS_SQL + ", " + POD_SQL + r""" SELECT event_id, rule_id, 'CEF:0|argusframe|argusframe|1.0|' || rule_id || '|Rule ' || rule_id || '|' || CASE severity WHEN 'critical' THEN 10 ELSE 4 END || '|rt=' || strftime(ts, '%b %d %Y %H:%M:%S') || ' suser=' || comm || ' spid=' || pid || ' cs1Label=rule_id cs1=' || rule_id || CASE WHEN pod THEN ' cs2Label=pod cs2=p' || k || ' cs3Label=namespace cs3=ns' ELSE '' END || CASE WHEN k % 5 = 0 THEN ' cs4Label=trace_id cs4=t1' ELSE '' END || ' msg=' || msg AS line FROM n""")
def cef_event_lines(spark, sf):
    rows = named_alerts(spark, sf)
    return rows.select("event_id", "rule_id", lines.cef_event(rows).alias("line"))


@query(ALERTS_SQL + ", " + POD_SQL + r""" SELECT event_id, rule_id, '{"labels":{"alertname":"ArgusframeAlert","rule_id":"' || rule_id || '","severity":"' || severity || '"' || CASE WHEN pod THEN ',"pod":"p' || k || '","namespace":"ns"' ELSE '' END || '},"annotations":{"summary":"Rule ' || rule_id || '","description":"m\"]' || k || CASE WHEN k % 5 = 0 THEN ' [trace_id: t1]' ELSE '' END || '"},"generatorURL":""}' AS line FROM n""")
def alertmanager_lines(spark, sf):
    rows = named_alerts(spark, sf)
    return rows.select("event_id", "rule_id", lines.alertmanager_json(rows).alias("line"))


@query(ALERTS_SQL + r""" SELECT event_id, rule_id, '{"timeUnixNano":"' || (epoch_us(ts) * 1000) || '","severityNumber":' || CASE severity WHEN 'critical' THEN 21 WHEN 'warning' THEN 13 ELSE 9 END || ',"severityText":"' || upper(severity) || '","body":{"stringValue":""},"attributes":[{"key":"rule.id","value":{"stringValue":"' || rule_id || '"}},{"key":"process.pid","value":{"stringValue":"' || pid || '"}},{"key":"process.name","value":{"stringValue":"' || comm || '"}},{"key":"service.name","value":{"stringValue":"argusframe"}}]}' AS line FROM alerts""")
def log_record_lines(spark, sf):
    rows = alerts(spark, sf)
    return rows.select("event_id", "rule_id", lines.log_record_json(rows).alias("line"))


@query(ALERTS_SQL + """ SELECT '{"rule_id":"' || rule_id || '","pid":' || pid || ',"severity":"' || severity || '"}' AS body FROM alerts WHERE severity <> 'info'""")
def webhook_bodies(spark, sf):
    return lines.webhook_json(alerts(spark, sf).select("rule_id", "pid", "severity"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, 's3' AS service, event_type AS action, CASE WHEN k % 2 = 0 THEN 'arn:' || k ELSE 'u' || user_id END AS principal, 'r' || k AS region FROM e")
def cloudtrail_events(spark, sf):
    k = F.col("k").cast("string")
    who = F.struct(F.when(F.col("k") % 2 == 0, F.concat(F.lit("arn:"), k)).otherwise("").alias("arn"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("principalId"))
    record = F.struct(F.col("event_id").cast("string").alias("eventID"), F.lit("s3.amazonaws.com").alias("eventSource"), F.col("event_type").alias("eventName"), F.concat(F.lit("r"), k).alias("awsRegion"), who.alias("userIdentity"))
    found = cloud.cloudtrail(events(spark, sf).select(F.to_json(F.struct(F.array(record).alias("Records"))).alias("value")))
    return found.select(F.col("event_id").cast("long").alias("event_id"), "service", "action", "principal", "region")


@query(f"WITH {EVENTS_SQL} SELECT event_id, event_type AS action, CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN 'denied' ELSE 'CODE_2' END AS error_code, CASE WHEN k % 2 = 0 THEN 'l' || k ELSE 'z' || k END AS region FROM e")
def gcp_events(spark, sf):
    k = F.col("k").cast("string")
    status = F.struct((F.col("k") % 3).alias("code"), F.when(F.col("k") % 3 == 1, "denied").otherwise("").alias("message"))
    labels = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("location"), F.concat(F.lit("l"), k), F.lit("zone"), F.lit("x"))).otherwise(F.create_map(F.lit("zone"), F.concat(F.lit("z"), k)))
    body = F.struct(F.col("event_id").cast("string").alias("insertId"), F.struct(labels.alias("labels")).alias("resource"), F.struct(F.col("event_type").alias("methodName"), status.alias("status")).alias("protoPayload"))
    found = cloud.gcp_audit(events(spark, sf).select(F.to_json(body).alias("value")))
    return found.select(F.col("event_id").cast("long").alias("event_id"), "action", "error_code", "region")


@query(f"WITH {EVENTS_SQL} SELECT event_id, CASE WHEN k % 2 = 0 THEN 'c' || k ELSE 'u' || user_id END AS principal, CASE WHEN k % 4 = 1 THEN '403' ELSE '' END AS error_code, 'g' || k AS region FROM e")
def azure_events(spark, sf):
    k = F.col("k").cast("string")
    record = F.struct(F.col("event_id").cast("string").alias("id"), F.lit("A/b").alias("operationName"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("c"), k)).otherwise("").alias("caller"), F.create_map(F.lit("upn"), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("claims"), F.when(F.col("k") % 4 == 1, "Error").otherwise("Information").alias("level"), F.lit("403").alias("resultType"), F.concat(F.lit("/subscriptions/1/resourceGroups/g"), k, F.lit("/x")).alias("resourceId"))
    found = cloud.azure_activity(events(spark, sf).select(F.to_json(F.struct(F.array(record).alias("records"))).alias("value")))
    return found.select(F.col("event_id").cast("long").alias("event_id"), "principal", "error_code", "region")


@query(f"WITH {EVENTS_SQL} SELECT 'b' || (k % 3) AS bucket, CASE WHEN k % 2 = 0 THEN 'o' ELSE 'r' END || event_id AS key FROM e")
def queue_messages(spark, sf):
    bucket, id = F.concat(F.lit("b"), (F.col("k") % 3).cast("string")), F.col("event_id").cast("string")
    old = F.to_json(F.struct(bucket.alias("s3Bucket"), F.array(F.concat(F.lit("o"), id)).alias("s3ObjectKey")))
    s3 = F.struct(F.struct(bucket.alias("name")).alias("bucket"), F.struct(F.concat(F.lit("r"), id).alias("key")).alias("object"))
    new = F.to_json(F.struct(F.array(F.struct(s3.alias("s3"))).alias("Records")))
    return logs.queue_messages(events(spark, sf).select(F.when(F.col("k") % 2 == 0, F.to_json(F.struct(old.alias("Message")))).otherwise(new).alias("value")))


@query(f"WITH {EVENTS_SQL} SELECT DISTINCT CASE WHEN k % 2 = 0 THEN 'ip' ELSE 'dns' END AS type, CASE WHEN k % 2 = 0 THEN '10.0.0.' || k ELSE 'h' || k || '.example' END AS value FROM e WHERE k % 5 <> 0")
def feed_indicators(spark, sf):
    k = F.col("k").cast("string")
    pattern = F.when(F.col("k") % 5 == 0, "[file:hashes = 'x']").when(F.col("k") % 2 == 0, F.concat(F.lit("[ipv4-addr:value = '10.0.0."), k, F.lit("']"))).otherwise(F.concat(F.lit("[domain-name:value='H"), k, F.lit(".example']")))
    return logs.indicator_frames(events(spark, sf).select(F.to_json(F.struct(F.array(F.struct(pattern.alias("pattern"))).alias("objects"))).alias("value")), "stix")


@query("SELECT CAST(5000 AS BIGINT) AS n, CAST(5000 AS BIGINT) AS ids, CAST(6 AS BIGINT) AS kinds, TRUE AS has_blocks")
def synthetic_events(spark, sf):
    block = F.coalesce(*[F.when(F.col("event_type") == k, F.col(k).isNotNull()) for k in ("syscall", "network", "file", "dns", "tls", "privesc")])
    return logs.synthetic(spark, 5000).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"), F.count_distinct("event_type").alias("kinds"), F.bool_and(block).alias("has_blocks"))


@query(f"WITH {EVENTS_SQL} SELECT DISTINCT k AS item FROM e")
def chunked_values(spark, sf):
    from ..operators.lookups import in_chunks

    return in_chunks(events(spark, sf), "k", 20).where("size(items) <= 20").select(F.explode("items").alias("item"))


@query(f"WITH {EVENTS_SQL} SELECT CAST('{{' AS VARCHAR) AS head, count(DISTINCT k) AS n FROM e")
def exported_rules(spark, sf):
    profile = events(spark, sf).agg(F.collect_set("k").alias("syscalls"))
    text = store.export_rules(profile)
    from ..sources.rule_files import load_text

    (rule,) = load_text(text)
    return spark.createDataFrame([(text[0], len(rule.when.values))], "head string, n long")


@query("SELECT 'rules.yaml' AS name, sha256('rules: []') AS digest")
def rule_checksums(spark, sf):
    from ..sources.rule_files import checksums_of

    listed = checksums_of(f"# list\n{hashlib.sha256(b'rules: []').hexdigest()}  rules.yaml\n")
    return spark.createDataFrame(list(listed.items()), "name string, digest string")
