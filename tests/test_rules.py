"""Rule operators, null discipline, validation, overlays and canaries on hand-written events."""

import pytest

from argusframe.operators.rules import CAPABILITIES, Condition, Group, Rule, canary_rules, evaluate, indicator_rules, overlay, problems
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def files(spark):
    rows = [(1, "file", "/etc/shadow", "10.1.2.3", "0", 0, 1 << CAPABILITIES.index("sys_admin")), (2, "file", "", "8.8.8.8", "12.5", 1 << 21, 0), (3, "file", None, "::1", "x", None, None), (4, "dns", "/etc/shadow", "bad", None, 0, 0)]
    return spark.createDataFrame(rows, "event_id long, event_type string, filename string, daddr string, size string, old_caps long, new_caps long")


CASES = [
    (Condition("filename", "in", ("/etc/shadow",)), {1}), (Condition("filename", "in", ()), set()), (Condition("filename", "not_in", ("/etc/shadow",)), {2}), (Condition("filename", "not_in", ()), {1, 2}),
    (Condition("filename", "equals", ("", "x")), {2}), (Condition("filename", "eq", ()), set()), (Condition("filename", "not_equals", ("a",)), {1, 2}), (Condition("filename", "neq", ()), {1, 2}),
    (Condition("filename", "prefix", ("/x", "/etc")), {1}), (Condition("filename", "not_prefix", ("/x",)), {1}), (Condition("filename", "suffix", ("dow",)), {1}), (Condition("filename", "not_suffix", ("dow",)), set()),
    (Condition("filename", "contains", ("sha",)), {1}), (Condition("filename", "regex", ("^/etc/.*w$",)), {1}), (Condition("size", "gt", (1,)), {2}), (Condition("size", "lt", (1,)), {1}), (Condition("size", "gte", (12.5,)), {2}), (Condition("size", "lte", ("no",)), set()),
    (Condition("daddr", "in_cidr", ("10.0.0.0/8",)), {1}), (Condition("daddr", "not_in_cidr", ("10.0.0.0/8",)), {2, 3}), (Condition("", "caps_gained", ("CAP_SYS_ADMIN", "nonsense")), {1}), (Condition("", "caps_dropped", ("sys_admin",)), {2}),
    (Condition("filename", "nonsense", ("a",)), set()), (Condition("missing", "not_in", ("a",)), set()),
    (Group("or", (Condition("filename", "eq", ("",)), Condition("size", "eq", ("0",)))), {1, 2}), (Group("and", (), (Group("or", (Condition("size", "lt", (5,)),)),)), {1}), (Group("and"), {1, 2, 3}),
]


def fields():
    return {c: F.col(c) for c in ("filename", "daddr", "size", "old_caps", "new_caps")}


def test_every_operator(files):
    rules = [Rule(str(i), "file", when) for i, (when, _) in enumerate(CASES)]
    found = {}
    for r in evaluate(files, rules, fields()).collect():
        found.setdefault(int(r.rule_id), set()).add(r.event_id)
    assert {i: found.get(i, set()) for i in range(len(CASES))} == {i: want for i, (_, want) in enumerate(CASES)}


def test_in_cidr_ipv6(spark):
    rows = [(i, x) for i, x in enumerate(["2001:DB8::1", "2001:db8:0:0:0:0:0:2", "2001:db9::1", "::1", "::", "fe80::1%e", "1::2::3", "1:2:3", "::ffff:10.1.2.3", "10.1.2.3", "2001:db8::1.2.3.4", ":::", "2001:db8::1.2.3.999", None])]
    ips = spark.createDataFrame(rows, "i int, ip string")
    ips = ips.withColumn("event_type", F.lit("file"))
    found = lambda *nets: {r.i for r in evaluate(ips, [Rule("a", "file", Condition("ip", "in_cidr", nets))], {"ip": F.col("ip")}).collect()}
    assert found("2001:db8::/32") == {0, 1, 10} and found("::1/128") == {3} and found("::/0") == {0, 1, 2, 3, 4, 10}
    assert found("10.0.0.0/8", "2001:db9::/32") == {2, 8, 9}
    assert found("::ffff:10.1.0.0/112") == {8, 9} and found("::ffff:10.2.0.0/112") == set() and found("::ffff:a01:203/128") == {8, 9}


def test_exceptions_drop_and_overlay(files):
    base = [Rule("a", "file", Group("and")), Rule("b", "file", Group("and"), action="drop")]
    tuned, unknown = overlay(base, {"a": [Condition("daddr", "equals", ("8.8.8.8",))], "z": []})
    assert unknown == ["z"] and {(r.event_id, r.rule_id) for r in evaluate(files, tuned, fields()).collect()} == {(1, "a"), (3, "a")}
    assert evaluate(files, [], fields()).count() == 0


def test_validation():
    rules = [Rule("a", "file", Group()), Rule("a", "file", Condition("x", "in")), Rule("b", "none", Group()), Rule("c", "file", Condition("filename", "bad")), Rule("d", "file", Condition("filename", "regex", ("x" * 2000,)))]
    assert len(problems(rules, {"file": {"filename"}})) == 6
    assert not problems(canary_rules(["/tmp/x"]), {"file": {"filename"}})


def test_indicator_rules(spark):
    feed = [("ip", "10.1.2.3"), ("ip", "10.1.2.3"), ("ip", "8.8.8.8"), ("ip", "9.9.9.9"), ("cidr", "10.0.0.0/8"), ("domain", "bad.example"), ("url", "HTTP://Worse.example:80/x"), ("hash", "aa"), (None, "x"), ("ip", None), ("ip", "")]
    listed = spark.createDataFrame(feed, "type string, value string")
    rules = indicator_rules(listed, "f", 2)
    assert [r.id for r in rules] == ["feed_f_ip_001", "feed_f_ip_002", "feed_f_cidr_001", "feed_f_domain_001"]
    assert rules[0].when.values == ("10.1.2.3", "8.8.8.8") and not problems(rules, {"network": {"daddr"}, "dns": {"qname"}})
    rows = spark.createDataFrame([(1, "network", "10.1.2.3", None), (2, "network", "10.9.9.9", None), (3, "network", "1.1.1.1", None), (4, "dns", None, "a.worse.example"), (5, "dns", None, "fine.example")], "event_id int, event_type string, daddr string, qname string")
    found = {(r.event_id, r.rule_id) for r in evaluate(rows, rules, {"daddr": F.col("daddr"), "qname": F.col("qname")}).collect()}
    assert found == {(1, "feed_f_ip_001"), (1, "feed_f_cidr_001"), (2, "feed_f_cidr_001"), (4, "feed_f_domain_001")}
    assert indicator_rules(listed.limit(0), "f") == []
    with pytest.raises(ValueError):
        indicator_rules(listed, "f", listed=2)
