"""Scalar field functions over event columns, all as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENT_TYPES = ["syscall", "network", "file", "tls", "dns", "privesc", "lsm_audit", "sequence", "net_close", "http_plaintext", "kmod", "cgroup_esc", "gpu", "io_uring", "bpf_program", "cloud_audit"]
#: Suspicious top-level domains (fixed values).
ODD_TLDS = [".onion", ".bit", ".bazar", ".coin", ".lib", ".emc", ".zip", ".mov", ".phd", ".xxx"]
#: Where programs lie.
PROGRAM_DIRS = ["/bin/", "/sbin/", "/usr/bin/", "/usr/sbin/", "/usr/local/bin/"]


def c_string(s: Column) -> Column:
    """Text up to the first NUL."""
    return F.substring_index(s, "\0", 1)


def directory(path: Column) -> Column:
    """Of a rule: without the last slash; "/" where there is none before it."""
    cut = F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def extension(path: Column) -> Column:
    """Of a rule: from the last dot of the whole path."""
    return F.regexp_extract(path, r"(?s)(\.[^.]*)\z", 1)


def profile_directory(path: Column) -> Column:
    """Of a profile: with the last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def profile_extension(path: Column) -> Column:
    """Of a profile: the dot must follow the last slash."""
    return F.regexp_extract(path, r"(?s)(\.[^./]*)\z", 1)


def path_prefix(path: Column) -> Column:
    """The first two non-empty segments; numbers become *."""
    parts = F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, 2)
    named = F.transform(parts, lambda x: F.when(x.rlike(r"^[0-9]+\z"), "*").otherwise(x))
    return F.when(path == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(named, "/")))


def is_program(path: Column) -> Column:
    return path.rlike("^(" + "|".join(PROGRAM_DIRS) + ")")


def is_library(path: Column) -> Column:
    return path.endswith(".so") | path.contains(".so.") | path.startswith("/lib/") | path.startswith("/usr/lib/")


def split_and_trim(s: Column, separator: str = ",") -> Column:
    """The trimmed parts that aren't empty."""
    return F.filter(F.transform(F.split(s, "\\Q" + separator + "\\E"), lambda x: F.trim(x)), lambda x: x != "")


def host_of_url(url: Column) -> Column:
    """Without user, password and port, and without the brackets of an IPv6 address."""
    host = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)", 1)
    return F.lower(F.regexp_replace(host, r"^\[|\]$", ""))


def path_of_url(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def entropy(s: Column) -> Column:
    """Shannon entropy in bits of a name's characters, over its bytes."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.octet_length(s)
    total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(F.octet_length(s) == 0, F.lit(0.0)).otherwise(total)


def base_domain(qname: Column) -> Column:
    """At most two labels: the first one; else all but the last, without dots."""
    labels = F.split(qname, r"\.")
    return F.when(F.size(labels) <= 2, F.get(labels, F.lit(0))).otherwise(F.array_join(F.slice(labels, F.lit(1), F.size(labels) - 1), ""))


def subdomain_count(qname: Column) -> Column:
    return F.greatest(F.size(F.split(qname, r"\.")) - 2, F.lit(0))


def digit_ratio(s: Column) -> Column:
    return F.when(F.octet_length(s) == 0, F.lit(0.0)).otherwise(F.char_length(F.regexp_replace(s, "[^0-9]", "")) / F.octet_length(s))


def is_tunneling(qname: Column) -> Column:
    return F.octet_length(qname) > 50


def is_generated(qname: Column) -> Column:
    """Long and random-looking: ten bytes and more than 3.5 bits a character."""
    base = base_domain(qname)
    return (F.octet_length(base) >= 10) & (entropy(base) > 3.5)


def has_odd_tld(qname: Column) -> Column:
    return F.rlike(F.lower(qname), F.lit("(" + "|".join(t.replace(".", r"\.") for t in ODD_TLDS) + r")\z"))


def size_bucket(n: Column) -> Column:
    """floor(log2(n)); 0 for 0."""
    return F.when(n <= 0, F.lit(0)).otherwise(F.length(F.bin(n)) - 1)


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it isn't one."""
    ok = ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}\z")
    part = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).try_cast("long")  # noqa: E731  no lambda columns: this runs for every event
    return F.when(ok, part(1) * (1 << 24) + part(2) * (1 << 16) + part(3) * 256 + part(4))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def ipv6_hex(ip: Column) -> Column:
    """An IPv6 address as 32 hex digits in lower case; null if it isn't one. The last 32 bits may be written as IPv4."""
    none = F.array().cast("array<string>")

    def written(tail: Column) -> Column:
        """The address with its last 32 bits in hex."""
        low = F.lpad(F.lower(F.hex(tail)), 8, "0")
        text = F.when(tail.isNotNull(), F.concat(F.regexp_extract(ip, r"^(.*:)[0-9.]+\z", 1), F.left(low, F.lit(4)), F.lit(":"), F.right(low, F.lit(4)))).otherwise(ip)
        return F.when(F.contains(ip, F.lit(".")) & tail.isNull(), F.lit(None)).otherwise(F.lower(text))

    def of_halves(halves: Column) -> Column:
        groups = lambda half: F.when(half == "", none).otherwise(F.split(half, ":"))
        right = F.when(F.size(halves) == 1, none).otherwise(F.coalesce(groups(F.get(halves, F.lit(1))), none))
        return bound(F.struct(groups(F.get(halves, F.lit(0))).alias("left"), right.alias("right"), (F.size(halves) == 2).alias("short")), of_groups)

    def of_groups(x: Column) -> Column:
        joined = lambda part: F.array_join(F.transform(part, lambda g: F.lpad(g, 4, "0")), "")
        n = F.size(x["left"]) + F.size(x["right"])
        right = lambda part: F.forall(part, lambda g: g.rlike(r"^[0-9a-f]{1,4}\z"))
        ok = right(x["left"]) & right(x["right"]) & F.when(x["short"], n <= 7).otherwise(n == 8)
        return F.when(ok, F.concat(joined(x["left"]), F.repeat(F.lit("0000"), 8 - n), joined(x["right"])))

    tail = ipv4_number(F.regexp_extract(ip, r":([0-9.]+)\z", 1))
    return F.when(F.contains(ip, F.lit(":")), bound(F.split(bound(tail, written), "::"), lambda halves: F.when(F.size(halves) <= 2, of_halves(halves))))


def mapped_ipv4(digits: Column) -> Column:
    """The IPv4 address, as a number, that an IPv6 address of 32 hex digits stands for; null if it stands for none."""
    return F.when(F.startswith(digits, F.lit("0" * 20 + "f" * 4)), F.conv(F.right(digits, F.lit(8)), 16, 10).cast("long"))


def cidr_bounds(cidr: str) -> tuple[int, int]:
    """First and last address of an IPv4 network, as numbers."""
    import ipaddress

    network = ipaddress.ip_network(cidr, strict=False)
    return int(network.network_address), int(network.broadcast_address)


def ipv4_text(n: Column) -> Column:
    """A 32-bit number as a dotted address."""
    return F.concat_ws(".", *[F.shiftright(n, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)])


def ipv6_text(digits: Column) -> Column:
    """32 hex digits as the shortest text: the first of the longest runs of two or more zero groups becomes ::."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.lower(F.substr(digits, i * 4 + 1, F.lit(4))), r"^0{1,3}", ""))
    full = F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":"))
    out = F.array_join(groups, ":")
    for n in range(2, 9):  # the longest run is tried last, so it wins
        zeros = ":" + "0:" * n
        out = F.when(F.contains(full, F.lit(zeros)), F.regexp_replace(F.concat(F.substring_index(full, zeros, 1), F.lit("::"), F.substr(full, F.locate(zeros, full) + len(zeros))), r"^:(?!:)|(?<!:):\z", "")).otherwise(out)
    return out


def alert_id(prefix: Column, ts: Column, pid: Column, number: Column) -> Column:
    return F.concat_ws("-", prefix, F.unix_micros(ts.cast("timestamp")) * 1000, pid, number)


def hashed_id(ts: Column, rule: Column, pid: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of nanoseconds:rule:pid."""
    return F.left(F.sha2(F.concat_ws(":", (F.unix_micros(ts.cast("timestamp")) * 1000).cast("string"), rule, pid.cast("string")), 256), F.lit(32))


def truncated(s: Column, n: int) -> Column:
    return F.when(F.char_length(s) > n, F.concat(F.left(s, F.lit(n - 1)), F.lit("…"))).otherwise(s)


def json_text(s: Column) -> Column:
    """A string as JSON, with <, > and & escaped."""
    text = F.regexp_extract(F.to_json(F.array(F.coalesce(s.cast("string"), F.lit("")))), r"(?s)^\[(.*)\]\z", 1)
    for a, b in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def alert_fingerprint(id: Column, ts: Column, rule: Column, severity: Column, pid: Column, comm: Column, message: Column, pod: Column | None = None, namespace: Column | None = None) -> Column:
    """SHA-256 of an object of these fields in this order; an empty pod or namespace is left out."""
    nanos = (F.unix_micros(ts.cast("timestamp")) * 1000).cast("string")
    parts = [F.lit('{"id":'), json_text(id), F.lit(',"ts":'), nanos, F.lit(',"rule_id":'), json_text(rule), F.lit(',"severity":'), json_text(severity), F.lit(',"pid":'), pid.cast("string"), F.lit(',"comm":'), json_text(comm), F.lit(',"msg":'), json_text(message)]
    for name, value in (("pod", pod), ("ns", namespace)):
        if value is not None:
            parts.append(F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.concat(F.lit(f',"{name}":'), json_text(value))))
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


def masked(header: Column, value: Column, secret: list[str]) -> Column:
    """A secret header's value as so many asterisks."""
    return F.when(F.lower(header).isin(secret), F.repeat(F.lit("*"), F.char_length(value))).otherwise(value)


def cef_escaped(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"([\\=|])", r"\\$1"), "\n", r"\\n"), "\r", r"\\r")


def cef_line(vendor: str, rule: Column, name: Column, severity: Column, extension: Column) -> Column:
    level = F.when(severity == "critical", "10").when(severity == "warning", "5").otherwise("4")
    return F.concat_ws("|", F.lit("CEF:0"), F.lit(vendor), F.lit("events"), F.lit("1.0"), cef_escaped(rule), cef_escaped(name), level, extension)
