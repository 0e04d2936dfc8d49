"""TLS fingerprints over parsed hellos: JA3 and JA3S as MD5, JA4 with truncated SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Version numbers and their names in JA4.
VERSIONS = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3", 0x0002: "s2"}


def dashed(numbers: Column) -> Column:
    return F.when(F.size(numbers) > 0, F.array_join(F.transform(numbers, lambda x: x.cast("string")), "-")).otherwise("-")


def ja3(version: Column, ciphers: Column, extensions: Column, curves: Column, formats: Column) -> Column:
    """Lists in wire order; - for an empty one."""
    return F.md5(F.concat_ws(",", version.cast("string"), dashed(ciphers), dashed(extensions), dashed(curves), dashed(formats)).cast("binary"))


def ja3s(version: Column, cipher: Column, extensions: Column) -> Column:
    """Extensions sorted."""
    return F.md5(F.concat_ws(",", version.cast("string"), cipher.cast("string"), dashed(F.array_sort(extensions))).cast("binary"))


def sorted_digest(numbers: Column) -> Column:
    """The first 12 hex digits of the SHA-256 of the sorted hex codes, of four digits at least."""
    code = lambda x: F.lpad(F.lower(F.hex(x)), F.greatest(F.lit(4), F.length(F.hex(x))), "0")
    codes = F.array_sort(F.transform(numbers, code))
    return F.left(F.sha2(F.array_join(codes, ","), 256), F.lit(12))


def ja4(version: Column, ciphers: Column, extensions: Column, sni: Column) -> Column:
    named = F.create_map(*[x for k, v in VERSIONS.items() for x in (F.lit(k), F.lit(v))])
    domain = (F.coalesce(sni, F.lit("")) != "") & ~F.coalesce(sni, F.lit("")).rlike(r"^\d{1,3}(\.\d{1,3}){3}\z")
    head = F.concat(F.lit("t"), F.coalesce(F.try_element_at(named, version.cast("int")), F.lit("00")), F.when(domain, "d").otherwise("i"), F.when(F.size(ciphers) < 10, "0").otherwise(""), F.size(ciphers).cast("string"))
    return F.concat(head, sorted_digest(ciphers), F.lit("_"), sorted_digest(extensions))
