"""Binary messages: DNS packets and TLS client hellos, parsed in Arrow batches. A message cut short or malformed gives null."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DNS_FIELDS = "qname string, qtype int, rcode int, direction int, response_ips array<string>"
HELLO_FIELDS = "version int, ciphers array<int>, extensions array<int>, curves array<int>, formats array<int>, sni string, alpn array<string>, signatures array<int>"
MOST_JUMPS = 32


def number(data: bytes, at: int, size: int = 2) -> int:
    if at + size > len(data):
        raise ValueError("short")
    return int.from_bytes(data[at : at + size], "big")


def name_at(data: bytes, at: int) -> tuple[str, int]:
    """A name and where what follows it begins; pointers are followed a bounded number of times."""
    labels, after = [], None
    for _ in range(MOST_JUMPS + 128):
        size = number(data, at, 1)
        if size >= 0xC0:
            after = at + 2 if after is None else after
            at = number(data, at) & 0x3FFF
        elif size:
            if at + 1 + size > len(data):
                raise ValueError("short")
            labels.append(data[at + 1 : at + 1 + size].decode("utf-8", "replace"))
            at += 1 + size
        else:
            return ".".join(labels), at + 1 if after is None else after
    raise ValueError("loop")


def dns_message(data: bytes | None) -> dict | None:
    try:
        flags, questions, answers = number(data, 2), number(data, 4), number(data, 6)
        if not questions:
            return None
        qname, at = name_at(data, 12)
        qtype, at, ips = number(data, at), at + 4, []
        for _ in range(questions - 1):
            at = name_at(data, at)[1] + 4
        for _ in range(answers):
            at = name_at(data, at)[1]
            kind, size = number(data, at), number(data, at + 8)
            if kind == 1 and size == 4 and at + 14 <= len(data):
                ips.append(str(ipaddress.IPv4Address(data[at + 10 : at + 14])))
            at += 10 + size
        return {"qname": qname, "qtype": qtype, "rcode": flags & 15, "direction": flags >> 15, "response_ips": ips}
    except (ValueError, TypeError):
        return None


def numbers(data: bytes, size: int = 2) -> list[int]:
    return [int.from_bytes(data[i : i + size], "big") for i in range(0, len(data) - size + 1, size)]


def is_grease(x: int) -> bool:
    return x & 0x0F0F == 0x0A0A and x >> 8 == x & 255


def client_hello(data: bytes | None) -> dict | None:
    """Of a TLS record or a bare handshake message; reserved (grease) numbers are left out."""
    try:
        at = 5 if data[0] == 0x16 else 0
        if data[at] != 1:
            return None
        at += 4
        out = {"version": number(data, at), "sni": None, "alpn": [], "curves": [], "formats": [], "signatures": [], "extensions": []}
        at += 34
        at += 1 + number(data, at, 1)
        size = number(data, at)
        out["ciphers"] = [x for x in numbers(data[at + 2 : at + 2 + size]) if not is_grease(x)]
        at += 2 + size
        at += 1 + number(data, at, 1)
        end = at + 2 + number(data, at) if at + 2 <= len(data) else at
        at += 2
        while at + 4 <= min(end, len(data)):
            kind, size = number(data, at), number(data, at + 2)
            body, at = data[at + 4 : at + 4 + size], at + 4 + size
            if is_grease(kind):
                continue
            out["extensions"].append(kind)
            if kind == 0 and len(body) > 5:
                out["sni"] = body[5 : 5 + number(body, 3)].decode("utf-8", "replace")
            elif kind == 10:
                out["curves"] = [x for x in numbers(body[2:]) if not is_grease(x)]
            elif kind == 11:
                out["formats"] = list(body[1:])
            elif kind == 13:
                out["signatures"] = numbers(body[2:])
            elif kind == 16:
                i = 2
                while i < len(body):
                    out["alpn"].append(body[i + 1 : i + 1 + body[i]].decode("utf-8", "replace"))
                    i += 1 + body[i]
            elif kind == 43 and len(body) >= 3:
                out["version"] = max([x for x in numbers(body[1:]) if not is_grease(x)], default=out["version"])
        return out
    except (ValueError, TypeError, IndexError):
        return None


def frame_of(rows: list[dict | None], kinds: str) -> pd.DataFrame:
    """A pandas frame of the struct's columns; a row of nulls where there is none."""
    names = [c.split()[0] for c in kinds.split(", ")]
    out = pd.DataFrame([[(x or {}).get(n) for n in names] for x in rows], columns=names, dtype=object)
    return out.astype({n: "Int32" for n, kind in (c.split() for c in kinds.split(", ")) if kind == "int"})


def parse_dns(payload: Column) -> Column:
    @F.pandas_udf(DNS_FIELDS)
    def run(data: pd.Series) -> pd.DataFrame:
        return frame_of([dns_message(x) for x in data], DNS_FIELDS)

    return run(payload)


def parse_hello(payload: Column) -> Column:
    @F.pandas_udf(HELLO_FIELDS)
    def run(data: pd.Series) -> pd.DataFrame:
        return frame_of([client_hello(x) for x in data], HELLO_FIELDS)

    return run(payload)
