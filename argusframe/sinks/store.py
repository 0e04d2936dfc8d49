"""Tables that alerts and profiles are kept in: upserts that rewrite only what they touch, commits that survive a dead writer, and what is
exported of profiles.

A table is a folder. Rows lie in cells, by day of their time and by a hash of their key; a cell is one folder of Parquet files under
``data/<writer>``. ``commits/<version>.json`` names the cells of a version and where each lies, the schema, and the last batch of each
source; a version is there when its commit is, which is written beside its place and renamed. So a writer that dies leaves files that no
commit names, readers keep the version that they began with, and a batch that comes again finds its number and changes nothing. Two
writers at once: the one whose version is taken starts over on the other's.

A merge reads the touched cells and writes them anew; all others stay where they are. Rows without a time lie in the day ``none``. A null
key is a key like any other. Of a key the row with the greatest ``order`` stays; of equal ones the one of the later merge, then the greater row.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .folders import Files

LISTED = 100_000
#: Hash cells of a day.
CELLS = 16
#: Tries of a writer whose version others keep taking.
TRIES = 20


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table, oldest first."""
    return sorted(int(n[:-5]) for n in Files(spark, path).names("commits") if n.endswith(".json") and n[:-5].isdigit())


def commit_of(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What a version (the last, if not given) consists of; None where there is none."""
    known = versions(spark, path)
    return Files(spark, path).read_json(f"commits/{(known[-1] if version is None else version):08d}.json") if known else None


def cells_of(rows: DataFrame, key: str, ts: str | None, cells: int) -> tuple[Column, Column]:
    day = F.coalesce(F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd"), F.lit("none")) if ts and ts in rows.columns else F.lit("none")
    return day.alias("__day"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(cells)).cast("int").alias("__cell")


def opened(spark: SparkSession, path: str, commit: dict, names: list[str] | None = None) -> DataFrame:
    """The rows of a version's cells, of all or of the named ones."""
    schema = StructType.fromJson(commit["schema"])
    places = [f"{path}/{commit['cells'][n]}" for n in (commit["cells"] if names is None else names)]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None, since: str = "", until: str = "") -> DataFrame | None:
    """A version of the table, None where there is none; since and until (days, both included) leave out cells unread."""
    commit = commit_of(spark, path, version)
    if commit is None:
        return None
    days = [n for n in commit["cells"] if (not since or n.split("/")[0] >= since) and (not until or n.split("/")[0] <= until)]
    return opened(spark, path, commit, days)


def written(rows: DataFrame, path: str) -> dict[str, str]:
    """Writes rows that have __day and __cell; where each cell lies."""
    spark, own = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    rows.repartition("__day", "__cell").write.partitionBy("__day", "__cell").parquet(f"{path}/{own}")
    files, out = Files(spark, f"{path}/{own}"), {}
    for day in (n for n in files.names() if n.startswith("__day=")):
        for cell in (n for n in files.names(day) if n.startswith("__cell=")):
            out[f"{day[6:]}/{cell[7:]}"] = f"{own}/{day}/{cell}"
    return out


def changed(spark: SparkSession, path: str, change, source: str = "", batch: int | None = None, cells: int = CELLS) -> int | None:
    """Commits what ``change`` makes of the last version (commit -> (cells, schema), None for no change); the new version's number."""
    for _ in range(TRIES):
        known, commit = versions(spark, path), commit_of(spark, path)
        if batch is not None and commit and batch <= commit["batches"].get(source, -1):
            return None
        made = change(commit)
        if made is None:
            return None
        batches = dict(commit["batches"]) if commit else {}
        if batch is not None:
            batches[source] = batch
        version = known[-1] + 1 if known else 0
        if Files(spark, path).create(f"commits/{version:08d}.json", {"cells": made[0], "schema": made[1], "batches": batches, "cells_a_day": (commit or {}).get("cells_a_day", cells)}):
            return version
    raise RuntimeError(f"{path}: other writers took {TRIES} versions in a row")


def merge(rows: DataFrame, path: str, key: str = "id", order: str = "arrived", ts: str | None = None, source: str = "", batch: int | None = None, moves: bool = True, cells_a_day: int = CELLS) -> int | None:
    """Upserts rows; the new version's number, None if nothing was to do. cells_a_day: hash cells of each day, settled by a table's first merge. ts: the column that days are taken from. source and batch: a batch
    of a source that was merged before, or an earlier one, changes nothing. moves: a key's row may come with another day than before, so
    that the keys of its hash cell are looked up on all days."""
    spark = rows.sparkSession

    def change(commit: dict | None):
        cells = (commit or {}).get("cells_a_day", cells_a_day)
        new = rows.select("*", *cells_of(rows, key, ts, cells), F.lit(1).alias("__late"))
        touched = [(r["__day"], r["__cell"]) for r in new.select("__day", "__cell").distinct().collect()]  # cells, not rows
        if not touched:
            return None
        known = (commit or {"cells": {}})["cells"]
        names = {f"{d}/{c}" for d, c in touched}
        if commit and moves and ts:
            hashes = {c for _, c in touched}
            other = [n for n in known if n not in names and int(n.split("/")[1]) in hashes]
            if other:
                held = opened(spark, path, commit, other)
                held = held.select(F.col(key).alias("__k"), *cells_of(held, key, ts, cells))
                hit = held.join(rows.select(F.col(key).alias("__n")).distinct(), F.col("__k").eqNullSafe(F.col("__n")), "left_semi")
                names |= {f"{r['__day']}/{r['__cell']}" for r in hit.select("__day", "__cell").distinct().collect()}
        both = new
        if commit:
            held = opened(spark, path, commit, sorted(names & set(known)))
            both = held.select("*", *cells_of(held, key, ts, cells), F.lit(0).alias("__late")).unionByName(new, allowMissingColumns=True)
        plain = [c for c in both.columns if c not in ("__day", "__cell", "__late")]
        last = Window.partitionBy("__cell", key).orderBy(F.desc(order), F.desc("__late"), *[F.desc(F.col(c).cast("string")) for c in plain])
        left = both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__late")
        made = written(left, path)
        return {n: p for n, p in known.items() if n not in names} | made, json.loads(left.drop("__day", "__cell").schema.json())

    return changed(spark, path, change, source, batch, cells_a_day)


def batch_writer(path: str, key: str = "id", order: str = "arrived", ts: str | None = None, source: str = "stream", moves: bool = True):
    """For ``writeStream.foreachBatch``: each micro-batch is one upsert; a batch that comes again changes nothing. source: the stream's name, one
    for each stream and checkpoint that writes to the table."""
    return lambda rows, batch: merge(rows, path, key, order, ts, source, batch, moves)


def delete(keys: DataFrame, path: str, key: str = "id", ts: str | None = None) -> int | None:
    """Deletes the rows of these keys; keys that the table lacks and a missing table change nothing."""
    spark = keys.sparkSession

    def change(commit: dict | None):
        if not commit:
            return None
        cells, gone = commit["cells_a_day"], keys.select(F.col(key).alias("__n")).distinct()
        hashes = {r["__cell"] for r in gone.select(cells_of(gone, "__n", None, cells)[1]).distinct().collect()}
        held = opened(spark, path, commit, [n for n in commit["cells"] if int(n.split("/")[1]) in hashes])
        held = held.select("*", *cells_of(held, key, ts, cells))
        same = F.col(key).eqNullSafe(F.col("__n"))
        names = {f"{r['__day']}/{r['__cell']}" for r in held.join(gone, same, "left_semi").select("__day", "__cell").distinct().collect()}
        if not names:
            return None
        rows = opened(spark, path, commit, sorted(names))
        left = rows.select("*", *cells_of(rows, key, ts, cells)).join(gone, same, "left_anti")
        return {n: p for n, p in commit["cells"].items() if n not in names} | written(left, path), commit["schema"]

    return changed(spark, path, change)


def expire(spark: SparkSession, path: str, before: str, ts: str = "ts") -> int | None:
    """Retention: rows older than ``before`` go. Whole days leave the commit unread; only the day that ``before`` lies in is rewritten."""

    def change(commit: dict | None):
        if not commit:
            return None
        day = spark.range(1).select(F.date_format(F.lit(before).cast("timestamp"), "yyyy-MM-dd")).first()[0]
        kept = {n: p for n, p in commit["cells"].items() if n.split("/")[0] > day}  # "none" sorts after all days
        edge = [n for n in commit["cells"] if n.split("/")[0] == day]
        if edge:
            parts = [opened(spark, path, commit, [n]).where(F.col(ts) >= F.lit(before).cast("timestamp")).withColumns({"__day": F.lit(day), "__cell": F.lit(int(n.split("/")[1]))}) for n in edge]
            left = parts[0]
            for p in parts[1:]:
                left = left.union(p)
            kept |= written(left, path)
        return None if len(kept) == len(commit["cells"]) and not edge else (kept, commit["schema"])

    return changed(spark, path, change)


def clean(spark: SparkSession, path: str, keep: int = 2, age_s: float = 86_400) -> list[str]:
    """Deletes what no kept version names and what has lain unchanged for ``age_s``: files of dead writers and of old versions. The names deleted."""
    files, known = Files(spark, path), versions(spark, path)
    named = {p.split("/")[1] for v in known[-keep:] for p in commit_of(spark, path, v)["cells"].values()}
    gone = [f"data/{n}" for n in files.names("data") if n not in named and files.age_s(f"data/{n}") >= age_s]
    gone += [f"commits/{v:08d}.json" for v in known[:-keep]]
    gone += [f"commits/{n}" for n in files.names("commits") if not n.endswith(".json") and files.age_s(f"commits/{n}") >= age_s]
    for n in gone:
        files.delete(n)
    return gone


def export_rules(profile: DataFrame, prefix: str = "learned") -> str:
    """Rules (JSON, as ``sources.rule_files`` reads) that tell of what a learned profile doesn't hold. profile: one row, sets by name:
    syscalls, ports, ips, paths, comms; a name without values makes no rule. A profile of more than LISTED values is refused."""
    kinds = {"syscalls": ("syscall", "nr"), "ports": ("network", "dport"), "ips": ("network", "daddr"), "paths": ("file", "filename"), "comms": ("syscall", "comm")}
    row = bounded(profile, list(kinds))
    rules = []
    for name, (kind, field) in kinds.items():
        if values := sorted(map(str, row.get(name) or ())):
            rules.append({"id": f"{prefix}_{name}", "name": f"Unlearned {name}", "event_type": kind, "severity": "warning", "action": "alert", "class": "drift", "condition": {"field": field, "op": "not_in", "values": values}})
    return json.dumps({"rules": rules}, indent=1)


def bounded(profile: DataFrame, names: list[str]) -> dict:
    """The sets of a profile's row, refused beyond LISTED values before any reaches the driver."""
    own = [n for n in names if n in profile.columns]
    sizes = profile.limit(1).select(*[F.size(n).alias(n) for n in own]).first() if own else None
    if sizes and sum(max(0, x or 0) for x in sizes) > LISTED:
        raise ValueError(f"a profile of more than {LISTED} values makes no file")
    row = profile.select(*own).first() if own else None
    return row.asDict() if row else {}


def rule_rows(profile: DataFrame, keys: list[str], sets: dict[str, tuple[str, str]], prefix: str = "learned") -> DataFrame:
    """``export_rules`` for many workloads at once, without the driver: (keys, rule), a rule's JSON for each workload and set that isn't empty.
    sets: event type and field by column."""
    made = [
        F.when(F.size(c) > 0, F.to_json(F.struct(
            F.concat_ws("_", F.lit(prefix), *[F.col(k).cast("string") for k in keys], F.lit(c)).alias("id"), F.lit(f"Unlearned {c}").alias("name"), F.lit(kind).alias("event_type"), F.lit("warning").alias("severity"),
            F.lit("alert").alias("action"), F.lit("drift").alias("class"),
            F.struct(F.lit(field).alias("field"), F.lit("not_in").alias("op"), F.array_sort(F.transform(c, lambda v: v.cast("string"))).alias("values")).alias("condition"),
        )))
        for c, (kind, field) in sets.items()
    ]
    return profile.select(*keys, F.explode(F.array_compact(F.array(*made))).alias("rule"))


def export_seccomp(profile: DataFrame, names: dict[int, str] | None = None) -> str:
    """An allow list of the learned syscalls; what isn't on it fails. names: of numbers, which stay numbers without one. Bounded as ``export_rules``."""
    numbers = sorted(int(x) for x in bounded(profile, ["syscalls"]).get("syscalls") or ())
    allowed = [(names or {}).get(n, str(n)) for n in numbers]
    return json.dumps({"defaultAction": "SCMP_ACT_ERRNO", "syscalls": [{"names": allowed, "action": "SCMP_ACT_ALLOW"}]}, indent=1)
