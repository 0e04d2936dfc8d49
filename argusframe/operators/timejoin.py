"""Joins and scans along time: the last row before each row, ancestors through reused process numbers, live intervals, token buckets, safe cuts.

None of them pairs rows up: two sides are laid into one sorted run of each key, and keys are cut in time where the definition allows it, so
that one key that holds a third of all rows is many tasks' work. Null keys match nothing. Rows without a time have no place in time: they get no
match, and limits let them pass.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def last_before(left: DataFrame, right: DataFrame, left_on: str, right_on: str, take: dict[str, str], ts: str = "ts", right_ts: str = "ts", within_s: float | None = None, strict: bool = False, tie: str = "event_id") -> DataFrame:
    """As-of join: ``left`` with the columns ``take`` (new name: name in right) of the right row of its key that came last, at or before
    (strict: before) its time and at most within_s before; of equal times the one with the greatest values. One exchange. With within_s
    a key's run is cut into pieces of that length, each right row standing in its own piece and the next."""
    held = F.struct(micros(right_ts).alias("__t"), *[F.col(c).alias(n) for n, c in take.items()])
    ours = left.select("*", F.col(left_on).alias("__key"), micros(ts).alias("__at"), F.lit(1).alias("__side"))
    theirs = right.where(F.col(right_on).isNotNull() & F.col(right_ts).isNotNull()).select(F.col(right_on).alias("__key"), micros(right_ts).alias("__at"), F.lit(2 if strict else 0).alias("__side"), held.alias("__held"))
    cut = ["__key"]
    if within_s is not None:
        width = max(1, int(within_s * 1e6))
        piece = F.floor(F.col("__at") / width)
        ours = ours.withColumn("__piece", piece)
        theirs = theirs.withColumn("__piece", F.explode(F.array(piece, piece + 1)))
        cut.append("__piece")
    else:  # null keys are dealt out, as nothing matches them
        ours = ours.withColumn("__piece", F.when(F.col("__key").isNull(), F.pmod(F.xxhash64(tie), F.lit(1024))))
        theirs = theirs.withColumn("__piece", F.lit(None).cast("bigint"))
        cut.append("__piece")
    both = ours.unionByName(theirs, allowMissingColumns=True)
    run = Window.partitionBy(*cut).orderBy("__at", "__side", "__held").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__last", F.last("__held", ignorenulls=True).over(run)).where("__side = 1")
    fits = F.col("__key").isNotNull() & F.col("__at").isNotNull()
    if within_s is not None:
        fits = fits & (F.col("__at") - F.col("__last.__t") <= int(within_s * 1e6))
    plain = [c for c in left.columns if c not in take]
    return found.select(*plain, *[F.when(fits, F.col("__last")[n]).alias(n) for n in take])


def with_trace(alerts: DataFrame, contexts: DataFrame, within_s: float = 30.0, tie: str = "event_id") -> DataFrame:
    """Alerts with trace_id and span_id of the last trace context (pid, ts, trace_id, span_id) that their process showed within_s before; an id that an
    alert has already stays."""
    own = [c for c in ("trace_id", "span_id") if c in alerts.columns]
    found = last_before(alerts, contexts, "pid", "pid", {f"__{c}": c for c in ("trace_id", "span_id")}, within_s=within_s, tie=tie)
    return found.select(*[c for c in alerts.columns if c not in own], *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")).alias(c) if c in own else F.col(f"__{c}").alias(c) for c in ("trace_id", "span_id")])


def parents_in_time(processes: DataFrame) -> DataFrame:
    """(pid, start, parent_pid, parent_start): a process number stands for the process that started last under it, so a parent is the one that
    had its number when the child started; null where none is known. processes: (pid, start, ppid), repeated rows count once."""
    rows = processes.select("pid", "start", "ppid").where("pid is not null and start is not null").groupBy("pid", "start").agg(F.min("ppid").alias("ppid"))
    asks = rows.where("ppid is not null and ppid <> pid").select("pid", "start", F.col("ppid").alias("__of"))
    found = last_before(asks, rows.select("pid", "start"), "__of", "pid", {"parent_start": "start"}, ts="start", right_ts="start", tie="pid")
    found = found.where("parent_start is not null").select("pid", "start", F.col("__of").alias("parent_pid"), "parent_start")
    return rows.select("pid", "start").join(found, ["pid", "start"], "left")


def ancestry_in_time(processes: DataFrame, depth: int = 10) -> DataFrame:
    """(pid, start, ancestor, ancestor_start, level) up to ``depth`` levels above each process, by pointer doubling: each join puts the list
    of the last known ancestor behind the own list, so log2(depth) joins do. A cycle (of processes that start at one time) ends where a process comes again."""
    me = F.struct("pid", "start")
    up = parents_in_time(processes).select(me.alias("p"), F.when(F.col("parent_start").isNotNull(), F.struct(F.col("parent_pid").alias("pid"), F.col("parent_start").alias("start"))).alias("q"))
    lists = up.select("p", F.array_compact(F.array("q")).alias("a"))
    reach = 1
    while reach < depth:
        more = lists.select(F.col("p").alias("__p"), F.col("a").alias("__a"))
        full = F.when(F.size("a") == reach, F.get("a", F.lit(reach - 1)))
        joined = lists.withColumn("__p0", full).join(more, F.col("__p0") == F.col("__p"), "left")
        lists = joined.select("p", F.concat("a", F.coalesce("__a", F.filter("a", lambda x: F.lit(False)))).alias("a"))
        reach *= 2
    seen = F.transform("a", lambda x, i: F.struct(x["pid"].alias("pid"), x["start"].alias("start"), (i + 1).alias("level")))
    rows = lists.select("p", "a", F.explode(F.slice(seen, 1, depth)).alias("x"))
    place = F.struct(F.col("x.pid"), F.col("x.start"))
    fresh = (place != F.col("p")) & (F.array_position("a", place) == F.col("x.level"))
    cut = ~F.exists(F.slice("a", F.lit(1), F.col("x.level")), lambda x: x == F.col("p"))
    return rows.where(fresh & cut).select("p.pid", "p.start", F.col("x.pid").alias("ancestor"), F.col("x.start").alias("ancestor_start"), "x.level")


def live_least(events: DataFrame, spans: DataFrame, key: str, value: str, ts: str = "ts", piece_s: int = 3600, tie: str = "event_id") -> DataFrame:
    """``events`` with the least value of the spans (key, starts_at, expires_at, value) of their key that are live at their time, null without
    any: one sort of starts and events and a walk that holds the live spans, not a join of pairs. Spans are cut at pieces of time; each piece of a key is walked on its own."""
    width = piece_s * 1_000_000
    piece = lambda c: F.floor(c / width)
    cut = spans.where(F.col(key).isNotNull() & F.col(value).isNotNull() & (F.col("starts_at") < F.col("expires_at"))).select(
        F.col(key).alias("__key"), micros("starts_at").alias("__a"), micros("expires_at").alias("__z"), F.col(value).cast("double").alias("__v")
    )
    cut = cut.withColumn("__piece", F.explode(F.sequence(piece(F.col("__a")), piece(F.col("__z") - 1))))
    cut = cut.select("__key", "__piece", F.greatest("__a", F.col("__piece") * width).alias("__at"), F.lit(0).alias("__side"), "__z", "__v")
    asks = events.select(F.col(key).alias("__key"), piece(micros(ts)).alias("__piece"), micros(ts).alias("__at"), F.lit(1).alias("__side"), F.col(tie)).where("__key is not null and __at is not null")
    both = cut.unionByName(asks, allowMissingColumns=True).repartition("__key", "__piece").sortWithinPartitions("__key", "__piece", "__at", "__side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, live = None, []  # (value, end); spans over are taken off when they come to the top
        for pdf in batches:
            ids, least = [], []
            for k, p, at, side, z, v, id in zip(pdf["__key"], pdf["__piece"], pdf["__at"], pdf["__side"], pdf["__z"], pdf["__v"], pdf[tie], strict=True):
                if (k, p) != current:
                    current, live = (k, p), []
                if side == 0:
                    heapq.heappush(live, (v, z))
                    continue
                while live and live[0][1] <= at:
                    heapq.heappop(live)
                if live:
                    ids.append(id)
                    least.append(live[0][0])
            yield pd.DataFrame({tie: ids, "__least": least})

    found = both.mapInPandas(run, f"`{tie}` {dict(events.dtypes)[tie]}, __least double").groupBy(tie).agg(F.min("__least").alias("__least"))
    return events.join(found, tie, "left").withColumnRenamed("__least", value)


def not_seen_elsewhere(alerts: DataFrame, seen: DataFrame, ttl_s: int = 300, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Alerts (fingerprint, node) whose fingerprint no other node told of in the last ttl_s seconds; seen: (fingerprint, node, at). In time, the
    last sights of the two nodes seen last tell it: of a key's run each row carries the last sight, and the last one by another node than that."""
    width = ttl_s * 1_000_000
    piece = F.floor(F.col("__at") / width)
    ours = alerts.select("*", micros(ts).alias("__at"), F.lit(1).alias("__side")).withColumn("__piece", piece)
    s = seen.where("fingerprint is not null and node is not null and at is not null").select("fingerprint", F.col("node").alias("__node"), micros("at").alias("__at"), F.lit(0).alias("__side")).withColumn("__piece", piece)
    s = s.groupBy("fingerprint", "__node", "__at", "__side", "__piece").count().drop("count").withColumn("__piece", F.explode(F.array("__piece", F.col("__piece") + 1)))
    both = ours.unionByName(s, allowMissingColumns=True)
    order = Window.partitionBy("fingerprint", "__piece").orderBy("__at", "__side", "__node")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sight = F.when(F.col("__side") == 0, F.struct(F.col("__at").alias("t"), F.col("__node").alias("n")))
    rows = both.withColumn("__s", sight).withColumn("__one", F.last("__s", ignorenulls=True).over(run))
    # where the node changes, the sight before the change is the last one of another node
    before = F.lag("__one").over(order)
    rows = rows.withColumn("__turn", F.when(F.col("__s").isNotNull() & (before["n"] != F.col("__node")), before))
    rows = rows.withColumn("__two", F.last("__turn", ignorenulls=True).over(run)).where("__side = 1")
    late = lambda c: F.coalesce(F.col("__at") - F.col(c)["t"] <= width, F.lit(False)) & F.coalesce(F.col(c)["n"] != F.col("node"), F.lit(False))
    told = late("__one") | late("__two")
    return rows.where(~told | F.col("fingerprint").isNull()).select(*alerts.columns)


def pieces(rows: DataFrame, keys: list[str], gap_s: float, at: str = "__s") -> DataFrame:
    """``rows`` with __piece: runs of a key's rows between which more than ``gap_s`` seconds pass. Found on the seconds-wide slots of gap_s that have rows,
    of which a key has few, so that no key's rows are sorted in one task. Neighbouring slots with rows stay in one piece; rows without a time are a piece of their own."""
    slot = F.floor(F.col(at) / max(gap_s, 1e-6))
    rows = rows.withColumn("__slot", slot)
    names = [f"__k{i}" for i in range(len(keys))]
    slots = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("__slot").alias("__slot2")).count().drop("count")
    w = Window.partitionBy(*names).orderBy("__slot2")
    starts = F.coalesce((F.col("__slot2") - F.lag("__slot2").over(w) > 1).cast("int"), F.lit(1))
    slots = slots.withColumn("__new", starts).withColumn("__piece", F.sum("__new").over(w)).drop("__new")
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)] + [F.col("__slot").eqNullSafe(F.col("__slot2"))]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return rows.join(slots, on, "left").drop(*names, "__slot", "__slot2")


def token_bucket(alerts: DataFrame, rate: float, burst: float, keys: list[str] | None = None, piece_s: float = 3600, tie: str = "event_id") -> DataFrame:
    """Alerts that a token bucket lets pass: it holds ``burst`` tokens at first and at most, gets ``rate`` a second, and an alert takes one or is left
    out. What is left in one second is there in the next.

    Refills are functions y -> min(burst, y + a), which combine in any grouping; so, as if all alerts took a token, the bucket's level at every
    alert is a running least value, found by pieces of time and then over the pieces. Where it would be full it is full in truth: the run before has no say
    any more. Runs that never lack a token pass whole; only runs that do are walked, each on its own."""
    keys = keys or []
    rows = alerts.withColumn("__t", micros("ts") / 1e6)
    timed = rows.where("__t is not null").withColumn("__p", F.floor(F.col("__t") / piece_s))
    inside = Window.partitionBy(*keys, "__p").orderBy("__t", tie)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = timed.withColumn("__i", F.row_number().over(inside)).withColumn("__low", F.min(F.col("__i") - rate * F.col("__t")).over(upto))
    sums = timed.groupBy(*keys, "__p").agg(F.max("__i").alias("__n"), F.min("__low").alias("__least"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    sums = sums.withColumn("__past", F.min(F.col("__least") + F.col("__base")).over(before)).select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__p").alias("__q"), "__base", "__past")
    on = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    timed = timed.join(sums, on).drop("__q", *[f"__key{i}" for i in range(len(keys))])
    place = F.col("__i") + F.col("__base")
    own = F.col("__i") - rate * F.col("__t") + F.col("__base")
    # tokens that are there when the alert comes, had all before it taken one; full where it is the least of all up to it
    level = burst + rate * F.col("__t") - place + F.least(F.coalesce("__past", own), F.col("__low") + F.col("__base"))
    timed = timed.withColumns({"__full": (level >= burst).cast("int"), "__level": level, "__place": place})
    timed = timed.withColumn("__inner", F.sum("__full").over(upto))
    runs = timed.groupBy(*keys, "__p").agg(F.sum("__full").alias("__m"))
    runs = runs.withColumn("__runs", F.coalesce(F.sum("__m").over(before), F.lit(0))).select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__p").alias("__q"), "__runs")
    timed = timed.join(runs, on).withColumn("__run", F.col("__inner") + F.col("__runs")).drop("__q", *[f"__key{i}" for i in range(len(keys))])
    short = timed.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__run").alias("__r")).agg(F.min("__level").alias("__worst")).where("__worst < 1")
    on = F.col("__run") == F.col("__r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    passed = timed.join(short, on, "left_anti").select(*alerts.columns)
    walked = timed.join(short, on, "left_semi").select(*alerts.columns, "__t", "__run", *[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)])
    groups, names = ["__run", *[f"__key{i}" for i in range(len(keys))]], alerts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .behaviour import same

        current, tokens, last = None, 0.0, 0.0
        for pdf in batches:
            out = []
            for g, t in zip(zip(*[pdf[c] for c in groups], strict=True), pdf["__t"], strict=True):
                if not same(g, current):
                    current, tokens, last = g, burst, t
                tokens, last = min(burst, tokens + rate * (t - last)), t
                out.append(tokens >= 1)
                tokens -= tokens >= 1
            yield pdf[out][names]

    walked = walked.repartition(*groups).sortWithinPartitions(*groups, "__t", tie).mapInPandas(run, alerts.schema)
    return passed.unionByName(walked).unionByName(rows.where("__t is null").select(*alerts.columns))
