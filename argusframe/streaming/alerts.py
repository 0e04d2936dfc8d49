"""The batch operators on streams: rules, incidents with a watermark, and the coupled limiter with state."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import behaviour, rules


def is_marked(rows: DataFrame) -> bool:
    """Whether a stream has a watermark; it takes no second one."""
    return "EventTimeWatermark" in rows._jdf.queryExecution().analyzed().toString()


def stream_alerts(events: DataFrame, own: list[rules.Rule], fields: Mapping[str, Column], late: str = "10 minutes") -> DataFrame:
    """As in batch; the events' own watermark holds, or else one of ``late``."""
    return rules.evaluate(events if is_marked(events) else events.withWatermark("ts", late), own, fields)


def stream_incidents(alerts: DataFrame, keys: list[str], gap: str = "60 seconds") -> DataFrame:
    """As in batch; a session is emitted when the watermark has passed its end. alerts: with a watermark on ts."""
    if not alerts.isStreaming:
        return behaviour.incidents(alerts, keys, gap)
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    grouped = alerts.groupBy(*keys, F.session_window("ts", gap).alias("w"))  # distinct counts don't stream, sets do
    return grouped.agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"), F.max_by("severity", rank).alias("severity"), F.size(F.collect_set("rule_id")).cast("long").alias("n_rules")).drop("w")


def stream_limited(alerts: DataFrame, rule: str, keys: str | list[str], dedup_s: float = behaviour.DEDUP_S, rate: int = behaviour.RATE, rate_s: float = behaviour.RATE_S, tie: str = "event_id") -> DataFrame:
    """The coupled dedup and rate limit: a rule's state is the admitted alerts that can still matter. With a watermark on ts, rows behind it are
    left out and the state of a rule that is silent for longer than both windows goes; without one it stays."""
    schema, names, keys = alerts.schema, alerts.columns, [keys] if isinstance(keys, str) else keys
    keep_s, marked = max(rate_s, dedup_s), is_marked(alerts)

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at_held, key_held = state.get if state.exists else ([], [])
        limiter = behaviour.Limiter(dedup_s, rate, rate_s)
        for at, key in zip(at_held, key_held, strict=True):
            limiter.last[key] = at
            limiter.log.append(at)
        kept = list(zip(at_held, key_held, strict=True))
        new = pd.concat(list(batches)).sort_values(["ts", tie], kind="stable")
        admitted, at = [], 0.0
        for t, key in zip(new["ts"], [json.dumps(x) for x in new[keys].astype(str).values.tolist()], strict=True):
            at = t.value / 1e9
            ok = limiter.admit(at, key)
            if ok:
                kept.append((at, key))
            admitted.append(ok)
        kept = [(t, key) for t, key in kept if t >= at - keep_s]
        state.update(([t for t, _ in kept], [key for _, key in kept]))
        if marked:
            state.setTimeoutTimestamp(max(int((at + keep_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield new[admitted][names]

    timeout = GroupStateTimeout.EventTimeTimeout if marked else GroupStateTimeout.NoTimeout
    return alerts.groupBy(rule).applyInPandasWithState(run, schema, "at array<double>, key array<string>", "append", timeout)
