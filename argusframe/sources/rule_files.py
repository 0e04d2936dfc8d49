"""Rule files: YAML or JSON documents with a list of rules, read into ``operators.rules.Rule`` and checked as a whole before use."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import Condition, Group, Rule, problems
from . import events

ACTIONS, CLASSES, MODES = {"alert", "drop", "block", "kill", "throttle"}, {"", "threat", "drift"}, {"", "random", "hash_pid"}


class RuleErrors(ValueError):
    """All that is wrong with a rule set."""


def parsed(text: str) -> dict:
    """A JSON or YAML document; rule files are small and read on the driver."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def condition_of(x: dict) -> Condition:
    field = str(x.get("field", ""))
    return Condition(events.ALIASES.get(field, field), str(x.get("op", "")), tuple(str(v) if not isinstance(v, bool) else str(v).lower() for v in x.get("values") or ()))


def group_of(x: dict) -> Group:
    return Group(str(x.get("operator") or "and"), tuple(condition_of(c) for c in x.get("conditions") or ()), tuple(group_of(g) for g in x.get("subgroups") or ()))


def when_of(x: dict) -> Condition | Group:
    return group_of(x["condition_group"]) if x.get("condition_group") is not None else condition_of(x.get("condition") or {})


def rule_of(x: dict) -> Rule:
    sampling = x.get("sampling") or {}
    rate = float(sampling.get("rate") or x.get("sample_rate") or 1.0)
    return Rule(
        str(x.get("id") or ""), str(x.get("event_type") or ""), when_of(x), str(x.get("severity") or "warning"), str(x.get("action") or "alert"), str(x.get("name") or ""), tuple(when_of(e) for e in x.get("exceptions") or ()),
        str(x.get("description") or ""), tuple(map(str, x.get("tags") or ())), str(x.get("class") or ""), rate, str(sampling.get("mode") or "hash_pid"),
    )


def rule_problems(rules: list[Rule]) -> list[str]:
    out = problems(rules, events.known_fields())
    for r in rules:
        out += [f"{r.id}: {what} is required" for what, x in (("id", r.id), ("name", r.name)) if not x]
        out += [f"{r.id}: unknown {what} {x}" for what, x, known in (("action", r.action, ACTIONS), ("class", r.klass, CLASSES), ("sampling mode", r.sampling, MODES)) if x not in known]
        if not 0 < r.rate <= 1:
            out.append(f"{r.id}: sample rate {r.rate} isn't in (0, 1]")
    return out


def load_text(text: str, check: bool = True) -> list[Rule]:
    rules = [rule_of(x) for x in parsed(text).get("rules") or []]
    if check and (wrong := rule_problems(rules)):
        raise RuleErrors("; ".join(wrong))
    return rules


def load_files(folder: str, checksums: dict[str, str] | None = None) -> list[Rule]:
    """The rules of all .yaml, .yml and .json files of a folder, by name. checksums: SHA-256 by file name; a file that differs or isn't listed stops the load."""
    rules: list[Rule] = []
    for path in sorted(Path(folder).iterdir()):
        if path.suffix.lower() not in (".yaml", ".yml", ".json") or path.is_dir():
            continue
        data = path.read_bytes()
        if checksums is not None and checksums.get(path.name) != hashlib.sha256(data).hexdigest():
            raise RuleErrors(f"{path.name}: checksum differs or is missing")
        rules += load_text(data.decode(), check=False)
    if wrong := rule_problems(rules):
        raise RuleErrors("; ".join(wrong))
    return rules


def checksums_of(text: str) -> dict[str, str]:
    """Lines ``digest  name`` as a map by name."""
    rows = [line.split(None, 1) for line in text.splitlines() if line.strip() and not line.startswith("#")]
    return {name.strip().lstrip("*"): digest.lower() for digest, name in rows}


def verified(files: DataFrame, listed: DataFrame) -> DataFrame:
    """(name, verdict) of files (name, content) held against digests (name, digest): ok, changed or unlisted. A name listed twice is ok by either."""
    own = listed.groupBy("name").agg(F.collect_set(F.lower("digest")).alias("__d"))
    found = files.withColumn("__sha", F.sha2("content", 256)).join(own, "name", "left")
    return found.select("name", F.when(F.col("__d").isNull(), "unlisted").when(F.array_contains("__d", F.col("__sha")), "ok").otherwise("changed").alias("verdict"))


def load_overlay(text: str) -> dict[str, list]:
    """Exceptions by rule id, for ``operators.rules.overlay``."""
    return {str(o["rule_id"]): [when_of(e) for e in o.get("exceptions") or ()] for o in parsed(text).get("overlays") or []}
