"""An inverted index over rules: which rules an event has to be tested against, found by looking its values up.

A rule that can only match where a field has one of some values, or begins or ends with one of some texts, has these as its keys. Keys become rows
(event type, value) -> rule numbers, one small table for each slot: a field whole, or its first or last n characters. Each event looks its values up
in the slots by hash joins; only the rules that are hit are tested further, and those that say no more than their keys aren't tested at all. Rules
without keys (ranges, patterns, negations alone) are tested against every event of their type, as before.

Rules are objects of the driver, so the tables are bounded by the rule set and broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as ru

#: A key: field, form ("is", "prefix", "suffix"), characters (0 for "is"), value.
Key = tuple[str, str, int, str]
#: Slots an event type looks up in, at most; rules that would need more are tested as ones without keys.
MOST_SLOTS = 24


def leaf_keys(c: ru.Condition) -> list[Key] | None:
    """The keys of one condition, None if it has none."""
    op, values = ru.ALIASES.get(c.op.lower(), c.op.lower()), list(map(str, c.values))
    if op == "equals":
        return [(c.field, "is", 0, v) for v in values[:1]]
    if op == "in":
        return [(c.field, "is", 0, v) for v in values if v]
    if op in ("prefix", "suffix") and all(values):
        return [(c.field, op, len(v), v) for v in values]
    return None


def keys_of(when: ru.Condition | ru.Group) -> list[Key] | None:
    """Keys one of which an event must have for the test to hold: of all parts that must hold the ones with the fewest, of alternatives all."""
    if isinstance(when, ru.Condition):
        return leaf_keys(when)
    parts = [keys_of(x) for x in (*when.conditions, *when.groups)]
    if when.operator.lower() == "or":
        return sum(parts, []) if parts and all(p is not None for p in parts) else None
    return min((p for p in parts if p is not None), key=lambda p: (sum(k[1] != "is" for k in p), len(p)), default=None)


def says_no_more(rule: ru.Rule) -> bool:
    """Whether having a key is all that the rule asks."""
    return isinstance(rule.when, ru.Condition) and not rule.exceptions and rule.rate >= 1


class Index:
    """The keys of the rules of each event type, by slot."""

    def __init__(self, rules: list[ru.Rule], known: Callable[[str, str], bool]):
        self.slots: dict[tuple[str, str, int], dict[tuple[str, str], list[int]]] = defaultdict(lambda: defaultdict(list))
        self.untested: set[int] = set()
        self.keyless: list[int] = []
        used: dict[str, set[tuple[str, str, int]]] = defaultdict(set)
        for i, r in enumerate(rules):
            keys = keys_of(r.when)
            if keys is None or not all(known(r.event_type, k[0]) for k in keys) or len(used[r.event_type] | {k[:3] for k in keys}) > MOST_SLOTS:
                self.keyless.append(i)
                continue
            used[r.event_type] |= {k[:3] for k in keys}
            if says_no_more(r):
                self.untested.add(i)
            for key in set(keys):
                self.slots[key[:3]][r.event_type, key[3]].append(i)


def slot_value(text: str, form: str, n: int) -> Column:
    """What of a text column is looked up; shorter texts than ``n`` have no such part."""
    if form == "is":
        return F.col(text)
    return F.when(F.char_length(text) >= n, F.left(F.col(text), F.lit(n)) if form == "prefix" else F.right(F.col(text), F.lit(n)))


def look_up(rows: DataFrame, index: Index, type_col: str, text: Callable[[str, str], str]) -> tuple[DataFrame, list[Column]]:
    """``rows`` with the numbers of the rules that each slot hits; text: the column of a field of an event type."""
    found = []
    for at, ((field, form, n), entries) in enumerate(sorted(index.slots.items())):
        kinds = sorted({kind for kind, _ in entries})
        value = F.coalesce(*[F.when(F.col(type_col) == kind, slot_value(text(kind, field), form, n)) for kind in kinds])
        names = [f"__kind{at}", f"__value{at}", f"__hits{at}"]
        table = rows.sparkSession.createDataFrame([(kind, v, sorted(hits)) for (kind, v), hits in entries.items()], f"`{names[0]}` string, `{names[1]}` string, `{names[2]}` array<int>")
        rows = rows.withColumn(f"__slot{at}", value)
        rows = rows.join(F.broadcast(table), (F.col(type_col) == F.col(names[0])) & (F.col(f"__slot{at}") == F.col(names[1])), "left").drop(*names[:2], f"__slot{at}")
        found.append(F.col(names[2]))
    return rows, found


def by_number(tests: Mapping[int, str], column: str, width: int = 24) -> str:
    """SQL: the test of the rule whose number the column holds; two levels, so that few numbers are compared."""
    numbers = sorted(tests)
    if not numbers:
        return "true"
    arms = []
    for a in range(0, len(numbers), width):
        own = numbers[a : a + width]
        arms.append(f"WHEN {column} <= {own[-1]} THEN CASE {column} {' '.join(f'WHEN {i} THEN {tests[i]}' for i in own)} ELSE false END")
    return f"CASE {' '.join(arms)} ELSE false END"
