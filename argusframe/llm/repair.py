"""Repair of damaged conversations at the least cost, in DataFrame operations only.

A conversation is right when the initials of its roles read ``(s?(ua)+)?``. Windows flag each row's fault (blank, duplicate, truncated)
and the neighbours whose roles don't follow each other; the turns are collected in order, and one fold over them carries, for each of
the pattern's four states (nothing yet, after system, after user, after assistant), the cheapest edits so far as a struct of cost and
plan. The least struct wins, so equal costs go to the least plan. A plan has one letter an edit (PLAN); its letters are in the order of the
audit's letters, which tell less, and two plans of one audit can't both lead to one state, so the least plan is the least audit.

Rows are taken by turn (nulls first), equal turns by role and text. A null role or text is one space, as is a null in the text that damage is
drawn from. Rows with a null conv_id are one conversation. Repeated rows are rows of their own: the later ones are duplicates. A conversation of
which no row is left has zeros and an empty audit. Other columns than (conv_id, turn, role, text) are not read. One row holds a whole
conversation, as its digest needs; rows are shuffled once, by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A row's first fault; blank and duplicate rows have to go.
BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", "sound"
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
#: Letters of a plan: delete, insert user, insert assistant, keep, make user, make assistant; and what the audit calls them.
PLAN, AUDIT = "DIJKRS", "DIIKRR"
#: The cost of a state that can't be reached.
NEVER = 1 << 40
WHITE = r"[\x20\x09-\x0D]"
ROWS = ("conv_id", "turn", "role", "text")


def clean_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with one space for a null role or text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` with crc32('conv_id:turn') % 20 deciding: 0 drops (dropped is set, role and text are null), 1 empties the text, 2 removes its
    end marks, 3 repeats the row, 4 makes it the user's."""
    rows, space = clean_rows(rows), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.col("__fault")
    rows = rows.withColumn("__fault", F.pmod(F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")), F.lit(20)))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": F.when(fault != 0, text), "role": F.when(fault != 0, F.when(fault == 4, "user").otherwise(F.col("role"))), "dropped": fault == 0})
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", copies).drop("__fault")


def flagged(rows: DataFrame) -> DataFrame:
    """``rows`` of (conv_id, turn, role, text, copy, dropped) with fault and illegal (its role can't follow the row before)."""
    order = Window.partitionBy("conv_id").orderBy("dropped", F.asc_nulls_first("turn"), "role", "text", "copy")
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"), "copy")
    initial = F.substring("role", 1, 1)
    rows = rows.withColumn("__before", F.lag(initial).over(order)).withColumn("__nth", F.row_number().over(same))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("__nth") > 1, DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?]" + WHITE + r"*+\z"), TRUNCATED).otherwise(SOUND)
    )
    illegal = F.col("__before").isNotNull() & ~F.concat("__before", initial).isin("su", "ua", "au")
    return rows.withColumns({"fault": fault, "illegal": ~F.col("dropped") & illegal}).drop("__before", "__nth")


def _plus(state: Column, cost: Column | int, letter: str) -> Column:
    return F.struct((state["cost"] + cost).cast("long").alias("cost"), F.concat(state["plan"], F.lit(letter)).alias("plan"))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _states(*states: Column) -> Column:
    return F.struct(*[s.alias(f"s{i}") for i, s in enumerate(states)])


def _inserted(at: Column) -> Column:
    """The four states after as many inserted turns as help."""
    user = F.least(at["s2"], *[_plus(at[s], INSERT_COST, "I") for s in ("s0", "s1", "s3")])
    return _states(at["s0"], at["s1"], user, F.least(at["s3"], _plus(user, INSERT_COST, "J")))


def _edited(at: Column, row: Column) -> Column:
    """The four states after one row was deleted, kept or given another role."""
    never = F.struct(F.lit(NEVER).cast("long").alias("cost"), F.lit("").alias("plan"))
    stays = ~row["fault"].isin(BLANK, DUPLICATE)
    late = F.when(row["fault"] == TRUNCATED, TRUNCATED_COST).otherwise(0)
    initial = F.substring(row["role"], 1, 1)
    gone = [_plus(at[f"s{i}"], DELETE_COST, "D") for i in range(4)]
    keep = lambda state, letter: F.when(stays & (initial == letter), _plus(state, late + KEEP_COST, "K")).otherwise(never)
    turn = lambda state, letter: F.when(stays, _plus(state, late + REROLE_COST, letter)).otherwise(never)

    def of(before_user: Column) -> Column:
        return _states(
            gone[0], F.least(gone[1], keep(at["s0"], "s")), F.least(gone[2], keep(before_user, "u"), turn(before_user, "R")),
            F.least(gone[3], keep(at["s2"], "a"), turn(at["s2"], "S")),
        )

    return _let(F.least(at["s0"], at["s1"], at["s3"]), of)


def cheapest(turns: Column) -> Column:
    """The struct (cost, plan) of the cheapest edits that make the turns right."""
    start = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("plan"))
    never = F.struct(F.lit(NEVER).cast("long").alias("cost"), F.lit("").alias("plan"))
    step = lambda at, row: _let(_inserted(at), lambda ready: _edited(ready, row))
    return F.aggregate(turns, _states(start, never, never, never), step, lambda at: _let(_inserted(at), lambda end: F.least(end["s0"], end["s3"])))


def repaired_turns(turns: Column, plan: Column) -> Column:
    """The (role, text) structs that the plan leaves and adds, in order."""
    steps = F.regexp_extract_all(plan, F.lit("[IJ]*[DKRS]|[IJ]+$"), F.lit(0))
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))

    def lines(row: Column, step: Column) -> Column:
        letters = F.filter(F.split(step, ""), lambda c: c.isin(*"IJKRS"))
        role = lambda c: F.when(c.isin("I", "R"), "user").when(c.isin("J", "S"), "assistant").otherwise(row["role"])
        return F.transform(letters, lambda c: turn(role(c), F.when(c.isin("I", "J"), "").otherwise(row["text"])))

    return F.flatten(F.zip_with(turns, steps, lines))


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation of damaged ``rows`` (conv_id, turn, role, text, copy, dropped): gaps, how many rows have each fault, illegal
    neighbours, cost, audit, and turns, the repaired (role, text) in order."""
    row = F.struct("turn", "role", "text", "copy", "fault", "illegal")
    found = flagged(rows).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(~F.col("dropped"), row))).alias("t"))
    found = found.withColumn("best", cheapest(F.col("t")))
    numbers = F.array_distinct(F.filter(F.transform("t", lambda x: x["turn"]), lambda n: n.isNotNull()))
    count = lambda test: F.size(F.filter("t", test)).cast("long")
    has = lambda fault: lambda x: x["fault"] == fault
    return found.withColumn("n", numbers).select(
        "conv_id", F.coalesce(F.array_max("n") - F.array_min("n") + 1 - F.size("n"), F.lit(0)).cast("long").alias("gaps"),
        *[count(has(f)).alias(f) for f in (BLANK, DUPLICATE, TRUNCATED)],
        count(lambda x: x["illegal"]).alias("illegal"), F.col("best.cost").alias("cost"), F.translate("best.plan", PLAN, AUDIT).alias("audit"),
        repaired_turns(F.col("t"), F.col("best.plan")).alias("turns"),
    )
