"""Keeping a catalogue: constraints, upsert plans, snapshots, ledgers and state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def shared_between(rows: DataFrame, key: str, side: str) -> DataFrame:
    """Keys that occur on more than one side (a leak between splits)."""
    return rows.groupBy(key).agg(F.countDistinct(side).alias("sides")).where("sides > 1")


def diff(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """``action`` insert, update, delete or unchanged for every key of either side, by null-safe comparison."""
    o = old.select(*key, F.struct(*values).alias("o"))
    n = new.select(*key, F.struct(*values).alias("n"))
    action = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("update")
    return o.join(n, key, "full_outer").select(*key, action.alias("action"), "o", "n")


def upserted(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """The table after an upsert: new rows win, old ones that are not named stay."""
    d = diff(old, new, key, values)
    return d.select(*key, F.coalesce("n", "o").alias("x")).select(*key, *[F.col(f"x.{v}").alias(v) for v in values])


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side; none if the sets (with repeats) are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def chained(events: DataFrame, by: str, order: list[str], state: str) -> DataFrame:
    """Each event with its ordinal and the state before it."""
    w = Window.partitionBy(by).orderBy(*order)
    return events.withColumn("ordinal", F.row_number().over(w)).withColumn("before", F.lag(state).over(w))


def audited(events: DataFrame, by: str, order: list[str], state: str, allowed: list[tuple[str | None, str]]) -> DataFrame:
    """Events whose step from the state before isn't allowed (None: the first step)."""
    c = chained(events, by, order, state)
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | (F.col("before").eqNullSafe(F.lit(a)) & (F.col(state) == b))
    return c.where(~ok)


def event_hash(*columns: str) -> Column:
    """The hash by which a ledger's event is known."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def append_once(ledger: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """A ledger with the events of a batch that it lacks: replaying a batch changes nothing."""
    return ledger.unionByName(batch.dropDuplicates([key]).join(ledger.select(key), key, "left_anti"))
