"""Which snapshots a retention policy keeps.

Every cutoff is a midnight, so snapshots are first reduced to the latest one for each group and first
midnight that they satisfy: a map-side maximum. The as-of join then runs over days, not snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = {"days": 7, "weeks": 4, "months": 4, "years": 1}
#: A snapshot stays if it is younger, compared with the last one, than so many seconds.
RECENT = 86_400


def _cutoffs(rule: str, day: Column, n: int) -> Column:
    """The rule's midnights, as dates: from the start of the day, week (Sunday), month or year of the last snapshot, going back."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    return {
        "days": lambda: F.transform(steps, lambda k: F.date_sub(day, k)),
        "weeks": lambda: F.transform(steps, lambda k: F.date_sub(day, F.dayofweek(day) - 1 + 7 * k)),
        "months": lambda: F.transform(steps, lambda k: F.add_months(F.trunc(day, "MM"), -k)),
        "years": lambda: F.transform(steps, lambda k: F.add_months(F.trunc(day, "YEAR"), -12 * k)),
    }[rule]()


def cutoffs(snapshots: DataFrame, by: list[str], rules: dict[str, int]) -> DataFrame:
    """(by, rule, cutoff); the last snapshot counts even without a filter."""
    last = snapshots.groupBy(*by).agg(F.to_date(F.max("ts")).alias("day"))

    def named(rule: str, n: int) -> Column:
        return F.transform(_cutoffs(rule, F.col("day"), n), lambda c: F.struct(F.lit(rule).alias("rule"), c.alias("cutoff")))

    each = [named(rule, n) for rule, n in rules.items() if n > 0]
    if not each:
        return last.select(*by, F.lit("").alias("rule"), F.col("day").alias("cutoff")).limit(0)
    return last.select(*by, F.explode(F.concat(*each)).alias("c")).select(*by, "c.rule", "c.cutoff")


def picks(snapshots: DataFrame, by: list[str], rules: dict[str, int] | None = None) -> DataFrame:
    """(by, rule, cutoff, id, ts): for each cutoff the latest snapshot at or before it; of equal times the first argument wins.

    snapshots: by, id, ts, argpos, has_bloom. Those without a filter are never picked.
    """
    day = F.to_date("ts")
    first_midnight = F.when(F.col("ts") == day.cast("timestamp_ntz"), day).otherwise(F.date_add(day, 1))
    best = F.max(F.struct("ts", (-F.col("argpos")).alias("earliest"), "id")).alias("best")
    daily = snapshots.where("has_bloom").groupBy(*by, first_midnight.alias("midnight")).agg(best)
    wanted = cutoffs(snapshots, by, RULES if rules is None else rules)
    near = wanted.join(daily.withColumnsRenamed({c: f"_{c}" for c in by}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("midnight") <= F.col("cutoff")])
    return near.groupBy(*by, "rule", "cutoff").agg(F.max("best").alias("best")).select(*by, "rule", "cutoff", "best.id", "best.ts")


def recent(snapshots: DataFrame, by: list[str], seconds: int = RECENT) -> DataFrame:
    """ids of snapshots strictly younger than `seconds` before the last of their group."""
    last = snapshots.groupBy(*by).agg(F.max("ts").alias("_last")).withColumnsRenamed({c: f"_{c}" for c in by})
    joined = snapshots.where("has_bloom").join(last, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] or F.lit(True))
    return joined.where(F.col("ts") > F.col("_last") - F.expr(f"INTERVAL {seconds} SECOND")).select("id")


def kept(snapshots: DataFrame, by: list[str], rules: dict[str, int] | None = None) -> DataFrame:
    return picks(snapshots, by, rules).select("id").union(recent(snapshots, by)).distinct()


def culled(snapshots: DataFrame, by: list[str], rules: dict[str, int] | None = None) -> DataFrame:
    """The snapshots to delete."""
    return snapshots.join(kept(snapshots, by, rules), "id", "left_anti")
