"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.joins import lookup_join


def orphan_references(children: DataFrame, parents: DataFrame, table_name: str, key: Column, referrer: Column, at: Column, parent_key: Column, parent_from: Column, parent_until: Column) -> DataFrame:
    """Rows of `children` whose key leads to no parent at the end of their month.

    Gives table_name, missing_key, referring_key, period and rows (how many child rows say the
    same). A parent is there at a month's end if it came before the month's end and was not removed
    before it; a parent that never says when it came is never there. A null key is no reference;
    a row whose own time is null has no month and is no case. An empty parent table makes every
    reference an orphan.

    The anti-join sees only the distinct keys of each month, which partial aggregation makes on the
    map side, so a key that a third of the rows hold costs one row. Those orphan keys are then
    joined back to the rows.
    """
    refs = children.select(key.alias("missing_key"), referrer.alias("referring_key"), F.trunc(at.cast("timestamp_ntz"), "month").alias("month")).where("missing_key is not null and month is not null")
    keys = refs.select("missing_key", "month").distinct()
    living = parents.select(parent_key.alias("parent_key"), parent_from.cast("timestamp_ntz").alias("came"), parent_until.cast("timestamp_ntz").alias("gone")).where("parent_key is not null and came is not null").distinct()
    month_end = F.add_months("month", 1).cast("timestamp_ntz")
    orphans = keys.join(living, (F.col("missing_key") == F.col("parent_key")) & (F.col("came") < month_end) & (F.col("gone").isNull() | (F.col("gone") >= month_end)), "left_anti")
    back = lookup_join(refs, orphans, ["missing_key", "month"], salt_on=["referring_key"])
    return back.groupBy("missing_key", "referring_key", "month").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(table_name).alias("table_name"), "missing_key", "referring_key", F.date_format("month", "yyyy-MM").alias("period"), "rows"
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table and period: table_name, period, missing_keys, referring_rows."""
    return orphans.groupBy("table_name", "period").agg(F.countDistinct("missing_key").alias("missing_keys"), F.sum("rows").cast("long").alias("referring_rows"))
