"""Joins against the small side of reference terms, whose size is looked at before it is sent anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Rows, and bytes of their values, up to which a side is broadcast; beyond, both sides are shuffled on the key.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def sized(rows: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """rows, marked for broadcast if they are few and small. Looks at limit + 1 of them at most."""
    values = sum((F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns), F.lit(0))
    n, total = rows.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(values), F.lit(0))).first()
    return F.broadcast(rows) if n <= limit and total <= size else rows


def first_up_to(rows: DataFrame, cap: int, *, whole: bool) -> DataFrame:
    """The first `cap` rows in the order of `place`; with `whole`, all rows of the input row (`seq`) that reaches the cap.

    A distributed top-n of at most cap rows, or input rows with all that they gave, never a global sort; rows is read once.
    """
    if not whole:
        return rows.orderBy("place").limit(cap)
    names = rows.columns
    inputs = rows.groupBy("seq").agg(F.collect_list(F.struct(*[c for c in names if c != "seq"])).alias("given")).orderBy("seq").limit(cap)
    # the first cap input rows at most, so one task is enough
    before = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inputs = inputs.withColumn("before", F.coalesce(F.sum(F.size("given")).over(before), F.lit(0))).where(F.col("before") < cap)
    return inputs.select("seq", F.inline("given")).select(*names)
