"""Exact ranks near either end of an ordering, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(df: DataFrame, order: list[Column], k: int, rank: str, how=F.row_number) -> DataFrame:
    """First ``k`` rows of the ordering with their rank.

    ``orderBy.limit`` keeps k rows per task and then k in all, so the
    unpartitioned window only ever sees k rows. A rank depends on earlier rows
    alone, hence the ranks equal those over the whole input.
    """
    return df.orderBy(*order).limit(k).withColumn(rank, how().over(Window.orderBy(*order)).cast("long"))


def both_ends(
    df: DataFrame,
    value: str,
    key: str,
    k: int,
    from_top: str,
    from_bottom: str,
    other: str | None = None,
    other_rank: str = "other_rank",
) -> DataFrame:
    """Rows among the ``k`` highest or ``k`` lowest values, with both ranks, in one pass over ``df``.

    The low end orders by the reverse of the high end, so one rank follows from
    the other and the row count. A row at both ends appears once.

    Rows are dealt into buckets, one per shuffle partition; each bucket is sorted on its own
    and hands on k rows of either end and its row count. The last window sees
    these rows only: 2k for each bucket, however many rows there are.

    With ``other`` the picked rows also get their exact rank among all rows by
    that column, highest first, as ``other_rank``. The buckets then are ranges
    of that column and the key, so equal values are split as well, and the rank
    is the place in the range plus the counts of the ranges before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if other is None:
        dealt = df.withColumn("_bucket", F.pmod(F.hash(key), F.lit(n)))
    else:
        by_other = [F.desc(other), F.asc(key)]
        dealt = df.repartitionByRange(n, *by_other).withColumn("_bucket", F.spark_partition_id())
        dealt = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_bucket").orderBy(*by_other)))
    high = [F.desc(value), F.asc(key)]
    bucket = Window.partitionBy("_bucket")
    near = dealt.withColumns(
        {"_high": F.row_number().over(bucket.orderBy(*high)), "_rows": F.count(F.lit(1)).over(bucket)}
    ).where((F.col("_high") <= k) | (F.col("_rows") - F.col("_high") < k))

    # The first row of every bucket is kept and speaks for its count.
    count = F.when(F.col("_high") == 1, F.col("_rows"))
    everything = Window.partitionBy()
    low = F.count(F.lit(1)).over(everything) + 1 - F.col("_top")
    ranked = near.withColumns(
        {"_top": F.row_number().over(Window.orderBy(*high)).cast("long"), "_total": F.sum(count).over(everything)}
    )
    if other is not None:
        before = F.sum(count).over(Window.orderBy("_bucket").rangeBetween(Window.unboundedPreceding, -1))
        ranked = ranked.withColumn(other_rank, F.col("_place") + F.coalesce(before, F.lit(0)))
    ranked = ranked.withColumn("_low", low).where((F.col("_top") <= k) | (F.col("_low") <= k))
    top = F.when(F.col("_top") <= k, F.col("_top")).otherwise(F.col("_total") + 1 - F.col("_low"))
    columns = [*df.columns, top.alias(from_top), (F.col("_total") + 1 - top).alias(from_bottom)]
    return ranked.select(*columns, *([other_rank] if other is not None else []))
