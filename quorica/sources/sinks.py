"""Sinks: replaced catalogue tables, and date-partitioned tables with clustered files."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Partition column of each grain.
PARTITIONS = {"day": "creation_day", "month": "creation_month"}


def save_table(df: DataFrame, name: str) -> None:
    """Create or replace a catalogue table.

    The rows go to a new folder of the warehouse first and the table is then pointed to it, so
    a failed job leaves the table as it was, and running queries keep the files they opened. Columns
    that differ from the table's take two steps of the catalogue, a drop and a create.
    """
    spark = df.sparkSession
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/{name}.versions/{uuid.uuid4().hex}"
    df.write.parquet(path)
    quoted = path.replace("'", "\\'")
    if spark.catalog.tableExists(name):
        if spark.table(name).schema.simpleString() == df.schema.simpleString():
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{quoted}'")
            spark.catalog.refreshTable(name)
            return
        spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{quoted}'")


def date_bucket(ts: Column, grain: str) -> Column:
    return F.to_date(ts) if grain == "day" else F.trunc(F.to_date(ts), grain)


def write_by_date(
    df: DataFrame,
    path: str,
    partition: str,
    grain: str,
    cluster: tuple[str, ...],
    timestamp: str = "creation_date",
) -> None:
    """Partition by day or month of the timestamp, and sort by the cluster keys.

    The rebalance is one shuffle by bucket in which adaptive execution splits a
    bucket that is too large for one task, such as a day with a third of all
    rows, and packs small ones together. Inside each file the cluster order
    lets row-group statistics prune.
    """
    (
        df.withColumn(partition, date_bucket(F.col(timestamp), grain))
        .hint("rebalance", F.col(partition))
        .sortWithinPartitions(partition, *cluster)
        .write.mode("overwrite")
        .partitionBy(partition)
        .parquet(path)
    )


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """One sorted file for each bucket of the key. The table that describes them doesn't stay in the catalogue."""
    spark = df.sparkSession
    table = f"written_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key).sortWithinPartitions(key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")


def read_bucketed(spark: SparkSession, path: str, schema: StructType, key: str, buckets: int) -> DataFrame:
    """Files of `write_bucketed`; joins and groupings by the key read the buckets where they are."""
    table = f"read_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
    quoted = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{quoted}'"
    )
    df = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the frame has read the description; the files stay
    return df


def in_window(
    df: DataFrame, start: str | datetime | None, end: str | datetime | None, timestamp: str = "creation_date"
) -> Column:
    """``start <= timestamp < end``, and the same bounds on the date partitions `df` has; None is no bound.

    Spark prunes folders only by a filter on the partition column itself.
    """
    ts, suits = F.col(timestamp), F.lit(True)
    buckets = {grain: F.col(partition) for grain, partition in PARTITIONS.items() if partition in df.columns}
    if start is not None:
        low = F.lit(start).cast("timestamp_ntz")
        suits = suits & (ts >= low)
        for grain, bucket in buckets.items():
            suits = suits & (bucket >= date_bucket(low, grain))
    if end is not None:
        high = F.lit(end).cast("timestamp_ntz")
        suits = suits & (ts < high)
        for grain, bucket in buckets.items():
            suits = suits & (bucket <= date_bucket(high, grain))
    return suits


def without_partitions(df: DataFrame) -> DataFrame:
    """Drop the helper columns of the layout."""
    return df.drop(*PARTITIONS.values())


def read_window(spark: SparkSession, path: str, start: str | None, end: str | None) -> DataFrame:
    """The rows of a date-partitioned table in ``[start, end)``, from the folders that can hold them."""
    df = spark.read.parquet(path)
    return df.where(in_window(df, start, end))
