"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorica.session import shared_dir

# Words are runs without ASCII white space, in Spark, Python and the SQL twins alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
PIECE = 1 << 20
_SPACE_BYTE = re.compile(rb"[\x20\x09-\x0D]")
_MISSING_ID = -(1 << 63)


def prepared(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches: a batch of long texts must fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` to the folder all executors share and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, least: int) -> DataFrame:
    """Like `stored`, in buckets of `key`: grouping by it reads the buckets where they are instead of shuffling.

    `least` buckets, and twice as many as shuffle partitions, as Spark ignores a bucketing with fewer; at most what Spark
    allows, beyond which buckets grow. The files are in the shared folder; the table that describes
    them leaves the catalogue at once, the frame has read the description.
    """
    spark = df.sparkSession
    unique = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/llm/{unique}/{name}"
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    buckets = min(max(least, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))), most)
    table = f"llm_{name}_{unique}"
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(table)
    made = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return made


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInPandas over a frame with doc_id, which comes first in the result.

    Ids pass as strings: pandas turns whole numbers beside nulls into floats, which would round large ids.
    """
    text_ids = df.withColumn("doc_id", F.col("doc_id").cast("string"))
    made = text_ids.mapInPandas(run, f"doc_id string, {schema}")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two non-null columns that only rows of equal id and text share."""
    return [
        F.coalesce(F.col(doc_id), F.lit(_MISSING_ID)).alias("key_id"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("key_text"),
    ]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in a fold; a null id is in none."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def word_pieces(data: bytes) -> Iterator[bytes]:
    """Cut at white space about every mebibyte, so that word lists stay short."""
    start = 0
    while start < len(data):
        cut = _SPACE_BYTE.search(data, start + PIECE) if len(data) - start > PIECE else None
        end = cut.start() if cut else len(data)
        yield data[start:end]
        start = end
