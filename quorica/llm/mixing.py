"""Mixing sources to target weights by capped water-filling.

Targets: every source gets its share by weight but stops at a number of epochs over its words; the excess goes
to the others by weight. With the sources ordered by cap per weight the level follows from running sums, without a loop.

Documents: a source's target is a number of whole repetitions and a rest. The rest takes documents in the
order of a seeded digest until it is reached, so that the words taken differ from the target by at most half of the one
document at the cut. The order is not sorted as a whole: digests fall into 4096 buckets, sums over buckets show
which bucket holds the cut, and sums over that bucket's keys (digest, digest of the text), which count equal rows together,
which key. Sizes and keys are written first, so this moves no text; every row is then compared with its source's cut where
it is. Only where the cut falls between wholly equal rows are these rows numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorica.llm.common import WORD, stored

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
EPOCHS = 2
SEED = "mix-1"
BUCKET_DIGITS = 3


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _digest(doc_id: str = "doc_id") -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target, whole, need) from rows (source, size).

    Sources in the order of their code points, null last, take the weights in turn. Only rows of the
    source table, one per source, meet in one window. An empty source has target 0.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    turn = F.coalesce(*(F.when(place % len(weights) == i, F.lit(w)) for i, w in enumerate(weights)))
    caps = sums.select("source", "source_size", turn.alias("weight"), (epochs * F.col("source_size")).alias("cap"))
    ratio = F.col("cap").cast("double") / F.col("weight")
    order = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything).cast("double") * budget
    levels = caps.withColumns(
        {"place": F.row_number().over(order), "level": (total - before.cast("double")) / rest.cast("double"), "ratio": ratio}
    )
    water = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("place", "level"))).over(everything)
    filled = levels.withColumn("water", water)
    capped = F.col("water").isNull() | (F.col("place") < F.col("water.place"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("water.level") * F.col("weight"))
    kept = filled.select("source", "source_size", target.alias("target"))
    size = F.col("source_size").cast("double")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long")
    kept = kept.withColumn("whole", whole)
    return kept.withColumn("need", F.col("target") - F.col("whole").cast("double") * size)


def _digest_of_text(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def cuts(sized: DataFrame) -> DataFrame:
    """One row per source: of_source, source_size, target, whole and the cut from rows (source, digest, tail, size).

    Rows before the cut's key (digest, tail) are taken once more than `whole` times, of those at the key the first `taken`
    of `ties`. A cut '~' lies behind all rows, '' before them.
    """
    bucketed = sized.withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS))
    buckets = stored(bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "buckets")
    goal = targets(buckets).withColumnRenamed("source", "of_source")
    in_order = Window.partitionBy("source").orderBy("bucket")
    upto = buckets.withColumn("upto", F.sum("size").over(in_order))
    found = (
        upto.join(goal, F.col("source").eqNullSafe(F.col("of_source")))
        .where("upto > need")
        .groupBy("source")
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"))).alias("cut"))
        .withColumnRenamed("source", "c_source")
    )
    plan = stored(goal.join(found, F.col("of_source").eqNullSafe(F.col("c_source")), "left").drop("c_source"), "plan")
    inside = bucketed.join(
        plan.select("of_source", "need", "cut"),
        F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("cut.bucket")) & (F.col("need") > 0),
    )
    keys = inside.groupBy("source", "digest", "tail", "size", "need", F.col("cut.before").alias("before")).agg(
        F.count(F.lit(1)).alias("ties")
    )
    ordered = Window.partitionBy("source").orderBy("digest", "tail", "size")
    passed = F.sum(F.col("size") * F.col("ties")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    keys = keys.withColumn("room", F.col("need") - F.col("before") - F.coalesce(passed, F.lit(0)))
    # Of rows of one size the i-th from 0 is taken if its middle, (i + 1/2) * size, is within the room.
    fitting = F.floor(F.try_divide("room", "size") + 0.5)
    taken = F.when(F.col("room") < 0, 0).when(F.col("size") == 0, F.col("ties")).otherwise(fitting)
    taken = F.least(F.greatest(taken, F.lit(0)), "ties").cast("long")
    first = F.min(F.struct("digest", "tail", F.col("taken").alias("taken"), "ties")).alias("at")
    at = keys.withColumn("taken", taken).where("taken < ties").groupBy("source").agg(first).withColumnRenamed("source", "a_source")
    whole = plan.join(at, F.col("of_source").eqNullSafe(F.col("a_source")), "left")
    behind = F.when(F.col("need") <= 0, "").when(F.col("cut").isNull(), "~")
    # Without a key that stays out, all of the cut's bucket is taken: the cut is right behind it.
    return whole.select(
        "of_source", "source_size", "target", "whole",
        F.coalesce(behind, "at.digest", F.concat("cut.bucket", F.lit("~"))).alias("cut"),
        F.coalesce("at.tail", F.lit("")).alias("cut_tail"),
        F.coalesce("at.taken", F.lit(0)).alias("taken"),
        F.coalesce("at.ties", F.lit(0)).alias("ties"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """(row, size, source_size, target, copies): how often the mix takes each document.

    `row` holds the input columns. A null text has size 0, a null source is a source of its own, a null id counts
    as an empty string in the order. Rows of equal id are ordered by their text; rows equal in both are interchangeable, and
    if the cut falls between them they are numbered in one task of their source. Texts may have any length.
    Documents without words are copied like others of their place and take no words. No documents give no rows.
    """
    base = docs.select(F.struct("*").alias("row"), "source", word_count().alias("size"), _digest().alias("digest"))
    tail = _digest_of_text(F.col("row.text"))
    sized = docs.select("source", word_count().alias("size"), _digest().alias("digest"), _digest_of_text(F.col("text")).alias("tail"))
    plan = stored(cuts(stored(sized, "sizes")), "cuts")
    known = base.join(plan, F.col("source").eqNullSafe(F.col("of_source")))
    same = F.col("digest") == F.col("cut")
    before = (F.col("digest") < F.col("cut")) | (same & (tail < F.col("cut_tail")))
    result = ["row", "size", "source_size", "target"]
    copies = (F.col("whole") + F.when(before, 1).otherwise(0)).alias("copies")
    between = plan.where("taken > 0")
    if between.isEmpty():
        return known.select(*result, copies)
    tied = (F.col("taken") > 0) & same & (tail == F.col("cut_tail"))
    number = F.row_number().over(Window.partitionBy("source").orderBy("digest"))
    first = (F.col("whole") + F.when(number <= F.col("taken"), 1).otherwise(0)).alias("copies")
    return known.where(~tied).select(*result, copies).unionByName(known.where(tied).select(*result, first))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words with repeats) of every document."""
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed(docs).select("row.doc_id", "size", "source_size", "target", taken)


def mix(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    rows = mixed(docs).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
