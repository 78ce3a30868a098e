"""Licence scan: canonical digests of entire texts, joined to those of known licences.

A text is made canonical: ASCII lower case, copyright lines dropped, punctuation to blanks, equivalent spellings unified,
white space collapsed. Its digest is then equal to that of the licence whatever the holder, year, wrapping or
quotation marks. The same is done for each line, which finds one-line notices. Everything is DataFrame functions.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorica.llm.common import row_key, stored

FOLDER = Path(__file__).parent / "known_licenses"
# One-line notices.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
# Spellings that count as the same.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("http ", "https "),
)
COPYRIGHT_LINE = r"^[ \t]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|<year>|\[year\]|\(c\)|©)[^\n]*$"
RESERVED_LINE = r"^[ \t]*all rights reserved\.?[ \t]*$"
PUNCTUATION = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E©“”‘’–—]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The canonical form with line ends kept; blanks within lines are single."""
    out = F.translate(text, _UPPER + "\r\t\x0b\x0c", _LOWER + "    ")
    for line in (COPYRIGHT_LINE, RESERVED_LINE):
        out = F.regexp_replace(out, f"(?dm){line}", "")
    out = F.regexp_replace(out, PUNCTUATION, " ")
    return _unified(F.regexp_replace(out, " +", " "))


def _unified(text: Column) -> Column:
    for spelling, usual in SPELLINGS:
        text = F.replace(text, F.lit(spelling), F.lit(usual))
    return text


def _flat(lines: Column) -> Column:
    """The whole text as one line, in which spellings of two words may have been parted by a line end."""
    return _unified(F.trim(F.regexp_replace(lines, r"[ \n]+", " ")))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text): full texts and one-line notices."""
    full = [(path.stem, path.read_text(encoding="utf-8")) for path in sorted(FOLDER.glob("*.txt"))]
    return spark.createDataFrame([*full, *NOTICES], "license_id string, text string")


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license_id) of the canonical forms; written, so that joins go by the table's true size."""
    form = _flat(canonical(F.col("text")))
    digests = known.where(form != "").select(F.sha2(form, 256).alias("digest"), "license_id")
    return stored(digests.groupBy("digest").agg(F.min("license_id").alias("license_id")), "known")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, license_id (licence the entire text is, else null), notices (licences that a line names).

    `known` (license_id, text) may be of any size: digests are joined, and as long as Spark finds the known ones small they
    go to the texts, otherwise digests of lines are shuffled. A text is made canonical once; only what is
    found is grouped. Notices are in order, joined by commas, the empty string if none. Null, blank and empty texts are no
    licence; an empty table has an empty result. Of known texts with equal canonical form the smallest id counts. Repeated
    rows give repeated results; other columns are ignored. Texts and lines of any length are read whole.
    """
    keys = ["key_id", "key_text"]
    # A generator keeps Catalyst from computing the form again wherever it is named.
    form = docs.select(*row_key(), F.explode(F.array(canonical(F.coalesce("text", F.lit(""))))).alias("form"))
    whole = F.struct(F.sha2(_flat(F.col("form")), 256).alias("digest"), F.lit(True).alias("entire"))
    lines = F.array_distinct(F.transform(F.split("form", "\n"), lambda line: F.trim(line)))
    each = F.transform(
        F.filter(lines, lambda line: line != ""),
        lambda line: F.struct(F.sha2(line, 256).alias("digest"), F.lit(False).alias("entire")),
    )
    digests = form.select(*keys, F.inline(F.concat(F.array(whole), each)))
    found = (
        digests.join(known_digests(known), "digest")
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col("entire"), F.col("license_id"))).alias("license_id"),
            F.array_join(F.array_sort(F.collect_set(F.when(~F.col("entire"), F.col("license_id")))), ",").alias("notices"),
        )
    )
    rows = docs.select("doc_id", *row_key()).join(stored(found, "found"), keys, "left")
    return rows.select("doc_id", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))
