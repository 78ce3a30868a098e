"""Quality rules: fixed base rules, then cutoffs that follow each language and source.

The cutoffs come from quantile sketches: a value is rounded down to its six leading bits, and a sketch is the
number of documents at each rounded value. Sketches merge by adding counts, to those of a language and of everything. The
quantiles of a group of n documents are drawn to those of its language with the weight of PRIOR_ROWS documents
against n, and the language's likewise to those of everything: a small group borrows, a large one stands alone, without a
step in between. The relative error of a quantile is at most 1/32. Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorica.llm.common import SPACE, WORD, stored

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
PRIOR_ROWS = 50
LEADING_BITS = 6
# Rates per document: name, SQL expression over the statistics, slack around the cutoff, both sides or the upper only.
RATES = (
    ("symbol_rate", "1000 * n_symbols div n_words", 200, False),
    ("dup_line_rate", "1000 * n_dup_lines div n_words", 50, False),
    ("repeat_rate", "1000 * n_repeat_words div n_words", 100, False),
    ("word_length", "100 * word_chars div n_words", 150, True),
)
SPREADS = 4


def _bind(value: Column, body) -> Column:
    """`body` over a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """`keep` and new columns that are computed once a row.

    They leave a generator, which Catalyst doesn't take apart. As plain columns they would be copied into every filter
    and lambda that names them, and a copy inside a lambda runs once per element.
    """
    made = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))
    return df.select(*keep, made.alias("made")).select(*keep, "made.*")


def _repeat_words(words: Column, count: Column, has_repeat: Column) -> Column:
    """Words inside windows that occur at least twice; sorting brings equal windows together."""

    def window_at(i: Column) -> Column:
        return F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i"))

    def repeated(ordered: Column) -> Column:
        def equal(x: Column, i: Column) -> Column:
            before = F.get(ordered, i - 1)["w"] == x["w"]
            after = F.get(ordered, i + 1)["w"] == x["w"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return F.sort_array(F.transform(F.filter(ordered, equal), lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        steps = F.transform(
            starts, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - x, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    windows = F.transform(F.sequence(F.lit(0), count - WINDOW), window_at)
    found = _bind(_bind(F.sort_array(windows), repeated), covered)
    return F.when(has_repeat, found).otherwise(0).cast("long")


def with_statistics(docs: DataFrame) -> DataFrame:
    """(row, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed).

    `docs` needs doc_id, text, lang and source; `row` holds all input columns. A null text counts as empty. Wrong-looking
    input (only white space, one endless word) simply has few words. Repeated rows count each, here and in the cutoffs. Whole
    texts are read, whatever their length: a row needs some ten times its text in memory. An empty table stays empty.
    """
    own = ["row", "lang", "source", "text"]
    text = F.coalesce("text", F.lit("")).alias("text")
    taken = docs.select(F.struct("*").alias("row"), "lang", "source", text)
    split = _once(
        taken,
        own,
        words=F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)),
        lines=F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    )
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(F.slice("words", i + 1, WINDOW))
    )
    none = F.array().cast("array<long>")
    hashed = _once(split, [*own, "words", "lines"], hashes=F.when(F.size("words") >= WINDOW, hashes).otherwise(none))
    symbols = F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))
    counted = _once(
        hashed,
        own[:3],
        n_words=F.size("words").cast("long"),
        word_chars=F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long"),
        n_symbols=symbols.cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_repeat_words=_repeat_words(
            F.col("words"), F.size("words"), F.size(F.array_distinct("hashes")) < F.size("hashes")
        ),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _rounded(value: str) -> str:
    shift = f"greatest(length(bin({value})) - {LEADING_BITS}, 0)"
    return f"shiftleft(shiftright({value}, {shift}), {shift})"


def _drawn(own: str, above: Column, prior_rows: int) -> Column:
    """Quantiles (q25, q50, q75) of a group drawn to those above, in whole numbers."""

    def drawn(name: str) -> Column:
        weighed = F.col(own)["rows"] * F.col(own)[name] + prior_rows * above[name]
        return F.call_function("div", weighed, F.col(own)["rows"] + prior_rows).alias(name)

    return F.struct(drawn("q25"), drawn("q50"), drawn("q75"))


def cutoffs(measured: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """Bounds of every rate for each (lang, source) with a document that passes the base rules.

    `prior_rows` is the number of documents that the level above counts for. Null languages and sources are groups of their
    own. Nothing but counts of rounded values is shuffled, so a hot group is a few hundred rows a task. Without
    documents there are no bounds.
    """
    rates = F.explode(F.array(*(F.struct(F.lit(n).alias("rate"), F.expr(e).alias("value")) for n, e, _, _ in RATES)))
    leaves = (
        measured.where("not base_failed")
        .select("lang", "source", rates.alias("r"))
        .groupBy("lang", "source", F.col("r.rate").alias("rate"), F.expr(_rounded("r.value")).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    leaves = stored(leaves, "sketches")
    levels = F.explode(
        F.array(
            F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")),
            F.struct(F.lit(1).alias("level"), F.col("lang"), F.lit(None).cast("string").alias("source")),
            F.struct(F.lit(2).alias("level"), F.col("lang"), F.col("source")),
        )
    )
    merged = (
        leaves.select(levels.alias("g"), "rate", "value", "n")
        .groupBy("g", "rate", "value")
        .agg(F.sum("n").alias("n"))
    )
    sketch = Window.partitionBy("g", "rate")
    ranked = merged.withColumns(
        {
            "upto": F.sum("n").over(sketch.orderBy("value")),
            "rows": F.sum("n").over(sketch),
        }
    )

    def quantile(percent: int) -> Column:
        return F.min(F.when(100 * F.col("upto") >= percent * F.col("rows"), F.col("value"))).alias(f"q{percent}")

    quantiles = ranked.groupBy("g", "rate").agg(F.first("rows").alias("rows"), quantile(25), quantile(50), quantile(75))
    wanted = leaves.select("lang", "source").distinct().select("lang", "source", levels.alias("g"))
    same = [wanted["g"][k].eqNullSafe(quantiles["g"][k]) for k in ("level", "lang", "source")]
    level = wanted["g"]["level"]
    found = F.struct("rows", "q25", "q50", "q75")
    stacked = (
        wanted.join(quantiles, same[0] & same[1] & same[2])
        .groupBy("lang", "source", "rate")
        .agg(*(F.max(F.when(level == i, found)).alias(name) for i, name in enumerate(("overall", "language", "own"))))
    )
    drawn = stacked.withColumn("language_q", _drawn("language", F.col("overall"), prior_rows))
    drawn = drawn.select("lang", "source", "rate", _drawn("own", F.col("language_q"), prior_rows).alias("q"))
    drawn = drawn.select("lang", "source", "rate", "q.*")
    slack = F.coalesce(*(F.when(F.col("rate") == n, F.lit(s)) for n, _, s, _ in RATES))
    two_sided = F.col("rate").isin(*(n for n, _, _, both in RATES if both))
    low = F.when(two_sided, F.col("q50") - SPREADS * (F.col("q50") - F.col("q25")) - slack).alias("low")
    high = (F.col("q50") + SPREADS * (F.col("q75") - F.col("q50")) + slack).alias("high")
    best = drawn.select("lang", "source", "rate", F.struct(low, high).alias("b"))
    return best.groupBy("lang", "source").pivot("rate", [n for n, *_ in RATES]).agg(F.first("b"))


def judged(docs: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """The columns of `with_statistics` and `kept`: the base rules and all cutoffs hold.

    The table of cutoffs is written first, so that its size is known and Spark broadcasts it only if small.
    """
    measured = with_statistics(docs) if measured is None else measured
    limits = stored(cutoffs(measured), "cutoffs").withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = measured.join(
        limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left"
    )
    fits = ~F.col("base_failed")
    for name, rate, _, both in RATES:
        value = F.expr(f"case when n_words > 0 then {rate} end")
        fits = fits & F.coalesce(value <= F.col(name)["high"], F.lit(False))
        if both:
            fits = fits & F.coalesce(value >= F.col(name)["low"], F.lit(False))
    return joined.select(*measured.columns, fits.alias("kept"))


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed and kept, one row per document, from one pass over the texts."""
    slim = with_statistics(docs.select("doc_id", "text", "lang", "source"))
    slim = slim.withColumn("row", F.struct("row.doc_id"))
    rows = judged(docs, stored(slim, "statistics"))
    return rows.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with their columns.

    Rows and statistics are written once, as computing them costs far more than reading them; the cutoffs read only the
    statistics. Texts are never shuffled.
    """
    measured = stored(with_statistics(docs), "measured")
    return judged(docs, measured).where("kept").select("row.*")
