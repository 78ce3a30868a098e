"""Personal data: fixed patterns, and more of the same kind found by bootstrapped contexts.

1. The fixed patterns give seed entities. Every identifier-like word and every seed is a mention of an instance, and the
   words before it are lexical patterns (one word, two words). One pass over the texts writes all mentions, with keys
   of their rows instead of texts.
2. Patterns and instances form a bipartite graph. Spark scores it in rounds: a pattern is worth the mean score of its
   instances for a kind, an instance that is no seed is worth the noisy-or of its patterns. A pattern needs the support of
   LEAST_SUPPORT seeds, however many there are in all.
3. Patterns of high score meet the mentions again in a join and find identifiers that the fixed patterns miss; these are
   grouped by row and go back to the texts. Neither patterns nor identifiers pass through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quorica.llm.common import row_key, stored

KINDS = ("email", "ip", "card", "phone")
LEAST_SUPPORT = 5
CONFIDENCE = 0.8
ROUNDS = 3

Span = tuple[int, int, str]

# The base patterns. Runs are possessive or anchored, so that a long run is read once.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

_CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@0-9]*+[@0-9][^\x20\x09-\x0D]*+")
_SHAPES = (
    ("email", re.compile(r"[^@]+@[^@]+")),
    ("ip", re.compile(r"[0-9]+(?:[.:][0-9]+){3,}|[0-9A-Fa-f]*(?::[0-9A-Fa-f]*){3,}")),
    ("card", re.compile(r"(?:[0-9]-?){12,19}")),
    ("phone", re.compile(r"[+(]?[0-9](?:[().-]?[0-9]){6,14}")),
)
_EDGES = ".,;:!?()[]{}<>\"'|*"
_BETWEEN = _EDGES + "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_RUN = re.compile(rf"[^{re.escape(_BETWEEN)}]*+")
# Longer patterns are known by their digest.
_LONG_PATTERN = 100


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else (2 * digit - 9 if digit > 4 else 2 * digit)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        # The run before the sign, read backwards, starts the leftmost match.
        run = _LOCAL_END.match(text[done:at][::-1]).end() if domain else 0
        if run:
            yield at - run, domain.end(), "email"
        done = domain.end() if run else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind as in KINDS; leftmost matches that fail the check are dropped."""
    found = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=_place)


def _place(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def _word_before(text: str, end: int) -> tuple[int, int]:
    """Place of the last run of characters before `end` that are neither white nor edges; empty if there is none."""
    size = 32
    while True:
        low = max(0, end - size)
        part = text[low:end].rstrip(_BETWEEN)
        run = _RUN.match(part[::-1]).end()
        if low == 0 or run < len(part):
            return low + len(part) - run, low + len(part)
        size *= 4


def _contexts(text: str, start: int, before: int) -> list[str]:
    """The lexical patterns before a place: its last word, its last two words.

    A word ends at white space, at punctuation and at the end `before` of an identifier it is glued to.
    """
    words, end = [], start
    while len(words) < 2:
        low, high = _word_before(text, end)
        if low == high:
            break
        words.append(text[max(low, before) if not words and before <= high else low : high].lower())
        if not words[-1]:
            words.pop()
        end = low
    patterns = [" ".join(words[n - 1 :: -1]) for n in (1, 2) if len(words) >= n]
    return [p if len(p) <= _LONG_PATTERN else f"#{xxhash.xxh3_128_hexdigest(p)}" for p in patterns]


def _candidates(text: str, base: list[Span]) -> Iterator[tuple[int, int, list[str]]]:
    """Identifier-like words outside the base spans, with the kinds their shape allows."""
    i = 0
    for m in _CANDIDATE.finditer(text):
        word = m[0].lstrip(_EDGES)
        start = m.end() - len(word)
        word = word.rstrip(_EDGES)
        end = start + len(word)
        while i < len(base) and base[i][1] <= start:
            i += 1
        # All later spans start behind this one.
        if not word or (i < len(base) and base[i][0] < end):
            continue
        kinds = [kind for kind, shape in _SHAPES if shape.fullmatch(word)]
        if kinds:
            yield start, end, kinds


def mentions_of(text: str) -> list[tuple[int, int, str, int, bool, list[str]]]:
    """(start, end, kind, order of the kind among those the shape allows, is a seed, patterns) of all mentions in order."""
    base = base_spans(text)
    found = [(start, end, [kind], True) for start, end, kind in base]
    found += [(start, end, kinds, False) for start, end, kinds in _candidates(text, base)]
    out, before = [], 0
    for start, end, kinds, seed in sorted(found):
        around = _contexts(text, start, before)
        out += [(start, end, kind, order, seed, around) for order, kind in enumerate(kinds)]
        before = max(before, end)
    return out


_MENTION = ["key_id", "key_text", "first", "last", "kind", "place", "seed", "patterns", "instance"]


def _observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key_id, key_text, text in zip(batch["key_id"], batch["key_text"], batch["text"]):
            for start, *rest in mentions_of(text or ""):
                instance = xxhash.xxh3_64_intdigest(text[start : rest[0]].lower()) - (1 << 63)
                rows.append((key_id, key_text, start, *rest, instance))
        yield pd.DataFrame(rows, columns=_MENTION)


def mentions(docs: DataFrame) -> DataFrame:
    """Every seed and identifier-like word of all texts, with the key of its row (id and text); written.

    Repeated rows give repeated mentions of one key.
    """
    made = docs.select(*row_key(), "text").mapInPandas(
        _observe,
        "key_id long, key_text long, first int, last int, kind string, place int, seed boolean, patterns array<string>, "
        "instance long",
    )
    return stored(made, "mentions")


def learn_patterns(seen: DataFrame, least_support: int = LEAST_SUPPORT) -> DataFrame:
    """(pattern, kind, score) of the patterns whose final score is high, learned from all mentions.

    The same identifier in several contexts links them; repeated mentions count once. Without seeds there are none.
    """
    edges = seen.select(F.explode("patterns").alias("pattern"), "kind", "instance", F.col("seed").cast("int").alias("seed"))
    edges = stored(edges.groupBy("pattern", "kind", "instance").agg(F.max("seed").alias("seed")), "observed")
    backed = edges.groupBy("pattern", "kind").agg(F.sum("seed").alias("support")).where(F.col("support") >= least_support)
    edges = stored(edges.join(backed.select("pattern", "kind"), ["pattern", "kind"]), "edges")
    worth = edges.select("kind", "instance", F.col("seed").cast("double").alias("worth")).distinct()
    for _ in range(ROUNDS):
        scores = (
            edges.join(worth, ["kind", "instance"])
            .groupBy("pattern", "kind")
            .agg(F.round(F.avg("worth"), 6).alias("score"))
        )
        scores = stored(scores, "scores")
        doubt = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))))
        worth = (
            edges.join(scores, ["pattern", "kind"])
            .groupBy("kind", "instance")
            .agg(F.when(F.max("seed") == 1, 1.0).otherwise(F.round(1 - F.exp(doubt), 6)).alias("worth"))
        )
        worth = stored(worth, "worth")
    return scores.where(F.col("score") >= CONFIDENCE)


def discovered(seen: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key_id, key_text, more): the identifiers that the patterns (pattern, kind) discover in each row that has some.

    `more` lists (first, last, kind) in order; of several kinds the first that the word's shape allows counts. It is as long as
    the text has identifiers. Written, so that the joins with it go by its true size.
    """
    keys = ["key_id", "key_text"]
    asked = seen.where("NOT seed").select(*keys, "first", "last", "kind", "place", F.explode("patterns").alias("pattern"))
    found = asked.join(patterns.select("pattern", "kind").distinct(), ["pattern", "kind"], "left_semi")
    spans = found.groupBy(*keys, "first", "last").agg(F.min(F.struct("place", "kind")).alias("kind"))
    entry = F.struct("first", "last", F.col("kind.kind").alias("kind"))
    return stored(spans.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("more")), "discovered")


_SPANS = "array<struct<first: int, last: int, kind: string>>"


def _joined(spans: Column) -> Column:
    """Spans by start, then kind as in KINDS, as `kind:start:end` joined by commas."""
    order = F.array(*map(F.lit, KINDS))
    placed = F.transform(
        spans, lambda s: F.struct(s["first"].alias("first"), F.array_position(order, s["kind"]).alias("kind"), s["last"].alias("last"))
    )
    listed = F.transform(
        F.array_sort(placed), lambda s: F.concat_ws(":", F.element_at(order, s["kind"].cast("int")), s["first"], s["last"])
    )
    return F.array_join(listed, ",")


def _with_more(rows: DataFrame, docs: DataFrame, least_support: int) -> DataFrame:
    seen = mentions(docs)
    more = discovered(seen, learn_patterns(seen, least_support))
    return rows.join(more, ["key_id", "key_text"], "left").withColumn("more", F.coalesce("more", F.array().cast(_SPANS)))


def find(docs: DataFrame, least_support: int = LEAST_SUPPORT) -> DataFrame:
    """Spans of every text: doc_id, base and all as `kind:start:end` joined by commas, and base counts by kind.

    Offsets are code points, the end is exclusive. Spans of different kinds may overlap; they come by start, then kind.
    A null text counts as empty, an empty table has an empty result. Repeated rows give repeated results; other
    columns of `docs` are ignored. Texts and words of any length are read whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [base_spans(text or "") for text in batch["text"]]
            out = batch.drop(columns="text")
            out["base"] = [[{"first": a, "last": b, "kind": kind} for a, b, kind in spans] for spans in found]
            yield out

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), *row_key(), "text")
    rows = rows.mapInPandas(run, f"doc_id string, key_id long, key_text long, base {_SPANS}")
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return _with_more(rows, docs, least_support).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *counts,
        _joined(F.col("base")).alias("base"),
        _joined(F.concat("base", "more")).alias("spans"),
    )


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first in brackets."""
    parts, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


@F.pandas_udf(StringType())
def _masked(texts: pd.Series, more: pd.Series) -> pd.Series:
    out = []
    for text, extra in zip(texts, more):
        if text is None:
            out.append(None)
            continue
        spans = [(int(a), int(b), kind) for kind, a, b in (s.split(":") for s in extra.split(",") if s)]
        out.append(masked(text, sorted(base_spans(text) + spans, key=_place)))
    return pd.Series(out, dtype=object)


def redact(docs: DataFrame, least_support: int = LEAST_SUPPORT) -> DataFrame:
    """`docs` with masked texts and, where the column exists, n_chars to match; null texts stay null."""
    rows = docs.select(F.struct("*").alias("row"), *row_key())
    known = _with_more(rows, docs, least_support).select("row", _masked("row.text", _joined(F.col("more"))).alias("clean"))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("clean").alias(name)
        old = F.col("row")[name]
        if name == "n_chars":
            old = F.coalesce(F.length("clean").cast(docs.schema[name].dataType), old)
        return old.alias(name)

    return known.select(*map(column, docs.columns))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and all spans."""
    return find(docs).select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
