"""Near duplicates by min-max hashing: both ends of every permutation are banded.

A signature keeps the minimum and the maximum of the shingles under each permutation, so half as
many hash evaluations give as many band values. The ends of one permutation go to different bands.

1. One pass over the texts: shingle count, fingerprint of the shingle set, band keys.
2. Equal sets become one node; from here on the number of copies plays no part.
3. Nodes sharing a band key are joined in stars around the smallest; the components of these stars are
   families. Unlike texts share no band key, so families are small except for real groups of variants.
4. Texts of family members (only these) are compared on their full sets. A family that fits one task is
   compared there. A larger one is cut into chunks: all chunks meet a few hubs first, then only the
   members outside the family's main component meet every chunk.
5. Components of the confirmed links; the smallest doc_id of each is handed back to all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorica.llm.common import free_names, mapped, row_key, stored, word_pieces
from quorica.llm.graph import components

PERMUTATIONS = 100
ROWS = 5
SHARE = 80
FAMILY_MEMBERS = 256
FAMILY_SHINGLES = 1_000_000
HUBS = 12
_PROFILE = "key_id long, key_text long, n_shingles long, node binary, short long, bands array<long>"
_LINK = "a binary, b binary"
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z are lower-cased.

    A text with fewer words than `width` has its whole sequence as one shingle, one without
    words has none.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    parts = [
        np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        for words in (piece.split() for piece in word_pieces(data))
        if words
    ]
    if not parts:
        return np.empty(0, np.uint64)
    words = np.concatenate(parts)
    width = min(width, len(words))
    acc = words[: len(words) - width + 1] + _U(width)
    for j in range(1, width):
        acc = _mix(acc) + words[j : len(words) - width + 1 + j]
    return np.unique(_mix(acc))


class MinMax:
    """Band keys of shingle sets. The constants follow from the seed alone."""

    def __init__(self, permutations: int, rows: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.factor = draw.integers(0, 1 << 63, permutations, dtype=np.uint64) * _U(2) + _U(1)
        self.offset = draw.integers(0, 1 << 63, permutations, dtype=np.uint64) * _U(2)
        self.rows, self.per_end = rows, permutations // rows

    def ends(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        high = np.zeros(len(self.factor), np.uint64)
        for start in range(0, len(hashes), 1024):
            x = hashes[start : start + 1024, None] * self.factor + self.offset
            np.minimum(low, x.min(axis=0), out=low)
            np.maximum(high, x.max(axis=0), out=high)
        return np.stack([low, high])

    def bands(self, ends: np.ndarray) -> np.ndarray:
        """Keys of shape (texts, 2 * bands per end) from ends of shape (texts, 2, permutations)."""
        used = ends[:, :, : self.per_end * self.rows].reshape(len(ends), 2 * self.per_end, self.rows)
        key = np.broadcast_to(np.arange(2 * self.per_end, dtype=np.uint64), used.shape[:2]).copy()
        for j in range(self.rows):
            key = _mix(key) + used[:, :, j]
        return _mix(key).view(np.int64)


def _profiler(width: int, permutations: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = MinMax(permutations, rows)
        with np.errstate(over="ignore"):
            for batch in batches:
                sets = [shingles(text, width) for text in batch["text"]]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = hasher.bands(np.stack([hasher.ends(sets[i]) for i in full])) if full else []
                nodes, short, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                for i, key in zip(full, keys):
                    nodes[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    short[i] = int.from_bytes(nodes[i][:8], "big", signed=True)
                    bands[i] = key
                out = batch[["doc_id", "key_id", "key_text"]].copy()
                out["n_shingles"] = [len(s) for s in sets]
                out["node"], out["short"], out["bands"] = nodes, pd.array(short, "Int64"), bands
                yield out

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left set with every right set."""
    counts = np.zeros((len(left), len(right)), np.int64)
    if len(left) * len(right) <= 12:
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                counts[i, j] = len(np.intersect1d(x, y, assume_unique=True))
        return counts
    known = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values = np.concatenate(sets)
        at = np.searchsorted(known, values)
        hit = at < len(known)
        hit[hit] = known[at[hit]] == values[hit]
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], owner[hit][order]

    (lp, lo), (rp, ro) = places(left), places(right)
    step = 4096
    for start in range(0, len(known), step):
        blocks = []
        for p, o, n in ((lp, lo, len(left)), (rp, ro, len(right))):
            a, b = np.searchsorted(p, [start, start + step])
            block = np.zeros((n, step), np.float32)
            block[o[a:b], p[a:b] - start] = 1
            blocks.append(block)
        counts += np.rint(blocks[0] @ blocks[1].T).astype(np.int64)
    return counts


def _links(group: pd.DataFrame, width: int, share: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the confirmed links between the left and right members of one family."""
    group = group.drop_duplicates(["role", "node"])
    nodes = list(group["node"])
    sets = [shingles(text, width) for text in group["text"]]
    left = [i for i, role in enumerate(group["role"]) if role != "right"]
    right = [i for i, role in enumerate(group["role"]) if role != "left"]
    if not left or not right:
        return []
    both = shared_counts([sets[i] for i in left], [sets[i] for i in right])
    size = np.array([len(s) for s in sets])
    union = size[left][:, None] + size[right][None, :] - both
    parent = {node: node for node in nodes}

    def root(x: bytes) -> bytes:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i, j in np.argwhere(100 * both >= share * union):
        a, b = root(nodes[left[i]]), root(nodes[right[j]])
        if a != b:
            parent[max(a, b)] = min(a, b)
            found.append((nodes[left[i]], nodes[right[j]]))
    return found


def _comparer(width: int, share: int):
    def run(task: pd.DataFrame) -> pd.DataFrame:
        with np.errstate(over="ignore"):
            found = [link for _, family in task.groupby("family") for link in _links(family, width, share)]
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def _confirmed(texts: DataFrame, width: int, share: int) -> DataFrame:
    """Links confirmed on full sets. `texts`: node, family, chunks, chunk, text."""
    compare = _comparer(width, share)
    small, large = texts.where("chunks = 1"), texts.where("chunks > 1")
    load = small.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bins = max(32, load >> 22)
    own = (
        small.select("family", "node", "text", F.lit("both").alias("role"))
        .groupBy(F.pmod(F.xxhash64("family"), F.lit(bins)))
        .applyInPandas(compare, _LINK)
    )
    if large.isEmpty():
        return own

    # Hubs, then components of what they link.
    members = large.select("family", "node", "chunk", "chunks")
    by_node = Window.partitionBy("family").orderBy("node")
    hubs = members.withColumn("place", F.row_number().over(by_node)).where(F.col("place") <= HUBS).select("node")
    spread = large.join(hubs, "node").withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    sides = spread.withColumn("role", F.lit("left")).unionByName(large.withColumn("role", F.lit("right")))
    near_hub = stored(sides.groupBy("family", "chunk").applyInPandas(compare, _LINK), "near_hub")
    roots = components(near_hub)

    # Members outside the main component of their family meet every member once more.
    placed = stored(
        members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed"
    )
    counted = placed.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"))
    main = counted.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    outside = placed.join(main, "family").where("root <> main").select("family", "node", "chunks")
    amount = outside.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / FAMILY_MEMBERS).cast("int").alias("parts"))
    outside = stored(
        outside.join(amount, "family").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int")),
        "outside",
    )
    left = (
        large.select("node", "text")
        .join(outside, "node")
        .withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
        .select("family", "part", "chunk", "node", "text", F.lit("left").alias("role"))
    )
    right = (
        large.join(amount, "family")
        .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        .select("family", "part", "chunk", "node", "text", F.lit("right").alias("role"))
    )
    rest = left.unionByName(right).groupBy("family", "part", "chunk").applyInPandas(compare, _LINK)
    return own.unionByName(near_hub).unionByName(rest)


def near_duplicates(
    docs: DataFrame, width: int = 5, share: int = SHARE, permutations: int = PERMUTATIONS, rows: int = ROWS
) -> DataFrame:
    """One row per document with its class of near duplicates.

    `docs` needs doc_id and text; other columns are ignored. Texts are linked if their sets of word
    shingles overlap by `share` percent of their union. Returns doc_id, n_shingles, component_id (smallest
    doc_id reachable over links), kept (doc_id = component_id), and key_id, key_text, keeper: the row key of `row_key`
    and whether the row is the one (up to repeated rows of equal id and text) that stands for its class.

    Null and blank texts have no shingles, are linked with nothing and keep their own id. Null ids come
    after all others; a class of null ids only has a null component_id and its rows are `kept`. Repeated rows are
    classed like other copies. An empty table gives no rows.

    With 100 permutations and 5 values a band, 40 bands miss a pair of similarity 0.8 once in 8 million.
    """
    source = docs.select("doc_id", "text").select("doc_id", "text", *row_key())
    profile = stored(mapped(source, _profiler(width, permutations, rows), _PROFILE), "profile")
    full = profile.where("node is not null")
    nodes = stored(
        full.groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key_id", "key_text")).alias("first"),
            F.first("short").alias("short"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
        ),
        "nodes",
    )

    keyed = nodes.select("short", F.explode("bands").alias("key"))
    stars = keyed.groupBy("key").agg(F.min("short").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = keyed.join(stars, "key").where("short <> hub").select("short", "hub").distinct()
    families = components(near).toDF("short", "family")

    members = nodes.select("node", "short", "n_shingles", "first.key_id", "first.key_text").join(families, "short")
    sizes = members.groupBy("family").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / FAMILY_MEMBERS), F.ceil(F.sum("n_shingles") / FAMILY_SHINGLES), F.lit(1)
        ).cast("int").alias("chunks")
    )
    members = stored(
        members.join(sizes, "family").select(
            "key_id", "key_text", "family", "node", "chunks",
            F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"),
        ),
        "members",
    )
    keys = ["key_id", "key_text"]
    texts = stored(
        source.select("text", *keys)
        .join(members.hint("shuffle_hash"), keys)
        .dropDuplicates([*keys, "node"])
        .drop(*keys),
        "texts",
    )
    roots = components(_confirmed(texts, width, share)).select("node", "root")

    classes = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = stored(classes, "classes")
    heads = classes.groupBy("root").agg(F.min("first").alias("head"))
    classes = classes.join(heads, "root").select("node", "head")
    joined = profile.select("doc_id", "n_shingles", "node", *keys).join(classes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        *keys,
        (
            F.col("node").isNull()
            | ((F.col("head.key_id") == F.col("key_id")) & (F.col("head.key_text") == F.col("key_text")))
        ).alias("keeper"),
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, share: int = SHARE) -> DataFrame:
    """`docs` with one row of each class; all columns stay.

    The row with the smallest id stands for its class. Rows of equal id and text count as one row. Rows
    without words all stay.
    """
    keep = near_duplicates(docs, width, share).where("keeper").select("key_id", "key_text").distinct()
    names = free_names(docs, "key_id", "key_text")
    kept = docs.select("*", *(key.alias(name) for key, name in zip(row_key(), names))).join(keep.toDF(*names).hint("shuffle_hash"), names, "left_semi")
    return kept.dropDuplicates(names).drop(*names)
