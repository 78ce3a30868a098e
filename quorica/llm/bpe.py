"""Byte-level BPE over distinct words: each distinct word of the corpus is encoded once.

1. Texts are split into pre-tokens in blocks of documents. Where the pattern lets a space start a word, texts are cut there first,
   and only the distinct pieces of a block meet the pattern. A block keeps its distinct words, the words of every distinct
   piece, and for every document the numbers of its pieces in order; frequent pieces have the short numbers.
2. The words of all blocks are shuffled by their hash, so that equal words meet. Each is merged once and its ids go
   back to the blocks that hold it. A frequent word is one entry per block, so no word makes a task large.
3. Every block puts the ids in the order of its positions. Blocks are stored in buckets, so only ids move to them.

Merging takes the pair of the lowest rank, the leftmost of equals, until none is left: all words of a bucket a step at a time in
arrays, words of more than LONG_WORD bytes one by one with a heap. Decoding joins each id with the bytes of its token; this
table has one row per rank of the vocabulary, which bounds it.
"""

from __future__ import annotations

import base64
import heapq
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorica.llm.common import bucketed, mapped

BLOCK_CHARS = 12_000_000
BUCKET_BYTES = 4_000_000
LEAST_BUCKETS = 48
LONG_WORD = 64
_BLOCKS = (
    "block long, words binary, word_bytes long, lengths binary, piece_words binary, piece_sizes binary, "
    "doc_ids array<string>, sizes array<int>, places binary"
)
_SHARES = "bucket int, block long, words binary, lengths binary, slots binary"
_IDS = "block long, slots binary, counts binary, ids binary"
_NO_RANK = np.iinfo(np.int64).max
# A space between two characters that aren't white, and all that counts as white.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace()]
# A character that no text holds marks the first piece of a text, before which there is no space.
_FIRST = "\ud800"


@dataclass(frozen=True)
class Vocabulary:
    """Byte strings by rank and the pattern that splits texts before merging."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    @property
    def space_starts_word(self) -> bool:
        """Whether a space after a character that isn't white always starts the word of the character behind it.

        Then texts may be cut there without a look at the rest. Known of the patterns that take `` ?`` before runs of
        letters, of digits and of other characters, and `\\s+(?!\\S)` before `\\s+`.
        """
        runs = (r"| ?\p{L}+|", r"| ?\p{N}+|", r"| ?[^\s\p{L}\p{N}]+|", r"|\s+(?!\S)|\s+")
        return self.pattern.startswith("'s|") and self.pattern.endswith("".join(r[:-1] for r in runs[:3]) + runs[3])

    def tokens(self) -> Table:
        """The bytes of every id."""
        return Table.of({rank: token for token, rank in self.ranks.items()})

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the 256 bytes, then every pair of tokens that is a token itself: key left << 32 | right, and rank, by key."""
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys)
        single = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        return single, keys[order], np.array(rank, np.int64)[order]


@dataclass(frozen=True)
class Table:
    """Byte strings by id in one array; size -1 where an id has none."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, entries: dict[int, bytes]) -> Table:
        size = np.full(max(entries, default=-1) + 1, -1, np.int64)
        for i, value in entries.items():
            size[i] = len(value)
        length = np.maximum(size, 0)
        data = b"".join(entries[i] for i in sorted(entries))
        return cls(np.frombuffer(data, np.uint8), np.cumsum(length) - length, size)

    def joined(self, ids: np.ndarray) -> bytes | None:
        """The strings of the ids one after another; None if one of the ids has none."""
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.size):
            return None
        size = self.size[ids]
        return None if (size < 0).any() else self.flat[_spread(self.start[ids], size)].tobytes()


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in groups of seven bits, the last group of a value without its top bit."""
    values = np.asarray(values, np.uint32)
    lengths = 1 + sum((values >= (1 << bits)).astype(np.int64) for bits in (7, 14, 21, 28))
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint8)
    for k in range(5):
        has = lengths > k
        more = (lengths[has] > k + 1).astype(np.uint8) << np.uint8(7)
        out[starts[has] + k] = ((values[has] >> np.uint32(7 * k)) & np.uint32(127)).astype(np.uint8) | more
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    values = np.zeros(len(ends), np.int64)
    for k in range(5):
        has = ends - starts >= k
        values[has] |= (raw[starts[has] + k].astype(np.int64) & 127) << (7 * k)
    return values


def pack_slots(slots: np.ndarray) -> bytes:
    """Slots that were dealt in the order of their first use: 0 for a first use, else the slot plus 1."""
    slots = np.asarray(slots, np.int64)
    highest = np.maximum.accumulate(slots)
    first = np.diff(highest, prepend=-1) > 0
    return pack(np.where(first, 0, slots + 1))


def unpack_slots(data: bytes) -> np.ndarray:
    coded = unpack(data)
    first = coded == 0
    return np.where(first, np.cumsum(first) - 1, coded - 1)


def _press(*parts: bytes) -> list[bytes]:
    """Parts of a row that is shuffled; short codes and words shrink little by what Spark does to shuffled rows."""
    with_zstd = zstandard.ZstdCompressor(level=3)
    return [with_zstd.compress(part) for part in parts]


def _unpress(*parts: bytes) -> list[bytes]:
    return [zstandard.decompress(part) for part in parts]


def _cut(data: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _pieces(text: str) -> list[str]:
    """The text cut at the spaces that surely start a word, without these spaces."""
    if any(f" {c}" in text or f"{c} " in text for c in _WHITE if c in text):
        return _CUT.split(text)
    return text.split(" ")


def _split_into_blocks(vocabulary: Vocabulary):
    pattern, by_space = vocabulary.pattern, vocabulary.space_starts_word

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = regex.compile(pattern)
        task, number = TaskContext.get().partitionId(), count()
        pieces: defaultdict[str, int] = defaultdict(count().__next__)
        ids, sizes, places, chars = [], [], [], 0

        def block() -> pd.DataFrame:
            slots: defaultdict[str, int] = defaultdict(count().__next__)
            piece_words, piece_sizes = [], []
            numbers, by_use = np.concatenate(places), list(pieces)
            order = np.argsort(-np.bincount(numbers, minlength=len(by_use)), kind="stable")
            for i in order.tolist():
                piece = by_use[i]
                whole = piece[1:] if piece[:1] == _FIRST else " " + piece
                own = [slots[word] for word in split.findall(whole)]
                piece_words += own
                piece_sizes.append(len(own))
            words = [word.encode("utf-8", "surrogatepass") for word in slots]
            row = (
                task << 32 | next(number),
                b"".join(words),
                sum(map(len, words)),
                pack(np.fromiter(map(len, words), np.int64, len(words))),
                pack_slots(np.array(piece_words, np.int64)),
                pack(np.array(piece_sizes, np.int64)),
                ids,
                sizes,
                pack(np.argsort(order)[numbers]),
            )
            return pd.DataFrame([row], columns=[c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                found = _pieces(text or "") if by_space else [text or ""]
                found[0] = _FIRST + found[0]
                at = np.fromiter(map(pieces.__getitem__, found), np.uint32, len(found))
                ids.append(doc_id)
                sizes.append(len(at))
                places.append(at)
                chars += len(text or "")
                if chars >= BLOCK_CHARS:
                    yield block()
                    pieces = defaultdict(count().__next__)
                    ids, sizes, places, chars = [], [], [], 0
        if ids:
            yield block()

    return run


def _deal_words(buckets: int):
    """Words of a block to the buckets of their hashes, one row per block and bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, data, lengths in zip(batch["block"], batch["words"], batch["lengths"]):
                words = _cut(data, unpack(lengths))
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                bucket = (hashes % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                rows = []
                for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    if len(part):
                        own = [words[i] for i in part]
                        size = np.fromiter(map(len, own), np.int64, len(own))
                        steps = np.diff(part, prepend=0)
                        rows.append((bucket[part[0]], block, *_press(b"".join(own), pack(size), pack(steps))))
                yield pd.DataFrame(rows, columns=["bucket", "block", "words", "lengths", "slots"])

    return run


def _ranks_of(left: np.ndarray, right: np.ndarray, keys: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    wanted = left << 32 | right
    if not len(keys):
        return np.full(len(wanted), _NO_RANK)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, ranks[at], _NO_RANK)


def merge_short(words: list[bytes], single: np.ndarray, keys: np.ndarray, ranks: np.ndarray) -> list[np.ndarray]:
    """Ids of every word; in each step every word merges its pair of the lowest rank, the leftmost of equals."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
    names = np.array([i for i, word in enumerate(words) if word], np.int64)
    ids = single[np.frombuffer(b"".join(words), np.uint8)]
    sizes = np.fromiter((len(word) for word in words if word), np.int64, len(names))
    owner = np.repeat(np.arange(len(names)), sizes)
    rank = np.full(len(ids), _NO_RANK)
    rank[:-1] = np.where(owner[1:] == owner[:-1], _ranks_of(ids[:-1], ids[1:], keys, ranks), _NO_RANK)
    while len(names):
        starts = np.cumsum(sizes) - sizes
        least = np.minimum.reduceat(rank, starts)
        done = least == _NO_RANK
        if done.any():
            for i in np.flatnonzero(done).tolist():
                out[names[i]] = ids[starts[i] : starts[i] + sizes[i]]
            stay = np.repeat(~done, sizes)
            ids, rank = ids[stay], rank[stay]
            names, sizes, least = names[~done], sizes[~done], least[~done]
            owner = np.repeat(np.arange(len(names)), sizes)
            if not len(names):
                break
        hits = np.flatnonzero(rank == least[owner])
        at = hits[np.concatenate([[True], owner[hits][1:] != owner[hits][:-1]])]
        ids[at] = least
        stay = np.ones(len(ids), bool)
        stay[at + 1] = False
        ids, rank, owner = ids[stay], rank[stay], owner[stay]
        sizes = sizes - 1
        at = at - np.arange(len(at))
        # The merged token has a new pair on either side, unless its word ends there.
        for left in (at, at - 1):
            inside = (left >= 0) & (left + 1 < len(ids))
            place = left[inside]
            made = _ranks_of(ids[place], ids[place + 1], keys, ranks)
            rank[place] = np.where(owner[place] == owner[place + 1], made, _NO_RANK)
        rank[-1] = _NO_RANK
    return out


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for one word, by a heap over its pairs: n log n for a word of n bytes."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def push(i: int) -> None:
        if i >= 0 and after[i] < n:
            end = after[after[i]] if after[i] < n else n
            rank = ranks.get(word[i:end])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end))

    for i in range(n):
        push(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        # An entry counts only while its left token starts there and its pair still ends there.
        if after[i] < 0 or after[i] >= n or after[after[i]] != end:
            continue
        gone = after[i]
        after[i] = end
        after[gone] = -1
        if end < n:
            before[end] = i
        push(i)
        push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def merge_words(words: list[bytes], ranks: dict[bytes, int], pairs: tuple) -> list[np.ndarray]:
    """Ids of every word; a word that is a token is that token."""
    out = [np.array([rank], np.int64) if (rank := ranks.get(word)) is not None else None for word in words]
    short = [i for i, word in enumerate(words) if out[i] is None and len(word) <= LONG_WORD]
    for i, ids in zip(short, merge_short([words[i] for i in short], *pairs)):
        out[i] = ids
    return [np.array(merge_long(word, ranks), np.int64) if ids is None else ids for word, ids in zip(words, out)]


def _encode_words(held):
    """All words of a bucket: each distinct one is merged once; ids return to every block that has it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ranks, pairs = held.value
        known: defaultdict[bytes, int] = defaultdict(count().__next__)
        at = []
        for data, lengths in map(_unpress, group["words"], group["lengths"]):
            words = _cut(data, unpack(lengths))
            at.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        merged = merge_words(list(known), ranks, pairs)
        counts = np.fromiter(map(len, merged), np.int64, len(merged))
        flat, first = np.concatenate(merged), np.cumsum(counts) - counts
        rows = []
        for block, slots, own in zip(group["block"], group["slots"], at):
            ids = flat[_spread(first[own], counts[own])]
            rows.append((block, slots, *_press(pack(counts[own]), _narrow(ids, len(ranks)).tobytes())))
        return pd.DataFrame(rows, columns=["block", "slots", "counts", "ids"])

    return run


def _narrow(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    return ids.astype(np.uint16 if vocabulary <= 1 << 16 else np.uint32)


def _reassemble(vocabulary: int, finish):
    """Ids of all documents of a block in order; `finish` makes a row from the ids of one."""

    def run(words: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        rows = []
        kind = _narrow(np.zeros(0, np.uint32), vocabulary).dtype
        for row in blocks.itertuples():
            amount = np.zeros(len(unpack(row.lengths)), np.int64)
            shares = (_unpress(w.slots, w.counts, w.ids) for w in words.itertuples())
            parts = [(np.cumsum(unpack(slots)), unpack(counts), np.frombuffer(ids, kind)) for slots, counts, ids in shares]
            for slots, counts, _ in parts:
                amount[slots] = counts
            first = np.cumsum(amount) - amount
            flat = np.zeros(int(amount.sum()), np.int32)
            for slots, counts, ids in parts:
                flat[_spread(first[slots], counts)] = ids
            # Tokens of the distinct pieces, then pieces in the order of each document.
            of_piece = unpack_slots(row.piece_words)
            upto = np.concatenate([[0], np.cumsum(amount[of_piece])])
            flat = flat[_spread(first[of_piece], amount[of_piece])]
            ends = np.cumsum(unpack(row.piece_sizes))
            ends = upto[np.concatenate([[0], ends]).astype(np.int64)]
            first, amount = ends[:-1], np.diff(ends)
            places = unpack(row.places)
            ends = np.cumsum(row.sizes)
            for doc_id, start, end in zip(row.doc_ids, ends - row.sizes, ends):
                at = places[start:end]
                rows.append((doc_id, *finish(flat[_spread(first[at], amount[at])])))
        return pd.DataFrame(rows)

    return run


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges [start, start + length) one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _encoded(docs: DataFrame, vocabulary: Vocabulary, finish, schema: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((vocabulary.ranks, vocabulary.pairs()))
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    made = texts.mapInPandas(_split_into_blocks(vocabulary), _BLOCKS)
    blocks = bucketed(made, "blocks", "block", -(-size // BLOCK_CHARS))
    load = blocks.agg(F.coalesce(F.sum("word_bytes"), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-load // BUCKET_BYTES))
    shares = blocks.select("block", "words", "lengths").mapInPandas(_deal_words(buckets), _SHARES)
    encoded = shares.groupBy("bucket").applyInPandas(_encode_words(held), _IDS)
    bodies = blocks.select("block", "lengths", "piece_words", "piece_sizes", "doc_ids", "sizes", "places")
    placed = (
        encoded.groupBy("block")
        .cogroup(bodies.groupBy("block"))
        .applyInPandas(_named(_reassemble(len(vocabulary.ranks), finish), schema), f"doc_id string, {schema}")
    )
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))


def _named(run, schema: str):
    columns = ["doc_id", *(c.split()[0] for c in schema.split(", "))]
    return lambda words, blocks: run(words, blocks).set_axis(columns, axis=1)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids) of every row of `docs`, as the whole text encoded in order without special tokens.

    A null or empty text has no ids, an empty table an empty result. A null doc_id stays null, repeated rows give repeated
    results, other columns are ignored. A text of any length stays in one block; words of any length are merged whole.
    """
    return _encoded(docs, vocabulary, lambda ids: (ids,), "ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """`encoded` (doc_id, ids) with the column `decoded`: the bytes of the tokens in order.

    Null ids give null bytes, and so do ids of which one is negative, null or not of the vocabulary.
    """
    table = encoded.sparkSession.sparkContext.broadcast(vocabulary.tokens())

    def bytes_of(ids) -> bytes | None:
        if ids is None or ids.dtype.kind != "i":
            return table.value.joined(np.empty(0, np.int64)) if ids is not None and not len(ids) else None
        return table.value.joined(ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(decoded=[bytes_of(ids) for ids in batch["ids"]])

    return mapped(encoded.select("doc_id", "ids"), run, "ids array<int>, decoded binary")


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, decoded): encoded as by `encode`, and decoded again from these ids in the same task."""
    table = docs.sparkSession.sparkContext.broadcast(vocabulary.tokens())
    return _encoded(docs, vocabulary, lambda ids: (ids, table.value.joined(ids)), "ids array<int>, decoded binary")


def round_trip_report(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; ids and bytes stay where they were made."""
    numbers = Table.of({rank: b"%d " % rank for rank in vocabulary.ranks.values()})
    held = docs.sparkSession.sparkContext.broadcast((vocabulary.tokens(), numbers))

    def digests(ids: np.ndarray) -> tuple[int, str, str]:
        tokens, decimals = held.value
        listed = decimals.joined(ids)[:-1]
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(tokens.joined(ids)).hexdigest()

    return _encoded(docs, vocabulary, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
