"""Shards by histogram sort: laws on ordinary, hot, odd and empty tables."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from fixtures import DOC_SCHEMA, odd_documents, prose

from quorica.llm import sharding
from quorica.llm.common import prepared


def check(docs, rows, shards, slack):
    """Every row once, gapless slots, sizes right and near equal; returns the bytes of each shard."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs
    )
    slots, held = defaultdict(list), Counter()
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        held[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(held.values())
    largest = max((r.size for r in rows), default=0)
    assert all(abs(held[s] - total / shards) <= slack * total / shards + largest for s in range(shards))
    return held


def frame(spark, docs):
    prepared(spark)
    return spark.createDataFrame([(i, t, *[None] * 12) for i, t in docs], DOC_SCHEMA).repartition(3)


def report(spark, docs, **options):
    narrow = frame(spark, docs).select("doc_id", "text")
    made = sharding.sharded(narrow, **options)
    return made.selectExpr("row.doc_id", "size", "crc32(cast(coalesce(row.text, '') as binary)) as text_crc32",
                           "'bytes' as law", "shard", "slot", "null as grown_shard", "row.text").collect()


def mixed_docs(n=900):
    """A third of all rows share one text, some long texts, small groups of copies, repeated rows."""
    draw = random.Random(3)
    docs = [(i, "hot text of a third of all rows") for i in range(n // 3)]
    docs += [(1000 + i, prose(i % 200, draw.randint(0, 60))) for i in range(n // 3)]
    docs += [(5000 + i, prose(7000 + i, 800)) for i in range(8)]
    return docs + [(42, "same row")] * (n // 3)


@pytest.mark.parametrize("shards", [1, 3, 8])
@pytest.mark.parametrize("piece_rows, n_probes", [(1 << 20, 4096), (20, 16), (1, 2)])
def test_shards_are_even_and_every_row_has_a_slot(spark, shards, piece_rows, n_probes):
    docs = mixed_docs()
    rows = report(spark, docs, shards=shards, piece_rows=piece_rows, n_probes=n_probes)
    check(docs, rows, shards, 0.011)


def test_equal_texts_stay_together_but_for_the_cut_ones(spark):
    draw = random.Random(1)
    docs = [(i, prose(draw.randrange(2000), 30)) for i in range(6000)]
    rows = report(spark, docs)
    check(docs, rows, 8, 0.011)
    places = defaultdict(set)
    for r in rows:
        places[r.text].add(r.shard)
    assert all(len(p) == 1 for p in places.values())


def test_copies_of_a_third_are_cut_into_even_shards(spark):
    docs = mixed_docs(9000)
    held = check(docs, report(spark, docs), 8, 0.011)
    assert max(held.values()) < 1.05 * min(held.values())


def test_pieces_bound_the_rows_a_task_sorts(spark):
    keyed = spark.createDataFrame([(bytes([0] * 7 + [i % 3, i // 256, i % 256] + [0] * 14), 1) for i in range(3000)], "key binary, size long")
    stretches, cuts = sharding.refine(keyed, 4, 0.005, 50, 64)
    assert sum(s.rows for s in stretches) == 3000 and max(s.rows for s in stretches) <= 50
    cut = sharding.pieces(stretches, cuts, 50)
    assert [p.before for p in cut if p.low in {min(q.low for q in cut if q.shard == s) for s in range(4)}] == [0] * 4
    assert len(cut) >= 60


def test_odd_empty_and_few_rows(spark):
    odd = [(r[0], r[1]) for r in odd_documents()]
    rows = sharding.shard_report(frame(spark, odd)).collect()
    check(odd, rows, 8, 10)
    assert sharding.shard_report(frame(spark, [])).count() == 0
    few = [(1, "a"), (2, None)]
    check(few, sharding.shard_report(frame(spark, few)).collect(), 8, 10)


def test_reruns_agree(spark):
    docs = mixed_docs(300)
    runs = [Counter(map(tuple, sharding.shard_report(frame(spark, docs).repartition(n)).collect())) for n in (2, 5)]
    assert runs[0] == runs[1]


def test_written_shards_hold_all_rows_in_slot_order(spark, tmp_path):
    docs = frame(spark, mixed_docs(300)).withColumn("slot", sharding.F.lit("taken"))
    sharding.write_shards(docs, str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(back.columns) == sorted([*docs.columns, "slot_", "shard"])
    assert back.drop("slot_", "shard").exceptAll(docs).count() == 0 and back.count() == docs.count()
    for file in (tmp_path / "shards").glob("shard=*/*.parquet"):
        slots = [r.slot_ for r in spark.read.parquet(str(file)).collect()]
        assert slots == sorted(slots)
