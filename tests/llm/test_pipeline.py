"""The pipeline against a brute-force version of every stage."""

import duckdb
import tiktoken
from fixtures import DOC_SCHEMA, components_of, odd_documents, plain_all_spans, plain_masked, plain_patterns

import corpus_pipeline
import public_tokenizers
from quorica.llm.bpe import Vocabulary
from quorica.llm.queries import TOKEN_RANKS
from quorica.llm.sql import MIX_CTES, QUALITY_CTES

SF_DIR = "/root/testdata/sf0.001"


def test_rows_of_a_whole_run(spark):
    con = duckdb.connect()
    docs = con.execute(f"SELECT * FROM '{SF_DIR}/documents.parquet'").df()  # noqa: F841
    kept = con.execute(f"WITH {QUALITY_CTES} SELECT doc_id FROM judged WHERE kept").df()["doc_id"]
    docs = docs[docs["doc_id"].isin(kept)]
    root = components_of(sorted(zip(docs["doc_id"], docs["text"])), 5)
    docs = docs[[root[i] == i for i in docs["doc_id"]]]
    patterns = plain_patterns(docs["text"])
    docs = docs.assign(text=[plain_masked(t, plain_all_spans(t, patterns)) for t in docs["text"]])
    copied = con.execute(f"WITH {MIX_CTES} SELECT doc_id, copies FROM copied").fetchall()
    text = dict(zip(docs["doc_id"], docs["text"]))
    ranks = Vocabulary.load(public_tokenizers.path(TOKEN_RANKS), "").ranks
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [str((i, coder.encode_ordinary(text[i]), text[i])) for i, n in copied for _ in range(n)]
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(str((r.doc_id, r.ids, r.text)) for r in got) == sorted(want)
    assert len(want) > 50


def test_stages_take_odd_and_empty_documents(spark, tmp_path):
    for name, rows in (("odd", odd_documents()), ("empty", [])):
        docs = spark.createDataFrame(rows, DOC_SCHEMA)
        for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}{place}")
            out = stage(spark, docs, SF_DIR)
            if place < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
