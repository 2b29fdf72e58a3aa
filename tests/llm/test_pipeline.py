"""The corpus pipeline, stage by stage, on a small table."""

from __future__ import annotations

import hashlib
import struct

import public_tokenizers
import tiktoken

import corpus_pipeline
from convolake.llm import bpe, quality_rules
from convolake.storage import keep


def test_stages(spark, tmp_path):
    clean = [f"The quick fox number {i} walks along a quiet river bank and sees {i * 7} small boats\nthen it turns home {i}" for i in range(40)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[0], "en", "src0", 1), (101, "too short", "en", "src1", 9), (102, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, step = step, keep(stage(spark, step, str(tmp_path)), name)
        assert step.columns == docs.columns
        if name == "quality_rules":
            kept = quality_rules.ledger(before).filter(quality_rules.verdict()).count()
            assert step.count() == kept and step.filter("doc_id in (101, 102)").count() == 0
        if name == "line_dedup":
            assert step.filter("doc_id = 100").count() == 0
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Codec.load(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN).ranks, special_tokens={}
    )
    expected = []
    for r in step.collect():
        ids = library.encode_ordinary(r["text"])
        expected.append((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expected) and got
