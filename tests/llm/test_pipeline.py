"""The stages of the corpus pipeline, each against what its operator promises."""

import re

import numpy as np
import zlib

import corpus_pipeline
from recfuse.llm import packing, queries
from recfuse.llm.common import stored
from tests.llm.test_operators import ids_of, without_passages

SF_DIR = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = queries.documents(spark, SF_DIR)
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, SF_DIR), "test")
        assert docs.columns == columns
        kept[name] = (before.collect(), docs.collect())
    rules, join, repeats, secrets = (kept[n] for n, _ in corpus_pipeline.STAGES[:-1])
    assert 0 < len(rules[1]) < len(rules[0])
    assert {r["doc_id"] for r in join[1]} < {r["doc_id"] for r in join[0]}
    left = without_passages([r.asDict() for r in repeats[0]], corpus_pipeline.PASSAGE.length, corpus_pipeline.PASSAGE_WORDS)
    assert left == {(r["doc_id"], r["text"]): 1 for r in repeats[1]}
    assert not any(re.search(r"[0-9a-f]{32}", r["text"]) for r in secrets[1])
    ends = {r["doc_id"]: ids_of(r["text"], "word_bpe_49k.json", 1) for r in secrets[1]}
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sum(r["length"] for r in got) == sum(map(len, ends.values()))
    for r in got:
        piece = ends[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes()) and r["length"] <= packing.SEQUENCE
