"""The pipeline's stages against plain versions of what they decide."""

import corpus_pipeline
from graphloom.llm.packing import ByteBpe
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = corpus_pipeline.table(spark, SF, "documents")
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{k}")
        after = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        steps.append((docs.collect(), after.collect()))
        docs = after
    # Exact copies: the largest doc_id of each text stays.
    before, after = steps[2]
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    want = {}
    for r in before:
        want[lower(r["text"])] = max(want.get(lower(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(want.values())
    # Near copies: the smallest doc_id of each component stays.
    before, after = steps[3]
    parts = brute([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, n, c in parts if d == c)
    # Packing: every token of what is left, once.
    before, after = steps[4]
    encode = ByteBpe()
    assert sum(r["length"] for r in after) == sum(len(encode(r["text"] or "")) + 1 for r in before)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
