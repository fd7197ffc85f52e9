import os

import pytest

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def test_stages_chain(spark):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    kept = []
    for i, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, DIR).cache()
        kept.append(out.count())
        if i < 4:
            assert out.columns == columns
        if i == 0:
            ids = {r.doc_id for r in out.select("doc_id").collect()}
            good = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
            assert sum(d in ids for d in good) >= 0.97 * len(good)
            assert before > kept[0]
        if i == 1:
            assert len({r.text.lower() for r in out.select("text").collect()}) == kept[1]
        docs = out
    assert kept[0] >= kept[1] >= kept[2] and kept[3] == kept[4]


def test_queries_have_stable_columns(spark):
    from terrasift.llm.queries import queries
    want = {"op1_repeated_spans": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words"], "op2_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"], "op8_nearest": ["query_id", "rank", "vec_id", "score"],
            "op9_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "op10_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]}
    found = queries()
    assert set(want) <= set(found) and len([n for n in found if n.startswith("op")]) == 10 and "pipeline" in found
    for n in ("op2_token_counts", "op9_exact_dedup", "op10_sentencepiece"):
        assert found[n](spark, DIR).columns == want[n]
