"""The pipeline's stages, each held against its own input."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from ..conftest import SF  # noqa: E402


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = (before, docs)
        if name != "pack_sequences":
            assert docs.columns == columns
    ids = lambda t: [r.doc_id for r in t.select("doc_id").collect()]
    before, after = kept["quality_rules"]
    assert set(ids(after)) < set(ids(before))
    before, after = kept["near_dedup"]
    text = {r.doc_id: r.text for r in before.collect()}
    assert len({text[i] for i in ids(after)}) == len(ids(after)) and {text[i] for i in ids(before)} >= {text[i] for i in ids(after)}
    before, after = kept["mask_secrets"]
    assert sorted(ids(before)) == sorted(ids(after))
    before, after = kept["mix_sources"]
    assert all(ids(after).count(i) <= 2 for i in set(ids(after))) and set(ids(after)) <= set(ids(before))
    before, after = kept["pack_sequences"]
    assert sum(r.piece == 0 for r in after.collect()) == before.count()
