"""The pipeline on empty and awkward tables."""

from __future__ import annotations

from collections import Counter

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, digest string, score double"


@pytest.mark.parametrize("empty", [True, False])
def test_awkward_documents(spark, tmp_path, empty):
    """Null and repeated ids, null, empty and repeated texts, columns whose names the stages use themselves, no labels that fit."""
    import corpus_pipeline

    item = " ".join(f"item{i}" for i in range(20))
    texts = [None, "", "one two three four five six seven", "one two three four five six seven", f"before {item} after", "token = abcdefghij0123456789", "x " * 30_000, "y"]
    rows = [] if empty else [(i % 3 if i % 4 else None, t, "en", "s", len(t or ""), 5, "d", 0.5) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, "x"), (None, "y")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = Counter(r.doc_id for r in got if r.piece == 0)
    # of the null and the empty text one stays, of the two alike one, the one with the item goes
    assert sum(kept.values()) == (0 if empty else 5)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
