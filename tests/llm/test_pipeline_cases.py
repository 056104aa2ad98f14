"""The pipeline on awkward tables."""

import random

import corpus_pipeline


def test_empty_tables_null_ids_repeats_and_other_columns(spark, tmp_path):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b = prose(120), prose(150)
    rows = [(1, a), (1, a), (2, b), (3, b), (None, prose(90)), (4, None), (5, ""), (6, "short"), (7, prose(9000))] + [(10 + i, prose(100)) for i in range(30)]
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", "y") for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, slot int, spans string, key string"
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(10 + i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    for name, frame in (("full", docs), ("none", docs.limit(0))):
        frame.coalesce(1).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.coalesce(1).write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, str(tmp_path / "full"))
        assert kept.columns == docs.columns and kept.count() <= before.count(), name
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    assert ids == sorted([(False, i) for i in [1, 2, 7, *range(10, 40)]] + [(True, None)])
