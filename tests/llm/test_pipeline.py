"""The pipeline's stages against what their operators decide."""

from collections import Counter

import brute
import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        out[name] = (before.toPandas(), docs.toPandas())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name

    before, after = out["quality classifier"]
    assert set(after.doc_id) <= set(before.doc_id) and len(after) > 0.8 * len(before)

    before, after = out["SimHash near-dedup"]
    parts = brute.simhash_components(list(zip(before.doc_id, before.text)))
    assert sorted(after.doc_id) == sorted({c for _, _, c in parts})

    before, after = out["benchmark decontamination"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    marked = brute.decontamination(list(zip(before.doc_id, before.text)), [tuple(r) for r in items])
    assert sorted(after.doc_id) == sorted(r[0] for r in marked if not r[5])

    before, after = out["mixing sources to target weights"]
    copies = Counter(after.doc_id)
    assert set(copies) <= set(before.doc_id) and max(copies.values()) == 2

    before, after = out["sharding"]
    assert Counter(after.doc_id) == Counter(before.doc_id)
    sizes = after.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1


def test_run_is_the_stages_in_order(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "shard", "slot"} <= set(rows.columns)
    assert rows.select("shard", "slot").distinct().count() == rows.count()
    assert rows.filter(F.col("shard").isNull()).count() == 0
