"""Columns of the caller with the operators' own names, empty tables and null texts, through op1, op6 and the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boxwright.llm import decontamination, quality_rules
from tests.llm import reference
from tests.llm.test_documents import SCHEMA, corpus

CLASHES = ["_contamination", "contamination", "contamination_0", "_spans", "spans", "quality", "verdict", "_gone", "_kept", "component_id", "kept"]


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(corpus(seed=4, n=24), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars", *[F.col("doc_id").alias(c) for c in CLASHES])


@pytest.mark.parametrize("blocks", [100_000, 7])
def test_decontamination_keeps_the_callers_columns(spark, wide, blocks):
    rows = [(r["doc_id"], r["text"]) for r in wide.collect()]
    items = [(i, " ".join((t or "").split()[2:20])) for i, t in rows[:6]]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    clean = decontamination.decontaminate(wide, bench, block_windows=blocks)
    assert clean.columns == wide.columns
    got = clean.collect()
    assert {r["doc_id"] for r in got} == {x[0] for x in reference.contamination(rows, items) if not x[5]}
    assert all(r[c] == r["doc_id"] for r in got for c in CLASHES)
    found = decontamination.find_contamination(wide, bench, block_windows=blocks, out="hit")
    assert found.columns == [*wide.columns, "hit"] and all(r[c] == r["doc_id"] for r in found.collect() for c in CLASHES)


def test_quality_keeps_the_callers_column(wide):
    judged = quality_rules.quality_rules(wide)
    assert judged.columns == [*wide.columns, "quality_"] and all(r["quality"] == r["doc_id"] for r in judged.collect())


def test_stages_keep_the_callers_columns(spark, wide, tmp_path):
    spark.createDataFrame([(1, "nothing of this is in any of the texts that are here at all")], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (wide, wide.where("false"), wide.withColumn("text", F.lit(None).cast("string")).limit(5)):
            kept = stage(spark, docs, f"file://{tmp_path}")
            assert kept.columns == docs.columns, name
            assert all(r[c] == r["doc_id"] for r in kept.collect() for c in CLASHES), name
    assert {r["length"] for r in corpus_pipeline.STAGES[-1][1](spark, wide.withColumn("text", F.lit(None).cast("string")).limit(5), "").collect()} == {1}


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
