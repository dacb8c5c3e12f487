from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from boxwright.llm import quality_rules
from tests.llm import reference
from tests.llm.test_documents import SCHEMA, corpus

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_against_plain_versions(spark, tmp_path):
    rows = corpus(seed=8)
    bench = [(1, " ".join(rows[7][1].split()[:40])), (2, "not in any text at all but long enough to be a window")]
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).select(*DOCUMENTS)
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality rules"](spark, docs, f"file://{tmp_path}").cache()
    verdict = {r["doc_id"] for r in quality_rules.quality_rules(docs).where(F.col("quality.kept")).collect()}
    assert {r["doc_id"] for r in kept.collect()} == verdict and kept.columns == DOCUMENTS

    lines = stages["line dedup"](spark, kept, f"file://{tmp_path}").cache()
    before = [(r["doc_id"], r["text"], r["source"]) for r in kept.collect()]
    bad = reference.boilerplate(before, 10)
    want = {i: "\n".join(x for x in t.split("\n") if x not in bad) for i, t, _ in before}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want and lines.columns == DOCUMENTS

    single = stages["near dedup"](spark, lines, f"file://{tmp_path}").cache()
    comps, _ = reference.near_duplicates(sorted(want.items()), 80)
    assert {r["doc_id"] for r in single.collect()} == set(comps.values()) and single.columns == DOCUMENTS

    clean = stages["decontamination"](spark, single, f"file://{tmp_path}").cache()
    left = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert {r["doc_id"] for r in clean.collect()} == {x[0] for x in reference.contamination(left, bench) if not x[5]} and clean.columns == DOCUMENTS

    pieces = defaultdict(int)
    for p in stages["packing"](spark, clean, f"file://{tmp_path}").collect():
        pieces[p["doc_id"]] += p["length"]
    assert set(pieces) == {r["doc_id"] for r in clean.collect()} and min(pieces.values()) > 0


def test_run(spark, tmp_path):
    rows = corpus(seed=9, n=20)
    spark.createDataFrame(rows, SCHEMA).select(*DOCUMENTS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "none of this occurs in the texts, it is only here to be looked for")], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() > 0
