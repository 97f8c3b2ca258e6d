import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from sparkmatch.llm import decontam, near_dup, quality, stages, toxicity  # noqa: E402


def test_stages_take_effect_and_equal_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows, kept = {r.doc_id: r.text for r in docs.collect()}, {}
    model = quality.train(docs, labels)
    for d, t in rows.items():
        if model.score(np.array([quality.features(t)]))[0] >= 0.7:
            kept[d] = t
    first = docs.where(docs.doc_id.isin(list(kept)))
    machine = toxicity.train(first, labels)
    score = machine.probability(toxicity.Scorer(machine)(list(kept.values())))
    kept = {d: t for (d, t), p in zip(kept.items(), score, strict=True) if p < 0.5}
    left = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    same = {r.doc_id: r.class_id for r in near_dup.classes(left).collect()}
    kept = {d: t for d, t in kept.items() if same[d] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaky = {list(kept)[i] for i, *_ in decontam.Index.build(items).search(list(kept.values()), 0.8)}
    got = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in got.collect()} == set(kept) - leaky
    assert set(docs.columns) < set(got.columns) and got.where("n_tokens is null").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "byte_bpe"]
    assert stages.STAGES is corpus_pipeline.STAGES


def test_stages_on_nulls_repeated_rows_clashing_names_and_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    odd = docs.selectExpr("*", "1 as score", "2 as `a.b`", "3 as vid", "4 as n_tokens").unionAll(docs.limit(2).selectExpr("*", "1", "2", "3", "4"))
    odd = odd.unionAll(spark.createDataFrame([(None, None, None, None, None, 1, 2, 3, 4), (900, "", "en", "web", 0, 1, 2, 3, 4)], odd.schema))
    for table in (odd, odd.limit(0)):
        for name, stage in stages.STAGES:
            got = stage(spark, table, sf)
            assert name == "byte_bpe" or got.columns == table.columns
            n = got.count()
            assert n <= table.count() and (name != "byte_bpe" or n == table.count())
