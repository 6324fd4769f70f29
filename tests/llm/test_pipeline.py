"""The pipeline's stages in a row on the smallest tables."""

from collections import defaultdict

import corpus_pipeline

from entitylens.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs, docs.columns
    kept = {r.doc_id: r.text for r in before.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        rows = after.collect()
        assert after.columns == columns, name
        ids = [r.doc_id for r in rows]
        assert len(set(ids)) == len(ids) and set(ids) <= set(kept)
        if name == "quality_rules":
            ok = {i for i, t in kept.items() if not (x := quality.Text(t)).base_failed and not any(f(x) for f in quality.RULES.values())}
            assert set(ids) == ok
        if name == "substring_dedup":
            assert all(len(r.text) <= len(kept[r.doc_id]) and (r.n_chars == len(r.text)) for r in rows)
        kept = {r.doc_id: r.text for r in rows}
        before = after
    name, stage = corpus_pipeline.STAGES[-1]
    packed = stage(spark, before, SF).collect()
    assert {r.doc_id for r in packed} == set(kept)
    by = defaultdict(int)
    for r in packed:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 4096


def test_mixing_keeps_all_of_balanced_sources(spark):
    docs = spark.createDataFrame([(i, f"one two three {i}", f"s{i % 4}", 17) for i in range(80)], "doc_id long, text string, source string, n_chars long")
    made = corpus_pipeline.source_mixing(spark, docs, SF)
    assert sorted(r.doc_id for r in made.collect()) == list(range(80))


def test_run_is_the_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
