"""The pipeline: stages take effect, keep columns, and chain to the same rows as run()."""

import corpus_pipeline
from siltstone.llm import packing, quality_rules, simhash


def test_stages(spark, sf, tmp_path):
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
    assert [k.columns for k in kept[:-1]] == [first.columns] * 3
    rules, toxic, distinct, packed = kept
    by_rules = {r["doc_id"] for r in quality_rules.op3_quality_rules(spark, sf).where("kept").collect()}
    assert {r["doc_id"] for r in rules.collect()} == by_rules
    clean = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").join(rules, "doc_id")
    assert clean.join(toxic, "doc_id", "left_anti").count() <= 0.02 * clean.count()
    classes = {r["component_id"] for r in simhash.near_duplicates(toxic).collect()}
    assert sorted(r["doc_id"] for r in distinct.collect()) == sorted(classes)
    assert {r["doc_id"] for r in packed.collect()} == classes
    total = packing.tokenized_pieces(distinct, packing.default_vocabulary()).agg({"length": "sum"}).first()[0]
    assert packed.agg({"length": "sum"}).first()[0] == total
    assert corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").exceptAll(packed.drop("sequence_id", "offset")).count() == 0


def test_odd_rows_and_empty_tables(spark, tmp_path):
    body = " ".join(f"Word{k} and other{k + 7} text." for k in range(40))
    rows = [(1, None), (2, ""), (None, body), (4, body), (4, body), (5, "x " * 60), (6, " ".join(f"tree{k} {k % 3}house" for k in range(9_000)))]
    schema = "doc_id bigint, text string"
    for name, docs in (("odd", rows), ("empty", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(docs, schema).selectExpr("*", "'en' as lang", "'s' as source", "cast(0 as bigint) as n_chars").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(4, 1, 0)] if docs else [], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert {r["doc_id"] for r in got} == ({4, 6} if docs else set())
        if docs:
            assert sum(r["doc_id"] == 4 for r in got) == 1 and sum(r["doc_id"] == 6 for r in got) > 1
