"""The pipeline's stages on small documents."""

import corpus_pipeline
from pyspark.sql import functions as F

from mutascale.llm import quality
from mutascale.llm.texts import read

SF_DIR = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = read(spark, SF_DIR, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_awkward_documents(spark):
    passage = " ".join(f"word{i}" for i in range(80))
    rows = [
        (1, passage, "en", "s", 1), (2, passage + " end", "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0),
        (None, passage, "en", "s", 1), (5, "unlike " + " ".join(f"other{i}" for i in range(300)) + " " + passage, "en", "s", 1), (1, passage, "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.without_near_duplicates(spark, docs, SF_DIR)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "None"]
    cut = {r.doc_id: r for r in corpus_pipeline.without_repeated_passages(spark, kept, SF_DIR).collect()}
    assert cut[5].text.endswith("other299") and cut[5].n_chars == len(cut[5].text) and cut[1].text == passage
    assert cut[3].text is None and cut[4].text == "" and cut[None].text == passage
    assert corpus_pipeline.mixed(spark, docs, SF_DIR).columns == docs.columns
    for stage in (s for _, s in corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_each_row_has_its_own_verdict(spark):
    docs = read(spark, SF_DIR, "documents")
    judged = quality.classify(docs, read(spark, SF_DIR, "labels")).select("doc_id", "posterior").orderBy("posterior").collect()
    (poor, worse), (good, best) = [r.doc_id for r in judged[:2]], [r.doc_id for r in judged[-2:]]
    same = F.when(F.col("doc_id").isin(poor, good), None).when(F.col("doc_id").isin(worse, best), 10**9).otherwise(F.col("doc_id"))
    texts = {r.doc_id: r.text for r in docs.filter(F.col("doc_id").isin(poor, good, worse, best)).collect()}
    kept = corpus_pipeline.good_quality(spark, docs.withColumn("doc_id", same), SF_DIR)
    assert kept.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in kept.filter("doc_id IS NULL OR doc_id = 1000000000").collect()]
    assert sorted(kept, key=str) == sorted([(None, texts[good]), (10**9, texts[best])], key=str)
