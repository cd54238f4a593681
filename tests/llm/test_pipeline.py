"""Each stage of the corpus pipeline against brute force on what its predecessor kept."""

import corpus_pipeline
from pyspark.sql import functions as F

from gaugeworks.operators.lineage import cut

from . import brute
from .test_tokens import check_packing

FOLDER = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
    start = spark.read.parquet(f"{FOLDER}/documents.parquet")
    junk = spark.createDataFrame([(-1, None, None, None, None), (-2, "!!! 123", "en", "s", 7), (None, None, None, None, None)], start.schema)
    docs = cut(start.unionByName(junk).withColumns({"spans": F.lit("mine"), "keep": F.lit("ours")}))
    columns = docs.columns
    language, lines, near, passages, packing = (f for _, f in corpus_pipeline.STAGES)

    kept = cut(language(spark, docs, FOLDER))
    assert kept.columns == columns and set(pairs(docs)) - set(pairs(kept)) == {(-1, None), (-2, "!!! 123"), (None, None)}
    before = pairs(kept)
    kept = cut(lines(spark, kept, FOLDER))
    assert kept.columns == columns and dict(pairs(kept)) == {k: v[2] for k, v in brute.lines_kept(before).items()}
    assert kept.where(F.col("n_chars") != F.length("text")).count() == 0
    before = pairs(kept)
    kept = cut(near(spark, kept, FOLDER))
    assert kept.columns == columns and set(pairs(kept)) == {(k, t) for k, t in before if brute.groups(before)[k][1] == k}
    before = pairs(kept)
    kept = cut(passages(spark, kept, FOLDER))
    want = {k: t if len(w.split()) == n else w for (k, t), (n, w) in zip(before, brute.windows_removed(before).values(), strict=True)}
    assert kept.columns == columns and dict(pairs(kept)) == want
    assert kept.where("spans <> 'mine' OR keep <> 'ours'").count() == 0
    packed = packing(spark, kept, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == set(want) and check_packing(packed) > 0


def test_run_and_empty(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and check_packing(rows)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, FOLDER))
    assert docs.count() == 0
