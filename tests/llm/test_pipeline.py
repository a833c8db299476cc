"""The pipeline and the registered queries on the smallest tables."""

import collections

import compare
import pytest
from pyspark.sql import functions as F

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_warc", "op2_url_filter"])
def test_sql(spark, name):
    compare.same_rows(__spark_entry__.queries()[name](spark, SF), compare.connect(SF), __spark_entry__.oracle_sql()[name])


@pytest.mark.parametrize("name,table,key", [("op3_lm_scores", "documents", "doc_id"), ("op4_toxicity", "documents", "doc_id"), ("op6_near_duplicates", "documents", "doc_id"), ("op7_bpe", "documents", "doc_id"), ("op8_language", "documents", "doc_id"), ("op10_vector_duplicates", "embeddings", "vec_id")])
def test_one_row_each(spark, name, table, key):
    got = collections.Counter(r[0] for r in __spark_entry__.queries()[name](spark, SF).select(key).collect())
    assert got == collections.Counter(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(40).withColumns({"row": F.lit(1), "score": F.lit(2), "lang_pred": F.lit("x"), "row_key": F.lit("y"), "_id": F.lit(3)})
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "a " * 50_000, "en", "s", 1)], docs.schema)
    extra = extra.unionByName(odd, allowMissingColumns=True)
    extra = extra.union(extra.limit(5))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, SF)
        assert out.columns == extra.columns and out.count() <= extra.count()
        assert stage(spark, extra.limit(0), SF).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "packing"]
    odd_packed = corpus_pipeline.STAGES[-1][1](spark, extra, SF).collect()
    assert len({(r["doc_id"], r["sequence_id"], r["offset"]) for r in odd_packed}) == len(odd_packed) >= extra.count()


def test_pipeline_against_brute_force(spark):
    """Which documents leave the pipeline: scores of its operators applied one document at a time, groups by all pairs."""
    import corpus_pipeline
    import numpy as np
    import public_tokenizers
    from test_llm_operators import brute_groups
    from tokenizers import Tokenizer

    from lexiloom.llm import langid, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = [r for r in docs.collect() if model.score(r["text"]) < corpus_pipeline.TOXIC_FROM]
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    assert len(clean & {r["doc_id"] for r in rows}) >= 0.95 * len(clean & {r["doc_id"] for r in docs.collect()})
    known = langid.fit(spark.createDataFrame(rows, docs.schema))
    kept = []
    for r in rows:
        if langid.has_letter(r["text"]):
            (lang,), (score,) = known.predict(langid.features(r["text"])[None])
            if lang != langid.UNDETERMINED and score >= corpus_pipeline.LANGUAGE_FROM:
                kept.append((r["doc_id"], r["text"]))
    texts = dict(kept)
    one_each = {least for _, _, least in brute_groups(kept, 80)}
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == one_each
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d in one_each:
        pieces = sorted((r for r in packed if r["doc_id"] == d), key=lambda r: r["start"])
        assert np.frombuffer(b"".join(r["ids"] for r in pieces), "<u4").tolist() == [*tok.encode(texts[d] or "", add_special_tokens=False).ids, 1]


def test_one_of_each_group_stays(spark):
    import corpus_pipeline

    text = " ".join(f"w{k}" for k in range(50))
    rows = [(3, text), (2, text), (2, text), (5, text + " more"), (9, "other words here"), (None, "some text of its own"), (7, None), (7, None)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got.collect()) == [-1, 2, 7, 9]
