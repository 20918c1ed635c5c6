import corpus_pipeline
from wattspark.llm import registered
from tests.parity import connection, difference

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    assert difference(registered.queries()[name](spark, SF), connection(SF), registered.oracle_sql()[name]) is None


def test_every_operator_is_registered():
    names = registered.queries()
    assert {n.split("_")[0] for n in names if n != "pipeline"} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_stages_keep_columns_and_decide(spark):
    odd = spark.createDataFrame([(10**6, "12 !! 34", "en", "src0", 8), (10**6 + 1, None, "en", "src0", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).unionByName(odd)
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, SF)
        assert after.columns == docs.columns, name
        seen = after.checkpoint() if spark.conf.get("spark.checkpoint.dir", None) else after.persist()
        if name == "language":
            ids = {r.doc_id for r in seen.collect()}
            assert not ids & {10**6, 10**6 + 1} and len(ids) >= 195
        if name in ("exact", "near"):
            texts = [r.t for r in seen.select(F.translate("text", " \t\n\x0b\x0c\r", "").alias("t")).collect()]
            assert len(texts) == len(set(texts))
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert last.count() == seen.count()
