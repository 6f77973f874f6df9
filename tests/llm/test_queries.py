"""The registered queries: SQL twins, brute force, and the pipeline stage by stage."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from daywatch.llm.common import stored
from daywatch.llm.queries import ORACLE, QUERIES
from tests.compare import difference, duck
from tests.llm.test_dedup import near_truth

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), duck(SF), ORACLE[name]) is None


def test_all_are_registered():
    ten = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in ten) == list(range(1, 14))
    assert "pipeline" in entry.queries() and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), name)
        seen[name] = docs
        if name != "sentencepiece":
            assert docs.columns == columns
        if name in ("toxicity", "exact_dedup", "near_dedup"):
            assert docs.exceptAll(before).isEmpty() and not docs.isEmpty()
    rows = sorted((r.doc_id, r.text) for r in seen["exact_dedup"].collect())
    keep = sorted(i for i, _, _, kept in near_truth(rows, 5) if kept)
    assert sorted(r.doc_id for r in seen["near_dedup"].collect()) == keep
    last = seen["sentencepiece"]
    assert last.count() == seen["mix_sources"].count()
    assert last.filter("n_corrected > 0").isEmpty()


def test_pipeline_drops_toxic_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.filter("length(text) between 200 and 2000").orderBy("doc_id").first().asDict()
    insult = first["text"] + " You are scum, a worthless loser."
    planted = spark.createDataFrame(
        [{**first, "doc_id": 10 ** 9, "text": insult}, {**first, "doc_id": 10 ** 9 + 1}], docs.schema)
    left = corpus_pipeline.drop_toxic(spark, docs.unionByName(planted), SF)
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    assert 10 ** 9 not in ids and 10 ** 9 + 1 in ids
    marks = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic is not null")
    gone = docs.join(marks, "doc_id").filter(~docs.doc_id.isin(ids)).select("toxic").collect()
    assert gone and all(r.toxic == 1 for r in gone)
