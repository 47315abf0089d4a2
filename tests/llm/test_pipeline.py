import importlib.util
import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tillstats.llm import queries

DATA = "/root/testdata/sf0.001"


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert importlib.util.find_spec("corpus_pipeline") is not None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, seen[-1], DATA).write.parquet(out)
        seen.append(spark.read.parquet(out))
    toxic, near, repeats, packed = seen[1:]
    assert all(s.columns == columns for s in seen[1:4])
    ids = [{r[0] for r in s.select("doc_id").collect()} for s in seen]
    assert ids[1] < ids[0] and ids[2] <= ids[1] and ids[3] == ids[2] == ids[4]
    assert repeats.where("length(text) <> n_chars").count() == 0
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_stages_without_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_odd_rows(spark, docs, tmp_path):
    docs.unionByName(docs.limit(3)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
