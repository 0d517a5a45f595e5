"""The pipeline's stages against plain statements of what each must leave."""

import pytest

import corpus_pipeline as pipeline
from cueloom.llm.common import table
from cueloom.llm.decontamination import contamination_report
from cueloom.llm.jaccard_join import near_duplicates


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, seen = table(spark, sf_dir, "documents"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append((name, docs))
    return dict(seen)


def test_columns(spark, sf_dir, stages):
    columns = table(spark, sf_dir, "documents").columns
    assert [f.columns for f in stages.values()] == [columns] * 4 + [[*columns, "shard", "slot", "moved"]]


def test_language_keeps_all_with_letters(spark, sf_dir, stages):
    documents = table(spark, sf_dir, "documents")
    assert stages["language_id"].count() == documents.where(documents["text"].rlike(r"\p{L}")).count()  # each of them shares n-grams with a profile


def test_one_document_of_each_group(stages):
    before, after = stages["language_id"], stages["near_duplicates"]
    classes = {r["doc_id"]: r["class_id"] for r in near_duplicates(before).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(classes.values()))


def test_decontaminated(spark, sf_dir, stages):
    before, after = stages["near_duplicates"], stages["decontamination"]
    clean = contamination_report(before, table(spark, sf_dir, "benchmark")).where("n_hit = 0")
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in clean.collect())


def test_mix_and_shards(stages):
    mixed, sharded = stages["mixing"], stages["sharding"]
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    sizes = [r["count"] for r in sharded.groupBy("shard").count().collect()]
    assert sum(sizes) == mixed.count() and max(sizes) - min(sizes) <= 1


def test_run(spark, sf_dir, stages):
    ran = pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, ran.select("doc_id", "shard").collect())) == sorted(map(tuple, stages["sharding"].select("doc_id", "shard").collect()))


def test_stages_of_odd_rows(spark, sf_dir):
    """Nulls in all columns, empty texts, repeated rows and columns that clash with what the operators add."""
    one = "seven words stand here and no more"
    rows = [(1, one, "en", "s"), (1, one, "en", "s"), (2, one, None, None), (None, "another text of a few words", "en", None), (3, None, None, None), (4, "", "en", "s"), (5, "!!! 1", "en", "s"), (6, "und noch ein Text", "de", "t")]
    schema = "doc_id long, text string, lang string, source string"
    clashing = ["score", "digest", "root", "size", "copies", "fingerprint", "n_hit", "__copy"]
    docs = spark.createDataFrame(rows, schema)
    docs = docs.selectExpr("*", *[f"'x' as {name}" for name in clashing])
    for name, stage in pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        assert made.columns == docs.columns, name
        docs = spark.createDataFrame(made.collect(), docs.schema)
        if name == "language_id":
            assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 1, 1, 2, 6]
        if name in ("near_duplicates", "decontamination"):
            assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 1, 6]
    assert {r["score"] for r in docs.collect()} == {"x"}
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name
