"""Documents written as lines: packed, and read back as they were."""

import os

from pyspark.sql import functions as F

from cueloom.plans import views as V
from cueloom.sources import sinks as K


def size(path):
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(path) for name in names)


def read(spark, path):
    line = F.split("value", "\t", 2)
    return spark.read.text(path).select("fmt", F.get(line, F.lit(0)).cast("long").alias("tid"), K.from_line(F.get(line, F.lit(1))).alias("text"))


def test_exports_are_packed_and_whole(spark, sf_dir, tmp_path):
    """Less than half the bytes of the documents, of which none is lost or changed."""
    words, path = V.words(spark, sf_dir), str(tmp_path / "export")
    K.write_transcript_export(words, path)
    made = K.transcript_export(words).select("fmt", F.col("tid").cast("long").alias("tid"), "text")
    assert read(spark, path).exceptAll(made).count() == 0 and made.exceptAll(read(spark, path)).count() == 0
    assert size(path) < made.agg(F.sum(F.octet_length("text"))).first()[0] / 2


def test_manifests_and_publications_as_lines_are_packed(spark, tmp_path):
    long = "a title " * 500
    segments = spark.range(40).select(F.lit("t").alias("tid"), F.col("id").cast("string").alias("seg_id"), F.lit(long).alias("title"), F.lit("").alias("description"))
    K.write_publication_text(segments, str(tmp_path / "publication"))
    K.write_manifests(segments.withColumn("source", F.concat("seg_id", F.lit(".mp4"))), str(tmp_path / "manifests"), lines=True)
    for name in ("publication", "manifests"):
        assert spark.read.text(str(tmp_path / name)).count() == 40
        assert size(tmp_path / name) < 40 * len(long) / 2


def test_odd_texts_on_one_line(spark, tmp_path):
    """Brackets, quotes, line ends, tabs, characters of two units, nothing and null."""
    odd = ["", "[", "]", "[]", '"', "]\n", "\n]", "a\r\nb\tc\\n", " \u0085\u0000", "😀]", "[\"é\"]", "\\", None]
    texts = spark.createDataFrame(list(enumerate(odd)), "k int, text string")
    texts.select(K.as_line(F.col("text")).alias("value")).write.options(**K.PACKED).text(str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == len(odd)
    lines = texts.select("k", "text", K.as_line(F.col("text")).alias("line"), F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "").alias("plain"))
    for row in lines.withColumn("again", K.from_line(F.col("line"))).collect():
        assert row["again"] == row["text"] and row["line"] == row["plain"]


def test_lines_are_made_without_a_search(spark):
    """A document's line is cut out by its ends, not found by a regular expression that looks at each of its places."""
    made = spark.range(1).select(K.as_line(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in made and made.count("StructsToJson") == 1
