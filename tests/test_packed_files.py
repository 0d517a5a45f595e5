"""Documents in packed files: smaller, and read back under their own names as they were."""

import gzip
import os

import pytest

from cueloom.plans import queries as Q
from cueloom.sources import documents as N
from cueloom.sources import readers as S


def test_packed_files_are_read_as_what_they_hold(spark, tmp_path):
    rows = [("a 1%+é.json", "long " * 500), ("b.gz", ""), ("c.json", None), (".d.json", "x")]
    path = str(tmp_path / "packed")
    N.write_documents(spark.createDataFrame(rows, "name string, content string"), path, packed=True)
    assert sorted(os.listdir(path)) == sorted(f"{name}.gz" for name, _ in rows) and os.path.getsize(f"{path}/a 1%+é.json.gz") < 100
    read = lambda **how: {r["name"]: bytes(r["content"]) for r in N.read_documents(spark, path, **how).collect()}
    assert read(unpack=True) == {name: (text or "").encode() for name, text in rows}
    assert set(read(unpack=True, suffix=".json")) == {"a 1%+é.json", "c.json", ".d.json"}
    assert gzip.decompress(read()["c.json.gz"]) == b""
    with pytest.raises(Exception, match="parts are of files as they are"):
        read(unpack=True, content="parts")


def test_names_of_packed_files(spark, tmp_path):
    for rows in ([("a", "x"), ("a", "y")], [(None, "x")], [("y" * 254, "x")]):
        with pytest.raises(Exception, match="different names|can't be named"):
            N.write_documents(spark.createDataFrame(rows, "name string, content string"), str(tmp_path / "out"), packed=True)


def test_readers_take_plain_and_packed_files(spark, tmp_path):
    """By the data source and, for patterns, by Spark's own reader."""
    text = '{"language": "en", "words": [{"word": "%s", "t0": 0.5, "t1": 1.0}]}'
    (tmp_path / "a+b %20.json").write_text(text % "one")
    (tmp_path / "c.d.json.gz").write_bytes(gzip.compress((text % "two").encode()))
    (tmp_path / "e.txt.gz").write_bytes(gzip.compress(b"no"))
    for path in (str(tmp_path), f"{tmp_path}*"):
        good, bad = S.read_transcripts(spark, path)
        assert {(r["tid"], r["word"]) for r in good.collect()} == {("a+b %20", "one"), ("c.d", "two")} and bad.count() == 0


def test_transcript_files_are_packed(spark, sf_dir):
    path = Q.transcript_files(spark, sf_dir).removeprefix("file:")
    names = os.listdir(path)
    assert names and all(name.endswith(".json.gz") for name in names)
    whole = sum(r["n"] for r in N.read_documents(spark, path, unpack=True).selectExpr("octet_length(content) n").collect())
    assert sum(os.path.getsize(f"{path}/{name}") for name in names) < whole / 3
