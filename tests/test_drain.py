"""Draining a folder of files: retries, conflicts, copies, and how much of the archive a run reads."""

import os

import pytest
from pyspark.sql import functions as F

from cueloom.streaming import drain as D


@pytest.fixture
def folder(spark, tmp_path):
    class Folder:
        def __init__(self):
            self.inputs = tmp_path / "in"
            self.inputs.mkdir()
            self.clock = 10**18

        def put(self, name, text):
            path = self.inputs / name
            path.parent.mkdir(exist_ok=True)
            path.write_text(text)
            self.clock += 10**9
            os.utime(path, ns=(self.clock, self.clock))

        def run(self, **options):
            rows = D.drain_folder(spark, str(self.inputs), str(tmp_path / "archive"), str(tmp_path / "log"), least=3, **options).collect()
            return {os.path.relpath(r["path"], self.inputs): (r["status"], r["reason"]) for r in rows}

        def archived(self):
            return sorted(r["name"] for r in spark.read.schema(D.STORED).parquet(str(tmp_path / "archive")).collect())

    return Folder()


def test_inputs_are_tried_again_once_they_change(folder):
    for name, text in (("a", "xxx"), ("b", "xxx"), ("c", ""), ("d", "yyyy")):
        folder.put(name, text)
    assert folder.run() == {"a": ("drained", None), "b": ("duplicate", None), "c": ("skipped", None), "d": ("drained", None)}
    assert folder.run() == {}
    folder.put("c", "now long enough")
    folder.put("e", "yyyy")
    assert folder.run() == {"c": ("drained", None), "e": ("duplicate", None)}
    assert folder.archived() == ["a", "c", "d"]


def test_failures_are_tried_at_each_run_and_conflicts_are_kept_apart(folder):
    folder.put("a", "xxx")
    folder.put("bad", "zzz")
    fault = F.when(F.col("name") == "bad", "refused")
    assert folder.run(problem=fault) == {"a": ("drained", None), "bad": ("failed", "refused")}
    assert folder.run(problem=fault) == {"bad": ("failed", "refused")}
    assert folder.run() == {"bad": ("drained", None)}
    folder.put("a", "another content")
    folder.put("x/new", "one one")
    folder.put("y/new", "two two")
    assert folder.run() == {"a": ("failed", "conflict"), "x/new": ("drained", None), "y/new": ("failed", "conflict")}
    assert folder.archived() == ["a", "bad", "new"]


def test_unreadable_files_fail_alone(folder):
    folder.put("a", "xxx")
    folder.put("b", "yyy")
    (folder.inputs / "b").chmod(0)
    if os.access(folder.inputs / "b", os.R_OK):
        (folder.inputs / "b").unlink()
        os.symlink(folder.inputs / "nowhere", folder.inputs / "b")
        pytest.skip("this user reads everything")
    assert folder.run() == {"a": ("drained", None), "b": ("failed", "unreadable: PermissionError")}


def test_lookups_read_a_part_of_the_archive(spark, tmp_path):
    """Of many batches, a run opens the folders of its hashes, and reads only the files whose Bloom filters admit them."""
    archive = str(tmp_path / "archive")
    for number in range(3):
        rows = spark.range(2000).select(F.sha2(F.concat(F.lit(f"{number}-"), F.col("id").cast("string")), 256).alias("sha256"), F.lit("n").alias("name"), F.lit("p").alias("path"), F.lit(1).cast("long").alias("size"))
        D.archive_rows(rows, archive, number)

    def looked(*texts):
        """Rows found, files opened, and rows read of them."""
        hashes = spark.createDataFrame([(t,) for t in texts], "t string").select(F.sha2("t", 256).alias("sha256"))
        found = D.known_hashes(spark, archive, D.STORED, hashes, 99)
        rows = len(found.collect())
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
        return rows, *(scan.get(name).get().value() for name in ("numFiles", "numOutputRows"))

    found, files, read = looked("0-5", "2-7", "new")
    assert found == 2 and files <= 9 and 2 <= read <= 60
    assert looked("new")[2] == 0, "Bloom filters admit no file"
    assert looked(*[f"new {k}" for k in range(D.LOOKUPS + 1)])[0] > 1000, "many hashes: their folders are read whole, and joined"
