"""Incremental draining of an input folder: every new content once, whatever its name and however often the job runs.

The archive is cut by the first digits of its hashes, and its files have Bloom filters of them: a batch opens only the
folders of its own hashes, and reads of these only the files that may hold one. So what a batch reads of the archive follows the batch, not the archive.
"""

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..functions.text import content_sha256
from ..sources.documents import PARTS, read_documents
from ..sources.fingerprints import one_hash

SCHEMA = "name string, content string"
ARCHIVE = "sha256 string, name string, content string, size long, batch long, prefix string"
LEDGER = "name string, sha256 string, size long, status string, reason string"
#: Hex digits of a hash by which the archive is cut, so that it has 16 ** DIGITS folders, and hashes that a batch looks up one by one; larger batches read their folders whole.
DIGITS, LOOKUPS = 2, 300
STORED = "sha256 string, name string, path string, size long, batch long, prefix string"
NAMED = "sha256 string, name string, held string, batch long, prefix string"
#: One row for each time that a file was taken up.
VISITS = "path string, name string, size long, modified long, sha256 string, status string, reason string, batch long"


def prefix(sha256: Column) -> Column:
    return F.substring(sha256, 1, DIGITS)


def known_hashes(spark: SparkSession, archive: str, schema: str, hashes: DataFrame, number: int, names: tuple[str, ...] = ("sha256",)) -> DataFrame:
    """What other batches have archived under the hashes (or more, of the same folders). hashes (sha256): the batch's, evaluated twice."""
    asked = hashes.select("sha256").distinct()
    seen = asked.agg(F.count("*").alias("n"), F.collect_set(prefix(F.col("sha256"))).alias("folders")).first()  # 16 ** DIGITS folders at most
    stored = spark.read.schema(schema).parquet(archive).where(F.col("prefix").isin(seen["folders"]) & (F.col("batch") != number))
    if 0 < seen["n"] <= LOOKUPS:
        # One test for each, as Spark hands tests, but not long lists, down to the files' Bloom filters.
        stored = stored.where(reduce(or_, [F.col("sha256") == r["sha256"] for r in asked.collect()]))
    return stored.select(*names)


def archive_rows(rows: DataFrame, archive: str, number: int) -> None:
    """Write a batch's rows (sha256, ...) in the archive's order; a batch that is run again replaces what it wrote."""
    placed = rows.withColumns({"prefix": prefix(F.col("sha256")), "batch": F.lit(number).cast("long")})
    writer = placed.repartition("prefix").sortWithinPartitions("prefix", "sha256").write.mode("overwrite").partitionBy("prefix", "batch")
    writer.option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#sha256", "true").parquet(archive)


def judged(batch: DataFrame, least: int, problem: Column | None = None) -> DataFrame:
    """(name, content, sha256, size, status, reason): skipped where content is null, empty or below `least` bytes; failed where `problem` gives a reason; else drained."""
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    fault = F.lit(None).cast("string") if problem is None else problem.cast("string")
    valid = size >= max(1, least)
    status = F.when(~valid, "skipped").when(fault.isNotNull(), "failed").otherwise("drained")
    return batch.select("name", "content", content_sha256(F.coalesce("content", F.lit(""))).alias("sha256"), size.alias("size"), status.alias("status"), F.when(valid, fault).alias("reason"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def drain_batch(batch: DataFrame, number: int, archive: str, log: str, least: int, problem: Column | None = None) -> None:
    """Archive the batch's content to be drained that earlier batches didn't archive, one row per hash (the least name), and log all of its rows.

    Both go to folders of the batch's number, so a batch that is run again replaces what it wrote.
    """
    spark = batch.sparkSession
    rows = judged(batch, least, problem)
    log_of_batch = f"{log}/batch={number}"
    rows.select("name", "sha256", "size", "status", "reason").write.mode("overwrite").parquet(log_of_batch)
    hashes = spark.read.schema(LEDGER).parquet(log_of_batch).where("status = 'drained'").select("sha256")
    known = known_hashes(spark, archive, ARCHIVE, hashes, number)
    new = rows.where("status = 'drained'").join(known, ["sha256"], "left_anti").groupBy("sha256").agg(F.min(F.struct("name", "content", "size")).alias("r"))
    archive_rows(new.select("sha256", "r.name", "r.content", "r.size"), archive, number)


def incremental_drain(spark: SparkSession, inputs: str, archive: str, log: str, checkpoint: str, least: int = 1 << 20, problem: Column | None = None) -> None:
    """Process all new files (Parquet, name and content) of the folder, then stop. The checkpoint remembers which files were taken; the archive, by hash, which contents.

    problem: a column on name and content that says why a row can't be processed, and is null where it can (made of functions that give null in place of an
    error, such as try_parse_json). Such a row is logged as failed and not archived, and the others of its batch go on. Inputs that are files of their
    own, to be tried again once they change, are drained by drain_folder.
    """
    begin(spark, archive, ARCHIVE)
    stream = spark.readStream.schema(SCHEMA).parquet(inputs)
    query = stream.writeStream.foreachBatch(lambda batch, number: drain_batch(batch, number, archive, log, least, problem)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def begin(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table at the path, if there is none, so that it can be read."""
    names = [c.split()[0] for c in schema.split(", ")]
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*[c for c in ("prefix", "batch") if c in names]).parquet(path)


def visits(spark: SparkSession, log: str) -> DataFrame:
    """What became of each file, each time that it was taken up."""
    return spark.read.schema(VISITS).parquet(log)


def hashed(files: DataFrame, scheme: str, parts: tuple[int, int, int]) -> DataFrame:
    """Files with sha256, or with a reason where they can't be read."""
    def each(batches):
        for batch in batches:
            found = []
            for path, size in zip(batch["path"], batch["size"], strict=True):
                try:
                    found.append((one_hash(path, int(size), scheme, parts), None))
                except OSError as error:
                    found.append((None, f"unreadable: {type(error).__name__}"))
            yield batch.assign(sha256=pd.Series([f[0] for f in found], dtype=object, index=batch.index), reason=pd.Series([f[1] for f in found], dtype=object, index=batch.index))

    dealt = files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInPandas(each, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", sha256 string, reason string")


def drain_folder(spark: SparkSession, inputs: str, archive: str, log: str, least: int = 1 << 20, problem: Column | None = None, scheme: str = "full", parts: tuple[int, int, int] = PARTS) -> DataFrame:
    """Take up all files of the folder that are new or have changed (in size or time) since they were last taken up, and those that failed; the visits of this run.

    Statuses: skipped (below `least` bytes or empty; not opened), failed (`problem`, a column on path, name, size and sha256, gives a reason; or the file can't be
    read; or the archive has another content of this name: 'conflict'), duplicate (its content is archived, or another new file of
    it has a lesser path), drained (its hash is archived now). A skipped file is tried again once it changes, a failed one at each run; files stay where they are.
    The archive is written before the log, each under the run's number, so a run that was cut short is repeated whole.
    """
    named = f"{archive}_names"
    begin(spark, archive, STORED)
    begin(spark, named, NAMED)
    begin(spark, log, VISITS)
    before = visits(spark, log)
    number = int(before.agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]) + 1
    settled = before.where("status <> 'failed'").select("path", "size", "modified").distinct()
    fresh = read_documents(spark, inputs, "none").join(settled, ["path", "size", "modified"], "left_anti")
    enough = F.col("size") >= max(1, least)
    fault = F.coalesce(F.col("reason"), F.lit(None).cast("string") if problem is None else problem.cast("string"))
    taken = fresh.where(~enough).unionByName(hashed(fresh.where(enough), scheme, parts), allowMissingColumns=True).withColumn("reason", F.when(enough, fault))
    # Hashing reads the files, so its outcome is written before it is used more than once.
    taken = cut(taken.withColumn("status", F.when(~enough, "skipped").when(F.col("reason").isNotNull(), "failed")))
    valid = taken.where("status is null").drop("status", "reason")
    # A name belongs to the content that is archived under it, else to that of its least path.
    key = F.sha2("name", 256)
    held = known_hashes(spark, named, NAMED, valid.select(key.alias("sha256")), number, ("name", "held")).groupBy("name").agg(F.min("held").alias("held"))
    owners = valid.groupBy("name").agg(F.min(F.struct("path", "sha256"))["sha256"].alias("sha256")).join(held, ["name"], "left").select("name", F.coalesce("held", "sha256").alias("sha256"), F.lit(True).alias("owned"))
    judged_ = cut(valid.join(owners, ["name", "sha256"], "left"))
    known = known_hashes(spark, archive, STORED, valid.select("sha256"), number)
    new = judged_.where("owned").groupBy("sha256").agg(F.min("path").alias("path")).join(known, ["sha256"], "left_anti").withColumn("new", F.lit(True))
    status = F.when(F.col("owned").isNull(), "failed").when(F.col("new"), "drained").otherwise("duplicate")
    done = judged_.join(new, ["sha256", "path"], "left").withColumns({"status": status, "reason": F.when(F.col("owned").isNull(), "conflict")})
    columns = ("path", "name", "size", "modified", "sha256", "status", "reason")
    done = cut(done.select(*columns).unionByName(taken.where("status is not null").select(*columns)))
    drained = done.where("status = 'drained'")
    archive_rows(drained.select("sha256", "name", "path", "size"), archive, number)
    archive_rows(drained.select(key.alias("sha256"), "name", F.col("sha256").alias("held")), named, number)
    done.write.mode("overwrite").parquet(f"{log}/batch={number}")
    return visits(spark, log).where(F.col("batch") == number)
