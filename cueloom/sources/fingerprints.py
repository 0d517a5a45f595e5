"""Hashes of files of any size, read where they lie: whole as a stream, or their head, middle and tail by ranges.

A cache (a Parquet folder) keeps hashes by path, size and time of change, so that a file is opened anew only once it has changed.
"""

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import PARTS, opened, part_ranges, read_documents, read_range

CHUNK = 1 << 20
KEY = ("path", "size", "modified", "scheme")
SCHEMES = ("full", "partial")


def fingerprinted(files: DataFrame) -> DataFrame:
    """Files as read in 'parts' to the same rows with sha256, their partial fingerprint, in place of the parts."""
    size_hex = F.lpad(F.hex("size"), 16, "0")
    size_bytes = F.unhex(F.concat(*[F.substring(size_hex, k, 2) for k in range(15, 0, -2)]))
    return files.withColumn("sha256", F.sha2(F.concat("head", "middle", "tail", size_bytes), 256)).drop("head", "middle", "tail")


def file_fingerprints(spark: SparkSession, path: str, parts: tuple[int, int, int] = PARTS) -> DataFrame:
    """(path, name, size, modified, sha256): the partial fingerprints of all files below a folder, as functions.text.partial_fingerprint gives them for contents. Of each file only the parts are read."""
    return fingerprinted(read_documents(spark, path, "parts", parts))


def one_hash(path: str, size: int, scheme: str, parts: tuple[int, int, int]) -> str:
    store, inner = opened(path)
    digest = hashlib.sha256()
    with store.open_input_file(inner) as file:
        if scheme == "partial":
            for start, length in part_ranges(size, parts):
                digest.update(read_range(file, start, length))
            digest.update(size.to_bytes(8, "little"))
        else:
            while chunk := file.read(CHUNK):
                digest.update(chunk)
    return digest.hexdigest()


def file_hashes(files: DataFrame, scheme: str = "full", parts: tuple[int, int, int] = PARTS, tasks: int | None = None) -> DataFrame:
    """files (path, size, ...), paths that pyarrow opens, to the same rows with sha256: of all bytes ('full'; a worker holds CHUNK of them) or of the parts ('partial'). Files are dealt to `tasks` tasks, by default four for each core, as they weigh far more than their rows."""
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}: full or partial")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(sha256=[one_hash(path, int(size), scheme, parts) for path, size in zip(batch["path"], batch["size"], strict=True)])

    dealt = files.repartition(tasks or 4 * files.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInPandas(hashed, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", sha256 string")


def cached_hashes(spark: SparkSession, path: str, cache: str, scheme: str = "full", parts: tuple[int, int, int] = PARTS, tasks: int | None = None) -> DataFrame:
    """(path, name, size, modified, scheme, sha256) of all files below a folder. Files that the cache doesn't have in this size, time and scheme are opened and added to it."""
    listed = read_documents(spark, path, "none").withColumn("scheme", F.lit(scheme if scheme == "full" else f"{scheme}:{','.join(map(str, parts))}"))
    columns = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in listed.select(*KEY).schema)}, sha256 string"

    def known() -> DataFrame:
        try:
            return spark.read.schema(columns).parquet(cache).dropDuplicates(KEY)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], columns)

    misses = listed.select(*KEY).join(known(), list(KEY), "left_anti")
    file_hashes(misses, scheme, parts, tasks).write.mode("append").parquet(cache)
    return listed.join(known(), list(KEY)).select("path", "name", "size", "modified", "scheme", "sha256")


