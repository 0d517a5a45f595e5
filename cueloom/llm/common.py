"""What the operators of this subpackage share."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.functions.shared import cut, scratch, shared_dir, table

__all__ = ["BROADCAST_ROWS", "HOT", "ascii_lower", "bounded", "cut", "join_weighed", "key_crc", "lean_batches", "scratch", "shared_dir", "table"]

#: ASCII letters, for lower-casing that leaves every other letter alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A side of a join is broadcast up to so many rows of some 50 bytes, else shuffled.
BROADCAST_ROWS = 200_000


def bounded(side: DataFrame, rows: int) -> DataFrame:
    """The side, to be broadcast if it has few enough rows."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


#: A key is hot if more than one row in HOT has it; so there are fewer than HOT hot keys, however large the table.
HOT = 1000


def join_weighed(rows: DataFrame, side: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with side, which has one row a key and, in `weight`, how many of rows have that key (or about so many).

    Hot keys are joined by a broadcast of their rows of side, fewer than HOT; all others by a shuffle, so no task
    gets more than its share for one key. side is evaluated twice: hand in a stored one. Rows with a null among the keys match nothing.
    """
    total = side.agg(F.sum(weight)).first()[0] or 0
    hot = side.where(F.col(weight) * HOT > int(total))
    if not hot.limit(1).count():
        return rows.join(side, keys, how)
    few = F.broadcast(hot)
    rest = rows.join(few.select(*keys), keys, "left_anti").join(side.where(F.col(weight) * HOT <= int(total)), keys, how)
    return rows.join(few, keys).unionByName(rest)


#: Rows that go to a Python worker at once. Spark's own default of 10,000 long texts would be held several times over, on either side.
BATCH_ROWS = 1000


@contextmanager
def lean_batches(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside has Arrow batches of BATCH_ROWS rows at most (Spark's bound of bytes a batch holds besides); the session's own setting holds again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    if 0 < before <= BATCH_ROWS:
        yield
        return
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def key_crc(key: Column) -> Column:
    """Unsigned CRC-32 of the key written as text; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
