"""Shards on a consistent-hash ring with virtual nodes and bounded loads.

The ring has RING_CELLS cells. Each shard owns `virtual_nodes` points on it; a key
falls into the cell that its hash names and belongs to the next point clockwise. A
shard takes rows up to its capacity only: rows beyond it go on clockwise to the next
point of a shard that has room. Rows try their first shard before any row is moved on, so
no more rows leave their place on the plain ring than capacity demands.

The walk needs no more than the number of rows of each cell, a table of RING_CELLS
rows at most however large the input, so it is planned on the driver, in time proportional to cells and points
however many shards there are. The rows themselves are numbered inside their cell (one shuffle of ids and
hashes, never of texts) and matched with the plan: ranks from..to of a cell go to a shard. A cell with very many rows
(a key that they repeat) is numbered in SPLITS parts.
"""

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT

RING_CELLS, SPLITS = 32_768, 64
VIRTUAL_NODES = 128


def ring_points(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = RING_CELLS) -> list[tuple[int, int, int]]:
    """(cell, tie, shard) of every virtual node in ring order. A shard's points don't depend on the other shards."""
    points = []
    for shard in range(shards):
        for replica in range(virtual_nodes):
            digest = hashlib.md5(f"shard-{shard}/{replica}".encode()).digest()
            points.append((int.from_bytes(digest[:8], "big") % cells, int.from_bytes(digest[8:12], "big"), shard))
    return sorted(points)


def capacities(rows: int, shards: int, epsilon: float) -> list[int]:
    """epsilon 0: as many rows as an even deal gives, so counts end at most one apart. Otherwise (1 + epsilon) times the mean, rounded up."""
    if epsilon <= 0:
        return [rows // shards + (shard < rows % shards) for shard in range(shards)]
    bound = -(-rows * (1 + epsilon) // shards)
    return [int(bound)] * shards


class OpenPoints:
    """The points of the ring, those of full shards passed over. Passing over points is remembered, so all walks together take about as many steps as there are points."""

    def __init__(self, points: list[tuple[int, int, int]]) -> None:
        self.n, self.next, self.places = len(points), list(range(len(points))), {}
        for k, (_, _, shard) in enumerate(points):
            self.places.setdefault(shard, []).append(k)

    def close(self, shard: int) -> None:
        for k in self.places[shard]:
            self.next[k] = (k + 1) % self.n

    def first(self, k: int) -> int:
        """The first open point from k on, clockwise. There must be one."""
        passed = []
        while self.next[k] != k:
            passed.append(k)
            k = self.next[k]
        for p in passed:
            self.next[p] = k
        return k


def plan_moves(cell_rows: dict[int, int], shards: int, epsilon: float, virtual_nodes: int, cells: int = RING_CELLS) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, first rank, last rank, shard, slot of the first, points moved on) for all rows of all cells; ranks from 1, slots from 0."""
    points = ring_points(shards, virtual_nodes, cells)
    free = capacities(sum(cell_rows.values()), shards, epsilon)
    open_, filled, moves = OpenPoints(points), [0] * shards, []

    def fill(cell: int, first: int, last: int, point: int, own: int) -> int:
        """Rows first..last to the point's shard, as many as it has room for: the first row that is left."""
        shard = points[point][2]
        taken = min(last - first + 1, free[shard])
        if taken:
            moves.append((cell, first, first + taken - 1, shard, filled[shard], (point - own) % len(points)))
            free[shard] -= taken
            filled[shard] += taken
        return first + taken

    waiting, point = [], 0
    for cell, rows in sorted(cell_rows.items()):
        while point < len(points) and points[point][0] < cell:
            point += 1
        own = point % len(points)
        left = fill(cell, 1, rows, own, own)
        if left <= rows:
            waiting.append((cell, left, rows, own))
    for shard in range(shards):
        if not free[shard] and waiting:
            open_.close(shard)
    for cell, first, last, own in waiting:
        while first <= last:
            at = open_.first(own)
            first = fill(cell, first, last, at, own)
            if not free[points[at][2]] and first <= last:
                open_.close(points[at][2])
        # A shard that this cell has just filled is closed when the next cell comes upon it.
    return moves


def shard_rows(rows: DataFrame, key: str, shards: int = 8, epsilon: float = 0.0, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """Add to each row: shard int, slot long (gapless from 0 in each shard), moved int (points passed from the row's own place).

    A row's place depends on its key's hash. Rows with a null key are dealt by a hash of
    all their other columns that can be hashed. Equal keys (repeated rows) share a cell and
    are numbered among themselves, so they may be split where a shard is full. Ties are
    ordered by the whole row, so a rerun gives the same result up to rows equal in all columns.
    An empty input gives an empty result. Columns named shard, slot or moved are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot", "moved")
    hashable = [F.col(f"`{name}`") for name, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    whole = F.xxhash64(*hashable)
    placed = rows.withColumns({"__hash": F.when(F.col(key).isNull(), whole).otherwise(F.xxhash64(F.col(key).cast("string")))})
    placed = placed.withColumns({"__cell": F.pmod(F.col("__hash"), F.lit(RING_CELLS)).cast("int"), "__whole": whole})
    counted = {r["__cell"]: r["n"] for r in placed.groupBy("__cell").agg(F.count("*").alias("n")).collect()}  # RING_CELLS rows at most
    moves = plan_moves(counted, shards, epsilon, virtual_nodes)
    plan = spark.createDataFrame(moves or [(0, 0, 0, 0, 0, 0)], "__cell int, __first long, __last long, shard int, __slot long, moved int")
    total = sum(counted.values())
    hot = sorted(cell for cell, n in counted.items() if n * HOT > total and n > SPLITS)
    split = F.when(F.col("__cell").isin(hot), F.pmod("__whole", F.lit(SPLITS)).cast("int")).otherwise(0) if hot else F.lit(0)
    placed = placed.withColumn("__split", split)
    ranked = placed.withColumn("__rank", F.row_number().over(Window.partitionBy("__cell", "__split").orderBy("__hash", "__whole")))
    if hot:
        before: list[tuple[int, int, int]] = []  # rows of a hot cell's earlier parts: HOT times SPLITS rows at most
        for r in sorted(placed.where(F.col("__cell").isin(hot)).groupBy("__cell", "__split").agg(F.count("*").alias("n")).collect()):
            passed = before[-1][2] + held if before and before[-1][0] == r["__cell"] else 0
            before.append((r["__cell"], r["__split"], passed))
            held = r["n"]
        earlier = spark.createDataFrame(before, "__cell int, __split int, __before long")
        ranked = ranked.join(F.broadcast(earlier), ["__cell", "__split"], "left").withColumn("__rank", F.col("__rank") + F.coalesce("__before", F.lit(0)))
    joined = ranked.join(F.broadcast(plan), ["__cell"]).where(F.col("__rank").between(F.col("__first"), F.col("__last")))
    return joined.select(*[F.col(f"`{name}`") for name in rows.columns], "shard", (F.col("__slot") + F.col("__rank") - F.col("__first")).alias("slot"), "moved")


def shard_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; null texts count as none), text_crc32 and the shard of every document, without its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(sizes, "doc_id", shards)
