"""What a chain of filters loses, for every order of the filters, from one pass over the texts.

A document fails some of five filters: its cell is the set (mask) of these. Counts of cells by part are all that the audit needs: a Gray code
goes through the 32 subsets of filters and toggles one filter at a time; each cell knows how many of the
filters switched on it fails, and leaves the running survivors when that number rises from 0, or comes back when it falls to 0. The survivors
of all 32 subsets are stored, and each step of each order is the difference of two of them.

Texts are read once and never shuffled: they are turned into digests and masks first. Copies of a hot text or rows of a hot source meet
only after partial aggregation.
"""

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

FILTERS = "ABCDE"
#: Fewest words; least percentage of distinct words; greatest percentage of capitals; marks that no text may hold. Fixed by the contract.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, r"[#$%&*|]"
GAP = r"[\x20\x09-\x0D]+"
CELLS, ORDERS = 1 << len(FILTERS), ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
#: Parts whose rows (600 each) a task makes at once.
AT_ONCE = 50


def failures(text: Column) -> Column:
    """The mask of the filters that look at the text alone: bit k for the k-th of FILTERS."""
    words = F.array_remove(F.split(text, GAP), "")
    bit = lambda fails, k: F.when(fails, 1 << k).otherwise(0)
    n = F.size(words)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (
        bit(n < LEAST_WORDS, 0) + bit(100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n, 1)
        + bit(100 * capitals.cast("long") > MOST_CAPITALS * F.char_length(text).cast("long"), 2) + bit(text.rlike(MARKS), 3)
    )


def gray_walk(cells: np.ndarray) -> np.ndarray:
    """cells (parts, 32, kinds), the counts of documents by mask, to survivors (parts, 32, kinds) of each subset of filters switched on."""
    masks, active = np.arange(CELLS), np.zeros(CELLS, int)
    states, running, on = np.zeros_like(cells), cells.sum(axis=1), 0
    states[:, 0] = running
    for step in range(1, CELLS):
        toggled = step & -step  # the bit in which two Gray codes that follow each other differ
        on ^= toggled
        fails = (masks & toggled) > 0
        if on & toggled:
            running = running - cells[:, fails & (active == 0)].sum(axis=1)
            active[fails] += 1
        else:
            active[fails] -= 1
            running = running + cells[:, fails & (active == 0)].sum(axis=1)
        states[:, on] = running
    return states


def audit_rows(parts: list[str], cells: np.ndarray) -> pd.DataFrame:
    """The 600 rows of each part. cells (parts, 32, kinds): of all documents, of good ones, of toxic ones."""
    states, masks = gray_walk(cells), np.arange(CELLS)
    failing = np.stack([cells[:, masks & 1 << k > 0, 0].sum(axis=1) for k in range(len(FILTERS))], axis=1)
    shapley = np.zeros_like(failing)
    for k in range(len(FILTERS)):
        for subset in masks[masks & 1 << k == 0]:
            size = int(subset).bit_count()
            orders = factorial(size) * factorial(len(FILTERS) - 1 - size)
            shapley[:, k] += orders * (states[:, subset, 0] - states[:, subset | 1 << k, 0])
    steps = []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            steps.append((order, step, FILTERS.index(letter), before))
            before |= 1 << FILTERS.index(letter)
    filters, befores = np.array([s[2] for s in steps]), np.array([s[3] for s in steps])
    gone = states[:, befores] - states[:, befores | 1 << filters]
    made = {
        "kept": states[:, befores | 1 << filters, 0], "removed": gone[..., 0], "redundant": failing[:, filters] - gone[..., 0], "unique_fails": cells[:, 1 << filters, 0],
        "good_lost": gone[..., 1], "toxic_lost": gone[..., 2], "shapley": shapley[:, filters],
    }
    frame = {"part": np.repeat(np.array(parts, object), len(steps)), "filter_order": np.tile(np.array([s[0] for s in steps], object), len(parts)), "step": np.tile(np.array([s[1] for s in steps], np.int32), len(parts))}
    return pd.DataFrame(frame | {name: counts.ravel() for name, counts in made.items()})


def audits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), AT_ONCE):
            some = batch.iloc[at : at + AT_ONCE]
            cells = np.zeros((len(some), CELLS, 3), np.int64)
            for row, held in enumerate(some["cells"]):
                for cell in held:
                    cells[row, cell["mask"]] = cell["docs"], cell["good"], cell["toxic"]
            yield audit_rows(list(some["part"]), cells)


def failing_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(key, part, mask, n): the documents by what they fail, n rows alike as one. A document fails E if a smaller key has its text.

    Null texts are empty ones, null parts the empty part. Null keys are smaller than none and no key is smaller than they are: they fail E never.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    facts = documents.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("digest"), failures(body).alias("mask"))
    facts = cut(facts.groupBy("key", "part", "digest", "mask").agg(F.count("*").alias("n")))
    least = facts.groupBy("digest").agg(F.min("key").alias("key")).withColumn("least", F.lit(True))
    found = facts.join(least, ["digest", "key"], "left")
    passes = F.col("key").isNull() | F.col("least").isNotNull()
    return found.select("key", "part", (F.col("mask") + F.when(passes, 0).otherwise(1 << 4)).alias("mask"), "n")


def filter_cells(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, docs, good, toxic): counts of documents, and of those that a label calls good (quality 1) or toxic. Of several labels of a key one is enough; labels of a null key belong to none."""
    judged = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Alike rows are one, so rows without a key are few.
    alike = failing_documents(documents, key, text, part).groupBy("key", "part", "mask").agg(F.sum("n").alias("n"))
    every = alike.join(judged, ["key"], "left")
    having = lambda c: F.coalesce(F.sum(F.when(F.col(c) == 1, F.col("n"))), F.lit(0))
    return every.groupBy("part", "mask").agg(F.sum("n").alias("docs"), having("good").alias("good"), having("toxic").alias("toxic"))


def filter_audit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """600 rows per part (each order of the five filters, each step of it): part, filter_order, step and the counts of COUNTS, zeros included.

    kept: documents left after the step; removed: by it; redundant: failing its filter, but gone before; unique_fails: failing its filter
    alone; good_lost and toxic_lost: labelled ones among the removed; shapley: removed by this filter, summed over all orders. A table
    without documents has no parts.
    """
    cells = filter_cells(documents, labels, key, text, part)
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells"))
    return by_part.mapInPandas(audits, RESULT)
