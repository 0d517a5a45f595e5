"""Mixing sources to target weights by entropy balancing.

Each source has a target number of tokens (words). Document rates r in [0, 2] are those of
least relative entropy to the plain corpus (rate 1) under one token constraint per source:
sum of rate * size = target. Its solution is an exponential tilt,

    r = 2 e^(a x) / (1 + e^(a x)),   x = size / mean size of the source,

with one multiplier `a` per source, the zero of the gradient of a convex dual. Newton steps
(kept inside a bracket) find all multipliers at once. Rates depend on source and size
alone, so each step sums over the table of distinct (source, size) pairs, aggregated once;
a source with a third of all rows is spread over many tasks. Tables of a row per source may be large (sources may be hosts):
they are numbered and summed by ranges, and joined by a shuffle, save for the few sources with very many rows.

Rates become whole copies 0, 1, 2 by one hash u in [0, 1) per document: copy k is taken
where k - r + u <= the source's threshold. The threshold (near 0) is chosen so that
the words taken meet the target; two histograms of the thresholds, the second within a bucket of the first, find the
bucket where the target is crossed, and only rows in that bucket (one in BUCKETS squared) are ordered. What is still
missing then, less than one document, is filled by FILL_ROUNDS further copies, each the
longest that fits.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, join_weighed

#: Weights of sources in code point order, repeating; the share of all sizes that they divide; how often a document may be taken. Fixed by the contract.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
NEWTON_STEPS, BRACKET, BUCKETS, FILL_ROUNDS = 40, 64.0, 2048, 5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: the empty text for a null source, else the source after a mark."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds place (from 0) and, for each of `sums`, the sum over all rows before this one in the order, and its total under the name with _all.

    Rows are sorted by ranges, so no task holds all of them; what a partition adds up to is one row, and these
    rows, as many as shuffle partitions, are summed in one window. The order must have no ties.
    """
    parts = cut(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    totals = parts.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    every, earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    names = ["__n", *[f"__{k}" for k in sums]]
    offsets = totals.select(F.col("__part").alias("__of"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in names], *[F.sum(c).over(every).alias(f"{c}_all") for c in names])
    inside = Window.partitionBy("__part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumns({"__place": F.row_number().over(inside) - 1} | {f"__{k}_here": F.coalesce(F.sum(c).over(upto), F.lit(0)) for k, c in sums.items()})
    joined = local.join(F.broadcast(offsets), F.col("__part") == F.col("__of"))
    return joined.select(*rows.columns, (F.col("__place") + F.col("__n_before")).alias("place"), *[(F.col(f"__{k}_here") + F.col(f"__{k}_before")).alias(k) for k in sums], *[F.col(f"__{k}_all").alias(f"{k}_all") for k in sums])


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target, mean, docs. sizes: (source, size, n).

    Water-filling: all sources get level * weight, but at most `most` times their size. Sorted by
    the level at which they are full, the first source that the level left for the others
    doesn't fill fixes that level.
    """
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("docs"))
    numbered = running(totals, [F.col("source").asc_nulls_last()]).withColumnRenamed("place", "number")
    weighted = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
    capped = weighted.withColumns({"cap": F.col("source_size") * float(most), "full": F.col("source_size") * float(most) / F.col("weight")})
    left = running(capped, [F.col("full"), F.col("number")], cap_before=F.col("cap"), weight_before=F.col("weight"), size_before=F.col("source_size"))
    level = (F.col("size_before_all") * share - F.col("cap_before")) / (F.col("weight_before_all") - F.col("weight_before"))
    found = cut(left.withColumn("level", level))
    first = found.where(F.col("level") <= F.col("full")).agg(F.min(F.struct("full", "number", "level")).alias("l")).first()["l"]
    # Where no level is left (all full), each source is at its cap.
    target = F.least(F.col("cap"), F.lit(first["level"]) * F.col("weight")) if first else F.col("cap")
    return found.select("source", "source_size", target.alias("target"), (F.col("source_size") / F.col("docs")).alias("mean"), "docs")


def rate(multiplier: Column, size: Column, mean: Column, most: int = MOST) -> Column:
    """The tilted rate; null multipliers stand for a full source (all documents `most` times)."""
    tilted = most / (1 + F.exp(-multiplier * size / mean))
    return F.when(multiplier.isNull(), F.lit(float(most))).when(mean <= 0, F.lit(0.0)).otherwise(tilted)


def balance(sizes: DataFrame, targets: DataFrame, most: int = MOST, steps: int = NEWTON_STEPS, tolerance: float = 1e-9) -> DataFrame:
    """Newton on the dual: targets with the multiplier of each source (null where the target is all that the source can give). Raises RuntimeError if a multiplier isn't settled after `steps`."""
    known = targets.select(source_key(F.col("source")).alias("s"), "source", "source_size", "target", "mean", "docs")
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    scaled = cut(sizes.where("size > 0").select(source_key(F.col("source")).alias("s"), "size", "n"))
    state = known.withColumns({"multiplier": F.lit(0.0), "low": F.lit(-BRACKET), "high": F.lit(BRACKET), "done": full})
    sources = known.count()
    for step in range(steps + 1):
        state = cut(state)
        if not state.where(~F.col("done")).limit(1).count():
            break
        if step == steps:
            raise RuntimeError(f"the multipliers are not settled after {steps} steps")
        # A source has as many rows here as distinct sizes, so none of them is hot.
        rated = scaled.join(bounded(state.where(~F.col("done")).select("s", "multiplier", "mean"), sources), ["s"]).withColumn("rate", rate(F.col("multiplier"), F.col("size"), F.col("mean"), most))
        x = F.col("size") / F.col("mean")
        sums = rated.groupBy("s").agg(
            F.sum(F.col("n") * F.col("size") * F.col("rate")).alias("taken"),
            F.sum(F.col("n") * F.col("size") * x * F.col("rate") * (1 - F.col("rate") / most)).alias("slope"),
        )
        gap = F.coalesce("taken", F.lit(0.0)) - F.col("target")
        low, high = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low")), F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - gap / F.col("slope")
        inside = (newton > low) & (newton < high)
        met = (F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))) | (high - low < 1e-12)
        stepped = F.when(F.coalesce(inside, F.lit(False)), newton).otherwise((low + high) / 2)
        done = F.col("done") | met
        state = state.join(sums, ["s"], "left").select(
            *known.columns, F.when(done, F.col("multiplier")).otherwise(stepped).alias("multiplier"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"), F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"), done.alias("done"))
    return cut(state.select(*known.columns, F.when(~full, F.col("multiplier")).alias("multiplier")))


def crossing(buckets: DataFrame, rooms: DataFrame) -> DataFrame:
    """buckets (s, bucket, size), rooms (s, room) to (s, edge, room): the first bucket that the room doesn't hold with all before it, and what is left for it; no row where all fits."""
    upto = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = buckets.withColumn("sum", F.sum("size").over(upto)).join(rooms, ["s"]).where("sum > room")
    return summed.groupBy("s").agg(F.min(F.struct(F.col("bucket").alias("edge"), (F.col("room") - F.col("sum") + F.col("size")).alias("room"))).alias("f")).select("s", "f.edge", "f.room")


def round_copies(rated: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """rated: (id, s, size, rate, u), stored; targets: (s, target, docs), stored. Adds copies int, such that each source's sum of copies * size is near its target."""
    levels = F.sequence(F.lit(1), F.lit(most))
    events = rated.where("size > 0").select("id", "s", "size", F.explode(F.transform(levels, lambda k: k - F.col("rate") + F.col("u"))).alias("at"))
    events = events.withColumn("fine", F.floor((F.col("at") + most) / (2 * most + 1) * BUCKETS * BUCKETS)).withColumn("bucket", F.floor(F.col("fine") / BUCKETS))
    rooms, docs = targets.select("s", F.col("target").alias("room")), targets.select("s", "docs")
    none = F.lit(BUCKETS * BUCKETS * 4)
    coarse = cut(docs.join(crossing(events.groupBy("s", "bucket").agg(F.sum("size").alias("size")), rooms), ["s"], "left").select("s", "docs", F.coalesce("edge", none).alias("edge"), "room"))
    placed = cut(join_weighed(events, coarse.select("s", "docs", "edge"), ["s"], "docs").where("bucket <= edge").select("id", "s", "size", "at", "bucket", "fine", "edge"))
    border = placed.where("bucket = edge").select("id", "s", "size", "at", "fine")
    finer = cut(docs.join(crossing(border.groupBy("s", F.col("fine").alias("bucket")).agg(F.sum("size").alias("size")), coarse.select("s", "room")), ["s"], "left").select("s", "docs", F.coalesce("edge", none).alias("edge"), F.coalesce("room", F.lit(0.0)).alias("room")))
    near = join_weighed(border, finer, ["s"], "docs")
    inner = Window.partitionBy("s").orderBy("at", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = near.where("fine = edge").withColumn("sum", F.sum("size").over(inner)).where("sum <= room").select("id")
    sure = placed.where("bucket < edge").select("id").unionByName(near.where("fine < edge").select("id"))
    taken = sure.unionByName(last).groupBy("id").agg(F.count("*").cast("int").alias("copies"))
    state = cut(rated.join(taken, ["id"], "left").withColumn("copies", F.coalesce("copies", F.lit(0))))
    got = state.groupBy("s").agg(F.sum(F.col("copies") * F.col("size")).alias("got"))
    gaps = cut(targets.join(got, ["s"]).select("s", "docs", (F.col("target") - F.col("got")).alias("gap")))
    more: list[DataFrame] = []
    for _ in range(FILL_ROUNDS):
        extra = state.select("id", "s", "size", "u", "copies").where((F.col("size") > 0) & (F.col("copies") < most))
        if more:
            given = cut(reduce(DataFrame.unionByName, more).groupBy("id").agg(F.count("*").alias("given")))
            extra = extra.join(bounded(given, given.count()), ["id"], "left").where(F.col("copies") + F.coalesce("given", F.lit(0)) < most)
        fits = join_weighed(extra, gaps.where("gap >= 1"), ["s"], "docs").where("size <= gap")
        picks = cut(fits.groupBy("s").agg(F.max(F.struct("size", "u", "id")).alias("p")).select("s", "p.size", "p.id"))
        if not picks.limit(1).count():
            break
        more.append(picks.select("id"))
        gaps = cut(gaps.join(picks.select("s", F.col("size").alias("less")), ["s"], "left").select("s", "docs", (F.col("gap") - F.coalesce("less", F.lit(0))).alias("gap")))
    if not more:
        return state
    given = cut(reduce(DataFrame.unionByName, more).groupBy("id").agg(F.count("*").cast("int").alias("given")))
    return state.join(bounded(given, given.count()), ["id"], "left").withColumn("copies", F.col("copies") + F.coalesce("given", F.lit(0))).drop("given")


def mix(documents: DataFrame, key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies.

    Null texts have no words; documents without words get no copies. Null sources are a
    source of their own, the last. Rows that agree in key, source and size are told apart by a
    running number, so each is rounded on its own; which of them gets a copy more makes no
    difference to the result. Null keys are hashed as the empty text. Empty tables give none.
    """
    text = documents.select(F.col(key).alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    same = Window.partitionBy("doc_id", "source", "size").orderBy("doc_id")
    docs = cut(text.withColumns({"again": F.row_number().over(same), "s": source_key(F.col("source"))}))
    sizes = cut(docs.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = balance(sizes, source_targets(sizes, weights, share, most), most)
    joined = join_weighed(docs, targets.select("s", "source_size", "target", "mean", "multiplier", "docs"), ["s"], "docs")
    code = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("\x00")), "size", "again")
    rated = joined.withColumns({
        "rate": rate(F.col("multiplier"), F.col("size"), F.col("mean"), most),
        "id": F.unhex(F.md5(code.cast("binary"))), "u": F.pmod(F.xxhash64(F.lit("round"), code), F.lit(1 << 40)) / float(1 << 40),
    })
    copied = round_copies(cut(rated.select("id", "doc_id", "s", "source", "size", "source_size", "target", "rate", "u")), targets.select("s", "target", "docs"), most)
    return copied.select("doc_id", "source", "size", "source_size", "target", "rate", "copies")


def mixed_documents(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix itself: each document as often as its copies say, with the columns of documents.

    A document is matched by key, source and size; where rows repeat all three, each row takes
    the copies of one of them.
    """
    copies = mix(documents, key)
    same = Window.partitionBy("__id", "__source", "__size").orderBy("__id")
    rows = documents.select(F.struct(*[F.col(f"`{name}`") for name in documents.columns]).alias("__row"), F.col(key).alias("__id"), F.col("source").alias("__source"), word_count(F.col("text")).alias("__size"))
    numbered = rows.withColumn("__again", F.row_number().over(same))
    again = copies.withColumn("again", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.desc("copies")))).where("copies > 0")
    wanted = again.select(F.col("doc_id").alias("__k"), F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("again").alias("__n"), F.col("copies").alias("__copies"))
    same_row = F.col("__id").eqNullSafe(F.col("__k")) & F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z")) & (F.col("__again") == F.col("__n"))
    matched = numbered.join(wanted, same_row)
    return matched.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"__row.`{name}`") for name in documents.columns])
