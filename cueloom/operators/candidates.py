"""Scored candidate segments: segments(tid, ord, t_start, t_end, score, ..., flags). ord is the input order within a transcript."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import DEFAULT

SEGMENT = "struct<start:double,end:double,score:int,hook:string,title:string,description:string,reason:string,topic:string>"
REQUIRED = ("start", "end", "score", "hook", "title", "description")


def length() -> Column:
    return F.col("t_end") - F.col("t_start")


def flag_durations(segments: DataFrame, least: float = DEFAULT.min_duration, most: float = DEFAULT.max_duration) -> DataFrame:
    """Adds 'too_short' or 'too_long' to flags (made if missing), once; all rows are kept."""
    if "flags" not in segments.columns:
        segments = segments.withColumn("flags", F.array().cast("array<string>"))
    new = F.filter(F.array(F.when(length() < least, "too_short"), F.when(length() > most, "too_long")), lambda x: x.isNotNull())
    return segments.withColumn("flags", F.array_union(F.coalesce("flags", F.array().cast("array<string>")), new))


def filter_by_score(segments: DataFrame, least: int = DEFAULT.min_score) -> DataFrame:
    return segments.where(F.col("score") >= least)


def filter_by_duration(segments: DataFrame, least: float = DEFAULT.min_meaningful) -> DataFrame:
    return segments.where(length() >= least)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Overlap of two spans relative to the shorter one; 0 where that has no length."""
    inter = F.greatest(F.lit(0.0), F.least(a["t_end"], b["t_end"]) - F.greatest(a["t_start"], b["t_start"]))
    shorter = F.least(a["t_end"] - a["t_start"], b["t_end"] - b["t_start"])
    return F.when(shorter > 0, inter / shorter).otherwise(0.0)


#: Cells of time into which the kept segments of a recording are sorted, at most; else twice the square root of their number.
CELLS = 1024


def greedy_keep(segments: DataFrame, order: list[Column], threshold: float) -> DataFrame:
    """Go through a transcript's segments in order; keep one unless it overlaps a kept one by more than the threshold.

    Kept segments are held by cells of time, each in all cells that it reaches into, so a segment is compared with those of its own cells
    only. These are few: of kept segments none lies within another, and of those over one point each reaches
    less far than half as far as the next. Segments without a length, or with a null bound, overlap none and are all kept. The threshold is a share, 0 or more; at 1 all are kept.
    """
    if threshold < 0:
        raise ValueError("the threshold is a share of the shorter segment, 0 or more")
    if threshold >= 1:
        return segments
    columns = segments.columns
    item = F.struct(*[c.alias(f"__k{i}") for i, c in enumerate(order)], *columns)
    ordered = segments.groupBy("tid").agg(F.array_sort(F.collect_list(item)).alias("all"))
    lasting = lambda x: F.coalesce(x["t_end"] > x["t_start"], F.lit(False))
    ordered = ordered.withColumn("some", F.filter("all", lasting))
    cells, first = F.least(F.lit(CELLS), F.greatest(F.lit(1), (2 * F.sqrt(F.size("some"))).cast("int"))), F.array_min(F.transform("some", lambda x: x["t_start"]))
    ordered = ordered.withColumns({"cells": cells, "first": first, "wide": (F.array_max(F.transform("some", lambda x: x["t_end"])) - first) / cells})
    cell = lambda t: F.least(F.col("cells") - 1, F.floor((t - F.col("first")) / F.col("wide")).cast("int"))

    def step(held: Column, x: Column) -> Column:
        # What is held must not be handed through a transform, which copies all that it gives.
        a, b = cell(x["t_start"]), cell(x["t_end"])
        own = F.slice(held, a + 1, b - a + 1)
        lost = F.exists(own, lambda c: F.exists(c, lambda k: overlap_ratio(x, k) > threshold))
        return F.when(lost, held).otherwise(F.concat(F.slice(held, F.lit(1), a), F.transform(own, lambda c: F.array_append(c, x)), F.slice(held, b + 2, F.col("cells"))))

    held = F.aggregate("some", F.array_repeat(F.filter("some", lambda x: F.lit(False)), F.col("cells")), step)
    kept = F.flatten(F.transform(held, lambda c, i: F.filter(c, lambda k: cell(k["t_start"]) == i)))
    every = F.concat(F.filter("all", lambda x: ~lasting(x)), kept)
    return ordered.select(F.explode(every).alias("s")).select(*[F.col(f"s.`{c}`") for c in columns])


def dedup_by_score(segments: DataFrame, threshold: float = DEFAULT.overlap) -> DataFrame:
    """Highest score first; equal scores in input order."""
    return greedy_keep(segments, [-F.col("score"), F.col("ord")], threshold)


def dedup_by_start(segments: DataFrame, threshold: float = DEFAULT.overlap) -> DataFrame:
    """Earliest start first; equal starts in input order."""
    return greedy_keep(segments, [F.col("t_start"), F.col("ord")], threshold)


def rank_and_number(segments: DataFrame, most: int | None = None, order: str = "ord") -> DataFrame:
    """Adds rank and seg_id (r01, r02, ...) by falling score, equal scores in input order; keeps the first `most`, if given."""
    ranked = segments.withColumn("rank", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("score"), order)))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    digits = F.col("rank").cast("string")
    return ranked.withColumn("seg_id", F.concat(F.lit("r"), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)))


def parse_candidates(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """responses (tid, chunk_no, answer) to (segments, quarantined (tid, chunk_no, reason)).

    Reasons: empty, invalid_json, no_segments (not an object, or no array of that name), bad_segment (a required field is
    missing or of another type, or the score is outside 0..100; the whole answer goes). An
    empty array gives no rows. reason and topic default to the empty text.
    """
    blank = F.col("answer").isNull() | (F.trim("answer") == "")
    value = F.try_parse_json("answer")
    array = F.try_variant_get(value, "$.segments", "array<variant>")
    shaped = F.from_json("answer", f"struct<segments:array<{SEGMENT}>>")["segments"]
    whole = F.transform(shaped, lambda s: F.array(*[s[c].isNotNull() for c in REQUIRED]))
    sound = F.forall(whole, lambda a: F.forall(a, lambda x: x)) & F.forall(shaped, lambda s: s["score"].between(0, 100))
    reason = (
        F.when(blank, "empty").when(value.isNull(), "invalid_json").when(~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)) | array.isNull(), "no_segments")
        .when(~F.coalesce(sound, F.lit(False)), "bad_segment")
    )
    judged = responses.select("tid", "chunk_no", reason.alias("reason"), shaped.alias("segments"))
    rows = judged.where("reason is null").select("tid", "chunk_no", F.posexplode("segments").alias("pos", "s"))
    segments = rows.select(
        "tid", "chunk_no", "pos", F.col("s.start").alias("t_start"), F.col("s.end").alias("t_end"), "s.score", "s.hook", "s.title", "s.description",
        F.coalesce("s.reason", F.lit("")).alias("reason"), F.coalesce("s.topic", F.lit("")).alias("topic"), F.array().cast("array<string>").alias("flags"),
    )
    return segments, judged.where("reason is not null").select("tid", "chunk_no", "reason")


def union_chunk_candidates(parsed: DataFrame) -> DataFrame:
    """Candidates of all chunks that pass the flags and filters, pooled per transcript in chunk order (ord)."""
    passed = filter_by_duration(filter_by_score(flag_durations(parsed)))
    return passed.withColumn("ord", F.row_number().over(Window.partitionBy("tid").orderBy("chunk_no", "pos")) - 1)


def select_pipeline(responses: DataFrame, tokens: DataFrame, budget: int = DEFAULT.chunk_tokens) -> DataFrame:
    """Answers to ranked segments. tokens (tid, tokens): the estimate of each whole compressed text; over the budget, overlaps go by start, else by score."""
    pooled = union_chunk_candidates(parse_candidates(responses)[0])
    sized = pooled.join(tokens.select("tid", (F.col("tokens") > budget).alias("__chunked")), ["tid"], "left")
    first = F.when(F.coalesce("__chunked", F.lit(False)), F.col("t_start")).otherwise(-F.col("score").cast("double"))
    return rank_and_number(greedy_keep(sized, [first, F.col("ord")], DEFAULT.overlap).drop("__chunked"), order="ord")
