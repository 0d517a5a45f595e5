"""Long recordings: when to cut them, where, how chunks are stitched, and what is lost with a failed chunk."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import DEFAULT, Config


def needs_chunking(media: DataFrame, enabled: bool = True, config: Config = DEFAULT) -> DataFrame:
    """media (tid, duration, size_bytes): those longer or larger than the limits (strictly)."""
    return media.where(F.lit(enabled) & ((F.col("duration") > config.long_minutes * 60) | (F.col("size_bytes") > config.long_bytes)))


def parse_silence_log(logs: DataFrame) -> DataFrame:
    """logs (tid, log) to silences (tid, pos, s, e): the n-th start with the n-th end; what has no partner is left out."""
    times = lambda name: F.regexp_extract_all("log", F.lit(rf"silence_{name}: ([0-9.]+)"), F.lit(1))
    pairs = logs.select("tid", F.posexplode(F.arrays_zip(times("start").alias("s"), times("end").alias("e"))).alias("pos", "p"))
    return pairs.select("tid", "pos", F.col("p.s").cast("double").alias("s"), F.col("p.e").cast("double").alias("e")).dropna()


def split_targets(media: DataFrame, every: float = DEFAULT.split_every) -> DataFrame:
    """media (tid, duration) to (tid, n, target): the whole multiples of `every` inside the recording."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("duration") / every)).cast("int")
    return media.withColumn("__n", chunks).where("__n > 1").select("tid", F.explode(F.sequence(F.lit(1), F.col("__n") - 1)).alias("n")).withColumn("target", F.col("n") * every)


def nearest_split(targets: DataFrame, silences: DataFrame, window: float = DEFAULT.split_window) -> DataFrame:
    """targets (tid, n, target) with at: the middle of the nearest silence whose middle is within the window (inclusive), the first of equals; else the target. Targets and silences are sorted by time together: the nearest one is the last before or the next after, however wide the window."""
    kind, t = F.col("kind"), F.col("t")
    middles = silences.select("tid", F.lit(0).alias("kind"), ((F.col("s") + F.col("e")) / 2.0).alias("t"), "pos").where("tid is not null and t is not null")
    asked = targets.select("tid", F.lit(1).alias("kind"), F.col("target").alias("t"), F.struct("n", "target").alias("q"))
    every = middles.unionByName(asked, allowMissingColumns=True)
    # At one time silences come before targets, from either side, and of silences the first in order last.
    side = lambda order: F.last(F.when(kind == 0, F.struct("pos", t.alias("mid"))), ignorenulls=True).over(Window.partitionBy("tid").orderBy(order, kind, F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = every.withColumns({"before": side(F.asc("t")), "after": side(F.desc("t"))}).where(kind == 1)
    target = F.col("q.target")
    near = lambda x: F.when((x["mid"] >= target - window) & (x["mid"] <= target + window), F.struct(F.abs(x["mid"] - target).alias("d"), x["pos"].alias("pos"), x["mid"].alias("mid")))
    best = F.array_min(F.array(near(F.col("before")), near(F.col("after"))))
    return met.select("tid", "q.n", "q.target", F.coalesce(best["mid"], target).alias("at"))


def stitch_chunks(chunks: DataFrame, default_language: str = "ru") -> DataFrame:
    """chunks (tid, chunk_no, start, language, words array<struct<word,t0,t1>> or null) to (tid, language, words) in chunk order, times shifted by each chunk's start.

    Of each chunk the leading words that start before the end of the last word kept go; words
    that overlap further on stay. Null chunks are left out. The language is the last one that isn't empty. The walk holds the end of the last word
    and where each chunk is cut; words are put together once.
    """
    item = F.struct("chunk_no", "start", F.coalesce("language", F.lit("")).alias("language"), "words")
    rows = chunks.groupBy("tid").agg(F.array_sort(F.collect_list(F.when(F.col("words").isNotNull(), item))).alias("parts"))
    shift = lambda c: F.transform(c["words"], lambda w: F.struct(w["word"].alias("word"), (w["t0"] + c["start"]).alias("t0"), (w["t1"] + c["start"]).alias("t1")))
    rows = rows.withColumn("shifted", F.transform("parts", shift))

    def cut(seen: Column, new: Column) -> Column:
        """seen (some: whether a word is kept, last: its end, cuts: where each chunk begins to be kept, from 1; 0: nowhere)."""
        onward = F.array_position(F.transform(new, lambda w: w["t0"] >= seen["last"]), F.lit(True)).cast("int")
        at = F.when(F.size(new) == 0, 0).when(~seen["some"], 1).otherwise(F.coalesce(onward, F.lit(0)))
        return F.transform(F.array(at), lambda k: F.struct((seen["some"] | (k > 0)).alias("some"), F.when(k > 0, F.get(new, F.size(new) - 1)["t1"]).otherwise(seen["last"]).alias("last"), F.array_append(seen["cuts"], k).alias("cuts")))[0]

    begun = F.struct(F.lit(False).alias("some"), F.lit(None).cast("double").alias("last"), F.array().cast("array<int>").alias("cuts"))
    rows = rows.withColumn("cuts", F.aggregate("shifted", begun, cut)["cuts"])
    kept = F.transform("shifted", lambda new, k: F.when(F.get("cuts", k) > 0, F.slice(new, F.get("cuts", k), F.size(new))).otherwise(F.slice(new, 1, 0)))
    spoken = F.filter(F.transform("parts", lambda c: c["language"]), lambda x: x != "")
    return rows.select("tid", F.coalesce(F.try_element_at(spoken, F.lit(-1)), F.lit(default_language)).alias("language"), F.flatten(kept).alias("words"))


def coverage_gaps(chunks: DataFrame, assumed: float = DEFAULT.split_every) -> DataFrame:
    """chunks (tid, chunk_no, start, words) to (tid, chunk_no, lost_from, lost_to) of the failed ones: to the next chunk's start, or `assumed` on."""
    following = F.lead("start").over(Window.partitionBy("tid").orderBy("chunk_no"))
    return chunks.withColumn("__next", following).where("words is null").select("tid", "chunk_no", F.col("start").alias("lost_from"), F.coalesce("__next", F.col("start") + assumed).alias("lost_to"))
