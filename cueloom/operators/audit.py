"""How well segments end: the class of each end, the cause of a bad one, and counts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import DEFAULT, Config
from .boundaries import pages_of
from .words import from_behind

#: End types and causes. Fixed values.
SENTENCE, SPEECH_END, NO_WORDS, COMMA, HANGING, MID_WORD, PAUSE = "фраза(.!?)", "конец речи", "нет слов", "запятая", "висячее", "мид-слово", "пауза"
NO_WORDS_CAUSE, PADDED, FALLBACK, NO_BOUNDARY = "нет слов в клипе", "PAD-хвост", " (snap-fallback)", "snap-fallback (нет чистой границы)"
SLACK = 0.05


def decimals(value, pattern: str):
    """Rounded half to even as the binary value lies."""
    return F.call_function("format_number", value, F.lit(pattern)).cast("double")


def with_tails(pages: DataFrame) -> DataFrame:
    """Pages (tid, page, ends, starts, words) with since (the least end from the page on), until (the greatest start up to it) and tail.

    tail: the last words before the page that may be asked for by a segment whose last word lies in the page. Such a segment ends at `since` or later, so
    words that end by then are surely among those that end by its end: five of these are enough for its last words, and the walk back
    stops before one that doesn't end a sentence. So a tail is some five words, or more where words overlap; as `since` never falls,
    each tail is cut out of the one before and the page between.
    """
    places = Window.partitionBy("tid").orderBy("page")
    edged = pages.withColumns({"since": F.min("ends").over(from_behind("page")), "until": F.max("starts").over(places.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    edged = edged.withColumn("later", F.lead("since").over(places))
    whole = edged.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("page", "since", "until", "later", "words"))).alias("p"))

    def cut_off(known: Column, later: Column) -> Column:
        def bounded(c: Column, sure: Column) -> Column:
            fifth, wall = F.get(sure, F.size(sure) - 5), F.array_max(F.filter(sure, lambda k: ~F.get(c, k)["sentence_end"]))
            first = F.least(F.coalesce(fifth, F.lit(0)), F.coalesce(wall, F.lit(0)))
            return F.slice(c, first + 1, F.size(c) - first)
        surely = lambda c: F.filter(F.transform(c, lambda x, k: F.when(x["t1"] <= later, k)), lambda k: k.isNotNull())
        return F.transform(F.array(known), lambda c: F.transform(F.array(surely(c)), lambda sure: bounded(c, sure))[0])[0]

    none = F.slice(F.col("p")[0]["words"], 1, 0)
    # The tails so far must not be handed through a transform, which copies all that it gives.
    folded = F.aggregate("p", F.struct(none.alias("tail"), F.filter(F.array(none), lambda x: F.lit(False)).alias("tails")), lambda seen, page: F.struct(
        cut_off(F.concat(seen["tail"], page["words"]), page["later"]).alias("tail"), F.array_append(seen["tails"], seen["tail"]).alias("tails")))
    each = whole.select("tid", F.explode(F.arrays_zip(F.col("p"), folded["tails"].alias("tail"))).alias("e"))
    return each.select("tid", "e.p.page", "e.p.since", "e.p.until", "e.p.words", "e.tail")


#: What the rows of a transcript stand for, in the order in which they stand at one time.
ENDS_BY, ASKS = 0, 1


def upto(*order: Column) -> Window:
    """The rows of a transcript up to this one."""
    return Window.partitionBy("tid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def classify_end(segments: DataFrame, words: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row per segment: tid, ord, duration, last_words, end_type, pause_after, verdict (CLEAN, SOFT or HARD), cause. words: flagged.

    The last word is the last in order that ends by t_end; a word
    that starts inside a preceding sentence's last word gives way to that one. The cause of a
    HARD end is the padding's overshoot past the last phrase end, else what the end is. Segments with a null t_end have no words.

    A segment takes one page for its last word, the last that has a word which ends by t_end, and one for the next start, the first that has a
    start past the last word. Both are found by sorting pages and segments by time together: by the least end from a page on, which
    never falls from page to page, and by the greatest start up to it. So words are neither copied to nor searched for each segment.
    """
    pages = with_tails(pages_of(words, "word", "sentence_end", "midphrase", "hanging", "phrase_end"))
    page = F.struct("page", "until", F.concat("tail", "words").alias("words"), F.transform("words", lambda x: x["t0"]).alias("starts"))
    event = lambda t, page, stop: F.struct(t.alias("t"), page.alias("page"), stop.alias("stop"))
    no_page, no_stop = F.when(F.lit(False), page), F.lit(None).cast("double")
    stops = F.transform(F.filter("words", lambda x: x["phrase_end"]), lambda x: event(x["t1"], no_page, x["t1"]))
    known = pages.select("tid", F.explode(F.concat(F.array(event(F.col("since"), page, no_stop)), stops)).alias("e")).select("tid", F.lit(ENDS_BY).alias("kind"), "e.t", "e.page", "e.stop")
    asked = segments.select("tid", F.lit(ASKS).alias("kind"), (F.col("t_end") + SLACK).alias("t"), F.struct("ord", "t_start", "t_end").alias("s"))
    every = known.where("t is not null").unionByName(asked, allowMissingColumns=True)
    by_end = upto(F.asc("t"), F.asc("kind"))
    at = every.withColumns({"at": F.last("page", ignorenulls=True).over(by_end), "last_stop": F.last("stop", ignorenulls=True).over(by_end)})
    asks = F.col("kind") == ASKS
    ended = F.when(asks, F.filter("at.words", lambda x: x["t1"] <= F.col("t")))
    found = at.where(asks | F.col("page").isNotNull()).withColumn("a", ended)
    a = lambda k: F.get(F.col("a"), k - 1)
    places = F.when(F.size("a") > 0, F.sequence(F.lit(1), F.size("a"))).otherwise(F.array().cast("array<int>"))
    last = F.array_max(F.filter(places, lambda k: (k == 1) | ~((a(k)["t0"] < a(k - 1)["t1"]) & a(k - 1)["sentence_end"])))
    last_words = F.coalesce(F.array_join(F.transform(F.slice("a", F.greatest(F.lit(1), F.size("a") - 4), 5), lambda x: x["word"]), " "), F.lit(""))
    walked = found.select("tid", "kind", "s", "last_stop", F.get(F.col("a"), last - 1).alias("w"), last_words.alias("last_words"), F.when(~asks, F.col("page.page")).alias("page"), F.when(~asks, F.col("page.starts")).alias("starts"), F.col("page.until").alias("until"))
    passed = walked.withColumn("past", F.when(asks, F.col("w.t1") + 0.001).otherwise(F.col("until")))
    # From behind; at one time a segment comes before the pages that start no later, and of equal pages the first in order is the last here.
    onward = F.last("starts", ignorenulls=True).over(upto(F.desc("past"), F.desc("kind"), F.desc("page")))
    ahead = passed.withColumn("onward", onward).where(asks & F.col("s").isNotNull())
    after_t0 = F.get(F.filter("onward", lambda t0: t0 > F.col("past")), F.lit(0))
    ahead = ahead.withColumn("pause_after", decimals(F.when(F.col("w").isNotNull(), after_t0) - F.col("w.t1"), "0.00"))
    gap = F.col("pause_after")
    kind = (
        F.when(F.col("w").isNull(), NO_WORDS).when(F.col("w.sentence_end"), SENTENCE).when(gap.isNull(), SPEECH_END).when(F.col("w.midphrase"), COMMA).when(F.col("w.hanging"), HANGING)
        .when(gap >= config.phrase_pause, f"{PAUSE}≥{config.phrase_pause:.1f}").when(gap < config.micro_pause, MID_WORD).otherwise(PAUSE)
    )
    verdict = F.when(F.col("end_type").isin(NO_WORDS, COMMA, HANGING, MID_WORD), "HARD").when(F.col("end_type") == PAUSE, "SOFT").otherwise("CLEAN")
    judged = ahead.select("tid", "s.ord", "s.t_end", "last_stop", decimals(F.col("s.t_end") - F.col("s.t_start"), "0.0").alias("duration"), "last_words", kind.alias("end_type"), "pause_after").withColumn("verdict", verdict)
    return judged.withColumn("cause", cause(F.col("last_stop"), config)).drop("t_end", "last_stop")


def cause(last_stop: Column, config: Config) -> Column:
    """The cause of a HARD end (t_end, end_type, verdict), else empty. last_stop: the last end of a phrase by t_end."""
    over = F.col("t_end") - last_stop
    padded = (over > 0.05) & (over <= config.tail_pad + 0.35)
    named = F.concat(F.lit(f"{PADDED} +"), F.call_function("format_number", over, F.lit("0.00")), F.lit("с"))
    return (
        F.when(F.col("verdict") != "HARD", "").when(F.col("end_type") == NO_WORDS, NO_WORDS_CAUSE).when(padded, named)
        .when(F.col("end_type").isin(COMMA, HANGING), F.concat("end_type", F.lit(FALLBACK))).otherwise(NO_BOUNDARY)
    )


def hard_cause(ends: DataFrame, words: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds cause to classified ends (tid, t_end, end_type, verdict, ...): empty unless HARD. words: flagged. Ends and phrase ends are sorted by time together."""
    names = [c for c in ends.columns if c != "cause"]
    stops = words.where(F.col("phrase_end") & F.col("t1").isNotNull()).select("tid", F.lit(ENDS_BY).alias("kind"), F.col("t1").alias("t"), F.col("t1").alias("stop"))
    asked = ends.select("tid", F.lit(ASKS).alias("kind"), (F.col("t_end") + SLACK).alias("t"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("s"))
    found = stops.unionByName(asked, allowMissingColumns=True).withColumn("last_stop", F.last("stop", ignorenulls=True).over(upto(F.asc("t"), F.asc("kind")))).where(F.col("kind") == ASKS)
    flat = found.select(*[F.col("s").getField(c).alias(c) for c in names], F.col("last_stop").alias("__stop"))
    return flat.withColumn("cause", cause(F.col("__stop"), config)).drop("__stop")


def end_quality_summary(ends: DataFrame) -> DataFrame:
    """(tid, verdict, cause, n): ends by verdict and by cause without its amount, per transcript and, with a null tid, in all."""
    short = F.substring_index("cause", " +", 1)
    return ends.withColumn("cause", short).groupingSets([["tid", "verdict", "cause"], ["verdict", "cause"]], "tid", "verdict", "cause").agg(F.count("*").alias("n"))
