"""Operators on timed words: words(tid, idx, word, t0, t1), one row per word, ordered by idx within a transcript.

Everything is windowed or grouped by tid first, so one shuffle by tid serves a chain of these
operators. Transcripts without words have no rows and appear in no result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.config import DEFAULT

def in_order() -> Window:
    """The words of a transcript in order."""
    return Window.partitionBy("tid").orderBy("idx")


def from_behind(place: str = "idx") -> Window:
    """The words (or other rows, by their place) from one on, the last first: a frame that grows word by word, where one that shrinks would be read anew for each."""
    return Window.partitionBy("tid").orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before() -> Window:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def word_class(words: DataFrame, hanging=DEFAULT.hanging) -> DataFrame:
    """Adds sentence_end, midphrase and hanging flags."""
    word = F.col("word")
    return words.withColumns({"sentence_end": X.ends_sentence(word), "midphrase": X.ends_midphrase(word), "hanging": X.is_hanging(word, hanging)})


def split_sentences(words: DataFrame, pause: float = DEFAULT.sentence_pause) -> DataFrame:
    """Adds sent_no, from 0: a sentence ends with a sentence mark (quotes and brackets after it don't count) or where the next word starts more than `pause` later."""
    breaks = X.closes_sentence(F.col("word")) | F.coalesce(F.lead("t0").over(in_order()) - F.col("t1") > pause, F.lit(False))
    return words.withColumn("__break", breaks.cast("int")).withColumn("sent_no", F.coalesce(F.sum("__break").over(before()), F.lit(0)).cast("int")).drop("__break")


def sentences(numbered: DataFrame) -> DataFrame:
    """Words with sent_no to one row per sentence: t0 of its first word, t1 of its last, text, n_words."""
    held = numbered.groupBy("tid", "sent_no").agg(F.array_sort(F.collect_list(F.struct("idx", "word", "t0", "t1"))).alias("w"))
    return held.select(
        "tid", "sent_no", F.get("w", F.lit(0))["t0"].alias("t0"), F.element_at("w", -1)["t1"].alias("t1"),
        F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"), F.size("w").alias("n_words"))


def sentences_of(transcripts: DataFrame, pause: float = DEFAULT.sentence_pause) -> DataFrame:
    """As sentences(split_sentences(words)), of transcripts (tid, words: array<struct<word,t0,t1>>): each is cut in its own row, so no word is sorted or gathered."""
    words = F.col("words")

    def start(x: Column, k: Column) -> Column:
        last = F.get(words, k - 1)
        return F.when((k == 0) | X.closes_sentence(last["word"]) | (x["t0"] - last["t1"] > pause), k)

    starts = F.filter(F.transform(words, start), lambda k: k.isNotNull())
    # Out of an array of one, so that the starts are found once a transcript.
    cut = transcripts.select("tid", "words", F.explode_outer(F.array(starts)).alias("__starts"))
    part = lambda a, k: F.slice("words", a + 1, F.coalesce(F.get("__starts", k + 1), F.size("words")) - a)
    each = cut.select("tid", F.explode_outer(F.array(F.transform("__starts", part))).alias("__parts")).select("tid", F.posexplode("__parts").alias("sent_no", "w"))
    return each.select("tid", "sent_no", F.get("w", F.lit(0))["t0"].alias("t0"), F.element_at("w", -1)["t1"].alias("t1"), F.array_join(F.col("w.word"), " ").alias("text"), F.size("w").alias("n_words"))


def compressed_lines(rows: DataFrame) -> DataFrame:
    """Sentence rows to lines '[0124.3-0131.0] text'."""
    return rows.select("tid", "sent_no", F.concat(F.lit("["), X.padded_seconds(F.col("t0")), F.lit("-"), X.padded_seconds(F.col("t1")), F.lit("] "), "text").alias("line"))


def phrase_ends(words: DataFrame, pause: float = DEFAULT.phrase_pause, micro: float = DEFAULT.micro_pause, hanging=DEFAULT.hanging, name: str = "phrase_end") -> DataFrame:
    """Adds a flag: a thought ends with this word. A sentence mark always does, a mark inside a sentence never; else a long pause or the last word, unless it is hanging."""
    gap = F.lead("t0").over(in_order()) - F.col("t1")
    long = gap.isNull() | ((gap > micro) & (gap > pause))
    word = F.col("word")
    return words.withColumn(name, X.ends_sentence(word) | (~X.ends_midphrase(word) & long & ~X.is_hanging(word, hanging)))


def phrase_starts(words: DataFrame, pause: float = DEFAULT.phrase_pause, hanging=DEFAULT.hanging) -> DataFrame:
    """Adds phrase_start (first word, after a sentence end, or after a long pause that no inner mark precedes) and next_clean (idx of this or the next word that isn't hanging)."""
    last, gap = F.lag("word").over(in_order()), F.col("t0") - F.lag("t1").over(in_order())
    start = last.isNull() | X.ends_sentence(last) | ((gap > pause) & ~X.ends_midphrase(last))
    return words.withColumns({"phrase_start": start, "next_clean": F.min(F.when(~X.is_hanging(F.col("word"), hanging), F.col("idx"))).over(from_behind())})


def pause_ends(words: DataFrame, pause: float = DEFAULT.sentence_pause) -> DataFrame:
    """Adds pause_end: the last word, or a pause longer than the threshold follows."""
    gap = F.lead("t0").over(in_order()) - F.col("t1")
    return words.withColumn("pause_end", gap.isNull() | (gap > pause))


def part_starts(limit: float) -> Column:
    """Where the parts of a sentence (w: its words in order, gaps: the gap before each) start, in places from 0.

    A stack of stretches that are still to be looked at, the first on top: at each step the top one either fits, and its start is noted, or is
    cut in two. A sentence of n words takes fewer than 2 n steps.
    """
    w, top = F.col("w"), lambda seen: F.element_at(seen["stack"], -1)
    stretch = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    large = lambda s: (s["b"] - s["a"] > 1) & (F.get(w, s["b"] - 1)["t1"] - F.get(w, s["a"])["t0"] > limit)

    def cut_of(s: Column) -> Column:
        inner = F.slice("gaps", s["a"] + 2, s["b"] - s["a"] - 1)
        near = lambda g, k: F.when(F.abs(g - F.array_max(inner)) <= 1e-9, F.struct(F.abs(k + 1 - (s["b"] - s["a"]) / 2).alias("d"), (k + 1 + s["a"]).alias("k")))
        return F.array_min(F.transform(inner, near))["k"]

    def step(seen: Column, _: Column) -> Column:
        s, rest = top(seen), F.slice(seen["stack"], F.lit(1), F.size(seen["stack"]) - 1)
        halves = F.transform(F.array(cut_of(s)), lambda k: F.concat(F.array(stretch(k, s["b"])), F.array(stretch(s["a"], k))))[0]
        both = F.struct(F.when(large(s), F.concat(rest, halves)).otherwise(rest).alias("stack"), F.when(large(s), seen["starts"]).otherwise(F.array_append(seen["starts"], s["a"])).alias("starts"))
        return F.when(F.size(seen["stack"]) > 0, both).otherwise(seen)

    whole = stretch(F.lit(0), F.size(w))
    folded = F.aggregate(F.sequence(F.lit(1), 2 * F.size(w)), F.struct(F.array(whole).alias("stack"), F.array().cast("array<int>").alias("starts")), step)
    return F.when(large(whole), folded["starts"]).otherwise(F.array(F.lit(0)))


def split_oversize(numbered: DataFrame, limit: float = DEFAULT.sentence_limit) -> DataFrame:
    """Renumber sent_no so that no sentence of several words spans more than `limit`.

    An oversize sentence is cut at its longest inner gap; of gaps equal within 1e-9 the one nearest the
    middle, then the first. Parts are cut again until they fit. Sentences are folded one by one, in the shuffle by tid that numbered them.
    """
    columns = numbered.columns
    word = F.struct("idx", *[c for c in columns if c != "idx"])
    whole = numbered.groupBy("tid", "sent_no").agg(F.array_sort(F.collect_list(word)).alias("w"))
    gapped = whole.withColumn("gaps", F.transform("w", lambda x, k: x["t0"] - F.get(F.col("w"), k - 1)["t1"])).withColumn("starts", part_starts(limit))
    each = gapped.select("starts", F.posexplode_outer("w").alias("k", "x")).select(*[F.col(f"x.`{c}`") for c in columns], F.array_contains("starts", F.col("k")).cast("int").alias("__new"))
    return each.withColumn("sent_no", (F.sum("__new").over(Window.partitionBy("tid").orderBy("idx")) - 1).cast("int")).select(*columns)


def paragraph_piece(pause: float = DEFAULT.paragraph_pause) -> Column:
    """A sentence row's text with what stands before it: nothing, a space, or a blank line after more than `pause`."""
    order = Window.partitionBy("tid").orderBy("sent_no")
    mark = F.when(F.lag("t1").over(order).isNull(), "").when(F.col("t0") - F.lag("t1").over(order) > pause, "\n\n").otherwise(" ")
    return F.concat(mark, F.col("text"))


def cue_mark(fmt: str) -> tuple[str, str]:
    """The mark before milliseconds and what a track starts with."""
    if fmt not in ("srt", "vtt"):
        raise ValueError(f"unknown cue format {fmt!r}")
    return (",", "") if fmt == "srt" else (".", "WEBVTT\n\n")


def cue(fmt: str) -> Column:
    """A sentence row as a numbered cue."""
    mark, _ = cue_mark(fmt)
    number = F.row_number().over(Window.partitionBy("tid").orderBy("sent_no"))
    return F.concat_ws("\n", number.cast("string"), F.concat(X.clock(F.col("t0"), mark), F.lit(" --> "), X.clock(F.col("t1"), mark)), F.col("text"))


def joined(column: str, between: str) -> Column:
    """An aggregate: the column's values in the order of the sentences."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_no", column))), lambda x: x[column]), between)


def paragraph_text(rows: DataFrame, pause: float = DEFAULT.paragraph_pause) -> DataFrame:
    """Sentence rows to (tid, text): sentences joined by a space; a blank line where more than `pause` lies between two."""
    return rows.withColumn("piece", paragraph_piece(pause)).groupBy("tid").agg(joined("piece", "").alias("text"))


def cue_track(rows: DataFrame, fmt: str = "srt") -> DataFrame:
    """Sentence rows to (tid, text): one numbered cue per sentence, as 'srt' or 'vtt'."""
    _, head = cue_mark(fmt)
    return rows.withColumn("cue", cue(fmt)).groupBy("tid").agg(F.concat(F.lit(head), joined("cue", "\n\n"), F.lit("\n")).alias("text"))


def word_json(words: DataFrame) -> DataFrame:
    """(tid, text): the words in order as a JSON array of {word, t0, t1}."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "word", "t0", "t1"))), lambda x: F.struct(x["word"].alias("word"), x["t0"].alias("t0"), x["t1"].alias("t1")))
    return words.groupBy("tid").agg(F.to_json(ordered).alias("text"))
