"""Benchmark decontamination as a prefix-filtered set join.

Every window of `width` consecutive item words (an item of fewer words is one window)
must be found wherever it occurs in a document. Containment of a whole window needs
every one of its words, so its prefix is its single rarest word: words are ordered by
their number of occurrences in the documents, and only documents' words equal to such
a prefix word become candidates. A candidate's place must leave room for the whole window
before and after (positional and length bounds), and the words there must equal the
window (verification). All of this happens in one pass over each document's word array;
texts are never shuffled and no pair of documents and items is formed without a shared
prefix word. What is broadcast are windows, a bounded number at a time; the items that hold them
are not: a window carries the name of its set of items, and each combination of sets that
some documents have is turned into a list of items once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, cut, join_weighed

#: What separates words: every ASCII character that is neither a digit nor a letter. Fixed by the contract.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
#: Windows that one broadcast may hold; more are handled in blocks of this size.
BLOCK = 200_000


def words_of(text: Column) -> Column:
    """Lower-cased words of the text in order; null and wordless texts give an empty array."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def item_windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """Distinct windows: window array<string>, items array<struct<id>> (the items that hold it, in order; a null id is an item too), set (names the same items alike)."""
    worded = items.select(F.struct(F.col(item_id).cast("string").alias("id")).alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))
    windows = worded.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("window"))
    held = windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return held.withColumn("set", F.unhex(F.md5(F.to_json("items").cast("binary"))))


def occurrences(documents: DataFrame, text: str, vocabulary: DataFrame, size: int) -> DataFrame:
    """word, n: how often each word of the vocabulary occurs in all documents (those that occur). Words are counted before they are shuffled."""
    seen = documents.select(F.explode(words_of(F.col(text))).alias("word"))
    kept = bounded(vocabulary, size)
    few = seen.join(kept, ["word"], "left_semi") if kept is not vocabulary else seen
    counts = few.groupBy("word").agg(F.count("*").alias("n"))
    return counts if kept is not vocabulary else counts.join(vocabulary, ["word"], "left_semi")


def with_prefix(windows: DataFrame, documents: DataFrame, text: str) -> DataFrame:
    """Windows with their rarest word: window, set, token, at (its first place, from 0). Windows with a word that no document has are gone."""
    spread = windows.select("window", F.posexplode("window").alias("at", "word"))
    vocabulary = cut(spread.select("word").distinct())
    size = vocabulary.count()
    counts = bounded(cut(occurrences(documents, text, vocabulary, size)), size)
    ranked = spread.join(counts, ["word"], "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word"), F.col("at"))).alias("rarest"),
    )
    return windows.join(ranked, ["window"]).where("rarest.n > 0").select("window", "set", F.col("rarest.word").alias("token"), F.col("rarest.at").alias("at"))


def occurring(documents: DataFrame, text: str, keys: list[str], windows: DataFrame) -> DataFrame:
    """A row for each place where a window stands: the keys, start (from 0), length, set."""
    worded = documents.select(*keys, words_of(F.col(text)).alias("words"))
    spread = worded.select(*keys, "words", F.posexplode("words").alias("pos", "token"))
    candidates = spread.join(F.broadcast(windows), ["token"]).withColumns({"start": F.col("pos") - F.col("at"), "length": F.size("window")})
    bounded = candidates.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.size("words")))
    same = bounded.where(F.slice("words", F.col("start") + 1, F.col("length")) == F.col("window"))
    return same.select(*keys, "start", "length", "set")


def covered(spans: Column) -> Column:
    """Number of places that the spans (start, length) cover together."""
    merged = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda seen, span: F.struct(
            (seen["n"] + F.greatest(F.lit(0), span["start"] + span["length"] - F.greatest(seen["end"], span["start"]))).alias("n"),
            F.greatest(seen["end"], span["start"] + span["length"]).alias("end"),
        ),
    )
    return merged["n"]


def found_places(documents: DataFrame, windows: DataFrame, doc_id: str, text: str, keys: Column) -> DataFrame:
    """One row per document with a hit: doc_id, fingerprint, spans, sets (names of the item sets of its windows, in order). windows: stored, with prefix."""
    blocks = max(1, -(-windows.count() // BLOCK))
    keyed = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), keys.alias("fingerprint"))
    found = None
    for block in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        hits = occurring(keyed, "text", ["doc_id", "fingerprint"], part)
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("doc_id", "fingerprint").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.array_sort(F.collect_set("set")).alias("sets"))


def find_contamination(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document with a hit: doc_id, fingerprint (of the text), n_hit long, spans array<struct<start,length>>, items array<string> (sorted).

    Rows that repeat both id and text share one result row. Null texts and null item texts
    have no words; an empty benchmark gives no rows. Items with a null id count as one item, null, the last in items.
    """
    held = cut(item_windows(items, item_id, item_text, width))
    windows = cut(with_prefix(held, documents, text))
    places = cut(found_places(documents, windows, doc_id, text, F.xxhash64(text)))
    combined = places.groupBy("sets").agg(F.count("*").alias("docs"))
    named = combined.select("sets", "docs", F.explode("sets").alias("set")).join(held.select("set", "items").dropDuplicates(["set"]), ["set"])
    listed = cut(named.groupBy("sets").agg(F.first("docs").alias("docs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    joined = join_weighed(places, listed, ["sets"], "docs")
    return joined.select("doc_id", "fingerprint", covered(F.col("spans")).cast("long").alias("n_hit"), F.array_sort("spans").alias("spans"), F.transform("items", lambda i: i["id"]).alias("items"))


def contamination_report(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document row: doc_id, n_words long, n_hit long, items array<string>, spans; documents without a hit have 0 and empty arrays."""
    found = find_contamination(documents, items, width=width).withColumnsRenamed({"doc_id": "__id", "fingerprint": "__print"})
    counted = documents.select("doc_id", F.xxhash64("text").alias("fingerprint"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("fingerprint") == F.col("__print")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans",
    )


def drop_contaminated(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that hold no window of any item; columns and repeated rows stay as they are."""
    found = find_contamination(documents, items, width=width).select(F.col("doc_id").alias("__id"), F.col("fingerprint").alias("__print"))
    return documents.join(found, documents["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(documents["text"]) == F.col("__print")), "left_anti")
