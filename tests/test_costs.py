"""Classes of words, and work that must not be repeated for each word."""

from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.operators import boundaries as B


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_words_are_flagged_by_one_sort(spark):
    words = spark.range(8).select(F.lit(1).alias("tid"), F.col("id").cast("int").alias("idx"), F.lit("a").alias("word"), (F.col("id") * 1.0).alias("t0"), (F.col("id") + 0.5).alias("t1"))
    assert plan(B.flagged(words)).count("Sort [") == 1


def test_padding_looks_at_each_word_once(spark):
    """The words kept aren't worked out anew within a lambda over the words."""
    words = spark.range(8).select(F.lit(1).alias("tid"), F.col("id").cast("int").alias("idx"), F.lit("a").alias("word"), (F.col("id") * 1.0).alias("t0"), (F.col("id") + 0.5).alias("t1"))
    rows = spark.createDataFrame([(1, 0, 0.0, 9.0)], "tid int, ord int, t_start double, t_end double")
    optimized = B.apply_padding(rows, B.flagged(words))._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in optimized.splitlines() if "forall(" in x)
    inner = line[: line.index("forall(")].rsplit("filter(", 1)[-1]
    assert "lambdafunction(((lambda" not in inner and "<= CASE" not in line


def test_classes_of_odd_words(spark):
    """As the regular expressions have them, also for words with line ends."""
    kinds = ["a.", "a", "", None, "a.\\n", "a.\n", "a.\n\n", "\n", ".", "a…", "a.»", 'a."', "a.)]", "a,", "a—", "a-", " a, ", "a.\r\n", "a. ", "a;\u0085", "».", "a.»b", "(и)", "«И»,", "--и--", "и\n", "и.\n", "a.\"\n"]
    words = spark.createDataFrame([(w,) for w in kinds], "word string")
    w = F.col("word")
    stripped = r"""[.!?…,;:"'»«()—–\-]+"""
    made = words.select(
        "word", X.ends_sentence(w), F.trim(w).rlike("[.!?…]$"), X.closes_sentence(w), w.rlike(r"""[.!?…][»"')\]]*$"""), X.ends_midphrase(w), F.trim(w).rlike("[,;:—–-]$"),
        X.is_hanging(w, ("и", "a")), F.lower(F.regexp_replace(F.trim(w), f"^{stripped}|{stripped}$", "")).isin("и", "a"))
    for word, *pairs in made.collect():
        assert [(word, k, a) for k, a in enumerate(pairs[::2])] == [(word, k, a) for k, a in enumerate(pairs[1::2])]
