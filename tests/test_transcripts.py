"""Words as transcripts, a row each, give what they give as rows, without a sort, a window or an aggregate of words."""

import random

import pytest
from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.operators import boundaries as B
from cueloom.operators import words as O
from cueloom.plans import queries as Q
from cueloom.plans import views as V

WORDS = "tid long, idx int, word string, t0 double, t1 double"
ODD = ["да", "и", "а", "слово", "нет,", "всё.", "вот", "«и»,", "конец!»", "", " и ", "a.\n", " ", None, "потому", "--и", "И", "…"]


def transcript(rng, n):
    rows, t = [], 0.0
    for _ in range(n):
        back = rng.choice([0, 0, 0, 1.0])
        t0 = rng.choice([None, *[round(max(0.0, t - back), 3)] * 30])
        rows.append((rng.choice(ODD if rng.random() < 0.5 else ["и", "вот"]), t0, rng.choice([None, *[round((t0 or t) + rng.choice([0.0, 0.2, 2.0]), 3)] * 30])))
        t += rng.choice([0.0, 0.1, 0.5, 1.7, 4.0])
    return rows


def frames(spark, seed):
    rng = random.Random(seed)
    said = {tid: transcript(rng, n) for tid, n in enumerate([1, 2, 63, 64, 65, 300])}
    said[6] = [("и", float(k), k + 0.5) for k in range(200)] + [("слово", 200.0, 200.5)] + [("и", 201.0 + k, 201.5 + k) for k in range(200)]
    rows = spark.createDataFrame([(tid, k, *w) for tid, all_ in said.items() for k, w in enumerate(all_)], WORDS)
    whole = spark.createDataFrame([*said.items(), (7, []), (8, None)], "tid long, words array<struct<word:string,t0:double,t1:double>>")
    return said, rows, whole


def test_flags_of_transcripts_are_those_of_rows(spark):
    _, rows, whole = frames(spark, 1)
    made = B.flagged_transcripts(whole).select("tid", F.inline("words"))
    names = B.flagged(rows).columns
    assert sorted(made.columns) == sorted(names)
    assert sorted(map(tuple, made.select(names).collect()), key=repr) == sorted(map(tuple, B.flagged(rows).collect()), key=repr)


def test_sentences_of_transcripts_are_those_of_rows(spark):
    _, rows, whole = frames(spark, 2)
    old, new = O.sentences(O.split_sentences(rows)), O.sentences_of(whole)
    assert old.dtypes == new.dtypes and sorted(map(tuple, old.collect()), key=repr) == sorted(map(tuple, new.collect()), key=repr)


@pytest.mark.parametrize("steps", [B.snap, B.apply_padding, B.settle, lambda s, w: B.snap_end(B.snap_start(s, w), w), lambda s, w: B.resnap(s, w)[0], lambda s, w: B.resnap(s, w)[1]])
def test_segments_move_alike(spark, steps):
    said, rows, whole = frames(spark, 3)
    rng = random.Random(3)
    asked = [(tid, k, a, a + rng.choice([0.0, 3.0, 30.0, 70.0, -1.0])) for tid in [*said, 7, 99] for k in range(8) for a in [rng.choice([0.0, 5.5, 60.0, 199.8, 250.0, 700.0])]]
    asked += [(0, 90, None, 5.0), (0, 91, 5.0, None), (None, 92, 0.0, 5.0)]
    segments = spark.createDataFrame(asked, "tid long, ord int, t_start double, t_end double").withColumns({"flags": F.array(F.lit("too_long")), "r0_start": F.col("t_start"), "r0_end": F.col("t_end")})
    old, new = steps(segments, B.flagged(rows)), steps(segments, B.flagged_transcripts(whole))
    assert sorted(map(repr, old.collect())) == sorted(map(repr, new.collect()))


def test_snap_is_both_steps(spark):
    _, _, whole = frames(spark, 4)
    words = B.flagged_transcripts(whole)
    segments = spark.range(7).select(F.col("id").alias("tid"), F.explode(F.sequence(F.lit(0), F.lit(40))).alias("ord")).withColumns({"t_start": F.col("ord") * 7.3, "t_end": F.col("ord") * 8.1 + 20})
    assert sorted(map(repr, B.snap(segments, words).collect())) == sorted(map(repr, B.snap_end(B.snap_start(segments, words), words).collect()))


def test_classes_within_a_lambda(spark):
    texts = spark.createDataFrame([(w,) for w in [*ODD, "a.\n\n", ".", "a…", 'a."', "a-", " a, ", "a;\u0085", "(и)", "и\n", "очень длинное", "İ"]], "word string")
    w, hanging = F.col("word"), ("и", "а", "вот")
    quick = X.classes(w, hanging)
    for row in texts.select("word", F.array(quick["sentence_end"], quick["midphrase"], quick["hanging"]).alias("a"), F.array(X.ends_sentence(w), X.ends_midphrase(w), X.is_hanging(w, hanging)).alias("b")).collect():
        assert row["a"] == row["b"], row


@pytest.mark.parametrize("name", ["c4_snap_end", "h3_resnap", "h3_resnapped_segments", "h5_segment_pipeline"])
def test_no_words_are_sorted_or_gathered(spark, sf_dir, name):
    """The join takes the words as they come, and holds the segments; words are made twice at most, and once more for their sentences."""
    made = Q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [tid" not in made and made.count("ShuffledHashJoin [tid") == 1 and made.count("FileScan parquet") <= (3 if name[:2] == "h5" else 2)
    for frame in (Q.flags(spark, sf_dir), Q.rows(spark, sf_dir), B.whole_pages(V.transcripts(spark, sf_dir))):
        part = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(step in part for step in ("Sort", "Window", "Aggregate"))
