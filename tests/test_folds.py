"""Cuts of oversize sentences, splits at silences and stitching against plain walks by hand."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cueloom.operators import media as M
from cueloom.operators import words as O

WORDS = "tid int, idx int, sent_no int, word string, t0 double, t1 double, note string"


def parts_by_hand(sentence, limit):
    """Numbers of words of the parts of a sentence [(t0, t1)], cut again and again."""
    n = len(sentence)
    if n < 2 or not sentence[-1][1] - sentence[0][0] > limit:
        return [n]
    gaps = [sentence[k][0] - sentence[k - 1][1] for k in range(1, n)]
    k = min((abs(k - n / 2), k) for k in range(1, n) if abs(gaps[k - 1] - max(gaps)) <= 1e-9)[1]
    return parts_by_hand(sentence[:k], limit) + parts_by_hand(sentence[k:], limit)


@pytest.mark.parametrize("limit", [0.0, 4.0, 30.0])
def test_oversize_sentences_equal_cuts_by_hand(spark, limit):
    rng = random.Random(3)
    said, rows = {}, []
    for tid in range(12):
        t, k, said[tid] = 0.0, 0, []
        for sent in range(rng.choice([1, 3])):
            sentence = []
            for _ in range(rng.choice([1, 2, 9, 120])):
                sentence.append((t, t + rng.choice([0.1, 0.5, 2.0])))
                t = sentence[-1][1] + rng.choice([0.1, 0.1, 0.2, 0.2, 0.3, -0.05])
            said[tid].append(sentence)
            for t0, t1 in sentence:
                rows.append((tid, k, sent, f"w{k}", t0, t1, None))
                k += 1
    frame = spark.createDataFrame(rows, WORDS).repartition(5)
    split = O.split_oversize(frame, limit)
    assert split.columns == frame.columns
    counts = {(r["tid"], r["sent_no"]): r["n"] for r in split.groupBy("tid", "sent_no").agg(F.count("*").alias("n")).collect()}
    for tid, sentences in said.items():
        want = [n for s in sentences for n in parts_by_hand(s, limit)]
        assert [counts[tid, k] for k in range(len(want))] == want and (tid, len(want)) not in counts
    assert {(r["tid"], r["idx"], r["word"]) for r in split.collect()} == {(r[0], r[1], r[3]) for r in rows}


def test_planning_a_split_runs_nothing(spark, monkeypatch):
    frame = spark.createDataFrame([(1, 0, 0, "a", 0.0, 100.0, None)], WORDS)
    monkeypatch.setattr(type(frame), "checkpoint", None)
    assert "Exchange" in O.split_oversize(frame)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("window", [0.0, 3.0, 30.0, 5000.0])
def test_nearest_splits_equal_all_silences_by_hand(spark, window):
    rng = random.Random(9)
    silences = [(tid, pos, s, s + rng.choice([0.0, 1.0, 2.0])) for tid in range(6) for pos, s in enumerate(sorted(rng.randrange(0, 2000) / 2 for _ in range(rng.choice([1, 5, 200]))))]
    silences += [(7, 0, None, 5.0), (None, 0, 99.0, 101.0)]
    targets = [(tid, n, n * 100.0) for tid in (*range(8), None) for n in range(1, 9)]
    made = M.nearest_split(spark.createDataFrame(targets, "tid int, n int, target double"), spark.createDataFrame(silences, "tid int, pos int, s double, e double")).collect() if window == 30.0 else M.nearest_split(
        spark.createDataFrame(targets, "tid int, n int, target double"), spark.createDataFrame(silences, "tid int, pos int, s double, e double"), window).collect()
    assert len(made) == len(targets)
    for r in made:
        middles = [((s + e) / 2, pos) for tid, pos, s, e in silences if tid is not None and tid == r["tid"] and s is not None]
        near = [(abs(m - r["target"]), pos, m) for m, pos in middles if abs(m - r["target"]) <= window]
        assert r["at"] == (min(near)[2] if near else r["target"])


CHUNKS = "tid long, chunk_no int, start double, language string, words array<struct<word:string,t0:double,t1:double>>"


def stitched_by_hand(chunks):
    kept = []
    for start, words in chunks:
        if words is None:
            continue
        new = [(w, a + start, b + start) for w, a, b in words]
        if kept and new:
            first = next((k for k, w in enumerate(new) if w[1] >= kept[-1][2]), len(new))
            new = new[first:]
        kept += new
    return kept


def test_stitching_equals_a_walk_by_hand(spark):
    rng = random.Random(2)
    rows = []
    for tid in range(40):
        for k in range(rng.choice([1, 3, 8])):
            words, t = [], rng.choice([0.0, 1.0])
            for j in range(rng.choice([0, 1, 4, 9])):
                words.append((f"{tid}-{k}-{j}", t, t + rng.choice([0.5, 2.0])))
                t += rng.choice([0.0, 0.5, 1.0])
            rows.append((tid, k, k * 3.0, "", None if rng.random() < 0.15 else words))
    for r in M.stitch_chunks(spark.createDataFrame(rows, CHUNKS)).collect():
        assert [tuple(w) for w in r["words"]] == stitched_by_hand([(s, w) for tid, _, s, _, w in rows if tid == r["tid"]])


def test_stitching_time_grows_with_the_recording(spark):
    def seconds(n):
        word = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda j: F.struct(F.lit("w").alias("word"), (j * 0.2).alias("t0"), (j * 0.2 + 0.1).alias("t1")))
        chunks = spark.range(n).select(F.lit(1).cast("long").alias("tid"), F.col("id").cast("int").alias("chunk_no"), (F.col("id") * 9.0).alias("start"), F.lit("").alias("language"), word.alias("words"))
        began = time.time()
        assert M.stitch_chunks(chunks).select(F.size("words")).first()[0] > 40 * n
        return time.time() - began

    seconds(100)
    assert seconds(8_000) < 4 * seconds(2_000) + 2
