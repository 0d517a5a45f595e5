"""Greedy de-duplication against all pairs by hand, and its time in one long recording."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cueloom.operators import candidates as C

SEGMENTS = "tid int, ord int, t_start double, t_end double, score int, flags array<string>"


def kept_by_hand(rows, key, threshold):
    kept = []
    for r in sorted(rows, key=key):
        def over(k, r=r):
            if None in (r[2], r[3], k[2], k[3]):
                return False
            shorter = min(r[3] - r[2], k[3] - k[2])
            return shorter > 0 and max(0.0, min(r[3], k[3]) - max(r[2], k[2])) / shorter > threshold
        if not any(map(over, kept)):
            kept.append(r)
    return {r[1] for r in kept}


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5, 0.99, 1.0])
def test_kept_segments_equal_all_pairs_by_hand(spark, threshold):
    rng = random.Random(7)
    rows = []
    for tid in range(30):
        for k in range(rng.choice([1, 5, 60, 150])):
            start = round(rng.uniform(0, 200 if tid % 2 else 2000), rng.choice([0, 1]))
            end = rng.choice([start, start - 3, None]) if rng.random() < 0.08 else start + rng.choice([1, 5, 30, 90, 400, round(rng.uniform(0.1, 70), 1)])
            rows.append((tid, k, None if rng.random() < 0.02 else start, end, rng.randint(0, 9), []))
    frame = spark.createDataFrame(rows, SEGMENTS)
    for made, key in ((C.dedup_by_score(frame, threshold), lambda r: (-r[4], r[1])), (C.dedup_by_start(frame, threshold), lambda r: (r[2] is not None, r[2] or 0.0, r[1]))):
        got = {}
        for r in made.collect():
            got.setdefault(r["tid"], []).append(r["ord"])
        for tid in range(30):
            assert sorted(got[tid]) == sorted(kept_by_hand([r for r in rows if r[0] == tid], key, threshold))


def test_time_grows_with_a_recording_of_many_segments(spark):
    def seconds(n, dedup):
        k = F.col("id")
        many = spark.range(n).select(F.lit(1).alias("tid"), k.cast("int").alias("ord"), (k * 5.0).alias("t_start"), (k * 5.0 + 10 + (k * 7919) % 60).alias("t_end"), ((k * 7919) % 101).cast("int").alias("score"))
        began = time.time()
        assert n / 20 < dedup(many).count() < n
        return time.time() - began

    for dedup in (C.dedup_by_score, C.dedup_by_start):
        seconds(1_000, dedup)
        assert seconds(20_000, dedup) < 2 * seconds(10_000, dedup) + 1.5


def test_thresholds_below_0_are_an_error(spark):
    with pytest.raises(ValueError, match="threshold"):
        C.dedup_by_score(spark.createDataFrame([], SEGMENTS), -0.1)
