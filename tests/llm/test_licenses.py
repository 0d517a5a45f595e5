"""License scans: the rules' own texts, the prefilter, and detections against brute force."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cueloom.llm import license_rules as R
from cueloom.llm import license_scan as S

RULES = R.every_rule()


def example(pattern, rng):
    """A text that the pattern matches, with optional groups and alternatives by chance."""
    group = re.compile(r"\(\?:([^()]*)\)(\?|\{(\d+),(\d+)\})?")
    while found := group.search(pattern):
        inner, mark, low, high = found.groups()
        times = rng.randint(0, 1) if mark == "?" else rng.randint(int(low), int(high)) if mark else 1
        # Several repetitions of a group may differ; groups inside have been written out by now.
        pattern = pattern[: found.start()] + "".join(rng.choice(inner.split("|")) for _ in range(times)) + pattern[found.end() :]
    return " ".join(rng.choice(["x9", "zwei"]) if w == "ANY" else "7" if w == "NUM" else w for w in pattern.split())


def test_rules_match_their_texts_and_ask_for_words_that_these_have():
    rng = random.Random(1)
    assert len(RULES) > 400 and len(set(RULES)) == len(RULES)
    for rule in RULES:
        assert needed_words(rule)
        for _ in range(6):
            words = example(rule.pattern, rng).split()
            assert re.fullmatch(R.spelled(rule.pattern), "".join(f" {w} " for w in words)), rule
            assert all(set(choice) & set(words) for choice in R.needed(rule.pattern)), rule


def needed_words(rule):
    return [w for choice in R.needed(rule.pattern) for w in choice]


def by_hand(text):
    """n_words, base places, kept places (start, stop, tier, rule) of a text, every rule tried and all pairs of places compared."""
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    line = "".join(f" {w} " for w in words)
    places = [(line[: m.start()].count(" ") // 2, line[: m.end()].count(" ") // 2, r.tier, k) for k, r in enumerate(RULES) for m in re.finditer(R.spelled(r.pattern), line)]
    holds = lambda q, p: q != p and q[0] <= p[0] and q[1] >= p[1] and q[2] <= p[2] and not (q[:3] == p[:3] and q[3] > p[3])
    kept = [p for p in places if not any(holds(q, p) for q in places)]
    return len(words), sorted(p for p in places if RULES[p[3]].base), sorted(kept)


FRAGMENTS = [
    "MIT License", "the Apache License, Version 2.0", "GNU General Public License v3 or any later version", "SPDX-License-Identifier: MPL-2.0", "CC BY-NC-SA 4.0", "mit", "license", "apache", "Lesser General Public License 2.1",
    "émit license", "mit licenses", "Licensed under the terms of the Example license", "all rights reserved", "general public", "License. MIT License", "\x00mit\x7flicense", "gpl", "v2", "2.0", "or later",
]


def test_scan_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " .,", *FRAGMENTS, *[" ".join(rng.choices(FRAGMENTS, k=rng.randint(2, 12))) for _ in range(60)], *[example(r.pattern, rng) for r in RULES[::9]]]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for row in S.scan_licenses(frame.withColumn("copy", F.col("text")).drop("text"), "copy").collect():
        n, base, kept = by_hand(texts[row["k"]])
        place = lambda d: (d["start"], d["stop"], d["tier"], d["rule"])
        assert row["n_words"] == n
        assert sorted(map(place, row["base"])) == base
        assert sorted(map(place, row["detections"])) == kept, texts[row["k"]]


def test_long_texts_in_time_of_their_length(spark):
    def seconds(n):
        frame = spark.createDataFrame([(1, "the mit license of x. " * n)], "doc_id long, text string")
        began = time.time()
        row = S.license_report(frame).first()
        assert (row["n_base"], row["first_word"], row["last_word"], row["labels"], row["n_detections"]) == (n, 1, 5 * n - 4, "mit", n)
        return time.time() - began

    seconds(100)
    assert seconds(80_000) < 8 * seconds(20_000) + 2


def test_report_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert S.license_report(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, None, None, None, None), (1, "MIT License", "en", "s", 1), (1, "MIT License", "en", "s", 1)], schema)
    found = S.license_report(rows).collect()
    assert [tuple(r)[1:] for r in found] == [(0, 0, None, None, "", "", 0.0, 0)] + [(2, 1, 0, 0, "mit", "mit", 0.7, 1)] * 2
    clashing = S.scan_licenses(rows.withColumns({"detections": F.lit(1), "base": F.lit(2), "n_words": F.lit(3), "extra": F.lit(4)}))
    assert clashing.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "n_words", "base", "detections"] and clashing.count() == 3


@pytest.mark.parametrize("rules", [(), (R.Rule(R.NAMED, "x", "x license "),)])
def test_own_rules(spark, rules):
    row = S.scan_licenses(spark.createDataFrame([("the x license, the mit license",)], "text string"), rules=rules).first()
    assert [d["label"] for d in row["detections"]] == [r.label for r in rules]


def test_plan_is_native_and_narrow(spark):
    plan = S.license_report(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Join" not in plan
