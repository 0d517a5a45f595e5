"""Licenses named in texts, by ordered signature rules.

The rules (license_rules) are regexes over a text's words. A keyword prefilter picks, for each text, the rules whose words it has; only
these are tried. Every place of a match is a detection, from a word to a word. Detections inside others give way:
one goes if a detection of the same or a better tier holds it (of those alike in both, the one of the earlier rule stays). As being held is
transitive, one pass in order of the starts, with the furthest end of each tier so far, decides all.

Each row is worked on alone, in built-in expressions: no text is shuffled, joined or copied to a rule, and the rules are one constant of the plan.
"""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontamination import words_of
from .license_rules import CONFIDENCE, Rule, every_rule, needed, spelled

#: What stands before and after a match while its words are counted; no word holds these.
OPEN, CLOSE = "\x01", "\x02"
#: Detections that are folded at once. A fold copies what it holds at each step, so its steps are taken in blocks.
BLOCK = 200
PLACE = "struct<start:int,stop:int,tier:int,rule:int,label:string,confidence:double,base:boolean>"


def spaced(words: Column) -> Column:
    """The words, each with a space on either side."""
    return F.when(F.size(words) > 0, F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))).otherwise("")


def rule_table(rules: tuple[Rule, ...]) -> Column:
    """The rules as an array: one constant of the plan, not an expression for each of their fields."""
    rows = [{"rule": k, "tier": r.tier, "label": r.label, "confidence": CONFIDENCE[r.tier], "base": r.base, "regex": spelled(r.pattern), "needs": needed(r.pattern)} for k, r in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<rule:int,tier:int,label:string,confidence:double,base:boolean,regex:string,needs:array<array<string>>>>")


def places(text: Column, rule: Column) -> Column:
    """Where the rule's regex matches in a spaced text, from the start word to the stop word (exclusive): matches are put between marks, and a mark's place among the tokens less the marks before it is a place among the words."""
    tokens = F.split(F.trim(F.regexp_replace(text, F.concat(F.lit("("), rule["regex"], F.lit(")")), F.lit(f" {OPEN} $1 {CLOSE} "))), " +")
    marks = F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(OPEN, CLOSE), i)), lambda i: i.isNotNull())
    bounds = F.transform(marks, lambda i, k: i - k)
    starts = F.filter(bounds, lambda b, k: k % 2 == 0)
    stops = F.filter(bounds, lambda b, k: k % 2 == 1)
    return F.transform(F.arrays_zip(starts.alias("start"), stops.alias("stop")), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), *[rule[c].alias(c) for c in ("tier", "rule", "label", "confidence", "base")]))


def in_order(detections: Column) -> Column:
    """Those that may hold others come first: by start, then the longer, the better tier, the earlier rule."""
    ranked = F.transform(detections, lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("back"), d["tier"].alias("tier"), d["rule"].alias("rule"), d.alias("d")))
    return F.transform(F.array_sort(ranked), lambda r: r["d"])


def unheld(detections: Column, tiers: int) -> Column:
    """The detections, in order, that none of the same or a better tier holds."""
    empty = F.array().cast(f"array<{PLACE}>")
    start = F.struct(F.array_repeat(F.lit(0), tiers).alias("furthest"), empty.alias("kept"))

    def step(seen: Column, d: Column) -> Column:
        held = F.exists(F.slice(seen["furthest"], 1, d["tier"]), lambda stop: stop >= d["stop"])
        further = F.transform(seen["furthest"], lambda stop, k: F.when(k + 1 == d["tier"], F.greatest(stop, d["stop"])).otherwise(stop))
        return F.struct(further.alias("furthest"), F.when(held, seen["kept"]).otherwise(F.array_append(seen["kept"], d)).alias("kept"))

    # Each block's are appended as the next one begins: what is held must not be handed through a transform, which copies all that it gives.
    def block(seen: Column, some: Column) -> Column:
        begun = F.struct(seen["last"]["furthest"].alias("furthest"), empty.alias("kept"))
        return F.struct(F.aggregate(some, begun, step).alias("last"), F.array_append(seen["blocks"], seen["last"]["kept"]).alias("blocks"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(detections) - 1) / BLOCK).cast("int")), lambda b: F.slice(detections, b * BLOCK + 1, BLOCK))
    first = F.struct(start.alias("last"), F.array().cast(f"array<array<{PLACE}>>").alias("blocks"))
    folded = F.aggregate(blocks, first, block, lambda seen: F.concat(F.flatten(seen["blocks"]), seen["last"]["kept"]))
    return F.when(F.size(detections) > 0, folded).otherwise(empty)


def scan_licenses(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The documents with n_words long, base and detections, arrays of struct<start,stop,tier,rule,label,confidence,base> in order of their starts; columns of these names are replaced.

    start and stop (exclusive) count words from 0. base: every place of a base phrase, whatever holds it. detections: all that
    no better one holds. Null and wordless texts have none. Letters other than A-Z are compared as they are.
    """
    rules = every_rule() if rules is None else rules
    names = ("n_words", "base", "detections")
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in names]
    keywords = sorted({w for r in rules for choice in needed(r.pattern) for w in choice})
    rows = documents.select(*kept, words_of(F.col(f"`{text}`")).alias("__words"))
    rows = rows.withColumn("__has", F.array_intersect("__words", F.split(F.lit(" ".join(keywords)), " ")))
    fitting = F.filter(rule_table(rules), lambda r: F.forall(r["needs"], lambda choice: F.arrays_overlap(choice, F.col("__has"))))
    rows = rows.withColumn("__rules", F.when(F.size("__has") > 0, fitting))
    rows = rows.withColumn("__text", F.when(F.size("__rules") > 0, spaced(F.col("__words"))))
    tried = F.transform("__rules", lambda r: F.when(F.rlike(F.col("__text"), r["regex"]), places(F.col("__text"), r)))
    none = F.array().cast(f"array<{PLACE}>")
    rows = rows.withColumn("__all", F.coalesce(in_order(F.flatten(F.filter(tried, lambda p: p.isNotNull()))), none))
    return rows.select(*kept, F.size("__words").cast("long").alias("n_words"), F.filter("__all", lambda d: d["base"]).alias("base"), unheld(F.col("__all"), len(CONFIDENCE)).alias("detections"))


def license_report(documents: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the greatest confidence of a detection, 0 without any), n_detections."""
    found = scan_licenses(documents.select("doc_id", "text"))
    starts, base = F.transform("base", lambda d: d["start"].cast("long")), F.transform("base", lambda d: d["label"])
    labels = F.array_distinct(F.concat(base, F.transform("detections", lambda d: d["label"])))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"), F.size("detections").cast("long").alias("n_detections"),
    )
