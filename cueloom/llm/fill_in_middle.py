"""Fill-in-the-middle: a text is cut at two places between its units, and its middle part is moved to the end behind marks.

A unit is a run of ASCII letters or one other code point. One full match of (unit)* with the `regex` library keeps the end of
every repetition of the group, so that the number of units and both places of cuts are looked up in that one list, whatever the
length of the text. The choices come from a hash of the key, so reruns, retried tasks and other layouts of the table agree.
Each row is worked on alone: nothing is shuffled.
"""

import hashlib

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Repeated without giving anything back: a unit is never taken apart again, so the match holds no state besides the ends of its units.
UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
#: The marks before the prefix, the suffix and the middle. Fixed by the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, those moved at all, and of 100 of these, those with the suffix first. Fixed by the contract.
MOVED, SUFFIX_FIRST = 90, 20
SHAPE = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(key: str | None, seed: int) -> list[int]:
    """Four numbers below 2 ** 32 that the key and the seed decide. A null key counts as empty."""
    digest = hashlib.sha256(f"{seed}:{key or ''}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transformed(key: str | None, text: str | None, seed: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    text = text or ""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    first, second, moved, order = draws(key, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or moved % 100 >= MOVED:
        return n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(documents: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """The documents with n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain) and output; columns of these names are replaced.

    Plain texts come out as they are: empty ones, those that hold a mark, and one in ten by the hash of the key. Null texts
    are empty. Rows of the same key and text come out alike; a null key counts as an empty one. A worker
    needs some 100 bytes a unit for the one text it is at.
    """
    names = ("n", "form", "prefix_chars", "middle_chars", "output")

    def each(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        made = pd.DataFrame([transformed(k, t, seed) for k, t in zip(keys, texts, strict=True)], columns=names)
        return made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    made = F.pandas_udf(each, SHAPE)
    found = documents.withColumn("__made", made(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")))
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in names]
    return found.select(*kept, *[F.col(f"__made.{c}").alias(c) for c in names])


def restored(form: Column, output: Column) -> Column:
    """The text before its parts were moved, out of the output and its form alone. As no part holds a mark and no mark can start inside a part or another mark, the first place of each mark is the true one."""
    body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)

    def parts(between: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(body, between, 1)
        rest = F.substr(body, F.char_length(one) + F.lit(len(between) + 1))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.char_length(two) + F.lit(len(MIDDLE) + 1))

    (p, s, m), (s2, p2, m2) = parts(SUFFIX), parts(PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def middle_report(documents: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n, form, prefix_chars, middle_chars, and SHA-256 of the output and of the text rebuilt from it."""
    made = fill_in_middle(documents.select("doc_id", "text"))
    rebuilt = restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))
