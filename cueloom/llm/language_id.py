"""Language identification by rank-order profiles.

A profile is the list of the PROFILE most frequent character n-grams (1 to 3 characters, inside
words, word ends marked) in order of frequency. A document's profile is compared
with each language's by the out-of-place distance: for each of its n-grams, how far its rank is
from the rank in the language's profile, or PROFILE where the language's lacks it.
The nearest language wins; ties go to the first in code point order.

Language profiles count the n-grams of all training documents: each task counts its own
(numpy sorts packed n-grams), and Spark sums these by language and n-gram. The profiles have
PROFILE rows a language, so they are collected and shipped with the function that predicts.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_crc, lean_batches

PROFILE, ORDERS = 300, 3
#: Documents are counted together up to about so many characters; a task passes on what it has counted when it has so many n-grams.
CHUNK, FLUSH = 60_000, 2_000_000
UNKNOWN = "und"

_letters: list[np.ndarray] = []
_matchers: dict[tuple, "Matcher"] = {}


def letter_table() -> np.ndarray:
    """For each code point: itself (20 bits) if it is a letter, else 0."""
    if not _letters:
        _letters.append(np.fromiter((min(c, 0xFFFFF) if chr(c).isalpha() else 0 for c in range(0x110000)), np.int64, 0x110000))
    return _letters[0]


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters of the text; whatever else stands between words is one 0, and so are both ends."""
    codes = letter_table()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    codes = np.concatenate(([0], codes, [0]))
    return codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]


def packed(codes: np.ndarray) -> np.ndarray:
    """All n-grams of 1 to ORDERS characters inside words, as whole numbers: 20 bits a character and 2 for the length."""
    grams = [(codes[codes != 0] << 2) | 1]
    for n in range(2, ORDERS + 1):
        parts = [codes[k : len(codes) - n + 1 + k] for k in range(n)]
        keep = np.ones(len(parts[0]), bool)
        for inner in parts[1:-1]:
            keep &= inner != 0
        keep &= (parts[0] != 0) | (parts[-1] != 0)
        code = np.zeros(len(parts[0]), np.int64)
        for part in parts:
            code = (code << 20) | part
        grams.append((code[keep] << 2) | (n % 4))
    return np.concatenate(grams)


def count_by_language(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, text) to partial counts (lang, gram, n)."""
    counted: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    held = 0

    def merged() -> Iterator[pd.DataFrame]:
        for lang, parts in counted.items():
            grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            n = np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.int64)
            yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})
        counted.clear()

    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            waiting: list[np.ndarray] = []
            size = 0
            for text in [*texts, None]:
                if text is not None:
                    waiting.append(letters_of(text))
                    size += len(waiting[-1])
                if waiting and (text is None or size >= CHUNK):
                    counted.setdefault(lang, []).append(np.unique(packed(np.concatenate(waiting)), return_counts=True))
                    held += len(counted[lang][-1][0])
                    waiting, size = [], 0
        if held > FLUSH:
            yield from merged()
            held = 0
    yield from merged()


def language_profiles(training: DataFrame, size: int = PROFILE) -> list[tuple[str, list[int]]]:
    """(language, its n-grams in order of frequency) from rows (lang, text) without nulls; size rows a language come to the driver."""
    partial = training.mapInPandas(count_by_language, "lang string, gram long, n long")
    counts = partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    by_language: dict[str, list[tuple[int, int]]] = {}
    for row in ranked.select("lang", "rank", "gram").collect():
        by_language.setdefault(row["lang"], []).append((row["rank"], row["gram"]))
    return [(lang, [gram for _, gram in sorted(by_language[lang])]) for lang in sorted(by_language)]


class Matcher:
    """All profiles in one table: the n-grams in order, and the rank of each in each language (PROFILE where it lacks it)."""

    def __init__(self, profiles: list[tuple[str, list[int]]], size: int = PROFILE) -> None:
        self.size, self.languages = size, [lang for lang, _ in profiles]
        self.grams = np.unique(np.concatenate([np.array(grams, np.int64) for _, grams in profiles])) if profiles else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(profiles)), -1, np.int32)
        for k, (_, grams) in enumerate(profiles):
            self.ranks[np.searchsorted(self.grams, np.array(grams, np.int64)), k] = np.arange(len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 - distance / the largest possible distance; unknown if there is no letter to go by."""
        codes = letters_of(text) if text else np.zeros(0, np.int64)
        if not codes.any() or not self.languages:
            return UNKNOWN, 0.0
        grams, counts = np.unique(packed(codes), return_counts=True)
        order = np.argsort(-counts, kind="stable")[: self.size]
        own = grams[order]
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[at]
        out_of_place = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(out_of_place.argmin())
        return self.languages[best], float(1 - out_of_place[best] / (self.size * len(own)))


def matcher_of(profiles: list[tuple[str, list[int]]]) -> Matcher:
    """The table of the profiles, made once in a worker (which keeps the last one)."""
    key = tuple((lang, tuple(grams)) for lang, grams in profiles)
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(profiles)
    return _matchers[key]


def matched(documents: DataFrame, training: Column | None, text: str, lang: str, key: str) -> Column:
    """struct<lang_pred, score> of a row of documents, learned from the rows for which `training` holds."""
    taught = training if training is not None else F.pmod(key_crc(F.col(key)), F.lit(5)) != 0
    known = documents.where(taught & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    with lean_batches(documents.sparkSession):
        profiles = language_profiles(known)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        matcher = matcher_of(profiles)
        return pd.DataFrame([matcher.predict(x) for x in texts], columns=["lang_pred", "score"])

    return predicted(F.col(text))


def identify(documents: DataFrame, training: Column | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """The rows of documents with lang_pred and score appended (columns of these names are replaced).

    training: which rows to learn from; those whose key's CRC-32 isn't a multiple of 5 if not given. Of
    these, rows without text or language teach nothing. Texts that are null or have no letter, and all texts
    if nothing could be learned, get "und" and 0. Equal texts get equal results.
    """
    kept = [F.col(f"`{name}`") for name in documents.columns if name not in ("lang_pred", "score")]
    return documents.select(*kept, matched(documents, training, text, lang, key).alias("__found")).select(*kept, "__found.lang_pred", "__found.score")


def language_report(documents: DataFrame) -> DataFrame:
    found = identify(documents)
    return found.select("doc_id", (F.pmod(key_crc(F.col("doc_id")), F.lit(5)) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(documents: DataFrame, least: float = 0.0) -> DataFrame:
    """Drop the documents that the identifier rejects: without a letter, or with a score not above `least` (0: the nearest profile shares none of the text's n-grams). Columns stay as they are, whatever their names."""
    marked = documents.select(F.struct(*[F.col(f"`{name}`") for name in documents.columns]).alias("__row"), matched(documents, None, "text", "lang", "doc_id").alias("__found"))
    kept = marked.where((F.col("__found.lang_pred") != UNKNOWN) & (F.col("__found.score") > least))
    return kept.select(*[F.col(f"__row.`{name}`") for name in documents.columns])
