"""Token counts through a digest cache.

The cache is a Parquet folder of (digest, tokenizer, n_tokens): the SHA-256 of the
normalised text, the SHA-256 of the tokenizer file, and the count. Texts are joined to
it by both digests; only distinct texts that it lacks are encoded, and their counts are
appended.

Encoding takes place in Python workers. Where no token of the tokenizer spans white space (spans_space() tries it out),
a text's count is the sum over its pieces between white space; each worker remembers the
counts of pieces it has met (MEMO of them at most, then it starts anew), and normalising turns runs of
space, tab, newline and return into one space, none at the ends. With other tokenizers whole texts are encoded, and
normalising only turns null into the empty text.
"""

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, join_weighed, lean_batches, scratch

LIMIT = 2048
MEMO = 400_000
TOKENIZER = "word_bpe_49k.json"
SPACE = " \t\n\r"
#: Texts on which a tokenizer shows whether white space makes or joins tokens.
PROBES = tuple(f"{a}{s}{b}" for a in ("", "word", "it's", "12.", "é") for b in ("", "word", "42", "ß!") for s in (*SPACE, "  ", " \n", "\n\n", "\t\t\t", "    "))
CACHE = "digest binary, tokenizer string, n_tokens long"

_tokenizers: dict = {}
_memos: dict[str, dict[str, int]] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and of the library that reads it."""
    import tokenizers

    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + tokenizers.__version__.encode()).hexdigest()


def loaded(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path)
        _memos[path] = {"": 0}
    return _tokenizers[path]


def lengths(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, without begin, end or other added tokens; special strings are read as the library does by default."""
    return [len(coded.ids) for coded in loaded(path).encode_batch_fast(texts, add_special_tokens=False)]


def pieces_of(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def spans_space(path: str) -> bool:
    """Whether the count of some probe isn't the sum of the counts of its pieces between white space."""
    return any(whole != sum(lengths(pieces_of(probe), path)) for probe, whole in zip(PROBES, lengths(list(PROBES), path), strict=True))


def normalised(text: Column, whole: bool = False) -> Column:
    text = F.coalesce(text, F.lit(""))
    return text if whole else F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def count_pieces(texts: list[str], path: str) -> list[int]:
    """As lengths(), for tokenizers of which no token spans white space."""
    loaded(path)
    memo, counts = _memos[path], []
    for text in texts:
        pieces = pieces_of(text)
        missing = list({piece for piece in pieces if piece not in memo})
        if missing:
            memo.update(zip(missing, lengths(missing, path), strict=True))
        counts.append(sum(map(memo.__getitem__, pieces)))
        if len(memo) > MEMO:
            memo.clear()
            memo[""] = 0
    return counts


def encode(texts: DataFrame, path: str, whole: bool = False) -> DataFrame:
    """(digest, content) to (digest, n_tokens)."""
    count = lengths if whole else count_pieces

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"digest": batch["digest"], "n_tokens": count(batch["content"].tolist(), path)})

    return texts.select("digest", "content").mapInPandas(counted, "digest binary, n_tokens long")


def open_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The counts stored for the version; none where the folder doesn't exist yet."""
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    # A job that appended and was run again may have stored a digest twice.
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def digest(content: Column) -> Column:
    return F.unhex(F.sha2(content.cast("binary"), 256))


def misses(documents: DataFrame, text: str, known: DataFrame, whole: bool = False) -> DataFrame:
    """(digest, content) of each distinct normalised text that the cache lacks. Digests alone are compared with the cache; then texts are chosen by a broadcast of the few that are lacking, or else made distinct, so that copies meet before the shuffle, and joined."""
    content = documents.select(normalised(F.col(text), whole).alias("content")).withColumn("digest", digest(F.col("content")))
    lacking = cut(content.select("digest").distinct().join(known, ["digest"], "left_anti"))
    few = bounded(lacking, lacking.count())
    once = lambda rows: rows.groupBy("digest").agg(F.first("content").alias("content"))
    return once(content.join(few, ["digest"], "left_semi")) if few is not lacking else once(content).join(lacking, ["digest"], "left_semi")


def fill_cache(documents: DataFrame, cache: str, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Encode what the cache lacks, append it, and give the counts (digest, n_tokens) of this tokenizer version."""
    spark, path = documents.sparkSession, tokenizer or tokenizer_path()
    version, whole = tokenizer_version(path), spans_space(path)
    encoded = encode(misses(documents, text, open_cache(spark, cache, version), whole), path, whole)
    with lean_batches(spark):
        encoded.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    return open_cache(spark, cache, version)


def count_tokens(documents: DataFrame, cache: str | None = None, text: str = "text", tokenizer: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The rows of documents with n_tokens long appended (a column of that name is replaced).

    keep: the columns to carry through the join with the counts (all, the text too, if not given).
    Null and empty texts have no tokens. cache: the folder to use and extend; without one, a new folder
    in the shared checkpoint folder serves this call. Rows that repeat a text, whatever else they
    hold, are encoded once, and a text with very many rows gets its count by a broadcast. An empty table leaves the cache as it is.
    """
    path = tokenizer or tokenizer_path()
    cache = cache or scratch(documents.sparkSession, "token-cache")
    counts = fill_cache(documents, cache, text, path).withColumnRenamed("digest", "__key")
    kept = [name for name in keep or documents.columns if name != "n_tokens"]
    keyed = documents.select(*[F.col(f"`{name}`") for name in kept], digest(normalised(F.col(text), spans_space(path))).alias("__key"))
    asked = cut(keyed.groupBy("__key").agg(F.count("*").alias("__rows")).join(counts, ["__key"]))
    return join_weighed(keyed, asked, ["__key"], "__rows").drop("__key", "__rows")


def token_report(documents: DataFrame, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document; only digests of the texts go through the join."""
    sized = documents.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    counted = count_tokens(sized, cache, keep=["doc_id", "n_bytes"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
