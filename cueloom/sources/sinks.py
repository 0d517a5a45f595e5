"""Tables as text documents. Where one line of a text file is one document, it starts with the document's key and a tab; line ends inside a document are written as JSON strings are, so that it can be read back. Such files are packed by gzip, which Spark's readers undo by the files' names."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import words as O
from .documents import write_documents

FORMATS = ("text", "srt", "vtt", "json")
#: Options of writers of lines. Transcripts as captions and as JSON are many times larger than their texts; levels beyond the fourth take twice the time for 4 % less.
PACKED = {"compression": "gzip", "zlib.compress.level": "FOUR"}


def as_line(text: Column) -> Column:
    """The text as a JSON string, on one line. Its brackets are cut off by bytes, as neither a search for them nor a count of its characters is as cheap."""
    return F.get(F.transform(F.array(F.to_json(F.array(text)).cast("binary")), lambda j: F.substring(j, F.lit(2), F.octet_length(j) - 2)), F.lit(0)).cast("string")


def from_line(line: Column) -> Column:
    return F.get(F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<string>"), F.lit(0))


def write_manifests(manifests: DataFrame, path: str, mode: str = "overwrite", lines: bool = False) -> None:
    """One JSON document per source, named by the source's stem; null fields are left out, as readers take them for missing. read_manifests reads both forms.

    A folder of indented files <stem>.json: sources of one stem, or without one, are an error, and the folder stays as it was. Or, with `lines`
    (for very many sources), documents of one line each after their stem and a tab: sources of one stem are all kept, under one key.
    """
    stem = X.stem(F.col("source"))
    if lines:
        manifests.select(F.concat(stem, F.lit("\t"), F.to_json(F.struct(*manifests.columns))).alias("value")).write.mode(mode).options(**PACKED).text(path)
    else:
        write_documents(manifests.select(F.concat(stem, F.lit(".json")).alias("name"), F.to_json(F.struct(*manifests.columns), {"pretty": "true"}).alias("content")), path, mode)


def transcript_export(words: DataFrame, pause: float = 0.35) -> DataFrame:
    """(fmt, tid, text): each transcript as text, srt, vtt and json, all from one pass over its words."""
    word = F.struct("idx", "word", "t0", "t1")
    rows = O.split_sentences(words, pause).groupBy("tid", "sent_no").agg(
        F.min_by("t0", "idx").alias("t0"), F.max_by("t1", "idx").alias("t1"), F.array_sort(F.collect_list(word)).alias("ws")).withColumn("text", F.array_join(F.transform("ws", lambda x: x["word"]), " "))
    made = rows.select("tid", F.struct("sent_no", O.paragraph_piece().alias("piece"), O.cue("srt").alias("srt"), O.cue("vtt").alias("vtt"), "ws").alias("s"))
    whole = made.groupBy("tid").agg(F.array_sort(F.collect_list("s")).alias("s"))
    part = lambda name, between: F.array_join(F.transform("s", lambda x: x[name]), between)
    track = lambda fmt: F.concat(F.lit(O.cue_mark(fmt)[1]), part(fmt, "\n\n"), F.lit("\n"))
    plain = F.transform(F.flatten(F.transform("s", lambda x: x["ws"])), lambda w: F.struct(w["word"].alias("word"), w["t0"].alias("t0"), w["t1"].alias("t1")))
    texts = (part("piece", ""), track("srt"), track("vtt"), F.to_json(plain))
    named = F.array(*[F.struct(F.lit(fmt).alias("fmt"), text.alias("text")) for fmt, text in zip(FORMATS, texts, strict=True)])
    return whole.select("tid", F.inline(named)).select("fmt", "tid", "text")


def write_transcript_export(words: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Documents by format: fmt=.../, each line the transcript's id, a tab and its document as a JSON string."""
    lines = transcript_export(words).select("fmt", F.concat(F.col("tid").cast("string"), F.lit("\t"), as_line(F.col("text"))).alias("value"))
    lines.write.mode(mode).partitionBy("fmt").options(**PACKED).text(path)


def publication_text(segments: DataFrame) -> DataFrame:
    """(tid, seg_id, body): title, a blank line, description; no row where both are empty or null."""
    title, description = F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))
    return segments.where((title != "") | (description != "")).select("tid", "seg_id", F.concat(title, F.lit("\n\n"), description, F.lit("\n")).alias("body"))


def write_publication_text(segments: DataFrame, path: str, mode: str = "overwrite") -> None:
    publication_text(segments).select(F.concat(F.col("tid").cast("string"), F.lit("/"), "seg_id", F.lit("\t"), as_line(F.col("body"))).alias("value")).write.mode(mode).options(**PACKED).text(path)
