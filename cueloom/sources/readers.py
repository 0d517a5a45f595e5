"""JSON documents as tables.

A path holds files (*.json, or packed: *.json.gz) of one document each, indented or not, as the writers of such files leave them; with `lines`, each line
of its files is a document (for manifests and calibrations: after its key and a tab). Documents of files are keyed by the
file's stem (its name without the last suffix, and .gz before that), exactly as the file is named. What can't be read is reported with its key and a reason, not left out.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .documents import SCHEMES, read_documents, scheme

CROP = "struct<x:int,y:int,w:int,h:int>"
SETUP = f"struct<setup_id:string,crop:{CROP},scale:array<int>,frame:array<int>,rotation_deg:double,palette:string>"
REEL = "struct<id:string,start:double,end:double,score:int,hook:string,title:string,description:string,reason:string,topic:string,r0_start:double,r0_end:double,flags:array<string>,subtitles:array<struct<word:string,t0:double,t1:double>>>"
MANIFEST = f"struct<source:string,source_sha256:string,source_hash_scheme:string,duration_preset:string,setup:{SETUP},run_key:string,status:string,reels:array<{REEL}>>"
#: Keys of a manifest, its setup and its segments; those that may be missing. Fixed values.
MANIFEST_KEYS = ("source", "source_sha256", "source_hash_scheme", "duration_preset", "setup", "run_key", "status", "reels")
SETUP_KEYS = ("setup_id", "crop", "scale", "frame", "rotation_deg", "palette")
REEL_KEYS = ("id", "start", "end", "score", "hook", "title", "description", "reason", "topic", "r0_start", "r0_end", "flags", "subtitles")
STATUSES = ("pending", "awaiting_review", "approved", "done", "failed")


def file_stem() -> Column:
    """The stem of the file that Spark reads a row from; its own file names are percent-coded."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return X.stem(F.regexp_replace(path, r"\.gz$", ""))


def named_texts(spark: SparkSession, path: str) -> DataFrame:
    """(key, text) of the files *.json and *.json.gz below a folder; of patterns and of stores that only Spark opens through its own reader, which passes over names that start with '_' or '.'."""
    if scheme(path) in SCHEMES and not re.search(r"[*?{]", path):
        return read_documents(spark, path, suffix=".json", unpack=True).select(X.stem(F.col("name")).alias("key"), F.col("content").cast("string").alias("text"))
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,json.gz}").text(path, wholetext=True).select(file_stem().alias("key"), F.col("value").alias("text"))


def texts(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """(key, text) of all documents; lines have their file's stem for a key."""
    return spark.read.text(path).select(file_stem().alias("key"), F.col("value").alias("text")) if lines else named_texts(spark, path)


def keyed_texts(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """(key, text) of all documents; lines have their key before a tab."""
    if not lines:
        return named_texts(spark, path)
    return spark.read.text(path).select(F.substring_index("value", "\t", 1).alias("key"), F.regexp_replace("value", r"^[^\t]*\t", "").alias("text"))


WORD, STORED = "struct<word:string,start:double,end:double>", "struct<word:string,t0:double,t1:double>"


def parse_words(documents: DataFrame, schema: str, words: Column, name: Column, language: Column) -> tuple[DataFrame, DataFrame]:
    """documents (key, text) to (words (tid, language, idx, word, t0, t1), quarantined (key, reason)).

    schema: of the document; words: its words (structs of word, t0, t1), name and language: of the transcript, as expressions over its fields.
    Reasons: invalid_json (also for anything but an object); bad_words (the words, or one of them, are of another shape: a text or a time
    is missing or of another type). The whole document goes then. A document without words is sound and gives none.
    """
    parsed = documents.select("key", "text", F.from_json("text", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("d"))
    rows = parsed.select("key", "text", "d._broken", name.alias("tid"), language.alias("language"), words.alias("words"))
    whole = F.forall("words", lambda w: w["word"].isNotNull() & w["t0"].isNotNull() & w["t1"].isNotNull())
    # Only what the first parse found broken is parsed again, to tell a broken text from a field of another type.
    invalid = F.try_parse_json("text").isNull()
    reason = F.when(F.col("text").isNull() | ~F.col("text").rlike(r"^\s*\{"), "invalid_json").when(F.col("_broken").isNotNull(), F.when(invalid, "invalid_json").otherwise("bad_words")).when(~F.coalesce(whole, F.lit(True)), "bad_words")
    # Taken out of an array of one, as a condition on that isn't moved ahead of the parse, which it would repeat for each of its parts.
    one = lambda c: F.explode(F.array(c))
    judged = rows.select(one(F.struct("tid", "language", "words", reason.alias("reason"))).alias("r"))
    good = judged.where("r.reason is null").select("r.tid", "r.language", F.posexplode("r.words").alias("idx", "w"))
    bad = rows.select("key", one(reason).alias("reason")).where("reason is not null")
    return good.select("tid", "language", "idx", "w.word", "w.t0", "w.t1"), bad


def timed(words: Column) -> Column:
    return F.transform(words, lambda w: F.struct(w["word"].alias("word"), w["start"].alias("t0"), w["end"].alias("t1")))


def read_word_json(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Speech-to-text answers {id, language, words: [{word, start, end}]}: (words with their language, '' if missing, quarantined), as parse_words gives them. Answers without an id are named by their file. Other fields are left aside."""
    return parse_words(texts(spark, path, lines), f"id string, language string, words array<{WORD}>", timed(F.col("d.words")), F.coalesce(F.col("d.id"), F.col("key")), F.coalesce("d.language", F.lit("")))


def read_segmented_word_json(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """As read_word_json, for answers whose words are nested in segments, some of them null; all are taken in order."""
    flat = F.flatten(F.filter(F.transform("d.segments", lambda s: s["words"]), lambda w: w.isNotNull()))
    return parse_words(texts(spark, path, lines), f"id string, language string, segments array<struct<words:array<{WORD}>>>", timed(flat), F.coalesce(F.col("d.id"), F.col("key")), F.coalesce("d.language", F.lit("")))


def read_transcripts(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stored transcripts {language, words: [{word, t0, t1}]}: (words, quarantined), as parse_words gives them; a field `key` in the document (lines have no file of their own) goes before the file's key."""
    return parse_words(texts(spark, path, lines), f"key string, language string, words array<{STORED}>", F.col("d.words"), F.coalesce(F.col("d.key"), F.col("key")), F.col("d.language"))


def only(keys: Column, allowed: tuple[str, ...]) -> Column:
    """No key but those allowed."""
    return F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0


def parse_manifests(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents (key, text) to (manifests, quarantined (key, reason)).

    Reasons: invalid_json; unknown_key (at the top, in the setup or in a segment); missing_field; out_of_range (a score outside 0..100, a crop
    without area or before the frame's corner, a rotation beyond 45 degrees either way, an unknown status). Missing optional fields get their
    defaults: scheme 'full', status 'pending', no segments, empty reason and topic, rotation 0.
    """
    # Two parses of a text: into a variant, of which the keys are asked, and into the columns.
    parsed = documents.select("key", F.try_parse_json("text").alias("v"), F.from_json("text", MANIFEST).alias("m"))
    inner = lambda at, kind: F.try_variant_get("v", at, kind)
    raw = F.coalesce(inner("$.reels", "array<map<string,variant>>"), F.array().cast("array<map<string,variant>>"))
    known = only(F.map_keys(inner("$", "map<string,variant>")), MANIFEST_KEYS) & only(F.map_keys(inner("$.setup", "map<string,variant>")), SETUP_KEYS) & F.forall(raw, lambda r: only(F.map_keys(r), REEL_KEYS))
    setup, reels = F.col("m.setup"), F.coalesce(F.col("m.reels"), F.array().cast(f"array<{REEL}>"))
    whole = [F.col(f"m.{k}").isNotNull() for k in ("source", "source_sha256", "duration_preset", "run_key")] + [setup[k].isNotNull() for k in ("setup_id", "crop", "scale", "frame")]
    whole += [setup["crop"][k].isNotNull() for k in "xywh"]
    full = whole[0]
    for part in whole[1:]:
        full = full & part
    full = full & F.forall(reels, lambda r: r["id"].isNotNull() & r["start"].isNotNull() & r["end"].isNotNull() & r["score"].isNotNull() & r["hook"].isNotNull() & r["title"].isNotNull() & r["description"].isNotNull())
    crop = setup["crop"]
    ranged = (
        (crop["x"] >= 0) & (crop["y"] >= 0) & (crop["w"] > 0) & (crop["h"] > 0) & F.coalesce(setup["rotation_deg"], F.lit(0.0)).between(-45, 45)
        & F.coalesce(F.col("m.status"), F.lit("pending")).isin(*STATUSES) & F.forall(reels, lambda r: r["score"].between(0, 100))
    )
    no = lambda c: ~F.coalesce(c, F.lit(False))
    object_ = F.schema_of_variant("v").startswith("OBJECT")
    reason = F.when(F.col("v").isNull() | no(object_), "invalid_json").when(no(known), "unknown_key").when(no(full), "missing_field").when(no(ranged), "out_of_range")
    judged = parsed.withColumn("reason", reason)
    filled = F.transform(reels, lambda r: r.withField("reason", F.coalesce(r["reason"], F.lit(""))).withField("topic", F.coalesce(r["topic"], F.lit(""))).withField("flags", F.coalesce(r["flags"], F.array().cast("array<string>"))))
    good = judged.where("reason is null").select(
        "key", "m.source", "m.source_sha256", F.coalesce("m.source_hash_scheme", F.lit("full")).alias("source_hash_scheme"), "m.duration_preset",
        setup.withField("rotation_deg", F.coalesce(setup["rotation_deg"], F.lit(0.0))).alias("setup"), "m.run_key", F.coalesce("m.status", F.lit("pending")).alias("status"), filled.alias("reels"))
    return good, judged.where("reason is not null").select("key", "reason")


def read_manifests(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Manifest documents: (manifests, quarantined (key, reason)), as parse_manifests gives them."""
    return parse_manifests(keyed_texts(spark, path, lines))


def parse_calibrations(documents: DataFrame) -> DataFrame:
    """documents (source_sha256, text) to calibrations; kind is auto (flag or label), manual, or corrupt (no object, no crop or no frame; other columns are null then)."""
    shape = f"struct<source_name:string,setup_label:string,crop:{CROP},scale:array<int>,frame:array<int>,rotation_deg:double,palette:string,auto:boolean,rotation_applied:boolean>"
    parsed = documents.select("source_sha256", F.try_parse_json("text").alias("v"), F.from_json("text", shape).alias("c"))
    broken = F.col("v").isNull() | F.col("c.crop").isNull() | F.col("c.frame").isNull()
    kind = F.when(broken, "corrupt").when(F.coalesce(F.col("c.auto"), F.lit(False)) | F.coalesce(F.col("c.setup_label") == "auto", F.lit(False)), "auto").otherwise("manual")
    return parsed.select("source_sha256", *[F.when(kind != "corrupt", F.col(f"c.{k}")).alias(k) for k in ("source_name", "setup_label", "crop", "scale", "frame", "rotation_deg", "palette", "auto", "rotation_applied")], kind.alias("kind"))


def read_calibrations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Calibration documents, keyed by content hash."""
    return parse_calibrations(keyed_texts(spark, path, lines).withColumnRenamed("key", "source_sha256"))


def calibration_kinds(hashes: DataFrame, calibrations: DataFrame) -> DataFrame:
    """(sha256, kind) for each hash asked for: that of its calibration, or none."""
    kinds = calibrations.groupBy(F.col("source_sha256").alias("__h")).agg(F.min("kind").alias("kind"))
    return hashes.join(kinds, hashes["sha256"] == F.col("__h"), "left").select("sha256", F.coalesce("kind", F.lit("none")).alias("kind"))
