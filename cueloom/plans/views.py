"""Inputs of the operators derived from the given tables by whole-number arithmetic, for Spark; oracles.py has the same in SQL."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.shared import table
from ..operators.reconcile import assemble_manifest
from ..operators.words import in_order

#: Hanging words of the derived transcripts.
HANGING = ("the", "and", "de", "la", "und", "que", "en", "le")


#: Words whose times are summed up as one block: 2 to the power of BITS.
BITS = 6
BLOCK = 1 << BITS


def sums_before(steps: Column) -> Column:
    """array<array<bigint>>: at place k // BLOCK + 1 and k % BLOCK the sum of what comes before place k. Summed up by blocks, as each step copies what it appends to."""
    blocks = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(steps) - 1, BITS)), lambda k: F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)))
    none = F.array(F.lit(0).cast("bigint"))
    add = lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + F.coalesce(x, F.lit(0)))
    return F.aggregate(blocks, F.array(none), lambda all_, b: F.array_append(all_, F.aggregate(b, F.array(F.element_at(F.element_at(all_, -1), -1)), add)))


def transcripts(spark: SparkSession, sf_dir: str, every: int = 1) -> DataFrame:
    """(tid, words): the timed words (or every so manyth, from the first on), array<struct<word,t0,t1>>, of each document that has any: word lengths from the letters, pauses from the marks and a fixed scatter.

    A transcript is made out of its one row, so no words are shuffled, sorted or gathered. Texts are dealt by tid before they are split; into all shuffle partitions, as these are not small for what comes out of them.
    """
    some = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tid"), "text").where(F.btrim("text", F.lit(" \n\t\r")) != "")
    dealt = some.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tid")
    split = dealt.select("tid", F.array_remove(F.split(F.col("text"), r"[ \n\t\r]+"), "").alias("__w"))
    d = F.col("tid")
    length = lambda w: 80 + 60 * F.least(F.char_length(w), F.lit(12))

    def step(w: Column, place: Column) -> Column:
        i = place.cast("long")
        marked = F.contains(F.lit(".!?," + X.LINE_ENDS), F.substring(w, -1, 1))  # of few words more is asked
        plain = F.when(i % 53 == 52, F.lit(-40)).otherwise((104729 * i + 17 * d) % 450)
        return length(w) + F.when(marked, F.when(X.ends_in(w, ".!?"), 300 + (7919 * i + 31 * d) % 2400).when(F.endswith(w, F.lit(",")), 50 + (7919 * i + 31 * d) % 600).otherwise(plain)).otherwise(plain)

    summed = split.withColumn("__steps", F.transform("__w", step)).withColumn("__sums", sums_before(F.col("__steps")))

    def timed(w: Column, i: Column) -> Column:
        t0 = F.get(F.get(F.col("__sums"), F.shiftright(i, BITS) + 1), i.bitwiseAND(F.lit(BLOCK - 1)))
        return F.struct(w.alias("word"), (t0 / F.lit(1000.0)).alias("t0"), ((t0 + length(w)) / F.lit(1000.0)).alias("t1"))

    # Out of an array of one: a condition on the words is not moved ahead of the sums, which it would work out anew for each word.
    chosen = F.transform("__w", timed) if every == 1 else F.transform(F.sequence(F.lit(0), F.size("__w") - 1, F.lit(every)), lambda i: timed(F.get("__w", i), i))
    return summed.select("tid", F.explode_outer(F.array(chosen)).alias("words"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed words of all documents, a row each."""
    each = transcripts(spark, sf_dir).select("tid", F.posexplode_outer("words").alias("idx", "w"))
    return each.select("tid", "idx", "w.word", "w.t0", "w.t1")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment from every 37th word on, of 10 to 70 seconds."""
    i, d = F.col("idx").cast("long") * 37, F.col("tid")
    ms = F.bround(F.col("t0") * 1000).cast("long") + (13 * i) % 900
    ord_ = F.floor(i / 37).cast("int")
    some = transcripts(spark, sf_dir, 37).select("tid", F.posexplode_outer("words").alias("idx", "w")).select("tid", "idx", "w.word", "w.t0")
    return some.select(
        "tid", ord_.alias("ord"), (ms / F.lit(1000.0)).alias("t_start"), ((ms + 10000 + (7919 * d + 104729 * i) % 60000) / F.lit(1000.0)).alias("t_end"),
        ((31 * d + 17 * i) % 101).cast("int").alias("score"), F.concat(F.lit("hook "), ord_.cast("string")).alias("hook"), F.col("word").alias("title"),
        F.lit("about").alias("description"), F.floor(i / 400).cast("int").alias("chunk_no"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by chunk of 400 words as JSON answers, some of them broken in the ways that answers are."""
    item = F.struct("ord", F.col("t_start").alias("start"), F.col("t_end").alias("end"), "score", "hook", "title", "description")
    grouped = candidates(spark, sf_dir).groupBy("tid", "chunk_no").agg(F.array_sort(F.collect_list(item)).alias("s"))
    body = F.to_json(F.struct(F.transform("s", lambda x: x.dropFields("ord")).alias("segments")))
    d = F.col("tid")
    answer = F.when(d % 11 == 3, F.expr("substring(body, 1, length(body) - 3)")).when(d % 13 == 5, F.lit("")).when(d % 17 == 7, F.lit('{"segments": "none"}')).when(d % 29 == 9, F.lit(None)).otherwise(F.col("body"))
    return grouped.withColumn("body", body).select("tid", "chunk_no", answer.alias("answer"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and size of the recordings: the last word's end, and 8000 bytes a second."""
    return words(spark, sf_dir).groupBy("tid").agg(F.max_by("t1", "idx").alias("duration")).withColumn("size_bytes", F.bround(F.col("duration") * 8000).cast("long"))


def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of 0.3 seconds or more between words, numbered."""
    ordered = in_order()
    gaps = words(spark, sf_dir).select("tid", "idx", F.col("t1").alias("s"), F.lead("t0").over(ordered).alias("e"))
    wide = gaps.where(F.bround((F.col("e") - F.col("s")) * 1000) >= 300)
    return wide.select("tid", (F.row_number().over(Window.partitionBy("tid").orderBy("idx")) - 1).alias("pos"), "s", "e")


def silence_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silences as a detector's log lines; every seventh log lacks its last end."""
    line = lambda name, c: F.concat(F.lit(f"[silence] silence_{name}: "), F.call_function("format_number", F.col(c), F.lit("0.000")), F.lit("\n"))
    last = F.col("pos") == F.max("pos").over(Window.partitionBy("tid"))
    lines = silences(spark, sf_dir).withColumn("line", F.concat(line("start", "s"), F.when(last & (F.col("tid") % 7 == 0), "").otherwise(line("end", "e"))))
    return lines.groupBy("tid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("log"))


def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts cut into chunks of 120 seconds that reach 10 seconds into the next, times from the chunk's start; of some the second one failed."""
    w = words(spark, sf_dir)
    ms = F.bround(F.col("t0") * 1000).cast("long")
    first, last = F.floor(F.greatest(F.lit(0), ms - 10000) / 120000), F.floor(ms / 120000)
    spread = w.withColumn("chunk_no", F.explode(F.sequence(first.cast("int"), last.cast("int")))).where(ms < (F.col("chunk_no") + 1) * 120000 + 10000)
    start = F.col("chunk_no") * 120
    word = F.struct("idx", "word", ((F.bround(F.col("t0") * 1000) - start * 1000) / F.lit(1000.0)).alias("t0"), ((F.bround(F.col("t1") * 1000) - start * 1000) / F.lit(1000.0)).alias("t1"))
    rows = spread.groupBy("tid", "chunk_no").agg(F.array_sort(F.collect_list(word)).alias("w"))
    inner = F.transform("w", lambda x: x.dropFields("idx"))
    failed = (F.col("tid") % 19 == 4) & (F.col("chunk_no") == 1)
    return rows.select("tid", "chunk_no", start.cast("double").alias("start"), F.when(F.col("tid") % 3 == 0, "en").otherwise("").alias("language"), F.when(~failed, inner).alias("words"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, sha): each distinct text by its hash, with its least document id."""
    known = table(spark, sf_dir, "documents").where("text is not null")
    return known.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.min("doc_id").alias("d"))


def file_name(d):
    return F.concat(F.lit("v"), d.cast("string"), F.lit(".mp4"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files: name, sha256, scheme."""
    return table(spark, sf_dir, "documents").where("text is not null").select(
        F.col("doc_id").alias("d"), file_name(F.col("doc_id")).alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.lit("full").alias("scheme"))


def crop_of(d, shift=0):
    x = F.when(d % 23 == 0, F.lit(3000)).otherwise(37 * d % 2600) + shift
    return F.struct(x.cast("int").alias("x"), F.lit(0).alias("y"), F.lit(1215).alias("w"), F.lit(2160).alias("h"))


def calibration_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibration as JSON for most sources: some automatic, some with the crop out of the frame, some broken."""
    d = F.col("d")
    body = F.to_json(F.struct(
        file_name(d).alias("source_name"), F.when(d % 7 == 0, "auto").otherwise("setup").alias("setup_label"), crop_of(d).alias("crop"), F.array(F.lit(1080), F.lit(1920)).alias("scale"),
        F.array(F.lit(3840), F.lit(2160)).alias("frame"), F.when(d % 5 == 0, 1.5).alias("rotation_deg"), F.when(d % 4 == 0, "warm").alias("palette"), F.when(d % 7 == 0, True).alias("auto")))
    return sources(spark, sf_dir).where(d % 11 != 0).withColumn("body", body).select("d", F.col("sha").alias("source_sha256"), F.when(d % 37 == 5, F.expr("substring(body, 1, length(body) - 2)")).otherwise(F.col("body")).alias("text"))


def manifest_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of 65 or more of the sources, numbered in input order."""
    good = candidates(spark, sf_dir).where("score >= 65").join(sources(spark, sf_dir).select(F.col("d").alias("tid"), F.col("sha").alias("source_sha256")), ["tid"])
    number = F.row_number().over(Window.partitionBy("tid").orderBy("ord"))
    return good.select(
        "tid", "source_sha256", F.concat(F.lit("r"), F.lpad(number.cast("string"), 5, "0")).alias("seg_id"), "t_start", "t_end", "score", "hook", "title", "description", F.lit("").alias("reason"), F.lit("").alias("topic"),
        F.col("t_start").alias("r0_start"), F.col("t_end").alias("r0_end"), F.array().cast("array<string>").alias("flags"), F.array().cast("array<struct<word:string,t0:double,t1:double>>").alias("words"))


def manifest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    setup = F.struct(
        F.when(d % 7 == 0, "auto").otherwise("setup").alias("setup_id"), crop_of(d, F.when(d % 7 == 1, 10).otherwise(0)).alias("crop"), F.array(F.lit(1080), F.lit(1920)).alias("scale"), F.array(F.lit(3840), F.lit(2160)).alias("frame"),
        F.when(d % 5 == 0, 1.5).otherwise(0.0).alias("rotation_deg"), F.when(d % 4 == 0, "warm").alias("palette"))
    return sources(spark, sf_dir).select(file_name(d).alias("source"), F.col("sha").alias("source_sha256"), F.lit("full").alias("source_hash_scheme"), F.lit("shorts").alias("duration_preset"), setup.alias("setup"))


def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests as JSON, some with an unknown key, some cut short, some with a rotation out of range."""
    whole = assemble_manifest(manifest_segments(spark, sf_dir), manifest_sources(spark, sf_dir))
    body = whole.select("source", F.to_json(F.struct(*whole.columns)).alias("body"), F.regexp_extract("source", r"\d+", 0).cast("long").alias("d"))
    d = F.col("d")
    text = (
        F.when(d % 31 == 2, F.concat(F.lit('{"extra":1,'), F.expr("substring(body, 2)"))).when(d % 37 == 3, F.expr("substring(body, 1, length(body) - 5)"))
        .when(d % 41 == 4, F.regexp_replace("body", '"rotation_deg":[0-9.]+', '"rotation_deg":90.0')).otherwise(F.col("body"))
    )
    return body.select(F.regexp_replace("source", r"\..*$", "").alias("key"), text.alias("text"))
