"""Keep manifests, calibrations, sources and outputs in step.

calibrations(source_sha256, source_name, setup_label, crop struct<x,y,w,h>, frame array<int>, rotation_deg, palette, auto, kind)
as read_calibrations gives them; manifests(source, source_sha256, source_hash_scheme, setup struct<setup_id,crop,scale,frame,rotation_deg,palette>, ...)
as read_manifests gives them; files(name, sha256, ...), one row per file and hash.
"""

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

ASPECT = 9 / 16
RATIO_SLACK, NEARLY_ALL, NEARLY_WIDE, NARROW = 0.02, 0.97, 0.9, 0.30
MIB = 1024 * 1024
#: Settings that each length meets; more are an error.
PROFILES = 1000


def outside(crop: Column, frame: Column) -> Column:
    return (crop["x"] < 0) | (crop["y"] < 0) | (crop["x"] + crop["w"] > F.get(frame, F.lit(0))) | (crop["y"] + crop["h"] > F.get(frame, F.lit(1)))


def off_ratio(crop: Column) -> Column:
    return F.abs(crop["w"] / crop["h"] - ASPECT) > RATIO_SLACK


def calibration_rules(calibrations: DataFrame) -> DataFrame:
    """(source_sha256, rule, hard): a row for each rule that a calibration breaks.

    Hard: outside_frame, not_9_16. Soft: wider_than_frame and nearly_whole_height (upright frames), nearly_whole_width
    (lying frames), narrow. Rows without a crop or frame break none.
    """
    crop, w, h = F.col("crop"), F.get("frame", F.lit(0)), F.get("frame", F.lit(1))
    rule = lambda when, name, hard: F.when(when, F.struct(F.lit(name).alias("rule"), F.lit(hard).alias("hard")))
    rules = F.array(
        rule(outside(crop, F.col("frame")), "outside_frame", True), rule(off_ratio(crop), "not_9_16", True), rule((h > w) & (crop["w"] > w), "wider_than_frame", False),
        rule((h > w) & (crop["h"] >= NEARLY_ALL * h), "nearly_whole_height", False), rule((w > h) & (crop["w"] >= NEARLY_WIDE * w), "nearly_whole_width", False),
        rule((w > 0) & (crop["w"] < NARROW * w), "narrow", False),
    )
    return calibrations.select("source_sha256", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("source_sha256", "r.rule", "r.hard")


def centred_crop(frame: Column) -> Column:
    """The 9:16 crop of full height in the middle of the frame."""
    w, h = F.get(frame, F.lit(0)), F.get(frame, F.lit(1))
    width = F.least(F.bround(h * ASPECT).cast("int"), w)
    return F.struct(F.floor((w - width) / 2).cast("int").alias("x"), F.lit(0).alias("y"), width.alias("w"), h.alias("h"))


def estimate_output_size(segments: DataFrame, profiles: DataFrame) -> DataFrame:
    """segments (tid, t_start, t_end), profiles (profile, video, audio bit rates such as 7M or 128k) to (tid, profile, mb), summed by source; whole milliseconds are summed, so that the order makes no difference.

    Profiles are settings, not data: more than PROFILES of them raise ValueError.
    """
    rate = profiles.select("profile", F.floor(X.bits_per_second(F.col("video"))).alias("v"), F.floor(X.bits_per_second(F.col("audio"))).alias("a"))
    rates = rate.select("profile", (F.col("v") + F.col("a")).alias("bps")).limit(PROFILES + 1).collect()
    if len(rates) > PROFILES:
        raise ValueError(f"more than {PROFILES} profiles")
    length = segments.groupBy("tid").agg(F.sum(F.bround((F.col("t_end") - F.col("t_start")) * 1000).cast("long")).alias("ms"))
    kind = dict(rate.dtypes)["profile"]
    each = F.array(*[F.struct(F.lit(r["profile"]).cast(kind).alias("profile"), F.lit(r["bps"]).cast("long").alias("bps")) for r in rates]).cast(f"array<struct<profile:{kind},bps:bigint>>")
    return length.select("tid", "ms", F.inline(each)).select("tid", "profile", (F.col("bps") * (F.col("ms") / F.lit(1000.0)) / 8 / MIB).alias("mb"))


def same_setup(setup: Column, crop: Column, rotation: Column, palette: Column) -> Column:
    zero = F.lit(0.0)
    return setup["crop"].eqNullSafe(crop) & (F.coalesce(setup["rotation_deg"], zero) == F.coalesce(rotation, zero)) & setup["palette"].eqNullSafe(palette)


def calibration_desync(manifests: DataFrame, calibrations: DataFrame) -> DataFrame:
    """(source, source_sha256, state): 'stale' where crop, rotation or palette differ from the calibration, 'manual_appeared' where, besides, the manifest has an automatic crop and the calibration is manual; others are left out."""
    c = calibrations.where(F.col("crop").isNotNull()).select(F.col("source_sha256").alias("h"), "crop", "rotation_deg", "palette", "kind")
    joined = manifests.join(c, manifests["source_sha256"] == F.col("h"))
    differs = joined.where(~same_setup(F.col("setup"), F.col("crop"), F.col("rotation_deg"), F.col("palette")))
    appeared = (F.col("setup.setup_id") == "auto") & (F.col("kind") == "manual")
    return differs.select("source", "source_sha256", F.when(appeared, "manual_appeared").otherwise("stale").alias("state"))


def recrop(manifests: DataFrame, calibrations: DataFrame, frames: DataFrame) -> DataFrame:
    """Manifests with the setup that their calibration gives now, and status.

    updated: the setup changed; synced: it is the same; skipped: the crop is invalid in its frame, there is neither a calibration nor a known
    frame size, or a manual calibration of that source name has another hash. frames (source, frame). Without a calibration the
    centred crop is used. Nothing but the setup changes.
    """
    c = calibrations.where(F.col("crop").isNotNull()).select(F.col("source_sha256").alias("h"), F.struct(
        F.coalesce("setup_label", F.lit("calibrated")).alias("setup_id"), "crop", F.array(F.lit(1080), F.lit(1920)).alias("scale"), "frame", F.coalesce("rotation_deg", F.lit(0.0)).alias("rotation_deg"), "palette").alias("found"))
    named = calibrations.where("kind = 'manual'").select(F.col("source_name").alias("n"), F.col("source_sha256").alias("nh")).groupBy("n").agg(F.collect_set("nh").alias("hashes"))
    f = frames.select(F.col("source").alias("fs"), F.col("frame").alias("f"))
    joined = manifests.join(c, manifests["source_sha256"] == F.col("h"), "left").join(f, manifests["source"] == F.col("fs"), "left").join(named, manifests["source"] == F.col("n"), "left")
    auto = F.struct(F.lit("auto").alias("setup_id"), centred_crop(F.col("f")).alias("crop"), F.array(F.lit(1080), F.lit(1920)).alias("scale"), F.col("f").alias("frame"), F.lit(0.0).alias("rotation_deg"), F.lit(None).cast("string").alias("palette"))
    fresh = F.when(F.col("h").isNotNull(), F.col("found")).when(F.col("hashes").isNull() & F.col("f").isNotNull(), auto)
    made = joined.withColumn("fresh", fresh)
    valid = F.col("fresh").isNotNull() & ~F.coalesce(outside(F.col("fresh.crop"), F.col("fresh.frame")) | off_ratio(F.col("fresh.crop")), F.lit(True))
    same = same_setup(F.col("setup"), F.col("fresh.crop"), F.col("fresh.rotation_deg"), F.col("fresh.palette")) & (F.col("setup.frame") == F.col("fresh.frame"))
    status = F.when(~valid, "skipped").when(same, "synced").otherwise("updated")
    marked = made.withColumn("status_", status)
    kept = [F.when(F.col("status_") == "updated", F.col("fresh")).otherwise(F.col("setup")).alias("setup") if name == "setup" else F.col(f"`{name}`") for name in manifests.columns]
    return marked.select(*kept, F.col("status_").alias("recrop"))


def missing_outputs(manifests: DataFrame, outputs: DataFrame) -> DataFrame:
    """manifests (source, reels array<struct<id,...>>), outputs (source, id) to (source, id) of the segments that have no output."""
    wanted = manifests.select("source", F.explode("reels.id").alias("id"))
    return wanted.join(outputs.select("source", "id"), ["source", "id"], "left_anti")


def orphan_manifests(manifests: DataFrame, inputs: DataFrame, archive: DataFrame) -> DataFrame:
    """Manifests whose source's stem is neither among the inputs nor in the archive (each with a name)."""
    known = inputs.select(X.stem(F.col("name")).alias("__stem")).unionByName(archive.select(X.stem(F.col("name")).alias("__stem"))).distinct()
    return manifests.join(known, X.stem(manifests["source"]) == F.col("__stem"), "left_anti")


def resolve_source(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(source, source_sha256, name): the file with the manifest's hash under its scheme; of several the one of the source's name, else the first by name; null if none. files (scheme, sha256, name)."""
    joined = manifests.join(files.withColumnsRenamed({"sha256": "__h", "scheme": "__s"}), (F.col("source_sha256") == F.col("__h")) & (F.col("source_hash_scheme") == F.col("__s")), "left")
    hint = F.regexp_extract("source", r"([^/\\]*)$", 1)
    best = F.min(F.when(F.col("name").isNotNull(), F.struct((F.col("name") != hint).cast("int").alias("other"), "name")))
    return joined.groupBy("source", "source_sha256").agg(best["name"].alias("name"))


def rekey_calibrations(calibrations: DataFrame, files: DataFrame) -> DataFrame:
    """(source_name, old_sha256, source_sha256): manual calibrations to be moved to the hash that the file of their name has now. files (name, sha256)."""
    manual = calibrations.where("kind = 'manual'").select("source_name", F.col("source_sha256").alias("old_sha256"))
    return manual.join(files.select(F.col("name").alias("source_name"), F.col("sha256").alias("source_sha256")), ["source_name"]).where("old_sha256 <> source_sha256").select("source_name", "old_sha256", "source_sha256")


def renamed_content_guard(files: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Files without a calibration under their hash, though there is a manual one of their name."""
    manual = calibrations.where("kind = 'manual'").select(F.col("source_name").alias("__n"))
    without = files.join(calibrations.select(F.col("source_sha256").alias("__h")), files["sha256"] == F.col("__h"), "left_anti")
    return without.join(manual, F.col("name") == F.col("__n"), "left_semi")


def sync_status(files: DataFrame, manifests: DataFrame, corrupt: DataFrame, calibrations: DataFrame) -> DataFrame:
    """(name, calibration, manifest) per file: kind of its calibration, and none, corrupt, stale or ok. corrupt (stem): manifests that can't be read."""
    desync = calibration_desync(manifests, calibrations).select(X.stem(F.col("source")).alias("ds")).distinct()
    there, broken = manifests.select(X.stem(F.col("source")).alias("ms")).distinct(), corrupt.select(F.col("stem").alias("bs")).distinct()
    kinds = calibrations.groupBy(F.col("source_sha256").alias("h")).agg(F.min("kind").alias("kind"))
    named = files.withColumn("stem", X.stem(F.col("name")))
    joined = named.join(kinds, named["sha256"] == F.col("h"), "left").join(there, F.col("stem") == F.col("ms"), "left").join(broken, F.col("stem") == F.col("bs"), "left").join(desync, F.col("stem") == F.col("ds"), "left")
    state = F.when(F.col("bs").isNotNull(), "corrupt").when(F.col("ms").isNull(), "none").when(F.col("ds").isNotNull(), "stale").otherwise("ok")
    return joined.select("name", F.coalesce("kind", F.lit("none")).alias("calibration"), state.alias("manifest"))


def assemble_manifest(segments: DataFrame, sources: DataFrame) -> DataFrame:
    """segments (source_sha256, seg_id, t_start, t_end, score, hook, title, description, reason, topic, r0_start, r0_end, flags, words), sources (source, source_sha256, source_hash_scheme, duration_preset, setup) to one manifest per source; sources without segments have an empty reels array."""
    reel = F.struct(
        F.col("seg_id").alias("id"), F.col("t_start").alias("start"), F.col("t_end").alias("end"), "score", "hook", "title", "description", "reason", "topic", "r0_start", "r0_end", "flags", F.col("words").alias("subtitles"))
    nested = segments.groupBy(F.col("source_sha256").alias("__h")).agg(F.array_sort(F.collect_list(reel)).alias("reels"))
    joined = sources.join(nested, sources["source_sha256"] == F.col("__h"), "left")
    return joined.select("source", "source_sha256", "source_hash_scheme", "duration_preset", "setup", X.run_key(F.col("source_sha256"), F.col("duration_preset")).alias("run_key"), F.lit("pending").alias("status"), F.coalesce("reels", F.array()).alias("reels"))


def project_status(inputs: DataFrame, manifests: DataFrame, rendered: DataFrame, archive: DataFrame) -> DataFrame:
    """(what, n): how many of each there are."""
    counted = [frame.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, frame in (("inputs", inputs), ("manifests", manifests), ("rendered", rendered), ("archive", archive))]
    whole = counted[0]
    for part in counted[1:]:
        whole = whole.unionByName(part)
    return whole


def batch_outcome(log: DataFrame) -> DataFrame:
    """log (name, status of ok, skipped or failed) to (status, n), counted in part before the shuffle."""
    return log.groupBy("status").agg(F.count("*").alias("n"))


def batch_names(log: DataFrame) -> DataFrame:
    """log to (status, name): the names as ordinary rows, sorted by ranges of both, so that no row or task holds all names of a status."""
    return log.where("name is not null").select("status", "name").orderBy("status", "name")


def names_digest(log: DataFrame) -> DataFrame:
    """(status, names_digest): the sums of the four 32-bit parts of the names' MD5 hashes. Whole logs can be compared by it, names that repeat count repeatedly, and as sums don't depend on order, they are made in part before the shuffle; no task sees all names of a status."""
    hashed = F.md5(F.col("name").cast("binary"))
    parts = [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("decimal(10,0)").alias(f"__{k}") for k in range(4)]
    sums = [F.coalesce(F.sum(f"__{k}"), F.lit(0)).cast("string") for k in range(4)]
    return log.select("status", *parts).groupBy("status").agg(F.concat_ws("-", *sums).alias("names_digest"))


#: Names to a block of names_md5().
NAMES = 4096


def names_md5(log: DataFrame) -> DataFrame:
    """(status, names_md5): MD5 of each status's sorted names with commas between them; no row for a status without names.

    Names are sorted by ranges and joined in blocks of NAMES in all tasks; only the digest, which is made in order, reads the blocks of a
    status one after the other, and holds one of them.
    """
    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        status, digest = None, None
        for batch in batches:
            for key, names in zip(batch["status"], batch["names"], strict=True):
                if digest is not None and key == status:
                    digest.update(b"," + names.encode())
                    continue
                if digest is not None:
                    yield pd.DataFrame({"status": [status], "names_md5": [digest.hexdigest()]}, dtype=object)
                status, digest = key, hashlib.md5(names.encode())
        if digest is not None:
            yield pd.DataFrame({"status": [status], "names_md5": [digest.hexdigest()]}, dtype=object)

    placed = batch_names(log).withColumn("block", F.floor(F.monotonically_increasing_id() / NAMES))  # ids grow from range to range
    blocks = placed.groupBy("status", "block").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return blocks.repartition("status").sortWithinPartitions("status", "block").mapInPandas(digests, "status string, names_md5 string")


def content_dedup(incoming: DataFrame, archive: DataFrame) -> DataFrame:
    """incoming and archive (name, sha256) to (name, action): accept a new name, skip what the archive has with the same content, conflict where it has other content."""
    there = archive.groupBy(F.col("name").alias("__n")).agg(F.collect_set("sha256").alias("hashes"))
    joined = incoming.join(there, incoming["name"] == F.col("__n"), "left")
    return joined.select("name", F.when(F.col("hashes").isNull(), "accept").when(F.array_contains("hashes", F.col("sha256")), "skip").otherwise("conflict").alias("action"))
