"""Hand-made cases of the operators."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.functions.config import Config
from cueloom.operators import audit as A
from cueloom.operators import boundaries as B
from cueloom.operators import candidates as C
from cueloom.operators import media as M
from cueloom.operators import packing as P
from cueloom.operators import reconcile as R
from cueloom.operators import words as O
from cueloom.sources import readers as S
from cueloom.sources import sinks as K
from cueloom.streaming import drain as D

WORDS = "tid long, idx int, word string, t0 double, t1 double"
SEGMENTS = "tid long, ord int, t_start double, t_end double, score int, flags array<string>"


def words(spark, *rows):
    return spark.createDataFrame([(1, k, w, float(a), float(b)) for k, (w, a, b) in enumerate(rows)], WORDS)


def segments(spark, *rows):
    return spark.createDataFrame([(1, k, float(a), float(b), s, []) for k, (a, b, s) in enumerate(rows)], SEGMENTS)


def spans(frame):
    return [(round(r["t_start"], 3), round(r["t_end"], 3)) for r in frame.orderBy("ord").collect()]


def phrases(spark):
    """Three words, a pause of two seconds, three words, a short pause of half a second, two words, a pause of four seconds, one word."""
    return words(spark, ("утро", 2, 2.4), ("было", 2.5, 2.9), ("тихим", 3.0, 3.5), ("потом", 5.5, 5.9), ("пришёл", 6.0, 6.6), ("ветер", 6.7, 7.2), ("сильный", 7.7, 8.3), ("холодный", 8.4, 9.0), ("дождь", 13.0, 13.6))


def test_sentences(spark):
    w = words(spark, ("Это", 0, 0.3), ("конец.»", 0.4, 0.8), ("Новая", 0.9, 1.2), ("мысль", 2.0, 2.4))
    assert [r["sent_no"] for r in O.split_sentences(w).orderBy("idx").collect()] == [0, 0, 1, 2]
    lines = O.compressed_lines(O.sentences(O.split_sentences(w))).orderBy("sent_no").collect()
    assert lines[0]["line"] == "[0000.0-0000.8] Это конец.»"


def test_formats(spark):
    rows = O.sentences(O.split_sentences(words(spark, ("a.", 0, 0.5), ("b.", 0.6, 1.0), ("c.", 3661.5, 3662.25))))
    assert O.paragraph_text(rows).first()["text"] == "a. b.\n\nc."
    assert O.cue_track(rows, "srt").first()["text"].endswith("3\n01:01:01,500 --> 01:01:02,250\nc.\n")
    assert O.cue_track(rows, "vtt").first()["text"].startswith("WEBVTT\n\n1\n00:00:00.000 --> ")
    with pytest.raises(ValueError, match="cue format"):
        O.cue_track(rows, "ass")


def test_empty_words(spark):
    none = words(spark)
    assert O.paragraph_text(O.sentences(O.split_sentences(none))).count() == 0
    assert spans(B.settle(segments(spark, (1, 20, 70)), B.flagged(none))) == [(1.0, 20.0)]
    assert P.group_captions(none).count() == 0


def test_split_oversize(spark):
    w = words(spark, *[(f"w{k}", k * 1.0, k * 1.0 + 0.8 - 0.1 * (k == 4)) for k in range(10)]).withColumn("sent_no", F.lit(0))
    parts = O.sentences(O.split_oversize(w, 5.0)).orderBy("sent_no").collect()
    assert [p["n_words"] for p in parts] == [5, 5]
    assert O.sentences(O.split_oversize(w.limit(1), 0.1)).count() == 1


def test_phrase_ends(spark):
    w = words(spark, ("да,", 0, 1), ("и", 5, 6), ("вот.", 9, 10), ("слово", 12, 13))
    assert [r["phrase_end"] for r in O.phrase_ends(w).orderBy("idx").collect()] == [False, False, True, True]


def test_snap_and_pad(spark):
    w = B.flagged(phrases(spark))
    near = B.snap_start(segments(spark, (6.3, 8.6, 80)), w)
    assert spans(near) == [(5.5, 8.6)]  # the phrase start, not the nearer word starts
    assert spans(B.snap_end(near, w)) == [(5.5, 9.3)]  # the end before the long pause, and the tail
    assert spans(B.apply_padding(segments(spark, (5.5, 9.3, 80)), w)) == [(5.2, 9.7)]
    assert spans(B.snap_start(segments(spark, (11.0, 20, 80)), w)) == [(11.0, 20.0)]  # no word within the window


def test_media_length_caps_the_end(spark):
    w = B.flagged(phrases(spark))
    held = segments(spark, (5.5, 9.3, 80), (12, 14, 80)).withColumn("length", F.when(F.col("ord") == 0, 9.2))
    assert spans(B.apply_padding(held, w, cap_at_speech_end=False, duration="length")) == [(5.2, 9.2), (12.7, 14.3)]


def odd_segments(spark):
    """A sound segment; null bounds; reversed, far and huge ones; an unknown transcript."""
    rows = [(1, 0, 6.3, 8.6), (1, 1, None, 8.6), (1, 2, 6.3, None), (1, 3, None, None), (1, 4, 8.0, 2.0), (1, 5, 1e12, 2e12), (1, 6, -1e12, 1e12), (7, 7, 6.3, 8.6), (None, 8, 6.3, 8.6)]
    return spark.createDataFrame([(*r, 80, ["too_long"], r[2], r[3]) for r in rows], SEGMENTS + ", r0_start double, r0_end double")


def test_every_segment_stays_whatever_its_bounds(spark):
    raw, w = odd_segments(spark), B.flagged(phrases(spark))
    same = {r["ord"]: (r["t_start"], r["t_end"]) for r in raw.collect()}
    steps = [B.snap_start(raw, w), B.snap_end(raw, w), B.apply_padding(raw, w), B.trim_too_long(raw, w), B.settle(raw, w), B.words_in_segment(raw, phrases(spark))]
    for made in steps:
        found = {r["ord"]: (r["t_start"], r["t_end"]) for r in made.collect()}
        assert sorted(found) == list(range(9)) and (found[1][0], found[3]) == (None, (None, None))
    attached = {r["ord"]: len(r["words"]) for r in steps[-1].collect()}
    assert attached == {0: 3, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 9, 7: 0, 8: 0}
    padded = {r["ord"]: (r["t_start"], r["t_end"]) for r in steps[2].collect()}
    assert all(padded[k] == same[k] for k in (1, 2, 3, 4, 5, 7, 8))
    ends = {r["ord"]: r["end_type"] for r in A.classify_end(raw, w).collect()}
    assert sorted(ends) == list(range(9)) and {ends[k] for k in (2, 3, 7, 8)} == {A.NO_WORDS} and ends[5] == A.SPEECH_END
    assert P.caption_track(raw, phrases(spark)).count() == 9
    kept, report = B.resnap(raw, w)
    assert kept.count() == 9 and {r["tid"]: r["status"] for r in report.collect()} == {1: "skipped", 7: "skipped", None: "skipped"}


def test_resnap(spark):
    w = B.flagged(phrases(spark))
    stored = segments(spark, (6, 8, 80), (5.2, 9.7, 70)).withColumns({"r0_start": F.lit(6.3), "r0_end": F.lit(8.6)})
    kept, report = B.resnap(stored, w)
    assert spans(kept) == [(5.2, 9.7)] * 2 and tuple(report.first()) == (1, "resnapped", 1)
    long = stored.withColumn("flags", F.when(F.col("ord") == 0, F.array(F.lit("too_long"))).otherwise(F.col("flags")))
    kept, report = B.resnap(long, w, policy="drop")
    assert spans(kept) == [(5.2, 9.7)] and tuple(report.first()) == (1, "resnapped", 0)


def test_pages_of_a_long_transcript(spark, monkeypatch):
    """Words in small pages give what words in one page give."""
    many = words(spark, *[(f"w{k}" + ("." if k % 7 == 6 else ""), k * 0.5 + (k % 5) * 0.02, k * 0.5 + 0.4 + (k % 3) * 0.2) for k in range(400)])
    asked = C.flag_durations(segments(spark, *[(k * 3.3, k * 3.3 + 20 + 11 * (k % 5), 50) for k in range(50)]))
    made = []
    for size in (5, 1000):
        monkeypatch.setattr(B, "PAGE", size)
        settled = B.settle(asked, B.flagged(many), attach=True)
        made.append((sorted(map(repr, settled.collect())), sorted(map(repr, A.classify_end(settled, B.flagged(many)).collect()))))
    assert made[0] == made[1]


def test_words_out_of_order_are_in_reach(spark, monkeypatch):
    """Hanging words, and words whose times go back by a minute: small pages and blocks give what one page and one block give."""
    texts = [("и" if k % 6 in (0, 1) else f"w{k}") + ("." if k % 9 == 8 else "") for k in range(300)]
    many = B.flagged(words(spark, *[(w, t0, t0 + 0.4) for k, w in enumerate(texts) for t0 in [100 + k * 0.6 - 60 * (k % 11 == 10)]]))
    asked = C.flag_durations(segments(spark, *[(100 + k * 2.9, 100 + k * 2.9 + 15 + 23 * (k % 4), 50) for k in range(60)]))
    made = []
    for size, seconds in ((3, 7.0), (1000, 1e9)):
        monkeypatch.setattr(B, "PAGE", size)
        monkeypatch.setattr(B, "BLOCK", seconds)
        stored = asked.withColumns({"r0_start": F.col("t_start") + 1, "r0_end": F.col("t_end")})
        kept, report = B.resnap(stored, many)
        made.append([sorted(map(repr, f.collect())) for f in (B.settle(asked, many, Config(max_duration=30.0), attach=True), kept, report)])
    assert made[0] == made[1] and made[0][0] != sorted(map(repr, asked.collect()))


def test_snap_never_ends_on_a_hanging_word(spark):
    w = B.flagged(words(spark, ("мысль", 0, 1), ("и", 1.2, 1.4), ("ещё", 5.0, 5.5)))
    assert spans(B.snap_end(segments(spark, (0, 1.4, 80)), w, Config(max_duration=3.0))) == [(0.0, 1.3)]


def test_trim_policies(spark):
    w, long = B.flagged(phrases(spark)), C.flag_durations(segments(spark, (1, 70, 80), (5, 25, 70)))
    assert spans(B.trim_too_long(long, w)) == [(1.0, 13.6), (5.0, 25.0)]  # the last word ends the window, so it counts as a pause
    assert spans(B.trim_too_long(long, w, Config(max_duration=6.5))) == [(1.0, 7.2), (5.0, 25.0)]  # up to 7.5: the pause before the eighth second
    assert spans(B.trim_too_long(long, w, policy="drop")) == [(5.0, 25.0)]
    assert spans(B.trim_too_long(long, w, policy="keep")) == [(1.0, 70.0), (5.0, 25.0)]
    with pytest.raises(ValueError, match="policy"):
        B.trim_too_long(long, w, policy="other")


def test_end_classes(spark):
    w = B.flagged(words(spark, ("Готово.", 0, 1), ("и", 1.2, 1.5), ("слово", 4, 5), ("да,", 5.1, 5.5), ("нет", 5.6, 6.0), ("конец", 6.7, 7.0)))
    rows = A.classify_end(segments(spark, (0, 1, 1), (0, 1.6, 1), (0, 5.5, 1), (0, 6.05, 1), (0, 8, 1), (-3, -1, 1)), w).orderBy("ord").collect()
    assert [(r["end_type"], r["verdict"]) for r in rows] == [
        (A.SENTENCE, "CLEAN"), (A.HANGING, "HARD"), (A.COMMA, "HARD"), (A.PAUSE, "SOFT"), (A.SPEECH_END, "CLEAN"), (A.NO_WORDS, "HARD")]
    assert rows[1]["cause"] == "PAD-хвост +0.60с"
    assert {(r["verdict"], r["n"]) for r in A.end_quality_summary(A.classify_end(segments(spark, (0, 1, 1)), w)).collect()} == {("CLEAN", 1)}


def test_end_classes_with_many_overlapping_words(spark):
    # Forty words of no length start within "и": the next start is the forty-first.
    loop = B.flagged(words(spark, ("и", 0, 5), *[("раз", 1, 6)] * 40, ("потом", 5.9, 7)))
    row = A.classify_end(segments(spark, (0, 5, 1)), loop).first()
    assert (row["end_type"], row["pause_after"], row["verdict"], row["last_words"]) == (A.HANGING, 0.9, "HARD", "и")
    # Each of forty sentence ends starts within the one before: the walk goes back to the first.
    ends = B.flagged(words(spark, ("тут", 0, 1), *[(f"да{k}.", 2 - k * 0.01, 3) for k in range(40)], ("и", 2.9, 3), ("всё", 9, 10)))
    row = A.classify_end(segments(spark, (0, 3, 1)), ends).first()
    assert (row["end_type"], row["pause_after"], row["last_words"]) == (A.SENTENCE, 6.0, "да36. да37. да38. да39. и")
    early = B.flagged(words(spark, ("и.", 0, 40), *[("да.", 1, 50)] * 30, ("конец", 60, 61)))
    assert A.classify_end(segments(spark, (0, 50, 1)), early).first()["pause_after"] == 20.0
    # The last words before the end lie more than sixteen places apart.
    apart = B.flagged(words(spark, ("один", 0, 1), ("два", 1, 2), *[("долго", 2, 60)] * 30, ("да", 3, 4), ("конец", 70, 71)))
    assert A.classify_end(segments(spark, (0, 4, 1)), apart).first()["last_words"] == "один два да"


def test_dedup_keeps_overlap_at_the_threshold(spark):
    at = segments(spark, (0, 100, 70), (50, 150, 90))
    assert C.dedup_by_start(at).count() == 2
    over = segments(spark, (0, 60, 70), (5, 65, 90), (5, 5, 10))
    assert {r["ord"] for r in C.dedup_by_score(over).collect()} == {1, 2}
    assert {r["ord"] for r in C.dedup_by_start(over).collect()} == {0, 2}


def test_rank_past_99(spark):
    many = spark.range(120).select(F.lit(1).alias("tid"), F.col("id").cast("int").alias("ord"), F.lit(50).alias("score"))
    ids = [r["seg_id"] for r in C.rank_and_number(many).orderBy("rank").collect()]
    assert ids[0] == "r01" and ids[99] == "r100" and len(set(ids)) == 120
    assert C.rank_and_number(many, 3).count() == 3


def test_parse_candidates(spark):
    item = {"start": 1, "end": 20.5, "score": 70, "hook": "h", "title": "t", "description": "d"}
    answers = [None, " ", "{", "[1]", '{"segments": {}}', '{"segments": []}', json.dumps({"segments": [item]}), json.dumps({"segments": [item | {"score": 101}]}), json.dumps({"segments": [{k: v for k, v in item.items() if k != "hook"}]})]
    good, bad = C.parse_candidates(spark.createDataFrame([(1, k, a) for k, a in enumerate(answers)], "tid long, chunk_no int, answer string"))
    assert [(r["chunk_no"], r["reason"]) for r in bad.orderBy("chunk_no").collect()] == [(0, "empty"), (1, "empty"), (2, "invalid_json"), (3, "no_segments"), (4, "no_segments"), (7, "bad_segment"), (8, "bad_segment")]
    assert [(r["chunk_no"], r["t_start"], r["topic"]) for r in good.collect()] == [(6, 1.0, "")]


def test_pack_chunks(spark):
    lines = spark.createDataFrame([(1, k, "x" * 40) for k in range(5)] + [(1, 9, "  ")], "tid long, n int, line string")
    packed = P.pack_chunks(lines, 25, 10).orderBy("chunk_no").collect()
    assert [(r["line_from"], r["line_to"]) for r in packed] == [(0, 2), (1, 3), (2, 4), (3, 5)]
    assert P.pack_chunks(lines, 1000, 10).count() == 1
    assert [(r["line_from"], r["line_to"]) for r in P.pack_chunks(lines, 5, 0).orderBy("chunk_no").collect()] == [(k, k + 1) for k in range(5)]


def test_captions(spark):
    w = words(spark, ("один", 0, 0.3), ("два", 0.4, 0.6), ("три", 0.7, 0.9), ("четыре", 1.0, 1.2), ("пять", 2.0, 2.4), ("оченьдлинноеслово" * 2, 2.5, 3))
    assert [r["text"].split()[0] for r in P.group_captions(w).orderBy("cap_no").collect()] == ["один", "четыре", "пять", "оченьдлинноеслово" * 2]
    track = P.caption_track(segments(spark, (0.4, 1.0, 1), (100, 101, 1)), w).orderBy("ord").collect()
    assert track[0]["text"].endswith("Dialogue: 0,0:00:00.00,0:00:00.50,Default,,0,0,0,,{\\fad(120,80)}ДВА ТРИ\n")
    assert track[1]["text"] == P.TRACK_HEAD


def test_requests(spark):
    made = P.build_requests(spark.createDataFrame([("chunk",)], "text string"), "doc\n```\nfrom {{min_duration}} to {{max_duration}}\n```", [("in", "out")])
    assert [(m["role"], m["content"]) for m in made.first()["messages"]] == [("system", "from 15 to 59"), ("user", "in"), ("assistant", "out"), ("user", "chunk")]


def test_stitch(spark):
    w = "array<struct<word:string,t0:double,t1:double>>"
    chunks = spark.createDataFrame([
        (1, 0, 0.0, "ru", [("a", 0.0, 1.0), ("b", 0.9, 2.0)]), (1, 1, 10.0, None, None), (1, 2, 1.5, "", [("b", 0.0, 0.5), ("c", 1.0, 2.0), ("d", 1.9, 3.0)]), (1, 3, 0.0, "", [("x", 0.0, 1.0)]),
    ], f"tid long, chunk_no int, start double, language string, words {w}")
    row = M.stitch_chunks(chunks).first()
    assert row["language"] == "ru" and [x["word"] for x in row["words"]] == ["a", "b", "c", "d"]
    assert [(r["lost_from"], r["lost_to"]) for r in M.coverage_gaps(chunks).collect()] == [(10.0, 1.5)]


def test_splits(spark):
    log = spark.createDataFrame([(1, "silence_start: 590.0\nsilence_end: 594.0\nsilence_start: 606\nsilence_end: 610\nsilence_start: 900")], "tid long, log string")
    silences = M.parse_silence_log(log)
    assert silences.count() == 2
    targets = M.split_targets(spark.createDataFrame([(1, 1300.0)], "tid long, duration double"))
    assert [(r["target"], r["at"]) for r in M.nearest_split(targets, silences).orderBy("n").collect()] == [(600.0, 592.0), (1200.0, 1200.0)]


def test_scalars(spark):
    row = spark.createDataFrame([("7M", "128k", "900", "x")], "a string, b string, c string, d string").select(*[X.bits_per_second(F.col(c)) for c in "abcd"]).first()
    assert list(row) == [7e6, 128e3, 900.0, None]
    assert spark.range(1).select(X.padded_seconds(F.lit(0.25)), X.centis(F.lit(-3.0)), X.clock(F.lit(3.0015), ",")).first()[0] == "0000.2"


def manifest(**changes):
    base = {
        "source": "a.mp4", "source_sha256": "h", "duration_preset": "shorts", "run_key": "k", "reels": [{"id": "r01", "start": 0, "end": 20, "score": 70, "hook": "", "title": "", "description": ""}],
        "setup": {"setup_id": "auto", "crop": {"x": 0, "y": 0, "w": 1215, "h": 2160}, "scale": [1080, 1920], "frame": [3840, 2160]},
    }
    return json.dumps(base | changes)


def test_manifests(spark, tmp_path):
    bad_reel = json.loads(manifest())["reels"][0]
    texts = {"good": manifest(), "extra": manifest(note=1), "cut": manifest()[:-3], "score": manifest(reels=[bad_reel | {"score": 101}]), "inner": manifest(reels=[bad_reel | {"x": 1}]), "missing": manifest(run_key=None), "state": manifest(status="new")}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    good, bad = S.read_manifests(spark, str(tmp_path))
    assert [(r["key"], r["status"], r["source_hash_scheme"], r["reels"][0]["flags"]) for r in good.collect()] == [("good", "pending", "full", [])]
    assert {r["key"]: r["reason"] for r in bad.collect()} == {"extra": "unknown_key", "cut": "invalid_json", "score": "out_of_range", "inner": "unknown_key", "missing": "missing_field", "state": "out_of_range"}


def test_indented_files_are_read_whole(spark, tmp_path):
    """One indented document to a file, as the writers of such files leave them; keys are names without the last suffix."""
    at = {k: tmp_path / k for k in ("speech", "nested", "stored", "manifests", "calibrations")}
    for path in at.values():
        path.mkdir()
    said = [{"word": " Да", "start": 0.5, "end": 0.9}, {"word": " нет.", "start": 1.0, "end": 1.25}]
    put = lambda kind, name, body: (at[kind] / name).write_text(json.dumps(body, indent=2, ensure_ascii=False))
    put("speech", "a.b.json", {"task": "transcribe", "language": "Russian", "duration": 1.5, "text": "Да нет.", "words": said, "segments": None, "x": {"id": "q"}})
    put("speech", "empty.json", {"text": ""})
    put("nested", "c.json", {"segments": [{"words": said[:1]}, {"words": None}, {"words": said[1:]}]})
    put("stored", "h.1.json", {"language": "ru", "words": [{"word": "Да", "t0": 0.5, "t1": 0.9}]})
    put("manifests", "a.b.json", json.loads(manifest()))
    put("manifests", "bad.json", json.loads(manifest(note="1")))
    put("calibrations", "h.json", {"source_name": "a.mp4", "setup_label": "auto", "crop": {"x": 5, "y": 0, "w": 1215, "h": 2160}, "frame": [3840, 2160], "rotation_applied": True})
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    assert rows(S.read_word_json(spark, str(at["speech"]))[0]) == [("a.b", "Russian", 0, " Да", 0.5, 0.9), ("a.b", "Russian", 1, " нет.", 1.0, 1.25)]
    assert rows(S.read_segmented_word_json(spark, str(at["nested"]))[0]) == [("c", "", 0, " Да", 0.5, 0.9), ("c", "", 1, " нет.", 1.0, 1.25)]
    assert rows(S.read_transcripts(spark, str(at["stored"]))[0]) == [("h.1", "ru", 0, "Да", 0.5, 0.9)]
    good, bad = S.read_manifests(spark, str(at["manifests"]))
    assert [r["key"] for r in good.collect()] == ["a.b"] and rows(bad) == [("bad", "unknown_key")]
    assert [(r["source_sha256"], r["kind"], r["crop"]["x"]) for r in S.read_calibrations(spark, str(at["calibrations"])).collect()] == [("h", "auto", 5)]


def test_manifests_are_written_by_source(spark, tmp_path):
    texts = [("k", manifest(source=f"{name}.mp4", source_sha256=name)) for name in ("a.b", "c")]
    good = S.parse_manifests(spark.createDataFrame(texts, "key string, text string"))[0].drop("key")
    for lines in (False, True):
        path = str(tmp_path / f"lines-{lines}")
        K.write_manifests(good.coalesce(1), path, lines=lines)
        again, bad = S.read_manifests(spark, path, lines=lines)
        assert {r["key"]: r["source"] for r in again.collect()} == {"a.b": "a.b.mp4", "c": "c.mp4"} and bad.count() == 0
        assert sorted(map(repr, again.drop("key").collect())) == sorted(map(repr, good.collect()))


def test_a_corrupt_manifest_of_a_name_with_two_dots_shows(spark):
    files = spark.createDataFrame([("a.b.mp4", "h")], "name string, sha256 string")
    good, bad = S.parse_manifests(spark.createDataFrame([("a.b", "{")], "key string, text string"))
    calibrations = S.parse_calibrations(spark.createDataFrame([], "source_sha256 string, text string"))
    assert R.sync_status(files, good, bad.withColumnRenamed("key", "stem"), calibrations).first()["manifest"] == "corrupt"


def test_too_many_profiles_are_an_error(spark):
    profiles = spark.range(1500).select(F.col("id").cast("string").alias("profile"), F.lit("1M").alias("video"), F.lit("1k").alias("audio"))
    held = segments(spark, (0, 8, 1), (0, 8, 1))
    with pytest.raises(ValueError, match="profiles"):
        R.estimate_output_size(held, profiles)
    found = R.estimate_output_size(held, profiles.where("id < 900")).collect()
    assert len(found) == 900 and found[0]["mb"] == 1_001_000 * 16 / 8 / 1024 / 1024
    assert R.estimate_output_size(held, profiles.limit(0)).count() == 0


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    from cueloom.functions import shared

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared.shared_dir(Session())


def test_reconcile(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"source_name": "a.mp4", "setup_label": "mine", "crop": {"x": 5, "y": 0, "w": 1215, "h": 2160}, "frame": [3840, 2160]}))
    (tmp_path / "broken.json").write_text("{")
    calibrations = S.read_calibrations(spark, str(tmp_path))
    assert {r["source_sha256"]: r["kind"] for r in calibrations.collect()} == {"h": "manual", "broken": "corrupt"}
    asked = spark.createDataFrame([("h",), ("none",)], "sha256 string")
    assert {r["sha256"]: r["kind"] for r in S.calibration_kinds(asked, calibrations).collect()} == {"h": "manual", "none": "none"}
    manifests = S.parse_manifests(spark.createDataFrame([("a", manifest())], "key string, text string"))[0]
    assert R.calibration_desync(manifests, calibrations).first()["state"] == "manual_appeared"
    frames = spark.createDataFrame([], "source string, frame array<int>")
    fresh = R.recrop(manifests, calibrations, frames).first()
    assert (fresh["recrop"], fresh["setup"]["crop"]["x"], fresh["reels"][0]["id"]) == ("updated", 5, "r01")
    other = S.parse_manifests(spark.createDataFrame([("b", manifest(source_sha256="new"))], "key string, text string"))[0]
    assert R.recrop(other, calibrations, frames).first()["recrop"] == "skipped"


def test_content_dedup(spark):
    rows = lambda *x: spark.createDataFrame(x, "name string, sha256 string")
    found = R.content_dedup(rows(("a", "1"), ("b", "2"), ("c", "3")), rows(("a", "1"), ("b", "9")))
    assert {r["name"]: r["action"] for r in found.collect()} == {"a": "skip", "b": "conflict", "c": "accept"}


def test_publication(spark):
    rows = spark.createDataFrame([(1, "r01", "t", "d"), (1, "r02", None, "")], "tid long, seg_id string, title string, description string")
    assert [r["body"] for r in K.publication_text(rows).collect()] == ["t\n\nd\n"]


def test_drain_is_idempotent(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "archive", "log", "ckpt")}
    load = lambda *rows: spark.createDataFrame(rows, D.SCHEMA).coalesce(1).write.mode("append").parquet(at["in"])
    run = lambda: D.incremental_drain(spark, at["in"], at["archive"], at["log"], at["ckpt"], least=2)
    load(("a", "xx"), ("b", "xx"), ("c", ""), ("d", None))
    run()
    run()
    load(("e", "xx"), ("f", "yyy"))
    run()
    assert sorted(r["name"] for r in spark.read.parquet(at["archive"]).collect()) == ["a", "f"]
    assert {(r["name"], r["status"]) for r in D.ledger(spark, at["log"]).collect()} == {("a", "drained"), ("b", "drained"), ("c", "skipped"), ("d", "skipped"), ("e", "drained"), ("f", "drained")}


def test_drain_isolates_failures_and_repeated_batches(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "archive", "log", "ckpt")}
    rows = spark.createDataFrame([("a", '{"x": 1}'), ("b", "{broken"), ("c", "")], D.SCHEMA)
    rows.coalesce(1).write.parquet(at["in"])
    problem = F.when(F.try_parse_json("content").isNull(), "not JSON")
    D.incremental_drain(spark, at["in"], at["archive"], at["log"], at["ckpt"], least=2, problem=problem)
    D.drain_batch(rows, 0, at["archive"], at["log"], 2, problem)  # the same batch once more
    assert [r["name"] for r in spark.read.parquet(at["archive"]).collect()] == ["a"]
    assert sorted((r["name"], r["status"], r["reason"]) for r in D.ledger(spark, at["log"]).collect()) == [("a", "drained", None), ("b", "failed", "not JSON"), ("c", "skipped", None)]


def test_batch_outcome_gathers_no_names(spark):
    names = [f"n{k:04}" for k in range(3000)]
    log = spark.createDataFrame([(n, "ok" if k % 3 else "failed") for k, n in enumerate(names)] + [("x", None), (None, "ok"), ("x", None)], "name string, status string").repartition(7)
    assert {tuple(r) for r in R.batch_outcome(log).collect()} == {("ok", 2001), ("failed", 1000), (None, 2)}
    kinds = {"ok": [n for k, n in enumerate(names) if k % 3], "failed": names[::3], None: ["x", "x"]}
    assert [tuple(r) for r in R.batch_names(log).collect()] == [(None, "x"), (None, "x"), *[(s, n) for s in ("failed", "ok") for n in kinds[s]]]
    digest = lambda held: "-".join(str(sum(int(hashlib.md5(n.encode()).hexdigest()[8 * k : 8 * k + 8], 16) for n in held)) for k in range(4))
    found = R.names_digest(log)
    assert {r["status"]: r["names_digest"] for r in found.collect()} == {s: digest(n) for s, n in kinds.items()}
    for frame in (R.batch_outcome(log), R.batch_names(log), found):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "Python" not in plan
