"""Derived transcripts are made out of their one row: nothing is sorted, gathered or shuffled word by word, and what is written of them is packed."""

import glob
import os

import pytest

from cueloom.functions.shared import shared_dir
from cueloom.plans import queries as Q
from cueloom.plans import views as V


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_transcripts_are_made_row_by_row(spark, sf_dir):
    for frame in (V.transcripts(spark, sf_dir), V.words(spark, sf_dir), Q.speech_answers(spark, sf_dir)):
        made = plan(frame)
        assert not any(step in made for step in ("Sort", "Window", "Aggregate")) and made.count("Exchange") == 1


def test_long_transcripts_and_empty_ones(spark, tmp_path):
    """Times go on over many blocks of words; a document without words has no row."""
    texts = [(7, "  " + "word, and\n" * 1000), (8, ""), (9, None), (10, " \t\n"), (11, "one.")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["tid"]: r["words"] for r in V.transcripts(spark, str(tmp_path)).collect()}
    assert set(found) == {7, 11} and [tuple(w) for w in found[11]] == [("one.", 0.0, 0.32)]
    clock = 0
    for i, word in enumerate(found[7]):
        text = ("word,", "and")[i % 2]
        length = 80 + 60 * len(text)
        assert tuple(word) == (text, clock / 1000, (clock + length) / 1000)
        clock += length + (50 + (7919 * i + 217) % 600 if i % 2 == 0 else -40 if i % 53 == 52 else (104729 * i + 119) % 450)
    assert len(found[7]) == 2000


@pytest.mark.parametrize(("name", "folder"), [("a1_read_word_json", "word-json"), ("a2_read_segmented_word_json", "segmented-json"), ("a1_quarantined", "broken-word-json")])
def test_answers_are_written_packed(spark, sf_dir, name, folder):
    there = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/{folder}-*"))
    before = there()
    Q.QUERIES[name](spark, sf_dir)
    (path,) = there() - before
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert files and all(f.endswith(".gz") for f in files)
