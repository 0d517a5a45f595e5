"""Texts are parsed once, whatever is asked of what they hold."""

import pytest

from cueloom.sources import readers as S


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("reader", [S.read_word_json, S.read_segmented_word_json, S.read_transcripts])
def test_texts_are_parsed_once(spark, tmp_path, reader):
    path = str(tmp_path / "lines")
    spark.createDataFrame([('{"words": []}',)], "value string").write.text(path)
    for frame in reader(spark, path, lines=True):
        assert plan(frame).count("from_json(") == 1
