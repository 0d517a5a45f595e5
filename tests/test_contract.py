"""Every query of the library against its SQL, and the entry module's own rules."""

import hashlib

import pytest

import __spark_entry__ as entry
from cueloom.plans.oracles import SQL
from cueloom.plans.queries import PARTS, QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["tid", "sent_no", "line"]
    assert frame.limit(1).count() == 1


@pytest.mark.parametrize(("name", "shuffles", "scans"), [("h5_segment_pipeline", 6, 3), ("h3_resnap", 4, 2), ("h4_select_pipeline", 3, 2), ("h1_classify_end", 3, 2), ("c7_apply_padding", 3, 2)])
def test_lineages_are_evaluated_once(spark, sf_dir, name, shuffles, scans):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    full = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= scans and full.count("Exchange hashpartitioning") <= shuffles and "Cartesian" not in full


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partial_fingerprint(spark, sf_dir):
    head, middle, tail = PARTS
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for row in QUERIES["g2_partial_fingerprint"](spark, sf_dir).collect():
        data = texts[row["doc_id"]].encode()
        size, want = len(data), hashlib.sha256(data[:head])
        centre, last = max(0, size // 2 - middle // 2), max(0, size - tail)
        if centre > head:
            want.update(data[centre : centre + middle])
        if last > head or last > centre + middle:
            want.update(data[last : last + tail])
        want.update(size.to_bytes(8, "little"))
        assert row["fingerprint"] == want.hexdigest()
