"""The digest of a batch's names, in order."""

import hashlib

from cueloom.operators import reconcile as R


def test_names_md5_is_of_all_names_in_order(spark, monkeypatch):
    monkeypatch.setattr(R, "NAMES", 100)  # several blocks a range
    names = [f"n{k * 7919 % 3001:04}é" for k in range(3000)]
    log = spark.createDataFrame([(n, "ok" if k % 3 else "failed") for k, n in enumerate(names)] + [("x", None), (None, "ok"), ("x", None), (None, "skipped")], "name string, status string").repartition(7)
    kinds = {"ok": [n for k, n in enumerate(names) if k % 3], "failed": names[::3], None: ["x", "x"]}
    assert {tuple(r) for r in R.names_md5(log).collect()} == {(s, hashlib.md5(",".join(sorted(n)).encode()).hexdigest()) for s, n in kinds.items()}
