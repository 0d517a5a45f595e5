"""The filter audit and fill-in-the-middle against brute force, on odd rows too."""

import hashlib
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.llm import fill_in_middle as M
from cueloom.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *rows):
    """Rows (doc_id, text, source)."""
    return spark.createDataFrame([(d, t, "en", s, 7) for d, t, s in rows], DOCS)


PLAIN = " ".join(f"word{k}" for k in range(60))
ODD = [
    (1, PLAIN, "a"), (2, PLAIN, "a"), (2, PLAIN, "b"), (1, PLAIN, "a"), (3, "same " * 60, "a"), (4, "BIG Words " * 30, None), (5, None, ""), (None, PLAIN, "a"), (None, None, None),
    (6, "", "a"), (7, f"{PLAIN} #", "b"), (8, f"{PLAIN} #", "c"), (9, "é x " * 50, "c"), (10, "x y " * 30_000, "b"), (7, "other $", "c"),
]
LABELS = [(1, 1, 0), (1, 0, 0), (2, 0, 1), (3, None, 1), (8, 1, 1), (None, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def audit_by_hand(rows, labels):
    """Every order applied filter by filter to every document."""
    first = {}
    for key, text, _ in rows:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    made = []
    for key, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, f in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), key is not None and key > first[t]), strict=True) if f}
        made.append((part or "", fails, key in good, key in toxic))
    out = {}
    for part in {m[0] for m in made}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [m for m in made if m[0] == part]
            whole = left
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(gone)
                failing = sum(f in m[1] for m in whole)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(m[1] == {f} for m in whole), sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_equals_every_order_by_hand(spark, labels):
    rows = A.filter_audit(docs(spark, *ODD), labels).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in A.COUNTS] for r in rows}
    assert len(rows) == len(got) == 600 * 4
    assert got == audit_by_hand(ODD, LABELS)


def test_audit_of_nothing_and_of_clashing_columns(spark, labels):
    assert A.filter_audit(docs(spark), labels).count() == 0
    clashing = docs(spark, *ODD).withColumns({c: F.lit(5) for c in ("key", "part", "digest", "mask", "n", "least", "good", "quality")})
    unlabelled = A.filter_audit(clashing, labels.limit(0))
    assert unlabelled.count() == 600 * 4
    assert unlabelled.agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


def test_gray_walk_equals_direct_sums():
    cells = np.random.default_rng(3).integers(0, 50, (7, A.CELLS, 3))
    states = A.gray_walk(cells)
    for subset in range(A.CELLS):
        assert (states[:, subset] == cells[:, [m for m in range(A.CELLS) if not m & subset]].sum(axis=1)).all()


TEXTS = ["", None, "a", "ab, c\nd", "one <P> two", "né 9\r\n\tx<S", "<", "<M><S", "\U0001f600 end.", "word " * 50_000, "x" * 100_000, "<S <P <M >"]


def cut_by_hand(key, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    digest = hashlib.sha256(b"1:" + (b"" if key is None else str(key).encode())).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text or ""
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_middles_equal_cuts_by_hand_and_are_restored(spark):
    rows = [(k, t, "s") for k in (None, *range(40)) for t in TEXTS]
    made = M.fill_in_middle(docs(spark, *rows)).withColumn("back", M.restored(F.col("form"), F.col("output"))).collect()
    assert len(made) == len(rows)
    for r in made:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == cut_by_hand(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_middles_of_nothing_and_of_clashing_columns(spark):
    assert M.middle_report(docs(spark)).count() == 0
    clashing = docs(spark, (1, "a b c", "s"), (1, "a b c", "s")).withColumns({"n": F.lit("x"), "form": F.lit("y"), "extra": F.lit(1)})
    made = M.fill_in_middle(clashing)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert len(set(made.collect())) == 1 and made.count() == 2
