"""Small cases of the training-data operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.llm import decontamination, jaccard_join, language_id, media, mixing, quality, recurrent_lm, sharding, token_counts, url_filters
from cueloom.llm.components import components
from cueloom.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000


def docs(spark, *rows):
    """Rows (doc_id, text[, lang[, source]])."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 7) for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, copies, repeated ids and rows."""
    return docs(spark, (1, "one two three four five six"), (2, None, None, None), (3, ""), (4, LONG), (5, "one two three four five six"), (None, "null key"), (1, "one two three four five six"), (1, "other text"), (6, "!!! 123"), (None, None))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE_SQL[name])


# --- sharding


@pytest.mark.parametrize("rows", [0, 1, 7, 8, 1000])
def test_shards_are_even_and_slots_gapless(spark, rows):
    placed = sharding.shard_rows(spark.range(rows).withColumnRenamed("id", "doc_id"), "doc_id").collect()
    by = Counter(r["shard"] for r in placed)
    assert len(placed) == rows and (rows < 8 or max(by.values()) - min(by.values()) <= 1)
    for shard in by:
        assert sorted(r["slot"] for r in placed if r["shard"] == shard) == list(range(by[shard]))


def test_shards_of_odd_rows(spark, odd):
    clashing = odd.withColumns({"shard": F.lit("x"), "slot": F.lit("y"), "shards": F.lit(1)})
    placed = sharding.shard_rows(clashing, "doc_id")
    assert placed.count() == odd.count() and placed.columns[-3:] == ["shard", "slot", "moved"] and "shards" in placed.columns


def walked_by_hand(cells, shards, epsilon, virtual_nodes):
    """The same ring, a row at a time: first all rows to their own points while there is room, then the rest clockwise, cell by cell."""
    points = sharding.ring_points(shards, virtual_nodes)
    free, taken = sharding.capacities(sum(cells.values()), shards, epsilon), Counter()
    own = {c: next((k for k, p in enumerate(points) if p[0] >= c), 0) for c in cells}
    left = {}
    for c in sorted(cells):
        shard = points[own[c]][2]
        here = min(cells[c], free[shard])
        free[shard] -= here
        taken[c, shard] += here
        left[c] = cells[c] - here
    for c in sorted(cells):
        for _ in range(left[c]):
            k = own[c]
            while not free[points[k][2]]:
                k = (k + 1) % len(points)
            free[points[k][2]] -= 1
            taken[c, points[k][2]] += 1
    return {k: n for k, n in taken.items() if n}


@pytest.mark.parametrize(("shards", "epsilon"), [(1, 0.0), (3, 0.0), (8, 0.25), (50, 0.0), (50, 0.01)])
def test_plan_equals_a_walk_by_hand(shards, epsilon):
    rng = np.random.default_rng(shards)
    cells = {int(c): int(n) for c, n in zip(rng.choice(sharding.RING_CELLS, 150, replace=False), rng.integers(1, 30, 150), strict=True)} | {7: 900}
    got = Counter()
    for cell, first, last, shard, _, _ in sharding.plan_moves(cells, shards, epsilon, 16):
        got[cell, shard] += last - first + 1
    assert got == walked_by_hand(cells, shards, epsilon, 16)


def test_plan_for_many_shards_is_quick():
    import time

    began = time.time()
    moves = sharding.plan_moves(dict.fromkeys(range(0, sharding.RING_CELLS, 4), 5), 2000, 0.0, 32)
    assert sum(m[2] - m[1] + 1 for m in moves) == 5 * sharding.RING_CELLS // 4 and time.time() - began < 20


def test_shard_values(spark, odd):
    rows = {(r["doc_id"], r["text_crc32"]): r for r in sharding.shard_documents(odd).collect()}
    for r in odd.collect():
        data = (r["text"] or "").encode()
        assert rows[r["doc_id"], zlib.crc32(data)]["size"] == len(data) + 1
    first, again = (sorted(map(repr, sharding.shard_documents(odd).collect())) for _ in range(2))
    assert first == again


def test_repeated_keys_are_numbered_in_parts(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.col("id").alias("n"))
    placed = sharding.shard_rows(rows, "doc_id").collect()
    assert len({r["n"] for r in placed}) == len(placed) == 3000
    for shard in range(8):
        assert sorted(r["slot"] for r in placed if r["shard"] == shard) == list(range(375))


def test_plan_moves_few_rows_and_keeps_to_capacity():
    cells = {c: 3 for c in range(0, sharding.RING_CELLS, 16)}
    loose = sharding.plan_moves(cells, 8, 0.25, sharding.VIRTUAL_NODES)
    held = Counter()
    for _, first, last, shard, slot, _ in loose:
        assert slot == held[shard]
        held[shard] += last - first + 1
    total = sum(cells.values())
    assert sum(held.values()) == total and max(held.values()) <= sharding.capacities(total, 8, 0.25)[0]
    assert sum(last - first + 1 for _, first, last, _, _, step in loose if step) < 0.2 * total


# --- near-duplicates


def brute_links(texts):
    sets = [set(jaccard_join.shingles(t).tolist()) for t in texts]
    n = [0] * len(sets)
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                n[i] += 1
                n[j] += 1
    return n


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    bases = [[f"w{x}" for x in rng.integers(0, 5000, 200)] for _ in range(6)]
    texts = []
    for base in bases:
        for _ in range(25):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 8)):
                words[at] = f"v{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
    texts = list(dict.fromkeys(texts))
    found = {r["doc_id"]: r for r in jaccard_join.near_duplicates(docs(spark, *enumerate(texts))).collect()}
    assert [found[k]["n_links"] for k in range(len(texts))] == brute_links(texts)


def test_isolated_pairs_are_found(spark):
    """Pairs a little above the threshold, each alone: no third text helps to find them."""
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(400):
        base = [f"w{x}" for x in rng.integers(0, 10**7, 104)]  # 100 shingles; one changed word among the first or last few leaves 90 or more of 110
        other = list(base)
        other[10] = "x"
        texts += [" ".join(base), " ".join([*other[:50], "y", *other[51:]])]
    sets = [set(jaccard_join.shingles(t).tolist()) for t in texts]
    near = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert min(near) == max(near) == pytest.approx(90 / 110)
    found = jaccard_join.near_duplicates(docs(spark, *enumerate(texts))).where("n_links = 1").count()
    assert found == len(texts)


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    for name, size in (("SMALL", 4), ("BLOCK", 8), ("VERIFY_BLOCK", 8)):
        monkeypatch.setattr(jaccard_join, name, size)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(0, 300, 10)]
    rows = jaccard_join.near_duplicates(docs(spark, *enumerate(texts))).collect()
    assert {r["class_id"] for r in rows} == {0} and [r["n_links"] for r in sorted(rows, key=lambda r: r["doc_id"])] == brute_links(texts)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = jaccard_join.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {(r["class_id"], r["n_copies"]) for r in rows if r["doc_id"] in (2, 3)} == {(2, 1), (3, 1)}
    assert {r["class_id"] for r in rows if r["n_copies"] == 3} == {1}
    assert jaccard_join.near_duplicates(none).count() == 0
    with pytest.raises(ValueError, match="similarities"):
        jaccard_join.near_duplicates(odd, similarity=0.5)


def test_one_of_each_group_stays(spark, odd):
    kept = jaccard_join.keep_one(odd.withColumns({"tokens": F.lit(1), "digest": F.lit(2)}))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 1, 2, 3, 4, 6, None, None])


def test_one_of_each_class_stays_under_null_and_repeated_keys(spark):
    base = [f"w{k}" for k in range(300)]
    near = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in (0, 10)]
    rows = [(None, "text a"), (None, "text a"), (None, "text b"), (None, "text b"), (None, near[0]), (None, near[1]), (1, "text c"), (2, "text c"), (1, "text d"), (3, "text d"), (4, "text e"), (None, "text e")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs(spark, *rows)).collect()]
    assert Counter("near" if t in near else t for _, t in kept) == Counter(["text a", "text b", "text c", "text d", "text e", "near"])
    assert {k for k, t in kept if t in ("text c", "text d")} == {1} and (4, "text e") in kept


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (3, 3), (5, None), *[(k, k + 1) for k in range(20, 60)]], "a long, b long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | dict.fromkeys(range(20, 61), 20)
    with pytest.raises(RuntimeError, match="not settled after 2 rounds"):
        components(edges, rounds=2)


def test_weighed_join_equals_a_join(spark):
    from cueloom.llm.common import join_weighed

    rows = spark.range(5000).select(F.when(F.col("id") < 3000, F.lit(1)).when(F.col("id") < 3010, F.lit(None)).otherwise(F.col("id")).alias("k"), "id")
    side = rows.where("k is not null and k % 7 <> 3").groupBy("k").agg(F.count("*").alias("w"), F.max("id").alias("m"))
    for how in ("inner", "left"):
        assert sorted(map(repr, join_weighed(rows, side, ["k"], "w", how).collect())) == sorted(map(repr, rows.join(side, ["k"], how).collect()))


# --- mixing


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 200))), "en", "abc"[k % 3] if k % 10 else None) for k in range(600)]
    mixed = mixing.mix(docs(spark, *rows)).collect()
    by = {}
    for r in mixed:
        assert 0 <= r["copies"] <= 2
        got, target = by.get(r["source"], (0, 0))
        by[r["source"]] = (got + r["copies"] * r["size"], r["target"])
    for got, target in by.values():
        assert abs(got - target) <= 2
    assert abs(sum(t for _, t in by.values()) - 1.5 * sum(r["size"] for r in mixed)) < 1e-6


def test_targets_stop_at_twice_the_size(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 10, 1), (None, 500, 1)], "source string, size long, n long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert found["a"] == 20 and found[None] == 1000 and found["c"] == 20 and found["b"] == pytest.approx(1.5 * 1520 - 1040)


def test_targets_and_rates_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    names = [f"h{k:03}" for k in range(60)] + [None]
    docs_ = [(name, int(size)) for name in names for size in rng.integers(1, 3000 if name == "h007" else 60, rng.integers(1, 12))]
    sizes = spark.createDataFrame([(a, b, n) for (a, b), n in Counter(docs_).items()], "source string, size long, n long")
    total = {name: sum(b for a, b in docs_ if a == name) for name in names}
    weight = {name: mixing.WEIGHTS[k % 3] for k, name in enumerate(names)}
    want, open_ = {}, list(names)
    while open_:
        level = (1.5 * sum(total.values()) - sum(want.values())) / sum(weight[n] for n in open_)
        full = [n for n in open_ if level * weight[n] >= 2 * total[n]]
        if not full:
            want |= {n: level * weight[n] for n in open_}
            break
        want |= {n: 2.0 * total[n] for n in full}
        open_ = [n for n in open_ if n not in full]
    targets = mixing.source_targets(sizes)
    for r in mixing.balance(sizes, targets).collect():
        assert r["target"] == pytest.approx(want[r["source"]])
        if r["multiplier"] is not None:
            own = [b for a, b in docs_ if a == r["source"]]
            mean = sum(own) / len(own)
            assert sum(2 * b / (1 + np.exp(-r["multiplier"] * b / mean)) for b in own) == pytest.approx(want[r["source"]])
    with pytest.raises(RuntimeError, match="not settled"):
        mixing.balance(sizes, targets, steps=1)


def test_mix_of_odd_rows(spark, odd, none):
    first, again = (sorted(map(tuple, mixing.mix(odd).select("doc_id", "source", "size", "copies").collect()), key=repr) for _ in range(2))
    assert len(first) == odd.count() and first == again
    assert mixing.mix(none).count() == 0
    clashing = odd.withColumns({"size": F.lit("x"), "copies": F.lit("y"), "rate": F.lit("z")})
    assert mixing.mixed_documents(clashing).count() == sum(r[3] for r in first)


# --- language model


def corpus_of(spark, n=60):
    rng = np.random.default_rng(1)
    return docs(spark, *[(k, " ".join(rng.choice(["the", "cat", "sat", f"rare{k}"], 30, p=[0.5, 0.2, 0.2, 0.1]))) for k in range(n)], (100, None), (101, "Unseen WORDS the"), (102, LONG))


def test_lm_counts_and_base_scores(spark, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "HEAD", 3)
    rows = corpus_of(spark).collect()
    held = lambda k: zlib.crc32(str(k).encode()) % 10 == 0
    tokens = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), None] for r in rows}
    counts = Counter(t for k, ts in tokens.items() if not held(k) for t in ts)
    n, v = sum(counts.values()), len(counts)
    for r in recurrent_lm.lm_report(corpus_of(spark)).collect():
        ts = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(counts[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
        assert r["score"] < 0


def likelihood_by_hand(p, lex, ids):
    """ln P of one text, a token at a time: one state, one sigmoid, one softmax after the other."""
    size, total, state, before = p["u"].shape[0], 0.0, np.zeros(p["u"].shape[0]), lex.end
    for token in ids:
        own, by_state = p["x"][before].astype(float), p["u"].astype(float)
        z, r = (1 / (1 + np.exp(-(own[k * size : (k + 1) * size] + state @ by_state[:, k * size : (k + 1) * size]))) for k in (0, 1))
        candidate = np.tanh(own[2 * size :] + r * (state @ by_state[:, 2 * size :]))
        state = z * state + (1 - z) * candidate
        scores = state @ p["wc"] + p["bc"]
        c = lex.class_of[token]
        total += scores[c] - np.log(np.exp(scores).sum())
        if token < lex.m:
            first, last = lex.first[c], lex.first[c + 1]
            words = state @ p["ww"][:, first:last] + p["bw"][first:last]
            total += words[token - first] - np.log(np.exp(words).sum())
        before = token
    return total


def test_lm_scores_equal_a_plain_recurrence():
    lex, rng = lexicon(), np.random.default_rng(4)
    p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in recurrent_lm.initial(lex).items()}
    texts = [rng.integers(0, lex.end, n).astype(np.uint16) for n in (0, 1, 5, 130)]
    texts = [np.append(t, np.uint16(lex.end)) for t in texts]
    assert recurrent_lm.log_likelihoods(p, lex, texts) == pytest.approx([likelihood_by_hand(p, lex, t) for t in texts], rel=1e-4)


def test_lm_is_alike_however_the_table_is_cut(spark, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "TRAINER_TOKENS", 400)
    rows = [(k, f"{'a b c d e f g h'[: 2 * (k % 7) + 1]} word{k % 5} the end of it {k % 3}") for k in range(300)] + [(7, "a b c")] * 40 + [(None, None)] * 3
    made = []
    for parts in (1, 7):
        frame = docs(spark, *rows).repartition(parts).orderBy(F.rand(parts)) if parts > 1 else docs(spark, *rows).coalesce(1)
        made.append(sorted((tuple(r) for r in recurrent_lm.lm_report(frame).collect()), key=repr))
    assert [r[:5] for r in made[0]] == [r[:5] for r in made[1]]
    # Training is the same; texts are scored side by side with others, which rounds single precision otherwise.
    assert np.array([r[5:] for r in made[0]]) == pytest.approx(np.array([r[5:] for r in made[1]]), rel=1e-6)


def test_lm_vocabulary_grows_with_the_corpus():
    sizes = [recurrent_lm.vocabulary_of(10**k) for k in range(0, 16)]
    assert sizes[:8] == [recurrent_lm.LEAST_WORDS] * 8 and sizes == sorted(sizes) and recurrent_lm.vocabulary_of(10**10) == 12_500 and sizes[-1] == recurrent_lm.MOST_WORDS
    assert recurrent_lm.classes_of(1_500) == 32


def lexicon():
    head = [(b"a", 50), (b"b", 30), (b"c", 10), (b"d", 5), (b"e", 2)]
    return recurrent_lm.Lexicon(head, ends=10, total=120, distinct=12, vocabulary=3, classes=2)


def test_lm_probabilities_sum_to_one():
    lex, states = lexicon(), np.random.default_rng(0).normal(size=(4, recurrent_lm.HIDDEN)).astype(np.float32)
    p = recurrent_lm.initial(lex)
    p["wc"] += 0.3
    p["ww"] += np.random.default_rng(1).normal(size=p["ww"].shape).astype(np.float32)
    total = sum(np.exp(recurrent_lm.outputs(p, lex, states, np.full(4, t))[0]) for t in range(lex.end + 1))
    assert total == pytest.approx(np.ones(4), abs=1e-5)
    # and within the bands: known words, and all words out of the head with the unknown one
    inside = sum(10 ** lex.in_band[k] for k in range(lex.m, 5)) + ((120 - 10 - 97) + 0.1 * (12 - 1 - 5 + 1)) / lex.band_mass[-1]
    assert inside == pytest.approx(len(set(lex.ids[lex.m :])) + 1)


def test_lm_gradients_and_state_across_windows():
    lex = lexicon()
    p = {k: v.astype(np.float64) for k, v in recurrent_lm.initial(lex).items()}
    texts = [lex.encode(t)[0] for t in ("a b c d e zz a a", "b b", "", "c a d")]
    s = recurrent_lm.Streams(recurrent_lm.pieces_of(texts, lex), 2)
    part = slice(0, int(s.sizes.min()))
    window = s.inputs[part], s.targets[part], s.fresh[part].astype(float), np.zeros((2, recurrent_lm.HIDDEN))
    grads = recurrent_lm.gradients(p, lex, *window)[0]
    for k in p:
        at = np.unravel_index(np.abs(grads[k]).argmax(), p[k].shape)
        moved = []
        for e in (1e-5, -1e-5):
            q = {n: v.copy() for n, v in p.items()}
            q[k][at] += e
            moved.append(recurrent_lm.gradients(q, lex, *window)[2])
        assert grads[k][at] == pytest.approx((moved[0] - moved[1]) / 2e-5, rel=1e-4, abs=1e-7)
    inputs, targets, fresh, sizes = recurrent_lm.even_lanes(texts, lex, 2)
    assert sizes.tolist() == [9, 8] and [*targets[:, 0], *targets[:8, 1]] == [t for text in texts for t in text]
    assert fresh[:, 0].tolist() == [0, *[1] * 8] and fresh[:8, 1].tolist() == [0, 1, 1, 0, 0, 1, 1, 1]  # the cut falls on a text's start
    whole = recurrent_lm.log_likelihoods(p, lex, texts, lanes=3, window=100)
    assert recurrent_lm.log_likelihoods(p, lex, texts, lanes=1, window=2) == pytest.approx(whole)


def test_lm_beats_its_base_on_held_out_texts(spark, sf_dir):
    rows = QUERIES["op4_recurrent_lm"](spark, sf_dir).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_lm_learns_from_all_training_texts(spark, monkeypatch):
    taught, train_ = [], recurrent_lm.trained
    monkeypatch.setattr(recurrent_lm, "trained", lambda p, lexicon_of, texts, trainers: taught.extend(r["ids"] for r in texts.collect()) or train_(p, lexicon_of, texts, trainers))
    recurrent_lm.lm_report(corpus_of(spark)).count()
    rows = corpus_of(spark).collect()
    want = Counter(len(recurrent_lm.tokens_of(r["text"])) + 1 for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 10)
    assert Counter(len(ids) // 2 for ids in taught) == want


def test_lm_learns_from_the_ends_of_lanes():
    lex = lexicon()
    p, texts = recurrent_lm.initial(lex), [lex.encode(t)[0] for t in ("a b c", "b d", "")]
    moved = recurrent_lm.train(p, lex, texts)
    assert all((moved[k] != p[k]).any() for k in ("wc", "bc"))
    s = recurrent_lm.Streams(recurrent_lm.pieces_of(texts, lex), 3)
    q = {k: v.astype(np.float64) for k, v in moved.items()}
    taken = np.arange(len(s.inputs))[:, None] < s.sizes[None, :]
    grads, _, loss = recurrent_lm.gradients(q, lex, s.inputs, s.targets, s.fresh.astype(float), np.zeros((3, recurrent_lm.HIDDEN)), taken)
    assert loss == pytest.approx(-recurrent_lm.log_likelihoods(q, lex, texts).sum(), rel=1e-4)
    alone = [recurrent_lm.gradients(q, lex, i[:, None], t[:, None], np.array([[0.0]] + [[1.0]] * (len(i) - 1)), np.zeros((1, recurrent_lm.HIDDEN)))[0] for i, t in recurrent_lm.pieces_of(texts, lex)]
    for k in q:
        assert grads[k] == pytest.approx(sum(g[k] for g in alone), abs=1e-9)


def test_lm_of_odd_rows(spark, odd, none):
    rows = recurrent_lm.lm_report(odd.withColumns({"score": F.lit("x"), "n_tokens": F.lit("y")})).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault((r["n_tokens"], r["n_known"], round(r["base_score"], 9)), []).append(r["score"])
    assert {len(v) for k, v in by.items() if k[0] == 7} == {3}  # the text that three rows hold
    assert all(max(v) - min(v) < 1e-3 for v in by.values())  # equal texts, equal values
    assert Counter(r["n_tokens"] for r in rows) == Counter([7, 7, 7, 1, 1, 1, 24001, 3, 3, 3])
    assert recurrent_lm.lm_report(none).count() == 0


# --- language identification


def test_language_accuracy(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language_id.language_report(documents).where("held_out").join(documents.select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right > 0.97


def test_language_distance_equals_brute_force():
    profiles = [("de", language_id.packed(language_id.letters_of("der die das und"))), ("en", language_id.packed(language_id.letters_of("the and of to")))]
    ranked = [(lang, [int(g) for g in dict.fromkeys(grams.tolist())]) for lang, grams in profiles]
    text = "und the der the"
    grams, counts = np.unique(language_id.packed(language_id.letters_of(text)), return_counts=True)
    own = [int(g) for g in grams[np.argsort(-counts, kind="stable")]]
    best = min((sum(abs(grams_.index(g) - k) if g in grams_ else language_id.PROFILE for k, g in enumerate(own)), lang) for lang, grams_ in ranked)
    lang, score = language_id.Matcher(ranked).predict(text)
    assert lang == best[1] and score == pytest.approx(1 - best[0] / (language_id.PROFILE * len(own)))


def test_language_of_odd_rows(spark, odd, none):
    found = {r["doc_id"]: r for r in language_id.identify(odd.withColumn("score", F.lit("x"))).where("doc_id in (2, 3, 4, 6)").collect()}
    assert [found[k]["lang_pred"] for k in (2, 3, 6)] == ["und"] * 3 and found[4]["lang_pred"] == "en" and 0 <= found[4]["score"] <= 1
    assert language_id.language_report(none).count() == 0
    clashing = odd.withColumns({"score": F.lit("x"), "lang_pred": F.lit("y")})
    kept = language_id.keep_identified(clashing)
    assert kept.columns == clashing.columns and {(r["score"], r["lang_pred"]) for r in kept.collect()} == {("x", "y")}
    assert kept.where("doc_id in (2, 3, 6)").count() == 0 and kept.where("doc_id in (1, 4, 5)").count() == 5
    foreign = odd.unionByName(docs(spark, (81, "ხვალ დილით")))  # held out, shares no n-gram with any profile
    assert language_id.keep_identified(foreign).where("doc_id = 81").count() == 0
    assert language_id.keep_identified(none).count() == 0


# --- URL filters


def test_url_filters(spark):
    day = "cast(day as date)"
    entries = spark.createDataFrame([
        ("ads", "a.com", "2024-01-05", True), ("ads", "a.com", "2024-01-10", False), ("ads", "a.com", "2024-01-20", True), ("ads", "a.com", "2024-01-20", False),
        ("bad", "x.a.com/p/q", "2024-01-01", True), ("bad", None, "2024-01-01", True), ("bad", "a.com", "2024-01-05", True), ("bad", "a.com", "2024-01-05", True),
    ], "list string, rule string, day string, active boolean").withColumn("day", F.expr(day))
    captures = spark.createDataFrame([
        (1, "https://u@X.A.com:80/p/q/r?x#y", "2024-01-07"), (2, "http://a.com", "2024-01-04"), (3, "http://a.com/", "2024-01-10"), (4, "http://ba.com", "2024-01-07"), (5, None, "2024-01-07"), (6, "http://a.com", None), (7, "x.a.com/p/qr", "2024-01-07"),
        (2, "http://a.com", "2024-01-04"),
    ], "page_id long, url string, day string").withColumn("day", F.expr(day))
    rows = url_filters.filter_captures(captures, entries, "page_id").collect()
    assert len(rows) == 8
    got = {r["page_id"]: (r["blocked"], r["n_entries"], r["lists"], r["rule"]) for r in rows}
    no = (False, 0, "", "")
    assert got == {1: (True, 3, "ads,bad", "x.a.com/p/q"), 2: no, 3: (True, 1, "bad", "a.com"), 4: no, 5: no, 6: no, 7: no}
    assert not url_filters.filter_captures(captures, entries.limit(0), "page_id").where("blocked").count()
    assert [r[0] for r in spark.createDataFrame([("http://[2001:DB8::1]:80/a",), ("http://u@h.org.:8/",)], "u string").select(url_filters.host_of(F.col("u"))).collect()] == ["[2001:db8::1]", "h.org"]


# --- quality


def test_quality_held_out(spark, sf_dir):
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality_report(documents, labels).where("held_out").join(labels, "doc_id")
    right, n = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 10 and right > 0.85


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (6, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_report(odd, labels).where("score between 0 and 1").count() == odd.count()
    assert {r["score"] for r in quality.quality_report(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_report(none, labels).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.AdditiveModel().fit(x[:3000], y[:3000])
    assert (0, 1) in {(i, j) for i, j, _ in model.pairs}
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


# --- token counts


def test_token_counts(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_counts.tokenizer_path())
    texts = ["It's  A test…\n\nof THINGS", "a<|endoftext|>b", "é é ́x", "İstanbul ΣΑΣ", "1234 $$$!!", "tab\tnbsp sep x\x1cy", "퟿😀👩‍👩‍👧"]
    rows = odd.unionByName(docs(spark, *enumerate(texts, 50)))
    cache = str(tmp_path / "cache")
    for found in (token_counts.token_report(rows, cache), token_counts.token_report(rows, cache)):
        got = {(r["doc_id"], r["n_bytes"]): r for r in found.collect()}
        for r in rows.collect():
            row = got[(r["doc_id"], len((r["text"] or "").encode()))]
            assert row["n_tokens"] == len(whole.encode(r["text"] or "", add_special_tokens=False).ids)
            assert row["over_limit"] == (row["n_tokens"] > 2048)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()
    known = token_counts.open_cache(spark, cache, token_counts.tokenizer_version(token_counts.tokenizer_path()))
    assert token_counts.misses(rows, "text", known).count() == 0
    assert token_counts.count_tokens(none.withColumn("n_tokens", F.lit("x"))).count() == 0
    half = str(tmp_path / "half")
    token_counts.fill_cache(rows.where("doc_id % 2 = 0"), half)
    first = spark.read.parquet(half).count()
    assert sorted(map(repr, token_counts.token_report(rows, half).collect())) == sorted(map(repr, token_counts.token_report(rows, cache).collect()))
    assert 0 < first < spark.read.parquet(half).count() == spark.read.parquet(cache).count()
    other = token_counts.tokenizer_path("byte_bpe_50k.json")
    assert token_counts.spans_space(other) and not token_counts.spans_space(token_counts.tokenizer_path())
    spaced = docs(spark, (1, "a  b\n\n  c"), (2, "a b c"), (3, None))
    want = {k: len(Tokenizer.from_file(other).encode(t, add_special_tokens=False).ids) for k, t in ((1, "a  b\n\n  c"), (2, "a b c"), (3, ""))}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(spaced, tokenizer=other).collect()} == want


# --- media


def test_png_round_trip():
    for size in (1, 2, 50):
        payload = np.random.default_rng(size).integers(0, 256, size * media.LINE, dtype=np.uint8).tobytes()
        png = media.encode_png(payload)
        assert media.decode_png(png).tobytes() == payload
        broken = bytearray(png)
        broken[40] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            media.decode_png(bytes(broken))
    with pytest.raises(ValueError, match="ends before"):
        media.decode_png(png[:-12])
    with pytest.raises(ValueError, match="multiple"):
        media.encode_png(b"x")


@pytest.mark.parametrize("kind", range(5))
def test_all_line_filters(kind):
    lines = np.random.default_rng(kind).integers(0, 256, (6, 24), dtype=np.int64)
    coded = np.zeros_like(lines)
    at = lambda y, x: int(lines[y, x]) if y >= 0 and x >= 0 else 0
    for y in range(6):
        for x in range(24):
            a, b, c = at(y, x - 3), at(y - 1, x), at(y - 1, x - 3)
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((abs(p - v), k, v) for k, v in enumerate((a, b, c)))[2]][kind]
            coded[y, x] = (lines[y, x] - guess) % 256
    assert (media.unfilter(np.full(6, kind), coded.astype(np.uint8), 3) == lines).all()


def test_media_of_odd_rows(spark, odd, none):
    for r, text in ((r, t["text"] or "") for t in odd.where("doc_id in (2, 3, 4)").collect() for r in media.media_report(odd.where(F.col("doc_id") == t["doc_id"])).collect()):
        payload = text.encode() + b" " * ((-len(text.encode())) % 192 if text else 192)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    kept = media.media_columns(odd.withColumns({"media": F.lit(1), "payload": F.lit(2)}))
    assert kept.columns == ["doc_id", "lang", "source", "n_chars", "media", "payload", "hash"] and kept.count() == odd.count()
    assert media.media_report(none).count() == 0


def test_similar_images_have_near_hashes():
    rng = np.random.default_rng(0)
    waves = media.cosine_basis(64, 8).T @ rng.normal(size=(8, 8)) @ media.cosine_basis(40, 8)
    a = np.repeat((128 + 100 * waves / np.abs(waves).max()).astype(np.uint8).T[:, :, None], 3, axis=2)
    b = np.clip(a.astype(int) + rng.integers(-3, 4, a.shape), 0, 255).astype(np.uint8)
    bits = lambda h: np.unpackbits(np.frombuffer(h, np.uint8))
    assert (bits(media.cosine_hash(a)) != bits(media.cosine_hash(b))).sum() <= 8


# --- decontamination


def test_contamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "two, THREE four"), (2, None), (3, "  "), (4, "lorem ipsum dolor sit amet consectetur lorem ipsum dolor sit amet"), (None, "null key"), (5, "two three four")], "item_id long, text string")
    report = decontamination.contamination_report(odd.withColumns({"items": F.lit(1), "n_hit": F.lit(2)}), items).collect()
    assert len(report) == odd.count()
    by = {(r["doc_id"], r["n_words"]): (r["n_hit"], list(r["items"])) for r in report}
    assert by[(1, 6)] == by[(5, 6)] == (3, ["1", "5"]) and by[(4, 24000)] == (23999, ["4"]) and by[(2, 0)] == by[(3, 0)] == (0, []) and by[(None, 2)] == (2, [None])  # an item without an id is an item
    assert decontamination.drop_contaminated(odd, items).where("doc_id in (4, 5)").count() == 0
    assert decontamination.drop_contaminated(odd, items.limit(0)).count() == odd.count()
    assert decontamination.contamination_report(none, items).count() == 0


def test_windows_in_blocks(spark, odd, monkeypatch):
    items = spark.createDataFrame([(k, t) for k, t in enumerate(["one two", "three four", "five six", "lorem", "text"])], "item_id long, text string")
    want = sorted(map(repr, decontamination.contamination_report(odd, items).drop("spans").collect()))
    monkeypatch.setattr(decontamination, "BLOCK", 2)
    assert sorted(map(repr, decontamination.contamination_report(odd, items).drop("spans").collect())) == want


def test_cosine_hash_equals_sums_by_hand():
    rng = np.random.default_rng(8)
    for _ in range(3):
        image = rng.integers(0, 256, (media.SIDE, media.SIDE, 1)).astype(np.uint8)
        low = []
        for u in range(media.LOW):
            for v in range(media.LOW):
                total = 0.0
                for y in range(media.SIDE):
                    for x in range(media.SIDE):
                        total += int(image[y, x, 0]) * np.cos(np.pi * (2 * y + 1) * u / (2 * media.SIDE)) * np.cos(np.pi * (2 * x + 1) * v / (2 * media.SIDE))
                low.append(total)
        bits = "".join("1" if value > np.median(low[1:]) else "0" for value in low)
        assert media.cosine_hash(image).hex() == f"{int(bits, 2):016x}"


def test_url_filters_of_odd_captures(spark):
    import datetime

    day = datetime.date(2024, 6, 1)
    rows = [(None, None, day), (1, None, day), (2, "", day), (3, "http://a.example/" + "x/" * 600, day), (3, "http://a.example/x", day), (4, "no url at all", day), (None, "http://a.example", day), (5, "http://a.example", None), (3, "http://a.example/x", day)]
    schema = "page_id long, url string, day date"
    entries = spark.createDataFrame([("ads", "a.example", datetime.date(2024, 1, 1), True), (None, "a.example", day, True)], "list string, rule string, day date, active boolean")
    clashing = spark.createDataFrame(rows, schema).withColumns({"rule": F.lit("r"), "lists": F.lit(1), "key": F.lit("k"), "fetched": F.lit(2), "n": F.lit(3)})
    found = url_filters.filter_captures(clashing, entries, "page_id").collect()
    assert len(found) == len(rows)
    assert sorted((r["page_id"], r["n_entries"]) for r in found if r["blocked"] and r["page_id"]) == [(3, 1)] * 3 and sum(r["blocked"] for r in found) == 4
    assert url_filters.filter_captures(spark.createDataFrame([], schema), entries, "page_id").count() == 0
    assert not any(r["blocked"] for r in url_filters.filter_captures(clashing, entries.limit(0), "page_id").collect())
