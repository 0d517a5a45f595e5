"""A gated recurrent language model over words, trained and applied in tasks, with exact corpus counts beside it.

Words (lower-cased, between white space, one end token per text) are counted over all training
texts. The most frequent words are the model's own, as many as vocabulary_of() gives for the corpus; all others share BANDS classes
by frequency, in which a word's probability is its smoothed share. The output softmax is
factored: first a class, then, for the model's words, the word within its class, both from the
recurrent state. All of it sums to one over every word and an unknown one, so the score
is a proper log-probability.

Texts are coded once, into two bytes a token, and stored; training and scoring read the codes.

Training is truncated backpropagation in numpy. A trainer (a task) lays its texts end to end and cuts the
whole into LANES lanes of equal length, so a text's state is carried over all of its windows (but for the
few texts that a lane's start cuts). Each trainer starts from the shared weights, works through its texts, and
returns its weights; Spark averages them block by block, ROUNDS times, MERGE trainers at a time, level by level.
All training texts are dealt to the rounds, so each is worked through once and the work grows with the corpus; biases
start at the logarithms of the shares that were counted over all training texts.

Scoring carries the state over a text's windows to its end. Words outside the HEAD most
frequent (a bound on what is broadcast) get their counts by a join.
"""

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_weighed, key_crc, lean_batches

HEAD, BANDS, HIDDEN = 131_072, 7, 24
#: The model's words: so many at least, and the more the larger the corpus; ids take two bytes, so at most MOST_WORDS (some 10^11 tokens).
LEAST_WORDS, MOST_WORDS, TOKENS_A_WORD = 1_500, 65_000, 64
SMOOTH = 0.1
WINDOW, LANES = 24, 384
#: Texts are scored side by side, so many tokens of them at a time.
SCORE_WINDOW, SCORE_LANES, SCORE_TOKENS = 48, 512, 5_000_000
ROUNDS, TRAINER_TOKENS, RATE, MERGE = 3, 2_000_000, 0.02, 64
COUNT_FLUSH = 500_000


def tokens_of(text: str | None) -> list[bytes]:
    """Words of the text, A to Z lower-cased, split at ASCII white space (the end token isn't among them)."""
    return (text or "").encode("utf-8", "replace").lower().split()


def vocabulary_of(total: int) -> int:
    """How many of the most frequent words are the model's own in a corpus of so many tokens: an eighth of their square root, as distinct words grow with it."""
    return min(MOST_WORDS, max(LEAST_WORDS, math.isqrt(total // TOKENS_A_WORD)))


def classes_of(words: int) -> int:
    """Classes of the output softmax, fewer than the words of a class, of which only one is looked into."""
    return max(1, round(0.826 * math.sqrt(words)))


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()

    def counted() -> pd.DataFrame:
        return pd.DataFrame({"word": list(counts.keys()), "n": np.fromiter(counts.values(), np.int64, len(counts))})

    for batch in batches:
        for text in batch["text"]:
            counts.update(tokens_of(text))
            if len(counts) > COUNT_FLUSH:
                yield counted()
                counts.clear()
    yield counted()


class Lexicon:
    """What is broadcast: the counts of the head words, and how they fall into the model's words, classes and bands.

    Token ids: 0..m-1 the model's words, then one id a band, then the end; as inputs, the end's id stands for the start.
    """

    def __init__(self, head: list[tuple[bytes, int]], ends: int, total: int, distinct: int, vocabulary: int | None = None, classes: int | None = None) -> None:
        self.ends, self.total, self.distinct = ends, total, distinct
        vocabulary = vocabulary_of(total) if vocabulary is None else vocabulary
        classes = classes_of(vocabulary) if classes is None else classes
        self.m = m = min(vocabulary, len(head))
        self.counts = np.array([n for _, n in head], float)
        self.place = {word: k for k, (word, _) in enumerate(head)}
        # Head words beyond the model's are dealt to all bands but the last by rank, in ever larger bands; the last is for words out of the head.
        edges = m + ((len(head) - m) * np.linspace(0, 1, BANDS)[1:] ** 2).astype(int)
        band = np.searchsorted(edges, np.arange(m, len(head)), "right")
        self.ids = np.concatenate([np.arange(m), m + np.minimum(band, BANDS - 2)]).astype(np.int32)
        self.end, self.tail = m + BANDS, m + BANDS - 1
        sums = np.bincount(self.ids[m:] - m, self.counts[m:], BANDS)
        kinds = np.bincount(self.ids[m:] - m, minlength=BANDS).astype(float)
        sums[-1] = max(0.0, total - ends - self.counts.sum())
        kinds[-1] = distinct - (ends > 0) - len(head) + 1
        self.band_mass = sums + SMOOTH * kinds
        divisor = total + SMOOTH * (distinct + 1)
        self.base_log = np.log10((self.counts + SMOOTH) / divisor)
        self.base_end, self.log_divisor = float(np.log10((ends + SMOOTH) / divisor)), float(np.log10(divisor))
        self.in_band = np.zeros(len(head))
        self.in_band[m:] = np.log10((self.counts[m:] + SMOOTH) / self.band_mass[self.ids[m:] - m])
        # The model's words are cut into classes of equal sums of square roots of counts, in order of frequency.
        share = np.cumsum(np.sqrt(self.counts[:m]))
        of_word = np.minimum((share / share[-1] * classes * 0.999999).astype(int), classes - 1) if m else np.zeros(0, int)
        _, of_word = np.unique(of_word, return_inverse=True)
        self.n_word_classes = int(of_word.max()) + 1 if m else 0
        self.n_classes = self.n_word_classes + BANDS + 1
        self.class_of = np.concatenate([of_word, self.n_word_classes + np.arange(BANDS + 1)]).astype(np.int32)
        self.first = np.searchsorted(of_word, np.arange(self.n_word_classes + 1)).astype(np.int64) if m else np.zeros(1, np.int64)
        mass = np.concatenate([self.counts[:m] + SMOOTH, self.band_mass, [ends + SMOOTH]])
        class_mass = np.bincount(self.class_of, mass, self.n_classes)
        self.class_bias = np.log(np.maximum(class_mass, 1e-30) / class_mass.sum())
        self.word_bias = np.log((self.counts[:m] + SMOOTH) / class_mass[self.class_of[:m]]) if m else np.zeros(0)

    def encode(self, text: str | None) -> tuple[np.ndarray, int, float, float, list[bytes]]:
        """Token ids with the end; head words; sums of their base log10 and in-band log10 (with the end's base); words out of the head."""
        words = tokens_of(text)
        found = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        known = found[found >= 0]
        ids = np.full(len(words) + 1, self.tail, np.uint16)
        ids[:-1][found >= 0] = self.ids[known]
        ids[-1] = self.end
        rare = [words[k] for k in np.flatnonzero(found < 0).tolist()]
        return ids, len(known), float(self.base_log[known].sum()) + self.base_end, float(self.in_band[known].sum()), rare


def initial(lexicon: Lexicon, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    start = np.zeros(3 * hidden, np.float32)
    start[:hidden] = -1.0
    return {
        "x": small(lexicon.end + 1, 3 * hidden) + start, "u": small(hidden, 3 * hidden) * np.float32(2),
        "wc": np.zeros((hidden, lexicon.n_classes), np.float32), "bc": lexicon.class_bias.astype(np.float32),
        "ww": np.zeros((hidden, lexicon.m), np.float32), "bw": lexicon.word_bias.astype(np.float32),
    }


def by_gate(weights: np.ndarray) -> np.ndarray:
    """Weights (rows, 3 * hidden) as (3, rows, hidden): update gate, reset gate, candidate. The gates' are negated, as the sigmoid needs them."""
    rows, width = weights.shape
    split = np.ascontiguousarray(weights.reshape(rows, 3, width // 3).transpose(1, 0, 2))
    split[:2] *= -1
    return split


def forward(p: dict, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
    """States of the gated unit (update and reset gates, candidate, new state) at all places, time by lane; and what the way back needs."""
    k, shape, by_state = p["u"].shape[0], inputs.shape, by_gate(p["u"])
    x = by_gate(p["x"]).take(inputs, axis=1)
    old, u, states = (np.empty((*shape, k), h.dtype) for _ in range(3))
    gates, n, fresh = x[:2], x[2], fresh[:, :, None]
    for t in range(len(inputs)):
        np.multiply(h, fresh[t], out=old[t])
        gate, candidate, h = gates[:, t], n[t], states[t]
        gate += old[t] @ by_state[:2]
        np.exp(gate, out=gate)
        gate += 1
        np.reciprocal(gate, out=gate)
        np.matmul(old[t], by_state[2], out=u[t])
        candidate += gate[1] * u[t]
        np.tanh(candidate, out=candidate)
        np.subtract(old[t], candidate, out=h)
        h *= gate[0]
        h += candidate
    return states, (old, gates, u, n)


def softmax(scores: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of columns of scores: ln of the wanted entry's probability, and the sums of the exponentials that take the place of the scores (over the sum, an exponential is a probability)."""
    scores -= scores.max(axis=0)
    out = scores[wanted, np.arange(len(wanted))]
    np.exp(scores, out=scores)
    total = scores.sum(axis=0)
    return out - np.log(total), total


def missed(scores: np.ndarray, total: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Gradient of minus ln P of the wanted entries by the scores, in the place of what softmax left there."""
    scores /= total
    scores[wanted, np.arange(len(wanted))] -= 1
    return scores


def outputs(p: dict, lexicon: Lexicon, states: np.ndarray, targets: np.ndarray, back: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """ln P(target | state) for each row; with `back`, also fills the output gradients and gives that of the states (of minus the sum).

    Rows are put in order of their class first, so that those of a class lie together.
    """
    order = np.argsort(lexicon.class_of[targets].astype(np.uint16), kind="stable")  # two bytes are sorted by radix
    states, targets = states.take(order, axis=0), targets[order]
    cls, ds = lexicon.class_of[targets], None
    scores = p["wc"].T @ states.T + p["bc"][:, None]
    out, total = softmax(scores, cls)
    if back is not None:
        e = missed(scores, total, cls)
        back["wc"], back["bc"] = (e @ states).T, e.sum(axis=1)
        back["ww"], back["bw"] = np.zeros_like(p["ww"]), np.zeros_like(p["bw"])
        ds = e.T @ p["wc"].T
    bounds = np.searchsorted(cls, np.arange(lexicon.n_word_classes + 1))
    for c in range(lexicon.n_word_classes):
        at = slice(bounds[c], bounds[c + 1])
        a, b = lexicon.first[c], lexicon.first[c + 1]
        if at.start == at.stop or b - a == 1:
            continue
        s, w, word = states[at], p["ww"][:, a:b], targets[at] - a
        scores = w.T @ s.T + p["bw"][a:b, None]
        likely, total = softmax(scores, word)
        out[at] += likely
        if back is not None:
            e = missed(scores, total, word)
            back["ww"][:, a:b], back["bw"][a:b] = (e @ s).T, e.sum(axis=1)
            ds[at] += e.T @ w.T
    back_in_place = np.empty_like(order)
    back_in_place[order] = np.arange(len(order))
    return out[back_in_place], None if ds is None else ds.take(back_in_place, axis=0)


Piece = tuple[np.ndarray, np.ndarray]


def pieces_of(texts: list[np.ndarray], lexicon: Lexicon) -> list[Piece]:
    """(inputs, targets) of each text: the tokens after the start, and the tokens to the end."""
    return [(np.concatenate(([lexicon.end], text[:-1])).astype(np.int32), text.astype(np.int32)) for text in texts]


def lanes_of(pieces: list[Piece], most: int) -> list[list[int]]:
    """Pieces dealt to at most so many lanes, the longest first, each to the shortest lane so far; the longest lane comes first."""
    import heapq

    sizes = [len(targets) for _, targets in pieces]
    lanes: list[list[int]] = [[] for _ in range(max(1, min(most, len(pieces))))]
    heap = [(0, k) for k in range(len(lanes))]
    for k in sorted(range(len(pieces)), key=lambda k: -sizes[k]):
        size, lane = heapq.heappop(heap)
        lanes[lane].append(k)
        heapq.heappush(heap, (size + sizes[k], lane))
    return sorted(lanes, key=lambda lane: -sum(sizes[k] for k in lane))


class Streams:
    """Pieces laid end to end in lanes, time by lane: inputs, targets, owner (the piece), fresh (0 where a piece starts, else 1), and each lane's length."""

    def __init__(self, pieces: list[Piece], most: int) -> None:
        lanes = lanes_of(pieces, most)
        self.sizes = np.array([sum(len(pieces[k][1]) for k in lane) for lane in lanes])
        shape = (int(self.sizes.max()), len(lanes))
        self.inputs, self.targets, self.owner = (np.zeros(shape, np.int32) for _ in range(3))
        self.fresh = np.ones(shape, np.float32)
        for j, lane in enumerate(lanes):
            at = slice(0, self.sizes[j])
            self.inputs[at, j] = np.concatenate([pieces[k][0] for k in lane])
            self.targets[at, j] = np.concatenate([pieces[k][1] for k in lane])
            lengths = [len(pieces[k][1]) for k in lane]
            self.owner[at, j] = np.repeat(lane, lengths)
            self.fresh[np.concatenate(([0], np.cumsum(lengths[:-1], dtype=np.int64))).astype(np.int64), j] = 0


def log_likelihoods(p: dict, lexicon: Lexicon, texts: list[np.ndarray], lanes: int = SCORE_LANES, window: int = SCORE_WINDOW) -> np.ndarray:
    """ln P of each whole text under the model (bands count as one word each)."""
    if not texts:
        return np.zeros(0)
    s = Streams(pieces_of(texts, lexicon), lanes)
    h = np.zeros((s.inputs.shape[1], p["u"].shape[0]), p["u"].dtype)
    total = np.zeros(len(texts))
    for first in range(0, len(s.inputs), window):
        last = min(first + window, len(s.inputs))
        live = int((s.sizes > first).sum())  # lanes are sorted by length
        at = slice(first, last), slice(0, live)
        states, _ = forward(p, s.inputs[at], s.fresh[at], h[:live])
        h, taken = states[-1], np.arange(first, last)[:, None] < s.sizes[None, :live]
        out, _ = outputs(p, lexicon, states[taken], s.targets[at][taken])
        total += np.bincount(s.owner[at][taken], out, len(texts))
    return total


def gradients(p: dict, lexicon: Lexicon, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray, taken: np.ndarray | None = None) -> tuple[dict, np.ndarray, float]:
    """Gradients of minus ln P summed over a window (time by lane), the state after it, and the sum itself. taken: the places that count, if not all; those after them in a lane must not count either."""
    k = p["u"].shape[0]
    states, (old, gates, u, n) = forward(p, inputs, fresh, h)
    back: dict[str, np.ndarray] = {}
    rows, wanted = states.reshape(-1, k), targets.ravel()
    if taken is None or taken.all():
        out, ds = outputs(p, lexicon, rows, wanted, back)
    else:
        some, ds = np.flatnonzero(taken), np.zeros_like(rows)
        out, ds[some] = outputs(p, lexicon, rows[some], wanted[some], back)
    ds = ds.reshape(states.shape)
    # What a gradient of the state is multiplied by to give those before the candidate's tanh and the gates' sigmoids.
    z, r = gates
    by_n, by_z, by_r = (1 - z) * (1 - n * n), (old - n) * z * (1 - z), u * r * (1 - r)
    dx = np.empty((3, *inputs.shape, k), h.dtype)  # by the inputs of update gate, reset gate and candidate
    dc = np.empty((*inputs.shape, k), h.dtype)  # by what the candidate takes from the state
    d, fresh = np.zeros_like(states[0]), fresh[:, :, None]
    to_z, to_r, to_c = (np.ascontiguousarray(part.T) for part in np.split(p["u"], 3, axis=1))
    for t in range(len(inputs) - 1, -1, -1):
        d += ds[t]
        dn = np.multiply(d, by_n[t], out=dx[2, t])
        dz = np.multiply(d, by_z[t], out=dx[0, t])
        dr = np.multiply(dn, by_r[t], out=dx[1, t])
        np.multiply(dn, r[t], out=dc[t])
        d *= z[t]
        d += dz @ to_z
        d += dr @ to_r
        d += dc[t] @ to_c
        d *= fresh[t]
    before = old.reshape(-1, k).T
    back["u"] = np.concatenate([before @ part.reshape(-1, k) for part in (dx[0], dx[1], dc)], axis=1)
    inputs = inputs.ravel().astype(np.uint16)  # ids have two bytes, which are sorted by radix
    order = np.argsort(inputs, kind="stable")
    used, starts = np.unique(inputs[order], return_index=True)
    back["x"] = np.zeros_like(p["x"])
    back["x"][used] = np.add.reduceat(np.concatenate([part.reshape(-1, k).take(order, axis=0) for part in dx], axis=1), starts, axis=0)
    return back, states[-1], -float(out.sum())


def even_lanes(texts: list[np.ndarray], lexicon: Lexicon, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts laid end to end and cut into lanes that differ by one place at most: inputs, targets, fresh (0 where a text or lane starts), time by lane, and the lanes' lengths, the longer ones first."""
    pieces = pieces_of(texts, lexicon)
    inputs, targets = (np.concatenate([piece[k] for piece in pieces]) for k in range(2))
    fresh = np.ones(len(inputs), np.float32)
    fresh[np.concatenate(([0], np.cumsum([len(t) for t in texts[:-1]], dtype=np.int64))).astype(np.int64)] = 0
    lanes = max(1, min(most, len(inputs)))
    sizes = np.full(lanes, len(inputs) // lanes)
    sizes[: len(inputs) % lanes] += 1
    first = np.concatenate(([0], np.cumsum(sizes[:-1])))
    place = np.minimum(first[None, :] + np.arange(sizes[0])[:, None], len(inputs) - 1)
    starts = fresh[place]
    starts[0] = 0
    return inputs[place], targets[place], starts, sizes


def train(p: dict, lexicon: Lexicon, texts: list[np.ndarray], rate: float = RATE) -> dict:
    """Weights after one pass over the texts: windows of all lanes, gradients cut at the windows' ends, steps scaled by running squares."""
    p = {k: v.copy() for k, v in p.items()}
    if not texts:
        return p
    inputs, targets, fresh, sizes = even_lanes(texts, lexicon, LANES)
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    h, n = np.zeros((len(sizes), p["u"].shape[0]), np.float32), 0
    for first in range(0, len(inputs), WINDOW):
        at = slice(first, first + WINDOW)
        taken = np.arange(first, min(first + WINDOW, len(inputs)))[:, None] < sizes[None, :]
        grads, h, _ = gradients(p, lexicon, inputs[at], targets[at], fresh[at], h, taken)
        n += 1
        count = int(taken.sum())
        for k, g in grads.items():
            g = g / np.float32(count)
            mean[k] += np.float32(0.1) * (g - mean[k])
            square[k] += np.float32(0.01) * (g * g - square[k])
            size = rate * min(1.0, n / 10) * np.sqrt(1 - 0.99**n) / (1 - 0.9**n)
            p[k] -= np.float32(size) * mean[k] / (np.sqrt(square[k]) + np.float32(1e-6))
    return p


def flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float32)


def shaped(values: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


BLOCK = 8192


def merged(parts: DataFrame, trainers: int) -> DataFrame:
    """parts (trainer, block, weight, values) to one weighted mean a block; no group holds more than MERGE rows."""

    def average(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")  # sums of floats depend on their order
        w = group["weight"].to_numpy()
        mean = (np.stack([np.frombuffer(v, np.float32) for v in group["values"]]) * (w / w.sum())[:, None]).sum(axis=0)
        return pd.DataFrame({"trainer": group["trainer"].iloc[:1], "block": group["block"].iloc[:1], "weight": [w.sum()], "values": [mean.astype(np.float32).tobytes()]})

    while True:
        trainers = -(-trainers // MERGE)
        parts = parts.withColumns({"part": F.col("trainer"), "trainer": F.col("trainer") % trainers}).groupBy("trainer", "block").applyInPandas(average, "trainer int, block int, weight double, values binary")
        if trainers == 1:
            return parts


def trained(p: dict, lexicon_of, texts: DataFrame, trainers: int) -> dict:
    """One round: texts (trainer int, key long, ids binary, copies int) are worked through by trainers, whose weights are averaged by Spark, weighted by their tokens."""
    start = flat(p)

    def work(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("key")
        coded = [np.frombuffer(ids, np.uint16) for ids, copies in zip(rows["ids"], rows["copies"], strict=True) for _ in range(copies)]
        values = flat(train(shaped(start, p), lexicon_of(), coded))
        blocks = [values[k : k + BLOCK] for k in range(0, len(values), BLOCK)]
        return pd.DataFrame({"trainer": group["trainer"].iloc[0], "block": range(len(blocks)), "weight": float(sum(map(len, coded))), "values": [b.tobytes() for b in blocks]})

    parts = texts.repartition(trainers, "trainer").groupBy("trainer").applyInPandas(work, "trainer int, block int, weight double, values binary")
    rows = merged(parts, trainers).select("block", "values").collect()
    if not rows:
        return p
    return shaped(np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(rows, key=lambda r: r["block"])]), p)


def corpus(training: DataFrame) -> tuple[DataFrame, list[tuple[bytes, int]], dict]:
    """Counts of all words of the training texts (word, n), the head of HEAD rows at most, and ends, total and distinct."""
    with lean_batches(training.sparkSession):
        counts = cut(training.mapInPandas(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    texts = training.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # The head holds all words of a count or none, as many counts as fit. There are few distinct counts (their sum is at most that of all tokens).
    least, room = None, HEAD
    for row in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(HEAD).collect():
        room -= row["words"]
        if room < 0:
            break
        least = row["n"]
    found = counts.where(F.col("n") >= least).collect() if least else []
    head = sorted(((bytes(r["word"]), r["n"]) for r in found), key=lambda x: (-x[1], x[0]))
    return counts, head, {"ends": texts, "total": sums["n"] + texts, "distinct": sums["v"] + (texts > 0)}


def coded(documents: DataFrame, lexicon_of) -> DataFrame:
    """(doc_id, taught, text) to doc_id, taught, digest, ids (two bytes a token), known, base and band (the lexicon's sums), rare (words out of the head) and times, stored."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = lexicon_of()
        for batch in batches:
            found = [lexicon.encode(text) for text in batch["text"]]
            rare = [Counter(f[4]) for f in found]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "taught": batch["taught"], "digest": batch["digest"], "ids": [f[0].tobytes() for f in found], "known": [f[1] for f in found], "base": [f[2] for f in found],
                "band": [f[3] for f in found], "rare": [list(r) for r in rare], "times": [list(r.values()) for r in rare]})

    kind = dict(documents.dtypes)["doc_id"]
    digested = documents.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    with lean_batches(documents.sparkSession):
        return cut(digested.mapInPandas(code, f"doc_id {kind}, taught boolean, digest binary, ids binary, known long, base double, band double, rare array<binary>, times array<long>"))


#: Copies of a row that one trainer takes at once.
COPIES = 16


def numbered(taught: DataFrame) -> DataFrame:
    """taught (doc_id, digest, ids) to (key, ids, copies): keys are made of what the rows hold, not of where they lie, so that any cut of the table into files gives the same training. Rows alike in all are one, COPIES at a time, as one key may hold any share of the rows."""
    pairs = taught.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    key = lambda *more: F.xxhash64(F.lit("lm"), "doc_id", "digest", *more).alias("key")
    if not pairs.where("n > 1").limit(1).count():
        return taught.select(key(F.lit(0)), "ids", F.lit(1).alias("copies"))
    alike = taught.groupBy("doc_id", "digest").agg(F.count("*").alias("n"), F.first("ids").alias("ids"))
    spread = alike.select("doc_id", "digest", "ids", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("at"))
    return spread.select(key((F.col("at") / COPIES).cast("int")), "ids", F.least(F.lit(COPIES), F.col("n") - F.col("at")).cast("int").alias("copies"))


def score_texts(documents: DataFrame, training: Column | None = None, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document row: doc_id, n_tokens, n_known, train_tokens, base_score, score; all logarithms to base 10.

    training: the rows to learn from; those whose key's CRC-32 isn't a multiple of 10 if not given. Null texts
    count as empty ones: one end token. Equal texts get equal counts and base scores, and scores equal but for
    rounding. Without training rows every word is unknown. rounds: into so many parts the training rows are dealt,
    by key and text; how the table is cut into files makes no difference.
    """
    spark = documents.sparkSession
    chosen = training if training is not None else F.pmod(key_crc(F.col(key)), F.lit(10)) != 0
    keyed = documents.select(F.col(key).alias("doc_id"), F.coalesce(chosen, F.lit(False)).alias("taught"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts, head, sums = corpus(keyed.where("taught").select("text"))
    held = spark.sparkContext.broadcast((head, sums))
    made: list[Lexicon] = []

    def lexicon_of() -> Lexicon:
        if not made:
            made.append(Lexicon(held.value[0], **held.value[1]))
        return made[0]

    weights = initial(lexicon_of())
    lexicon = lexicon_of()
    made.clear()  # what is shipped to the workers holds no lexicon
    whole = coded(keyed, lexicon_of)
    dealt = numbered(whole.where("taught").select("doc_id", "digest", "ids")).withColumn("round", F.pmod("key", F.lit(rounds)).cast("int"))
    sizes = dict(dealt.groupBy("round").agg(F.sum(F.length("ids") / 2 * F.col("copies"))).collect())
    for number in sorted(sizes):
        trainers = max(1, -(-int(sizes[number]) // TRAINER_TOKENS))
        part = dealt.where(F.col("round") == number).select(F.pmod(F.xxhash64("key"), F.lit(trainers)).cast("int").alias("trainer"), "key", "ids", "copies")
        weights = trained(weights, lexicon_of, part, trainers)
    model = spark.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, rows, waiting = lexicon_of(), [], 0

        def done() -> pd.DataFrame:
            frame = pd.concat(rows, ignore_index=True)
            texts = [np.frombuffer(ids, np.uint16) for ids in frame.pop("ids")]
            return frame.assign(n_tokens=[len(t) for t in texts], model=log_likelihoods(model.value, lexicon, texts) / np.log(10) + frame["band"])[names]

        for batch in batches:
            rows.append(batch)
            waiting += int(batch["ids"].map(len).sum()) // 2
            if waiting >= SCORE_TOKENS:
                yield done()
                rows, waiting = [], 0
        if rows:
            yield done()

    kind = dict(keyed.dtypes)["doc_id"]
    shape = f"doc_id {kind}, digest binary, n_tokens long, known long, base double, model double, rare long"
    names = ["doc_id", "digest", "n_tokens", "known", "base", "model", "rare"]
    few = whole.select("doc_id", "digest", "ids", "known", "base", "band", F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x).alias("rare"))
    likely = cut(few.mapInPandas(scored, shape))
    tails = whole.where(F.size("rare") > 0).groupBy("digest").agg(F.first(F.arrays_zip("rare", "times")).alias("r"), F.count("*").alias("texts")).select("digest", "texts", F.explode("r").alias("r")).select("digest", "texts", F.col("r.rare").alias("word"), "r.times")
    n = F.coalesce("n", F.lit(0))
    logs = tails.join(counts, ["word"], "left").groupBy("digest").agg(F.sum(F.col("times") * F.log10(n + SMOOTH)).alias("logs"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("seen"), F.first("texts").alias("texts"))
    tail_log = float(np.log10(lexicon.band_mass[-1]))
    joined = join_weighed(likely, cut(logs), ["digest"], "texts", "left")
    logs_ = F.coalesce("logs", F.lit(0.0))
    return joined.select(
        "doc_id", "n_tokens", (F.col("known") + int(lexicon.ends > 0) + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(sums["total"]).cast("long").alias("train_tokens"),
        (F.col("base") + logs_ - F.col("rare") * lexicon.log_divisor).alias("base_score"), (F.col("model") + logs_ - F.col("rare") * tail_log).alias("score"),
    )


def lm_report(documents: DataFrame) -> DataFrame:
    scored = score_texts(documents)
    return scored.select("doc_id", (F.pmod(key_crc(F.col("doc_id")), F.lit(10)) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
