"""N-gram Jaccard self-join of documents by chosen paths.

A document's set is that of its shingles of WORDS words; two texts are linked if their sets'
Jaccard similarity is SIMILARITY or more. Equal texts are one node from the start.

Each set is embedded as SIGNATURE min-hash tokens, which two sets share in proportion to
their similarity. Chosen paths split the nodes: a bucket is a path of sampled tokens that
all its members share. First tokens start the runs, as many runs side by side (ROOTS) as the target recall needs; a bucket
of more than SMALL members is split again on tokens that its path samples, on average
1 / SIMILARITY of them, so that a pair at the threshold stays together on some path with a
probability that falls only slowly with depth. Small buckets, and those that are still large at
depth DEPTH (in blocks of BLOCK members, each pair of blocks a task of its own), are compared
member by member on their tokens. Of two splits a pair at the threshold survives SURVIVES in the mean, so it
meets in none of the runs with probability (1 - SIMILARITY * SURVIVES) ** ROOTS even where all of its buckets
are split twice; ROOTS is the least number that keeps this below 1 - RECALL.

Pairs whose tokens agree well enough make candidate groups, passed on as one link per member to
the first of its group, never as pairs. Within a candidate group all sets are then compared
exactly, in blocks; a task gives each member's number of links and one link to its group's
first, so rows stay in proportion to members although every pair was counted. Texts become sets of hashed
shingles once, in the task that reads them; only sets of candidate groups travel, once per pair of blocks. Blocks
are bounded in members and in shingles, so that long texts don't fill a task.
"""

import math

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, join_weighed, lean_batches
from .components import components

WORDS, SIMILARITY = 5, 0.8
SIGNATURE, DEPTH, SMALL, BLOCK = 64, 3, 48, 1024
#: Share of the pairs at the threshold that are to meet in some run; how many of them two splits leave together.
RECALL, SURVIVES = 0.9999, 0.47
ROOTS = math.ceil(math.log(1 - RECALL) / math.log(1 - SIMILARITY * SURVIVES))
#: Tokens that must agree, of SIGNATURE: nearly five standard deviations below what a pair at the threshold has.
AGREE = 36
VERIFY_BLOCK, VERIFY_SHINGLES = 512, 2_000_000
MEMO = 200_000

_random = np.random.default_rng(20240229)
_MULTIPLIERS = _random.integers(0, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_STEPS = _STEP * np.arange(9, dtype=np.uint64)


class WordHashes(dict):
    """Word to its 64-bit hash, computed on first sight."""

    def __missing__(self, word: str) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return value


_words = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Hashes of the runs of `size` lower-cased words between white space, with repeats; a text of fewer words is one run, one of none has none."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > MEMO:
        _words.clear()
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    runs = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        runs = runs * _STEP + ids[k : len(runs) + k]
    return mixed(runs)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SIGNATURE mixed min-hashes of each of the sets, none of them empty."""
    out, first = np.empty((len(sets), SIGNATURE), np.uint64), 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= 65_536):
            size += len(sets[last])
            last += 1
        joined = np.concatenate(sets[first:last])
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets[first : last - 1]], dtype=np.int64))).astype(np.int64)
        for k, multiplier in enumerate(_MULTIPLIERS):
            out[first:last, k] = np.minimum.reduceat(joined * multiplier, offsets)
        first = last
    return mixed(out)


def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, digest, text) to (doc_id, digest, runs (of words), tokens, roots)."""
    for batch in batches:
        sets = [shingles(text) for text in batch["text"]]
        some = [k for k, s in enumerate(sets) if len(s)]
        tokens: list[bytes | None] = [None] * len(sets)
        roots: list[np.ndarray | None] = [None] * len(sets)
        if some:
            full = signatures([sets[k] for k in some])
            short = (full >> np.uint64(48)).astype(np.uint16)
            first = mixed(full[:, :ROOTS] + _STEP * np.arange(1, ROOTS + 1, dtype=np.uint64)).view(np.int64)
            for k, row, root in zip(some, short, first, strict=True):
                tokens[k], roots[k] = row.tobytes(), root
        yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "runs": [len(s) for s in sets], "tokens": tokens, "roots": roots})


def branches(paths: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of all children. A path alone decides which tokens it samples: a Poisson number of mean 1 / SIMILARITY, by its hash."""
    spread = mixed(paths.view(np.uint64) * _STEP + np.uint64(1))
    share = (spread >> np.uint64(11)).astype(float) / 2.0**53
    mean = 1 / SIMILARITY
    rows, children, term, reached = [], [], np.exp(-mean), np.exp(-mean)
    for k in range(1, 9):
        has = np.flatnonzero(share > reached)
        place = mixed(spread[has] + _STEPS[k])
        token = tokens[has, (place % np.uint64(SIGNATURE)).astype(np.int64)].astype(np.uint64)
        children.append(mixed((place ^ (token * _MIX)) + np.uint64(k)).view(np.int64))
        rows.append(has)
        term *= mean / k
        reached += term
    return np.concatenate(rows), np.concatenate(children)


def deeper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            tokens = np.stack([np.frombuffer(x, np.uint16) for x in batch["tokens"]])
            rows, paths = branches(batch["path"].to_numpy(np.int64), tokens)
            yield pd.DataFrame({"digest": batch["digest"].to_numpy()[rows], "path": paths})


def runs_of(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], list[int]]]:
    """Columns, and the bounds of the runs of equal keys in them, from batches in which equal keys follow each other. Every run is whole: the last one of a batch waits for the next batch."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        rows = {name: batch[name].to_numpy() for name in batch.columns}
        if held is not None:
            rows = {name: np.concatenate([held[name], rows[name]]) for name in rows}
        n = len(rows[keys[0]])
        if not n:
            continue
        new = np.zeros(n - 1, bool)
        for key in keys:
            new |= rows[key][1:] != rows[key][:-1]
        bounds = [0, *(np.flatnonzero(new) + 1).tolist()]
        if bounds[-1]:
            yield {name: values[: bounds[-1]] for name, values in rows.items()}, bounds
        held = {name: values[bounds[-1] :] for name, values in rows.items()}
    if held is not None:
        yield held, [0, len(held[keys[0]])]


def first_linked(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the least row that it is connected with."""
    label = np.arange(len(linked))
    joined = linked | np.eye(len(linked), dtype=bool)
    while True:
        least = np.where(joined, label[None, :], len(linked)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (path, part, other, digest, tokens) of buckets to links (a, b) of members to the first member of their candidate group."""
    for rows, bounds in runs_of(batches, ["path", "part", "other"]):
        tokens = np.frombuffer(b"".join(rows["tokens"]), np.uint16).reshape(-1, SIGNATURE)
        firsts, sizes = np.array(bounds[:-1]), np.diff(bounds)
        pairs = firsts[sizes == 2]
        pairs = pairs[(tokens[pairs] == tokens[pairs + 1]).sum(axis=1) >= AGREE]
        a, b = [pairs], [pairs + 1]
        for first, size in zip(firsts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = tokens[first : first + size]
            linked = np.empty((size, size), bool)
            for k in range(0, size, 64):
                linked[k : k + 64] = (own[k : k + 64, None, :] == own[None, :, :]).sum(axis=2) >= AGREE
            root = first_linked(linked)
            moved = np.flatnonzero(root != np.arange(size))
            a.append(first + moved)
            b.append(first + root[moved])
        yield pd.DataFrame({"a": rows["digest"][np.concatenate(a)], "b": rows["digest"][np.concatenate(b)]})


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets without repeats; only values in two sets or more count."""
    sizes = [len(s) for s in sets]
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = counts[place] > 1
    owner, column = owner[keep], shared[place[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    for first in range(0, int((counts > 1).sum()), width):
        a, b = np.searchsorted(column, [first, first + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        total += part @ part.T
    return total.astype(np.int64)


def shingle_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(root, size, digest, text) to (root, size, digest, shingles: the sorted set); copies of a text in one task give one row."""
    seen: set[bytes] = set()
    for batch in batches:
        new = [k for k, d in enumerate(batch["digest"]) if not (bytes(d) in seen or seen.add(bytes(d)))]
        rows = batch.iloc[new]
        yield pd.DataFrame({"root": rows["root"], "blocks": rows["blocks"], "digest": rows["digest"], "shingles": [np.unique(shingles(text)).tobytes() for text in rows["text"]]})


def verify(similarity: float):
    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (root, part, other, own, digest, shingles) of candidate groups to (digest, links, first)."""
        for rows, bounds in runs_of(batches, ["root", "part", "other"]):
            found: list[tuple[np.ndarray, ...]] = []
            for first, last in zip(bounds, bounds[1:], strict=False):
                digests, own = rows["digest"][first:last], rows["own"][first:last]
                keep = np.array(sorted({bytes(d): k for k, d in enumerate(digests)}.values()))
                digests, own = digests[keep], own[keep]
                sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"][first:last][keep]]
                size = np.array([len(s) for s in sets])
                both = intersections(sets)
                linked = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
                np.fill_diagonal(linked, False)
                if rows["part"][first] != rows["other"][first]:
                    linked &= own[:, None] != own[None, :]
                found.append((digests, linked.sum(axis=1).astype(np.int64), digests[first_linked(linked)]))
            yield pd.DataFrame(dict(zip(("digest", "links", "first"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return verified


def in_blocks(members: DataFrame, key: str, blocks: str) -> DataFrame:
    """Adds own, part and other: groups of several blocks are dealt into them, and each member goes once to each pair of blocks with its own."""
    own = members.withColumn("own", F.pmod(F.xxhash64(key, "digest"), F.col(blocks)).cast("int"))
    spread = own.withColumn("__with", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return spread.withColumns({"part": F.least("own", "__with"), "other": F.greatest("own", "__with")}).drop("__with")


def candidate_links(nodes: DataFrame) -> DataFrame:
    """nodes (digest, tokens, roots) to links (a, b) between nodes whose tokens agree, along the paths."""
    level = nodes.select("digest", F.explode("roots").alias("path"))
    finals = None
    for depth in range(1, DEPTH + 1):
        sizes = cut(level.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"))
        shared = cut(join_weighed(level, sizes, ["path"], "size"))
        done = shared if depth == DEPTH else shared.where(F.col("size") <= SMALL)
        finals = done if finals is None else finals.unionByName(done)
        if depth < DEPTH:
            large = shared.where(F.col("size") > SMALL).select("digest", "path").join(nodes.select("digest", "tokens"), ["digest"])
            level = cut(large.mapInPandas(deeper, "digest binary, path long").distinct())
    dealt = in_blocks(finals.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "path", "blocks")
    buckets = dealt.join(nodes.select("digest", "tokens"), ["digest"])
    sorted_ = buckets.select("path", "part", "other", "digest", "tokens").repartition("path", "part", "other").sortWithinPartitions("path", "part", "other", "digest")
    return sorted_.mapInPandas(agreeing, "a binary, b binary")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document row: doc_id, digest (of the text), root, class_id, n_links, n_copies.

    root: the class itself, named by the least digest of its linked texts (the text's own digest without links); null for null
    and wordless texts. class_id, which several classes may share where keys are null or repeated: the least doc_id of all documents that are linked, directly or over others, or copies of each other.
    n_links: with how many different texts a document's text is linked. n_copies: rows with the very same text.
    Null texts and texts without words are linked with nothing: each is its own class (class_id its doc_id)
    with no links and one copy. Texts of fewer than WORDS words are one shingle. Null keys take part; a
    class of null keys alone has a null class_id. Rows that repeat key and text are copies. Empty tables give none.
    similarity must not be below SIMILARITY, for which the paths are laid out.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"paths are laid out for similarities of {SIMILARITY} or more")
    spark = documents.sparkSession
    keyed = documents.select(F.col(key).alias("doc_id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("digest"), F.col(text).alias("text"))
    kind = dict(keyed.dtypes)["doc_id"]
    with lean_batches(spark):
        sketched = cut(keyed.mapInPandas(sketch, f"doc_id {kind}, digest binary, runs long, tokens binary, roots array<long>"))
        nodes = cut(sketched.where("tokens is not null").groupBy("digest").agg(
            F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.min("runs").alias("runs"), F.min("tokens").alias("tokens"), F.min("roots").alias("roots")))
        groups = components(candidate_links(nodes))
        grouped = cut(groups.withColumnRenamed("node", "digest").join(nodes.select("digest", "doc", "runs"), ["digest"]))
        sizes = cut(grouped.groupBy("root").agg(F.count("*").alias("size"), F.sum("runs").alias("runs")).select(
            "root", "size", F.ceil(F.greatest(F.col("size") / VERIFY_BLOCK, F.col("runs") / VERIFY_SHINGLES)).cast("int").alias("blocks")))
        members = cut(join_weighed(grouped.drop("runs"), sizes, ["root"], "size"))
        # By key and text: the copies of one text under many keys are spread, and only the one that stands for the text is kept.
        wanted = bounded(members.select("root", "blocks", F.col("digest").alias("__digest"), "doc"), members.count())
        texts = keyed.join(wanted, (F.col("digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("doc"))).select("root", "blocks", "digest", "text")
        sets = texts.mapInPandas(shingle_sets, "root binary, blocks int, digest binary, shingles binary")
        tasks = in_blocks(sets, "root", "blocks").select("root", "part", "other", "own", "digest", "shingles")
        ordered = tasks.repartition("root", "part", "other").sortWithinPartitions("root", "part", "other", "digest")
        compared = cut(ordered.mapInPandas(verify(similarity), "digest binary, links long, first binary"))
    links = compared.groupBy("digest").agg(F.sum("links").alias("links")).where("links > 0")
    classes = components(compared.select(F.col("digest").alias("a"), F.col("first").alias("b")))
    joined = cut(classes.withColumnRenamed("node", "digest").join(nodes.select("digest", "doc"), ["digest"]))
    least = cut(joined.groupBy("root").agg(F.min("doc").alias("class"), F.count("*").alias("size")))
    named = join_weighed(joined, least, ["root"], "size").join(links, ["digest"], "left").select("digest", "root", "class", "links")
    linked = cut(nodes.select("digest", "doc", "copies").join(named, ["digest"], "left").select(
        "digest", F.when(F.col("links").isNotNull(), F.col("root")).otherwise(F.col("digest")).alias("root"),
        F.when(F.col("links").isNotNull(), F.col("class")).otherwise(F.col("doc")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies")))
    rows = sketched.where("tokens is not null").select("doc_id", "digest")
    alone = sketched.where("tokens is null").select("doc_id", "digest", F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return join_weighed(rows, linked, ["digest"], "n_copies").select(*alone.columns).unionByName(alone)


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class stays, the one of the least key (of the least text digest among null keys); columns stay as they are.

    Of rows that repeat key and text one stays. Rows of null or wordless texts all stay.
    """
    found = cut(near_duplicates(documents, key, text, similarity))
    inside = found.where("n_links > 0 or n_copies > 1")
    best = inside.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unkeyed"), "doc_id", "digest")).alias("b")).select(
        F.col("b.doc_id").alias("__doc"), F.col("b.digest").alias("__best"))
    grouped = inside.groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.count("*").alias("rows"))
    ranked = cut(grouped.join(best, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__digest") == F.col("__best")), "left"))
    gone = ranked.where("__best is null").select("__id", "__digest")
    marked = documents.withColumn("__print", F.unhex(F.md5(F.col(text).cast("binary"))))
    same = marked[key].eqNullSafe(F.col("__id")) & (F.col("__print") == F.col("__digest"))
    kept = marked.join(bounded(gone, gone.count()), same, "left_anti")
    repeated = ranked.where("__best is not null and rows > 1").select("__id", "__digest")
    if repeated.limit(1).count():
        once = kept.join(repeated, same, "left_semi").dropDuplicates([key, "__print"])
        kept = kept.join(repeated, same, "left_anti").unionByName(once)
    return kept.drop("__print")
