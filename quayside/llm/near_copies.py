"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least a threshold.

Candidates come from SimHash fingerprints of the shingles first: texts with equal ones, and those that meet
under a Golay key with two or fewer differing bits. As texts at 0.8 mostly differ in some ten bits, candidates are
also texts that share one of ``BANDS`` keys, each made of ``ROWS`` minimum hashes of the shingles; at a similarity
of 0.8 a pair shares none with a chance of 0.00035, and less above. Candidates are compared shingle by shingle. What is wanted are the groups that links connect, so of a key with many texts not every
pair is compared: texts that are linked already are one group, and only pairs between groups are open. In
each round the groups of a key are put into a random order and neighbours are compared (a chain has no hot
row, and long ones are cut into blocks), which joins dense groups quickly. When a round finds nothing new,
all pairs that are still open are compared, so no link between two texts that share a key is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import in_tasks, written
from quayside.llm.golay_simhash import connected, links, simhash

BANDS, ROWS = 20, 5
#: Keys with up to so many texts give all their pairs at once.
SMALL = 8
#: Groups in one stretch of a chain, and rows of a block when all open pairs are made.
BLOCK = 1000
#: Rounds of chains before the open pairs are all compared.
ROUNDS = 6

_MIX = np.uint64(0xD6E8FEB86659FD93)
_draw = np.random.default_rng(20)
_XOR = _draw.integers(0, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2)
_TIMES = _draw.integers(0, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Words cut and lowered as for SimHash."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, size: int) -> set[bytes]:
    """The distinct shingles of a text's words; fewer words are one shingle."""
    words = words_of(text)
    return {b" ".join(words[i: i + size]) for i in range(max(1, len(words) - size + 1))}


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles, made of the words' hashes."""
    words = words_of(text)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    found = np.full(n, len(h) < size, np.uint64)
    for k in range(min(size, len(h))):
        found = (found ^ (found >> np.uint64(29))) * _MIX + (h[k: k + n] if len(h) >= size else h[k: k + 1])
    return np.unique((found ^ (found >> np.uint64(32))) * _MIX)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[at: at + 1024, None] ^ _XOR) * _TIMES).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ (keys >> np.uint64(31))) * _MIX + column
    return (keys ^ (keys >> np.uint64(32))) * _MIX


def _signed(size: int) -> Callable:
    """``node`` stands for the set of shingles, ``n`` is its size, ``print`` its SimHash, ``keys`` are its bands' keys."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints, keys = [], [], [], []
            for value in batch.column(2):
                text = value.as_py()
                hashes = shingle_hashes(text, size)
                prints.append(simhash(text, size))
                nodes.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
                sizes.append(len(hashes))
                keys.append(band_keys(hashes).view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())),
            ], ["doc_id", "version", "node", "n", "print", "keys"])

    return made


def _alike(size: int, similarity: float) -> Callable:
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, set()
        for batch in batches:
            good = []
            for a, left, right in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:  # pairs of one text mostly come together
                    last, x = a, shingles(left.as_py(), size)
                y = shingles(right.as_py(), size)
                common = len(x & y)
                good.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])

    return kept


def _ordered(pairs: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs ``a < b`` whose sizes allow the similarity."""
    pairs = pairs.where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity - 1e-6)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def all_pairs(members: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b`` for all pairs of a key (``key, node, n, root, size``) with different roots.

    Keys of many rows are cut into blocks, and a task joins two blocks.
    """
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.pmod(F.xxhash64("node", F.lit("block")), blocks)
    left = members.select("key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"), own.alias("own"), blocks.alias("blocks"))
    left = left.select("*", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("other"))
    right = members.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"), own.alias("other"))
    right = right.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other"))).alias("own"))
    pairs = left.join(right, ["key", "own", "other"]).where("root_a != root_b and (own < other or a < b)")
    return pairs.select("a", "n_a", "b", "n_b")


def chained(members: DataFrame, number: int) -> DataFrame:
    """``a, n_a, b, n_b``: one text of every root of a key next to one of another root, in the order of draw ``number``."""
    drawn = members.groupBy("key", "root").agg(F.min(F.struct(F.xxhash64(F.lit(number), "node"), "node", "n")).alias("text"))
    sizes = drawn.groupBy("key").agg(F.count("*").alias("roots")).where("roots > 1")
    stretch = F.pmod(F.xxhash64(F.lit(number), "root"), F.ceil(F.col("roots") / BLOCK))
    drawn = drawn.join(sizes, "key").select("key", stretch.alias("stretch"), "text.node", "text.n")
    order = Window.partitionBy("key", "stretch").orderBy(F.xxhash64(F.lit(-number - 1), "node"))
    drawn = drawn.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.lag(F.struct("node", "n")).over(order).alias("before"))
    return drawn.where("before is not null").select("a", "n_a", F.col("before.node").alias("b"), F.col("before.n").alias("n_b"))


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: texts (``node, n, print``) of equal fingerprints in chains, and the smallest of two linked ones."""
    equal = chained(nodes.select(F.col("print").alias("key"), "node", "n", F.col("node").alias("root")), 0)
    firsts = written(nodes.groupBy("print").agg(F.min(F.struct("node", "n")).alias("first")), "golay-firsts")
    found = links(firsts)
    for side in ("a", "b"):
        found = found.join(firsts.select(F.col("print").alias(side), F.col("first").alias(f"first_{side}")), side)
    found = found.select(F.col("first_a.node").alias("a"), F.col("first_a.n").alias("n_a"), F.col("first_b.node").alias("b"), F.col("first_b.n").alias("n_b"))
    return equal.union(found)


def roots_of_copies(members: DataFrame, texts: DataFrame, size: int, similarity: float, known: DataFrame) -> DataFrame | None:
    """``member, root`` of every linked text; None without any link.

    ``members`` are rows ``key, node, n, size`` (texts of the key), ``texts`` rows ``node, text``; ``known`` are pairs
    ``a, n_a, b, n_b`` to be compared as well, in the first round.
    """
    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(_ordered(pairs, similarity), "copy-candidates")
        for side in ("b", "a"):
            pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
        return written(in_tasks(pairs.select("a", "b", "text_a", "text_b"), _alike(size, similarity), "a long, b long"), "copy-links")

    def joined(roots: DataFrame | None, edges: DataFrame) -> DataFrame:
        if roots is not None:
            edges = edges.union(roots.select("member", "root"))
        return written(connected(edges), "copy-roots").withColumnRenamed("node", "member")

    def labelled(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(roots, F.col("node") == F.col("member"), "left").withColumn("root", F.coalesce("root", "node")).drop("member")

    roots = None
    large = members.where(F.col("size") > SMALL)
    for number in range(ROUNDS):
        rows = written(labelled(large), "copy-members")
        pairs = chained(rows, number)
        if number == 0:
            pairs = pairs.union(all_pairs(labelled(members.where(F.col("size") <= SMALL)))).union(known)
        edges = verified(pairs)
        if edges.isEmpty():
            break
        roots = joined(roots, edges)
    rows = written(labelled(large), "copy-members")
    several = rows.groupBy("key").agg(F.count_distinct("root").alias("roots")).where("roots > 1").select("key")
    edges = verified(all_pairs(rows.join(several, "key")))
    return roots if edges.isEmpty() else joined(roots, edges)


def groups_of_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """A row per row of ``docs``: ``doc_id, version`` (the text's hash) and ``root``, equal for linked texts.

    Null and empty texts and texts of blanks are equal; texts of fewer words than ``size`` are like others only
    if their words are the same. Null and repeated ids make no difference; an empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text"))
    sets = written(in_tasks(plain, _signed(size), "doc_id long, version long, node long, n long, print long, keys array<long>"), "shingle-sets")
    unique = sets.dropDuplicates(["node"]).select("node", "version", "n", F.explode("keys").alias("key"))
    unique = written(unique, "shingle-keys")
    sizes = unique.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(unique.join(sizes, "key"), "copy-keys")
    nodes = written(sets.select("node", "version", "n", "print").dropDuplicates(["node"]), "copy-nodes")
    known = written(simhash_pairs(nodes.select("node", "n", "print")), "golay-pairs")
    near = nodes.join(known.select(F.col("a").alias("node")).union(known.select("b")), "node", "left_semi")
    meeting = members.select("node", "version").union(near.select("node", "version")).distinct()
    texts = written(plain.join(meeting, "version").select("node", "text").dropDuplicates(["node"]), "copy-texts")
    roots = roots_of_copies(members.select("key", "node", "n", "size"), texts, size, similarity, known)
    if roots is None:
        return sets.select("doc_id", "version", F.col("node").alias("root"))
    joined = sets.join(roots, F.col("node") == F.col("member"), "left")
    return joined.select("doc_id", "version", F.coalesce("root", "node").alias("root"))


def without_near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of texts that links of ``similarity`` connect.

    It is the row with the smallest doc_id; null comes after all others, and texts of one doc_id follow in the
    order of their hashes. Rows equal in both are one. Null and empty texts and texts of blanks are equal.
    """
    found = written(groups_of_copies(docs, size, similarity), "copy-groups")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version")
    first = found.groupBy("root").agg(F.min(row).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    gone = found.join(first, "root").where(row != F.col("first")).select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version")).distinct()
    name = "version"
    while name in docs.columns:
        name += "_"
    kept = docs.withColumn(name, F.xxhash64("text"))
    kept = kept.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (F.col(name) == F.col("gone_version")), "left_anti")
    return kept.dropDuplicates(["doc_id", name]).drop(name)
