"""Near duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. If two fingerprints differ in at most
two bits, one segment is equal in both (pigeonhole) and the next segment differs in at most two bits. The
Golay code (23,12,7) covers all 23-bit words by spheres of radius 3 around its codewords; two words that
differ in at most two bits have a codeword within distance 4 of both, the one nearest to the word between
them. So each fingerprint gets, for each segment, keys made of that segment and the indices of the
codewords near the next one: one or six. Fingerprints that meet under a key are joined and verified.

A key with very many different fingerprints is not joined pairwise. Its fingerprints are linked through
the words within one bit of them: two of them differ in at most two bits exactly if they share such a word,
and everyone who has the word is linked to the smallest who has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import in_tasks, written

# The generator polynomial of the binary Golay code and the segments of a fingerprint, lowest first.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))

_PIECE = 1 << 16


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low and of the high bits; for each remainder the error patterns of weight up to 4, six wide."""
    low = np.array([_remainder(x) for x in range(1 << 12)], np.int64)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int64)
    from itertools import combinations

    near: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            pattern = sum(1 << p for p in places)
            near[low[pattern & 0xFFF] ^ high[pattern >> 12]].append(pattern)
    return low, high, np.array([(x + [x[0]] * 6)[:6] for x in near], np.int64)


def near_codewords(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance 4 of 23-bit words, six columns, repeated where there is only one."""
    low, high, near = _tables()
    return (words[:, None] ^ near[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def fuzzy_keys(prints: np.ndarray) -> np.ndarray:
    """Keys of fingerprints (uint64): 18 columns, with repeats."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    keys = []
    for i, exact in enumerate(parts):
        near = near_codewords(parts[(i + 1) % 3])
        keys.append(np.int64(i) << np.int64(40) | exact[:, None] << np.int64(12) | near)
    return np.concatenate(keys, axis=1)


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit by bit the majority over the XXH64 hashes of all word shingles, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()  # of bytes: lowers A-Z only and cuts at the ASCII blanks only
    if not words:
        return 0
    n, digest, join = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, np.int64)
    for start in range(0, n, _PIECE):
        stop = min(n, start + _PIECE)
        h = np.array([digest(join(words[i: i + shingle]), seed) for i in range(start, stop)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([simhash(t.as_py()) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy()
        for at in range(0, len(prints), _PIECE):
            part = prints[at: at + _PIECE]
            keys = np.sort(fuzzy_keys(part.view(np.uint64)), axis=1)
            new = np.diff(keys, axis=1, prepend=-1) != 0
            yield pa.RecordBatch.from_pydict({"print": np.repeat(part, new.sum(axis=1)), "key": keys[new]})


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print`` of every document."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_tasks(plain, _fingerprints, "doc_id long, print long")


def links(prints: DataFrame, bits: int = 2, most: int = 32) -> DataFrame:
    """Pairs ``a, b`` that connect exactly the distinct ``print`` values that differ in at most ``bits`` bits (2).

    Keys with up to ``most`` fingerprints give all their verified pairs, the others a star for each word
    within one bit, so the work grows with the fingerprints and not with their pairs.
    """
    if bits != 2:
        raise ValueError("the keys are made for two differing bits")
    keys = written(in_tasks(prints.select("print"), _keyed, "print long, key long"), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(keys.join(sizes, "key"), "golay-shared")
    small = shared.where(F.col("size") <= most).select("key", "print")
    pairs = small.select("key", F.col("print").alias("a")).join(small.select("key", F.col("print").alias("b")), "key")
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(64)))
    around = shared.where(F.col("size") > most).select("print").distinct()
    around = around.select("print", F.explode(flips).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("word"))
    centres = around.groupBy("word").agg(F.min("print").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = around.join(centres, "word").select("a", F.col("print").alias("b")).where("a < b")
    return pairs.select("a", "b").union(stars).distinct()


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the undirected edges ``a, b``; the root is the smallest node of its component.

    Alternating stars: every node hands its larger neighbours to its smallest one, then every node hands all
    its neighbours to its smallest smaller one, until nothing changes. Each round is a written table.
    """
    big, little = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now, last = written(edges.select(big, little).where("u != v").distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
        last = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        now = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        moved = now.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(moved.union(least.select("u", "m")).distinct(), "edges")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per document: ``doc_id, print`` (the fingerprint as a signed long) and ``component_id``.

    Documents whose fingerprints differ in at most two bits are linked; ``component_id`` is the smallest
    doc_id that links reach. Null and empty texts and texts of blanks have fingerprint 0 and are linked like
    any other. Fewer words than a shingle are one shingle. Rows without doc_id take part, but give no
    component its id: it is null if no row of the component has a doc_id. Repeated rows return as they are.
    Other columns are not read. An empty table gives no rows.

    Copies have one fingerprint and are one row from here on; keys, links and components are made of
    distinct fingerprints.
    """
    prints = written(fingerprints(docs), "simhash")
    distinct = written(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = written(connected(links(distinct)), "simhash-roots")
    joined = distinct.join(roots, F.col("print") == F.col("node"), "left")
    joined = joined.select("print", "first", F.coalesce("root", "print").alias("root"))
    ids = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = joined.join(ids, "root").select("print", "component_id")
    return prints.join(labels, "print", "left").select("doc_id", "print", "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id.

    Rows that repeat a doc_id are one document, of which one row stays. Rows without doc_id all stay.
    """
    found = near_duplicates(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_anti")
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
