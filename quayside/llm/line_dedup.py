"""Line deduplication by a sharded minimal perfect hash.

Distinct line keys are counted once per document in Spark and dealt to shards by their hash. Each shard gets
a minimal perfect hash: levels of bit arrays, where a key that is alone at its place in a level takes that
place and all others go on to the next level; the number of ones before a place is the key's index. The
index points into compact arrays of fingerprints, counts and first documents. Documents send the hashes of
their lines past the arrays; no two tables of lines are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import BLANKS, ascii_lower, in_tasks, written

_NO_ID = -(2**63)  # stands for a null doc_id: one document before all others
_LOAD = 2  # places per key in a level
_HOT = 4  # a shard's probes are dealt to more tasks beyond so many times its keys

INDEX = "shard int, keys int, sizes binary, bits binary, ranks binary, prints binary, counts binary, firsts binary, salts int"


def _mixed(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of the 128-bit keys for each level."""
    x = lo ^ (hi * np.uint64(2 * level + 1)) ^ np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys (two uint64 arrays)."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.sizes, self.bits, self.ranks = sizes, bits, ranks

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(hi):
            size = -(-len(hi) * _LOAD // 64) * 64
            place = _mixed(hi, lo, len(sizes)) % np.uint64(size)
            taken = np.bincount(place.astype(np.int64), minlength=size)
            levels.append(taken == 1)
            sizes.append(size)
            rest = taken[place] != 1
            hi, lo = hi[rest], lo[rest]
            if len(sizes) > 200:
                raise ValueError("the keys of a shard are not distinct")
        flags = np.concatenate(levels) if levels else np.zeros(0, bool)
        ones = flags.reshape(-1, 64).sum(axis=1)
        return cls(np.array(sizes, np.int64), np.packbits(flags, bitorder="little"), np.concatenate([[0], np.cumsum(ones)]).astype(np.int64))

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The index of each key; -1 for some keys that are not in the set, any index for the others."""
        found, open_, start = np.full(len(hi), -1, np.int64), np.arange(len(hi)), 0
        words = self.bits.view("<u8")
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            place = (_mixed(hi[open_], lo[open_], level) % np.uint64(size)).astype(np.int64) + start
            word, bit = words[place >> 6], (place & 63).astype(np.uint64)
            here = ((word >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[open_[here]] = (self.ranks[place >> 6] + below)[here]
            open_, start = open_[~here], start + int(size)
        return found


def _prints(hi: np.ndarray) -> np.ndarray:
    return (hi & np.uint64(0xFFFF)).astype(np.uint16)


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _built(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).combine_chunks()
    hi, lo = (_unsigned(table[c].chunk(0)) for c in ("hi", "lo"))
    count, first = (table[c].to_numpy() for c in ("documents", "first"))
    perfect = PerfectHash.of(hi, lo)
    at = perfect.index(hi, lo)
    prints, counts, firsts = np.zeros(len(hi), np.uint16), np.zeros(len(hi), np.uint8), np.zeros(len(hi), np.int64)
    prints[at], counts[at], firsts[at] = _prints(hi), np.minimum(count, 255), first
    return pa.RecordBatch.from_pydict({
        "shard": pa.array([shard], pa.int32()), "keys": pa.array([len(hi)], pa.int32()),
        **{k: pa.array([v.tobytes()], pa.binary()) for k, v in (
            ("sizes", perfect.sizes), ("bits", perfect.bits), ("ranks", perfect.ranks),
            ("prints", prints), ("counts", counts), ("firsts", firsts))},
        "salts": pa.array([1 + int(count.sum()) // (_HOT * len(hi) + 1000)], pa.int32()),
    })


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; one shard is held at a time."""
    shard, held = None, []
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if shard is not None and shards[a] != shard:
                yield _built(shard, held)
                held = []
            shard = int(shards[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield _built(shard, held)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard and salt, the shard's arrays first; the keys to drop go on."""
    perfect = prints = counts = firsts = None
    for batch in batches:
        arrays = batch.column("sizes")
        marks = np.flatnonzero(np.asarray(arrays.is_valid()))
        for a, b in zip([-1, *marks.tolist()], [*marks.tolist(), batch.num_rows]):
            if a >= 0:
                row = batch.slice(a, 1).to_pylist()[0]
                perfect = PerfectHash(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["bits"], np.uint8), np.frombuffer(row["ranks"], np.int64))
                prints, counts, firsts = (np.frombuffer(row[k], t) for k, t in (("prints", np.uint16), ("counts", np.uint8), ("firsts", np.int64)))
            part = batch.slice(a + 1, b - a - 1)
            if not part.num_rows:
                continue
            hi, lo, doc = _unsigned(part.column("hi")), _unsigned(part.column("lo")), part.column("doc").to_numpy()
            at = perfect.index(hi, lo)
            if (at < 0).any() or (prints[at] != _prints(hi)).any():
                raise ValueError("a line is missing from its shard")
            drop = (counts[at] > 1) & (firsts[at] != doc)
            yield pa.RecordBatch.from_pydict({"doc": doc[drop], "lo": lo[drop].view(np.int64)})


def _kept(text: str, n_dropped: set[int]) -> tuple[str, int]:
    lines = text.split("\n")
    keys = [line.encode().strip(BLANKS.encode()).lower() for line in lines]
    kept = [line for line, key in zip(lines, keys, strict=True) if _signed(xxhash.xxh64_intdigest(key, 42)) not in n_dropped]
    return "\n".join(kept), len(lines) - len(kept)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _rewrite(text_column: str, dropped_column: str, lines_column: str) -> Callable:
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, drops = (batch.column(names.index(c)).to_pylist() for c in (text_column, dropped_column))
            counts = [0] * len(texts)
            n_lines = [1 if t is None else t.count("\n") + 1 for t in texts]
            for i, drop in enumerate(drops):
                if drop and texts[i] is not None:
                    texts[i], counts[i] = _kept(texts[i], set(drop))
            new = {text_column: pa.array(texts, pa.string()), lines_column: pa.array(n_lines, pa.int64()), dropped_column: pa.array(counts, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(names)], names)

    return rewrite


def _keys(text: Column, min_chars: int) -> Column:
    """The distinct keys of a text's lines that are long enough."""
    keys = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: ascii_lower(F.btrim(x, F.lit(BLANKS))))
    return F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= min_chars))


def line_index(lines: DataFrame, shard_keys: int = 1 << 17) -> DataFrame:
    """The arrays of every shard, from lines ``hi, lo, doc``; a row per shard, written once."""
    found = written(lines.groupBy("hi", "lo").agg(F.min("doc").alias("first"), F.count("*").alias("documents")), "line-counts")
    bits = max(0, (max(1, found.count()) // shard_keys).bit_length())
    shard = F.shiftrightunsigned("hi", 64 - bits).cast("int") if bits else F.lit(0)
    dealt = found.withColumn("shard", shard).repartition(1 << min(bits, 14), "shard").sortWithinPartitions("shard")
    return written(in_tasks(dealt, _build, INDEX), "line-index").withColumn("bits_used", F.lit(bits))


def dedup_lines(docs: DataFrame, min_chars: int = 10, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and the two counts per document as last columns.

    A line's key is the line without blanks at both ends and with A-Z in lower case. A key of at least
    ``min_chars`` code points that several documents hold keeps its lines in the document with the smallest
    doc_id only. Lines that repeat within one document stay there. A null text counts as one empty line and
    stays null; an empty one stays empty. All rows without doc_id are one document before all others, and
    rows that repeat a doc_id are one document. Other columns pass through; columns that are named like the
    counts are replaced. An empty table gives no rows.
    """
    docs = docs.drop(n_lines, n_dropped)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    key = F.explode(_keys(F.col("text"), min_chars)).alias("key")
    lines = docs.select(doc.alias("doc"), key).select("doc", F.xxhash64(F.lit(1), "key").alias("hi"), F.xxhash64("key").alias("lo"))
    index = line_index(lines)
    bits = index.select("bits_used").first()
    bits = bits[0] if bits else 0
    shard = F.shiftrightunsigned("hi", 64 - bits).cast("int") if bits else F.lit(0)
    salts = index.where("salts > 1").select("shard", F.col("salts").alias("dealt"))
    probes = lines.withColumn("shard", shard).join(salts, "shard", "left")
    probes = probes.withColumn("salt", F.pmod(F.hash("doc"), F.coalesce("dealt", F.lit(1))))
    arrays = ("sizes", "bits", "ranks", "prints", "counts", "firsts")
    probes = probes.select("shard", "salt", "doc", "hi", "lo", *(F.lit(None).cast("binary").alias(c) for c in arrays))
    nothing = [F.lit(None).cast("long").alias(c) for c in ("doc", "hi", "lo")]
    copies = index.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *nothing, *arrays)
    dealt = copies.unionByName(probes).repartition(max(1 << min(bits, 14), 8), "shard", "salt")
    dealt = dealt.sortWithinPartitions("shard", "salt", F.col("sizes").isNull())
    drops = in_tasks(dealt, _probe, "doc long, lo long").groupBy("doc").agg(F.collect_set("lo").alias("gone"))
    names = [*docs.columns, n_lines, n_dropped]
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), doc.alias("own"))  # any column name may come
    rows = whole.join(drops, F.col("own") == F.col("doc"), "left").select("row.*", F.lit(0).cast("long").alias(n_lines), F.col("gone").alias(n_dropped))
    kinds = {**dict(docs.dtypes), n_lines: "long", n_dropped: "long", "text": "string"}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    return in_tasks(rows, _rewrite("text", n_dropped, n_lines), schema)
