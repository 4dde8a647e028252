"""Token ids on disk as directly addressable codes.

An id is cut into chunks of ``width`` bits, lowest first. Level 0 holds the lowest chunk of every id; a
continuation bit says whether the id goes on, and the next level holds the next chunk of just those ids. A
rank directory (ones before every block of 512 bits) turns an id's place in one level into its place in
the next, so any token is read by one step per level, and no block is ever decoded.

Files are written in ascending document order by the tasks of a range partitioning, and carry their own
document index. A task writes file after file, so their sizes are bounded and so is the number of tasks. A
manifest row per file gives the number of ids before it.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import Kept, in_tasks, rows_of, shared_folder, written
from quayside.llm.unit_ids import UnitIds

_MAGIC = b"DACTOK1\n"
_BLOCK = 512

MANIFEST = "path string, part int, seq int, documents long, tokens long"

#: Tasks that write token files; beyond that many files a task writes several.
MOST_PARTS = 4096
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


@dataclass
class Level:
    """One chunk level: values, continuation bits (lowest bit first) and ones before each 512-bit block."""

    chunks: np.ndarray
    bits: np.ndarray
    ranks: np.ndarray

    def goes_on(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before position ``at``: the directory's entry and the bits of one block."""
        block = at // _BLOCK
        start = block * (_BLOCK // 8)
        bytes_ = self.bits[np.minimum(start[:, None] + np.arange(_BLOCK // 8), max(len(self.bits) - 1, 0))]
        left = np.clip((at - block * _BLOCK)[:, None] - 8 * np.arange(_BLOCK // 8), 0, 8)
        return self.ranks[block] + np.bitwise_count(bytes_ & ((1 << left) - 1).astype(np.uint8)).sum(axis=1, dtype=np.int64)

    def rank_run(self, start: int, stop: int) -> int:
        return int(self.rank(np.array([start]))[0]) if start < stop else 0


class Codes:
    """Directly addressable codes of one sequence of ids."""

    def __init__(self, n: int, width: int, levels: list[Level]):
        self.n, self.width, self.levels = n, width, levels

    @classmethod
    def of(cls, ids: np.ndarray, width: int = 8) -> Codes:
        rest, levels = ids.astype(np.uint64), []
        n = len(rest)
        while len(rest) or not levels:
            high = rest >> np.uint64(width)
            on = high > 0
            ones = np.add.reduceat(on, np.arange(0, len(on), _BLOCK), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
            levels.append(Level(
                (rest & np.uint64((1 << width) - 1)).astype(np.uint8 if width <= 8 else np.uint16),
                np.packbits(on, bitorder="little"), np.concatenate([[0], np.cumsum(ones)]).astype(np.int64),
            ))
            rest = high[on]
        return cls(n, width, levels)

    def at(self, positions: np.ndarray) -> np.ndarray:
        """The ids at any positions, each found by itself."""
        positions = np.asarray(positions, np.int64)
        if len(positions) and (positions.min() < 0 or positions.max() >= self.n):
            raise IndexError("token position out of range")
        found, alive, place = np.zeros(len(positions), np.uint64), np.arange(len(positions)), positions
        for k, level in enumerate(self.levels):
            found[alive] |= level.chunks[place].astype(np.uint64) << np.uint64(k * self.width)
            on = level.goes_on(place).astype(bool)
            alive, place = alive[on], level.rank(place[on])
            if not len(alive):
                break
        return found.astype(np.uint32)

    def run(self, start: int, stop: int) -> np.ndarray:
        """The ids of one stretch: a rank at its start in each level, then plain slices."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError("token range out of range")
        found, alive = np.zeros(stop - start, np.uint64), None
        for k, level in enumerate(self.levels):
            if start >= stop:
                break
            part = level.chunks[start:stop].astype(np.uint64) << np.uint64(k * self.width)
            if alive is None:
                found |= part
            else:
                found[alive] |= part
            on = np.unpackbits(level.bits[start // 8: (stop + 7) // 8], bitorder="little")[start % 8:][: stop - start].astype(bool)
            alive = np.flatnonzero(on) if alive is None else alive[on]
            start = level.rank_run(start, stop)
            stop = start + len(alive)
        return found.astype(np.uint32)


def write_file(out, doc_ids: list[int | None], lengths: np.ndarray, codes: Codes) -> None:
    """Header line, document index (ids, null flags, lengths), then chunks, bits and ranks of each level."""
    sections = [np.array([0 if d is None else d for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), lengths.astype("<i8")]
    for level in codes.levels:
        sections += [level.chunks, level.bits, level.ranks.astype("<i8")]
    head = json.dumps({"documents": len(doc_ids), "tokens": codes.n, "width": codes.width,
                       "sections": [[s.dtype.str, len(s)] for s in sections]}).encode()
    out.write(_MAGIC + struct.pack("<I", len(head)) + head)
    for s in sections:
        out.write(s.tobytes())


def read_file(source) -> tuple[list[int | None], np.ndarray, Codes]:
    if source.read(len(_MAGIC)) != _MAGIC:
        raise ValueError("not a token file")
    head = json.loads(source.read(struct.unpack("<I", source.read(4))[0]))
    parts = []
    for kind, n in head["sections"]:
        data = source.read(n * np.dtype(kind).itemsize)
        if len(data) != n * np.dtype(kind).itemsize:
            raise ValueError("the token file is cut off")
        parts.append(np.frombuffer(data, kind))
    ids, nulls, lengths, *rest = parts
    levels = [Level(*rest[i: i + 3]) for i in range(0, len(rest), 3)]
    return [None if z else int(d) for d, z in zip(ids, nulls, strict=True)], lengths, Codes(head["tokens"], head["width"], levels)


class _Library:
    """Learns units from the tokenizers library."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True  # units never hold an added token: see LibraryIds
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # byte-level vocabularies write each byte as one character

    def inner(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many units as one text; as no token reaches over a cut, its ids are dealt back by their bytes."""
        found, sizes = [], []
        for at in range(0, len(units), 20_000):
            part = units[at: at + 20_000]
            texts = ["".join(part[i: i + 100]) for i in range(0, len(part), 100)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
            ends, reached = np.cumsum([len(u.encode()) for u in part]), np.cumsum(self.bytes_of[ids])
            cuts = np.searchsorted(reached, ends) + 1
            if not np.array_equal(reached[cuts - 1], ends):
                raise ValueError("a token reaches over a unit's end")
            found.append(ids)
            sizes.append(np.diff(cuts, prepend=0))
        return np.concatenate(found), np.concatenate(sizes)

    def first(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)


class LibraryIds:
    """Ids of whole texts as the tokenizers library gives them with its defaults.

    Texts that hold the name of an added token (of an end mark, say) are cut there before anything else, so
    they are left to the library whole; all others are put together from their units.
    """

    def __init__(self, tokenizer_path: str, end_id: int | None):
        from tokenizers import Tokenizer

        library = _Library(tokenizer_path)
        self.units = UnitIds(library.inner, library.first, end_id)
        self.plain, self.after = Tokenizer.from_file(tokenizer_path), int(end_id is not None)
        names = sorted({t.content for t in self.plain.get_added_tokens_decoder().values() if t.content}, key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, each with the end id, and how many each text has."""
        odd = [i for i, t in enumerate(texts) if self.added and self.added.search(t)]
        if not odd:
            return self.units.of(texts)
        ids, sizes = self.units.of(["" if i in set(odd) else t for i, t in enumerate(texts)])
        found = [np.array(self.plain.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in odd]
        each = np.array([len(f) for f in found])
        before = (np.cumsum(sizes) - sizes)[odd]
        ids = np.insert(ids, np.repeat(before, each), np.concatenate(found))
        sizes[odd] += each
        return ids, sizes


def library_ids(tokenizer_path: str, end_id: int | None) -> LibraryIds:
    return LibraryIds(tokenizer_path, end_id)


@cache
def _library_ids(tokenizer_path: str, end_id: int | None) -> Kept:
    return Kept(lambda: library_ids(tokenizer_path, end_id))


def _by_size(rows: Iterator[dict], most: int) -> Iterator[list[dict]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["text"])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _writer(folder: str, tokenizer_path: str, end_id: int, width: int, file_bytes: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _library_ids(tokenizer_path, end_id)
        doc_ids, ids, lengths, part, seq, size = [], [], [], 0, 0, 0

        def file() -> pa.RecordBatch:
            store, base = fs.FileSystem.from_uri(folder)
            store.create_dir(base, recursive=True)
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"  # a repeated attempt writes a file of its own
            codes = Codes.of(np.concatenate(ids), width)
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                write_file(out, doc_ids, np.concatenate(lengths), codes)
            return pa.RecordBatch.from_pydict({
                "path": [f"{folder}/{name}"], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "documents": [len(doc_ids)], "tokens": [codes.n],
            })

        for rows in _by_size(rows_of(batches), min(1 << 22, file_bytes)):
            part = rows[0]["part"]
            doc_ids += [r["doc_id"] for r in rows]
            size += sum(len(r["text"]) for r in rows)
            with kept as units:
                found, sizes = units.of([r["text"] for r in rows])
            ids.append(found)
            lengths.append(sizes)
            if size >= file_bytes:
                yield file()
                doc_ids, ids, lengths, seq, size = [], [], [], seq + 1, 0
        if doc_ids:
            yield file()

    return write


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0, width: int = 8, part_bytes: int = 16 << 20) -> DataFrame:
    """Encode ``doc_id, text`` and write the ids in ascending doc_id order; returns a manifest row per file.

    A null text is empty, and an empty text has just the end id. Documents without doc_id come first;
    repeated ids follow each other in the order of their texts' hashes. Other columns are not read. An empty table
    writes no file. A file holds about ``part_bytes`` bytes of text or one longer document, and a task one file's ids.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_PARTS, max(1, -(-total // part_bytes)))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # keys of fixed size: samples of them reach the driver
    ranged = plain.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    folder = shared_folder(spark, "tokens")
    # ranges differ in size: a file may hold half as much again before another is begun
    return written(in_tasks(ranged, _writer(folder, tokenizer_path, end_id, width, part_bytes * 3 // 2), MANIFEST), "token-files")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: the ids in all files before.

    Sums of parts first (at most ``MOST_PARTS`` rows go through one window), then the files of each part.
    """
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("of_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("of_part").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(parts, "part").withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).drop("before")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        store, path = fs.FileSystem.from_uri(row["path"])
        with store.open_input_stream(path, compression=None) as source:
            doc_ids, lengths, codes = read_file(source)
        ends = np.cumsum(lengths)
        data = memoryview(codes.run(0, codes.n).astype("<u4").tobytes())
        crcs = [zlib.crc32(data[4 * (e - n): 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(doc_ids, pa.int64()), "start": row["start"] + ends - lengths, "n_tokens": lengths,
            "ids_crc32": pa.array(crcs, pa.int64()),
        })


def read_tokens(manifest: DataFrame) -> DataFrame:
    """A row per document from the files: place of its first id among all ids, number of ids, CRC-32 of its ids."""
    files = manifest.count()
    dealt = with_starts(manifest).select("path", "start").repartition(max(1, min(files, 20_000)), "path")
    return in_tasks(dealt, _reader, DOCUMENTS)
