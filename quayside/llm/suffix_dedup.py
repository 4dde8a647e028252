"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A string of ``length`` bytes that also starts earlier is removed wherever it starts again. Only suffixes that
can have an equal are sorted. Each string is represented by the leftmost smallest hash of its 32-byte grams,
its anchor; equal strings have equal anchors at equal places. Anchors are counted in Spark: one that occurs
once is done, and one whose whole surroundings (all strings that it represents) equal earlier ones is done
too. What is left is small: anchors that come back in different surroundings.

Those surroundings are dealt to blocks by anchor, and one block is sorted at a time. The suffixes at the
positions of a difference cover (7 of 32) are ranked first, by their first ``length`` bytes, with the lengths
of their common prefixes. All suffixes that start a string are then grouped by their first 32 bytes; within a
group two suffixes are compared in constant time: their positions plus one common shift are both in the cover,
and ranks and common prefixes are known there. So long ties cost nothing, and memory follows the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import in_tasks, written

_NO_ID = -(2**63)  # stands for a null doc_id: before all others
_GRAM = 32
_PERIOD = 32
_CHUNK = 2 << 20
_RUN = 15 << 20  # below 2**24: anchors are chosen by hashes that carry their place in the run in 24 bits
_BLOCK = 1 << 20
_FULL = 4096  # surroundings of one anchor in a block; more of them are dealt to further blocks

ANCHORS = "route long, anchor long, around long, sid long, tag long, at int, left int, right int"
FOUND = "kind int, anchor long, salt int, sid long, tag long, at int, left int, right int"
SPANS = "sid long, tag long, start int, strings int, hi long, lo long"


@cache
def difference_cover(period: int = _PERIOD) -> tuple[tuple[int, ...], np.ndarray]:
    """Residues whose differences give every residue, and for two residues the shift that takes both into them."""
    cover = [0]
    while True:
        differences = {(a - b) % period for a in cover for b in cover}
        if len(differences) == period:
            break
        gains = {x: len({d for c in cover for d in ((x - c) % period, (c - x) % period)} - differences) for x in range(period) if x not in cover}
        cover.append(max(gains, key=lambda x: (gains[x], -x)))
    shift = np.zeros((period, period), np.int64)
    for a in range(period):
        for b in range(period):
            shift[a, b] = next(s for s in range(period) if (a + s) % period in cover and (b + s) % period in cover)
    return tuple(sorted(cover)), shift


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all 32-byte grams, by doubling."""
    h = _mix(data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    factor, width = 0xD6E8FEB86659FD93, 1
    while width < _GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % 2**64, 2 * width
    return _mix(h)


def _anchors(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Per run of strings with one anchor: document, anchor's hash and place in ``data``, first and last start of the strings."""
    hashes = _gram_hashes(data)
    packed = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
    reach, width = length - _GRAM + 1, 1
    low = packed
    while 2 * width <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (reach - width)], low[reach - width:])
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
    valid = np.flatnonzero(np.arange(len(low)) + length <= ends[doc])
    chosen = (low[valid] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(chosen) != 0) | (np.diff(valid) != 1)])) if len(valid) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(valid)) - 1
    return doc[valid[new]], hashes[chosen[new]], chosen[new], valid[new], valid[last]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append((*row[:2], row[2].encode()))
            size += len(held[-1][2])
            if size >= _CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _pieces(docs: list[tuple], length: int) -> Iterator[tuple[np.ndarray, list[tuple]]]:
    """Documents side by side in runs of up to ``_RUN`` bytes; a longer one comes in overlapping parts: (sid, tag, bytes, place of the part)."""
    most, small, size = _RUN, [], 0
    for sid, tag, data in docs:
        if len(data) > most:
            for at in range(0, len(data) - length + 1, most - length + 1):
                yield np.frombuffer(data[at: at + most], np.uint8), [(sid, tag, data[at: at + most], at)]
        elif len(data) >= length:
            if size + len(data) > most:
                yield np.frombuffer(b"".join(d[2] for d in small), np.uint8), small
                small, size = [], 0
            small.append((sid, tag, data, 0))
            size += len(data)
    if small:
        yield np.frombuffer(b"".join(d[2] for d in small), np.uint8), small


def _anchor_rows(length: int) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _chunks(batches):
            for data, parts in _pieces(docs, length):
                sizes = np.array([len(p[2]) for p in parts])
                begin = np.cumsum(sizes) - sizes
                doc, anchor, at, first, last = _anchors(data, sizes, length)
                view, digest = memoryview(data), xxhash.xxh3_64_intdigest
                around = np.fromiter(
                    (digest(view[a:b], x - a) for a, b, x in zip(first.tolist(), (last + length).tolist(), at.tolist(), strict=True)), np.uint64, len(doc))
                sid, tag, shift = (np.array([p[i] for p in parts], np.int64)[doc] for i in (0, 1, 3))
                place = at - begin[doc] + shift
                order = np.lexsort((place, sid, around, anchor))
                same = np.zeros(len(order), bool)
                a, c = anchor[order], around[order]
                same[1:] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
                later = np.zeros(len(order), bool)
                leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                later[order] = same & ((sid[order] != sid[order][leader]) | (place[order] > place[order][leader]))
                # an earlier equal in this chunk settles it: such rows are dealt by document and pass through
                route = np.where(later, _mix(sid.view(np.uint64)), anchor).view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "route": route, "anchor": pa.array(anchor.view(np.int64), mask=later), "around": around.view(np.int64), "sid": sid,
                    "tag": tag, "at": place.astype(np.int32), "left": (at - first).astype(np.int32), "right": (at - last).astype(np.int32)})

    return find


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor, surroundings, document, place and tag. Kind 0: all strings repeat earlier ones; kind 1: to be sorted.

    Of an anchor only the last row's key and the first surroundings are kept, however often it occurs. Texts
    that share a doc_id may have equal surroundings at one place; none of them is earlier, so each is sorted.
    """
    key, leader, waiting, count, last_tag = None, None, None, 0, 0
    for batch in batches:
        names = ("anchor", "around", "sid", "tag", "at", "left", "right")
        settled = np.asarray(batch.column(1).is_null())
        out = [np.stack([np.zeros(settled.sum(), np.int64), np.zeros(settled.sum(), np.int64), np.zeros(settled.sum(), np.int64),
                         *(batch.column(i).to_numpy(zero_copy_only=False)[settled].astype(np.int64) for i in range(3, 8))])]
        rest = batch.filter(pa.array(~settled))
        if rest.num_rows:
            anchor, around, sid, tag, at, left, right = (rest.column(rest.schema.names.index(n)).to_numpy().astype(np.int64) for n in names)
            n = len(anchor)
            before = np.concatenate([[0], anchor[:-1]]), np.concatenate([[0], around[:-1]])
            starts = (anchor != before[0]) | (around != before[1])
            starts[0] = key != (anchor[0], around[0])
            lead = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
            lead_sid, lead_at = np.where(lead >= 0, sid[lead], leader[0] if leader else 0), np.where(lead >= 0, at[lead], leader[1] if leader else 0)
            repeats = ~starts & ((sid != lead_sid) | (at > lead_at))
            out.append(np.stack([np.zeros(repeats.sum(), np.int64)] * 3 + [x[repeats] for x in (sid, tag, at, left, right)]))
            firsts = np.flatnonzero(starts | (~repeats & (tag != np.concatenate([[last_tag], tag[:-1]]))))
            fa = anchor[firsts]
            rows = np.stack([np.ones(len(firsts), np.int64), fa, np.zeros(len(firsts), np.int64), *(x[firsts] for x in (sid, tag, at, left, right))])
            carried = key is not None and len(firsts) and fa[0] == key[0]
            if len(firsts):
                group = np.concatenate([[0], np.cumsum(np.diff(fa) != 0)])
                nth = np.arange(len(firsts)) - np.searchsorted(group, group) + np.where((group == 0) & carried, count, 0)
                size = np.bincount(group)[group] + np.where((group == 0) & carried, count, 0)
                rows[2] = nth // _FULL
                if waiting is not None and carried:
                    out.append(waiting)
                many = size > 1
                out.append(rows[:, many])
                count = int(nth[-1]) + 1
                waiting = None if many[-1] else rows[:, -1:]
            key, last_tag = (anchor[-1], around[-1]), tag[-1]
            leader = (int(lead_sid[-1]), int(lead_at[-1]))
        made = np.concatenate(out, axis=1)
        if made.shape[1]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[i], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 3))],
                ["kind", "anchor", "salt", "sid", "tag", "at", "left", "right"])


def _surroundings(length: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for sid, tag, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                for w in wanted:
                    first = w["at"] - w["left"]
                    strings = w["left"] - w["right"] + 1
                    held.append((w["anchor"], w["salt"], sid, tag, first, strings, data[first: first + strings - 1 + length]))
                    size += length
                if size > 8 << 20:
                    yield _cut_batch(held)
                    held, size = [], 0
            if held:
                yield _cut_batch(held)

    return cut


_CUT = "anchor long, salt int, sid long, tag long, start int, strings int, data binary"


def _cut_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    names = [x.split()[0] for x in _CUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _words(data: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The bytes after each position as big-endian 64-bit words, the last one filled up with zeros."""
    found = []
    for k in range(0, size, 8):
        word = np.zeros(len(at), np.uint64)
        for b in range(8):
            word = word << np.uint64(8) | (data[at + k + b].astype(np.uint64) if k + b < size else np.uint64(0))
        found.append(word)
    return found


class CoverRanks:
    """Ranks of the cover's suffixes by their first ``length`` bytes, and their common prefixes."""

    def __init__(self, data: np.ndarray, length: int):
        cover, self.shift = difference_cover()
        self.length, size = length, len(data) - 2 * length
        self.places = np.flatnonzero(np.isin(np.arange(size) % _PERIOD, cover))
        words = _words(data, self.places, length)
        order = np.lexsort(words[::-1])
        self.rank = np.zeros(size, np.int64)
        self.rank[self.places[order]] = np.arange(len(order))
        common = np.full(max(0, len(order) - 1), length, np.int64)
        undone = np.ones(len(common), bool)
        for k, w in enumerate(words):
            differs = w[order[1:]] ^ w[order[:-1]]
            here = undone & (differs != 0)
            zeros = 63 - np.floor(np.log2(differs[here].astype(np.float64), where=True)).astype(np.int64)
            exact = differs[here]
            zeros = np.where(exact >> (np.uint64(63) - zeros.clip(0, 63).astype(np.uint64)) == 0, zeros + 1, zeros)
            common[here] = np.minimum(length, 8 * k + zeros // 8)
            undone &= differs == 0
        self.table = [common.astype(np.uint8)]
        while 2 ** len(self.table) <= len(common):
            half = 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def compare(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of suffixes equal in their first 32 bytes: whether their strings are equal, and whether q sorts before p."""
        shift = self.shift[p % _PERIOD, q % _PERIOD]
        a, b = self.rank[p + shift], self.rank[q + shift]
        low, high = np.minimum(a, b), np.maximum(a, b)
        common = np.full(len(p), self.length, np.int64)
        far = high > low
        level = np.floor(np.log2((high - low)[far])).astype(np.int64)
        found = np.zeros(far.sum(), np.int64)
        for k in np.unique(level):
            here = level == k
            row = self.table[k]
            found[here] = np.minimum(row[low[far][here]], row[high[far][here] - 2**k])
        common[far] = found
        return shift + common >= self.length, b < a


def equal_strings(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number for each start, the same for equal strings of ``length`` bytes. ``data`` ends with 2 * length spare bytes."""
    classes, done = np.full(len(starts), -1, np.int64), 0
    head = np.stack(_words(data, starts, _PERIOD))
    order = np.lexsort(head[::-1])
    new = np.concatenate([[True], (head[:, order[1:]] != head[:, order[:-1]]).any(axis=0)]) if len(starts) else np.zeros(0, bool)
    group, left = np.cumsum(new) - 1, order
    ranks = None
    while len(left):
        edges = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
        sizes = np.diff(np.append(edges, len(left)))
        single = np.repeat(sizes == 1, sizes)
        classes[left[single]] = done + np.arange(single.sum())
        done += int(single.sum())
        left, group = left[~single], group[~single]
        if not len(left):
            break
        ranks = ranks or CoverRanks(data, length)
        edges = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
        number = np.cumsum(np.concatenate([[False], np.diff(group) != 0]))
        pivot = left[edges + (np.diff(np.append(edges, len(left)))) // 2][number]
        same, less = ranks.compare(starts[pivot], starts[left])
        classes[left[same]] = done + number[same]
        done += int(number[-1]) + 1
        left, group = left[~same], 2 * number[~same] + less[~same]
        order = np.argsort(group, kind="stable")
        left, group = left[order], group[order]
    return classes


def _sorted_block(rows: list[dict], length: int) -> pa.RecordBatch:
    data = np.frombuffer(b"".join(r["data"] for r in rows) + bytes(2 * length), np.uint8)
    sizes = np.array([len(r["data"]) for r in rows])
    begin = np.cumsum(sizes) - sizes
    strings = np.array([r["strings"] for r in rows])
    row = np.repeat(np.arange(len(rows)), strings)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(strings) - strings, strings)
    starts = begin[row] + inside
    sid, tag, start, anchor, salt = (np.array([r[k] for r in rows], np.int64) for k in ("sid", "tag", "start", "anchor", "salt"))
    classes = equal_strings(data, starts, length)
    where = start[row] + inside
    order = np.lexsort((where, sid[row], classes))
    same = np.concatenate([[False], np.diff(classes[order]) == 0])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    repeats = np.zeros(len(row), bool)
    repeats[order] = same & ((sid[row][order] != sid[row][order][lead]) | (where[order] > where[order][lead]))
    flagged = np.flatnonzero(repeats)
    new = np.concatenate([[True], (np.diff(flagged) != 1) | (np.diff(row[flagged]) != 0)]) if len(flagged) else np.zeros(0, bool)
    runs, counts = flagged[new], np.diff(np.append(np.flatnonzero(new), len(flagged)))
    parts = [(sid[row[runs]], tag[row[runs]], where[runs], counts, None, None)]
    pair = np.stack([anchor, salt])
    _, which, members = np.unique(pair, axis=1, return_inverse=True, return_counts=True)
    dealt = ((members[which] >= _FULL) | (salt > 0))[row] & ~repeats
    if dealt.any():  # equals may be in another block of the anchor: these meet by the hash of the string
        at = np.flatnonzero(dealt)
        raw = data.tobytes()
        digests = [xxhash.xxh3_128_intdigest(raw[s: s + length]) for s in starts[at].tolist()]
        hi = np.array([d >> 64 for d in digests], np.uint64).view(np.int64)
        lo = np.array([d & (2**64 - 1) for d in digests], np.uint64).view(np.int64)
        parts.append((sid[row[at]], tag[row[at]], where[at], np.ones(len(at), np.int64), hi, lo))
    made = []
    for s, t, w, c, hi, lo in parts:
        none = pa.nulls(len(s), pa.int64())
        made.append(pa.RecordBatch.from_arrays(
            [pa.array(s, pa.int64()), pa.array(t, pa.int64()), pa.array(w, pa.int32()), pa.array(c, pa.int32()),
             none if hi is None else pa.array(hi), none if lo is None else pa.array(lo)], ["sid", "tag", "start", "strings", "hi", "lo"]))
    return pa.Table.from_batches(made).combine_chunks().to_batches()[0] if sum(m.num_rows for m in made) else made[0]


def _sort_blocks(length: int) -> Callable:
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and salt; a block is a number of whole groups."""
        held, size, last = [], 0, None
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["anchor"], r["salt"])
                if size >= _BLOCK and key != last:
                    yield _sorted_block(held, length)
                    held, size = [], 0
                held.append(r)
                size += len(r["data"])
                last = key
        if held:
            yield _sorted_block(held, length)

    return sort


def _cover(data: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """What is left of ``data`` without the strings of the spans, bytes removed and maximal removed runs."""
    change = np.zeros(len(data) + 1, np.int64)
    for start, strings in spans:
        change[start] += 1
        change[start + strings - 1 + length] -= 1
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _remove(length: int) -> Callable:
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kept, sizes, removed, runs = batch.column(0), [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                left, n, k = _cover(data, [(s["start"], s["strings"]) for s in spans], length) if spans else (data, 0, 0)
                kept.append(left)
                sizes.append(len(data))
                removed.append(n)
                runs.append(k)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return remove


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans`` of every document.

    Every byte is removed that a string of ``length`` bytes covers which also starts earlier: in a document
    with a smaller doc_id or earlier in the same one. Strings are judged on the input and do not reach over
    documents. ``kept`` are the other bytes; it need not be whole characters. A null text is empty, and texts
    under ``length`` bytes stay. All rows without doc_id are one document before all others. Rows that share
    a doc_id are one document: the same string in another of them is earlier only at a smaller offset, so
    equal rows stay equal. Other columns are not read. An empty table gives no rows.
    """
    if length <= _GRAM + _PERIOD:
        raise ValueError(f"length must be over {_GRAM + _PERIOD}")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = plain.select(
        "doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("sid"), F.xxhash64("text").alias("tag"), "text")
    rows = in_tasks(plain.where(F.octet_length("text") >= length).select("sid", "tag", "text"), _anchor_rows(length), ANCHORS)
    dealt = rows.repartition("route").sortWithinPartitions("anchor", "around", "sid", "at", "tag")
    found = written(in_tasks(dealt, _judge, FOUND), "anchors")
    wanted = found.where("kind = 1").groupBy("sid", "tag").agg(F.collect_list(F.struct("anchor", "salt", "at", "left", "right")).alias("wanted"))
    wanted = wanted.withColumnsRenamed({"sid": "s", "tag": "t"})
    texts = plain.join(wanted, (F.col("sid") == F.col("s")) & (F.col("tag") == F.col("t"))).select("sid", "tag", "text", "wanted")
    cut = in_tasks(texts, _surroundings(length), _CUT).repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    sorted_ = written(in_tasks(cut, _sort_blocks(length), SPANS), "sorted")
    strings = sorted_.where("hi is not null")
    first = strings.groupBy("hi", "lo").agg(F.min(F.struct("sid", "start")).alias("first"))
    later = strings.join(first, ["hi", "lo"]).where((F.col("sid") != F.col("first.sid")) | (F.col("start") > F.col("first.start")))
    spans = found.where("kind = 0").select("sid", "tag", (F.col("at") - F.col("left")).alias("start"), (F.col("left") - F.col("right") + 1).alias("strings"))
    spans = spans.unionByName(sorted_.where("hi is null").select("sid", "tag", "start", "strings")).unionByName(later.select("sid", "tag", "start", "strings"))
    spans = spans.groupBy("sid", "tag").agg(F.collect_list(F.struct("start", "strings")).alias("spans")).withColumnsRenamed({"sid": "s", "tag": "t"})
    whole = plain.join(spans, (F.col("sid") == F.col("s")) & (F.col("tag") == F.col("t")), "left").select("doc_id", "text", "spans")
    return in_tasks(whole, _remove(length), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
