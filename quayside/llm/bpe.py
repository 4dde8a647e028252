"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside Spark tasks.

A task cuts its texts into pieces and encodes the pieces it has not met yet. Their bytes become rows of
word, position and token; a recursive query joins neighbouring tokens with the merge table and contracts
each word's leftmost pair of the lowest rank, round by round, until no pair of the word can be merged.
Decoding joins the ids of whole documents with the vocabulary and puts their bytes together by an ordered
aggregation. DuckDB works on bounded blocks of words or ids in one thread; Spark spreads the documents.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import Kept, give_back, in_tasks
from quayside.llm.unit_ids import UnitIds

#: Words of up to so many bytes take one merge a round; longer ones all places of their lowest pair at once.
SHORT = 64
_WORDS = 10_000
_IDS = 100_000
_BYTES = 1 << 20
#: Sparing tasks take so much text at a time.
_SPARING = 400_000
#: Rows of an Arrow batch whose texts are taken out of it at a time.
_ROWS = 200

# A row's key is its word's number above 32 bits of its position, so one order over one number holds all words.
_ONE_MERGE = """
WITH RECURSIVE step(done, k, t) AS (
  SELECT false, (w::BIGINT << 32) | p, t FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT k, k >> 32 AS w, t, lead(t) OVER x AS n, lead(k) OVER x AS after, lag(k) OVER x AS before
     FROM step WHERE NOT done WINDOW x AS (ORDER BY k)),
   best AS (
     SELECT w, min((c::BIGINT << 32) | (k & 4294967295)) AS b
     FROM pairs JOIN merges ON ab = (t::BIGINT << 32) | n WHERE after >> 32 = w GROUP BY w)
   SELECT b IS NULL, k, CASE WHEN k & 4294967295 = b & 4294967295 THEN (b >> 32)::INTEGER ELSE t END
   FROM pairs LEFT JOIN best USING (w)
   WHERE before IS NULL OR b IS NULL OR before <> (w << 32) | (b & 4294967295)))
SELECT k >> 32 AS w, list(t ORDER BY k) AS ids FROM step WHERE done GROUP BY ALL
"""

# All non-overlapping places of a word's lowest pair, every second one of a run, are merged in a round. That
# is the same as one by one from the left, unless a token so made takes part in a pair of a lower rank
# ("early"): of those only the leftmost place is merged.
_ALL_MERGES = """
WITH RECURSIVE step(i, w, p, t) AS (
  SELECT 0, w, p, t FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT i, w, p, t, lead(t) OVER x AS n, lead(p) OVER x AS np, row_number() OVER x AS k
     FROM step WINDOW x AS (PARTITION BY w ORDER BY p)),
   met AS (SELECT pairs.*, c, early, min(c) OVER (PARTITION BY w) AS lowest
     FROM pairs JOIN merges ON ab = (t::BIGINT << 32) | n WHERE i < 12),
   places AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY k) AS nth FROM met WHERE c = lowest),
   run AS (SELECT *, row_number() OVER (PARTITION BY w, k - nth ORDER BY k) AS in_run FROM places),
   chosen AS (SELECT w, p, np, c FROM run WHERE CASE WHEN early THEN nth = 1 ELSE in_run % 2 = 1 END)
   SELECT s.i + 1, s.w, s.p, coalesce(h.c, s.t)
   FROM step s JOIN (SELECT DISTINCT w FROM chosen) USING (w) LEFT JOIN chosen h ON h.w = s.w AND h.p = s.p
   WHERE NOT EXISTS (FROM chosen d WHERE d.w = s.w AND d.np = s.p)))
SELECT w, last >= 12 AS more, list(t ORDER BY p) AS ids, list(p ORDER BY p) AS places
FROM (SELECT *, max(i) OVER (PARTITION BY w) AS last FROM step) WHERE i = last GROUP BY w, last
"""

_DECODE = """
SELECT d, string_agg(bytes, '' ORDER BY p) AS text FROM ids JOIN vocabulary USING (t) GROUP BY d
"""


class ByteBpe:
    """Encoder and decoder of one rank file (base64 token and rank a line) and its splitting pattern."""

    def __init__(self, path: str, pattern: str, keep: int = 600_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.units = UnitIds(self._learn, self._learn, most=keep)
        self.keep = keep
        self.pieces: dict[str, bytes] = {}
        parts = [(a, b, c) for token, c in self.ranks.items() for i in range(1, len(token))
                 if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        a, b, c = (pa.array(x, pa.int32()) for x in zip(*parts, strict=True)) if parts else (pa.array([], pa.int32()),) * 3
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.con.register("made", pa.table({"a": a, "b": b, "c": c}))
        self.con.execute(
            "CREATE TABLE merges AS WITH low AS (SELECT DISTINCT unnest([a, b]) AS t FROM made WHERE c < a OR c < b) "
            "SELECT (a::BIGINT << 32) | b AS ab, c, c IN (SELECT t FROM low) AS early FROM made")
        tokens = pa.table({"t": pa.array(self.ranks.values(), pa.int32()), "bytes": [x.decode("latin-1") for x in self.ranks]})  # a character a byte
        self.con.register("tokens", tokens)
        self.con.execute("CREATE TABLE vocabulary AS FROM tokens")

    def _merged(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words that are no tokens themselves."""
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        for at in range(0, len(short), _WORDS):
            block = short[at: at + _WORDS]
            rows = self._query(_ONE_MERGE, *self._start([words[i] for i in block]))
            ids = rows["ids"].combine_chunks()
            cuts, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            for w, a, b in zip(rows["w"].to_pylist(), cuts, cuts[1:]):
                found[block[w]] = flat[a:b]
        for i, word in enumerate(words):
            if len(word) > SHORT:
                state, more = self._start([word]), True
                while more:
                    row = self._query(_ALL_MERGES, *state).to_pylist()[0]
                    more, found[i] = row["more"], np.array(row["ids"], np.int32)
                    state = (np.zeros(len(row["ids"]), np.int32), np.array(row["places"], np.int32), found[i])
        return found

    def _start(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        places = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(np.arange(len(words), dtype=np.int32), sizes), places.astype(np.int32), self.of_byte[data]

    def _query(self, sql: str, w: np.ndarray, p: np.ndarray, t: np.ndarray) -> pa.Table:
        self.con.register("start", pa.table({"w": w, "p": p, "t": t}))
        return self.con.sql(sql).to_arrow_table()

    def _learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units; only pieces that were not met before are merged."""
        if len(self.pieces) > self.keep:
            self.pieces.clear()
        split = [self.pattern.findall(u) for u in units]
        words = list({p for ps in split for p in ps}.difference(self.pieces))
        raw = [w.encode() for w in words]
        whole = [self.ranks.get(r) for r in raw]
        longer = [i for i, r in enumerate(whole) if r is None]
        self.pieces.update((w, r.to_bytes(4, "little")) for w, r in zip(words, whole, strict=True) if r is not None)
        self.pieces.update((words[i], x.astype("<u4").tobytes()) for i, x in zip(longer, self._merged([raw[i] for i in longer]), strict=True))
        of = self.pieces.__getitem__
        data = [b"".join(map(of, ps)) for ps in split]
        return np.frombuffer(b"".join(data), "<u4"), np.array([len(d) // 4 for d in data], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        ids, sizes = self.units.of(texts)
        return np.split(ids, np.cumsum(sizes)[:-1]) if texts else []

    def decode(self, documents: list[np.ndarray]) -> list[bytes]:
        """Bytes of documents from their ids alone, in blocks of bounded size; longer documents in parts."""
        found = [b""] * len(documents)
        block, size = [], 0
        for d, ids in enumerate(documents):
            for at in range(0, len(ids), _IDS):
                block.append((d, ids[at: at + _IDS]))
                size += len(block[-1][1])
                if size >= _IDS:
                    self._decoded(block, found)
                    block, size = [], 0
        self._decoded(block, found)
        return found

    def _decoded(self, block: list[tuple[int, np.ndarray]], found: list[bytes]) -> None:
        if not block:
            return
        flat = np.concatenate([x for _, x in block]).astype(np.int32)
        part = np.repeat(np.arange(len(block), dtype=np.int32), [len(x) for _, x in block])
        self.con.register("ids", pa.table({"d": part, "p": np.arange(len(flat), dtype=np.int32), "t": flat}))
        texts = dict(zip(*(c.to_pylist() for c in self.con.sql(_DECODE).to_arrow_table().columns), strict=True))
        for i, (d, _) in enumerate(block):
            found[d] += texts[i].encode("latin-1")


@cache
def _bpe(path: str, pattern: str, keep: int) -> Kept:
    return Kept(lambda: ByteBpe(path, pattern, keep))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _coder(path: str, pattern: str, keep: int, sparing: bool = False) -> Callable:
    most = _SPARING if sparing else _BYTES

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, ids, texts, size = _bpe(path, pattern, keep), [], [], 0

        def coded() -> pa.RecordBatch:
            with kept as bpe:
                tokens = bpe.encode(texts)
                if sparing:
                    give_back()
                decoded = bpe.decode(tokens)
            if sparing:
                give_back()
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary()), pa.array(decoded, pa.binary()),
            ], ["doc_id", "ids", "decoded"])

        for part in _parts(batches):
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(text or "")
                size += len(texts[-1])
                if size >= most:
                    yield coded()
                    ids, texts, size = [], [], 0
        if ids:
            yield coded()

    return code


def encode_and_decode(docs: DataFrame, path: str, pattern: str, keep: int = 600_000, sparing: bool = False) -> DataFrame:
    """``doc_id, ids, decoded`` of every document: its ids as little-endian unsigned 32-bit integers, and the
    bytes that these ids decode to.

    A null text is an empty one, and an empty text has no ids. Special tokens in a text are ordinary text.
    Rows without doc_id and repeated rows return as they are. Other columns are not read. An empty table
    gives no rows. There is no shuffle; a task works on a megabyte of text, or one longer text, at a time. A worker
    remembers the ids of up to ``keep`` units and pieces of text: more is faster and takes more memory. A ``sparing``
    task works on less text at a time and returns unused memory after each block, for more CPU time.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_tasks(plain, _coder(path, pattern, keep, sparing), "doc_id long, ids binary, decoded binary")
