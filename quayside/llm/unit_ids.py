"""Token ids of whole texts from the ids of their units, each asked for once.

The splitting pattern of byte-level tokenizers starts a new piece in any case at a space that a character
follows which is no white space. Texts are cut there; what stands between two cuts always has the same ids.

Arrow cuts a block of texts and numbers its distinct units, so only these become Python strings and are looked up.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SAFE_CUT = re.compile(r" (?=\S)")
_UNSAFE = re.compile(r" (?!\S)")

#: Takes unit texts and says their ids, one after the other, and how many each has.
Learn = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def cut_safely(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts, one after the other, and how many each text has.

    A text in which every space is a safe cut is split at its spaces, which Arrow does for many texts at once.
    """
    odd = np.fromiter((_UNSAFE.search(t) is not None for t in texts), bool, len(texts))
    plain = pc.split_pattern(pa.array([t for t, o in zip(texts, odd.tolist(), strict=True) if not o], pa.large_string()), " ")
    units, counts = plain.flatten(), np.zeros(len(texts), np.int64)
    counts[~odd] = pc.list_value_length(plain).to_numpy()
    if not odd.any():
        return units, counts
    cut = [SAFE_CUT.split(texts[i]) for i in np.flatnonzero(odd)]
    counts[odd] = list(map(len, cut))
    units = pa.concat_arrays([units, pa.array(chain.from_iterable(cut), pa.large_string())])
    starts, order = np.zeros(len(texts), np.int64), np.argsort(odd, kind="stable")
    starts[order] = np.cumsum(counts[order]) - counts[order]
    return units.take(pa.array(np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(len(units)))), counts


class _Places(dict):
    """Numbers units in the order in which they are met."""

    def __init__(self):
        super().__init__()
        self.fresh = []

    def __missing__(self, unit):
        place = self[unit] = len(self)
        self.fresh.append(unit)
        return place


class UnitIds:
    """Keeps the ids of the units met, up to ``most`` of them, from block to block.

    ``inner`` learns units that begin with a safe cut, ``first`` those at the start of a text. ``end`` is the
    id to put after each text, if any.
    """

    def __init__(self, inner: Learn, first: Learn, end: int | None = None, most: int = 1_200_000):
        self.inner, self.first, self.end, self.most = inner, first, end, most
        self._forget()

    def _forget(self) -> None:
        self.places = _Places()
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        fresh, self.places.fresh = self.places.fresh, []
        sizes, parts, done = np.zeros(len(fresh), np.int64), [], []
        for learn, kind in ((self.inner, str), (self.first, tuple)):
            at = [i for i, u in enumerate(fresh) if isinstance(u, kind)]
            if at:
                ids, each = learn([" " + fresh[i] for i in at] if kind is str else [fresh[i][0] for i in at])
                sizes[at] = each
                parts.append(ids)
                done += at
        for i, u in enumerate(fresh):
            if u is None:
                sizes[i] = self.end is not None
                parts.append(np.full(sizes[i], self.end or 0))
                done.append(i)
        begins = np.zeros(len(fresh), np.int64)
        begins[done] = len(self.ids) + np.cumsum(sizes[done]) - sizes[done]
        self.ids = np.concatenate([self.ids, *parts]).astype(np.uint32)
        self.starts, self.sizes = np.concatenate([self.starts, begins]), np.concatenate([self.sizes, sizes])

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        if len(self.places) > self.most:
            self._forget()
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        units, counts = cut_safely(texts)
        counts += 1  # the end
        ends = np.cumsum(counts) - 1
        starts = ends - counts + 1
        at, inner = np.empty(counts.sum(), np.int64), np.ones(counts.sum(), bool)
        inner[starts] = inner[ends] = False
        firsts = starts - np.arange(len(texts))
        at[starts] = [self.places[unit,] for unit in units.take(pa.array(firsts)).to_pylist()]
        at[ends] = self.places[None]
        later = np.ones(len(units), bool)
        later[firsts] = False
        coded = units.filter(pa.array(later)).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        at[inner] = np.fromiter(map(self.places.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        if self.places.fresh:
            self._learn()
        sizes = self.sizes[at]
        before = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(self.starts[at] - before, sizes) + np.arange(sizes.sum())]
        return ids, np.add.reduceat(sizes, starts)
