"""Units of texts: cut as by the pattern, looked up once a block."""

import numpy as np

from quayside.llm import unit_ids

TEXTS = ["", " ", "  ", "one", " one two", "one  two ", "one \ntwo three", "a b a b a", "é 日本 語", "x y  z w", "a\nb c", "tail "]


def learned(units):
    """Each unit's ids are its code points, the space before it included."""
    return np.array([ord(c) for u in units for c in u], np.uint32), np.array([len(u) for u in units], np.int64)


def test_units_are_those_between_safe_cuts():
    for texts in (TEXTS, TEXTS[::-1], [t for t in TEXTS if "  " not in t], [""], ["  "]):
        units, counts = unit_ids.cut_safely(texts)
        found, expected = units.to_pylist(), [unit_ids.SAFE_CUT.split(t) for t in texts]
        assert found == [u for us in expected for u in us] and counts.tolist() == list(map(len, expected))


def test_ids_are_those_of_the_texts():
    for most in (3, 1000):
        units = unit_ids.UnitIds(learned, learned, end=7, most=most)
        for texts in (TEXTS, TEXTS[::-1], [], ["b a", "a new one"]):
            ids, sizes = units.of(texts)
            assert sizes.tolist() == [len(t) + 1 for t in texts]
            assert ids.tolist() == [i for t in texts for i in [*map(ord, t), 7]]


def test_a_unit_is_looked_up_once_a_block():
    class Counted(unit_ids._Places):
        asked = 0

        def __getitem__(self, unit):
            Counted.asked += 1
            return super().__getitem__(unit)

    units = unit_ids.UnitIds(learned, learned)
    units.places = Counted()
    units.of(["one two three two three"] * 100)
    assert Counted.asked <= 2 + 2 * 100
