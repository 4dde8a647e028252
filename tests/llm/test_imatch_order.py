"""I-Match compares each document with the next one within stretches of the order, and fingerprints are shuffled once."""

import pytest
from brute import FIRST

from quayside.llm import imatch


def test_fingerprints_are_shuffled_once(make):
    found = imatch.imatch(make([(i, f"word{i} of document {i % 7}") for i in range(50)]))
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    exchanges = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert len(exchanges) == 1 and "part" in exchanges[0] and "block" in exchanges[0], plan
    assert found.count() == 50


@pytest.mark.parametrize("block", (1, 7, 4096))
def test_every_copy_gets_its_row(make, monkeypatch, block):
    monkeypatch.setattr(imatch, "_BLOCK", block)
    monkeypatch.setattr(imatch, "_COPIES", 3)
    docs = [(i, f"own{i} common words and more{i % 3} of them {i % 5}") for i in range(0, 120, 3)]
    docs += [(6, docs[2][1])] * 6 + [(None, "no id here")] * 10 + [(FIRST, "no id here")] * 4 + [(-5, None), (-5, ""), (200, "")]
    found = imatch.imatch(make(docs)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for i, _ in docs)
    rows = {FIRST if r.doc_id is None else r.doc_id: r for r in found}
    order = sorted(rows)
    assert len({tuple(r)[1:] for r in found}) <= len(order)
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        a, b = rows[i].fingerprint, rows[after].fingerprint
        if a == b or "text:" in a + b:
            want = float(a == b)
        else:
            pairs = [(x, y) for x, y in zip(a.split("."), b.split("."), strict=True) if (x, y) != ("-", "-")]
            want = sum(x == y for x, y in pairs) / max(1, len(pairs))
        assert abs(rows[i].near_next - want) < 1e-12, i
