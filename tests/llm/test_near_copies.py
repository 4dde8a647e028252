"""The pipeline's near copies against all pairs, and what the 2-bit rule would leave."""

import sys
from pathlib import Path

import numpy as np
import pytest
from brute import survivors

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from quayside.llm import golay_simhash, near_copies  # noqa: E402


def edited(rng, words, edits):
    out = list(words)
    for at in rng.choice(len(out), edits, replace=False):
        out[at] = f"e{rng.integers(1 << 30)}"
    return " ".join(out)


def test_stage_drops_edited_copies(spark, make):
    rng = np.random.default_rng(5)
    docs = []
    for base in range(25):
        words = [f"v{x}" for x in rng.integers(0, 900, 40 + 12 * base)]
        docs += [(10 * base + k, edited(rng, words, k * len(words) // 90)) for k in range(4)]
    docs += [(900, None), (901, ""), (902, "a b c d e f g h"), (903, "a b c d e f g h i"), (904, "one"), (905, "One ")]
    prints = {i: golay_simhash.simhash(t) for i, t in docs}
    assert sum((prints[10 * b] ^ prints[10 * b + 1]).bit_count() > 2 for b in range(25)) > 10
    want = survivors(docs)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, make(docs), "").collect()} == want
    assert len(want) < len(docs) - 25


@pytest.mark.parametrize(("small", "block", "rounds"), ((8, 1000, 6), (2, 5, 6), (1, 7, 1), (0, 3, 0)))
def test_a_large_group_keeps_one(make, monkeypatch, small, block, rounds):
    for name, value in (("SMALL", small), ("BLOCK", block), ("ROUNDS", rounds)):
        monkeypatch.setattr(near_copies, name, value)
    rng = np.random.default_rng(6)
    words = [f"v{x}" for x in range(300)]
    docs = [(i, edited(rng, words, 3)) for i in range(120)] + [(500 + i, edited(rng, [f"u{i}x{k}" for k in range(60)], 1) + " " + " ".join(words[:12])) for i in range(60)]
    found = near_copies.groups_of_copies(make(docs)).collect()
    roots = {r.doc_id: r.root for r in found}
    assert len({roots[i] for i in range(120)}) == 1
    assert len(set(roots.values())) == 61


def test_texts_made_of_common_blocks(make):
    """600 pairs at a similarity of 0.8 or more among texts that all share their blocks with hundreds of others."""
    rng = np.random.default_rng(7)
    blocks = [" ".join(f"b{i}w{k}" for k in range(60)) for i in range(80)]
    docs = []
    for i in range(600):
        own = list(rng.choice(80, 20, replace=False))
        docs += [(2 * i, " ".join(blocks[b] for b in own)), (2 * i + 1, " ".join(blocks[b] for b in rng.permutation(own)))]
    sets = {i: near_copies.shingles(t, 5) for i, t in docs}
    alike = [i for i in range(600) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1])]
    assert len(alike) > 550
    roots = {r.doc_id: r.root for r in near_copies.groups_of_copies(make(docs, clashing=False)).collect()}
    assert sum(roots[2 * i] == roots[2 * i + 1] for i in alike) >= 0.99 * len(alike)
    assert len(set(roots.values())) >= 600


def test_hashes_stand_for_shingles():
    for text in (None, "", "a", "a b c d", "a b c d e", "a b c d e f g", "x " * 3000, "a b c d e a b c d e"):
        assert len(near_copies.shingle_hashes(text, 5)) == len(near_copies.shingles(text, 5))
    assert near_copies.shingle_hashes("A b", 5).tolist() == near_copies.shingle_hashes("a  B", 5).tolist() != near_copies.shingle_hashes("b a", 5).tolist()
    many = near_copies.shingle_hashes(" ".join(f"w{k}" for k in range(5000)), 5)
    assert near_copies.band_keys(many).tolist() == near_copies.band_keys(many[::-1]).tolist()


def test_rows_without_or_with_equal_ids(make):
    long = " ".join(f"w{k}" for k in range(100))
    other = " ".join(f"x{k}" for k in range(100))
    docs = [(None, long), (7, long), (7, other), (None, other + " end"), (None, "alone"), (None, "alone"), (8, "x y")]
    kept = sorted(((r.doc_id, r.text) for r in near_copies.without_near_copies(make(docs)).collect()), key=repr)
    assert kept == sorted([(7, long), (7, other), (None, "alone"), (8, "x y")], key=repr)


def test_fingerprints_give_candidates(spark, make, monkeypatch):
    """Every pair of at most two differing bits is reached by candidates from SimHash and Golay keys alone."""
    rng = np.random.default_rng(8)
    docs = []
    for base in range(30):
        words = [f"v{x}" for x in rng.integers(0, 900, 400)]
        docs += [(10 * base + k, edited(rng, words, k)) for k in range(3)]
    prints = np.array([golay_simhash.simhash(t, 5) for _, t in docs], np.uint64)
    rows = [(i, 400, int(p)) for i, p in enumerate(prints.view(np.int64))]
    found = near_copies.simhash_pairs(spark.createDataFrame(rows, "node long, n long, print long"))
    reached = {frozenset((r.a, r.b)) for r in found.collect()}
    close = {frozenset((i, j)) for i in range(90) for j in range(i) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 2}
    assert len(close) > 5 and reached <= close

    def groups(pairs):
        root = list(range(90))
        for _ in range(90):
            for a, b in map(tuple, pairs):
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert groups(reached) == groups(close)
    used = []
    monkeypatch.setattr(near_copies, "links", lambda *args: used.append(args) or golay_simhash.links(*args))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, make(docs), "").collect()} == survivors(docs)
    assert len(used) == 1
