"""I-Match likeness of edited texts of every length and of rare languages."""

import numpy as np
import xxhash
from brute import FIRST

from quayside.llm import imatch


def likenesses(docs):
    found = imatch.imatch(docs).collect()
    return {r.doc_id: (r.near_edited, r.near_next) for r in found}


def test_a_text_of_over_a_megabyte(make):
    rng = np.random.default_rng(21)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40_000, 300))) for i in range(600)]
    docs += [(1000 + i, " ".join(f"w{x}" for x in rng.integers(0, 40_000, 200_000))) for i in range(3)]
    assert all(len(t) > 1_000_000 for i, t in docs if i >= 1000)
    found = likenesses(make(docs, clashing=False))
    assert all(found[1000 + i][0] > 0.1 for i in range(3))
    assert sum(found[i][0] > found[i][1] for i in range(600)) >= 594


def test_rare_languages_and_short_texts(make):
    rng = np.random.default_rng(22)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 500, 60))) for i in range(1500)]
    docs += [(5000, " ".join(f"ж{x}" for x in range(80))), (5001, " ".join(f"λ{x}" for x in range(120)))]
    short = {6000 + i: " ".join(f"w{x}" for x in rng.integers(0, 500, 12)) for i in range(60)}
    found = likenesses(make([*docs, *short.items()], clashing=False))
    assert all(found[i][0] > found[i][1] for i in (5000, 5001))
    above = sum(found[i][0] > found[i][1] for i in short)
    assert above >= 57


def words_of(text):
    import regex

    return list(dict.fromkeys(regex.findall(r"[\p{L}\p{N}]+", text.lower())))


def term_hash(word):
    return signed(xxhash.xxh64_intdigest(word.encode(), 42))


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chained(*longs, seed=42):
    """Hashes of several longs as Spark makes them: each with the one before as seed."""
    for x in longs:
        seed = xxhash.xxh64_intdigest((x % 2**64).to_bytes(8, "little"), seed)
    return seed


def lane_hash(term, lane):
    """The lane is hashed as a 32-bit integer, after the term."""
    return signed(xxhash.xxh64_intdigest(lane.to_bytes(4, "little"), chained(term)))


def token(terms):
    return f"{chained(*terms):016x}"[:8]


def brute_fingerprint(text, common):
    terms = [term_hash(w) for w in words_of(text)]
    rare = [t for t in terms if t not in common]
    tokens = [token(sorted(rare)) if 0 < len(rare) <= 4 else "-"]
    for lane in range(imatch.LANES):
        hashes = sorted(lane_hash(t, lane) for t in (rare if lane < imatch.RARE_LANES else terms))
        for scale in range(1, imatch.SCALES + 1):
            inside = [h for h in hashes if h + 2**63 < 2 ** (64 - scale)]
            tokens.append(token(inside) if 0 < len(inside) <= 4 else "-")
    if set(tokens) == {"-"}:
        return f"text:{xxhash.xxh64_intdigest(text.encode(), 42):016x}"
    return ".".join(tokens)


def brute_likeness(a, b):
    if a == b:
        return 1.0
    if "text:" in a + b:
        return 0.0
    pairs = [(x, y) for x, y in zip(a.split("."), b.split("."), strict=True) if (x, y) != ("-", "-")]
    return sum(x == y for x, y in pairs) / max(1, len(pairs))


def test_fingerprints_as_brute_force(make, awkward):
    rng = np.random.default_rng(23)
    docs = {}
    for i, t in awkward:
        docs.setdefault(FIRST if i is None else i, t or "")
    docs |= {100 + i: " ".join(f"q{x}" for x in rng.integers(0, 60 * (1 + i), int(rng.integers(1, 30 * (1 + i % 9))))) + " the of" for i in range(60)}
    order = sorted(docs)
    held = {}
    for t in docs.values():
        for w in words_of(t):
            held[w] = held.get(w, 0) + 1
    common = {term_hash(w) for w, n in held.items() if n > 0.1 * len(docs)}
    assert common
    for r in imatch.imatch(make([(None if i == FIRST else i, t) for i, t in docs.items()])).collect():
        own = FIRST if r.doc_id is None else r.doc_id
        text, following = docs[own], docs[order[(order.index(own) + 1) % len(order)]]
        m = len(text) // 4
        prints = [brute_fingerprint(t, common) for t in (text, text[: len(text) - m] + following[:m], following)]
        assert [r.fingerprint, r.edited_fingerprint] == prints[:2], own
        assert abs(r.near_edited - brute_likeness(*prints[:2])) < 1e-12 and abs(r.near_next - brute_likeness(prints[0], prints[2])) < 1e-12


def test_few_and_many_rare_terms_follow_one_rule(make):
    """30 common terms and 2 to 13 own ones, which come first: no number of own terms makes an edit unrelated."""
    common = [f"c{k}" for k in range(30)]
    docs = [(i, " ".join([f"own{i}x{k}" for k in range(2 + i % 12)] + common)) for i in range(120)]
    found = likenesses(make(docs, clashing=False))
    means = [np.mean([found[i][0] for i in found if i % 12 == own]) for own in range(12)]
    assert min(means) > 0.2, means
