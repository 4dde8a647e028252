"""Brute-force versions that tests hold operators and stages against."""

import regex
import xxhash

FIRST = -(2**63)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def line_key(line):
    return line.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute_lines(docs):
    held = {}
    for i, t in docs:
        for key in {line_key(x) for x in (t or "").split("\n")}:
            held.setdefault(key, set()).add(FIRST if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        own = FIRST if i is None else i
        kept = [x for x in lines if not (len(line_key(x)) >= 10 and len(held[line_key(x)]) > 1 and min(held[line_key(x)]) != own)]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k: k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: {node: fingerprint}; the smallest node reachable through pairs that differ in two bits at most."""
    root = {n: n for n in prints}
    nodes = sorted(prints)
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def brute_repeats(docs, length=100):
    """Rows of one id are one document: a string starts earlier in another of them only at a smaller offset."""
    first, out = {}, []
    cut = [(i, FIRST if i is None else i, (t or "").encode()) for i, t in docs]
    for _, own, data in cut:
        for p in range(len(data) - length + 1):
            s = data[p: p + length]
            first[s] = min(first.get(s, (own, p)), (own, p))
    for i, own, data in cut:
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p: p + length]] < (own, p):
                gone[p: p + length] = b"\1" * length
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, bytes(c for c, g in zip(data, gone, strict=True) if not g), len(data), sum(gone), runs))
    return sorted(out, key=repr)


def word_shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k: k + size]) for k in range(max(1, len(words) - size + 1))}


def shingle_set(text, size=5):
    w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return {" ".join(w[k: k + size]) for k in range(len(w) - size + 1)}


def survivors(docs, similarity=0.8):
    """The smallest ids of the groups that pairs with a Jaccard similarity of word shingles link; every pair with a common shingle is compared."""
    sets = {i: word_shingles(t) for i, t in docs}
    root, holders = {i: i for i in sets}, {}
    for i, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, own in sets.items():
        for b in {b for s in own for b in holders[s] if b > a}:
            common = len(own & sets[b])
            if common >= similarity * (len(own) + len(sets[b]) - common) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in sets}
