"""Every operator against brute force, on awkward rows and on empty tables."""

import base64
import hashlib
import io
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from brute import FIRST, brute_components, brute_lines, brute_print, brute_repeats, rows, shingle_set
from pyspark.sql import functions as F

from quayside.llm import bpe, decontaminate, golay_simhash, imatch, language_id, line_dedup, sharding, suffix_dedup, token_store, unit_ids, warc

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


# --- language ----------------------------------------------------------------------------------

def test_language_id(spark, make, awkward):
    words = {"en": "the and thing", "de": "der und ßen", "fr": "le été que", "es": "el ñan que"}
    train = [(i, " ".join(words[lang].split()[j % 3] for j in range(i % 7, i % 7 + 12)), lang) for i, lang in enumerate(list(words) * 20)]
    model = language_id.fit_model(make(train))
    assert model.families == [["de", "en"], ["es", "fr"]]
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(make(awkward), model).collect()}
    assert len(language_id.identify(make(awkward), model).collect()) == len(awkward)
    assert all(found[i] == ("und", 0.0) for i in (2, 3, 4, 8)) and found[9][0] in words and found[7] == found[1]
    right = [language_id.Model.predict(model, t)[0] == lang for _, t, lang in train]
    assert sum(right) / len(right) > 0.95
    empty = language_id.fit_model(make([(1, "text")]))
    assert [r.lang_pred for r in language_id.identify(make([(1, "text")]), empty).collect()] == ["und"]
    assert language_id.identify(make([]), model).collect() == []
    one = language_id.fit_model(make([(1, "text", "xx"), (2, "other", "xx")]))
    assert language_id.identify(make([(3, "text")]), one).first().lang_pred == "xx"


def test_held_out_accuracy(spark):
    from quayside.llm.queries import op1_language_id

    found = op1_language_id(spark, "/root/testdata/sf0.001").where("held_out").join(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.95


# --- lines -------------------------------------------------------------------------------------

@pytest.mark.parametrize("hot", (4, 0))
def test_line_dedup(make, awkward, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "_HOT", hot)
    many = awkward + [(100 + i, f"a line that very many hold\nown line number {i}\n" * (1 + i % 3)) for i in range(300)]
    found = line_dedup.dedup_lines(make(many), n_lines="lines", n_dropped="dropped")
    assert rows(found.select("doc_id", "text", "lines", "dropped")) == brute_lines(many)
    assert found.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert line_dedup.dedup_lines(make([])).collect() == []


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 5000):
        hi, lo = (rng.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
        index = line_dedup.PerfectHash.of(hi, lo).index(hi, lo)
        assert sorted(index.tolist()) == list(range(n))


def test_shards_are_built_one_by_one(make):
    docs = [(i, f"a long enough line {i % 700}") for i in range(1500)]
    lines = make(docs).select(F.col("doc_id").alias("doc"), F.xxhash64(F.lit(1), "text").alias("hi"), F.xxhash64("text").alias("lo"))
    index = line_dedup.line_index(lines, shard_keys=50).collect()
    assert len(index) > 4 and sum(r.keys for r in index) == 700


# --- fingerprints ------------------------------------------------------------------------------

def test_imatch(make, awkward):
    found = imatch.imatch(make(awkward)).collect()
    assert len(found) == len(awkward)
    unique = sorted({(FIRST if i is None else i, t or "") for i, t in awkward}, key=lambda r: r[0])
    place = {}
    for i, t in unique:
        place.setdefault(i, []).append(t)
    alone = [i for i, texts in place.items() if len(texts) == 1]
    order = [i for i, _ in unique]
    for r in found:
        own = FIRST if r.doc_id is None else r.doc_id
        after = order[(order.index(own) + 1) % len(order)]
        if own in alone and after in alone:
            text, following = place[own][0], place[after][0]
            m = len(text) // 4
            edited = text[: len(text) - m] + following[:m]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {r.doc_id: r.fingerprint for r in found}
    assert prints[1] == prints[7] != prints[6] and prints[2] == prints[3]
    assert imatch.imatch(make([])).collect() == []
    single = imatch.imatch(make([(1, "only one here")])).first()
    assert single.near_next == 1.0


def test_likeness(spark):
    a, b, c = "x.y.-.-", "x.z.-.q", "text:1"
    pairs = spark.createDataFrame([(a, b), (a, a), (a, c), (c, c), (c, "text:2")], "a string, b string")
    assert [r[0] for r in pairs.select(imatch.likeness(F.col("a"), F.col("b"))).collect()] == [1 / 3, 1.0, 0.0, 1.0, 0.0]


# --- near duplicates ---------------------------------------------------------------------------

def test_simhash(make, awkward):
    assert all(golay_simhash.simhash(t) == brute_print(t) for _, t in awkward)
    near = awkward + [(200 + i, " ".join(f"w{k}" for k in range(400) if k != i)) for i in range(25)]
    found = golay_simhash.near_duplicates(make(near)).collect()
    named = {i: brute_print(t) for i, t in near if i is not None}
    want = brute_components(named)
    assert len(found) == len(near)
    assert all(r.component_id == want[r.doc_id] and r["print"] % 2**64 == named[r.doc_id] for r in found if r.doc_id is not None)
    kept = {r.doc_id for r in golay_simhash.without_near_duplicates(make(near)).collect() if r.doc_id is not None}
    assert kept == set(want.values())
    assert golay_simhash.near_duplicates(make([])).collect() == []


@pytest.mark.parametrize("most", (32, 1))
def test_no_link_is_lost(spark, most):
    rng = np.random.default_rng(3)
    prints = set()
    for base in rng.integers(0, 2**63, 12).tolist():
        for _ in range(60):
            x = base
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << bit
            prints.add(x)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    edges = golay_simhash.links(spark.createDataFrame(signed, "print long"), most=most)
    assert all(((a ^ b) % 2**64).bit_count() <= 2 for a, b in edges.collect())
    root = {r.node: r.root for r in golay_simhash.connected(edges).collect()}
    groups = {}
    for (p,) in signed:
        groups.setdefault(root.get(p, p), set()).add(p)
    want = {}
    for p, r in brute_components({p: p % 2**64 for (p,) in signed}).items():
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**63, 3000).astype(np.uint64)
    flipped = prints ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    assert all(set(a) & set(b) for a, b in zip(golay_simhash.fuzzy_keys(prints), golay_simhash.fuzzy_keys(flipped), strict=True))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    assert {r.node: r.root for r in golay_simhash.connected(edges).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# --- repeated strings --------------------------------------------------------------------------

@pytest.mark.parametrize("full", (4096, 2))
def test_repeated_strings(make, awkward, monkeypatch, full):
    monkeypatch.setattr(suffix_dedup, "_FULL", full)
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdefgh "))
    passage = "".join(rng.choice(letters, 260))
    more = [(300 + i, "".join(rng.choice(letters, rng.integers(0, 90))) + passage[i % 5: 150 + i * 4] + "".join(rng.choice(letters, 80))) for i in range(40)]
    more += [(400, "a" * 1000), (401, "ab" * 300), (402, "é" * 120 + passage), (403, passage[:99]), (404, passage[:100])]
    docs = [r for r in awkward if r[0] is not None or r[1] is not None] + more
    found = suffix_dedup.remove_repeats(make(docs))
    assert rows(found.select("doc_id", F.col("kept"), "n_bytes", "n_removed", "n_spans")) == sorted(
        [(i, bytearray(k), n, r, s) for i, k, n, r, s in brute_repeats(docs)], key=repr)
    assert suffix_dedup.remove_repeats(make([])).collect() == []


def test_a_long_text_after_small_ones(make):
    rng = np.random.default_rng(12)
    letters = rng.integers(97, 123, (17 << 20) + 5000, dtype=np.uint8).tobytes().decode()
    small = [(i, letters[i << 17: (i + 1) << 17]) for i in range(15)]
    text = letters[2 << 20:][: (15 << 20) - 1000]
    passage = letters[-4000:-3500]
    docs = [*small, (99, passage + text[500:-500] + passage)]
    found = suffix_dedup.remove_repeats(make(docs, clashing=False).coalesce(1)).where("doc_id = 99").first()
    assert (found.n_removed, found.n_spans) == (500, 1) and bytes(found.kept) == (passage + text[500:-500]).encode()


def test_many_texts_without_an_id(make):
    rng = np.random.default_rng(13)
    letters = np.array(list("abcdefgh "))
    passage = "".join(rng.choice(letters, 200))
    docs = [(None if i % 2 else 7, "".join(rng.choice(letters, 220)) + (passage if i % 10 == 0 else "")) for i in range(4000)]
    for own in (7, None):  # tags of 18 bits would not tell these texts apart
        texts = [t for i, t in docs if i == own]
        assert len({xxhash.xxh64_intdigest(t.encode(), 42) % 2**18 for t in texts}) < len(texts)
    docs = [(1, passage), *docs]
    found = suffix_dedup.remove_repeats(make(docs)).select("doc_id", "kept", "n_bytes", "n_removed", "n_spans")
    assert rows(found) == sorted([(i, bytearray(k), n, r, s) for i, k, n, r, s in brute_repeats(docs)], key=repr)


def test_places_in_a_run_fit_their_bits():
    docs = [(i, 0, b"x" * ((2 << 20) - 1)) for i in range(1)] + [(5, 0, b"y" * (15 << 20)), (6, 0, b"z" * (40 << 20))]
    runs = list(suffix_dedup._pieces(docs, 100))
    assert all(len(data) < 1 << 24 for data, _ in runs)
    assert {p[0] for _, parts in runs for p in parts} == {0, 5, 6}


def test_difference_cover():
    cover, shift = suffix_dedup.difference_cover(32)
    assert {(a - b) % 32 for a in cover for b in cover} == set(range(32)) and len(cover) == 7
    assert all((a + shift[a, b]) % 32 in cover and (b + shift[a, b]) % 32 in cover for a in range(32) for b in range(32))


def test_equal_strings_by_the_cover():
    rng = np.random.default_rng(4)
    for trial in range(20):
        base = rng.integers(0, 3 if trial % 2 else 256, 500, dtype=np.uint8)
        parts = [base[a: a + 250].copy() for a in rng.integers(0, 250, 6)]
        for part in parts[::2]:
            part[rng.integers(0, 250)] ^= 1
        data = np.concatenate([*parts, np.zeros(400, np.uint8), np.tile(base[:7], 60), np.zeros(200, np.uint8)])
        starts = rng.permutation(len(data) - 300)[:500]
        raw, classes = data.tobytes(), suffix_dedup.equal_strings(data, starts, 100)
        texts = [raw[s: s + 100] for s in starts]
        assert len(set(zip(classes.tolist(), texts, strict=True))) == len(set(texts)) == len(set(classes.tolist()))


# --- benchmark ---------------------------------------------------------------------------------

@pytest.mark.parametrize("most", (200_000, 0))
def test_decontamination(spark, make, awkward, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    item = " ".join(f"item{k}" for k in range(30))
    items = [(1, item), (2, None), (3, "too short"), (4, item.upper()), (5, "w1 w2 w3 w4 w5"), (None, "x1 y2 z3 q4 r5 s6"), (6, " ".join(f"b{k}" for k in range(7)))]
    docs = awkward + [
        (500, f"before, {item}; after"), (501, " ".join(item.split()[:26])), (502, " ".join(item.split()[:20])), (503, "q " * 3000 + item + " r" * 3000),
        (504, "x1 y2 z3 q4 r5 s6"), (505, "b0 b1 b2 b3 b4 b5"), (506, item), (506, "nothing of it"),
    ]
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS hash", "2 AS n")
    found = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contained_items(make(docs), frame).collect()}
    want = {}
    for d, t in docs:
        for i, x in items:
            s = shingle_set(x)
            if s and (c := len(s & shingle_set(t)) / len(s)) >= 0.8:
                want[d, i] = max(c, want.get((d, i), 0))
    assert found == pytest.approx(want)
    kept = decontaminate.without_contamination(make(docs), frame)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.contained_items(make([]), frame).collect() == []
    assert decontaminate.contained_items(make(docs), frame.limit(0)).collect() == []
    assert decontaminate.contamination(make(docs), frame).count() == len(docs)


def test_a_sketch_misses_no_pair(spark):
    items = spark.createDataFrame([(n, " ".join(f"t{n}_{k}" for k in range(n + 4))) for n in range(1, 60)], "item_id long, text string")
    parts = decontaminate.item_shingles(items, 5)
    sizes = {r.item_id: r.n for r in parts.select("item_id", "n").distinct().collect()}
    kept = {r.item_id: r["count"] for r in decontaminate.sketches(parts, 0.8).groupBy("item_id").count().collect()}
    assert all(kept[i] > n - -(-n * 8 // 10) for i, n in sizes.items())


# --- tokens ------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_tiktoken(make, awkward, tiktoken_encoding):
    docs = awkward + [(600, "  x  \n y \t z  "), (601, "<|endoftext|> 's 're DON'T"), (602, "日本語テキスト" * 60), (603, "a" * 700), (604, "\x1c \x85 \xa0x  "), (605, "😀 😀😀")]
    found = bpe.encode_and_decode(make(docs), MULTI, public_tokenizers.PATTERN).collect()
    want = sorted(((i, struct.pack(f"<{len(x)}I", *x), (t or "").encode()) for i, t in docs for x in [tiktoken_encoding.encode_ordinary(t or "")]), key=repr)
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in found), key=repr) == want
    assert bpe.encode_and_decode(make([]), MULTI, public_tokenizers.PATTERN).collect() == []


def test_token_files(spark, make, awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    docs = awkward + [(700, "<|endoftext|> a  b \n c"), (701, " lead"), (702, "x <|endoftext|> y"), (703, "x \n <|endoftext|>  <|endoftext|>y" * 40), (704, "<|endoftext|")]
    manifest = token_store.write_tokens(make(docs), JSON, end_id=0, part_bytes=60_000)
    found = token_store.read_tokens(manifest).orderBy("start").collect()
    assert manifest.count() > 2 and len(found) == len(docs)
    want, start = {}, 0
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.setdefault(i, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    order = [r.doc_id for r in found]
    assert order == sorted(order, key=lambda i: FIRST if i is None else i)
    for r in found:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens
    assert token_store.read_tokens(token_store.write_tokens(make([]), JSON)).collect() == []


@pytest.mark.parametrize("width", (3, 8, 16))
def test_directly_addressable_codes(width):
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 2**k, 900) for k in (1, 8, 16, 31)]).astype(np.uint32)
    rng.shuffle(ids)
    store = io.BytesIO()
    token_store.write_file(store, [4, None], np.array([3000, 600]), token_store.Codes.of(ids, width))
    store.seek(0)
    doc_ids, lengths, codes = token_store.read_file(store)
    assert doc_ids == [4, None] and lengths.tolist() == [3000, 600]
    at = rng.integers(0, len(ids), 700)
    assert (codes.at(at) == ids[at]).all() and (codes.at(np.arange(len(ids))) == ids).all()
    for a, b in ((0, len(ids)), (0, 0), (511, 513), (1000, 2777)):
        assert (codes.run(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        codes.at(np.array([len(ids)]))
    with pytest.raises(ValueError):
        token_store.read_file(io.BytesIO(b"something else"))
    assert token_store.Codes.of(np.zeros(0, np.uint32)).run(0, 0).tolist() == []


def test_units_are_forgotten_without_harm():
    units = token_store.library_ids(JSON, None).units
    small = unit_ids.UnitIds(units.inner, units.first, most=3)
    texts = ["a b c d", "a  b", "", "x y z w"]
    for _ in range(3):
        assert small.of(texts)[0].tolist() == units.of(texts)[0].tolist()


# --- archives ----------------------------------------------------------------------------------

def test_warc(spark):
    pages = [(5, "http://a", "same"), (2, "http://b\r\nEvil: 1", "same"), (9, None, None), (8, "u", ""), (None, "u", "same"), (None, "u", "alone"), (2, "again", "same"),
             (3, "long", "é\r\n\r\n" * 200_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "'x' AS payload")
    found = warc.read_archives(warc.archive_pages(frame, file_bytes=2000)).collect()
    assert len(found) == len(pages) and all(r.digests_hold for r in found)
    assert len({r.record_id for r in found}) == len(pages) and all(r.record_id.startswith("urn:uuid:") for r in found)
    first = {"same": 2, "": 8}
    want = sorted(((
        i, "revisit" if (h or "") in first and first[h or ""] != i else "response", first[h or ""] if (h or "") in first and first[h or ""] != i else None,
        len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in pages), key=repr)
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in found), key=repr) == want
    assert {r.html for r in found if r.record_type == "response"} == {"same", "", "alone", pages[-1][2]}
    short = warc.read_archives(warc.archive_pages(frame, min_bytes=5)).collect()
    assert {r.record_type for r in short} == {"response"}
    assert warc.read_archives(warc.archive_pages(frame.limit(0))).collect() == []


def test_archives_of_others(spark, tmp_path):
    import gzip

    def record(kind, block, *headers):
        head = "".join(f"{h}\r\n" for h in ("WARC/1.0", f"WARC-Type: {kind}", *headers, f"Content-Length: {len(block)}"))
        return gzip.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n")

    response = b"HTTP/1.1 200 OK\r\n\r\nbody"
    (tmp_path / "a.warc.gz").write_bytes(
        record("warcinfo", b"software: other", "WARC-Record-ID: <urn:uuid:1>") + record("response", response, "WARC-Record-ID: <urn:uuid:2>", "WARC-Target-URI: http://x")
        + record("revisit", b"", "WARC-Record-ID: <urn:uuid:3>", "WARC-Refers-To: <urn:uuid:2>") + record("response", response, "WARC-Payload-Digest: sha1:AAAA"))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")
    found = warc.read_archives(manifest).orderBy("offset").collect()
    digest = warc.base32_sha1(b"body")
    assert [(r.record_id, r.page_id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.digests_hold, r.html) for r in found] == [
        ("urn:uuid:2", None, "http://x", "response", 4, digest, True, "body"), ("urn:uuid:3", None, None, "revisit", None, None, True, None),
        ("", None, None, "response", 4, "AAAA", False, "body")]


def test_broken_archives_are_refused():
    member = warc.record_member([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + warc.base32_sha1(b"body"))], b"HTTP/1.1 200 OK\r\n\r\nbody")
    good = list(warc.read_records(io.BytesIO(member * 3)))
    assert [r.payload() for r in good] == [b"body"] * 3 and all(r.digests_hold() for r in good) and good[1].offset == len(member)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(member[:-9])))
    changed = warc.record_member([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + warc.base32_sha1(b"else"))], b"HTTP/1.1 200 OK\r\n\r\nbody")
    assert not next(warc.read_records(io.BytesIO(changed))).digests_hold()
    raw = zlib.decompress(member, 31).replace(b"Content-Length: 23", b"Content-Length: 20")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(packer.compress(raw) + packer.flush())))


# --- shards ------------------------------------------------------------------------------------

@pytest.mark.parametrize("limit", (700, 10**9, 1))
def test_sharding(make, awkward, limit):
    docs = awkward + [(800 + i, "x" * (i % 90)) for i in range(400)]
    found = sharding.with_shards(make(docs).select("doc_id", "text"), limit).collect()
    assert len(found) == len(docs)
    size, keys, hashes = {}, {}, {}
    for r in found:
        bits = format(int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16), "060b")
        assert bits.startswith(r.shard) and len(r.shard) == r.depth
        size[r.shard] = size.get(r.shard, 0) + len((r.text or "").encode())
        keys.setdefault(r.shard, set()).add(r.doc_id)
        hashes[bits] = hashes.get(bits, 0) + len((r.text or "").encode())
    assert all(size[r.shard] == r.shard_bytes for r in found)
    assert all(n <= limit or len(keys[s]) == 1 for s, n in size.items())
    for s in size:  # no shard was split off a bucket that fits
        assert not s or sum(n for b, n in hashes.items() if b.startswith(s[:-1])) > limit
    assert sharding.with_shards(make([]).select("doc_id", "text"), limit).collect() == []


def test_written_shards(spark, make, tmp_path):
    docs = make([(i, "y" * 50) for i in range(100)] + [(7, "z" * 900), (7, "z" * 900), (None, "n" * 3000), (200, None)])
    sharding.write_shards(docs, str(tmp_path / "s"), 1000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 104
    columns = ["doc_id", "shard", "depth", "shard_bytes", "shard_rows"]
    assert rows(sharding.read_shards(docs, str(tmp_path / "s"))) == rows(sharding.with_shards(docs.select("doc_id", "text"), 1000).select(columns))
    sharding.write_shards(docs, str(tmp_path / "one"), 10**9)
    assert {(r.shard, r.depth, r.shard_rows) for r in sharding.read_shards(docs, str(tmp_path / "one")).collect()} == {("", 0, 104)}
    sharding.write_shards(make([]), str(tmp_path / "none"), 1000)
    assert sharding.read_shards(docs, str(tmp_path / "none")).collect() == []
