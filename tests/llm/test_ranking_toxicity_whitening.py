"""Ranked search against brute force, toxicity by held-out accuracy, whitening against a dense eigensolver."""

import math
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import lexical_search, queries, toxicity, whitening

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- ranked search ---------------------------------------------------------------------------------------

def brute_search(docs, items, k=10):
    texts = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n, length = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    df = {}
    for _, w in texts:
        for term in set(w):
            df[term] = df.get(term, 0) + 1
    wanted = {}
    for item, t in items:
        wanted.setdefault(item, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        found = []
        for i, w in texts:
            if w:
                m = 10 + 90 * len(w) * n // length
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms if t in w)
                if score > 0:
                    found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def found_rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("k", "block"), ((10, 8 << 20), (3, 1)))
def test_search_as_brute_force(spark, make, awkward, k, block):
    rng = np.random.default_rng(8)
    common = [f"c{x}" for x in range(12)]
    docs = awkward + [(1000 + i, " ".join(rng.choice(common, rng.integers(1, 40))) + (f" rare{i % 40}" if i % 3 else "")) for i in range(400)]
    docs += [(2000 + i, "tie tie c1 c2") for i in range(30)] + [(50, "tie tie c1 c2"), (None, "tie tie c1 c2")]
    items = [(1, "c1 c2 rare3 Tie"), (2, None), (3, "..."), (4, "absent words only"), (5, "ÄÖÜ äöü 日本語"), (6, "c0 " * 50), (7, "c0 c5"), (7, "rare9"), (None, "the first line"),
             (8, " ".join(f"c{x} rare{x} w{x}" for x in range(90)))]
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS n", "'x' AS terms", "2 AS rank", "3 AS score")
    assert found_rows(lexical_search.search(make(docs), frame, k, block)) == brute_search(docs, items, k)
    assert lexical_search.search(make([]), frame).collect() == [] == lexical_search.search(make(docs), frame.limit(0)).collect()


def test_masks_are_pruned_without_loss():
    rng = np.random.default_rng(3)
    bitmaps = rng.random((70, 900)) < 0.1
    part = np.where(bitmaps, rng.integers(1, 1000, bitmaps.shape), 0)
    weights, ids = rng.integers(0, 50, 70), rng.permutation(900)
    bits, order, starts = lexical_search._masks(bitmaps)
    assert sorted(order) == list(range(900))
    for k in range(bits.shape[1]):
        assert (bitmaps[:, order[starts[k]: starts[k + 1]]] == bits[:, [k]].astype(bool)).all()
    best = lexical_search._Best(10)
    for half in (slice(0, 500), slice(500, 900)):
        lexical_search._evaluate(best, part[:, half], bitmaps[:, half], weights, np.zeros(900, int)[half], ids[half], together=1)
    scores = weights @ part
    assert best.rows[0].tolist() == scores[np.lexsort((ids, -scores))[:10]].tolist()
    assert best.rows[2].tolist() == ids[np.lexsort((ids, -scores))[:10]].tolist()


# --- toxicity --------------------------------------------------------------------------------------------

def test_toxic_words_are_learned(spark, make, awkward):
    rng = np.random.default_rng(9)
    words = [f"w{x}" for x in range(300)]

    def text(toxic):
        w = list(rng.choice(words, rng.integers(5, 200)))
        return " ".join(w[:3] + ["Vile,"] * toxic + w[3:])

    docs = [(i, text(i % 8 == 0)) for i in range(1200)]
    train = make(docs).withColumn("toxic", (F.col("doc_id") % 8 == 0).cast("int"))
    model = toxicity.fit_model(train, shard_rows=300)
    assert 0 < len(model.cells) < 3000 and set(np.diff(model.cells) > 0) == {True}
    fresh = [(i, text(i % 2)) for i in range(400)]
    found = {r.doc_id: r.score for r in toxicity.score(make(fresh), model).collect()}
    assert sum((found[i] >= 0.3) == bool(i % 2) for i in found) >= 390
    scored = toxicity.score(make(awkward).selectExpr("*", "'x' AS cells"), model)
    values = [r.score for r in scored.collect()]
    assert len(values) == len(awkward) and all(0 <= v <= 1 for v in values) and scored.columns[-1] == "score"
    assert len({r.score for r in scored.where("coalesce(text, '') = ''").collect()}) == 1
    assert toxicity.score(make([]), model).collect() == []


def test_labels_that_teach_nothing(make):
    docs = make([(1, "a b"), (2, None)])
    for toxic in ("cast(null as int)", "7"):
        model = toxicity.fit_model(docs.selectExpr("*", f"{toxic} AS toxic"))
        assert [r.score for r in toxicity.score(docs, model).collect()] == [0.5, 0.5]
    assert len(toxicity.fit_model(docs.limit(0).selectExpr("*", "1 AS toxic")).cells) == 0
    ones = toxicity.fit_model(docs.selectExpr("*", "1 AS toxic"))
    assert all(r.score > 0.5 for r in toxicity.score(docs, ones).collect())


def test_features_span_the_whole_text():
    a, b = toxicity.features("One two THREE four"), toxicity.features("one, two three. four")
    assert (a == b).all() and len(a) == 4 + 3 + 2 + 1 + 1
    long = " ".join(f"w{i}" for i in range(5_000))
    assert len(toxicity.features(long + " vile")) > len(toxicity.features(long))
    assert toxicity.features(None).tolist() == toxicity.features(" .!").tolist() == [toxicity.BIAS]


def test_state_follows_the_plain_recurrence():
    """Weights of a single cell by the published update, step by step."""
    state, z, n = toxicity.State(l1=0.5), 0.0, 0.0
    for label in (1, 1, 0, 1, 1, 1):
        w = 0.0 if abs(z) <= 0.5 else -(z - math.copysign(0.5, z)) / ((1 + math.sqrt(n)) / 2 + 1)
        g = 1 / (1 + math.exp(-w)) - label
        z, n = z + g - (math.sqrt(n + g * g) - math.sqrt(n)) / 2 * w, n + g * g
        state.learn(np.array([5]), label)
        assert state.z[5] == pytest.approx(z) and state.n[5] == pytest.approx(n)


def test_toxicity_held_out(spark):
    found = queries.op11_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    kept = found.cache()
    assert kept.count() == docs.count() and dict(kept.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = kept.join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    kept.unpersist()
    assert all(crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    english = [r for r in rows if r.lang == "en" and r.toxic == 1]
    assert sum(r.predicted for r in english) / len(english) > 0.9
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in clean) / len(clean) < 0.02


# --- whitening -------------------------------------------------------------------------------------------

def dense(vectors, k=32):
    x = np.floor(64 * np.array(vectors, float)).astype(int) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    return np.square(n * x - sums).sum(axis=1), (y @ axes[:, :k]) / np.sqrt(values[:k]), values / values.sum()


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(10)
    good = [(i, (rng.normal(size=40) * np.linspace(0.2, 3, 40)).tolist()) for i in range(300)] + [(5, [0.5] * 40), (5, [0.5] * 40), (None, [0.1] * 40)]
    bad = [(900, None), (901, [None] + [0.0] * 39), (902, [float("nan")] * 40), (903, [float("inf")] + [1.0] * 39), (904, []), (905, [1.0] * 39)]
    frame = spark.createDataFrame(bad[:3] + good + bad[3:], "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "'x' AS x", "2 AS component").repartition(5)
    found = whitening.whiten(frame).toPandas()
    single = [(i, np.array(v, np.float32)) for i, v in good]
    deviation, want, explained = dense([v for _, v in single])
    assert len(found) == 32 * len(good) and set(found.n) == {len(good)} and found.identity_error.max() < 1e-12
    known = found[found.vec_id.notna() & (found.vec_id != 5)].pivot(index="vec_id", columns="component", values="whitened")
    place = {i: k for k, (i, _) in enumerate(good)}
    want_known = want[[place[int(i)] for i in known.index]]
    signs = np.sign((known.to_numpy() * want_known).sum(axis=0))
    assert np.abs(known.to_numpy() * signs - want_known).max() < 1e-9
    assert sorted(found[found.component == 1].deviation) == sorted(deviation)
    shares = found.drop_duplicates("component").set_index("component").explained.sort_index()
    assert np.abs(shares.to_numpy() - explained[:32]).max() < 1e-12
    assert len(found[found.vec_id == 5]) == 3 * 32 and found.vec_id.isna().sum() == 32


@pytest.mark.parametrize("rows", ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() == []


def test_whitening_of_few_dimensions_and_huge_entries(spark):
    rows = [(1, [0.0, 0.0, 7.0]), (2, [1.0, 0.0, 7.0]), (3, [0.0, 2.0, 7.0]), (4, [1e300, 0.0, 7.0])]
    found = whitening.whiten(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in found} == {1, 2} and all(abs(r.identity_error) < 1e-9 for r in found)
    huge = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in huge if r.vec_id == 4} == {None} and {r.component for r in huge} == {1}


@pytest.mark.parametrize(("size", "spread"), ((64, 1.0), (300, 30.0), (300, 1.0), (7, 2.0)))
def test_eigenpairs(size, spread):
    rng = np.random.default_rng(size)
    q = np.linalg.qr(rng.normal(size=(size, size)))[0]
    values = np.sort(rng.uniform(1, 1 + spread, size))[::-1]
    values[1] = values[0]  # a double eigenvalue
    matrix = q * values @ q.T
    got, vectors = whitening.leading_pairs(lambda block: matrix @ block, size, 32)
    k = min(32, size)
    assert got.shape == (k,) and np.abs(got - values[:k]).max() < 1e-12 * values[0]
    assert np.linalg.norm(matrix @ vectors - vectors * got, axis=0).max() < 1e-12 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_minres_solves():
    rng = np.random.default_rng(1)
    matrix = np.diag(rng.choice([-3.0, 1.0, 2.0, 5.0], 50))
    right = rng.normal(size=(50, 3))
    assert np.abs(matrix @ whitening.minres(lambda x: matrix @ x, right, 6) - right).max() < 1e-10
    assert (whitening.minres(lambda x: matrix @ x, np.zeros((50, 2)), 3) == 0).all()
