"""The driver lays out the sample's features once, and fitting makes no further copies of them."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quayside.llm import language_id


def sample(n, seed=5):
    rng = np.random.default_rng(seed)
    words = ["".join(map(chr, 97 + rng.integers(0, 26, 6))) for _ in range(400)]
    langs = [("fr", "ja", "en", "de")[i % 4] for i in range(n)]
    texts = [" ".join(rng.choice(words[100 * (i % 4):][:200], 30)) for i in range(n)]
    return langs, texts


def test_rows_are_those_of_all_cells_in_the_order_of_their_bytes():
    langs, texts = sample(120)
    texts[5:8], texts[9] = texts[:3], "12 !"
    batch = pa.RecordBatch.from_pydict({"lang": langs, "text": texts})
    found = [tuple(r.values()) for out in language_id._featured(iter([batch])) for r in out.to_pylist()]
    got, rows = language_id._matrix(found)
    dense = sorted((lang, x.tobytes()) for lang, t in zip(langs, texts, strict=True) if (x := language_id.features(t)) is not None)
    assert got == [lang for lang, _ in dense] and not found
    assert rows[:, :-1].astype("<f4").tobytes() == b"".join(x for _, x in dense) and (rows[:, -1] == 1).all()


def test_fitting_copies_only_the_rows_of_a_pair():
    langs, texts = sample(2000)
    rows = np.vstack([np.append(language_id.features(t), np.float32(1)) for t in texts])
    tracemalloc.start()
    model = language_id.Model.fit(langs, rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(model.predict(t)[0] == lang for lang, t in zip(langs, texts, strict=True)) > 0.97 * len(texts)
    assert most < 0.8 * rows.nbytes, (most, rows.nbytes)  # half for the rows of the one pair
