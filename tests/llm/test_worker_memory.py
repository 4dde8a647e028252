"""Workers decode bounded blocks of ids, and give memory back when a task ends."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from quayside.llm import bpe, common


def test_blocks_of_ids_are_bounded(monkeypatch):
    coder = bpe.ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    plain, sizes = coder._decoded, []
    monkeypatch.setattr(coder, "_decoded", lambda block, found: (sizes.append(sum(len(x) for _, x in block)), plain(block, found)))
    tokens = np.array(sorted(coder.ranks.values())[:1000], np.int32)
    documents = [np.tile(tokens, n) for n in (450, 1, 90, 60)] + [np.zeros(0, np.int32)]
    of = {r: t for t, r in coder.ranks.items()}
    assert coder.decode(documents) == [b"".join(of[i] for i in d.tolist()) for d in documents]
    assert sum(sizes) == 601_000 and max(sizes) <= 200_000, sizes


class Mapped:
    """Stands for a table, and says the function that its tasks would call."""

    def __init__(self, spark):
        self.sparkSession = spark

    def mapInArrow(self, function, schema):
        return function


def test_a_task_ends_by_giving_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1), raising=False)
    batches = [pa.RecordBatch.from_pydict({"a": [i]}) for i in range(3)]
    task = common.in_tasks(Mapped(spark), lambda rows: (b.slice(0) for b in rows), "a long")
    assert [b.column(0)[0].as_py() for b in task(iter(batches))] == [0, 1, 2] and calls == [1]
    common.give_back()


def test_sparing_tasks_take_less_at_a_time():
    texts = [f"{i} " + " ".join(f"w{j}" for j in range(40_000)) for i in range(6)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    args = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, 150_000
    large, small = (list(bpe._coder(*args, sparing)(iter([batch]))) for sparing in (False, True))
    assert pa.Table.from_batches(large).equals(pa.Table.from_batches(small))
    assert [b.num_rows for b in small] == [2, 2, 2, 2] and len(large) < len(small)
    assert [x.as_py().decode() for b in small for x in b.column(2)] == [t or "" for t in texts]
