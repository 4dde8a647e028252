"""A worker that encodes holds little at a time, whatever the size of the Arrow batches."""

import subprocess
import sys
from pathlib import Path

CODE = """
import re, threading, time
import numpy as np, pyarrow as pa, public_tokenizers
from quayside.llm import bpe

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024

rng = np.random.default_rng(31)
words = ["".join(map(chr, 97 + rng.integers(0, 26, 9))) for _ in range(200_000)]
texts = [" ".join(words[at: at + 200]) for at in range(0, len(words), 200)] * 4
batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
code = bpe._coder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, 300_000)
before, most, done = held(), 0, False

def watch():
    global most
    while not done:
        most = max(most, held())
        time.sleep(0.02)

watcher = threading.Thread(target=watch)
watcher.start()
got = [x.as_py().decode() for out in code(iter([batch])) for x in out.column(2)]
done = True
watcher.join()
assert got == texts
print("MB", most - before)
"""


def test_a_task_holds_little():
    run = subprocess.run([sys.executable, "-c", CODE], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout.split("MB")[1].split()[0]) < 330, run.stdout
