from __future__ import annotations

import subprocess
import sys

import pyarrow as pa
from pyspark.sql import functions as F

from linkrisk.llm import quality
from linkrisk.llm.memory import lean

HELD = """
import re, sys
import pyarrow as pa
from linkrisk.llm.memory import give_back, lean

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

give_back()
before = held()
batches = iter([pa.RecordBatch.from_pydict({"text": [f"{k} " + "word " * 1000 for k in range(10_000)]})])
words = 0
for batch in lean(batches, 0):
    words += sum(len(x.split()) for x in batch.column(0).to_pylist())
del batch
assert words == 10_010_000, words
print(held() - before)
"""


def test_lean_keeps_all_rows_in_small_slices():
    texts = [None, "", "ab" * 500_000, *(str(k) * 1000 for k in range(3000)), None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    slices = list(lean(iter([batch, batch.slice(0, 0), batch.slice(5, 7)]), 1, 100_000))
    assert [x for s in slices for x in s.column(0).to_pylist()] == [*range(len(texts)), *range(5, 12)]
    assert [x for s in slices for x in s.column(1).to_pylist()] == [*texts, *texts[5:12]]
    assert all(s.num_rows == 1 or sum(len(x or "") for x in s.column(1).to_pylist()[:-1]) < 100_000 for s in slices)


def test_a_worker_gives_its_memory_back():
    done = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, env={"PYTHONPATH": ":".join(sys.path)}, timeout=120)
    assert float(done.stdout) < 30  # MB; the batch alone has 50


def test_quality_stage_judges_every_row_of_large_batches(docs):
    good = " ".join(f"word{k}" for k in range(3000))
    rows = [(k, (None, "", "too short", good)[k % 4]) for k in range(2000)]
    kept = quality.keep_good(docs(rows).coalesce(1))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(3, 2000, 4)) and kept.where(F.col("text") != good).isEmpty()
