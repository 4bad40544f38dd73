"""What a worker holds between tasks."""

from __future__ import annotations

import subprocess
import sys

import pyarrow as pa

from stowage.llm import batches

# The last of many blocks stays in use, so that those before it are freed but not at the heap's end.
LEAVES_BEHIND = """
import pyarrow as pa
from stowage.llm.batches import slices

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096

before = resident()
for _ in slices(iter([pa.record_batch({"text": ["a"]})]), "text"):
    blocks = [bytearray(100_000) for _ in range(1000)]
    last = blocks.pop()
    del blocks
print(resident() - before)
"""


def test_freed_memory_goes_back_after_the_last_run():
    ran = subprocess.run([sys.executable, "-c", LEAVES_BEHIND], capture_output=True, text=True, check=True)
    assert int(ran.stdout) < 50_000_000


def test_runs_hold_all_rows_whatever_is_given_back_between(monkeypatch):
    given = []
    monkeypatch.setattr(batches, "give_back", lambda: given.append(len(seen)))
    monkeypatch.setattr(batches, "GIVEN_BACK_AFTER", 20)
    seen = []
    rows = [pa.record_batch({"text": texts}) for texts in (["abcde"] * 10, [], [None, "", "x" * 50], ["y"])]
    for run in batches.slices(iter(rows), "text", 10):
        seen.extend(run.column(0).to_pylist())
    assert seen == ["abcde"] * 10 + [None, "", "x" * 50, "y"]
    assert given[0] == 0 and given[-1] == len(seen) and len(given) > 3
