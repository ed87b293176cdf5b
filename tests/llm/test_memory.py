import re
from pathlib import Path

import pyarrow as pa

from keyloom.llm import common


def resident() -> int:
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024


def test_a_task_gives_back_what_it_freed():
    kept = []

    def run(batches):
        for b in batches:
            held = [bytes(2000) for _ in range(100_000)]
            kept.append(held[-1])  # lies on top of the heap, so nothing below it is given back by itself
            del held
            yield b

    before = resident()
    plain = list(run(iter([pa.record_batch({"a": [1]})])))
    high = resident()
    assert list(common.released(run)(iter([pa.record_batch({"a": [1]})]))) == plain
    assert high - before > 100 and resident() - before < (high - before) / 4


def test_memory_is_given_back_when_a_task_is_stopped(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    got = common.released(iter)(iter([1, 2]))
    assert next(got) == 1
    got.close()
    assert calls == [1]
