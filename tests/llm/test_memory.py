"""Workers outlive their tasks and must not keep what a task has freed."""

from __future__ import annotations

import pyarrow as pa

from scoreloom.llm import common


def test_freed_memory_goes_back_when_the_batches_end(monkeypatch):
    seen = []

    class Library:
        malloc_trim = staticmethod(lambda pad: seen.append(pad))

    monkeypatch.setattr(common.ctypes, "CDLL", lambda name: Library)
    batches = [pa.record_batch({"a": [i]}) for i in range(3)]
    out = common.trimmed(lambda found: (b for b in found))(iter(batches))
    assert next(out) is batches[0] and seen == []
    assert list(out) == batches[1:] and seen == [0]
