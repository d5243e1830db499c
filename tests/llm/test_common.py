import pytest

from pathloom.llm import common


def test_lean_gives_memory_back_when_a_task_ends_or_fails(monkeypatch):
    done = []
    monkeypatch.setattr(common, "release", lambda: done.append(1))
    assert list(common.lean(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4] and done == [1]

    def fails(batches):
        yield 1
        raise ValueError

    with pytest.raises(ValueError):
        list(common.lean(fails)(iter([])))
    assert done == [1, 1]


def test_workers_keep_no_free_memory(spark):
    """A task that needs 400 MB in small pieces, then one that reads its worker's size."""
    import numpy as np
    import pyarrow as pa

    def size():
        return int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1]) // 1024

    def run(batches):
        pieces = [np.ones(5000) for _ in range(10_000)]
        last = np.ones(5000)  # keeps the top of the heap
        before = size()
        del pieces
        list(common.lean(lambda batches: batches)(batches))
        yield pa.RecordBatch.from_arrays([pa.array([before]), pa.array([size()]), pa.array([float(last[0])])], names=["before", "after", "last"])

    row = spark.range(1).coalesce(1).mapInArrow(run, "before long, after long, last double").first()
    assert row.before - row.after > 200
